"""HTML extraction by wrapper induction.

Each page becomes a tree of its block elements, runs of like siblings merged, and a list of text blocks with their node. Pages
of a host are counted per distinct tree, with whether each node's text is the same on all of them; that is a map-side
aggregate, so a host with a third of all pages is no hot group. The host's commonest tree goes to its other trees, which may be
as many as its pages, dealt into parts; there each tree, of any size, is aligned with it on its own by simple tree matching (the
largest order-keeping match, by dynamic programming). Nodes without a partner are known by their parent's name and their own
key. What the host's trees say of a node of one name meets in an aggregate and goes back to the trees that have it. A node is template if its text is the same on all pages that have it, and those pages differ
elsewhere; the others are slots. A page's content is its slots. An article or main element is evidence only: inside one, template
also takes three pages and half of the host's, so that copies of an article stay. Where no text of a page is seen to vary (hosts
of one page or of copies), the page's article or main element is its content, or else all its text.

Menus, footers, scripts and the like, by element name, are never content. Words in class, role or id mark an element as doubtful:
it goes unless it holds an article or main element or over half of the page's varying text, or lies where most of that text
lies and has varying text itself.

Defined results: null html is the empty page with empty text; a page cut off in a tag, also in a quoted value, loses that tag
only; a quoted value that never ends goes to the next ">"; pages without url are one host; repeated rows, also of one page_id,
each give a row; a null page_id is kept; extra columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter, defaultdict
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import heavy_keys, spread_join
from .common import discard, staged, table

#: Element names by role (fixed values).
INLINE = set("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins kbd label mark meter noscript output picture q ruby rb rt rp s samp small source span strike strong sub sup time tt u var wbr del nobr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes".split())
BOILER = set("head nav footer aside form script style title textarea button select option svg math template iframe object embed canvas audio video dialog menu fieldset input noembed noframes xmp".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

HINT = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|side|menu|nav\w*|breadcrumbs?|footer|header|masthead|cookies?|consent|notice|popup|modal|overlay|comments?|replies|respond|disqus|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|toolbar|widget)(?:$|[\s_-])", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S)
ATTR = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"\s+")


#: What is known of a node by itself.
FREE, BOILERPLATE, DOUBTFUL = range(3)


def parse(page: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str]]]:
    """(nodes as (parent, key, kind), blocks as (node, text)); like siblings in a row share a node."""
    nodes = [(-1, "", FREE)]
    blocks: list[tuple[int, str]] = []
    inside = [False]  # whether a node is an article or main element or in one
    stack = [("", 0)]  # open block elements
    last: dict[int, int] = {}  # node to its latest child node
    buf: list[str] = []

    def flush():
        if buf:
            text = SPACE.sub(" ", entities.unescape("".join(buf))).strip()
            buf.clear()
            if text:
                blocks.append((stack[-1][1], text))

    at, n = 0, len(page)
    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            buf.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                buf.append(" ")
            continue
        flush()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in CLOSES[tag]:
                    del stack[k:]
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "select", "menu"):
                    break
        elif stack[-1][0] == "p" or stack[-1][0][:1] == "h" and stack[-1][0][1:].isdigit() and tag[:1] == "h" and tag[1:].isdigit():
            stack.pop()
        attrs = m[3]
        key, hint = tag, False
        within = inside[stack[-1][1]]
        if attrs:
            found = [(a.lower(), x or y or z) for a, x, y, z in ATTR.findall(attrs)]
            if found:
                heading = tag[:1] == "h" and tag[1:].isdigit()
                hint = tag not in ("html", "body", "main", "article") and not heading and any(HINT.search(v) for a, v in found if a != "id" or not within) or tag == "article" and any(re.search(r"(?:^|[\s_-])comments?(?:$|[\s_-])", v) for _, v in found)
                key = tag + "".join(f" {a}={v}" for a, v in found if a != "id")
        parent = stack[-1][1]
        kind = BOILERPLATE if nodes[parent][2] == BOILERPLATE or tag in BOILER or tag == "header" and not within else DOUBTFUL if hint else FREE
        child = last.get(parent)
        if child is None or nodes[child][1:] != (key, kind):
            child = len(nodes)
            nodes.append((parent, key, kind))
            inside.append(within or tag in ("article", "main"))
            last[parent] = child
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not attrs.endswith("/"):
            stack.append((tag, child))
    if at < n:
        buf.append(page[at:])
    flush()
    return nodes, blocks


def host(url) -> str:
    m = re.match(r"[a-z][a-z0-9+.-]*://([^/?#]*)", url or "", re.I)
    return (m[1] if m else "").lower().rpartition("@")[2].removeprefix("www.").removeprefix("m.")


def digest(text: str, size: int) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=size).digest()


def _parse(batches):
    for b in batches:
        out = defaultdict(list)
        for page, url, text in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html"))):
            nodes, blocks = parse(text or "")
            own = defaultdict(list)
            for k, t in blocks:
                own[k].append(t)
            shape = json.dumps(nodes, ensure_ascii=False)
            plain = [x[2] == FREE for x in nodes]
            for k, x in enumerate(nodes):
                plain[k] = plain[k] and (x[0] < 0 or plain[x[0]])
            out["page_id"].append(page)
            out["url"].append(url)
            out["host"].append(host(url))
            out["tree"].append(digest(shape, 12).hex())
            out["shape"].append(shape)
            out["at"].append([k for k, _ in blocks])
            out["block"].append([t for _, t in blocks])
            out["said"].append(int.from_bytes(digest("\n".join(t for k, t in blocks if plain[k]), 7)))
            out["sums"].append([int.from_bytes(digest("\n".join(own[k]), 7)) for k in range(len(nodes))])
            out["chars"].append([sum(map(len, own[k])) for k in range(len(nodes))])
        kinds = {"page_id": pa.int64(), "at": pa.list_(pa.int32()), "block": pa.list_(pa.string()), "said": pa.int64(), "sums": pa.list_(pa.int64()), "chars": pa.list_(pa.int32())}
        yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()], list(out))


PARSED = "page_id long, url string, host string, tree string, shape string, at array<int>, block array<string>, said long, sums array<long>, chars array<int>"


def children(nodes) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in nodes]
    for k, (parent, _, _) in enumerate(nodes):
        if parent >= 0:
            out[parent].append(k)
    return out


def _rows(dense, rows, c, d, turned=False):
    """The last row of the alignment's table: the best sums of weights of all of rows with more and more of the elements c to d."""
    out = np.zeros(d - c + 1, np.int64)
    for p in rows:
        w = dense(p, c, d)
        if w is not None:  # a row of zeros changes nothing, as sums never fall along it
            out[1:] = np.maximum.accumulate(np.maximum(out[1:], out[:-1] + (w[::-1] if turned else w)))
    return out


def align(dense, n: int, m: int) -> list[tuple[int, int]]:
    """Positions (p, q) of the order-keeping pairs of n and m elements with the largest sum of weights; dense(p, c, d) gives those of p
    with c to d, None if all are 0. Memory grows with n + m."""
    out, todo = [], [(0, n, 0, m)]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        if b - a == 1:
            w = dense(a, c, d)
            if w is not None:
                out.append((a, c + int(w.argmax())))
            continue
        mid = (a + b) // 2
        q = c + int((_rows(dense, range(a, mid), c, d) + _rows(dense, range(b - 1, mid - 1, -1), c, d, True)[::-1]).argmax())
        todo += [(a, mid, c, q), (mid, b, q, d)]
    return out


def classes(nodes, known: dict) -> list[int]:
    """A number for each node, equal where the trees below are; known maps (key, children's numbers) to it."""
    below = children(nodes)
    out = [0] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):  # children come after their parents
        what = (nodes[k][1], tuple(out[c] for c in below[k]))
        if what not in known:
            known[what] = len(known)
        out[k] = known[what]
    return out


def match(a, b) -> dict[int, int]:
    """Simple tree matching: b's nodes that match a's, by the largest order-keeping match of equal keys from the roots down.

    Equal subtrees at either end of two lists of children are paired without a table, which loses nothing: no other partner has
    a larger match. No table of two lists is held, only its rows, one at a time. What is held per pair, in four bytes, is the weight
    of two different subtrees of one key that both have children; time grows with the product of two lists' lengths. Neither
    depth nor size is bounded.
    """
    known: dict = {}
    ia, ib = classes(a, known), classes(b, known)
    keys, kids, nodes, place, count = [], [], [], [], Counter()
    for key, below in known:
        keys.append(key)
        kids.append(below)
        nodes.append(1 + sum(nodes[c] for c in below))
        place.append(count[key])  # among the classes of its key that have children
        count[key] += bool(below)
    weights: dict = {}  # by key, the weights of pairs of its classes that have children; 0: not known yet

    def ends(x, y):
        n, head, tail = min(len(x), len(y)), 0, 0
        while head < n and x[head] == y[head]:
            head += 1
        while tail < n - head and x[-1 - tail] == y[-1 - tail]:
            tail += 1
        return head, tail

    def of(key):
        if key not in weights:
            weights[key] = np.zeros((count[key], count[key]), np.int32)
        return weights[key]

    def middle(i, j):
        x, y = kids[i], kids[j]
        head, tail = ends(x, y)
        return head, tail, x[head : len(x) - tail], y[head : len(y) - tail]

    def unknown(i, j):
        return i != j and keys[i] == keys[j] and kids[i] and kids[j] and not of(keys[i])[place[i], place[j]]

    def wanted(i, j):
        """The pairs of children whose weights the pair's table needs, one after the other."""
        _, _, x, y = middle(i, j)
        same = defaultdict(list)
        for q in dict.fromkeys(y):
            if kids[q]:
                same[keys[q]].append(q)
        for p in dict.fromkeys(x):
            if kids[p]:
                for q in same.get(keys[p], ()):
                    yield p, q

    def rows(x, y):
        """dense(p, c, d) for align: the weights of x[p] with y[c:d]."""
        at = defaultdict(list)
        for q, j in enumerate(y):
            at[keys[j]].append(q)
        at = {k: np.array(v) for k, v in at.items()}
        leaf, col, number = np.array([not kids[j] for j in y], bool), np.array([place[j] for j in y]), np.array(y)

        def dense(p, c, d):
            i, where = x[p], at.get(keys[x[p]])
            if where is None:
                return None
            where = where[np.searchsorted(where, c) : np.searchsorted(where, d)]
            if not len(where):
                return None
            w = np.zeros(d - c, np.int64)
            if kids[i] and not leaf[where].all():
                w[where - c] = np.where(leaf[where], 1, np.where(number[where] == i, nodes[i], of(keys[i])[place[i], np.where(leaf[where], 0, col[where])]))
            else:
                w[where - c] = 1
            return w

        return dense

    todo = [(ia[0], ib[0], wanted(ia[0], ib[0]))] if unknown(ia[0], ib[0]) else []
    while todo:
        i, j, pairs = todo[-1]
        below = next(((p, q) for p, q in pairs if unknown(p, q)), None)
        if below:
            todo.append((*below, wanted(*below)))
            continue
        head, tail, x, y = middle(i, j)
        of(keys[i])[place[i], place[j]] = 1 + sum(nodes[c] for c in kids[i][:head]) + sum(nodes[c] for c in kids[i][len(kids[i]) - tail :]) + int(_rows(rows(x, y), range(len(x)), 0, len(y))[-1])
        todo.pop()

    ca, cb, out, todo = children(a), children(b), {}, [(0, 0)]
    while todo:
        p, q = todo.pop()
        out[q] = p
        if ia[p] == ib[q]:
            todo += zip(ca[p], cb[q])
            continue
        head, tail, x, y = middle(ia[p], ib[q])
        todo += zip(ca[p][:head], cb[q][:head])
        todo += zip(ca[p][len(ca[p]) - tail :], cb[q][len(cb[q]) - tail :])
        if x and y:
            todo += [(ca[p][head + k], cb[q][head + l]) for k, l in align(rows(x, y), len(x), len(y))]
    return out


def _content(nodes, names, constant, varied, chars):
    """The content nodes of a tree; constant(name, in an article) and varied(name) are what the host's pages say."""
    n = len(nodes)
    root, plain = [-1] * n, [True] * n
    for k, (parent, key, kind) in enumerate(nodes):
        plain[k] = kind != BOILERPLATE
        root[k] = k if key.split(" ")[0] in ("article", "main") and kind == FREE else root[parent] if parent >= 0 else -1
    times = Counter(names)
    slot = [plain[k] and not constant(names[k], root[k] >= 0) for k in range(n)]
    moves = [plain[k] and varied(names[k]) for k in range(n)]
    mass = [chars(names[k]) / times[names[k]] if slot[k] else 0 for k in range(n)]
    holds, stirs = [root[k] == k for k in range(n)], list(moves)
    for k in range(n - 1, 0, -1):
        parent = nodes[k][0]
        mass[parent] += mass[k]
        holds[parent] |= holds[k]
        stirs[parent] |= stirs[k]
    most, below = 0, children(nodes)
    while heavy := [c for c in below[most] if mass[c] * 2 > mass[0]]:
        most = heavy[0]
    region = root[most] if root[most] >= 0 else most
    within, gone = [False] * n, [False] * n
    for k, (parent, _, kind) in enumerate(nodes):
        within[k] = k == region or parent >= 0 and within[parent]
        gone[k] = parent >= 0 and gone[parent] or kind == DOUBTFUL and not (holds[k] or mass[k] * 2 > mass[0] or within[k] and stirs[k])
    free = [k for k in range(n) if plain[k] and not gone[k]]
    if any(moves[k] for k in free):
        return [k for k in free if slot[k]]
    return [k for k in free if root[k] >= 0] or free


def named(first, nodes) -> list[int]:
    """A name for each node: its partner's place in the host's commonest tree, or else a hash of its parent's name and its own key."""
    to, names = match(first, nodes), []
    for k, (parent, key, _) in enumerate(nodes):
        names.append(to[k] if k in to else 1 << 56 | int.from_bytes(digest(f"{names[parent]} {key}", 7)))
    return names


def _align(batches):
    """Of each tree its nodes' names, and of each name in it the least and greatest text sums and the characters."""
    for b in batches:
        out = defaultdict(list)
        for top, shape, low, high, chars in zip(*(b.column(c).to_pylist() for c in ("top", "shape", "low", "high", "chars"))):
            names = named(json.loads(top), json.loads(shape))
            own: dict = {}
            for k, name in enumerate(names):
                x = own.setdefault(name, [low[k], high[k], 0])
                own[name] = [min(x[0], low[k]), max(x[1], high[k]), x[2] + chars[k]]
            out["names"].append(names)
            out["name"].append(list(own))
            for i, c in enumerate(("lo", "hi", "sum")):
                out[c].append([x[i] for x in own.values()])
        kept = ["host", "tree", "shape", "pages", "least", "most", "total"]
        yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(out[c], pa.list_(pa.int64())) for c in ("names", "name", "lo", "hi", "sum")], [*kept, "names", "name", "lo", "hi", "sum"])


ALIGNED = "host string, tree string, shape string, pages long, least long, most long, total long, names array<long>, name array<long>, lo array<long>, hi array<long>, sum array<long>"


def _decide(batches):
    """Of each node of each tree whether it is content, by what its host's trees say of its nodes' names."""
    for b in batches:
        out = []
        for shape, names, said in zip(*(b.column(c).to_pylist() for c in ("shape", "names", "said"))):
            of = {x["name"]: x for x in said}
            content = set(_content(json.loads(shape), names, lambda n, within: of[n]["same"] and (not within or of[n]["common"]), lambda n: of[n]["varied"], lambda n: of[n]["chars"]))
            out.append([k in content for k in range(len(names))])
        yield pa.RecordBatch.from_arrays([b.column("host"), b.column("tree"), pa.array(out, pa.list_(pa.bool_()))], ["host", "tree", "content"])


def wrappers(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, tree, content: whether each node is) and (host, tree, pages); no host's trees are gathered, each is aligned and decided on its own."""
    each = parsed.select("host", "tree", F.posexplode(F.arrays_zip("sums", "chars")).alias("k", "x"))
    sums = each.groupBy("host", "tree", "k").agg(F.min("x.sums").alias("low"), F.max("x.sums").alias("high"), F.sum(F.col("x.chars").cast("long")).alias("chars"))
    sums = sums.groupBy("host", "tree").agg(F.array_sort(F.collect_list(F.struct("k", "low", "high", "chars"))).alias("x")).select("host", "tree", F.col("x.low").alias("low"), F.col("x.high").alias("high"), F.col("x.chars").alias("chars"))
    trees = parsed.groupBy("host", "tree").agg(F.first("shape").alias("shape"), F.count(F.lit(1)).alias("pages"), F.min("said").alias("least"), F.max("said").alias("most"))
    trees = staged(trees.join(sums, ["host", "tree"]), "trees")
    tops = trees.groupBy("host").agg(F.min_by("shape", F.struct(-F.col("pages"), "tree")).alias("top"), F.sum("pages").alias("total"), F.count(F.lit(1)).alias("n"))
    tops = staged(tops, "tops")
    heavy = heavy_keys(tops, ["host"], trees.count())
    aligned = staged(spread_join(trees, tops.drop("n"), ["host"], heavy, F.xxhash64("tree")).mapInArrow(_align, ALIGNED), "aligned", 250)
    votes = aligned.select("host", "pages", "least", "most", "total", F.explode(F.arrays_zip("name", "lo", "hi", "sum")).alias("x")).select("*", "x.*")
    votes = votes.groupBy("host", "name").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("pages").alias("pages"), F.sum("sum").alias("chars"), F.max("total").alias("total"), F.count(F.lit(1)).alias("n"))
    differ = F.col("least") != F.col("most")  # the host's pages that have the node differ somewhere
    votes = staged(votes.select(
        "host", "name", "n", ((F.col("lo") == F.col("hi")) & differ).alias("same"), ((F.col("pages") >= 3) & (2 * F.col("pages") >= F.col("total"))).alias("common"),
        ((F.col("lo") != F.col("hi")) & differ & (F.col("chars") > 0)).alias("varied"), (F.col("chars") / F.col("pages")).alias("chars")), "votes")
    asked = aligned.select("host", "tree", F.explode("name").alias("name"))
    said = spread_join(asked, votes.drop("n"), ["host", "name"], heavy_keys(votes, ["host", "name"], asked.count()))
    said = said.groupBy("host", "tree").agg(F.collect_list(F.struct("name", "same", "common", "varied", "chars")).alias("said"))
    rules = staged(aligned.select("host", "tree", "shape", "names").join(said, ["host", "tree"]).mapInArrow(_decide, "host string, tree string, content array<boolean>"), "wrappers", 250)
    discard(tops, aligned, votes)
    return rules, trees.select("host", "tree", "pages")


def extract(pages: DataFrame, most_broadcast: int = 2_000_000) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html)."""
    parsed = staged(pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_parse, PARSED), "pages", 1000)
    rules, trees = wrappers(parsed)
    n = rules.agg(F.sum(F.lit(30) + F.size("content"))).first()[0] or 0  # entries of the table: beyond most_broadcast the join is shuffled
    keys = ["host", "tree"]
    given = parsed.select("page_id", "url", "host", "tree", "at", "block")
    if n <= most_broadcast:
        picked = given.join(F.broadcast(rules), keys, "left")
    else:
        heavy = heavy_keys(trees, keys, parsed.count(), "pages")
        picked = spread_join(given, rules, keys, heavy, F.monotonically_increasing_id(), "left")
    chosen = F.filter("block", lambda x, i: F.col("content")[F.col("at")[i]])
    return picked.select("page_id", "url", F.coalesce(F.array_join(chosen, "\n"), F.lit("")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
