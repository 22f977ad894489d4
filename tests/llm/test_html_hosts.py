"""op10: a plain version of the whole extraction over small hosts, and lists of very many different siblings in little memory."""

import random
import tracemalloc
from collections import Counter, defaultdict

from folio.llm import html


def plain(pages):
    """(page_id, url, text) of pages given as (page_id, url, html): all of a host at once, in dictionaries."""
    hosts = defaultdict(list)
    for page, url, text in pages:
        nodes, blocks = html.parse(text or "")
        own = defaultdict(list)
        for k, t in blocks:
            own[k].append(t)
        free = []
        for parent, _, kind in nodes:
            free.append(kind == html.FREE and (parent < 0 or free[parent]))
        hosts[html.host(url)].append((page, url, nodes, blocks, own, "\n".join(t for k, t in blocks if free[k])))
    out = []
    for rows in hosts.values():
        shape = {html.json.dumps(r[2], ensure_ascii=False): r[2] for r in rows}
        times = Counter(html.json.dumps(r[2], ensure_ascii=False) for r in rows)
        top = shape[min(times, key=lambda s: (-times[s], html.digest(s, 12).hex()))]
        names = {s: html.named(top, nodes) for s, nodes in shape.items()}
        texts, said, pages_of, chars = defaultdict(set), defaultdict(set), Counter(), Counter()
        for tree in shape:  # a tree counts once a name, with all its pages
            mine = [r for r in rows if html.json.dumps(r[2], ensure_ascii=False) == tree]
            for name in set(names[tree]):
                pages_of[name] += len(mine)
                said[name] |= {r[5] for r in mine}
            for r in mine:
                for k, name in enumerate(names[tree]):
                    texts[name].add("\n".join(r[4][k]))
                    chars[name] += sum(map(len, r[4][k]))
        differ = lambda n: len(said[n]) > 1
        same = lambda n: len(texts[n]) == 1 and differ(n)
        common = lambda n: pages_of[n] >= 3 and 2 * pages_of[n] >= len(rows)
        for page, url, nodes, blocks, _, _ in rows:
            content = html._content(
                nodes, names[html.json.dumps(nodes, ensure_ascii=False)], lambda n, within: same(n) and (not within or common(n)),
                lambda n: len(texts[n]) > 1 and differ(n) and chars[n] > 0, lambda n: chars[n] / pages_of[n])
            text = "\n".join(t for k, t in blocks if k in content)
            out.append((page, url, text, len(text)))
    return out


def test_whole_extraction_equals_plain_python(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta".split()) + str(rng.randrange(9))
    pages = []
    for k in range(160):
        host = rng.choice(["hot", "hot", "hot", "b", "c", "one" if k == 7 else "d"])
        parts = ["<div class=menu>home news</div>", "<div class=top>Same on all</div>", f"<article><h1>{word()}</h1>" + "".join(f"<p>{word()} {word()}</p>" for _ in range(rng.randrange(3))) + "</article>"]
        parts += rng.sample([f"<div class=x{rng.randrange(3)}>{word()}</div>", "<ul><li>a<li>b</ul>", f"<section><h2>{word()}</h2><div>fixed</div></section>", "<div class='sidebar ad'>buy <b>now</b></div>", f"<table><tr><td>{rng.randrange(3)}</table>"], rng.randrange(5))
        pages.append((k, f"http://{host}.org/{k}", "<body>" + "".join(parts)))
    pages += [pages[0], (None, None, None), (900, "", "<p>x"), (901, "http://b.org", ""), (902, "http://www.B.org/q", "plain")]
    docs = spark.createDataFrame(pages, "page_id long, url string, html string")
    for most in (2_000_000, 0):
        got = sorted(str(tuple(r)) for r in html.extract(docs, most_broadcast=most).select("page_id", "url", "text", "n_chars").collect())
        assert got == sorted(map(str, plain(pages)))


def test_many_different_siblings_take_little_memory():
    flat = lambda keys: [(-1, "", 0), *[(0, k, 0) for k in keys]]
    n = 5000
    tracemalloc.start()
    to = html.match(flat([f"k{i}" for i in range(n)]), flat([f"k{i}" if i % 10 else f"q{i}" for i in range(n)] + ["k3"]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert to == {0: 0, **{i + 1: i + 1 for i in range(n) if i % 10}}
    assert peak < 30e6  # a table of all pairs would hold 200 MB
    # different subtrees of one key: their weights are kept, in four bytes a pair

    def lists(order):
        nodes = [(-1, "", 0)]
        for i in order:
            at = len(nodes)
            nodes += [(0, "li", 0), *[(at, f"c{b}", 0) for b in range(8) if i >> b & 1]]
        return nodes
    order = list(range(1, 150))
    a, b = lists(order), lists(order[40:] + order[:40])
    to = html.match(a, b)
    assert len(set(to.values())) == len(to) and all(a[p][1] == b[q][1] for q, p in to.items())
    assert sum(x[0] == 0 for x in (b[q] for q in to)) >= 109
