"""The registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import AFTER, BEFORE, CARDS, CUE, CUES, DATES, EMAIL, ENTITIES, NUMBER_TOKEN, REACH, SSN, SSNS, numbers as candidates, shapes
from ..operators import dedup, entities, masking, numbers, ordered, packing, sweep, terms, topk
from ..sources.tables import table

FLAGSHIP = "mask_contacts"
TARGET = 65536
COUNTS = masking.COUNTS


def _masked(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    return masking.mask(table(spark, sf_dir, "documents"), mode)


def mask_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir, "full").select("doc_id", *COUNTS, F.sha2("masked", 256).alias("digest"))


def mask_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir, "partial").select("doc_id", *COUNTS, F.sha2("masked", 256).alias("digest"))


def mask_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir, "full").groupBy("source").agg(*[F.sum(c).alias(c) for c in COUNTS])


def mask_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.findings(table(spark, sf_dir, "documents"))


#: A text of identifiers per order, true ones and false ones, as SQL that Spark and DuckDB read alike: (spaced or dashed SSN, routing number, card, date, amount).
_PAD = "lpad(cast({} as varchar(20)), {}, '0')"
_SSN = ["o_orderkey * 7 % 1000", 3, "o_orderkey * 3 % 100", 2, "o_orderkey * 13 % 10000", 4]
_ssn = lambda sep: f" || '{sep}' || ".join(_PAD.format(e, n) for e, n in zip(_SSN[::2], _SSN[1::2]))
_four = lambda k: _PAD.format(f"o_orderkey * {k} % 10000", 4)
_CARDS = [f"'4' || {_PAD.format('o_orderkey * 17 % 1000', 3)}", _four(31), _four(53), _four(71)]
_DATE = f"cast(1990 + o_orderkey % 40 as varchar(20)) || '-' || {_PAD.format('o_orderkey % 14', 2)} || '-' || {_PAD.format('o_orderkey % 33', 2)}"
_MONEY = f"cast(1 + o_orderkey % 900 as varchar(20)) || '{{}}' || {_PAD.format('o_orderkey * 37 % 1000', 3)}"
IDENTIFIERS = (
    f"'ssn ' || CASE WHEN o_orderkey % 5 = 0 THEN '9' ELSE '' END || CASE WHEN o_orderkey % 2 = 0 THEN {_ssn('-')} ELSE {_ssn(' ')} END || ' aba ' || {_PAD.format('o_orderkey * 1234577 % 1000000000', 9)}"
    f" || ' card ' || CASE WHEN o_orderkey % 3 = 0 THEN {' || '.join(_CARDS)} WHEN o_orderkey % 3 = 1 THEN {' || chr(32) || '.join(_CARDS)} ELSE {' || chr(45) || '.join(_CARDS)} END || ' on ' || {_DATE} || ' paid ' || {_MONEY.format(',')} || '.'"
)
REFORMATTED = f"'paid ' || CASE WHEN o_orderkey % 7 = 0 THEN '1' ELSE '' END || {_MONEY.format('')} || '.'"


def _identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("orders").alias("source"), F.expr(IDENTIFIERS).alias("text"), F.expr(REFORMATTED).alias("after"))


def luhn_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbers.luhn_numbers(table(spark, sf_dir, "documents"))


def card_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbers.card_numbers(_identifiers(spark, sf_dir))


def ssn_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbers.ssn_numbers(_identifiers(spark, sf_dir))


def routing_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbers.routing_numbers(_identifiers(spark, sf_dir))


def calendar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbers.calendar_dates(_identifiers(spark, sf_dir))


def mask_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.mask(_identifiers(spark, sf_dir)).select("doc_id", *COUNTS, "masked")


def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.kinds(table(spark, sf_dir, "documents"))


def number_survival_reformatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.survival(_identifiers(spark, sf_dir).withColumnRenamed("text", "before"), reformatted=True)


def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_copies(table(spark, sf_dir, "documents"))


def pack_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_in_order(table(spark, sf_dir, "documents"), TARGET)


def pack_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.parts(pack_in_order(spark, sf_dir))


#: Rules from the benchmark's items: their first one, two and four words, each replaced by its item's number; SQL that Spark and DuckDB read alike.
_WORDS = {1: "^[^ ]+", 2: "^[^ ]+ [^ ]+", 4: "^[^ ]+ [^ ]+ [^ ]+ [^ ]+"}
_RULES = " UNION ALL ".join(f"SELECT regexp_extract(text, '{p}', 0) AS term, '[' || cast(item_id AS varchar(20)) || '.{k}]' AS replacement FROM benchmark" for k, p in _WORDS.items())


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, union = table(spark, sf_dir, "benchmark"), None
    for k, p in _WORDS.items():
        part = items.select(F.regexp_extract("text", p, 0).alias("term"), F.concat(F.lit("["), F.col("item_id").cast("string"), F.lit(f".{k}]")).alias("replacement"))
        union = part if union is None else union.unionByName(part)
    return union


def _replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), _rules(spark, sf_dir))


def replace_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return _replaced(spark, sf_dir).select("doc_id", F.size("hits").cast("long").alias("n_terms"), n.alias("n"), F.sha2("replaced", 256).alias("digest"))


def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.counts(_replaced(spark, sf_dir), _rules(spark, sf_dir))


#: A secret as it is declared, and what one looks like where it isn't; words for lists of terms.
SECRET, TOKEN = '(?i:token|secret|password|api_key) ?[=:] ?"?([0-9A-Za-z]{16,})', "[0-9A-Za-z]{16,}"
LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
PER_KIND, BUDGET = 3, 5
LIST, LEAST, SHARE = 25, 3, 0.5


def sweep_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sweep.sweep(docs, sweep.declared(docs, SECRET), TOKEN, "[SECRET]").select("doc_id", "n_swept", F.sha2("swept", 256).alias("digest"))


def entity_index_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.capped_index(table(spark, sf_dir, "documents"), PER_KIND, BUDGET)


def common_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.common_words(table(spark, sf_dir, "documents"), "lang", LIST, LETTERS)


def classify_by_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = common_words(spark, sf_dir).select(F.col("lang").alias("label"), "word")
    return topk.classified(table(spark, sf_dir, "documents"), lists, LETTERS, LEAST, SHARE)


#: A row of cells between pipes; seconds of a gap between events, in microseconds; identities over the lines of an order: name, one side, the other, tolerance.
TABLE_LINE, GAP = "[|].*[|]", 1_800_000_000
IDENTITIES = [("total", "total", "net", "0.01"), ("total_before_tax", "total", "gross - discount", "1000"), ("flags", "quantity", "returned + accepted + open", "0"), ("lines", "n_lines", "last_line", "0"), ("discount", "gross - discount", "net - tax", "0.01")]


def _events(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")))
    return events.where(F.col("event_type") == kind) if kind else events


def _matched(direction: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        right = _events(spark, sf_dir, "view").select("user_id", "micros", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
        return ordered.asof(_events(spark, sf_dir, "click").select("event_id", "user_id", "micros"), right, ["user_id"], "micros", direction)

    return query


asof_views, next_views, nearest_views = map(_matched, ("backward", "forward", "nearest"))


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.runs(_events(spark, sf_dir), ["event_type"], "micros", GAP)


#: A labelled number: a word of two letters or more, a sign or none, digits; the share of a key's labels that makes a series dominant.
LABELLED, DOMINANT = "[A-Za-z]{2,}[ #-]?[0-9]+", 0.5


def dominant_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.dominant_series(table(spark, sf_dir, "documents"), "source", LABELLED, DOMINANT)


def table_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.line_runs(table(spark, sf_dir, "documents"), TABLE_LINE, 2)


#: One row an order: what its lines add up to, in exact decimals; SQL that Spark and DuckDB read alike.
_LINE = "SELECT l_orderkey, l_linenumber, l_returnflag AS f, cast(l_quantity AS decimal(18, 2)) AS q, cast(l_extendedprice AS decimal(18, 2)) AS e, cast(l_discount AS decimal(18, 2)) AS d, cast(l_tax AS decimal(18, 2)) AS t FROM lineitem"
_SUMS = f"""SELECT o_orderkey, max(cast(o_totalprice AS decimal(18, 2))) AS total, sum(e) AS gross, sum(cast(e * d AS decimal(18, 4))) AS discount, sum(cast(e * (1 - d) * t AS decimal(20, 6))) AS tax, sum(cast(e * (1 - d) * (1 + t) AS decimal(20, 6))) AS net,
  sum(q) AS quantity, sum(CASE WHEN f = 'R' THEN q ELSE 0 END) AS returned, sum(CASE WHEN f = 'A' THEN q ELSE 0 END) AS accepted, sum(CASE WHEN f = 'N' THEN q ELSE 0 END) AS open, count(l_linenumber) AS n_lines, max(l_linenumber) AS last_line
FROM orders LEFT JOIN ({_LINE}) ON l_orderkey = o_orderkey GROUP BY o_orderkey"""


def order_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = {name: table(spark, sf_dir, name) for name in ("orders", "lineitem")}
    sql = _SUMS.replace("FROM lineitem", "FROM {lineitem}").replace("FROM orders", "FROM {orders}")
    return ordered.identities(spark.sql(sql, **views), IDENTITIES)


def entity_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.entities(table(spark, sf_dir, "documents"))


def number_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.survival(_masked(spark, sf_dir, "full").select("doc_id", F.col("text").alias("before"), F.col("masked").alias("after")))


QUERIES = {f.__name__: f for f in (mask_contacts, mask_partial, mask_totals, mask_findings, luhn_numbers, exact_copies, pack_in_order, pack_parts, entity_index, number_survival, card_numbers, ssn_numbers, routing_numbers, calendar_dates, mask_identifiers, entity_counts, number_survival_reformatted, replace_terms, term_counts, sweep_secrets, entity_index_capped, common_words, classify_by_terms, event_runs, table_runs, order_identities, dominant_series)} | {"asof_views": asof_views, "next_views": next_views, "nearest_views": nearest_views}


_OWN = f"(SELECT o_orderkey AS doc_id, 'orders' AS source, {IDENTIFIERS} AS text, {REFORMATTED} AS after FROM orders)"


_SUM371 = "list_sum(list_transform(range(0, 9), lambda i: substr({0}, i + 1, 1)::INT * [3, 7, 1][i % 3 + 1])) % 10 = 0"
_ABA = f"{_SUM371} AND ({{0}}[1:2]::INT BETWEEN 0 AND 12 OR {{0}}[1:2]::INT BETWEEN 21 AND 32 OR {{0}}[1:2]::INT BETWEEN 61 AND 72 OR {{0}}[1:2] = '80')"
_LUHN_OF = """list_sum(list_transform(range(1, length({0}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse({0}), i, 1)::INT
  ELSE (2 * substr(reverse({0}), i, 1)::INT) // 10 + (2 * substr(reverse({0}), i, 1)::INT) % 10 END)) % 10 = 0"""


def _segments(given: str = "documents") -> str:
    """A row per segment (r, doc_id, source, text, j, k, label, value), from marked matches: e-mails between chr(2), then numbers, in pieces whose other characters are doubled, between chr(1)."""
    near = {label: f"regexp_extract_all(lower(right(b, {REACH})), '{CUE}', 2)[-1] IN ({', '.join(map(repr, words))})" for label, words in CUES.items()}
    return f"""
(WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, text, string_split(regexp_replace(coalesce(text, ''), '({EMAIL})', chr(2) || '\\1' || chr(2), 'g'), chr(2)) AS p FROM {given}),
p AS (SELECT r, doc_id, source, text, unnest(p) AS p, generate_subscripts(p, 1) AS j FROM t),
q AS (SELECT *, CASE WHEN j % 2 = 0 THEN [p] ELSE list_transform(string_split(regexp_replace(regexp_replace(p, '([^0-9])', '\\1\\1', 'g'), '{BEFORE}({candidates(2)}){AFTER}', '\\1' || chr(1) || '\\2' || chr(1) || '\\3', 'g'), chr(1)),
  lambda x: regexp_replace(x, '([^0-9])[^0-9]', '\\1', 'g')) END AS u FROM p),
v AS (SELECT r, doc_id, source, text, j, unnest(u) AS value, unnest(list_prepend('', u[:-2])) AS b, generate_subscripts(u, 1) AS k FROM q),
d AS (SELECT *, translate(value, ' .()+-', '') AS d FROM v)
SELECT r, doc_id, source, text, j, k, value, CASE WHEN j % 2 = 0 THEN 'EMAIL' WHEN k % 2 = 1 THEN NULL
  WHEN d = value THEN CASE WHEN length(d) >= 12 THEN 'NUMBER' WHEN length(d) = 9 AND {near['SSN']} AND regexp_full_match(d[1:3] || '-' || d[4:5] || '-' || d[6:9], '{SSN}') THEN 'SSN'
    WHEN length(d) = 9 AND {near['ROUTING']} AND {_ABA.format('d')} THEN 'ROUTING' WHEN {near['ACCOUNT']} THEN 'ACCOUNT' END
  WHEN length(d) = 9 THEN 'SSN' WHEN length(d) <= 11 THEN 'PHONE' WHEN {_LUHN_OF.format('d')} THEN 'CARD' END AS label FROM d)"""


def _chain(mode: str, given: str = "documents") -> str:
    """doc_id, source, text, the counts and the masked text m, put together from the segments."""
    item = "'[' || label || ']'" if mode == "full" else "'****' || CASE WHEN label = 'EMAIL' THEN regexp_extract(value, '@.*') ELSE right(value, 4) END"
    counts = ", ".join(f"count(*) FILTER (label = '{c[2:].upper()}') AS {c}" for c in COUNTS)
    return f"SELECT doc_id, source, coalesce(text, '') AS text, {counts}, string_agg(CASE WHEN label IS NULL THEN value ELSE {item} END, '' ORDER BY j, k) AS m FROM {_segments(given)} GROUP BY r, doc_id, source, text"


def _found(pattern: str, name: str, given: str) -> str:
    """A row per match: doc_id, seq and the match."""
    return f"(SELECT doc_id, unnest(x) AS {name}, generate_subscripts(x, 1) - 1 AS seq FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}') AS x FROM {given}))"


def _joined(pattern: str) -> str:
    """A row per item of shapes() in the texts of identifiers."""
    return f"(SELECT doc_id, seq, replace(replace(item, '--', '-'), '  ', ' ') AS item FROM (SELECT doc_id, unnest(x) AS item, generate_subscripts(x, 1) - 1 AS seq FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '([^0-9])', '\\1\\1', 'g'), '{pattern}', 2) AS x FROM {_OWN})))"


_LUHN = f"{_LUHN_OF.format('digits')} AS valid"

#: One fold over all documents, a row at a time.
_FOLD = f"""
WITH RECURSIVE d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS bytes, row_number() OVER (ORDER BY doc_id NULLS FIRST, octet_length(encode(coalesce(text, '')))) AS k FROM documents),
p AS (SELECT doc_id, k, bytes, 0::BIGINT AS part, bytes AS total FROM d WHERE k = 1
  UNION ALL SELECT d.doc_id, d.k, d.bytes, CASE WHEN total > 0 AND total + d.bytes > {TARGET} THEN part + 1 ELSE part END, CASE WHEN total > 0 AND total + d.bytes > {TARGET} THEN d.bytes ELSE total + d.bytes END
  FROM p JOIN d ON d.k = p.k + 1)"""

#: rules; texts cut at the terms, longest first, into pieces of which every second one is a term.
_TERMS = f"""
WITH rules AS (SELECT term, min(replacement) AS replacement FROM ({_RULES}) WHERE term <> '' GROUP BY term),
p AS (SELECT '(' || string_agg(regexp_escape(term), '|' ORDER BY length(term) DESC, term) || ')' AS p FROM rules),
t AS (SELECT row_number() OVER () AS r, doc_id, string_split(regexp_replace(coalesce(text, ''), (SELECT p FROM p), chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS x FROM documents),
s AS (SELECT r, doc_id, unnest(x) AS piece, generate_subscripts(x, 1) AS k FROM t),
m AS (SELECT r, doc_id, k, piece, replacement, CASE WHEN k % 2 = 0 THEN term END AS term FROM s LEFT JOIN rules ON k % 2 = 0 AND term = piece)"""

_ENTITIES = "SELECT doc_id, kind, seq, value FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(x) AS value, generate_subscripts(x, 1) - 1 AS seq FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{p}') AS x FROM documents)" for k, p in ENTITIES) + ")"
_lower = lambda c: f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_COMMON = f"""
WITH c AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_docs DESC, word) AS rank FROM (SELECT lang, word, count(*) AS n_docs FROM (SELECT lang, unnest(list_distinct(regexp_extract_all({_lower("coalesce(text, '')")}, '{LETTERS}'))) AS word FROM documents) GROUP BY ALL) QUALIFY rank <= {LIST})"""

#: Clicks with the last view at or before and the first at or after.
_NEAR = """
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS micros, event_type, value FROM events),
v AS (SELECT user_id, micros, max({'micros': micros, 'view_id': event_id, 'view_value': value}) AS v FROM e WHERE event_type = 'view' GROUP BY user_id, micros)
SELECT event_id, user_id, micros, (SELECT max_by(v, v.micros) FROM v WHERE v.user_id = e.user_id AND v.micros <= e.micros) AS back, (SELECT min_by(v, v.micros) FROM v WHERE v.user_id = e.user_id AND v.micros >= e.micros) AS ahead FROM e WHERE event_type = 'click'"""

ORACLES = {
    "mask_contacts": f"SELECT doc_id, {', '.join(COUNTS)}, sha256(m) AS digest FROM ({_chain('full')})",
    "mask_partial": f"SELECT doc_id, {', '.join(COUNTS)}, sha256(m) AS digest FROM ({_chain('partial')})",
    "mask_totals": f"SELECT source, {', '.join(f'sum({c})::BIGINT AS {c}' for c in COUNTS)} FROM ({_chain('full')}) GROUP BY source",
    "mask_identifiers": f"SELECT doc_id, {', '.join(COUNTS)}, m AS masked FROM ({_chain('full', _OWN)})",
    "mask_findings": f"""
SELECT doc_id, count(label) OVER w - 1 AS seq, label, (sum(length(value)) OVER w - length(value))::BIGINT AS start, length(value) AS length, value
FROM {_segments()} WINDOW w AS (PARTITION BY r ORDER BY j, k) QUALIFY label IS NOT NULL""",
    "luhn_numbers": f"SELECT doc_id, seq, digits, {_LUHN} FROM {_found('[0-9]+', 'digits', 'documents')} WHERE length(digits) BETWEEN 12 AND 19",
    "card_numbers": f"SELECT *, {_LUHN} FROM (SELECT doc_id, seq, item, translate(item, ' -', '') AS digits FROM {_joined(shapes(CARDS, ' -'))})",
    "ssn_numbers": f"SELECT doc_id, seq, item, regexp_full_match(item, '{SSN}') AS valid FROM {_joined(shapes(SSNS, ' -'))}",
    "routing_numbers": f"SELECT doc_id, seq, digits, {_ABA.format('digits')} AS valid FROM {_found('[0-9]+', 'digits', _OWN)} WHERE length(digits) = 9",
    "calendar_dates": f"SELECT doc_id, seq, item, try_cast(item AS DATE) IS NOT NULL AS valid FROM {_joined(shapes(DATES, '-'))}",
    "entity_counts": "SELECT kind, count(*) AS n, count(DISTINCT value) AS n_values FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, unnest(regexp_extract_all(coalesce(text, ''), '{p}')) AS value FROM documents" for k, p in ENTITIES) + ") GROUP BY kind",
    "number_survival_reformatted": f"""
SELECT doc_id, len(b) AS total, len(list_intersect(b, a)) AS preserved, len(b) - len(list_intersect(b, a)) AS missing
FROM (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '{NUMBER_TOKEN}'), lambda x: replace(x, ',', ''))) AS b, list_distinct(list_transform(regexp_extract_all(after, '{NUMBER_TOKEN}'), lambda x: replace(x, ',', ''))) AS a FROM {_OWN})""",
    "exact_copies": """
SELECT doc_id, digest, min(doc_id) OVER w AS first_doc_id, count(*) OVER w AS n_copies, coalesce(doc_id > min(doc_id) OVER w, min(doc_id) OVER w IS NOT NULL) AS is_copy
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents) WINDOW w AS (PARTITION BY digest)""",
    "pack_in_order": f"{_FOLD} SELECT doc_id, part, bytes FROM p",
    "pack_parts": f"{_FOLD} SELECT part, min(doc_id) AS first_doc_id, max(doc_id) AS last_doc_id, count(*) AS n_docs, sum(bytes)::BIGINT AS bytes FROM p GROUP BY part",
    "replace_terms": f"{_TERMS} SELECT doc_id, count(DISTINCT term) AS n_terms, count(term) AS n, sha256(string_agg(CASE WHEN term IS NULL THEN piece ELSE replacement END, '' ORDER BY k)) AS digest FROM m GROUP BY r, doc_id",
    "term_counts": f"{_TERMS} SELECT rules.term, rules.replacement, count(DISTINCT r) AS n_docs, count(r) AS n FROM rules LEFT JOIN m ON rules.term = m.term GROUP BY ALL",
    "sweep_secrets": f"""
WITH terms AS (SELECT DISTINCT unnest(regexp_extract_all(coalesce(text, ''), '{SECRET}', 1)) AS term FROM documents),
t AS (SELECT row_number() OVER () AS r, doc_id, string_split(regexp_replace(coalesce(text, ''), '({TOKEN})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS x FROM documents),
s AS (SELECT r, doc_id, unnest(x) AS piece, generate_subscripts(x, 1) AS k FROM t)
SELECT doc_id, count(term) AS n_swept, sha256(string_agg(CASE WHEN term IS NULL THEN piece ELSE '[SECRET]' END, '' ORDER BY k)) AS digest FROM s LEFT JOIN terms ON k % 2 = 0 AND term = piece GROUP BY r, doc_id""",
    "entity_index_capped": f"""
WITH f AS (SELECT doc_id, kind, value, min(seq) AS seq FROM ({_ENTITIES}) GROUP BY ALL),
c AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, kind ORDER BY seq) <= {PER_KIND})
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq, kind) AS place FROM c QUALIFY place <= {BUDGET}""",
    "common_words": f"{_COMMON} SELECT lang, word, n_docs, rank FROM c",
    "classify_by_terms": f"""
{_COMMON},
t AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (SELECT r, unnest(x) AS part, generate_subscripts(x, 1) AS line FROM (SELECT r, string_split(coalesce(text, ''), chr(10)) AS x FROM t)),
m AS (SELECT r, line, lang AS label, word FROM (SELECT r, line, unnest(list_distinct(regexp_extract_all({_lower('part')}, '{LETTERS}'))) AS word FROM l) JOIN c USING (word) WHERE lang IS NOT NULL),
s AS (SELECT r, label, count(DISTINCT word) AS score FROM m GROUP BY r, label QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, label) = 1),
b AS (SELECT r, line, label, count(*) AS n FROM m GROUP BY r, line, label QUALIFY row_number() OVER (PARTITION BY r, line ORDER BY n DESC, label) = 1),
v AS (SELECT r, label AS vote, n_votes, n_parts FROM (SELECT r, label, count(*) AS n_votes, sum(count(*)) OVER (PARTITION BY r) AS n_parts FROM b GROUP BY r, label) QUALIFY row_number() OVER (PARTITION BY r ORDER BY n_votes DESC, label) = 1),
o AS (SELECT doc_id, CASE WHEN score >= {LEAST} THEN label END AS label, coalesce(score, 0) AS score, coalesce(n_parts, 0)::BIGINT AS n_parts, coalesce(n_votes, 0) AS n_votes, vote FROM t LEFT JOIN s USING (r) LEFT JOIN v USING (r))
SELECT *, coalesce(vote = label AND n_votes >= n_parts * {SHARE}, false) AS settled FROM o""",
    "asof_views": f"SELECT event_id, user_id, micros, back.micros AS matched_at, back.view_id, back.view_value FROM ({_NEAR})",
    "next_views": f"SELECT event_id, user_id, micros, ahead.micros AS matched_at, ahead.view_id, ahead.view_value FROM ({_NEAR})",
    "nearest_views": f"SELECT event_id, user_id, micros, x.micros AS matched_at, x.view_id, x.view_value FROM (SELECT *, CASE WHEN back IS NOT NULL AND (ahead IS NULL OR micros - back.micros <= ahead.micros - micros) THEN back ELSE ahead END AS x FROM ({_NEAR}))",
    "event_runs": f"""
WITH e AS (SELECT event_type, epoch_us(ts) AS m FROM events),
f AS (SELECT *, CASE WHEN m - lag(m) OVER w > {GAP} OR lag(m) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY event_type ORDER BY m)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY m)::BIGINT AS run FROM f)
SELECT event_type, run, min(m) AS first, max(m) AS last, count(*) AS n FROM r GROUP BY event_type, run""",
    "table_runs": f"""
WITH l AS (SELECT r, doc_id, unnest(x) AS t, generate_subscripts(x, 1) - 1 AS line FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
h AS (SELECT *, line - row_number() OVER (PARTITION BY r ORDER BY line) AS g FROM l WHERE regexp_matches(t, '{TABLE_LINE}'))
SELECT doc_id, min(line) AS first_line, count(*) AS n_lines, sum(length(t))::BIGINT AS n_chars FROM h GROUP BY r, doc_id, g HAVING count(*) >= 2""",
    "order_identities": " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) AS n, count(abs(({a}) - ({b}))) AS testable, count(*) FILTER (abs(({a}) - ({b})) <= {t}) AS passed, max(abs(({a}) - ({b})))::DOUBLE AS worst FROM ({_SUMS})" for n, a, b, t in IDENTITIES),
    "dominant_series": f"""
WITH l AS (SELECT source, unnest(regexp_extract_all(coalesce(text, ''), '{LABELLED}')) AS x FROM documents),
n AS (SELECT source, {_lower("regexp_replace(x, '[0-9]+$', '')")} AS series, regexp_extract(x, '[0-9]+$') AS number FROM l),
s AS (SELECT source, series, count(*) AS n, count(DISTINCT number::BIGINT) AS n_numbers, min(number::BIGINT) AS first, max(number::BIGINT) AS last FROM n WHERE length(number) <= 9 GROUP BY ALL),
b AS (SELECT *, sum(n) OVER (PARTITION BY source)::BIGINT AS n_labels FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, n_numbers DESC, series) = 1)
SELECT d.source, coalesce(n_labels, 0) AS n_labels, series, coalesce(n, 0) AS n, coalesce(n_numbers, 0) AS n_numbers, first, last, last - first + 1 - n_numbers AS missing, n_numbers / (last - first + 1) AS density, coalesce(n >= n_labels * {DOMINANT}, false) AS dominant
FROM (SELECT DISTINCT source FROM documents) d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source""",
    "entity_index": _ENTITIES,
    "number_survival": f"""
SELECT doc_id, len(b) AS total, len(list_intersect(b, a)) AS preserved, len(b) - len(list_intersect(b, a)) AS missing
FROM (SELECT doc_id, list_distinct(regexp_extract_all(text, '{NUMBER_TOKEN}')) AS b, list_distinct(regexp_extract_all(m, '{NUMBER_TOKEN}')) AS a FROM ({_chain('full')}))""",
}
