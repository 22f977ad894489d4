"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Measures of each whole text are compared with cutoffs. The labelled holdout of each stratum (a language) consists of different texts:
copies of a text are one trial, with its lowest label, and a hash of the text halves the holdout, so that no text stands in both
halves and trials are independent. The first half proposes: for every measure the cutoff that gains most (bad texts rejected less good texts rejected, the
largest of equals) among those that reject at most alpha / (number of measures) of its good texts; these cutoffs are put in
order, those that reject fewest good texts first, and one stays if, of the texts that none before it rejects, it rejects more bad
than good ones. The second half tests them as a fixed sequence: the first cutoff alone, the
first two together, and so on, each by an exact binomial test, over the good texts, of the rejections by any of them against
alpha, at level delta / (number of strata), until a test fails; the cutoffs before that are admitted. Fixed-sequence testing
needs no correction within a stratum, and Bonferroni corrects between strata: so with probability 1 - delta no stratum loses
more than alpha of the good texts that pass the base rules.

Defined results: null text has no words and fails the base rules; a null language is a stratum of its own; documents and texts labelled
more than once count once, with their lowest label; strata without enough labels have no cutoffs, so only the base rules reject
there; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.skew import spread_join
from .common import staged, table

ALPHA, DELTA = 0.05, 0.05
#: Cutoffs tried for every measure, per thousand (fixed values).
GRID = [5, 10, 20, 30, 50, 75, 100, 150, 200, 300, 400, 500, 600, 800]
#: Per-thousand measures and the counts they come from.
MEASURES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "marks": ("n_marks", "word_chars"),
    "pipes": ("n_pipes", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_pipes", "n_capitals"]
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def measured(docs: DataFrame) -> DataFrame:
    """docs with the counts of COUNTS, text_md5 and base_failed; every other column stays as it is."""
    own = ["_t", "_w", "_h", "_s", "_p", "_l"]
    without = lambda chars: F.length("_t") - F.length(F.translate("_t", chars, ""))
    d = docs.withColumn("_t", F.coalesce(F.col("text"), F.lit("")))
    d = d.withColumn("_w", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))
    d = d.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    d = d.withColumn("_l", F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD)))
    # all 3-word windows, sorted by hash so that equal ones are neighbours
    tri = F.transform(F.slice("_h", 1, F.greatest(F.size("_h") - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.col("_h")[i + 1], F.col("_h")[i + 2]).alias("h"), i.alias("i")))
    d = d.withColumn("_s", F.sort_array(tri))
    same = lambda x, k: F.coalesce(F.get("_s", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_s", k + 1)["h"] == x["h"], F.lit(False))
    d = d.withColumn("_p", F.sort_array(F.transform(F.filter("_s", same), lambda x: x["i"])))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at"))
    covered = F.aggregate("_p", start, lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["at"])).alias("n"), x.alias("at")), lambda a: a["n"])
    d = d.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.regexp_replace("_t", BLANK, "")).cast("long"),
        "n_symbols": without("#*$%&|<>").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "n_repeat_words": covered.cast("long"),
        "n_lines": F.size("_l").cast("long"),
        "n_marks": without("!?").cast("long"),
        "n_pipes": without("|").cast("long"),
        "n_capitals": without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long"),
        "text_md5": F.md5(F.col("_t").cast("binary")),
    }).drop(*own)
    return d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _rate(name: str):
    over, of = MEASURES[name]
    return F.expr(f"(1000 * {over}) div greatest({of}, 1L)")


def _cdf(n, k, p: float):
    """P(Binomial(n, p) <= k), exact up to rounding, summed in log space; 1 where k exceeds the mean (never admitted)."""
    import math

    ratio = math.log(p / (1 - p))
    first = n * F.lit(math.log1p(-p))
    step = lambda a, i: F.struct((a["t"] + F.log((n - i + 1) / i) + F.lit(ratio)).alias("t"), (a["s"] + F.exp(a["t"] + F.log((n - i + 1) / i) + F.lit(ratio))).alias("s"))
    total = F.aggregate(F.sequence(F.lit(1).cast("long"), k), F.struct(first.alias("t"), F.exp(first).alias("s")), step, lambda a: a["s"])
    return F.when(k > n * F.lit(p), F.lit(1.0)).when(k == 0, F.exp(first)).otherwise(total)


def _wide(cutoffs: DataFrame, values: list[str]) -> DataFrame:
    """One row a stratum of (lang, measure, *values), with a column _<value>_<measure> of each."""
    return cutoffs.groupBy("lang").agg(*[F.max(F.when(F.col("measure") == m, F.col(v))).alias(f"_{v}_{m}") for v in values for m in MEASURES])


def _beside(docs: DataFrame, at: DataFrame, most_broadcast: int = 200_000) -> DataFrame:
    """docs with the row of its lang in at, a staged table of one row a stratum; null lang to null, docs without one kept."""
    if at.count() <= most_broadcast:  # a dozen numbers and a name each
        at = at.withColumnRenamed("lang", "_lang")
        return docs.join(F.broadcast(at), F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    return spread_join(docs, at, ["lang"], by=F.monotonically_increasing_id(), how="left")


def thresholds(counts: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(lang, measure, cutoff) admitted by the holdout; counts: doc_id, lang and measured() columns (without text_md5 each doc_id is a text of its own)."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    key = F.col("text_md5") if "text_md5" in counts.columns else F.md5(F.col("doc_id").cast("string"))
    held = counts.where("not base_failed").join(known, "doc_id").select("lang", "quality", key.alias("key"), *[_rate(m).alias(m) for m in MEASURES])
    # equal texts have equal rates: one row a text and stratum, with map-side combine
    held = held.groupBy("lang", "key").agg(F.min("quality").alias("quality"), *[F.max(m).alias(m) for m in MEASURES])
    held = staged(held.select("lang", "quality", (F.col("key") < "8").alias("learn"), *MEASURES), "holdout")
    # one row per stratum, measure and distinct rate: pre-aggregated before anything is crossed with the grid
    per = held.where("learn").select("lang", "quality", F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in MEASURES]), F.array(*MEASURES))).alias("measure", "rate"))
    per = per.groupBy("lang", "measure", F.least("rate", F.lit(1001)).alias("rate")).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    grid = per.select("*", F.explode(F.array(*[F.lit(g) for g in GRID])).alias("cutoff"))
    over = F.col("rate") > F.col("cutoff")
    found = grid.groupBy("lang", "measure", "cutoff").agg(F.sum("good").alias("n"), F.sum(F.when(over, F.col("good")).otherwise(0)).alias("k"), F.sum(F.when(over, F.col("bad")).otherwise(0)).alias("caught"))
    fair = found.where((F.col("k") <= F.col("n") * F.lit(alpha / len(MEASURES))) & (F.col("caught") > F.col("k")))
    best = fair.groupBy("lang", "measure").agg(F.max_by(F.struct("cutoff", "k", "caught"), F.struct(F.col("caught") - F.col("k"), "cutoff")).alias("b")).select("lang", "measure", "b.*")
    # a window over the measures of one stratum
    chain = best.select("lang", "measure", "cutoff", F.row_number().over(Window.partitionBy("lang").orderBy("k", F.desc("caught"), "measure")).alias("place"))
    places = range(1, len(MEASURES) + 1)
    first = F.least(*[F.when(F.col(m) > F.col(f"_cutoff_{m}"), F.col(f"_place_{m}")) for m in MEASURES])

    def counted(rows: DataFrame, chain: DataFrame, **arrays) -> DataFrame:
        """chain with what its stratum's rows, each with the place of the first cutoff that it exceeds, give at every place."""
        met = _beside(rows, staged(_wide(chain, ["cutoff", "place"]), "chains")).groupBy(F.col("lang").alias("_lang"))
        met = met.agg(F.count(F.lit(1)).alias("n"), *[F.array(*[F.count_if(f(j)) for j in places]).alias(c) for c, f in arrays.items()])
        return chain.join(met, F.col("lang").eqNullSafe(F.col("_lang"))).withColumns({c: F.element_at(c, F.col("place")) for c in arrays})

    chain = staged(chain, "chain")
    chain = counted(held.where("learn"), chain, bad=lambda j: (first == j) & (F.col("quality") == 0), good=lambda j: (first == j) & (F.col("quality") == 1))
    chain = staged(chain.where("bad > good").select("lang", "measure", "cutoff", "place"), "chain")
    tested = counted(held.where("not learn and quality = 1"), chain, k=lambda j: first <= j)
    strata = held.select("lang").distinct().count()
    p = _cdf(F.col("n"), F.col("k"), alpha)
    # the rejections grow along the sequence and so does p: what passes comes before what fails
    return tested.where(p <= F.lit(delta / max(strata, 1))).select("lang", "measure", "cutoff")


def judged(docs: DataFrame, cutoffs: DataFrame, most_broadcast: int = 200_000) -> DataFrame:
    """measured() docs with kept; cutoffs: thresholds(), one row a stratum here, joined by lang."""
    wide = _beside(docs, staged(_wide(cutoffs, ["cutoff"]), "cutoffs"), most_broadcast)
    fails = [F.coalesce(_rate(m) > F.col(f"_cutoff_{m}"), F.lit(False)) for m in MEASURES]
    return wide.withColumn("kept", ~F.col("base_failed") & ~reduce(lambda a, b: a | b, fails)).drop(*[f"_cutoff_{m}" for m in MEASURES])


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row of docs(doc_id, text, lang)."""
    counts = staged(measured(docs.select("doc_id", "lang", "text")).drop("text"), "quality")
    return judged(counts, thresholds(counts, labels))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns."""
    names = [f"_{i}" for i in range(len(docs.columns))]
    same = docs.toDF(*names)  # measured() columns may clash with extra columns of docs
    at = {c: names[i] for i, c in enumerate(docs.columns)}
    wide = same.withColumns({c: F.col(at[c]) for c in ("doc_id", "lang", "text")})
    # the rows are written with their measures, which both the thresholds and the verdicts read: every text is measured once
    rows = staged(measured(wide).drop("text"), "quality")
    return judged(rows, thresholds(rows, labels)).where("kept").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *COUNTS[:5], "base_failed", "kept")


ORACLE = f"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
r AS (SELECT doc_id, lang, t, len(w) AS n_words, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
  list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS tri FROM w),
g AS (SELECT doc_id, tri, i FROM (SELECT doc_id, unnest(tri) AS tri, generate_subscripts(tri, 1) AS i FROM r)),
d AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, tri) > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM d, (VALUES (0), (1), (2)) v(o) GROUP BY doc_id),
m AS (SELECT doc_id, lang, md5(t) AS key, n_words, n_lines, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
  length(t) - length(translate(t, '!?', '')) AS n_marks, length(t) - length(translate(t, '|', '')) AS n_pipes,
  length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_capitals FROM r LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  {", ".join(f"(1000 * {a}) // greatest({o}, 1) AS {m}" for m, (a, o) in MEASURES.items())} FROM m),
k AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT lang, key, min(quality) AS quality, {", ".join(f"max({m}) AS {m}" for m in MEASURES)} FROM b JOIN k USING (doc_id) WHERE NOT base_failed GROUP BY lang, key),
h AS (SELECT *, key < '8' AS learn, row_number() OVER () AS r FROM h0),
u AS ({" UNION ALL ".join(f"SELECT r, lang, quality, learn, '{m}' AS measure, {m} AS rate FROM h" for m in MEASURES)}),
f AS (SELECT lang, measure, cutoff, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 1 AND rate > cutoff) AS k, count(*) FILTER (quality = 0 AND rate > cutoff) AS caught
  FROM u, (SELECT unnest({GRID}) AS cutoff) WHERE learn GROUP BY ALL),
y AS (SELECT lang, measure, cutoff, k, caught FROM f WHERE k <= n * {ALPHA / len(MEASURES)} AND caught > k QUALIFY row_number() OVER (PARTITION BY lang, measure ORDER BY caught - k DESC, cutoff DESC) = 1),
c0 AS (SELECT lang, measure, cutoff, row_number() OVER (PARTITION BY lang ORDER BY k, caught DESC, measure) AS place FROM y),
g0 AS (SELECT u.r, u.lang, quality, min(c0.place) FILTER (u.rate > c0.cutoff) AS place FROM u JOIN c0 ON u.lang IS NOT DISTINCT FROM c0.lang AND u.measure = c0.measure WHERE learn GROUP BY ALL),
z AS (SELECT c0.lang, measure, cutoff, c0.place FROM c0 JOIN g0 ON g0.lang IS NOT DISTINCT FROM c0.lang AND g0.place = c0.place GROUP BY ALL HAVING count(*) FILTER (quality = 0) > count(*) FILTER (quality = 1)),
q AS (SELECT u.r, u.lang, min(z.place) FILTER (u.rate > z.cutoff) AS place FROM u JOIN z ON u.lang IS NOT DISTINCT FROM z.lang AND u.measure = z.measure WHERE NOT learn AND quality = 1 GROUP BY ALL),
n AS (SELECT z.lang, z.measure, z.cutoff, z.place, count(*) AS n, count(*) FILTER (q.place <= z.place) AS k FROM z JOIN q ON q.lang IS NOT DISTINCT FROM z.lang GROUP BY ALL),
p AS (SELECT *, (SELECT count(*) FROM (SELECT DISTINCT lang FROM h)) AS strata,
  CASE WHEN k > n * {ALPHA} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})))) END AS p FROM n),
x AS (SELECT lang, measure, cutoff FROM p WHERE p <= {DELTA} / strata)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM x WHERE x.lang IS NOT DISTINCT FROM b.lang AND x.cutoff < CASE measure {" ".join(f"WHEN '{m}' THEN {m}" for m in MEASURES)} END) AS kept
FROM b
"""
