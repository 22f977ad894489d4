"""Masking of personal data at match positions.

A text is cut, in one pass, into segments that joined give the text again: kept pieces, and items with a label. Candidates are
found by pattern (e-mails, then numbers that touch no other digit); each is tested by what it is (check digits, what SSA and
the ABA issue) and by the kept text before it (the last cue within REACH characters), and is an item only if a test holds. Masked text,
counts and positions are read from the segments. All of it is SQL functions, linear in the text; texts without an @ and without three digits in a row are not
scanned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import CUE, CUES, EMAIL, LABELS, REACH, SSN, numbers
from .skew import aside

COUNTS = [f"n_{label.lower()}" for label in LABELS]
_FOUND = f"(?<![0-9])(?:{numbers()})(?![0-9])"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def routing(digits: Column) -> Column:
    """Whether nine digits can be an ABA routing number: a Federal Reserve prefix and the weighted sum 3-7-1."""
    total = reduce(lambda a, b: a + b, [F.substring(digits, k + 1, 1).cast("int") * (3, 7, 1)[k % 3] for k in range(9)])
    prefix = F.substring(digits, 1, 2).cast("int")
    return (total % 10 == 0) & (prefix.between(0, 12) | prefix.between(21, 32) | prefix.between(61, 72) | (prefix == 80))


def _looked(item: Column, before: Column) -> Column:
    """What a candidate number is judged by: itself, its digits, and the last cue of the kept text before it."""
    cues = F.regexp_extract_all(F.translate(F.right(before, F.lit(REACH)), _UPPER, _LOWER), F.lit(CUE), F.lit(2))
    return F.struct(item.alias("item"), F.translate(item, " .()+-", "").alias("digits"), F.try_element_at(cues, F.lit(-1)).alias("cue"))


def _label(seen: Column) -> Column:
    """The label of a candidate number, null if it is none."""
    item, digits, n = seen["item"], seen["digits"], F.length(seen["digits"])
    near = {label: seen["cue"].isin(words) for label, words in CUES.items()}
    bare = F.when(n >= 12, "NUMBER")
    bare = bare.when((n == 9) & near["SSN"] & F.regexp_replace(digits, "^(...)(..)", "$1-$2-").rlike(f"^(?:{SSN})$"), "SSN")
    bare = bare.when((n == 9) & near["ROUTING"] & routing(digits), "ROUTING").when(near["ACCOUNT"], "ACCOUNT")
    return F.when(F.length(item) == n, bare).when(n == 9, "SSN").when(n <= 11, "PHONE").when(luhn(digits), "CARD")


def _cut(text: Column, pattern: str, looked, label) -> Column:
    """Segments of text: what lies between matches of pattern, and the matches; label(looked(match, text before it)) is theirs.

    Each match is bound once, by zip_with and then by transform: a lambda evaluates what it closes over at every element."""
    none = F.lit(None).cast("string")
    seen = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x, item: F.struct(x.alias("kept"), looked(item, x).alias("seen")))
    pairs = F.transform(seen, lambda s: F.array(F.struct(none.alias("label"), s["kept"].alias("value")), F.struct(label(s["seen"]).alias("label"), s["seen"]["item"].alias("value"))))
    return F.filter(F.flatten(pairs), lambda s: s["value"].isNotNull())


def segments(text: Column) -> Column:
    """array<struct<label, value>> of a text that isn't null: the values joined are the text, a null label marks what is kept."""
    kept = lambda x: F.array(F.struct(F.lit(None).cast("string").alias("label"), x.alias("value")))
    by_number = lambda x: F.when(x.rlike("[0-9]{3}"), _cut(x, _FOUND, _looked, _label)).otherwise(kept(x))
    mails = F.flatten(F.transform(_cut(text, EMAIL, lambda item, _: F.struct(item.alias("item")), lambda _: F.lit("EMAIL")), lambda s: F.when(s["label"].isNull(), by_number(s["value"])).otherwise(F.array(s))))
    return F.when(F.contains(text, F.lit("@")), mails).otherwise(by_number(text))


def mask(docs: DataFrame, mode: str = "full") -> DataFrame:
    """docs with `masked` and a count column n_<label> per label; full puts [LABEL], partial keeps the last four digits or the domain.

    Null text is the empty text; repeated rows are masked alike; columns of docs named like the new ones are returned as
    given_<name>, all others as they are; an empty table gives no rows.
    """
    cut = "_segments"
    while cut in docs.columns:
        cut = f"_{cut}"
    out = aside(docs, ["masked", *COUNTS]).withColumn(cut, segments(F.coalesce("text", F.lit(""))))

    def shown(s):
        last = F.when(s["label"] == "EMAIL", F.regexp_extract(s["value"], "@.*", 0)).otherwise(F.right(s["value"], F.lit(4)))
        item = F.concat(F.lit("["), s["label"], F.lit("]")) if mode == "full" else F.concat(F.lit("****"), last)
        return F.when(s["label"].isNull(), s["value"]).otherwise(item)

    # labels are gathered once, so that texts without an item cost nothing more
    found = F.filter(F.transform(cut, lambda s: s["label"]), lambda x: x.isNotNull())
    count = lambda label: F.size(F.filter(found, lambda x: x == label)).cast("long")
    return out.withColumns({"masked": F.array_join(F.transform(cut, shown), ""), **{c: count(label) for c, label in zip(COUNTS, LABELS)}}).drop(cut)


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, seq, label, start, length, value of every item of docs(doc_id, text): its place among the text's items and its first character, from 0, and its characters.

    Null and empty texts have none; repeated rows each give their items; a null doc_id is kept; extra columns are ignored; an
    empty table gives no rows. Only the segments of texts that hold an item are shuffled, by row.
    """
    cut = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), segments(F.coalesce("text", F.lit(""))).alias("x")).where(F.exists("x", lambda s: s["label"].isNotNull()))
    pieces = cut.select("doc_id", "row", F.posexplode("x").alias("k", "s")).select("doc_id", "row", "k", "s.label", F.length("s.value").cast("long").alias("length"), F.when(F.col("s.label").isNotNull(), F.col("s.value")).alias("value"))
    of = Window.partitionBy("row").orderBy("k")
    placed = pieces.withColumns({"start": F.sum("length").over(of) - F.col("length"), "seq": F.count("label").over(of) - 1})
    return placed.where(F.col("label").isNotNull()).select("doc_id", "seq", "label", "start", "length", "value")
