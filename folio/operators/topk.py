"""Bounded selections per group, and texts classified by lists of terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .entities import entities
from .stage import staged


def top(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """rows with rank (from 1): the first k of each group of keys by order, which is to be total.

    A filter on row_number makes Spark limit every group to k rows in each task before the shuffle, so no group is gathered or
    sorted whole; null keys are a group; an empty table gives no rows.
    """
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def capped_index(docs: DataFrame, per_kind: int, budget: int) -> DataFrame:
    """doc_id, kind, value, seq, place of the entities of docs(doc_id, text): each value of a kind once, at its first place; of a text's values
    per_kind of each kind at most, the first ones; of those budget at most, in the order of their seq, then kind.

    The text's row is the key, so a doc_id of many rows is many keys, and every task limits a key before it is shuffled. Null and
    empty texts have none; repeated rows each give their index; extra columns are ignored; an empty table gives no rows.
    """
    found = entities(docs.select(F.struct(F.monotonically_increasing_id().alias("row"), "doc_id").alias("doc_id"), "text"))
    first = found.groupBy("doc_id", "kind", "value").agg(F.min("seq").alias("seq"))
    few = top(first, ["doc_id", "kind"], [F.col("seq")], per_kind).drop("rank")
    return top(few, ["doc_id"], [F.col("seq"), F.col("kind")], budget).select("doc_id.doc_id", "kind", "value", "seq", F.col("rank").alias("place"))


def words(text: Column, pattern: str) -> Column:
    """The distinct lower-cased words of a text; A-Z only are lower-cased."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.regexp_extract_all(low, F.lit(pattern), F.lit(0)))


def common_words(docs: DataFrame, key: str, k: int, pattern: str) -> DataFrame:
    """key, word, n_docs, rank: the k words that most rows of a key's docs(key, text) hold, ties to the smaller word.

    Counted with map-side combine, so a key of a third of all rows is one row a word and task."""
    each = docs.select(key, F.explode(words(F.col("text"), pattern)).alias("word"))
    counts = each.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n_docs"))
    return top(counts, [key], [F.desc("n_docs"), F.col("word")], k)


def classified(docs: DataFrame, lists: DataFrame, pattern: str, least: int, share: float, most_terms: int = 100_000) -> DataFrame:
    """doc_id, label, score, n_parts, n_votes, vote, settled of every row of docs(doc_id, text), by lists(label, word) of terms.

    score: how many different words of a label's list the text holds; label: that of the highest score, ties to the smaller label, null under `least`. Every
    line with a word votes likewise (one word is enough); vote is the label of most votes, ties to the smaller one; n_parts the lines that
    vote, n_votes those for vote; settled: vote is the label and has `share` of the parts at least. Null words and labels of lists are ignored; null and empty
    texts have no label; repeated rows are judged each; extra columns are ignored; an empty table gives no rows. The lists are
    broadcast; more than most_terms words raise an error.
    """
    lists = staged(lists.where("label is not null and word is not null").select("label", "word").distinct(), "lists")
    size = lists.count()
    if size > most_terms:
        raise ValueError(f"{size} terms, over {most_terms}")
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    # words of each line, met with the lists before any shuffle
    lines = rows.select("row", F.posexplode(F.split("text", "\n", -1)).alias("line", "part"))
    met = staged(lines.select("row", "line", F.explode(words(F.col("part"), pattern)).alias("word")).join(F.broadcast(lists), "word"), "met")
    rank = lambda c: [F.desc(c), F.col("label")]
    best = lambda df, keys, c: top(df, keys, rank(c), 1).drop("rank")
    score = best(met.groupBy("row", "label").agg(F.count_distinct("word").alias("score")), ["row"], "score")
    votes = best(met.groupBy("row", "line", "label").agg(F.count(F.lit(1)).alias("n")), ["row", "line"], "n").groupBy("row", "label").agg(F.count(F.lit(1)).alias("n_votes"))
    votes = votes.withColumn("n_parts", F.sum("n_votes").over(Window.partitionBy("row")))
    votes = best(votes, ["row"], "n_votes").select(F.col("row").alias("_row"), F.col("label").alias("vote"), "n_votes", "n_parts")
    each = score.join(votes, F.col("row") == F.col("_row")).drop("_row").withColumnRenamed("row", "_row")
    label = F.when(F.col("score") >= least, F.col("label"))
    out = rows.select("doc_id", "row").join(each, F.col("row") == F.col("_row"), "left").withColumn("label", label)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("doc_id", "label", zero("score"), zero("n_parts"), zero("n_votes"), "vote", F.coalesce((F.col("vote") == F.col("label")) & (F.col("n_votes") >= F.col("n_parts") * F.lit(share)), F.lit(False)).alias("settled"))


def dominant_series(docs: DataFrame, key: str, pattern: str, share: float, digits: int = 9) -> DataFrame:
    """key, n_labels, series, n, n_numbers, first, last, missing, density, dominant of every key of docs(key, text): its commonest series of labelled numbers.

    A label is what pattern finds: letters and signs (the series, A-Z lower-cased) and then a number; those of over `digits` digits (18 at most) are none.
    The commonest series has most labels; ties go to that of more different numbers, then to the smaller one by code points. It is
    dominant if it has `share` of the key's n_labels at least. first and last are its smallest and largest number, missing those between them that don't
    occur, density the share of those that do. A key without labels has n_labels 0, a null series and is not dominant; null keys are a key; null
    and empty texts have no label; repeated rows count each; extra columns are ignored; an empty table gives no rows.
    Labels are counted by number with map-side combine, then by series, so neither a key nor a series is ever gathered.
    """
    label = F.explode_outer(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(0)))
    each = docs.select(F.struct(F.col(key)).alias("_key"), label.alias("x")).select("_key", F.regexp_replace("x", "[0-9]+$", "").alias("series"), F.regexp_extract("x", "[0-9]*$", 0).alias("number"))
    each = each.withColumn("known", F.coalesce(F.length("number").between(1, digits), F.lit(False)))
    known = lambda c: F.when(F.col("known"), F.col(c))
    small = F.translate("series", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # what isn't a label keeps its key, as a row without series
    numbers = each.select("_key", F.when(F.col("known"), small).alias("series"), known("number").cast("long").alias("number")).groupBy("_key", "series", "number").agg(F.count(F.lit(1)).alias("n"))
    series = numbers.groupBy("_key", "series").agg(
        F.sum(F.when(F.col("series").isNull(), 0).otherwise(F.col("n"))).alias("n"), F.count("number").alias("n_numbers"), F.min("number").alias("first"), F.max("number").alias("last"))
    series = staged(series, "series")
    total = series.groupBy("_key").agg(F.sum("n").alias("n_labels")).withColumnRenamed("_key", "_of")
    best = top(series, ["_key"], [F.desc("n"), F.desc("n_numbers"), F.asc_nulls_last("series")], 1).drop("rank")
    span = F.col("last") - F.col("first") + 1
    out = best.join(total, F.col("_key") == F.col("_of"))
    return out.select(
        F.col(f"_key.{key}").alias(key), "n_labels", "series", "n", "n_numbers", "first", "last", (span - F.col("n_numbers")).alias("missing"), (F.col("n_numbers") / span).alias("density"),
        ((F.col("n") > 0) & (F.col("n") >= F.col("n_labels") * F.lit(share))).alias("dominant"))
