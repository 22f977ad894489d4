"""Replacing the terms of a rule table in texts, by Aho-Corasick automata.

An automaton finds all terms in one pass over a text, however many there are; of what it finds, the leftmost match stands, of
those that begin there the longest, and the next one begins after its end. The rules' size is measured first: up to MOST_BYTES they
are one automaton, broadcast, and texts are rewritten in one pass without a shuffle. A larger table is dealt into shards under that
size by a hash of the term: each shard's automaton passes over the texts and leaves its matches, and the matches of all shards
meet at their text, by row, where they are resolved as above. So nothing that grows with the rules is broadcast whole.

Defined results: null text is the empty text; null and empty terms are no rules; of rules with one term the least replacement holds, a null one
deletes; repeated rows are rewritten each; columns of docs named like the new ones are returned as given_<name>, all others as they
are; an empty table of docs or rules gives no rows or no change.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import aside
from .stage import staged

#: Bytes of terms and replacements in one automaton.
MOST_BYTES = 32 << 20
_WORD = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz")
_HITS = "array<struct<term:string,n:bigint>>"


def prepared(rules: DataFrame) -> DataFrame:
    """term, replacement of rules(term, replacement): one row a term."""
    given = rules.where("term is not null and term <> ''")
    return given.groupBy("term").agg(F.min(F.coalesce("replacement", F.lit(""))).alias("replacement"))


def automaton(terms: list[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for term in terms:
        out.add_word(term, term)
    out.make_automaton()
    return out


def matches(found, text: str, whole: bool) -> list[tuple[int, str]]:
    """(start, term) of every occurrence; whole: only those that touch no ASCII letter, digit or _."""
    out = []
    for end, term in found.iter(text):
        start = end + 1 - len(term)
        if whole and (start and text[start - 1] in _WORD or end + 1 < len(text) and text[end + 1] in _WORD):
            continue
        out.append((start, term))
    return out


def resolved(found: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Leftmost, then longest, without overlaps."""
    out, at = [], 0
    for start, term in sorted(found, key=lambda x: (x[0], -len(x[1]))):
        if start >= at:
            out.append((start, term))
            at = start + len(term)
    return out


def rewritten(text: str, found: list[tuple[int, str]], to: dict[str, str]) -> tuple[str, list[dict]]:
    """The text with its resolved matches replaced, and how often each term was."""
    pieces, at, hits = [], 0, {}
    for start, term in found:
        pieces += [text[at:start], to[term]]
        at = start + len(term)
        hits[term] = hits.get(term, 0) + 1
    return "".join(pieces) + text[at:], [{"term": t, "n": n} for t, n in sorted(hits.items())]


def _added(batch: pa.RecordBatch, drop: list[str], texts: list[str], hits: list[list[dict]]) -> pa.RecordBatch:
    kept = [c for c in batch.schema.names if c not in drop]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(texts, pa.string()), pa.array(hits, pa.list_(pa.struct([("term", pa.string()), ("n", pa.int64())])))], [*kept, "replaced", "hits"])


def _in_one_pass(rules, whole: bool):
    def run(batches):
        to = rules.value
        found = automaton(list(to)) if to else None
        for b in batches:
            out = [(t or "", matches(found, t, whole) if found and t else []) for t in b.column("text").to_pylist()]
            out = [rewritten(t, resolved(x), to) for t, x in out]
            yield _added(b, [], [t for t, _ in out], [h for _, h in out])

    return run


def _shard(rules, whole: bool):
    """_row, start, term, replacement of the matches of one shard's terms."""

    def run(batches):
        to = rules.value
        found = automaton(list(to))
        for b in batches:
            rows, starts, terms = [], [], []
            for row, text in zip(b.column("_row").to_pylist(), b.column("text").to_pylist()):
                for start, term in matches(found, text or "", whole):
                    rows.append(row)
                    starts.append(start)
                    terms.append(term)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(starts, pa.int64()), pa.array(terms, pa.string()), pa.array([to[t] for t in terms], pa.string())], ["_row", "start", "term", "replacement"])

    return run


def _met(batches):
    for b in batches:
        out = []
        for text, found in zip(b.column("text").to_pylist(), b.column("_found").to_pylist()):
            found = found or []
            out.append(rewritten(text or "", resolved([(x["start"], x["term"]) for x in found]), {x["term"]: x["replacement"] for x in found}))
        yield _added(b, ["_row", "_found"], [t for t, _ in out], [h for _, h in out])


def replace(docs: DataFrame, rules: DataFrame, whole: bool = False, most_bytes: int = MOST_BYTES) -> DataFrame:
    """docs with `replaced`, the text with the terms of rules(term, replacement) replaced, and hits, how often each."""
    spark, docs = docs.sparkSession, aside(docs, ["replaced", "hits", "_row", "_found"])
    rules = staged(prepared(rules), "rules")
    size = rules.agg(F.sum(F.octet_length("term") + F.octet_length("replacement"))).first()[0] or 0
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", replaced string, hits {_HITS}"
    told = lambda part: spark.sparkContext.broadcast({r.term: r.replacement for r in part.collect()})
    if size <= most_bytes:
        return docs.mapInArrow(_in_one_pass(told(rules), whole), schema)
    shards = -(-2 * size // most_bytes)  # half full on average, so that none is over the bound by chance
    rows = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "docs")
    found = None
    for k in range(shards):
        part = rules.where(F.pmod(F.xxhash64("term"), F.lit(shards)) == k)
        part = staged(rows.select("_row", "text").mapInArrow(_shard(told(part), whole), "_row long, start long, term string, replacement string"), "matches")
        found = part if found is None else found.unionByName(part)
    found = found.groupBy(F.col("_row").alias("_at")).agg(F.collect_list(F.struct("start", "term", "replacement")).alias("_found"))
    return rows.join(found, F.col("_row") == F.col("_at"), "left").drop("_at").mapInArrow(_met, schema)


def counts(replaced: DataFrame, rules: DataFrame) -> DataFrame:
    """term, replacement, n_docs, n of every rule: in how many texts of replace() it was applied, and how often."""
    hits = replaced.select(F.explode("hits").alias("h")).groupBy(F.col("h.term").alias("_term")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("h.n").alias("n"))
    return prepared(rules).join(hits, F.col("term") == F.col("_term"), "left").select("term", "replacement", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n", F.lit(0)).alias("n"))
