"""Chat formatting by perspective rotation, in DataFrame functions only.

For every participant of a conversation (every role but system) the whole dialogue is rendered with that participant as the
assistant, the others as users under their names, and a mask over what the assistant says. A rendering is one row per turn,
with its text, its place in the rendered dialogue in characters and whether it is trained on; no dialogue is gathered into one
value or one task, since a conversation may be of any length. Places are three-level running sums: over the rows of a turn
that begin with the same digits of a checksum, such groups of a block of 64 turns, and the blocks of a conversation. There are
as many digits as make a turn's groups, and the rows of a group, about the square root of the table at most. Equal rows are one
row with a number until their places are known, and then spread by runs of at most 1024; rows of a turn that holds many are
dealt into parts where they meet their group's place.

Defined results: null text is the empty text; a null role is rendered as a user without name and is no participant; a null
conversation id is a conversation of its own; null turns come first; rows of equal turn are ordered by a checksum of role and
text; repeated rows are kept; the text's own "<|" is written "<||" and a name in a head has % < > | and line breaks percent-encoded, so that neither a text nor
a role can forge a marker (the column name has the role as it is); a conversation without
participants gives no rows; extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.skew import heavy_keys, spread_join
from .common import table

BLOCK, RUN = 64, 1024
#: How a name's characters that make markers and lines are written in a head, the escape itself first (percent-encoding, RFC 3986).
ESCAPES = {c: f"%{ord(c):02X}" for c in "%<>|\r\n"}


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, position, speaker, name, segment, trained, start, mask_start, mask_end."""
    total = max(turns.count(), 1)
    digits = -(-(total - 1).bit_length() // 8)
    count = F.count(F.lit(1)).alias("n")
    turns = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    t = turns.withColumn("body", F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("<||"))).groupBy("conv_id", "turn", "role", "body").agg(F.count(F.lit(1)).alias("copies"))
    t = t.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(RUN).cast("long")))).withColumn("k", F.least(F.lit(RUN), F.col("copies") - F.col("first"))).drop("copies")
    t = t.withColumn("sum", F.md5(F.concat(F.coalesce("role", F.lit("")), F.lit(":"), "body").cast("binary")))
    t = t.withColumn("block", F.floor(F.col("turn") / BLOCK)).withColumn("digit", F.substring("sum", 1, max(digits, 1)))
    who = turns.where("role is not null and role <> 'system'").select("conv_id", F.col("role").alias("perspective")).distinct()
    r = spread_join(t, who, ["conv_id"], heavy_keys(turns.groupBy("conv_id").agg(count), ["conv_id"], total))
    own = F.col("role").eqNullSafe(F.col("perspective"))
    r = r.withColumn("speaker", F.when(own, "assistant").when(F.col("role") == "system", "system").otherwise("user"))
    r = r.withColumn("name", F.when(F.col("speaker") == "user", F.col("role")))
    shown = F.col("name")
    for c, code in ESCAPES.items():
        shown = F.replace(shown, F.lit(c), F.lit(code))
    head = F.concat(F.lit("<|"), F.col("speaker"), F.coalesce(F.concat(F.lit(" name="), shown), F.lit("")), F.lit("|>\n"))
    r = r.withColumn("head", F.length(head)).withColumn("segment", F.concat(head, "body", F.lit("<|end|>\n"))).withColumn("each", F.length("segment").cast("long")).withColumn("n", F.col("k") * F.col("each")).drop("body", "role")
    rows = ["conv_id", "perspective", "block", "turn", "digit"]
    low = r.groupBy(*rows).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    mid = low.groupBy(*rows[:3]).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))

    def before(frame, keys, order, names):
        w = Window.partitionBy(*keys).orderBy(*[F.col(o).asc_nulls_first() for o in order]).rowsBetween(Window.unboundedPreceding, -1)
        return frame.withColumns({names[0]: F.coalesce(F.sum("n").over(w), F.lit(0)), names[1]: F.coalesce(F.sum("k").over(w), F.lit(0))})

    mid = before(mid, rows[:2], ["block"], ("n2", "k2")).drop("n", "k")
    low = before(low, rows[:3], ["turn", "digit"], ("n1", "k1")).drop("n", "k")
    eq = lambda a, b, keys: [F.col(f"{a}.{x}").eqNullSafe(F.col(f"{b}.{x}")) for x in keys]
    low = low.alias("a").join(mid.alias("b"), eq("a", "b", rows[:3])).select(*[F.col(f"a.{x}") for x in rows], (F.col("n1") + F.col("n2")).alias("n1"), (F.col("k1") + F.col("k2")).alias("k1"))
    r = before(r, rows, ["sum", "segment", "first"], ("n0", "k0"))
    heavy = heavy_keys(turns.groupBy("conv_id", "turn").agg(count), ["conv_id", "turn"], total)
    r = spread_join(r, low, rows, heavy, F.xxhash64("sum", "first")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    r = r.withColumn("start", F.col("n0") + F.col("n1") + F.col("i") * F.col("each")).withColumn("position", F.col("k0") + F.col("k1") + F.col("i"))
    trained = F.col("speaker") == "assistant"
    return r.select("conv_id", "perspective", "turn", "position", "speaker", "name", "segment", trained.alias("trained"), "start",
                    F.when(trained, F.col("start") + F.col("head")).alias("mask_start"), F.when(trained, F.col("start") + F.col("each") - 1).alias("mask_end"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


_SHOWN = "name"
for _c in ESCAPES:
    _SHOWN = f"replace({_SHOWN}, chr({ord(_c)}), '{ESCAPES[_c]}')"
ORACLE = f"""
WITH t AS (SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|', '<||') AS body FROM conversations),
s AS (SELECT *, md5(coalesce(role, '') || ':' || body) AS sum FROM t),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role IS NOT NULL AND role <> 'system'),
r AS (SELECT s.conv_id, perspective, turn, sum, body, CASE WHEN role IS NOT DISTINCT FROM perspective THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user' END AS speaker, role
  FROM s JOIN p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, CASE WHEN speaker = 'user' THEN role END AS name FROM r),
g AS (SELECT *, '<|' || speaker || coalesce(' name=' || {_SHOWN}, '') || '|>' || chr(10) AS head FROM h),
x AS (SELECT *, head || body || '<|end|>' || chr(10) AS segment FROM g),
w AS (SELECT *, length(segment) AS n, row_number() OVER o - 1 AS position, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, sum, segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM x WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, sum, segment))
SELECT conv_id, perspective, turn, position, speaker, name, segment, speaker = 'assistant' AS trained, start,
  CASE WHEN speaker = 'assistant' THEN start + length(head) END AS mask_start, CASE WHEN speaker = 'assistant' THEN start + n - 1 END AS mask_end FROM w
"""
