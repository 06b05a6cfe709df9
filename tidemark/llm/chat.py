"""Chat formatting (op 1): cumulative-snapshot collapse, then rendering. DataFrame functions only.

A logger that saves a conversation after every turn leaves snapshots that are prefixes of later
ones. Rolling hashes of turn prefixes identify them: the hash of a prefix is a pair of exclusive ors of turn
hashes, each of which holds the turn's place, so that it can be built by parts. A conversation whose full hash is a
proper prefix's hash of another is anti-joined away; of equal conversations the smallest
conv_id stays. What remains is rendered.

Texts are shuffled once, when the turns of a part are gathered, rendered and hashed; from then on only hashes
travel. A part holds PART_TURNS turn numbers of a conversation, so that a conversation that holds a third of all rows is
many groups, whose counts and hashes are then carried on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, pick, table

#: Turn numbers of one rendered part.
PART_TURNS = 256
#: Retained conversations whose ids may be broadcast; more are joined by shuffle.
BROADCAST_IDS = 200_000
_KEY = ["k", "h1", "h2"]


def _marker(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def _gathered(turns: DataFrame) -> DataFrame:
    """One row a part: conv, part, n, text as rendered, and the hashes of its turns in order. Repeated rows are one turn, found where they are read."""
    parts = turns.groupBy("conv", "part").agg(F.sort_array(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    rendered = F.transform("turns", lambda x: F.concat(_marker(x["role"]), x["text"], F.lit("<|end|>\n")))
    own = lambda salt, x: F.xxhash64(F.lit(salt), x["role"], F.lit("\u0000"), x["text"])
    hashes = F.transform("turns", lambda x: F.struct(own(1, x).alias("a"), own(2, x).alias("b")))
    return cut(parts.select("conv", "part", F.size("turns").cast("long").alias("n"), F.array_join(rendered, "").alias("text"), hashes.alias("hashes")), "parts")


def _prefixes(parts: DataFrame) -> DataFrame:
    """conv, k, h1, h2 of every prefix, and whether it is the whole conversation."""
    on = lambda a, b: F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv")) & F.col(f"{a}.part").eqNullSafe(F.col(f"{b}.part"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.select("conv", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("conv")).alias("total"))
    placed = parts.select("conv", "part", "hashes").alias("x").join(counts.alias("y"), on("x", "y")).select("x.conv", "x.part", "hashes", "before", "total")
    turn = lambda salt: lambda x, i: F.xxhash64(F.lit(salt), F.col("before") + i, x["a"], x["b"])
    placed = cut(placed.select("conv", "part", "before", "total", F.transform("hashes", turn(1)).alias("e1"), F.transform("hashes", turn(2)).alias("e2")), "placed")
    zero = F.lit(0).cast("long")
    sums = placed.select("conv", "part", *[F.aggregate(f"e{i}", zero, lambda a, x: a.bitwiseXOR(x)).alias(f"s{i}") for i in (1, 2)])
    carried = sums.select("conv", "part", *[F.coalesce(F.bit_xor(f"s{i}").over(earlier), zero).alias(f"c{i}") for i in (1, 2)])
    joined = placed.alias("x").join(carried.alias("y"), on("x", "y"))
    # the hashes of all prefixes that end in the part, each from the one before it
    rolled = lambda i: F.aggregate(f"e{i}", F.array(f"c{i}"), lambda a, x: F.concat(a, F.array(F.element_at(a, -1).bitwiseXOR(x))))
    ends = joined.select("x.conv", "before", "total", F.posexplode(F.arrays_zip(F.slice(rolled(1), 2, F.size("e1")).alias("h1"), F.slice(rolled(2), 2, F.size("e2")).alias("h2"))).alias("i", "h"))
    k = F.col("before") + F.col("i") + 1
    return ends.select("conv", k.alias("k"), "h.h1", "h.h2", (k == F.col("total")).alias("whole"))


def collapse_and_render(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, part, n_turns, text: the retained conversations, rendered.

    Turns are ordered by turn (null first), role and text; a repeated row is one turn. A null role is
    "unknown", a null text empty; "<|" inside either is written "< |", so that no text forges a marker. Rows with a null
    conv_id are one conversation, which loses against an equal one. A part holds ``part_turns`` turn numbers (part =
    turn div part_turns, null for null); most conversations have one. A very long text is one value of its part. Other
    columns are ignored, whatever their names; an empty table gives no rows. Different turns of one conversation that
    share one turn number share a task.
    """
    d = pick(conversations, "conv_id", "turn", "role", "text").toDF("conv", "turn", "role", "text")
    clean = lambda c, other: F.replace(F.coalesce(c, F.lit(other)), F.lit("<|"), F.lit("< |"))
    d = d.select("conv", "turn", F.floor(F.col("turn") / part_turns).cast("long").alias("part"), clean(F.col("role"), "unknown").alias("role"), clean(F.col("text"), "").alias("text"))
    parts = _gathered(d)
    prefixes = cut(_prefixes(parts), "prefixes")
    # of equal conversations the smallest id
    whole = prefixes.where("whole").groupBy(*_KEY).agg(F.min(F.struct(F.col("conv").isNull().alias("none"), "conv")).alias("m"))
    proper = prefixes.where("NOT whole").select(*_KEY).distinct()
    kept = cut(whole.join(proper, _KEY, "left_anti").select(F.col("m.conv").alias("kept")), "kept")
    if kept.count() <= BROADCAST_IDS:
        kept = F.broadcast(kept)
    return parts.join(kept, F.col("conv").eqNullSafe(F.col("kept")), "left_semi").select(F.col("conv").alias("conv_id"), "part", F.col("n").alias("n_turns"), "text")


def op1_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_and_render(table(spark, sf_dir, "conversations"))


OP1_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS body
  FROM conversations),
r AS (
  SELECT conv_id, turn, role, body, CAST(floor(turn / 256.0) AS BIGINT) AS part, '<|' || role || '|>' || chr(10) || body || '<|end|>' || chr(10) AS s
  FROM t),
p AS (
  SELECT conv_id, string_agg(s, '') OVER w AS prefix, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body ROWS UNBOUNDED PRECEDING)),
gone AS (
  SELECT DISTINCT a.conv_id FROM p AS a JOIN p AS b ON a.k = a.n AND a.k = b.k AND a.prefix = b.prefix
  WHERE b.n > b.k OR (a.conv_id IS NULL AND b.conv_id IS NOT NULL) OR b.conv_id < a.conv_id)
SELECT conv_id, part, count(*) AS n_turns, string_agg(s, '' ORDER BY turn NULLS FIRST, role, body) AS text
FROM r WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.conv_id IS NOT DISTINCT FROM r.conv_id) GROUP BY conv_id, part
"""
