"""Sharding (op 5): minimum-cost-flow resharding.

A layout's documents form blocks: the documents of one old shard whose hash falls into one of
BLOCKS buckets, or of fewer where there are many old shards: all blocks together are MAX_BLOCKS at most, whatever the input. Block sizes are
summed by the cluster. On it the driver solves a transportation problem as a minimum-cost flow, where
a byte that stays costs nothing and a byte that moves costs one, from the old sizes to the new
capacities. Blocks are then chosen to carry the flow. The plan names the shards that lose or gain any, and only these are
rewritten: the others keep their files.

A shard is written in parts of about FILE_BYTES of text. Small blocks share a part; a block of more bytes is cut into
parts by a second hash, whose counts are summed by the cluster too, so that a part is one task's work at any size.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, new_folder, pick, table

SHARDS = 24
OLD_SHARDS = 16
#: Blocks of an old shard, and the bound on all blocks, whose table is solved on the driver and broadcast.
BLOCKS, MAX_BLOCKS = 1024, 1 << 16
#: The flow's edges at most: old shards times new ones.
MAX_EDGES = 1 << 16
#: Bytes of text of a part of a shard, about: one task's work.
FILE_BYTES = 64 << 20


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Flow (i, j) -> units that ships all of ``supply`` into ``capacity`` at the least total cost(i, j).

    Successive shortest paths with node potentials; costs are not negative.
    """
    m, n = len(supply), len(capacity)
    if m * n > MAX_EDGES:
        raise ValueError(f"{m} old shards and {n} new ones are {m * n} edges; {MAX_EDGES} are solved on the driver")
    if sum(supply) > sum(capacity):
        raise ValueError("the supply exceeds the capacity")
    s, t = m + n, m + n + 1
    graph: list[list[list]] = [[] for _ in range(m + n + 2)]  # edges [to, left, cost, index of the reverse]

    def edge(a: int, b: int, cap: int, c: int) -> None:
        graph[a].append([b, cap, c, len(graph[b])])
        graph[b].append([a, 0, -c, len(graph[a]) - 1])

    for i, x in enumerate(supply):
        edge(s, i, x, 0)
    for i in range(m):
        for j in range(n):
            edge(i, m + j, supply[i], cost(i, j))
    for j, x in enumerate(capacity):
        edge(m + j, t, x, 0)
    high, left = [0] * len(graph), sum(supply)
    while left:
        dist, back = [None] * len(graph), [None] * len(graph)
        dist[s], todo = 0, [(0, s)]
        while todo:
            d, a = heapq.heappop(todo)
            if d > dist[a]:
                continue
            for k, (b, cap, c, _) in enumerate(graph[a]):
                e = d + c + high[a] - high[b]
                if cap and (dist[b] is None or e < dist[b]):
                    dist[b], back[b] = e, (a, k)
                    heapq.heappush(todo, (e, b))
        for v, d in enumerate(dist):
            if d is not None:
                high[v] += d
        step, v = left, t
        while v != s:
            a, k = back[v]
            step, v = min(step, graph[a][k][1]), a
        v = t
        while v != s:
            a, k = back[v]
            graph[a][k][1] -= step
            graph[v][graph[a][k][3]][1] += step
            v = a
        left -= step
    return {(i, b - m): supply[i] - cap for i in range(m) for b, cap, _, _ in graph[i] if m <= b < m + n and supply[i] > cap}


@dataclass
class Plan:
    """New shard of each block (old shard, bucket); bytes that move; shards that change."""

    shard: dict[tuple[int, int], int]
    moved: int
    changed: set[int]


def plan(blocks: list[tuple[int, int, int]], n_new: int) -> Plan:
    """Assign blocks (old shard, bucket, bytes) to ``n_new`` shards of near equal bytes.

    The flow is by bytes; blocks carry it, the largest first, each into the flow that has most left. At last single blocks
    of the fullest shard move to the emptiest while that evens the two.
    """
    olds = sorted({o for o, _, _ in blocks})
    total = sum(b for _, _, b in blocks)
    capacity = [total // n_new + (j < total % n_new) for j in range(n_new)]
    supply = [sum(b for o, _, b in blocks if o == x) for x in olds]
    flow = min_cost_flow(supply, capacity, lambda i, j: int(olds[i] != j))
    shard: dict[tuple[int, int], int] = {}
    size = [0] * n_new
    held: list[list[tuple[int, int, int]]] = [[] for _ in range(n_new)]
    for i, o in enumerate(olds):
        left = {j: x for (a, j), x in flow.items() if a == i}
        for b, k in sorted(((b, k) for x, k, b in blocks if x == o), reverse=True):
            j = max(left, key=lambda j: (left[j], j == o, -j))
            left[j] -= b
            size[j] += b
            held[j].append((b, o, k))
    for h in held:
        h.sort()
    for _ in range(4 * len(blocks)):
        hi, lo = max(range(n_new), key=lambda j: size[j]), min(range(n_new), key=lambda j: size[j])
        gap = size[hi] - size[lo]
        # the block that evens the two best
        best = min(held[hi], key=lambda x: abs(gap - 2 * x[0]), default=None)
        if best is None or best[0] >= gap or best[0] <= 0:
            break
        held[hi].remove(best)
        held[lo].append(best)
        size[hi] -= best[0]
        size[lo] += best[0]
    for j, h in enumerate(held):
        for _, o, k in h:
            shard[o, k] = j
    moves = [(o, shard[o, k], b) for o, k, b in blocks if shard[o, k] != o]
    return Plan(shard, sum(b for *_, b in moves), {x for o, j, _ in moves for x in (o, j)})


@dataclass
class Layout:
    """Where each shard's rows lie: its folder under the layout it was written in."""

    folders: dict[int, str]

    def rows(self, spark: SparkSession) -> DataFrame:
        """doc_id, text, size, old_shard, slot, part, shard of all shards."""
        by_folder = [spark.read.parquet(f).withColumn("shard", F.lit(j)) for j, f in sorted(self.folders.items())]
        return reduce(DataFrame.unionByName, by_folder)


def _sized(docs: DataFrame, old_shard: Column, blocks: int) -> DataFrame:
    names = docs.columns
    for n in ("doc_id", "text"):
        if n not in names:
            raise ValueError(f"column {n!r} is missing; there are {names}")
    # by place: no column of the caller's, whatever its name, is taken for the shard
    placed = docs.select("*", old_shard.cast("int")).toDF(*[f"c{i}" for i in range(len(names) + 1)])
    d = placed.select(F.col(f"c{names.index('doc_id')}").alias("doc_id"), F.col(f"c{names.index('text')}").alias("text"), F.coalesce(f"c{len(names)}", F.lit(-1)).alias("old_shard"))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    d = d.withColumn("size", size).withColumn("h", F.xxhash64("doc_id", F.length("text"), F.crc32("text")))
    return d.withColumn("bucket", F.pmod("h", F.lit(blocks)).cast("int"))


def _placed(d: DataFrame, sums: list, p: Plan, file_bytes: int) -> DataFrame:
    """Rows with shard, part and slot, of the shards that change."""
    spark = d.sparkSession
    per: dict[int, list] = {}
    for r in sums:
        per.setdefault(p.shard[r["old_shard"], r["bucket"]], []).append(r)
    rows, cut_blocks = [], False
    for j in p.changed & per.keys():
        parts, filled, at = 0, 0, 0
        before = 0
        for r in sorted(per[j], key=lambda r: (r["old_shard"], r["bucket"])):
            subs = -(-r["b"] // file_bytes)
            cut_blocks |= subs > 1
            if filled and (subs > 1 or filled + r["b"] > file_bytes):
                parts, filled = parts + 1, 0
            if not filled:
                before = at
            rows.append((r["old_shard"], r["bucket"], j, parts, subs, at if subs > 1 else before))
            if subs > 1:
                parts, filled = parts + subs, 0
            else:
                filled += r["b"]
            at += r["n"]
    where = spark.createDataFrame(rows, "old_shard int, bucket int, shard int, part int, subs long, before long")
    placed = d.join(F.broadcast(where), ["old_shard", "bucket"])
    sub = F.when(F.col("subs") > 1, F.pmod(F.xxhash64("h"), F.col("subs"))).otherwise(F.lit(0)).cast("int")
    placed = placed.withColumn("sub", sub).withColumn("part", F.col("part") + F.col("sub"))
    if cut_blocks:
        # where a part begins within its block is known from the counts of the parts before it
        block = ["old_shard", "bucket"]
        counts = placed.where("subs > 1").groupBy(*block, "sub").agg(F.count("*").alias("n"))
        earlier = Window.partitionBy(*block).orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.select(*block, "sub", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skipped"))
        placed = placed.join(counts, [*block, "sub"], "left").withColumn("before", F.col("before") + F.coalesce("skipped", F.lit(0)))
    in_part = Window.partitionBy("shard", "part").orderBy("old_shard", "bucket", "doc_id", F.crc32("text"))
    placed = placed.withColumn("slot", F.col("before") + F.row_number().over(in_part) - 1)
    return placed.select("doc_id", "text", "size", "old_shard", "slot", "part", "shard")


def _summed(d: DataFrame, blocks: int) -> tuple[DataFrame, list]:
    """``d`` with its buckets, and the blocks' bytes and rows: with buckets joined where there are so many old shards
    that all blocks would be more than MAX_BLOCKS."""
    sums = d.groupBy("old_shard", "bucket").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    sums = cut(sums, "blocks")
    olds = sums.select("old_shard").distinct().count()
    if olds > MAX_BLOCKS:
        raise ValueError(f"{olds} old shards; {MAX_BLOCKS} blocks are planned on the driver")
    fewer = blocks
    while fewer > 1 and olds * fewer > MAX_BLOCKS:
        fewer = next(n for n in range(fewer - 1, 0, -1) if blocks % n == 0)  # a divisor, so that buckets stay whole
    bucket = F.pmod("bucket", F.lit(fewer)).cast("int")
    if fewer < blocks:
        d, sums = d.withColumn("bucket", bucket), sums.groupBy("old_shard", bucket.alias("bucket")).agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
    return d, sums.collect()


def reshard(docs: DataFrame, old_shard: Column, n_new: int = SHARDS, blocks: int = BLOCKS, file_bytes: int = FILE_BYTES) -> tuple[DataFrame, Plan]:
    """``docs`` (doc_id, text), laid out by the column ``old_shard``, in ``n_new`` shards of near equal bytes.

    Returns the rows (doc_id, text, size, old_shard, shard, part, slot) and the plan. Rows of shards that change are written under
    shard=N in the shared folder and read from there; those of the others are not written: they are read where they lie and
    numbered as their shard's only blocks. A document's size is the UTF-8 bytes of its text (none for null) plus 8.

    The law is ``bytes`` alone: equal texts form no groups that would have to stay together. doc_id and text may be null or
    repeat: a row's block and part hang on both, so that only rows equal in both share a part whatever their number (ties in
    slots fall to any of them). A null shard is shard -1. A very long text is one row of its part. Other columns play no part, whatever
    their names. An empty table gives no rows. More old shards than MAX_BLOCKS, or than MAX_EDGES allows for ``n_new``, are an error.
    """
    spark = docs.sparkSession
    d = _sized(docs, old_shard, blocks)
    d, sums = _summed(d, blocks)
    p = plan([(r["old_shard"], r["bucket"], r["b"]) for r in sums], n_new)
    folder = new_folder(spark, "shards")
    written = _placed(d, sums, p, file_bytes)
    written.write.partitionBy("shard").parquet(folder)
    rows = spark.read.schema(written.schema).parquet(folder)
    if still := sorted({j for j in p.shard.values()} - p.changed):
        # their blocks are all their own, so that the plan of nothing but them numbers their rows
        own = Plan({k: j for k, j in p.shard.items() if j in still}, 0, set(still))
        kept = _placed(d.where(F.col("old_shard").isin(still)), [r for r in sums if r["old_shard"] in still], own, file_bytes)
        rows = rows.unionByName(kept)
    return rows, p


def write_layout(docs: DataFrame, shard: Column, blocks: int = BLOCKS, file_bytes: int = FILE_BYTES) -> Layout:
    """``docs`` (doc_id, text) written as the layout that the column ``shard`` names, a folder a shard."""
    spark = docs.sparkSession
    d = _sized(docs, shard, blocks)
    d, sums = _summed(d, blocks)
    p = Plan({(r["old_shard"], r["bucket"]): r["old_shard"] for r in sums}, 0, {r["old_shard"] for r in sums})
    folder = new_folder(spark, "layout")
    _placed(d, sums, p, file_bytes).write.partitionBy("shard").parquet(folder)
    return Layout({j: f"{folder}/shard={j}" for j in sorted(p.changed)})


def reshard_files(spark: SparkSession, layout: Layout, n_new: int = SHARDS, blocks: int = BLOCKS, file_bytes: int = FILE_BYTES) -> tuple[Layout, Plan]:
    """The layout in ``n_new`` shards: shards that change are written to a new folder, the others keep their files."""
    old = layout.rows(spark)
    d = _sized(old, F.col("shard"), blocks)
    d, sums = _summed(d, blocks)
    p = plan([(r["old_shard"], r["bucket"], r["b"]) for r in sums], n_new)
    folder = new_folder(spark, "layout")
    if p.changed:
        _placed(d, sums, p, file_bytes).write.partitionBy("shard").parquet(folder)
    held = sorted(set(p.shard.values()))
    return Layout({j: f"{folder}/shard={j}" if j in p.changed else layout.folders[j] for j in held}), p


def source_layout(docs: DataFrame, n_old: int = OLD_SHARDS) -> DataFrame:
    """doc_id, text and the old shard of a layout by source: uneven, as one source may hold a third of all rows."""
    d = pick(docs, "doc_id", "text", "source")
    return d.select("doc_id", "text", F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(n_old)).cast("int").alias("old_shard"))


def op5_min_cost_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = reshard(source_layout(table(spark, sf_dir, "documents")), F.col("old_shard"))
    return rows.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )
