"""SimHash near-duplicates (op 3) with sharded BK-trees.

Fingerprints: 64 bits from the XXH64 values of all three-word shingles. Documents with one fingerprint are
one point from then on, so copies are never paired. Points that differ in at most two bits agree
in at least two of four 16-bit blocks, so six keyings put every linked pair into a common shard.
A shard's points form BK-trees of at most ``tree_points`` nodes, children keyed by their Hamming
distance to the parent; a tree is sent to the blocks of queries of its own shard, never to the whole
cluster, as all trees together grow with the data. A query follows only edges whose key is within
the radius of its distance to the node. A large shard is a grid of such tree and query blocks; each
returns a spanning forest of the links it finds, no list of pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, only_memory, pick, table

RADIUS = 2
#: Nodes of one tree: the bound on what is sent to each block of queries.
TREE_POINTS = 512
#: A longer text is hashed in parts of about so many bytes, which overlap by two words.
PART_BYTES = 1 << 22
_SPACE = b" \t\n\x0b\x0c\r"


def shingles(text: str, size: int = 3) -> Iterator:
    """XXH64 values of the text's shingles of ``size`` words (of the whole, if it has fewer), in uint64 arrays."""
    import numpy as np
    import xxhash

    hash_of = xxhash.xxh64_intdigest
    raw = text.encode("utf-8", "surrogatepass").lower()
    n, carry, start = 0, [], 0
    while True:
        end = start + PART_BYTES
        if end < len(raw):
            while end < len(raw) and raw[end] not in _SPACE:
                end += 1
        words = carry + raw[start:end].split()
        last = end >= len(raw)
        count = len(words) - size + 1
        if count > 0:
            yield np.fromiter(map(hash_of, map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)), repeat(42)), np.uint64, count)
            n += count
        elif last and n == 0 and words:
            yield np.array([hash_of(b" ".join(words), 42)], np.uint64)
        if last:
            return
        carry, start = words[max(0, count) :], end


def fingerprint(text: str) -> int:
    """64-bit SimHash of the text's three-word shingles, unsigned."""
    return simhash(shingles(text))


def simhash(hashes: Iterable) -> int:
    """64-bit SimHash of arrays of hashes, unsigned; zero without any."""
    import numpy as np

    sums, n = np.zeros(64, np.int64), 0
    for h in hashes:
        for k in range(0, len(h), 1 << 16):
            bits = np.unpackbits(h[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums += bits.sum(0, dtype=np.int64)
        n += len(h)
    if not n:
        return 0
    return sum(1 << i for i in np.flatnonzero(2 * sums > n).tolist())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row."""
    d = pick(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_memory("simhash")
        for b in batches:
            fp = [_signed(fingerprint(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, fp long")


class BkTree:
    """Children are keyed by their Hamming distance to the parent."""

    def __init__(self):
        self.root: int | None = None
        self.children: dict[int, dict[int, int]] = {}

    def add(self, point: int) -> None:
        if self.root is None:
            self.root, self.children[point] = point, {}
            return
        at = self.root
        while at != point:
            d = (at ^ point).bit_count()
            below = self.children[at]
            if d not in below:
                below[d], self.children[point] = point, {}
                return
            at = below[d]

    def _edges(self, at: int, lo: int, hi: int) -> list[int]:
        """Children whose keys lie from ``lo`` to ``hi``."""
        below = self.children[at]
        if len(below) <= hi - lo:
            return [p for k, p in below.items() if lo <= k <= hi]
        return [below[k] for k in range(max(1, lo), hi + 1) if k in below]

    def within(self, point: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root is not None else []
        while todo:
            at = todo.pop()
            d = (at ^ point).bit_count()
            if d <= radius:
                found.append(at)
            todo += self._edges(at, d - radius, d + radius)
        return found


class Forest:
    """Union-find that keeps the links which joined two sets."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.up[y] = x
            self.links.append((a, b))


def links(points: DataFrame, radius: int = RADIUS, tree_points: int = TREE_POINTS) -> DataFrame:
    """Spanning links (u, v) among the distinct longs ``fp`` that differ in at most ``radius`` bits."""
    if not 0 <= radius <= 2:
        raise ValueError("the shards' keys are complete for a radius of 0 to 2")
    block = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))
    keys = [F.shiftleft(F.lit(k).cast("long"), 32) + F.shiftleft(block(i), 16) + block(j) for k, (i, j) in enumerate(combinations(range(4), 2))]
    rows = points.select("fp", F.explode(F.array(*keys)).alias("shard"))
    rows = cut(rows, "shards")
    sizes = rows.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, "shard").withColumn("m", F.ceil(F.col("n") / tree_points).cast("int"))
    rows = rows.withColumn("c", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    cells = rows.select("shard", F.least("c", "j").alias("a"), F.greatest("c", "j").alias("b"), (F.col("c") <= F.col("j")).alias("tree"), "fp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, forest = None, BkTree(), Forest()
        out: list[tuple[int, int]] = []
        mask = (1 << 64) - 1
        for b in batches:
            for shard, x, y, of_tree, fp in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if (shard, x, y) != now:
                    out += forest.links
                    now, tree, forest = (shard, x, y), BkTree(), Forest()
                p = fp & mask
                if not of_tree or x == y:
                    for q in tree.within(p, radius):
                        forest.join(q, p)
                if of_tree:
                    tree.add(p)
            yield _edges(out)
            out = []
        yield _edges(forest.links)

    def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([_signed(p[i]) for p in found], pa.int64()) for i in (0, 1)], ["u", "v"])

    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.repartition(n, "shard", "a", "b").sortWithinPartitions("shard", "a", "b", F.desc("tree"), "fp")
    return cells.mapInArrow(search, "u long, v long")


def labelled(prints: DataFrame, radius: int = RADIUS, tree_points: int = TREE_POINTS) -> DataFrame:
    """For each distinct fp: component_id, the smallest doc_id that its links reach."""
    points = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    comp = components(links(points.select("fp"), radius, tree_points))
    held = points.join(comp, points["fp"] == comp["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    roots = held.groupBy("component").agg(F.min("least").alias("component_id"))
    return held.join(roots, "component").select("fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tree_points: int = TREE_POINTS) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs`` (doc_id, text).

    Null and empty texts have fingerprint zero and are linked like any other; a very long text is hashed in parts of
    PART_BYTES, to the same fingerprint; a bit that is set in exactly half of the shingles is 0; a null doc_id stays
    null and names a component only if nothing else can; repeated rows come back as often;
    other columns play no part, whatever their names; an empty table gives no rows.
    """
    prints = cut(fingerprints(docs), "fingerprints")
    ids = labelled(prints, radius, tree_points)
    return prints.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
