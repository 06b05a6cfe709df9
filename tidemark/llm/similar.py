"""Near-duplicates of whole texts by word shingles: the pipeline's SimHash stage (op 3's query itself is ``simhash``).

Texts with one set of five-word shingles are one point. A point's fingerprint is a SimHash of PRINT_BITS bits
over its shingles. Links begin with op 3's operator: points whose fingerprints of 64 bits differ in at most two are found by sharded BK-trees
(``simhash.links``), and whole sets decide them. That loses nearly all pairs at SHARE, so wider fingerprints find the rest. At a Jaccard similarity of SHARE two fingerprints differ by 15.3 % of their bits or less (sets of fewer
than SMALL shingles: 18.8 %), so links lie within a radius of 4.4 standard deviations more. Such a radius is far too wide
for shards that are blocks of the fingerprint; the shards are BANDS keys of ROWS MinHash values instead. A pair at
SHARE shares none with a chance of (1 - SHARE ** ROWS) ** BANDS, some 7 in a million, and less above it.

Within a shard all fingerprints are compared, in blocks of at most BLOCK_POINTS: one matrix of exclusive ors and bit counts. (BK-trees
don't help at this radius: distances of unrelated fingerprints lie so close together that every edge is within it, and
a tree visits 97 % of its nodes.) In a first round, over NEAR_BANDS of the keys and the first bits of the fingerprints, each point
looks up the nearest point of its own block; these pairs are few, and linked ones form components. In a second round the shards
that still hold several components are a grid of blocks, and pairs of different components within the radius come out,
each from the first shard that holds both. Every pair that comes out is decided by its
whole sets, so that the fingerprint finds pairs and never links them. A group of copies thus costs as much as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import components, cut, only_memory, short_batches
from . import simhash
from .simhash import PART_BYTES, _signed

WORDS = 5
SHARE = 0.8
BANDS, ROWS = 30, 5
PRINT_BITS = 2048
#: Bits by which linked points differ at most, and where one of them has fewer than SMALL shingles.
RADIUS, RADIUS_SMALL, SMALL = 384, 460, 64
#: The first round looks only at so many keys and at so many bytes of a fingerprint, within these radii: it proposes pairs and may miss some.
NEAR_BANDS, NEAR_BYTES, NEAR, NEAR_SMALL = 30, 64, 114, 135
#: Points of one block.
BLOCK_POINTS = 512
#: Rows whose texts or sets are held as Python objects at once.
SLICE = 256
#: Bits a compared text of the table that tells which texts are compared at all, and its size at most (32 MB): what it lets through in
#: excess is written and joins with nothing.
FILTER_BITS, FILTER_LEAST, FILTER_MOST = 16, 1 << 20, 1 << 28
_SPACE = b" \t\n\x0b\x0c\r"


def _word_hashes(text: str):
    """XXH64 of each word, A to Z in lower case; a long text is split in parts."""
    import numpy as np
    import xxhash

    raw = text.encode("utf-8", "surrogatepass").lower()
    found, start = [], 0
    while start < len(raw):
        end = start + PART_BYTES
        while end < len(raw) and raw[end] not in _SPACE:
            end += 1
        words = raw[start:end].split()
        found.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
        start = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_set(text: str | None, words: int = WORDS):
    """The distinct shingles' hashes, sorted: each a polynomial of its words' hashes, mixed."""
    import numpy as np

    w = _word_hashes(text) if text else np.zeros(0, np.uint64)
    size = min(words, len(w))
    if not size:
        return w
    n = len(w) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += w[k : k + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return np.unique(h)


@cache
def _factors():
    import numpy as np

    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 1 << 32, (2, BANDS * ROWS, 1), np.uint32)
    return a | np.uint32(1), b


def band_keys(found) -> list[int]:
    """BANDS signed longs of a set of hashes; none of an empty one."""
    import numpy as np
    import xxhash

    if not len(found):
        return []
    a, b = _factors()
    low = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    for k in range(0, len(low), 1024):
        least = np.minimum(least, (a * low[None, k : k + 1024] + b).min(1))
    raw = least.astype("<u4").reshape(BANDS, ROWS)
    return [_signed(xxhash.xxh64_intdigest(raw[i].tobytes(), seed=i)) for i in range(BANDS)]


def wide_print(found) -> bytes:
    """SimHash of PRINT_BITS bits of a set of hashes: a bit is set if it is in over half of the hashes' words."""
    import numpy as np

    steps = np.arange(1, PRINT_BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sums = np.zeros(PRINT_BITS, np.int64)
    for k in range(0, len(found), 512):
        x = found[k : k + 512, None] + steps
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        sums += np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * sums > len(found), bitorder="little").tobytes()


def alike(a, b, share: float = SHARE) -> bool:
    """Do two sorted sets have a Jaccard similarity of at least ``share``?"""
    import numpy as np

    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= share * (len(a) + len(b) - both) - 1e-9


def _compared(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """Of ``pairs`` (u, v) those whose ``sets`` (uid, hashes) are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            x, y = b.column("x"), b.column("y")
            good = [alike(np.frombuffer(x[i].as_py(), "<u8"), np.frombuffer(y[i].as_py(), "<u8"), share) for i in range(b.num_rows)]
            yield b.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    x = sets.select(F.col("uid").alias("u"), F.col("hashes").alias("x"))
    y = sets.select(F.col("uid").alias("v"), F.col("hashes").alias("y"))
    return pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(run, "u long, v long")


def _sets(full: DataFrame, text: str, shared: DataFrame, words: int) -> DataFrame:
    """uid, n, hashes, print and marks of the rows of ``full`` that ``shared`` names, and of a few others."""
    import numpy as np

    bits = min(FILTER_MOST, max(FILTER_LEAST, 1 << (FILTER_BITS * shared.count()).bit_length()))
    place = F.pmod(F.xxhash64("uid"), F.lit(bits))
    ends = shared.select(place.alias("p"))
    cells = ends.groupBy(F.expr("p div 32").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 32 as int))")).alias("bits"))
    table = np.zeros(bits // 32, np.int64)
    for r in cells.toLocalIterator():
        table[r["at"]] = r["bits"]
    sent = full.sparkSession.sparkContext.broadcast(table.astype("<u4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("p").to_numpy()
            b = b.filter(pa.array((sent.value[at // 32] >> (at % 32).astype("u4")) & 1 == 1))
            for k in range(0, b.num_rows, SLICE):
                part = b.slice(k, SLICE)
                found = [shingle_set(t, words) for t in part.column("text").to_pylist()]
                marks = [np.array(x, np.int64).astype("<u4").tobytes() for x in part.column("keys").to_pylist()]
                more = [[x.astype("<u8").tobytes() for x in found], [wide_print(x) for x in found], marks]
                yield pa.RecordBatch.from_arrays([part.column("uid"), part.column("n"), *(pa.array(x, pa.binary()) for x in more)], ["uid", "n", "hashes", "print", "marks"])

    rows = full.select("uid", "n", "keys", place.alias("p"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "uid long, n int, hashes binary, print binary, marks binary")


def _pairs(u, v) -> pa.RecordBatch:
    import numpy as np

    return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])


def _blocks(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[dict]:
    """The rows of each block, that is, of equal ``keys``, which come one after the other: a dict of arrays by column."""
    import numpy as np

    def arrays(b: pa.RecordBatch) -> dict:
        kinds = {"print": "<u8", "marks": "<u4"}
        joined = lambda c, kind: np.frombuffer(b"".join(c.to_pylist()), kind).reshape(b.num_rows, -1)
        return {n: joined(b.column(n), kinds[n]) if n in kinds else b.column(n).to_numpy(zero_copy_only=False) for n in b.schema.names}

    def whole(held: list[dict]) -> dict:
        return held[0] if len(held) == 1 else {n: np.concatenate([x[n] for x in held]) for n in held[0]}

    held: list[dict] = []
    for b in batches:
        if not b.num_rows:
            continue
        x = arrays(b)
        new = np.ones(b.num_rows, bool)
        new[1:] = np.any([x[k][1:] != x[k][:-1] for k in keys], axis=0)
        starts = np.flatnonzero(new).tolist()
        if held and any(held[-1][k][-1] != x[k][0] for k in keys):
            yield whole(held)
            held = []
        for i, j in zip(starts, starts[1:], strict=False):
            held.append({n: c[i:j] for n, c in x.items()})
            yield whole(held)
            held = []
        held.append({n: c[starts[-1] :] for n, c in x.items()})
    if held:
        yield whole(held)


def differing(a, b):
    """Bits by which each row of ``a`` differs from each row of ``b``."""
    import numpy as np

    out = np.zeros((len(a), len(b)), np.int16)
    for k in range(a.shape[1]):
        out += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    return out


def _can_link(x: dict, y: dict, share: float, radius: int, small: int):
    """Pairs of rows whose sizes and fingerprints don't rule out a link, and the fingerprints' distances."""
    import numpy as np

    d = differing(x["print"], y["print"])
    lo, hi = np.minimum(x["n"][:, None], y["n"]), np.maximum(x["n"][:, None], y["n"])
    return (lo >= share * hi - 1e-9) & (d <= np.where(lo < SMALL, small, radius)), d


def _by_trees(points: DataFrame) -> DataFrame:
    """Of ``points`` (uid, fp) pairs (u, v) whose fingerprints of 64 bits differ in at most two: a spanning forest, found by op 3's sharded BK-trees;
    points of one fingerprint are paired with the first of them."""
    own = points.groupBy("fp").agg(F.min("uid").alias("u"))
    same = points.join(own, "fp").where("uid <> u").select("u", F.col("uid").alias("v"))
    near = simhash.links(own.select("fp")).toDF("a", "b")
    near = near.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
    return same.unionByName(near)


def _nearest(rows: DataFrame, share: float, block_points: int) -> DataFrame:
    """Of the points (key, uid, n, size, print) of each shard pairs (u, v) of near neighbours: at most one a point and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for x in _blocks(batches, "key", "c"):
            good, d = _can_link(x, x, share, NEAR, NEAR_SMALL)
            d = np.where(np.tril(good, -1), d, np.int16(PRINT_BITS))
            at = d.argmin(1)
            own = np.flatnonzero(d[np.arange(len(at)), at] < PRINT_BITS)
            if len(own):
                yield _pairs(x["uid"][own], x["uid"][at[own]])

    cells = rows.withColumn("c", F.pmod(F.xxhash64("uid"), F.ceil(F.col("size") / block_points)).cast("int"))
    cells = cells.select("key", "c", "uid", "n", F.substring("print", 1, NEAR_BYTES).alias("print")).repartition("key", "c").sortWithinPartitions("key", "c", "uid")
    return cells.mapInArrow(run, "u long, v long").distinct()


def _across(rows: DataFrame, share: float, block_points: int) -> DataFrame:
    """Of the points (key, band, uid, n, size, comp, print, marks) of each shard all pairs (u, v) within the radius that lie in
    different components; a pair comes from the first band that its points share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for x in _blocks(batches, "key", "a", "b"):
            band, one = int(x["band"][0]), x["a"][0] == x["b"][0]
            left, right = (x, x) if one else ({n: c[side] for n, c in x.items()} for side in (x["first"], ~x["first"]))
            if not len(left["uid"]) or not len(right["uid"]):
                continue
            good, _ = _can_link(left, right, share, RADIUS, RADIUS_SMALL)
            good &= left["comp"][:, None] != right["comp"]
            i, j = np.nonzero(np.triu(good, 1) if one else good)
            new = ~(left["marks"][i, :band] == right["marks"][j, :band]).any(1)
            if new.any():
                yield _pairs(left["uid"][i[new]], right["uid"][j[new]])

    # a shard of more than block_points is a grid of blocks, each pair of them a group of bounded size
    cells = rows.withColumn("m", F.ceil(F.col("size") / block_points).cast("int")).withColumn("c", F.pmod(F.xxhash64("uid"), F.col("m")).cast("int"))
    cells = cells.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    cells = cells.select("key", "band", F.least("c", "j").alias("a"), F.greatest("c", "j").alias("b"), (F.col("c") <= F.col("j")).alias("first"), "uid", "n", "comp", "print", "marks")
    return cells.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(run, "u long, v long")


def keep_one(docs: DataFrame, words: int = WORDS, share: float = SHARE, block_points: int = BLOCK_POINTS) -> DataFrame:
    """``docs`` with one row of each group that similar texts form, also by way of others: the one with the smallest
    doc_id (null last; ties: any one of the rows). All columns of ``docs`` stay, whatever their names.

    Null and empty texts and texts without any word are alike. A text of fewer than ``words`` words is one shingle. Repeated rows
    are copies. A very long text is hashed in parts, its set of shingles held by one task. An empty table gives no rows.
    """
    if not SHARE <= share <= 1:
        raise ValueError(f"the keys find pairs of a similarity of {SHARE} to 1")
    short_batches(docs.sparkSession)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at_id, at_text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    out = StructType([*plain.schema.fields, StructField("sig", LongType()), StructField("n", IntegerType()), StructField("fp", LongType()), StructField("keys", ArrayType(LongType()))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        only_memory("similar")
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                b = batch.slice(k, SLICE)
                found = [shingle_set(t, words) for t in b.column(at_text).to_pylist()]
                more = [pa.array([_signed(xxhash.xxh64_intdigest(x.tobytes())) for x in found], pa.int64()), pa.array([len(x) for x in found], pa.int32()), pa.array([_signed(simhash.simhash([x])) for x in found], pa.int64()), pa.array([band_keys(x) for x in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "sig", "n", "fp", "keys"])

    full = cut(plain.mapInArrow(add, out).withColumn("uid", F.monotonically_increasing_id()), "printed")
    own = F.struct(F.col(at_id).isNull().alias("none"), F.col(at_id).alias("id"), "uid", "n", "fp", "keys")
    points = cut(full.groupBy("sig").agg(F.min(own).alias("r")).select("r.*"), "points")
    rows = points.select("uid", F.posexplode("keys").alias("band", "key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = cut(rows.join(sizes, "key"), "shared")
    sets = cut(_sets(full, at_text, shared.select("uid").distinct(), words), "sets")
    placed = shared.join(sets.drop("hashes"), "uid")
    # only what shares a key has its set written; a pair at SHARE that shares none is as rare as is said above
    trees = _by_trees(points.join(shared.select("uid").distinct(), "uid").select("uid", "fp"))
    first = cut(_nearest(placed.where(F.col("band") < NEAR_BANDS), share, block_points).unionByName(trees).distinct(), "pairs")
    links = cut(_compared(first, sets, share), "links")
    comp = components(links)
    held = shared.join(comp, F.col("uid") == F.col("node"), "left").select(*shared.columns, F.coalesce("component", "uid").alias("comp"))
    mixed = held.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    open_ = cut(held.join(mixed, "key", "left_semi"), "open")
    second = _across(open_.join(sets.drop("hashes"), "uid"), share, block_points).join(first, ["u", "v"], "left_anti")
    comp = components(links.unionByName(cut(_compared(second, sets, share), "links")))
    ends = points.join(comp, F.col("uid") == F.col("node"), "left").select("none", "id", "uid", F.coalesce("component", "uid").alias("c"))
    rep = ends.groupBy("c").agg(F.min(F.struct("none", "id", "uid")).alias("r"))
    # what goes is the smaller side; as a written table its size is known, so that texts are shuffled only where it can't be broadcast
    gone = cut(full.select("uid").join(rep.select("r.uid"), "uid", "left_anti"), "gone")
    return full.join(gone, "uid", "left_anti").select(*plain.columns).toDF(*names)
