"""An index for cosine search that loses nothing: coarse centroids, and the triangle inequality of angles.

Vectors of one length are points of a sphere. Each is assigned to the centroid at the smallest angle, and within this cell to a ring by that angle.
If a query lies at an angle of p from a centroid, a vector within d of the query lies between p - d and p + d from the centroid: only the rings
that meet this interval are read. So the centroids decide how much is read, never what is found; they are fitted on
a bounded sample.

The index is dealt in tiles: runs of blocks in the order of cell and ring, of a bounded number of bytes. A query is sent once to each tile that holds a
ring it has to read, however many rings these are, and the tile's task finds the rings anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import new_folder

#: Vectors that centroids are fitted on at most (those with the smallest hashes of their ids), centroids of one length, and rounds.
SAMPLE, CENTROIDS, ROUNDS = 1 << 14, 256, 6
#: Rings of a half turn.
RINGS = 64
#: Vectors of one block.
ROWS = 1024
#: Angles are widened by this much against rounding.
SLACK = 1e-6
#: Bytes of the vectors of one tile, and of the queries that meet it in one task.
TILE_BYTES = 1 << 25


def _unit(x):
    """Rows of some direction as rows of length one."""
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _units(column: pa.Array):
    """Which rows are vectors of some direction, these as they are, and as unit rows, by length: {length: (rows, matrix, units)}."""
    held: dict[int, list[tuple[int, list[float]]]] = {}
    for i, v in enumerate(column.to_pylist()):
        if v and None not in v:
            held.setdefault(len(v), []).append((i, v))
    out = {}
    for n, own in held.items():
        x = np.array([v for _, v in own], np.float64)
        top = np.abs(x).max(1)
        good = np.isfinite(top) & (top > 0)
        out[n] = (np.array([i for i, _ in own])[good], x[good], _unit(x[good]))
    return {n: v for n, v in out.items() if len(v[0])}


def _angles(x, c):
    return np.arccos(np.clip(x @ c.T, -1.0, 1.0))


def fit(vectors: DataFrame, k: int = CENTROIDS, sample: int = SAMPLE, count: int | None = None) -> dict[int, np.ndarray]:
    """Centroids by length of vector, from at most ``sample`` of ``vectors`` (id, embedding), of which there are ``count``."""
    rows = vectors.where("embedding IS NOT NULL")
    if count and count > 2 * sample:  # the smallest hashes lie below this one: what is sorted and sent doesn't grow with the rows
        rows = rows.where(F.xxhash64("id") < F.lit(int((1.2 * sample / count - 0.5) * 2.0**64)))
    rows = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select(F.col("embedding").cast("array<double>").alias("x"))
    units = _units(pa.array([r["x"] for r in rows.collect()], pa.list_(pa.float64())))
    out = {}
    for n, (_, _, x) in units.items():
        c = x[: max(1, min(k, int(len(x) ** 0.5)))].copy()
        for _ in range(ROUNDS):
            at = (x @ c.T).argmax(1)
            for i in np.unique(at):
                s = x[at == i].sum(0)
                if (size := np.linalg.norm(s)) > 0:
                    c[i] = s / size
        out[n] = c
    return out


def _ring(angle):
    return np.minimum((angle * (RINGS / np.pi)).astype(np.int64), RINGS - 1)


def _kind(vectors: DataFrame) -> str:
    """How a component is written: as it is in the column, in four bytes or in eight."""
    return "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"


@dataclass
class Index:
    """Blocks of vectors (tile, dim, cell, ring, n, ids, x) in a folder, and the centroids that they lie around."""

    spark: SparkSession
    folder: str
    centroids: dict[int, np.ndarray] = field(repr=False)
    kind: str = "<f8"

    def blocks(self) -> DataFrame:
        return self.spark.read.schema("tile long, dim int, cell int, ring int, n int, ids binary, x binary").parquet(self.folder)

    def tiles(self) -> dict[int, np.ndarray]:
        """By length of vector: (tile, cell, least ring, greatest ring) of what each tile holds; as tiles follow the order of cells, about a row a tile and a cell."""
        rows = self.blocks().groupBy("dim", "tile", "cell").agg(F.min("ring").alias("lo"), F.max("ring").alias("hi")).collect()
        out: dict[int, list] = {}
        for r in rows:
            out.setdefault(r["dim"], []).append((r["tile"], r["cell"], r["lo"], r["hi"]))
        return {n: np.array(own, np.int64) for n, own in out.items()}


def _plain(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("id").cast("long").alias("id"), "embedding").where("id IS NOT NULL")


def _placed(vectors: DataFrame, sent, kind: str) -> DataFrame:
    """dim, cell, ring, id, x of each of ``vectors`` (id, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("id").to_numpy(zero_copy_only=False)
            for n, (rows, raw, x) in _units(b.column("embedding")).items():
                angle = _angles(x, sent.value[n])
                cell = angle.argmin(1)
                ring = _ring(angle[np.arange(len(x)), cell])
                cols = [np.full(len(x), n, np.int32), cell.astype(np.int32), ring.astype(np.int32), ids[rows]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array([v.tobytes() for v in raw.astype(kind)], pa.binary())], ["dim", "cell", "ring", "id", "x"])

    return _plain(vectors).mapInArrow(run, "dim int, cell int, ring int, id long, x binary")


def _packed(placed: DataFrame, tiles: int) -> DataFrame:
    """Rows (dim, cell, ring, id, x) as blocks of at most ROWS of one ring: dealt by place and id, so that a ring may hold any share of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, size = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            key = np.stack([b.column(n).to_numpy() for n in ("dim", "cell", "ring")], 1)
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]).any(1)
            starts = np.flatnonzero(new).tolist()
            for i, j in zip(starts, [*starts[1:], len(key)], strict=True):
                for a in range(i, j, ROWS):
                    part = b.slice(a, min(ROWS, j - a))
                    ids = part.column("id").to_numpy().astype("<i8").tobytes()
                    x = b"".join(part.column("x").to_pylist())
                    if size and size + len(x) > TILE_BYTES:
                        tile, size = tile + 1, 0
                    size += len(x)
                    row = [pa.array([int(v)], pa.int32()) for v in (*key[i], part.num_rows)]
                    yield pa.RecordBatch.from_arrays([pa.array([tile], pa.int64()), *row, pa.array([ids], pa.binary()), pa.array([x], pa.binary())], ["tile", "dim", "cell", "ring", "n", "ids", "x"])

    dealt = placed.repartitionByRange(tiles, "dim", "cell", "ring", "id").sortWithinPartitions("dim", "cell", "ring", "id")
    return dealt.mapInArrow(run, "tile long, dim int, cell int, ring int, n int, ids binary, x binary")


def build(vectors: DataFrame, folder: str | None = None, centroids: dict[int, np.ndarray] | None = None) -> Index:
    """The index of ``vectors`` (id, embedding): every row whose vector has a direction (null, zero and non-finite ones have none)."""
    spark = vectors.sparkSession
    folder, kind = folder or new_folder(spark, "vectors"), _kind(vectors)
    lengths = {r["n"]: r["count"] for r in vectors.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("n")).count().collect()}
    centroids = fit(vectors, count=sum(lengths.values())) if centroids is None else centroids
    # a length that the sample missed gets one centroid, so that its rows are found like any other's
    centroids = {n: centroids.get(n, np.eye(1, n)) for n in lengths}
    sent = spark.sparkContext.broadcast(centroids)
    size = sum(n * own for n, own in lengths.items()) * int(kind[-1])
    _packed(_placed(vectors, sent, kind), max(spark.sparkContext.defaultParallelism, -(-size // TILE_BYTES))).write.parquet(folder)
    return Index(spark, folder, centroids, kind)


def _asked(index: Index, queries: DataFrame, probes: float, parts: int) -> DataFrame:
    """tile, part, dim, id, x of each of ``queries`` (id, embedding) for each tile that may hold a vector within that angle: once, whatever the number of its rings."""
    sent, kind = index.spark.sparkContext.broadcast((index.centroids, index.tiles())), _kind(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, tiles = sent.value
        for b in batches:
            ids = b.column("id").to_numpy(zero_copy_only=False)
            for n, (rows, raw, x) in _units(b.column("embedding")).items():
                if n not in tiles:
                    continue  # no vector of this length is indexed
                lo, hi = _rings(_angles(x, centroids[n]), probes)
                own = [v.tobytes() for v in raw.astype(kind)]
                for tile in np.unique(tiles[n][:, 0]).tolist():
                    held = tiles[n][tiles[n][:, 0] == tile]
                    at = np.flatnonzero(((lo[:, held[:, 1]] <= held[:, 3]) & (hi[:, held[:, 1]] >= held[:, 2])).any(1))
                    if len(at):
                        cols = [pa.array(np.full(len(at), tile)), pa.array(np.full(len(at), n, np.int32)), pa.array(ids[rows[at]]), pa.array([own[i] for i in at.tolist()], pa.binary())]
                        yield pa.RecordBatch.from_arrays(cols, ["tile", "dim", "id", "x"])

    rows = _plain(queries).mapInArrow(run, "tile long, dim int, id long, x binary")
    return rows.withColumn("part", F.pmod(F.xxhash64("id", "x"), F.lit(parts)))


def _rings(angle, probes: float):
    """The first and the last ring that may hold a vector within ``probes`` of what lies at ``angle``."""
    return _ring(np.maximum(angle - probes - SLACK, 0)), _ring(np.minimum(angle + probes + SLACK, np.pi))


def _met(index: Index, queries: DataFrame, threshold: float, each, schema: str) -> DataFrame:
    """``each`` (ids, units, block's ids, block's units) of each block of the index and those of ``queries`` that have to meet it, at most ROWS at once."""
    probes, kind, own = float(np.arccos(threshold)), index.kind, _kind(queries)
    size = (queries.agg(F.sum(F.greatest(F.size("embedding"), F.lit(0)))).first()[0] or 0) * int(own[-1])
    parts = max(1, -(-size // TILE_BYTES))
    sent = index.spark.sparkContext.broadcast(index.centroids)
    names = [p.split()[0] for p in schema.split(", ")]

    def run(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        out = []
        of = np.array(asked.column("dim"))
        for n in np.unique(of).tolist():
            mine = asked.filter(pa.array(of == n))
            ids, x = np.array(mine.column("id")), _unit(np.frombuffer(b"".join(mine.column("x").to_pylist()), own).reshape(-1, n).astype(np.float64))
            cell = None
            for r in blocks.filter(pa.array(np.array(blocks.column("dim")) == n)).sort_by([("cell", "ascending"), ("ring", "ascending")]).to_batches(1):
                at, ring = r.column("cell")[0].as_py(), r.column("ring")[0].as_py()
                if at != cell:
                    cell, (lo, hi) = at, _rings(_angles(x, sent.value[n][at : at + 1])[:, 0], probes)
                near = np.flatnonzero((lo <= ring) & (ring <= hi))
                if len(near):
                    y = _unit(np.frombuffer(r.column("x")[0].as_py(), kind).reshape(-1, n).astype(np.float64))
                    for k in range(0, len(near), ROWS):
                        part = near[k : k + ROWS]
                        out.append(each(ids[part], x[part], np.frombuffer(r.column("ids")[0].as_py(), "<i8"), y))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[] for _ in names]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    kinds = [pa.float64() if p.endswith("double") else pa.int64() for p in schema.split(", ")]
    blocks = index.blocks().withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return _asked(index, queries, probes, parts).groupBy("tile", "part").cogroup(blocks.groupBy("tile", "part")).applyInArrow(run, schema)


def within(index: Index, queries: DataFrame, threshold: float = 0.88) -> DataFrame:
    """(a, b, cosine): for ``queries`` (id, embedding) all indexed vectors of other ids with a cosine of at least ``threshold``."""
    if not -1 <= threshold <= 1:
        raise ValueError("a cosine lies between -1 and 1")

    def found(qi, qx, vi, vx):
        m = qx @ vx.T
        i, j = np.nonzero(m >= threshold)
        return qi[i], vi[j], m[i, j]

    return _met(index, queries, threshold, found, "a long, b long, cosine double").where("a <> b")


def share_read(index: Index, queries: DataFrame, threshold: float = 0.88) -> float:
    """Of all comparisons of a query with a vector the share that ``within`` makes."""
    made = _met(index, queries, threshold, lambda qi, qx, vi, vx: ([len(qi) * len(vi)],), "made long").agg(F.sum("made")).first()[0] or 0
    n = index.blocks().agg(F.sum("n")).first()[0] or 0
    return made / (n * queries.count()) if n else 0.0
