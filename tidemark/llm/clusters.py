"""Centroid clustering (op 11): Lloyd's rounds over whole numbers, exact at any size.

The squared distances of a block of vectors to all centroids are one matrix product, |x|^2 - 2 x.c + |c|^2, in float64 BLAS.
Every term and every partial sum is a whole number of at most dims * (|x|max + |c|max)^2; where that stays below 2^53 for a row,
a double holds each of them exactly, whatever the order in which BLAS adds. Rows beyond the bound are computed in
integers: 64-bit ones below 2^62, Python's own above. So ties and floors are those of exact arithmetic.

Vectors lie in blocks in the shared folder. A round maps each block to counts and sums by centroid, combined by treeAggregate;
nothing else is moved, and the driver holds the centroids alone. What a task holds is one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only_memory, table
from .vectors import BLOCK, DOUBLE_SAFE, LONG_SAFE, blocks, first, kept, matrix, most, rows_of, whole

DIMS, CLUSTERS, ROUNDS, SEED, FACTOR = 64, 16, 3, 1, 64
#: Branches of the tree in which the partitions' sums are combined.
DEPTH = 3


def _integer_distances(x, c):
    """Squared distances in integers: 64-bit ones where the bound allows, else Python's own."""
    import numpy as np

    if x.shape[1] * (most(x) + most(c)) ** 2 >= LONG_SAFE:
        x, c = x.astype(object), c.astype(object)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def distances(x, c):
    """Squared distances (rows of x, rows of c) of whole numbers, exactly. int64, or objects where one is too large."""
    import numpy as np

    if not len(x) or x.dtype == object or c.dtype == object:
        return _integer_distances(x, c)
    dims, top = x.shape[1], most(c)
    near = np.abs(x).max(1)
    bound = max(0, int((DOUBLE_SAFE // max(1, dims)) ** 0.5) - 1 - top)  # dims * (bound + top)^2 < 2^53
    small = near < bound
    if small.all():
        return _gemm(x, c)
    rest = _integer_distances(x[~small], c)
    out = np.zeros((len(x), len(c)), rest.dtype)
    out[small] = _gemm(x[small], c)
    out[~small] = rest
    return out


def _gemm(x, c):
    import numpy as np

    a, b = x.astype(np.float64), c.astype(np.float64)
    d = a @ b.T
    d *= -2.0
    d += (a * a).sum(1)[:, None]
    d += (b * b).sum(1)
    return d.astype(np.int64)


def nearest(x, c):
    """The nearest row of c for each row of x (ties: the first), and its squared distance."""
    import numpy as np

    d = distances(x, c)
    at = d.argmin(1) if d.dtype != object else np.array([min(range(len(r)), key=r.__getitem__) for r in d], np.int64)
    return at, d[np.arange(len(x)), at]


def _sums(x, at, k: int):
    """Exact sums of the rows of x by their number, as Python integers."""
    import numpy as np

    out = np.zeros((k, x.shape[1]), object)
    if x.dtype != object and len(x) * most(x) >= LONG_SAFE:
        x = x.astype(object)
    for i in np.unique(at).tolist():
        out[i] += x[at == i].sum(0).astype(object)
    return out


def _add(a, b):
    return tuple(x + y for x, y in zip(a, b, strict=True))


def _gathered(data, c, factor: int):
    """Over all blocks: count, sum of vectors and sum of squared distances by centroid."""
    import numpy as np

    k, dims = c.shape
    sent = data.context.broadcast(c)

    def one(state, block):
        x = whole(matrix(dims, block), factor)
        at, d = nearest(x, sent.value)
        far = np.zeros(k, object)
        for i in np.unique(at).tolist():
            far[i] = sum(map(int, d[at == i].tolist()))
        return _add(state, (np.bincount(at, minlength=k).astype(object), _sums(x, at, k), far))

    zero = (np.zeros(k, object), np.zeros((k, dims), object), np.zeros(k, object))
    found = data.treeAggregate(zero, one, _add, DEPTH)
    sent.destroy()
    return found


def as_array(rows):
    """Whole numbers as int64 where they are within LONG_SAFE, else as they are."""
    import numpy as np

    x = np.array(rows, object)
    return x.astype(np.int64) if not x.size or most(x) < LONG_SAFE else x


def digest(numbers) -> str:
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def cluster(embeddings: DataFrame, dims: int = DIMS, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, factor: int = FACTOR) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector of ``embeddings`` (vec_id, embedding)
    that has ``dims`` components, none of them null or not finite. Others give no row.

    Centroids start as the ``k`` vectors whose sha256 of ``seed:vec_id`` is smallest (null ids last; ties: the least
    vector); fewer vectors give fewer centroids, no vectors no rows. Equal distances go to the smaller number. Repeated rows
    are vectors of their own, null ids stay null, and other columns play no part, whatever their names. Components of any
    finite size count exactly; a distance or an inertia that a long can't hold is an error.
    """
    import numpy as np

    spark = embeddings.sparkSession
    v = kept(embeddings).where(F.size("x") == dims)
    start = first(v, k, F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    kind = v.schema["vec_id"].dataType.simpleString()
    out = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return spark.createDataFrame([], out)
    c = as_array(whole(np.array(start), factor).tolist())
    data = blocks(v).select("x").rdd.map(lambda r: bytes(r["x"]))
    for _ in range(rounds):
        n, total, _far = _gathered(data, c, factor)
        c = as_array([[t // m for t in row] if m else old for m, row, old in zip(n.tolist(), total.tolist(), c.tolist(), strict=True)])
    *_, far = _gathered(data, c, factor)
    own, names = [int(x) for x in far.tolist()], [digest(row) for row in c.tolist()]
    if sum(own) >= 1 << 63:
        raise OverflowError(f"the inertia {sum(own)} is beyond a long")
    sent = spark.sparkContext.broadcast((c, own, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_memory("clusters")
        c, own, names = sent.value
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                b = batch.slice(a, BLOCK)
                at, d = nearest(whole(rows_of(b.column("x")), factor), c)
                at = at.tolist()
                cols = [pa.array(at, pa.int32()), pa.array(list(map(int, d.tolist())), pa.int64()), pa.array([own[i] for i in at], pa.int64()), pa.array([sum(own)] * len(at), pa.int64()), pa.array([names[i] for i in at], pa.string())]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), *cols], ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return v.select("vec_id", "x").mapInArrow(run, out)


def op11_gemm_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The same by plain joins: each round is an assignment and a mean."""
    steps = [
        """v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        """c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, x) - 1 AS k, x AS c FROM v QUALIFY k < 16)""",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT r, min(ROW(d, k)) AS m FROM (
    SELECT r, k, CAST(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v CROSS JOIN c{i}) GROUP BY r)""")
        if i < ROUNDS:
            steps.append(f"""s{i} AS (
  SELECT m[2] AS k, j, CAST(sum(x[j]) AS BIGINT) AS s, count(*) AS n FROM a{i} JOIN v USING (r) CROSS JOIN range(1, 65) AS t(j) GROUP BY ALL)""")
            steps.append(f"""c{i + 1} AS MATERIALIZED (
  SELECT k, coalesce(l, c) AS c FROM c{i} LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS l FROM s{i} GROUP BY k) USING (k))""")
    return f"""WITH {", ".join(steps)},
o AS (SELECT vec_id, CAST(m[2] AS INTEGER) AS cluster, m[1] AS distance FROM a{ROUNDS} JOIN v USING (r))
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM o JOIN c{ROUNDS} ON k = cluster"""


OP11_SQL = _sql()
