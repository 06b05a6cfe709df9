"""What the operators that learn centroids share: which vectors count, blocks of them, and exact whole numbers.

A component x counts as floor(factor * x), a whole number of any size: as 64-bit integers where all of a block's lie within
LONG_SAFE, else as Python's own, so that no result depends on the size of a value.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pick

#: Vectors of one block, and bytes of one at most (a vector of more components is a block of its own).
BLOCK, BLOCK_BYTES = 4096, 4 << 20
#: Whole numbers up to this are exact in a double, and in a long.
DOUBLE_SAFE, LONG_SAFE = 1 << 53, 1 << 62


def kept(embeddings: DataFrame, *more: str) -> DataFrame:
    """vec_id, x (array of doubles) and the columns ``more`` of the rows whose vector is not null and has no component that is null
    or not finite."""
    d = pick(embeddings, "vec_id", "embedding", *more)
    x = F.col("embedding").cast("array<double>")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return d.select("vec_id", x.alias("x"), *more).where(F.col("x").isNotNull() & F.forall("x", finite))


def first(vectors: DataFrame, n: int, *order: Column) -> list[list[float]]:
    """The ``n`` first vectors of the order (of equal places the least vector): a bounded number, whatever the input."""
    return [list(r["x"]) for r in vectors.orderBy(*[c.asc_nulls_last() for c in order], "x").limit(n).select("x").collect()]


def whole(x, factor: int):
    """floor(factor * x) of an array of doubles, exactly: int64 where it is within LONG_SAFE, else Python integers.
    ``factor`` is a power of two, so that the product is exact unless it overflows."""
    import numpy as np

    with np.errstate(over="ignore"):
        y = np.floor(x * float(factor))
    if not y.size or float(np.abs(y).max()) < LONG_SAFE:
        return y.astype(np.int64)
    exact = [floor(v) * factor if abs(v) >= 2.0**53 else floor(v * factor) for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def most(x) -> int:
    """The largest magnitude in an array of whole numbers, as a Python integer."""
    import numpy as np

    return int(np.abs(x).max()) if x.size else 0


def rows_of(column: pa.Array):
    """An Arrow column of equally long lists of doubles as a matrix."""
    import numpy as np

    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(n, len(flat) // n if n else 0)


def by_length(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch by the length of their vectors, in blocks: (length, rows)."""
    import pyarrow.compute as pc

    lengths = pc.list_value_length(batch.column(name))
    for n in sorted(pc.unique(lengths).to_pylist()):
        same = batch.filter(pc.equal(lengths, n))
        step = max(1, min(BLOCK, BLOCK_BYTES // (8 * n + 1)))
        for a in range(0, same.num_rows, step):
            yield n, same.slice(a, step)


def blocks(vectors: DataFrame) -> DataFrame:
    """The column x of ``vectors`` as blocks (dims, x: doubles in binary), written to the shared folder: what every round reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, part in by_length(b, "x"):
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([rows_of(part.column("x")).astype("<f8").tobytes()], pa.binary())], ["dims", "x"])

    return cut(vectors.select("x").mapInArrow(run, "dims int, x binary"), "blocks")


def matrix(dims: int, raw: bytes):
    import numpy as np

    return np.frombuffer(raw, "<f8").reshape(-1, dims) if dims else np.zeros((1, 0))
