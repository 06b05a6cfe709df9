"""Vector code compression (op 13): product codes whose entries are found by partial-distance search.

A vector of whole numbers is cut into PARTS consecutive parts; each part position has a codebook of ENTRIES entries, learnt
in Lloyd's rounds. The nearest entry is searched dimension by dimension, those in which the codebook varies most first: an
entry's distance to a block of parts grows with each dimension, and a mask drops every part for which it
strictly exceeds the best complete distance that the part has so far. What is dropped can't be nearest, nor tie, so the result
is that of the whole search, in integers of any size.

Vectors lie in blocks in the shared folder. A round maps blocks to counts and sums by part and entry, combined by treeAggregate;
the driver holds codebooks alone. Of the results only (label, sum of errors) is grouped, with partial sums, so that a label may
hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .clusters import DEPTH, as_array, digest
from .common import cut, only_memory, table
from .vectors import LONG_SAFE, blocks, by_length, first, kept, matrix, most, rows_of, whole

PARTS, ENTRIES, ROUNDS, FACTOR = 8, 16, 6, 4096


def bounds(dims: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Where each part begins and ends; where ``parts`` doesn't divide ``dims``, the first parts are one longer."""
    low, more = divmod(dims, parts)
    at = [0]
    for i in range(parts):
        at.append(at[-1] + low + (i < more))
    return list(zip(at, at[1:], strict=False))


def variance_order(book) -> list[int]:
    """The dimensions of a codebook in descending variance, exactly (ties: the lower one first)."""
    k = len(book)
    spread = [k * sum(int(v) ** 2 for v in col) - sum(map(int, col)) ** 2 for col in book.T.tolist()]
    return sorted(range(len(spread)), key=lambda d: (-spread[d], d))


def nearest(x, book, order: list[int] | None = None, seen: list[int] | None = None):
    """The nearest entry of ``book`` for each row of x (ties: the lower index) and its squared distance, by partial distances.
    ``seen`` gets the number of single dimensions that were added up."""
    import numpy as np

    n, dims = x.shape
    order = variance_order(book) if order is None else order
    if dims * (most(x) + most(book)) ** 2 >= LONG_SAFE:
        x, book = x.astype(object), book.astype(object)
    cols = [np.ascontiguousarray(x[:, d]) for d in order]
    entries = book[:, order]
    # the entry that is nearest in the first dimension is likely to be near: its distance is the first to beat
    at = np.zeros(n, np.int64)
    if dims and x.dtype != object:
        values = np.sort(entries[:, 0])
        by_value = np.argsort(entries[:, 0], kind="stable")
        hi = np.searchsorted(values, cols[0]).clip(0, len(values) - 1)
        lo = np.maximum(hi - 1, 0)
        at = by_value[np.where(cols[0] - values[lo] <= values[hi] - cols[0], lo, hi)]
    best = sum(((c - entries[at, d]) ** 2 for d, c in enumerate(cols)), np.zeros(n, x.dtype))
    if seen is not None:
        seen.append(n * dims)
    tried = at.copy()
    for k in range(len(book)):
        rows = np.flatnonzero(tried != k)
        so_far = np.zeros(len(rows), x.dtype)
        for d, c in enumerate(cols):
            if not len(rows):
                break
            so_far += (c[rows] - entries[k, d]) ** 2
            if seen is not None:
                seen.append(len(rows))
            alive = so_far <= best[rows]
            if not alive.all():
                rows, so_far = rows[alive], so_far[alive]
        better = (so_far < best[rows]) | (k < at[rows])  # what is left has the best distance at most
        best[rows[better]], at[rows[better]] = so_far[better], k
    return at, best


def _gathered(data, books: dict, factor: int):
    """Over all blocks: {dims: (counts by part and entry, sums by part of the entries' parts)}."""
    import numpy as np

    sent = data.context.broadcast({n: [(a, b, book, variance_order(book)) for (a, b), book in zip(bounds(n, len(own)), own, strict=True)] for n, own in books.items()})

    def one(state: dict, block) -> dict:
        dims, raw = block
        x = whole(matrix(dims, raw), factor)
        counts, sums = [], []
        for a, b, book, order in sent.value[dims]:
            part = x[:, a:b]
            at, _ = nearest(part, book, order)
            if part.dtype != object and len(part) * most(part) >= LONG_SAFE:
                part = part.astype(object)
            total = np.zeros(book.shape, object)
            for i in np.unique(at).tolist():
                total[i] = part[at == i].sum(0)
            counts.append(np.bincount(at, minlength=len(book)).astype(object))
            sums.append(total)
        return add(state, {dims: (counts, sums)})

    def add(a: dict, b: dict) -> dict:
        out = dict(a)
        for dims, (counts, sums) in b.items():
            if dims in out:
                counts, sums = ([x + y for x, y in zip(*pair, strict=True)] for pair in ((out[dims][0], counts), (out[dims][1], sums)))
            out[dims] = (counts, sums)
        return out

    found = data.treeAggregate({}, one, add, DEPTH)
    sent.destroy()
    return found


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, factor: int = FACTOR) -> dict[int, list]:
    """The codebooks by length of vector: for each part position an array (entries, dimensions of the part)."""
    import numpy as np

    lengths = [r["n"] for r in vectors.select(F.size("x").alias("n")).distinct().collect()]
    books = {}
    for n in sorted(lengths):
        rows = first(vectors.where(F.size("x") == n), entries, F.col("vec_id"))
        start = whole(np.array(rows, np.float64).reshape(len(rows), n), factor)
        books[n] = [as_array(start[:, a:b].tolist()).reshape(len(start), b - a) for a, b in bounds(n, parts)]
    if not books:
        return books
    data = blocks(vectors).rdd.map(lambda r: (r["dims"], bytes(r["x"])))
    for _ in range(rounds):
        found = _gathered(data, books, factor)
        for n, own in books.items():
            for i, (book, counts, sums) in enumerate(zip(own, *found[n], strict=True)):
                rows = [[int(t) // m for t in total] if m else old for m, total, old in zip(counts.tolist(), sums.tolist(), book.tolist(), strict=True)]
                own[i] = as_array(rows).reshape(book.shape)
    return books


def codes(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, factor: int = FACTOR) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every vector of ``embeddings`` (vec_id, embedding, label) that isn't null
    and has no component that is null or not finite. Others give no row.

    Codebooks start as the vectors with the ``entries`` smallest vec_ids (null last; ties: the least vector); fewer vectors give
    fewer entries, no vectors no rows. Equal distances go to the lower index. Vectors of different lengths have codebooks of their
    own (lengths are few: each is a pass over the table), and where ``parts`` doesn't divide a length the first parts are one longer; an empty vector has code 0
    throughout. Repeated rows are vectors of their own; null labels are one label; other columns play no part, whatever
    their names. Components of any finite size count exactly; an error that a long can't hold is an error.
    """
    import numpy as np

    if not 1 <= entries <= 256:
        raise ValueError("an entry's index has two hex digits")
    spark = embeddings.sparkSession
    v = kept(embeddings, "label")
    books = fit(v, parts, entries, rounds, factor)
    hashes = {n: digest(int(x) for book in own for row in book.tolist() for x in row) for n, own in books.items()}
    kinds = [v.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    sent = spark.sparkContext.broadcast((books, hashes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_memory("codes")
        books, hashes = sent.value
        ordered = {n: [(a, b, book, variance_order(book)) for (a, b), book in zip(bounds(n, len(own)), own, strict=True)] for n, own in books.items()}
        for batch in batches:
            for n, b in by_length(batch, "x"):
                x = whole(rows_of(b.column("x")), factor)
                code, error = np.zeros((len(x), len(ordered[n])), np.uint8), np.zeros(len(x), object)
                for i, (a, e, book, order) in enumerate(ordered[n]):
                    at, d = nearest(x[:, a:e], book, order)
                    code[:, i] = at
                    error += d.astype(object)
                named = [row.tobytes().hex() for row in code]
                cols = [pa.array(named, pa.string()), pa.array(error.tolist(), pa.int64()), pa.array([hashes[n]] * len(x), pa.string())]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), *cols], ["vec_id", "label", "code", "error", "codebooks_sha256"])

    coded = cut(v.mapInArrow(run, f"vec_id {kinds[0]}, label {kinds[1]}, code string, error long, codebooks_sha256 string"), "coded")
    # a written table: where the labels are few, its size makes it a broadcast; else both sides are shuffled, and a hot label is split
    sums = cut(coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")), "label_errors")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_partial_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """The same by plain joins of all parts with all entries, for vectors of one length that PARTS divides."""
    steps = [
        """v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))""",
        "p AS MATERIALIZED (SELECT r, i, x[i * len(x) // 8 + 1 : (i + 1) * len(x) // 8] AS y FROM v CROSS JOIN range(8) AS t(i))",
        """c0 AS MATERIALIZED (
  SELECT i, k, y AS c FROM (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS k FROM v QUALIFY k < 16) JOIN p USING (r))""",
    ]
    for n in range(ROUNDS + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT r, i, min(ROW(d, k)) AS m FROM (
    SELECT r, p.i, k, CAST(list_sum(list_transform(list_zip(y, c), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) AS BIGINT) AS d FROM p JOIN c{n} ON p.i = c{n}.i) GROUP BY r, i)""")
        if n < ROUNDS:
            steps.append(f"""s{n} AS (
  SELECT i, m[2] AS k, j, CAST(sum(y[j]) AS BIGINT) AS s, count(*) AS n FROM a{n} JOIN p USING (r, i) CROSS JOIN range(1, 9) AS t(j) GROUP BY ALL)""")
            steps.append(f"""c{n + 1} AS MATERIALIZED (
  SELECT i, k, coalesce(l, c) AS c FROM c{n} LEFT JOIN (SELECT i, k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS l FROM s{n} GROUP BY i, k) USING (i, k))""")
    return f"""WITH {", ".join(steps)},
o AS (SELECT r, string_agg(printf('%02x', m[2]), '' ORDER BY i) AS code, CAST(sum(m[1]) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY i, k)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN v USING (r) CROSS JOIN h"""


OP13_SQL = _sql()
