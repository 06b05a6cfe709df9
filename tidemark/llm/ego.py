"""Embedding near-duplicates (op 2) by an epsilon grid order join.

Unit vectors are linked when their cosine reaches ``threshold``, that is, when they lie within
eps = sqrt(2 - 2 threshold). They are sorted by the grid cells (side eps) of their leading principal
components and cut into sequence intervals of ``block_rows`` vectors. Intervals are joined recursively:
pairs of runs of intervals are refined run by run, and a pair whose boxes lie further apart than
eps in the principal components, or whose balls do, is skipped with everything in it. A pair that is
left is compared with one matrix product in double precision; intervals whose balls prove that all their vectors
are linked are counted without one. Pairs of intervals are dealt out in tiles of up to TILE by TILE intervals, so that
an interval is sent once to a tile and not once to each partner. Equal vectors are one point with a weight. Tiles
return numbers of links and a spanning forest, never the pairs. Vectors travel as they came (32-bit numbers stay such).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import components, cut, pick, table

THRESHOLD = 0.95
BLOCK_ROWS = 2048
#: Leading principal components in the grid order and in the boxes.
GRID_DIMS = 4
BOX_DIMS = 16
#: Intervals, or runs of them, that are refined together.
FAN_OUT = 8
#: Intervals on either side of a tile, and the numbers (intervals times dimension) that bound it for long vectors.
TILE, TILE_DIMS = 8, 2048
#: Points that the principal components are fitted on, about; they only decide the order and the boxes.
AXES_SAMPLE = 65_536
AXES_TASKS = 16
_SLACK = 1e-9


def _points(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, DataFrame]:
    """All rows (id, k1, k2), the keys null where the vector links with nothing; and the distinct points (k1, k2, e, w, least, node)."""
    d = pick(vectors, vec_id, embedding).toDF("id", "e")
    if d.schema["e"].dataType != ArrayType(FloatType()):
        d = d.withColumn("e", F.transform("e", lambda x: x.cast("double")))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(~bad, F.lit(False)) & F.exists("e", lambda x: x != 0)
    # -0.0 and 0.0 have one hash
    key = lambda seed: F.when(good, F.xxhash64(F.lit(seed), "e"))
    d = d.select("id", "e", key(1).alias("k1"), key(2).alias("k2"))
    points = d.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.first("e").alias("e"), F.count("*").alias("w"), F.min("id").alias("least"))
    return d.drop("e"), cut(points.withColumn("node", F.monotonically_increasing_id()), "points")


def _unit(raw):
    """Rows of unit length in double precision; scaled by the largest component first, so that squares neither overflow nor vanish."""
    import numpy as np

    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _rows(column, dim: int):
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _principal(points: DataFrame, dim: int, n_axes: int):
    """Mean and leading axes of about AXES_SAMPLE points, the same on every run; AXES_TASKS matrices of (dim + 1) squared numbers reach the driver."""
    import numpy as np

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim + 1, dim + 1))
        for b in batches:
            x = _unit(_rows(b.column("e"), dim))
            x = np.hstack([x, np.ones((len(x), 1))])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["s"])

    every = max(1, points.count() // AXES_SAMPLE)
    some = points.where(F.pmod(F.xxhash64("k1", "k2"), F.lit(every)) == 0).select("e").repartition(AXES_TASKS)
    total = np.zeros((dim + 1, dim + 1))
    for r in some.mapInArrow(moments, "s binary").toLocalIterator():
        total += np.frombuffer(r["s"]).reshape(dim + 1, dim + 1)
    n = max(total[-1, -1], 1.0)
    mean = total[-1, :-1] / n
    cov = total[:-1, :-1] / n - np.outer(mean, mean)
    values, axes = np.linalg.eigh((cov + cov.T) / 2)
    return mean, np.ascontiguousarray(axes[:, np.argsort(-values)[:n_axes]])


def _blocks(points: DataFrame, dim: int, eps: float, block_rows: int) -> DataFrame:
    """Sequence intervals in epsilon grid order: seq, n, matrix, ids, weights, box and ball."""
    import numpy as np

    n_axes = min(BOX_DIMS, dim)
    mean, axes = _principal(points, dim, n_axes)
    k = min(GRID_DIMS, n_axes)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = (_unit(_rows(b.column("e"), dim)) - mean) @ axes[:, :k]
            cols = [pa.array(np.floor(g[:, i] / eps).astype(np.int64)) for i in range(k)]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("w"), b.column("e"), *cols], ["node", "w", "e", *[f"g{i}" for i in range(k)]])

    grid = ", ".join(f"g{i} long" for i in range(k))
    kind = points.schema["e"].dataType.simpleString()
    placed = points.select("node", "w", "e").mapInArrow(cells, f"node long, w long, e {kind}, {grid}")
    placed = placed.orderBy(*[f"g{i}" for i in range(k)], "node")

    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made, waiting = TaskContext.get().partitionId() << 32, 0, []

        def block(t: pa.Table) -> pa.RecordBatch:
            nonlocal made
            raw = _rows(t.column("e").combine_chunks(), dim)
            x = _unit(raw)
            y, c = (x - mean) @ axes, x.mean(0)
            r = float(np.sqrt(((x - c) ** 2).sum(1).max()))
            made += 1
            ids, w = (t.column(n).combine_chunks().to_numpy() for n in ("node", "w"))
            value = [base + made, len(x), np.ascontiguousarray(raw).tobytes(), ids.astype("<i8").tobytes(), w.astype("<i8").tobytes(), y.min(0).tolist(), y.max(0).tolist(), c.tolist(), r]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(value, _ARROW, strict=True)], schema=_ARROW)

        held = 0
        for b in batches:
            waiting.append(b.select(["node", "w", "e"]))
            held += b.num_rows
            if held >= block_rows:
                t = pa.Table.from_batches(waiting)
                full = held - held % block_rows
                for i in range(0, full, block_rows):
                    yield block(t.slice(i, block_rows))
                waiting, held = t.slice(full).to_batches(), held - full
        if held:
            yield block(pa.Table.from_batches(waiting))

    return placed.mapInArrow(intervals, "seq long, n int, x binary, ids binary, w binary, lo array<double>, hi array<double>, c array<double>, r double")


_ARROW = pa.schema([("seq", pa.int64()), ("n", pa.int32()), ("x", pa.binary()), ("ids", pa.binary()), ("w", pa.binary()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("c", pa.list_(pa.float64())), ("r", pa.float64())])


def _apart(eps: float):
    """Squared distance of two boxes against eps, and of two balls."""
    gap = F.aggregate(
        F.zip_with(F.zip_with("a.lo", "b.hi", lambda x, y: x - y), F.zip_with("b.lo", "a.hi", lambda x, y: x - y), lambda p, q: F.greatest(p, q, F.lit(0.0))),
        F.lit(0.0), lambda s, x: s + x * x,
    )
    centres = F.sqrt(F.aggregate(F.zip_with("a.c", "b.c", lambda x, y: x - y), F.lit(0.0), lambda s, x: s + x * x))
    far = (F.sqrt(gap) > eps + _SLACK) | (centres - F.col("a.r") - F.col("b.r") > eps + _SLACK)
    all_near = centres + F.col("a.r") + F.col("b.r") < eps - _SLACK
    return far, all_near


def _pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """Pairs (a, b) of intervals that may hold links, with their numbers in the order (a_up, b_up), found by refining pairs of runs of intervals.

    Level by level, a run is FAN_OUT intervals (or runs) in sequence; runs keep the box and the ball of
    what they hold. The levels are joins of pairs with the children of either side.
    """
    # seq is (partition, number from 1); only numbers of intervals by partition are summed in one task
    part = F.shiftright("seq", 32)
    held = blocks.groupBy(part.alias("part")).agg(F.count("*").alias("k"))
    before = held.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("before"))
    leaf = blocks.select("seq", "lo", "hi", "c", "r").withColumn("part", part).join(before, "part")
    leaf = leaf.select((F.col("before") + F.col("seq").bitwiseAND(F.lit((1 << 32) - 1)) - 1).alias("at"), "seq", "lo", "hi", "c", "r")
    levels = [cut(leaf, "level")]
    while levels[-1].count() > FAN_OUT:
        g = levels[-1].groupBy(F.floor(F.col("at") / FAN_OUT).cast("long").alias("at")).agg(F.sort_array(F.collect_list(F.struct("at", "lo", "hi", "c", "r"))).alias("g"))
        lo = F.aggregate("g", F.element_at("g", 1)["lo"], lambda s, x: F.zip_with(s, x["lo"], lambda p, q: F.least(p, q)))
        hi = F.aggregate("g", F.element_at("g", 1)["hi"], lambda s, x: F.zip_with(s, x["hi"], lambda p, q: F.greatest(p, q)))
        c = F.transform(F.aggregate("g", F.transform(F.element_at("g", 1)["c"], lambda x: x * 0.0), lambda s, x: F.zip_with(s, x["c"], lambda p, q: p + q)), lambda x: x / F.size("g"))
        up = g.withColumn("lo", lo).withColumn("hi", hi).withColumn("c", c)
        dist = lambda x: F.sqrt(F.aggregate(F.zip_with(x["c"], F.col("c"), lambda p, q: p - q), F.lit(0.0), lambda s, v: s + v * v)) + x["r"]
        up = up.withColumn("r", F.array_max(F.transform("g", dist)))
        levels.append(cut(up.select("at", F.col("at").alias("seq"), "lo", "hi", "c", "r"), "level"))
    far, all_near = _apart(eps)

    def side(level: DataFrame, name: str) -> DataFrame:
        return level.select(F.floor(F.col("at") / FAN_OUT).cast("long").alias(f"{name}_up"), F.struct("at", "seq", "lo", "hi", "c", "r").alias(name))

    above = levels[0].sparkSession.createDataFrame([(0, 0)], "a_up long, b_up long")
    for level in reversed(levels):
        joined = above.join(side(level, "a"), "a_up").join(side(level, "b"), "b_up").where(F.col("a.at") <= F.col("b.at")).where(~far)
        found = joined.select(F.col("a.at").alias("a_up"), F.col("b.at").alias("b_up"), F.col("a.seq").alias("a"), F.col("b.seq").alias("b"), all_near.alias("all_near"))
        above = cut(found, "pairs").select("a_up", "b_up") if level is not levels[0] else cut(found, "pairs")
    return above


def _forest(m):
    """Spanning links (row, column) of the bipartite graph whose links are the true entries of ``m``."""
    import numpy as np

    rows_left, seen = m.any(1), np.zeros(m.shape[1], bool)
    out: list[tuple] = []
    while rows_left.any():
        front = np.array([int(rows_left.argmax())])
        rows_left[front] = False
        while len(front):
            sub = m[front] & ~seen
            cols = np.flatnonzero(sub.any(0))
            if not len(cols):
                break
            out.append((front[sub[:, cols].argmax(0)], cols))
            seen[cols] = True
            sub = m[:, cols] & rows_left[:, None]
            front = np.flatnonzero(sub.any(1))
            out.append((front, cols[sub[front].argmax(1)]))
            rows_left[front] = False
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


_FOUND = pa.schema([("kind", pa.int32()), ("u", pa.int64()), ("v", pa.int64())])


def _compare(pairs: DataFrame, blocks: DataFrame, threshold: float, dim: int, number: str) -> DataFrame:
    """For the pairs that are left: (0, node, number of linked vectors) and (1, node, node) for spanning links.

    A group is a tile of pairs with the intervals that they name, so its size is bounded whatever the data.
    """
    import numpy as np

    tile = max(1, min(TILE, TILE_DIMS // dim))
    place = lambda c: F.floor(F.col(c) / tile).cast("long")
    dealt = cut(pairs.select(place("a_up").alias("p"), place("b_up").alias("q"), "a", "b", "all_near"), "dealt")
    needed = dealt.select("p", "q", F.explode(F.array("a", "b")).alias("seq")).distinct().join(blocks.select("seq", "x", "ids", "w"), "seq")
    rows = needed.select("p", "q", "seq", "x", "ids", "w", F.lit(None).cast("long").alias("b"), F.lit(None).cast("boolean").alias("all_near"))
    none = lambda c: F.lit(None).cast("binary").alias(c)
    rows = rows.unionByName(dealt.select("p", "q", F.col("a").alias("seq"), none("x"), none("ids"), none("w"), "b", "all_near"))

    def compare(t: pa.Table) -> pa.Table:
        held, todo = {}, []
        for r in t.select(["seq", "x", "ids", "w", "b", "all_near"]).to_pylist():
            if r["b"] is None:
                held[r["seq"]] = (r["x"], np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["w"], "<i8"))
            else:
                todo.append((r["seq"], r["b"], r["all_near"]))
        out: list[tuple] = []

        def add(kind: int, u, v) -> None:
            out.append((np.full(len(u), kind, np.int32), u, v))

        now, xa = None, None
        for a, b, all_near in sorted(todo):
            (raw_a, ia, wa), (raw_b, ib, wb) = held[a], held[b]
            if all_near:
                na, nb = np.full(len(ia), wb.sum()), np.full(len(ib), wa.sum())
                ru, rv = np.concatenate([ia, np.full(len(ib), ia[0])]), np.concatenate([np.full(len(ia), ib[0]), ib])
            else:
                if now != a:
                    now, xa = a, _unit(np.frombuffer(raw_a, number).reshape(-1, dim))
                m = xa @ _unit(np.frombuffer(raw_b, number).reshape(-1, dim)).T >= threshold
                if a == b:
                    np.fill_diagonal(m, True)
                na, nb = m @ wb, wa @ m
                i, j = _forest(m)
                ru, rv = ia[i], ib[j]
            if a == b:
                na = na - wa
            else:
                add(0, ib[nb > 0], nb[nb > 0])
            add(0, ia[na > 0], na[na > 0])
            add(1, ru[ru != rv], rv[ru != rv])
        return pa.table([np.concatenate([o[k] for o in out]) for k in range(3)], schema=_FOUND)

    return rows.groupBy("p", "q").applyInArrow(compare, "kind int, u long, v long")


def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
    components of their own; vectors of different lengths aren't compared. A null vec_id
    stays null and names a component only if nothing else can. Equal vectors link with
    each other; repeated rows count as vectors of their own. Other columns are ignored, whatever their names; an empty table
    gives no rows. Vectors are told apart by 128 bits of hash.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold lies between 0 and 1")
    eps = (2 - 2 * threshold) ** 0.5
    spark = vectors.sparkSession
    all_rows, points = _points(vectors, vec_id, embedding)
    found = spark.createDataFrame([], "kind int, u long, v long")
    number = "<f4" if points.schema["e"].dataType == ArrayType(FloatType()) else "<f8"
    for (dim,) in sorted(points.select(F.size("e")).distinct().collect()):
        part = points.where(F.size("e") == dim)
        blocks = cut(_blocks(part, dim, eps, block_rows), "blocks")
        found = found.unionByName(cut(_compare(_pairs(blocks, eps), blocks, threshold, dim, number), "links"))
    n = found.where("kind = 0").groupBy(F.col("u").alias("node")).agg(F.sum("v").alias("links"))
    comp = components(found.where("kind = 1").select("u", "v"))
    held = points.select("k1", "k2", "node", "w", "least").join(n, "node", "left").join(comp, "node", "left")
    held = cut(held.select("k1", "k2", "least", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "held")
    roots = held.groupBy("component").agg(F.min("least").alias("component_id"))
    by_point = held.join(roots, "component").select("k1", "k2", "n_links", "component_id")
    out = all_rows.join(by_point, ["k1", "k2"], "left")
    own = F.when(F.col("k1").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))


def op2_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v AS a JOIN v AS b
  ON a.vec_id <> b.vec_id AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.95 ELSE false END),
reach AS (
  SELECT vec_id AS node, vec_id AS label FROM embeddings UNION
  SELECT links.v, reach.label FROM reach JOIN links ON links.u = reach.node WHERE reach.label < links.v),
c AS (SELECT node, min(label) AS component_id FROM reach GROUP BY node),
n AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings AS e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.u = e.vec_id
"""
