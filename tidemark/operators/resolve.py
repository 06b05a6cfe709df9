"""Entity resolution: domains, then similar names, then components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.url import canonical_domain
from .graph import components, cut
from .names import indel_ratio, name_pairs

__all__ = ["claimed_domain", "entity_clusters", "indel_ratio", "name_pairs", "resolve", "vector_neighbors", "within_two_edits"]


def claimed_domain(candidates: DataFrame) -> DataFrame:
    """Each candidate's domain: the claimed one if it is a company's, else its URL's, else null (dropped)."""
    return candidates.withColumn("resolved_domain", F.coalesce(canonical_domain(F.col("claimed")), canonical_domain(F.col("url"))))


def resolve(candidates: DataFrame) -> DataFrame:
    """Candidates (id, claimed, url, name, country, created_at) to one row per company: the earliest name, gaps filled by the first that has a value."""
    c = claimed_domain(candidates).where("resolved_domain IS NOT NULL")
    order = F.struct("created_at", "id")
    by = lambda col: F.min_by(F.col(col), F.when(F.col(col).isNotNull() & (F.col(col) != ""), order))
    return c.groupBy("resolved_domain").agg(by("name").alias("display_name"), by("country").alias("country"), F.count("*").alias("candidates"),
        F.min("created_at").alias("first_seen_at"))


def within_two_edits(names: DataFrame) -> DataFrame:
    """Pairs (a, b, distance), a < b, of the distinct ``names`` (n) that two insertions, deletions or replacements part at most.

    Such names have a common form that each reaches by leaving out at most two characters: the join is on these forms, and loses no pair.
    """
    once = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.overlay(c, F.lit(""), i, F.lit(1)))
    n = names.select("n").where("n IS NOT NULL").distinct().withColumn("d", once(F.col("n")))
    forms = n.select("n", F.explode(F.array_distinct(F.concat(F.array("n"), "d", F.flatten(F.transform("d", once))))).alias("form"))
    a, b = forms.toDF("a", "form"), forms.toDF("b", "form")
    pairs = a.join(b, "form").where("a < b").select("a", "b").distinct()
    return pairs.withColumn("distance", F.levenshtein("a", "b")).where("distance <= 2")


def entity_clusters(candidates: DataFrame, threshold: float = 92.0) -> DataFrame:
    """Each company of ``candidates`` (as for ``resolve``; id: long): resolved_domain, id of its earliest row, and entity_id,
    the earliest (created_at, id) among the companies that similar names link with it, also by way of others."""
    c = claimed_domain(candidates).where("resolved_domain IS NOT NULL")
    order = F.struct("created_at", "id")
    by = lambda col: F.min_by(F.col(col), F.when(F.col(col).isNotNull() & (F.col(col) != ""), order))
    own = c.groupBy("resolved_domain").agg(F.min(order).alias("o"), by("name").alias("name"), by("country").alias("country"))
    # domains are read from addresses once, and not for each of the joins below
    own = cut(own.select("resolved_domain", "o", F.col("o.id").alias("id"), "name", "country"), "companies")
    comp = components(name_pairs(own, threshold).select(F.col("a_id").alias("u"), F.col("b_id").alias("v")))
    held = own.join(comp, F.col("id") == F.col("node"), "left").select("resolved_domain", "o", "id", F.coalesce("component", "id").alias("c"))
    first = held.groupBy("c").agg(F.min("o").alias("r"))
    return held.join(first, "c").select("resolved_domain", "id", F.col("r.id").alias("entity_id"))


def _vector_blocks(vectors: DataFrame, rows: int) -> DataFrame:
    """Vectors (id, embedding) as matrices of unit rows: (ids, x) in binary, at most ``rows`` a block."""
    names = vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                kept = [(i, v) for i, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if v and None not in v]
                for dim in sorted({len(v) for _, v in kept}):
                    own = [(i, v) for i, v in kept if len(v) == dim]
                    x = np.array([v for _, v in own], "f8")
                    n = np.linalg.norm(x, axis=1)
                    good = np.isfinite(n) & (n > 0)
                    ids = np.array([i for i, _ in own], "i8")[good]
                    x = x[good] / n[good, None]
                    yield pa.RecordBatch.from_arrays([pa.array([dim]), pa.array([ids.tobytes()]), pa.array([x.tobytes()])], ["dim", "ids", "x"])

    return vectors.select(*names).mapInArrow(run, "dim long, ids binary, x binary")


#: Blocks on either side of one cell of the grid.
CELL = 8


def vector_neighbors(queries: DataFrame, vectors: DataFrame, threshold: float = 0.88, rows: int = 1024) -> DataFrame:
    """(a, b, cosine) of a stated query set against all vectors, block by block: one matrix product for each pair of blocks.

    Blocks are dealt out over a grid of cells of some CELL by CELL blocks, so that no task meets more than those, and each
    block is sent once to a row (or a column) of cells.
    """
    sides = [max(1, -(-d.count() // (CELL * rows))) for d in (queries, vectors)]
    place = lambda own: F.pmod(F.monotonically_increasing_id(), F.lit(own)).cast("int")
    every = lambda other: F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
    q = _vector_blocks(queries, rows).toDF("dim", "qi", "qx").withColumn("i", place(sides[0])).withColumn("j", every(sides[1]))
    v = _vector_blocks(vectors, rows).withColumn("j", place(sides[1])).withColumn("i", every(sides[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                dim, qi, qx, vi, vx = (b.column(n)[r].as_py() for n in ("dim", "qi", "qx", "ids", "x"))
                qi, vi = np.frombuffer(qi, "i8"), np.frombuffer(vi, "i8")
                m = np.frombuffer(qx, "f8").reshape(-1, dim) @ np.frombuffer(vx, "f8").reshape(-1, dim).T
                i, j = np.nonzero(m >= threshold)
                yield pa.RecordBatch.from_arrays([pa.array(qi[i]), pa.array(vi[j]), pa.array(m[i, j])], ["a", "b", "cosine"])

    return v.join(q, ["dim", "i", "j"]).mapInArrow(run, "a long, b long, cosine double").where("a <> b")
