"""Quality classifier (op 7): nearest-neighbour voting in a latent-semantic space.

Terms of a text are its words, the words' shapes, pairs of neighbouring shapes and repetitions of the
previous word, hashed into DIMS counts. A bounded sample of labelled texts gives the term weights and
a truncated singular value decomposition. The sample's latent vectors are broadcast (SAMPLE
x LATENT numbers, whatever the input) and every document is compared with all of them, block by block, in double
precision. Its K nearest labels, and all that tie with the last of them, vote with the POWER-th power of their cosine
similarity (none below zero) as weight.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import MEMORIES, only_memory, pick, table, word_parts

#: Labelled texts that the classifier learns from, half of them of either label where there are enough.
SAMPLE = 4096
LATENT = 64
DIMS = 4096
K = 15
POWER = 4
#: Similarities that differ by less are a tie, so that rounding decides none.
TIE = 1e-9
THRESHOLD = 0.3
#: Documents compared in one matrix product.
BLOCK = 256
#: Characters of a very long text that are counted at once.
PART_CHARS = 4_000_000
#: Words whose terms one Python worker remembers.
MEMORY_WORDS = 300_000

_SHAPES, _PAIRS = 1024, 1024
_REPEAT = DIMS - 1


class _Terms(dict):
    """word -> 31-bit hash of the word << 10 | hash of its shape."""

    def __missing__(self, word: str) -> int:
        shape, last = [], ""
        for c in word:
            s = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
            if s != last:
                shape.append(s)
                last = s
        low = word.lower().encode("utf-8", "surrogatepass")
        found = (zlib.crc32(low) & 0x7FFFFFFF) << 10 | zlib.crc32("".join(shape).encode("utf-8", "surrogatepass")) % _SHAPES
        if len(self) >= MEMORY_WORDS:
            self.clear()
        self[word] = found
        return found


_terms = _Terms()
MEMORIES["quality"] = _terms.clear


def term_counts(texts: list[str]):
    """Counts (len(texts), DIMS) as float32, and the numbers of words."""
    import numpy as np

    out, sizes = np.zeros((len(texts), DIMS), np.float32), np.zeros(len(texts), np.int64)
    for row, text in enumerate(texts):
        before: list[str] = []
        for words in word_parts(text, PART_CHARS):
            if not words:
                continue
            part = before + words  # the word before a part counts in pairs only
            sizes[row] += len(words)
            codes = np.fromiter(map(_terms.__getitem__, part), np.int64, len(part))
            shapes = codes & (_SHAPES - 1)
            own = codes[len(before) :]
            terms = np.concatenate([own & (_SHAPES - 1), _SHAPES + (shapes[:-1] * 31 + shapes[1:]) % _PAIRS, _SHAPES + _PAIRS + (own >> 10) % (DIMS - _SHAPES - _PAIRS - 1)])
            counts = np.bincount(terms, minlength=DIMS).astype(np.float32)
            counts[_REPEAT] = np.count_nonzero(codes[1:] == codes[:-1])
            out[row] += counts
            before = words[-1:]
    return out, sizes


@dataclass
class Model:
    """Term weights, projection, and the labelled latent vectors (rows of unit length)."""

    weights: object
    projection: object
    vectors: object
    labels: object
    prior: float

    def latent(self, counts, sizes):
        import numpy as np

        x = np.sqrt(counts / np.maximum(sizes, 1)[:, None].astype(np.float32)) * self.weights
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        z = x @ self.projection
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[str]):
        """One score a text, in blocks of BLOCK documents."""
        import numpy as np

        out = np.full(len(texts), self.prior)
        if not len(self.labels):
            return out
        k = min(K, len(self.labels))
        known, labels = self.vectors.astype(np.float64).T, self.labels
        for a in range(0, len(texts), BLOCK):
            counts, sizes = term_counts(texts[a : a + BLOCK])
            sims = self.latent(counts, sizes).astype(np.float64) @ known
            least = np.partition(sims, -k, axis=1)[:, -k, None]
            row, col = np.nonzero(sims >= least - TIE)
            w = np.maximum(sims[row, col], 0) ** POWER
            total, votes = (np.bincount(row, x, len(sizes)) for x in (w, w * labels[col]))
            empty = (sizes == 0) | (total <= 1e-12)
            out[a : a + BLOCK] = np.where(empty, self.prior, np.clip(votes / np.maximum(total, 1e-12), 0, 1))
        return out


def fit_counts(counts, sizes, labels, prior: float) -> Model:
    """Term weights and the truncated decomposition of the weighted counts."""
    import numpy as np

    labels = np.asarray(labels, np.float64)
    n = len(labels)
    if not n:
        return Model(np.ones(DIMS, np.float32), np.zeros((DIMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, prior)
    weights = (np.log((1 + n) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    model = Model(weights, None, None, labels, prior)
    x = np.sqrt(counts / np.maximum(sizes, 1)[:, None].astype(np.float32)) * weights
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rank = min(LATENT, n, DIMS)
    basis = np.random.default_rng(0).standard_normal((DIMS, min(rank + 16, n, DIMS))).astype(np.float32)
    for _ in range(6):  # subspace iteration: the leading right singular vectors of x
        basis, _r = np.linalg.qr(x.T @ (x @ basis))
    _u, _s, turn = np.linalg.svd(x @ basis, full_matrices=False)
    top = (basis @ turn.T)[:, :rank]
    model.projection = np.ascontiguousarray(top, np.float32)
    model.vectors = model.latent(counts, sizes)
    return model


def _held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled rows of ``docs`` outside the held-out fifth.

    Rows with a null doc_id, quality or text are not learnt from; a document with both labels counts for
    neither; where a doc_id repeats in ``docs``, one of its texts is learnt from, the one with the smallest term counts. The
    sample is the smallest hashes of either label (ties: the smallest doc_id), so it is the same on every run.
    """
    import numpy as np

    spark = docs.sparkSession
    known = pick(labels, "doc_id", "quality").where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).where("q = q2").select("doc_id", "q")
    share = known.agg(F.avg("q")).first()[0]
    rank = F.xxhash64("doc_id")
    some = [r for q in (0, 1) for r in known.where(F.col("q") == q).orderBy(rank, "doc_id").limit(sample).select("doc_id", "q").collect()]
    zeros, ones = [r for r in some if r["q"] == 0], [r for r in some if r["q"] == 1]
    n0 = min(len(zeros), max(sample // 2, sample - len(ones)))
    chosen = zeros[:n0] + ones[: sample - n0]
    ids = spark.createDataFrame([(r["doc_id"], r["q"]) for r in chosen], known.schema)
    d = pick(docs, "doc_id", "text").where("text IS NOT NULL").join(F.broadcast(ids), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_memory("quality")
        for b in batches:
            for a in range(0, b.num_rows, BLOCK):
                part = b.slice(a, BLOCK)
                counts, sizes = term_counts(part.column("text").to_pylist())
                at = [np.flatnonzero(c) for c in counts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("q").cast(pa.int32()), pa.array(sizes), pa.array([i.astype("<i4").tobytes() for i in at], pa.binary()), pa.array([c[i].astype("<f4").tobytes() for c, i in zip(counts, at, strict=True)], pa.binary())],
                    ["doc_id", "q", "n", "at", "c"],
                )

    kind = d.schema["doc_id"].dataType.simpleString()
    found = d.select("doc_id", "q", "text").mapInArrow(count, f"doc_id {kind}, q int, n long, at binary, c binary")
    # the smallest of the counts where a doc_id repeats, found where it is read: one row a sampled doc_id reaches the driver
    least = found.groupBy("doc_id").agg(F.min(F.struct("n", "at", "c", "q")).alias("r"))
    rows = [((r["n"], bytes(r["at"]), bytes(r["c"])), r["q"]) for r in sorted(least.select("doc_id", "r.*").collect(), key=lambda r: r["doc_id"])]
    counts = np.zeros((len(rows), DIMS), np.float32)
    for i, ((_, at, c), _q) in enumerate(rows):
        counts[i, np.frombuffer(at, "<i4")] = np.frombuffer(c, "<f4")
    return fit_counts(counts, np.array([r[0][0] for r in rows]), [r[1] for r in rows], 0.5 if share is None else float(share))


def with_score(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs``, all columns as they are, with the score of each row's text as a last column."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = f"c{names.index(text)}"
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_memory("quality")
        m = sent.value
        for b in batches:
            s = m.score([t or "" for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, "score"])

    return plain.mapInArrow(run, StructType([*plain.schema.fields, StructField("score", DoubleType())])).toDF(*names, score)


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    Texts that are null, empty or hold no word get the labels' mean; without labels that is
    0.5. A null doc_id is not held out and stays null. Repeated rows are scored each; a very long text is counted in
    parts; neighbours at equal distances all vote; other columns are never read, whatever their names; an empty
    table gives no rows.
    """
    model = fit(docs, labels, sample)
    d = pick(docs, "doc_id", "text")
    plain = d.select("doc_id", "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_memory("quality")
        m = sent.value
        for b in batches:
            s = m.score([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    out = plain.mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", F.coalesce(_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns as they are, whatever their names.

    Cases are those of ``quality_scores``: empty texts go by the labels' mean, repeated rows stay or go together, and
    without any label all rows stay.
    """
    names = docs.columns
    scored = with_score(docs, fit(docs, labels, sample)).toDF(*[f"c{i}" for i in range(len(names) + 1)])
    return scored.where(F.col(f"c{len(names)}") >= threshold).drop(f"c{len(names)}").toDF(*names)


def op7_neighbour_voting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
