"""Best-fit packing (op 4): bounded-space online best-fit.

Each task packs the pieces of its documents as they stream by, batch by batch; the pieces of one Arrow batch are placed longest
first, so that the packing is online from batch to batch and not from row to row. A fixed number of bins is open, in a bit
set keyed by free space: the lowest bit at or above a piece's length is the bin that it fits best; when
all bins are open and none fits, the fullest closes. What the tasks leave partly filled
is packed once more, whole bins at a time, by the same rule.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, only_memory, pick, table
from .tokens import byte_encoder, vocabulary_path

CAPACITY = 2048
#: Bins that are open at once in a task: its memory, whatever the input.
OPEN_BINS = 4096
#: Partly filled bins that one task of the second round packs.
BINS_A_TASK = 50_000


class BestFit:
    """Open bins keyed by free space; ``place`` returns (bin, offset)."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits, self.open, self.made = 0, 0, 0
        self.closed: list[tuple[int, int]] = []  # (bin, filled) of bins that closed before they were full

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.open -= 1
        return found

    def place(self, size: int) -> tuple[int, int]:
        above = self.bits >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            at = self._take(free)
        else:
            if self.open == self.limit:
                least = (self.bits & -self.bits).bit_length() - 1
                self.closed.append((self._take(least), self.capacity - least))
            at, free = self.made, self.capacity
            self.made += 1
        left = free - size
        if left:
            if not self.by_free[left]:
                self.bits |= 1 << left
            self.by_free[left].append(at)
            self.open += 1
        return at, self.capacity - free

    def partly(self) -> list[tuple[int, int]]:
        return self.closed + [(b, self.capacity - f) for f, bins in enumerate(self.by_free) for b in bins]


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of ``n`` ids: the first may be shorter, the others are full."""
    if n <= capacity:
        return [n]
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


_ROW = "doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, filled long"


def pack(docs: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = 0, vocabulary: str = "byte_bpe_50k", path: Callable[[str], str] = vocabulary_path) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone. Only documents
    longer than ``capacity`` are cut. Repeated rows are packed each. doc_id may be null or repeat;
    other columns are ignored, whatever their names; an empty table gives no rows; a very long text is encoded in parts; pieces
    of equal length are placed in the order of their rows. Texts are encoded once, where they are read,
    and never shuffled; only the pieces' numbers are written and joined.
    """
    d = pick(docs, "doc_id", "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    end = end_id.to_bytes(4, "little")

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        only_memory("tokens")
        encoder, bins = byte_encoder(vocabulary, path), BestFit(capacity, open_bins)
        base = TaskContext.get().partitionId() << 32
        id_type = None
        for b in batches:
            id_type = b.schema.field("doc_id").type
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            pieces = []
            for doc_id, text in zip(ids, texts, strict=True):
                coded = (encoder.encode(text) if text else b"") + end
                start = 0
                for k, n in enumerate(cut_lengths(len(coded) // 4, capacity)):
                    pieces.append((n, doc_id, k, start, zlib.crc32(coded[4 * start : 4 * (start + n)])))
                    start += n
            pieces.sort(key=lambda p: -p[0])  # stable: a batch's order is that of its rows
            out = [(doc_id, k, start, n, crc, *bins.place(n)) for n, doc_id, k, start, crc in pieces]
            cols = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], id_type), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5]), pa.array([base + x for x in cols[5]], pa.int64()), pa.array(cols[6], pa.int64()), pa.nulls(len(out), pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "filled"],
            )
        left = bins.partly()
        if left:
            none = lambda t: pa.nulls(len(left), t)
            yield pa.RecordBatch.from_arrays(
                [none(id_type), none(pa.int32()), none(pa.int64()), none(pa.int64()), none(pa.int64()), pa.array([base + x for x, _ in left], pa.int64()), none(pa.int64()), pa.array([n for _, n in left], pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "filled"],
            )

    packed = cut(d.mapInArrow(first_round, _ROW.format(kind=kind)), "packed")
    partly = packed.where("filled IS NOT NULL").select("sequence_id", "filled")
    n_tasks = max(1, -(-partly.count() // BINS_A_TASK))

    def second_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, holder = BestFit(capacity, open_bins), {}
        for b in batches:  # fullest first within a task, see below
            old, new, base = [], [], []
            for seq, filled in zip(b.column("sequence_id").to_pylist(), b.column("filled").to_pylist(), strict=True):
                at, offset = bins.place(filled)
                if not offset:
                    holder[at] = seq  # the first that lies in a bin lends it its number
                elif at not in holder:
                    raise AssertionError("a bin without its first content")
                old.append(seq), new.append(holder[at]), base.append(offset)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (old, new, base)], ["old_id", "new_id", "base"])

    spread = partly.repartition(n_tasks, F.xxhash64("sequence_id")) if n_tasks > 1 else partly.coalesce(1)
    merged = spread.sortWithinPartitions(F.desc("filled"), "sequence_id").mapInArrow(second_round, "old_id long, new_id long, base long")
    merged = merged.where("base > 0")
    pieces = packed.where("filled IS NULL").drop("filled")
    joined = pieces.join(merged, pieces["sequence_id"] == merged["old_id"], "left")
    return joined.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("new_id", "sequence_id").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"),
    )


def op4_best_fit(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
