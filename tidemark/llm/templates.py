"""Benchmark decontamination (op 10) by template canonicalisation.

Numbers, names and units become typed placeholders; the rest of a word is its lower-case letters.
Windows of WINDOW such tokens of the benchmark are hashed (an item of fewer words is one window of them all, which has to
be there as it stands). The windows of every document
are looked up among them (a hash join, whose build side is the benchmark, broadcast within
BROADCAST_TOKENS and in parts of that size beyond it). Windows whose words are equal as they stand pass; they are
matched by distinct windows, whatever number of times either side repeats them. Of the others
those with a literal word pass where their slots are consistent on their diagonal, that is, among the hits with one
distance between the places in the document and in the item: equal values in the item must be equal in the
document, and different ones different, the first value met deciding. What
passes in at least COVERAGE of an item's windows is a copy of it. With other numbers, names or units only
windows with a literal word can pass, so it is enough to reach COVERAGE of those (counted as WINDOW at least,
where the item has as many windows: one window of a title says nothing).

Hits are counted for all items at once, as numbers of windows; diagonals are looked at only for items whose hits could reach the
coverage, in groups of items with about HITS hits, as arrays. So the work on a document follows its hits, however
many items share a window, and memory holds one group's.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

from .common import MEMORIES, cut, only_memory, pick, table, word_parts

WINDOW = 5
COVERAGE = 0.5
#: Benchmark tokens that one broadcast holds (some 64 bytes each); a larger benchmark goes in parts.
BROADCAST_TOKENS = 2_000_000
#: Hits of one document whose diagonals are looked at together (one item's at least).
HITS = 1 << 18
#: Characters of a document looked up at once.
PART_CHARS = 2_000_000
MEMORY_WORDS = 300_000

NUMBER, NAME, UNIT = 1, 2, 3
#: Units that are one type.
UNITS = frozenset("mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g gram grams kg kilogram kilograms lb lbs pound pounds oz ounce ounces ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years % percent dollar dollars euro euros cent cents mph km/h °c °f".split())
_NUMBER = re.compile(r"[-+]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th|%)?")
_TRIM = re.compile(r"^[^\w%°$€£+-]+|[^\w%°]+$")
_END = re.compile(r"[.!?:][\"')\]]*$")
#: number words of the four languages are words: they are not typed.

_ENDS, _CAP = 1 << 62, 1 << 61
_MASK = (1 << 61) - 1


class _Words(dict):
    """word -> token hash, with flags for a capital and for the end of a sentence."""

    def __missing__(self, word: str) -> int:
        core = _TRIM.sub("", word)
        low = core.lower()
        if _NUMBER.fullmatch(core):
            code = NUMBER
        elif low in UNITS:
            code = UNIT
        else:
            raw = low.encode("utf-8", "surrogatepass")
            code = 16 + ((zlib.crc32(raw) << 28 | zlib.crc32(raw, 0x5BD1E995) >> 4) & (_MASK >> 1))
        if core and core[0].isupper() and code >= 16 and not core.isupper():
            code |= _CAP
        if _END.search(word):
            code |= _ENDS
        if len(self) >= MEMORY_WORDS:
            self.clear()
        self[word] = code
        return code


_words = _Words()


def canonical(words: list[str]):
    """Two int64 arrays: tokens in which capitalised words inside a sentence are names, and tokens in which
    they are words. A name's placeholder depends on what stands before it, so both are kept."""
    import numpy as np

    raw = np.fromiter(map(_words.__getitem__, words), np.int64, len(words))
    plain = raw & _MASK
    first = np.empty(len(raw), bool)
    first[:1] = True
    first[1:] = (raw[:-1] & _ENDS) != 0
    typed = np.where(((raw & _CAP) != 0) & ~first, NAME, plain)
    return typed, plain


class _Exact(dict):
    """word -> hash of its letters and digits as they stand, without case."""

    def __missing__(self, word: str) -> int:
        raw = _TRIM.sub("", word).lower().encode("utf-8", "surrogatepass")
        if len(self) >= MEMORY_WORDS:
            self.clear()
        self[word] = code = (zlib.crc32(raw) << 28 | zlib.crc32(raw, 0x5BD1E995) >> 4) & _MASK
        return code


_exact = _Exact()
#: The index of the last benchmark that this worker saw, by the name it was sent with.
_indexes: dict[str, Benchmark] = {}
MEMORIES["templates"] = lambda: (_words.clear(), _exact.clear(), _indexes.clear())


def _window_hashes(tokens, size: int = WINDOW):
    import numpy as np

    n = len(tokens) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    t = tokens.astype(np.uint64)
    h = np.full(n, size - WINDOW, np.int64).astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = (h ^ t[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def _expand(lo, hi):
    """The numbers from lo[i] to hi[i] - 1 for each i, and the i that each stands for."""
    import numpy as np

    n = hi - lo
    of = np.repeat(np.arange(len(lo)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + lo[of], of


class Benchmark:
    """Window index of some items. Windows and words of all items lie one after the other; ``base`` and ``word_base`` say where an
    item's begin."""

    def __init__(self, items: list[tuple[object, str]]):
        import numpy as np

        self.ids: list[object] = []
        words_of, typed_of, sizes, looked_up, exact, literals, hashes, places = [], [], [], [], [], [], [], []
        for item_id, text in items:
            words = text.split()
            if not words:
                continue
            typed, plain = canonical(words)
            size = min(WINDOW, len(words))
            own = np.fromiter(map(_exact.__getitem__, words), np.int64, len(words))
            literal = np.lib.stride_tricks.sliding_window_view(typed >= 16, size).any(1) if size == WINDOW else np.zeros(1, bool)
            at = np.flatnonzero(literal)
            both = [_window_hashes(t, size) for t in (typed, plain)]
            self.ids.append(item_id)
            words_of.append(own), typed_of.append(typed), sizes.append(size), exact.append(_window_hashes(own, size)), literals.append(literal)
            looked_up += both
            other = at[both[0][at] != both[1][at]]  # a window without names reads the same both ways
            hashes.append(np.concatenate([both[0][at], both[1][other]]))
            places.append(np.concatenate([at, other]))
        none = [np.zeros(0, np.uint64)]
        join = lambda x, kind: np.concatenate(x or none).astype(kind)
        starts = lambda lengths: np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int64)
        n = np.array([len(x) for x in exact], np.int64)
        self.sizes = sorted(set(sizes))
        self.base, self.word_base = starts(n), starts([len(x) for x in words_of])
        self.words, self.typed = join(words_of, np.int64), join(typed_of, np.int64)
        #: does a window hold a literal word? How many of an item's do, and which item is a window of?
        self.literal = join(literals, bool)
        self.owner = np.repeat(np.arange(len(n)), n)
        lit = np.bincount(self.owner, self.literal, len(n)).astype(np.int64)
        self.n, self.full = n, np.array(sizes, np.int64) == WINDOW
        self.n_literal = np.maximum(lit, np.minimum(n, WINDOW))
        #: every window's hash under both readings
        self.hashes = np.unique(join(looked_up, np.uint64))
        e = join(exact, np.uint64)
        order = np.argsort(e, kind="stable")
        self.exact, self.exact_at = e[order], order
        # windows with a literal word, item by item and by hash
        self.of_item = starts([len(x) for x in hashes])
        self.item_hash, self.item_place = join(hashes, np.uint64), join(places, np.int64)
        windows = self.item_place + np.repeat(self.base[:-1], np.diff(self.of_item))
        order = np.argsort(self.item_hash, kind="stable")
        self.open, self.open_at = self.item_hash[order], windows[order]
        # a small bit table in front of the sorted hashes: most windows end here
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.hashes >> np.uint64(42)).astype(np.int64)] = True

    def _hits(self, text: str):
        """The document's windows whose hash some item has: place, hash, hash as it stands, hashes of the words."""
        import numpy as np

        found = []
        start, before = 0, []
        for words in word_parts(text, PART_CHARS):
            # a part begins with the last words of the one before; the first of them only tells whether a sentence ended
            part = before + words
            typed, plain = canonical(part)
            for size in self.sizes:
                skip = max(0, len(before) - size + 1)
                first = None
                for tokens in (typed, plain) if (typed != plain).any() else (typed,):
                    h = _window_hashes(tokens, size)[skip:]
                    seen = self.filter[(h >> np.uint64(42)).astype(np.int64)]
                    at = np.flatnonzero(seen if first is None else seen & (h != first))
                    first = h
                    if len(at):
                        i = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
                        at = at[self.hashes[i] == h[at]]
                    if not len(at):
                        continue
                    own = np.zeros((len(at), WINDOW), np.int64)
                    for k in range(size):
                        own[:, k] = [_exact[part[p]] for p in (at + skip + k).tolist()]
                    e = np.full(len(at), size - WINDOW, np.int64).astype(np.uint64)
                    with np.errstate(over="ignore"):
                        for k in range(size):
                            e = (e ^ own[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                            e ^= e >> np.uint64(29)
                    found.append((at + skip + start - len(before), h[at], e, own))
            start += len(words)
            before = part[-WINDOW:]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else None

    def find(self, text: str) -> list[tuple[object, int, float, int]]:
        """(item_id, matched windows, coverage, first word) of the items that ``text`` holds."""
        import numpy as np

        hits = self._hits(text) if len(self.hashes) else None
        if hits is None:
            return []
        at, h, e, own = hits
        # the first place of each distinct window as it stands, and the items' windows that are equal to it
        e1 = np.unique(e)
        first_at = np.full(len(e1), 1 << 62)
        np.minimum.at(first_at, np.searchsorted(e1, e), at)
        rows, of = _expand(np.searchsorted(self.exact, e1, "left"), np.searchsorted(self.exact, e1, "right"))
        passed, place = self.exact_at[rows], first_at[of]  # a window of an item is equal to one e1 only
        # what any placeholder could add
        h1 = np.unique(h)
        more, _ = _expand(np.searchsorted(self.open, h1, "left"), np.searchsorted(self.open, h1, "right"))
        upper = np.union1d(passed, self.open_at[more])
        items, share, count = self._shares(upper)
        able = items[share >= COVERAGE]
        exact_count = np.bincount(np.searchsorted(items, self.owner[passed]), minlength=len(items))
        open_items = items[(share >= COVERAGE) & (exact_count < count)]
        if len(open_items):
            order = np.argsort(h, kind="stable")
            at, h, e, own = at[order], h[order], e[order], own[order]
            lo, hi = (np.searchsorted(h, self.item_hash, side) if 4 * len(open_items) > len(self.ids) else None for side in ("left", "right"))
            for group in self._groups(open_items, h, lo, hi):
                p, w = self._consistent(group, at, h, e, own)
                passed, place = np.concatenate([passed, w]), np.concatenate([place, p])
        if not len(passed):
            return []
        order = np.lexsort((place, self.owner[passed]))
        firsts = place[order][np.unique(self.owner[passed[order]], return_index=True)[1]]
        items, share, count = self._shares(np.unique(passed))
        good = (share >= COVERAGE) & np.isin(items, able)
        return [(self.ids[k], c, s, f) for k, c, s, f in zip(items[good].tolist(), count[good].tolist(), share[good].tolist(), firsts[good].tolist(), strict=True)]

    def _shares(self, windows):
        """Of distinct windows: the items that have any, the share of each item's windows, and how many they are."""
        import numpy as np

        items, inverse = np.unique(self.owner[windows], return_inverse=True)
        count = np.bincount(inverse, minlength=len(items))
        literal = np.bincount(inverse, self.literal[windows], len(items))
        share = np.where(self.full[items], np.maximum(count / self.n[items], literal / self.n_literal[items]), count / self.n[items])
        return items, share, count

    def _groups(self, items, h, lo, hi):
        """``items`` in groups of about HITS hits."""
        import numpy as np

        at, of = _expand(self.of_item[items], self.of_item[items + 1])
        if lo is None:
            lo, hi = (np.searchsorted(h, self.item_hash[at], side) for side in ("left", "right"))
        else:
            lo, hi = lo[at], hi[at]
        total = np.cumsum(np.bincount(of, hi - lo, len(items)))
        for k in np.unique(total // HITS):
            yield items[total // HITS == k]

    def _consistent(self, items, at, h, e, own):
        """Places in the document and windows of ``items``: those with a literal word whose slots map one to one on their diagonal.
        ``h`` is sorted."""
        import numpy as np

        i, of = _expand(self.of_item[items], self.of_item[items + 1])
        hashes = self.item_hash[i]
        r, j = _expand(np.searchsorted(h, hashes, "left"), np.searchsorted(h, hashes, "right"))
        p, q, it = at[r], self.item_place[i[j]], of[j]
        order = np.lexsort((q, p - q, it))
        r, p, q, it = r[order], p[order], q[order], it[order]
        # of diagonals of an item with equal words at equal places the first is enough
        new = np.ones(len(q), bool)
        new[1:] = (np.diff(p - q) != 0) | (np.diff(it) != 0)
        starts = np.flatnonzero(new)
        with np.errstate(over="ignore"):
            x = (e[r] + q.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            marks = np.add.reduceat(x ^ (x >> np.uint64(32)), starts) if len(starts) else x
            marks = (marks ^ it[starts].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        kept = np.zeros(len(starts), bool)
        kept[np.unique(marks, return_index=True)[1]] = True
        kept = np.repeat(kept, np.diff(starts, append=len(q)))
        r, p, q, it, d = r[kept], p[kept], q[kept], it[kept], (np.cumsum(new) - 1)[kept]
        k = (self.word_base[items[it]] + q)[:, None] + np.arange(WINDOW)
        a, b, t = self.words[k], own[r], self.typed[k]
        literal = ((t >= 16) & (a == b)).any(1)
        kind = np.where(t < 16, t, np.where(a != b, NAME, 0))
        use = (kind != 0) & literal[:, None]
        # each word of a diagonal once, in order
        cell = (d[:, None] * (len(self.words) + 1) + k)[use]
        cells, one, inverse = np.unique(cell, return_index=True, return_inverse=True)
        line, what, x, y = cells // (len(self.words) + 1), kind[use][one], a[use][one], b[use][one]
        bad = np.zeros(len(cells), bool)
        for x, y in ((x, y), (y, x)):
            order = np.lexsort((x, what, line))  # stable: the first value met leads
            new = np.zeros(len(order), bool)
            new[:1] = True
            for c in (line, what, x):
                new[1:] |= c[order][1:] != c[order][:-1]
            lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            bad[order] |= y[order] != y[order][lead]
        wrong = np.zeros(k.shape, bool)
        wrong[use] = bad[inverse]
        good = literal & ~wrong.any(1)
        return p[good], self.base[items[it[good]]] + q[good]


def _parts(benchmark: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """The benchmark's items in lists of at most about BROADCAST_TOKENS words."""
    held, size = [], 0
    for r in pick(benchmark, "item_id", "text").where("text IS NOT NULL").toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += r["text"].count(" ") + r["text"].count("\n") + 1
        if size >= BROADCAST_TOKENS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _sent(benchmark: DataFrame) -> Iterator[tuple[Broadcast, bool]]:
    """The benchmark's parts, sent to the workers one at a time, and whether it is the last: what was made with any other has to be
    written before the next."""
    context, before = benchmark.sparkSession.sparkContext, None
    for items in _parts(benchmark):
        if before is not None:
            yield before, False
            before.destroy()
        before = context.broadcast((uuid.uuid4().hex, items))
    if before is not None:
        yield before, True


def _index(sent: Broadcast) -> Benchmark:
    """The index of what was sent, built once a worker."""
    only_memory("templates")
    name, items = sent.value
    if name not in _indexes:
        _indexes.clear()
        _indexes[name] = Benchmark(items)
    return _indexes[name]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item that it holds: doc_id, item_id, n_windows,
    coverage, first_word. Documents without any give no row.

    An item of fewer than WINDOW words matches where its words stand in the text in order, whatever their case; items and
    texts that are null or hold no word match nothing; ids are of any type, and null ids stay null; repeated rows, of either table, are reported
    each, and so are items that match equally well; a very long text is read in parts; other columns play no part, whatever
    their names; an empty table on either side gives no rows. A benchmark of more than BROADCAST_TOKENS words goes in parts, each a
    pass over the documents whose rows are written.
    """
    d = pick(docs, "doc_id", "text")
    id_type = pick(benchmark, "item_id").schema["item_id"].dataType
    schema = f"doc_id {d.schema['doc_id'].dataType.simpleString()}, item_id {id_type.simpleString()}, n_windows long, coverage double, first_word long"
    arrow_id = to_arrow_type(id_type)
    out = docs.sparkSession.createDataFrame([], schema)
    for sent, last in _sent(benchmark):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = _index(sent)
            for b in batches:
                held = [(i, f) for i, t in enumerate(b.column("text").to_pylist()) if t for f in index.find(t)]
                cols = list(zip(*(f for _, f in held), strict=True)) or [[]] * 4
                kinds = [arrow_id, pa.int64(), pa.float64(), pa.int64()]
                ids = b.column("doc_id").take(pa.array([i for i, _ in held], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "item_id", "n_windows", "coverage", "first_word"])

        found = d.mapInArrow(run, schema)
        out = out.unionByName(found if last else cut(found, "contaminated"))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns as they are, whatever their names.

    Cases are those of ``contaminated``: rows with a null or empty text stay, repeated rows stay or go together, and
    all rows stay where the benchmark is empty.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = f"c{names.index('text')}"
    for sent, last in _sent(benchmark):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = _index(sent)
            for b in batches:
                yield b.filter(pa.array([not (t and index.find(t)) for t in b.column(at).to_pylist()], pa.bool_()))

        kept = plain.mapInArrow(run, plain.schema)
        plain = kept if last else cut(kept, "clean")
    return plain.toDF(*names)


def op10_template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
