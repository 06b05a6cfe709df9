"""Token counts (op 6), and the byte-level encoder that packing (op 4) shares.

Texts are encoded in Arrow functions, in sub-batches of near equal sizes of at most about BATCH_BYTES. Every
text, also a very long one, is split at boundaries that no token can cross, and each part that has not
been seen lately is encoded by the library, all new parts of a sub-batch in one call; only lengths
leave the function.

Why the boundaries are safe. Piece model: no piece of the vocabulary holds the space mark behind
another character (checked when the model is loaded), so no merge crosses the border between a
non-space and a space. A text is cut before single spaces; texts with runs of spaces, or with the
mark itself, are cut before runs. Byte-level BPE: its splitting pattern ends every match before
a single space that stands between two non-spaces, so the same cut holds; texts with other white
space around spaces, special strings or letters outside Latin go to the library whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import MEMORIES, byte_batches, only_memory, pick, table

PIECE_MODEL = "piece_bpe_32k.model"
#: Parts that one Python worker remembers; a bound on its memory (some 100 MB), not on what is counted.
MEMORY_PARTS = 500_000
BATCH_BYTES = 2_000_000
#: Characters of one part of a very long text.
BATCH_CHARS = 2_000_000

_loaded: dict = {}
MEMORIES["tokens"] = _loaded.clear


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCounter:
    """Numbers of tokens by a sentencepiece model, without begin and end."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        mark = "▁"
        self.mark = mark
        self.safe = not any(mark in self.model.id_to_piece(i).lstrip(mark) for i in range(self.model.get_piece_size()))
        self.known: dict[str, int] = {}

    def count(self, texts: list[str]) -> list[int]:
        """One number a text; sub-batches, and parts of long texts, keep the memory of one call bounded."""
        out: list[int] = []
        sizes = pc.binary_length(pa.array(texts, pa.large_string())).to_pylist()
        for a, b in byte_batches(sizes, BATCH_BYTES):
            if self.safe and b == a + 1 and len(texts[a]) > 2 * BATCH_CHARS:
                out.append(sum(self._count([part])[0] for part in self._parts(texts[a])))
            else:
                out += self._count(texts[a:b])
        return out

    def _parts(self, text: str) -> Iterator[str]:
        """A text cut before single or first spaces; the library's mark before each part stands for the space that is left out."""
        start = 0
        while start < len(text):
            m = _BOUNDARY.search(text, start + BATCH_CHARS)
            end = m.start() + 1 if m else len(text)
            yield text[start:end]
            start = end + 1

    def _count(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        known = self.known
        parts = [t.split(" ") for t in texts]
        new: set[str] = set()
        for p in parts:
            new.update(p)
        new.difference_update(known)
        new.discard("")
        odd = {w for w in new if self.mark in w}
        new -= odd
        if len(known) + len(new) > MEMORY_PARTS:
            known.clear()
            new = {w for p in parts for w in p if w and self.mark not in w}
        fresh = list(new)
        known.update(zip(fresh, map(len, self.model.encode(fresh, num_threads=1)), strict=True))
        out = []
        for t, p in zip(texts, parts, strict=True):
            try:
                out.append(sum(map(known.__getitem__, p)))
            except KeyError:  # runs of spaces, empty text or the mark itself
                out.append(self._whole(t))
        return out

    def _whole(self, text: str) -> int:
        """Units are a run of marks and what follows up to the next run; the library puts one
        mark before the text. Encoding some hundred units a call bounds memory for any length."""
        if not text:
            return 0
        if len(text) < 20_000:
            return len(self.model.encode(text))
        n, start, first = 0, 0, True
        while start < len(text):
            end = start + 20_000
            if end < len(text):
                m = _BOUNDARY.search(text, end)
                end = m.start() + 1 if m else len(text)
            piece = text[start:end]
            # each call adds a mark at its beginning, which stands for the space that a later part begins with
            n += len(self.model.encode(piece if first else piece[1:]))
            first, start = False, end
        return n


#: The last space of a text stands for itself, so something must follow.
_BOUNDARY = re.compile(r"[^ ▁][ ▁](?=[\s\S])")


def piece_counter(name: str = PIECE_MODEL, path: Callable[[str], str] = vocabulary_path) -> PieceCounter:
    at = path(name)
    if at not in _loaded:
        _loaded[at] = PieceCounter(at)
    return _loaded[at]


def token_counts(docs: DataFrame, limit: int = 4096, model: str = PIECE_MODEL, path: Callable[[str], str] = vocabulary_path) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text).

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each; a null doc_id
    stays null; columns other than the two are ignored, whatever their names; an empty table gives no rows. No shuffle;
    memory is bounded by BATCH_BYTES, the longest text and MEMORY_PARTS.
    """
    d = pick(docs, "doc_id", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_memory("tokens")
        counter = piece_counter(model, path)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            n = pa.array(counter.count(texts), pa.int64())
            size = pc.cast(pc.coalesce(pc.binary_length(b.column("text")), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


class ByteEncoder:
    """Ids of the byte-level BPE vocabulary as little-endian unsigned 32-bit integers.

    ``tokenizers`` decides; words in Latin letters are looked up by the same vocabulary's ranks,
    which give the same ids (tests compare the two on whole texts).
    """

    def __init__(self, json_path: str, ranks_path: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.head = _Parts(self.ranks, "")
        self.rest = _Parts(self.ranks, " ")

    def encode(self, text: str) -> bytes:
        """A long text is cut before single spaces between other characters, where every match of the pattern ends."""
        out, start = [], 0
        while len(text) - start > 2 * BATCH_CHARS:
            m = _SINGLE.search(text, start + BATCH_CHARS)
            if not m:
                break
            out.append(self._encode(text[start : m.start() + 1]))
            start = m.start() + 1
        return b"".join([*out, self._encode(text[start:] if start else text)])

    def _encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            return self.head[first] + b"".join(map(self.rest.__getitem__, rest))
        except _Odd:
            import numpy as np

            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_SINGLE = re.compile(r"[!-~] (?=[!-~])")


class _Odd(Exception):
    pass


_STRANGE = re.compile("[^\t\n\r -~À-ÖØ-öø-ſ]|<\\||^\\s|\\s$")


class _Parts(dict):
    """Ids of parts of texts; a part that isn't safe to encode alone raises."""

    def __init__(self, ranks, before: str):
        self.ranks, self.before = ranks.encode_ordinary, before

    def __missing__(self, part: str) -> bytes:
        if part == "" and self.before == "":
            return b""
        if not part or _STRANGE.search(part):
            raise _Odd
        ids = self.ranks(self.before + part)
        found = b"".join([i.to_bytes(4, "little") for i in ids])
        if len(self) >= MEMORY_PARTS:
            self.clear()
        self[part] = found
        return found


def byte_encoder(name: str = "byte_bpe_50k", path: Callable[[str], str] = vocabulary_path) -> ByteEncoder:
    at = path(name + ".json")
    if at not in _loaded:
        _loaded[at] = ByteEncoder(at, path(name + ".tiktoken"))
    return _loaded[at]
