import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import packing, tokens

ODD = ["", " ", "  a  b", "a\n b", " x", "x ", "▁a b", "日本 語 a", "<s> a </s>", "<|endoftext|> a", "a<|endoftext|>b c", "tab\there \t x", "don't I'll 12,5 x٣", "é b c", " \n\n a", "a b  c", "a\x0bb \x1c c",
       "a  " * 9000 + "b", "x" * 9000 + "  y" * 3000, "Ab1! " * 5000]


def test_piece_counts_equal_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert tokens.piece_counter().count(ODD) == [len(x) for x in sp.encode(ODD)]


def test_byte_ids_equal_library(spark):
    t, e = Tokenizer.from_file(P.path("byte_bpe_50k.json")), tokens.byte_encoder()
    texts = ODD + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for x in texts:
        assert np.frombuffer(e.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x[:50]


def test_small_memory_of_parts(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY_PARTS", 3)
    monkeypatch.setattr(tokens, "BATCH_CHARS", 10)
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    own = tokens.PieceCounter(P.path("piece_bpe_32k.model"))
    texts = ["one two three four five six", "seven eight", "one nine ten", ""]
    assert own.count(texts) == [len(x) for x in sp.encode(texts)]


def test_parts_of_long_texts(monkeypatch):
    t, e = Tokenizer.from_file(P.path("byte_bpe_50k.json")), tokens.byte_encoder()
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = ["word  two\n x é ü\t9,9 " * 40, "plain words in a row " * 30, "日本 " * 50 + "<|endoftext|> a b c d", " lead  ing " * 20]
    for n in (1, 5, 17):
        monkeypatch.setattr(tokens, "BATCH_CHARS", n)
        assert tokens.piece_counter().count(texts) == [len(x) for x in sp.encode(texts)]
        for x in texts:
            assert np.frombuffer(e.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def test_count_rows(docs):
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokens.token_counts(docs([(1, None), (2, "é a"), (None, ""), (2, "é a"), (3, "word " * 5000)])).collect()), key=repr)
    assert got[0][:3] == (1, 0, 0) and got[1] == got[2] and got[1][1] == 4 and got[3][3] and got[4][0] is None
    assert tokens.token_counts(docs([])).count() == 0


def rules(rows, capacity=2048):
    """The law of packing: gapless, within capacity, every document whole."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    for spans in by_seq.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity
    return by_doc, by_seq


def test_pack(docs):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = {1: "a b c", 2: None, 3: "", 4: "word " * 5000, 5: "x y " * 1023 + "z", 6: "hello " * 300}
    rows = packing.pack(docs(list(texts.items()))).collect()
    by_doc, by_seq = rules(rows)
    for i, x in texts.items():
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[i])
        assert sum(n for *_, n in pieces) == len(ids) and [p for p, *_ in pieces] == list(range(len(pieces)))
        assert all(n == 2048 for *_, n in pieces[1:]) and (len(pieces) == 1 or len(ids) > 2048)
        for r in rows:
            if r["doc_id"] == i:
                assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    total = sum(r["length"] for r in rows)
    assert len(by_seq) == -(-total // 2048)
    assert packing.pack(docs([])).count() == 0


def test_pack_repeats_and_tasks(docs, monkeypatch):
    monkeypatch.setattr(packing, "BINS_A_TASK", 2)
    rows = packing.pack(docs([(i % 7 if i % 5 else None, "word " * (i % 40 * 9)) for i in range(200)]).repartition(6)).collect()
    assert len(rows) == 200
    _, by_seq = rules(rows)
    assert len(by_seq) <= 1.3 * sum(r["length"] for r in rows) / 2048 + 6


@pytest.mark.parametrize("open_bins", [1, 3, 50])
def test_best_fit_is_bounded(open_bins):
    bins = packing.BestFit(100, open_bins)
    rng = np.random.default_rng(0)
    used = {}
    for n in rng.integers(1, 101, 2000).tolist():
        b, o = bins.place(n)
        assert o == used.get(b, 0)
        used[b] = o + n
        assert used[b] <= 100 and bins.open <= open_bins
    assert sorted(bins.partly()) == sorted((b, n) for b, n in used.items() if n < 100)
    assert packing.cut_lengths(100, 100) == [100] and packing.cut_lengths(250, 100) == [50, 100, 100] and packing.cut_lengths(200, 100) == [100, 100]


def test_byte_batches():
    from tidemark.llm.common import byte_batches

    assert list(byte_batches([], 10)) == [] and list(byte_batches([0, 0], 10)) == [(0, 2)]
    rng = random.Random(3)
    sizes = [rng.randrange(100) for _ in range(1000)]
    got = list(byte_batches(sizes, 1000))
    assert [a for a, _ in got] == [0, *(b for _, b in got[:-1])] and got[-1][1] == 1000
    assert max(sum(sizes[a:b]) for a, b in got) <= 1100 and min(sum(sizes[a:b]) for a, b in got) >= 800
    assert (1, 2) in list(byte_batches([5, 10_000, 5, 5], 1000))
