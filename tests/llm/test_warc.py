import gzip
import hashlib
import io

import pytest

from tidemark.llm import warc

KIND = "page_id long, url string, html string, digest string, size string"


def make(spark, rows):
    return spark.createDataFrame([(*r, "d", "s") for r in rows], KIND)


LONG = "é<p>" * 60
ROWS = [(4, "https://a.io/", LONG), (2, "https://b.io/x y", LONG), (9, None, LONG), (1, "u", "short"), (3, "u", "short"), (5, "u", None), (6, "u", ""), (None, "u", LONG), (None, "v", "z" * 200), (8, "u", "big " * 300_000), (2, "https://b.io/x y", LONG)]


def test_round_trip(spark):
    got = [tuple(r) for r in warc.read_back(warc.archive(make(spark, ROWS), archive_bytes=2000)).collect()]
    want = []
    for i, _, h in ROWS:
        p = (h or "").encode()
        revisit = h == LONG and i != 2
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_members_and_index(spark):
    files = warc.archive(make(spark, ROWS)).collect()
    n = 0
    for f in files:
        path = f["file"].removeprefix("file://")
        raw = open(path, "rb").read()
        whole = gzip.decompress(raw)
        lines = open(path + ".idx").read().splitlines()
        assert len(lines) == f["n_records"]
        parts = []
        for line in lines:
            offset, length, kind, _ = line.split("\t")
            part = gzip.decompress(raw[int(offset) : int(offset) + int(length)])
            assert part.startswith(b"WARC/1.1\r\nWARC-Type: " + kind.encode())
            parts.append(part)
        assert b"".join(parts) == whole
        n += len(lines)
    assert n == len(ROWS)


def test_streams():
    recs = [warc.record(i, "u", b"x" * (i * 1000), "d", i * 1000, None) for i in range(5)]
    one, many = gzip.compress(b"".join(recs)), b"".join(gzip.compress(r) for r in recs)
    for raw in (one, many):
        assert [w for _, w in warc.records(warc.inflate(io.BytesIO(raw)))] == recs
    with pytest.raises(ValueError):
        list(warc.records(iter([recs[0][:-5]])))
    assert list(warc.records(iter([]))) == []


def test_empty(spark):
    assert warc.read_back(warc.archive(make(spark, []))).count() == 0


def test_against_sql(spark, duck, same, data_dir):
    same(warc.op8_gzip_normaliser(spark, data_dir).toPandas(), duck.sql(warc.OP8_SQL).df())


def test_ranges(monkeypatch):
    members = [gzip.compress(bytes([i]) * 50) for i in range(20)]
    raw, lines, at = b"", [], 0
    for i, m in enumerate(members):
        if i % 7 == 3:  # a gap
            raw, at = raw + b"?" * 9, at + 9
        lines.append(f"{at}\t{len(m)}\tresponse\t{i}".encode())
        raw, at = raw + m, at + len(m)
    for n in (1, 100, 1 << 20):
        monkeypatch.setattr(warc, "RANGE_BYTES", n)
        assert [m for _, _, m in warc._members(io.BytesIO(raw), iter(lines))] == members
    assert list(warc._members(io.BytesIO(raw), iter([]))) == []
