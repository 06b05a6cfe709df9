"""The format of landed answers: every line once, whatever the ranges; filters plan less; a stream goes on where it was."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import format as fmt
from tidemark.sources import landed


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    body = [json.dumps({"hits": [{"title": f"é{i}", "url": f"https://u{i}.io", "author": "a", "created_at_i": i, "story_text": "x" * (i % 50)}]}, ensure_ascii=False) for i in range(120)]
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(body[:70]) + "\n")
    (tmp_path / "in" / "sub" / "b.jsonl").write_text("\n\n".join(body[70:]))  # empty lines, and no newline at the end
    (tmp_path / "in" / "_hidden").write_text("no\n")
    (tmp_path / "in" / "empty").write_text("")
    return tmp_path / "in", body


def test_ranges(folder):
    path, body = folder
    for size in (1, 7, 64, 1000, 1 << 20):
        for name, want in (("a.jsonl", body[:70]), ("sub/b.jsonl", body[70:])):
            f = str(path / name)
            n = (path / name).stat().st_size
            got = [x for r in fmt._ranges(f, 0, n, size) for x in fmt.lines(f, r.start, r.end)]
            assert [b.decode() for _, b in got] == want and len({p for p, _ in got}) == len(got)


def test_small_chunks(folder, monkeypatch):
    path, body = folder
    monkeypatch.setattr(fmt, "CHUNK", 5)
    f = str(path / "a.jsonl")
    n = (path / "a.jsonl").stat().st_size
    assert [b.decode() for r in fmt._ranges(f, 0, n, 33) for _, b in fmt.lines(f, r.start, r.end)] == body[:70]
    assert fmt._last_end(f, n) == n


def test_read(spark, folder):
    path, body = folder
    fmt.register(spark)
    df = spark.read.format("landed").option("range", "500").load(f"file://{path}")
    assert df.rdd.getNumPartitions() > 10 and sorted(r["body"] for r in df.collect()) == sorted(body)
    stories = landed.stories(df)
    assert {r["title"] for r in stories.collect()} == {f"é{i}" for i in range(120)}
    one = df.where(F.col("path").endswith("a.jsonl")).count()
    assert one == 70
    a = df.where("path LIKE '%a.jsonl'").orderBy("pos").collect()
    low = a[10]["pos"]
    some = df.where((F.col("path") == a[0]["path"]) & (F.col("pos") >= low) & (F.col("pos") < a[20]["pos"]))
    assert [r["pos"] for r in some.orderBy("pos").collect()] == [r["pos"] for r in a[10:20]] and some.rdd.getNumPartitions() < df.rdd.getNumPartitions()
    with pytest.raises(Exception, match="path"):
        spark.read.format("landed").load().count()


def test_stream_resumes(spark, folder, tmp_path):
    """Rows of two runs, the second after the last file grew and another came: each line once."""
    path, body = folder
    fmt.register(spark)
    out, mark = f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint"

    def run():
        s = spark.readStream.format("landed").option("range", "700").load(f"file://{path}")
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["body"] for r in spark.read.parquet(out).collect())

    assert run() == sorted(body[:-1])  # the last line has no end yet
    with open(path / "sub" / "b.jsonl", "a") as f:
        f.write(" \nlate one\nlate two\npart")
    (path / "sub" / "c.jsonl").write_text("new\n")
    got = run()
    assert got == sorted([*body[:-1], body[-1] + " ", "late one", "late two", "part", "new"]) or got == sorted([*body[:-1], body[-1] + " ", "late one", "late two", "new", "part"])
    assert run() == got


def test_a_long_line_is_read_once(tmp_path, monkeypatch):
    """Ranges in the middle of a line read their own bytes and not the rest of the line."""
    f = tmp_path / "long"
    body = [b"x" * 200_000, b"", b"y" * 30, b"z" * 50_000]
    f.write_bytes(b"\n".join(body))
    n, read = f.stat().st_size, []
    system, at = fmt._system(str(f))

    class Counted:
        def __init__(self, file):
            self.file = file

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def __getattr__(self, name):
            return getattr(self.file, name)

        def read(self, size):
            read.append(size)
            return self.file.read(size)

    class System:
        def open_input_file(self, path):
            return Counted(system.open_input_file(path))

    monkeypatch.setattr(fmt, "_system", lambda _: (System(), at))
    monkeypatch.setattr(fmt, "CHUNK", 4096)
    got = [x for r in fmt._ranges(str(f), 0, n, 1000) for x in fmt.lines(str(f), r.start, r.end)]
    assert got == [(0, body[0]), (200_002, body[2]), (200_033, body[3])]
    assert sum(read) < 3 * n


def test_answers_are_bounded(spark, monkeypatch):
    """Items of one source lie in answers of a bounded number of events."""
    from tidemark import catalogue_sources as c

    monkeypatch.setattr(c, "PAGE", 100)
    rows = spark.range(1000).select(F.col("id").alias("event_id"))
    found = c._landed(rows, F.lit(1), F.struct("event_id"), "hits").where("board <> 'junk'").select(F.size(F.from_json("body", "hits array<struct<event_id:long>>")["hits"]).alias("n"))
    assert sorted(r["n"] for r in found.collect()) == [100] * 10


def test_small_ranges_share_tasks():
    """The number of tasks follows the bytes, however small the ranges are, and each range is read by one."""
    ranges = fmt._ranges("f", 0, 100_000, 10)
    parts = fmt._dealt(ranges)
    assert len(parts) <= fmt.PARTITIONS + 1 and [r.value for p in parts for r in p.ranges] == [r.value for r in ranges]
    assert len(fmt._dealt(fmt._ranges("f", 0, 10 * fmt.RANGE, fmt.RANGE))) == 10 and len(fmt._dealt(fmt._ranges("f", 0, 30, 10))) == 3 and len(fmt._dealt([])) == 1
