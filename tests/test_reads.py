"""Read models, decisions and versions that SQL doesn't show."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import normalize_name
from tidemark.operators import reads, resolve
from tidemark.plans import versions


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def test_json_strings(spark):
    for body, want in (('["a", 1, null, "b"]', ["a", "b"]), ('{"a": 1}', []), ("junk", []), (None, [])):
        assert one(spark, reads.json_strings(F.lit(body).cast("string"))) == want


def test_same_company_against_brute_force(spark):
    rng = random.Random(5)
    words = ["Harbour", "Harbor", "Quarry", "Tools", "Analytics", "Analytic", "Systems", "Works", "Workz", "Lighthouse"]
    known = [(f"k{i}.io", " ".join(rng.sample(words, 2)), rng.choice([None, "US", "DE"])) for i in range(40)]
    given = [(i, rng.choice([f"k{i}.io", f"n{i}.io"]), " ".join(rng.sample(words, 2)), rng.choice([None, "US", "DE"])) for i in range(60)]
    got = {r["id"]: (r["rung"], r["domain"], round(r["score"], 6)) for r in reads.same_company(spark.createDataFrame(given, "id long, domain string, name string, country string"), spark.createDataFrame(known, "domain string, display_name string, country string")).collect()}
    names = {n for _, n, _ in known} | {n for _, _, n, _ in given}
    norm = {r["v"]: r["n"] for r in spark.createDataFrame([(n,) for n in names], "v string").select("v", normalize_name(F.col("v")).alias("n")).collect()}
    want = {}
    for i, domain, name, country in given:
        if domain in {d for d, _, _ in known}:
            want[i] = (1, domain, 100.0)
            continue
        best = None
        for d, n, c in known:
            if not country or not c or country == c:
                s = 100.0 if norm[n] == norm[name] else resolve.indel_ratio(norm[name], norm[n])
                if s >= 92 and (best is None or (-s, d) < best):
                    best = (-s, d)
        if best:
            want[i] = (2, best[1], round(-best[0], 6))
    assert got == want and {r for r, _, _ in got.values()} == {1, 2}


def test_versions(tmp_path):
    (tmp_path / "a.md").write_text("one")
    prompts = versions.read_prompts(str(tmp_path))
    v = versions.prompt_version(prompts)
    assert len(v) == 16 and v != versions.prompt_version({"a.md": b"two"}) and v != versions.prompt_version({"b.md": b"one"})
    p = versions.prose_version(prompts, {"tokens": 10}, {"angle": 400})
    assert p != versions.prose_version(prompts, {"tokens": 11}, {"angle": 400}) and p != versions.prose_version(prompts, {"tokens": 10}, {"angle": 220})
    assert versions.schema_versions(["0002_b.sql", "0001_a.sql"], ["0001_a"]) == [("0001_a", True), ("0002_b", False)]
    for files, applied in ((["1_a.sql"], []), (["0001_a.sql"], ["0009_z"])):
        with pytest.raises(ValueError):
            versions.schema_versions(files, applied)
    assert versions.checked_config("x", {"a": 1}, ("a",)) == {"a": 1}
    for bad in ([], {"a": None}, None):
        with pytest.raises(ValueError):
            versions.checked_config("x", bad, ("a",))


def test_schema_without_annotations():
    schema = {"title": "T", "description": "d", "properties": {"description": {"type": "string", "description": "x"}, "title": {"title": "y"}}, "items": [{"title": "z", "type": "int"}]}
    assert json.dumps(versions.without_annotations(schema), sort_keys=True) == json.dumps({"properties": {"description": {"type": "string"}, "title": {}}, "items": [{"type": "int"}]}, sort_keys=True)


def test_generation_stops_where_the_backend_is_down(spark):
    tries = lambda *t: F.array(*[F.struct(F.lit(a).alias("ok"), F.lit(b).alias("down")) for a, b in t])
    for (first, second, cloud) in itertools.product([(True, False), (False, False), (False, True)], [(True, False), (False, False)], [True, False]):
        x = one(spark, reads.generation(tries(first, second), F.struct(*[F.lit(cloud).alias(n) for n in ("allowed", "configured", "affordable", "ok")])))
        local = 1 if first[0] else 2 if not first[1] and second[0] else None
        assert (x["local_attempt"], x["escalated"], x["reason"]) == (local, local is None and cloud, None if local or cloud else "not permitted")


def test_stale_extractions_know_each_company(spark, duck, same, tmp_path):
    """Users 1, 501 and 1001 are three companies of which one lacks an industry: none stands for the others."""
    import datetime

    from tidemark import catalogue

    at = datetime.datetime(2024, 1, 1)
    rows = [(200 + 5 * i, at, 1 + 500 * (i % 3) + 2 * (i // 60), "view", 1.0, "{}") for i in range(180)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"file://{tmp_path}/events.parquet")
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(catalogue.ORACLE_SQL["stale_extractions"]).df()
    assert len(want)
    same(catalogue.QUERIES["stale_extractions"](spark, f"file://{tmp_path}").toPandas(), want)


def test_evidence_rows_of_large_keys(spark, duck, same, data_dir, tmp_path):
    """What is made for a row doesn't grow with its key: a key beyond an int is one like any other."""
    from tidemark import catalogue

    for name in ("nation", "orders"):
        spark.read.parquet(f"{data_dir}/{name}.parquet").write.parquet(f"file://{tmp_path}/{name}.parquet")
    far = spark.read.parquet(f"{data_dir}/customer.parquet").limit(20).withColumn("c_custkey", F.col("c_custkey") + 5_000_000_000 * (F.col("c_custkey") % 2))
    far.write.parquet(f"file://{tmp_path}/customer.parquet")
    con = duck.cursor()
    con.execute(f"CREATE TEMP VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    want = con.execute(catalogue.ORACLE_SQL["evidence_rows"]).df()
    assert want["k"].max() > 5_000_000_000
    same(catalogue.QUERIES["evidence_rows"](spark, f"file://{tmp_path}").toPandas(), want)
