"""State machines in batch and as streams, and landed source files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources import catalog, landed
from tidemark.streaming import machines, streams


def test_governor_steps():
    temps = [(60, False), (72, False), (85, False), (82, False), (76, False), (68, False), (64, False), (None, False), (50, True), (None, False), (66, False)]
    state, seen = None, []
    for t, u in temps:
        state = machines.governor(state, t, u)
        seen.append(state)
    assert seen == ["nominal", "warm", "hot", "hot", "warm", "warm", "nominal", "nominal", "throttled", "hot", "nominal"]


def test_breaker_steps():
    state, out = None, []
    for at, ok in [(0, False), (1, False), (2, False), (3, True), (100, False), (150, True), (210, True), (211, False)]:
        state, admitted = machines.breaker(state, at, ok, threshold=3, cooldown=60)
        out.append((state[0], admitted))
    assert out == [("closed", True), ("closed", True), ("open", True), ("open", False), ("open", True), ("open", False), ("closed", True), ("closed", True)]


def test_budget_refusals_spend_nothing():
    state, out = None, []
    for h, u in [(0, 5), (1, 4), (1, 2), (2, 1), (24, 4), (25, 9)]:
        state, ok = machines.budget(state, h, u, 10, 24)
        out.append(ok)
    assert out == [True, True, False, True, True, False]


def test_budget_adds_grants_one_by_one(spark):
    """One after the other, as SQL adds them, these exceed the cap of 1; hour by hour, or by a compensated sum, they don't."""
    asks = [(0, 0.54), (1, 0.03), (1, 0.32), (2, 0.11), (2, 0.05), (30, 0.1), (30, 0.9)]
    state, want, held = None, [], []
    for h, u in asks:
        held = [x for x in held if x[0] > h - 24]
        total = 0.0
        for _, x in held:
            total += x
        want.append(total + u <= 1.0)
        if want[-1]:
            held.append((h, u))
        state, ok = machines.budget(state, h, u, 1.0, 24)
        assert ok == want[-1]
    rows = [("a", f"2024-03-{1 + h // 24:02d} {h % 24:02d}:00:00", i, u) for i, (h, u) in enumerate(asks)]
    df = spark.createDataFrame(rows, "provider string, at string, seq long, units double").withColumn("at", F.col("at").cast("timestamp_ntz"))
    assert [r["granted"] for r in machines.budget_grants(df, 1.0).orderBy("seq").collect()] == want
    assert want[3] is False and sum([0.54, 0.03, 0.32]) + 0.11 <= 1.0


def test_governor_bands():
    steps = [("nominal", 71, "warm"), ("warm", 67.5, "warm"), ("nominal", 67.5, "nominal"), ("warm", 66, "nominal"), ("warm", 84, "hot"), ("hot", 81, "hot"), ("hot", 80.9, "warm"), ("throttled", 82, "warm"), ("throttled", 60, "nominal"), ("throttled", None, "hot"), ("warm", None, "warm")]
    assert [machines.governor(now, t, False) for now, t, _ in steps] == [want for *_, want in steps]
    assert machines.governor("nominal", 20, True) == "throttled"


def test_folds_do_not_depend_on_the_time_zone(spark):
    rows = [("a", f"2024-03-{d:02d} {h:02d}:30:00", d * 100 + h, float(h % 3 != 0)) for d in (9, 10, 11) for h in range(24)]
    df = spark.createDataFrame(rows, "source string, at string, seq long, v double").withColumn("at", F.col("at").cast("timestamp_ntz"))
    calls, asks = df.withColumn("ok", F.col("v") > 0), df.select(F.col("source").alias("provider"), "at", "seq", (F.col("seq") % 7 + 1).cast("double").alias("units"))
    got, zone = [], spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("UTC", "America/New_York", "Asia/Dhaka"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            got.append((sorted(map(tuple, machines.circuit_states(calls, 2, 5400.0).collect())), sorted(map(tuple, machines.budget_grants(asks, 50.0).collect()))))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got[0] == got[1] == got[2]


def samples(spark, n=200):
    df = spark.range(n).select(F.concat(F.lit("u"), (F.col("id") % 3).cast("string")).alias("unit"), F.col("id").alias("seq"), (F.col("id") * 37 % 50 + 50).cast("double").alias("value"), (F.col("id") % 31 == 0).alias("undervoltage"))
    return df.withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))


def test_governor_stream_equals_batch(spark, tmp_path):
    s = samples(spark)
    seen: set = set()
    for i in range(4):  # files are read in the order of their times
        s.where(F.col("seq").between(i * 50, i * 50 + 49)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in set((tmp_path / "in").glob("*.parquet")) - seen:
            os.utime(f, (1_700_000_000 + 100 * i,) * 2)
            seen.add(f)
    want = {(r["unit"], r["seq"]): r["state"] for r in machines.governor_states(s).collect()}
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.governor_stream(stream).writeStream.format("memory").queryName("governor").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {(r["unit"], r["seq"]): r["state"] for r in spark.table("governor").collect()}
    assert got == want


def test_rolling_units_and_sessions(spark, tmp_path):
    rows = [("p", f"2024-01-01 {h:02d}:30:00", 1.0) for h in range(4)]
    df = spark.createDataFrame(rows, "provider string, at string, units double").withColumn("at", F.col("at").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out in (("rolling", streams.rolling_units(stream, "2 hours")), ("beats", streams.heartbeat_sessions(stream.withColumnRenamed("provider", "unit")))):
        q = out.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(180)
    assert sorted(r["units"] for r in spark.table("rolling").collect()) == [1.0, 1.0, 2.0, 2.0, 2.0]
    assert spark.table("beats").count() == 4


def test_append_once_sink(spark, tmp_path):
    write = streams.append_once_sink(str(tmp_path / "log"), "key")
    one = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "key string, v int")
    write(one, 0)
    write(one, 0)
    write(spark.createDataFrame([("b", 3), ("c", 4)], "key string, v int"), 1)
    got = spark.read.parquet(*[str(p) for p in (tmp_path / "log").iterdir()])
    assert sorted((r["key"], r["v"]) for r in got.collect()) == [("a", 1), ("b", 2), ("c", 4)]


def bodies(spark, *rows, **extra):
    data = [(*extra.values(), r if isinstance(r, str) else json.dumps(r)) for r in rows]
    return spark.createDataFrame(data, ", ".join([*(f"{k} string" for k in extra), "body string"]))


def test_sources(spark, tmp_path):
    got = landed.stories(bodies(spark, {"hits": [{"title": "T", "url": "https://a.io", "author": "x", "created_at_i": 0, "story_text": "<p>hi &amp; ho</p>"}]}, "junk")).collect()
    assert [(r["title"], r["snippet"]) for r in got] == [("T", "hi & ho")]
    comments = [{"comment_text": "Acme | Dhaka <a href=\"https://acme.io\">x</a>", "author": "a", "created_at_i": 1}, {"comment_text": "none https://github.com/x", "author": "b", "created_at_i": 2}]
    assert [(r["title"], r["url"]) for r in landed.thread_comments(bodies(spark, {"hits": comments})).collect()] == [("Acme", "https://acme.io")]
    repos = {"items": [{"full_name": "o/r", "html_url": "h", "homepage": "acme.io", "owner": {"login": "o", "type": "Organization"}}, {"full_name": "u/r", "owner": {"login": "u", "type": "User"}}]}
    assert [r["title"] for r in landed.repositories(bodies(spark, repos)).collect()] == ["o/r"] and landed.repositories(bodies(spark, repos), False).count() == 2
    assert landed.web_results(bodies(spark, {"organic_results": [{"title": "a"}], "news_results": [{"title": "b"}]}, {"error": "no", "organic_results": [{"title": "c"}]})).count() == 2
    assert [r["content"] for r in landed.greenhouse(bodies(spark, {"jobs": [{"title": "t", "content": "<b>x</b>" + "y" * 3000}]}, board="b")).collect()][0].startswith("x yyy")
    assert landed.lever(bodies(spark, [{"text": "t", "createdAt": "1700000000000"}], board="b").withColumn("body", F.col("body"))).first()["published_at"].year == 2023
    assert landed.ashby(bodies(spark, {"jobs": [{"title": "t", "publishedAt": "2024-01-01T00:00:00Z"}]}, board="b")).first()["published_at"].year == 2024
    names = landed.certificate_names(bodies(spark, [{"name_value": "*.a.io\nB.a.io\nother.io", "not_before": "2024-01-01T00:00:00"}], domain="a.io"))
    assert sorted(r["name"] for r in names.collect()) == ["a.io", "b.a.io"]
    assert tuple(landed.certificate_growth(names, F.lit("2023-12-01").cast("timestamp")).first()) == ("a.io", 2, 2)
    rdap = {"events": [{"eventAction": "registration", "eventDate": "2023-01-01T00:00:00Z"}, {"eventAction": "registration", "eventDate": "2023-06-01T00:00:00Z"}], "entities": [{"roles": ["registrar"], "handle": "R"}]}
    r = landed.registration(bodies(spark, rdap, domain="a.io"), F.lit("2024-06-01").cast("timestamp")).first()
    assert (r["age_days"], r["registrar"]) == (366, "R")
    dns = spark.createDataFrame([("a", "MX", "m"), ("a", "TXT", "v=spf1 x"), ("a", "DMARC", "v=DMARC1; p=none"), ("b", "DNSKEY", None)], "domain string, kind string, value string")
    h = {x["domain"]: x["hygiene"] for x in landed.dns_records(dns).collect()}
    assert h["a"]["dmarc"] == "none" and h["a"]["dnssec"] is None and h["b"]["dnssec"] is False
    (tmp_path / "x.json").write_text('{"a": 1}')
    assert landed.raw(spark, str(tmp_path / "x.json")).first()["body"] == '{"a": 1}'


def test_catalog(spark):
    s = catalog.Source
    good = [s("a", "A", "discovery"), s("b", "B", "enrichment", costed=True, budget="b"), s("c", "A", "discovery", enabled=False)]
    assert catalog.by_role(catalog.frame(spark, good), "discovery").count() == 1
    for bad in ([s("a", "A", "x"), s("a", "A", "x")], [s("a", "Z", "x")], [s("a", "A", "x", costed=True)], [s("a", "A", "x", ttl_hours=0)]):
        with pytest.raises(ValueError):
            catalog.checked(bad)
