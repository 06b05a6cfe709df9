"""Public-suffix rules against a plain search of the rules, labels against Python's codec."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import suffix

LIST = """// a list as it is published
com
co.uk
uk
*.ck
!www.ck
*.compute.example.com   // what follows a space is left out
!free.compute.example.com
jp
*.kawasaki.jp
!city.kawasaki.jp
xn--p1ai
бг.рф
"""


def brute(host, rules):
    labels = host.split(".")
    if len(labels) < 1 or "" in labels:
        return None
    found, out = [1], None
    for rule in rules:
        parts = rule.lstrip("!").split(".")
        end = labels[-len(parts) :]
        if len(end) == len(parts) and all(p in ("*", x) for p, x in zip(parts, end, strict=True)):
            if rule[0] == "!":
                out = len(parts) - 1
            else:
                found.append(len(parts))
    n = out if out is not None else max(found)
    return ".".join(labels[-(n + 1) :]) if len(labels) > n else None


def test_rules(spark):
    rng = random.Random(2)
    rules = ["com", "co.uk", "uk", "*.ck", "!www.ck", "*.compute.example.com", "!free.compute.example.com", "jp", "*.kawasaki.jp", "!city.kawasaki.jp", "рф", "бг.рф"]
    pool = "com co uk ck www compute example free jp kawasaki city рф бг a b".split()
    hosts = sorted({".".join(rng.choice(pool) for _ in range(rng.randint(1, 6))) for _ in range(600)})
    df = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", suffix.registered_domain(F.col("h"), suffix.Rules.of(LIST.splitlines())).alias("d"))
    assert {r["h"]: r["d"] for r in df.collect()} == {h: brute(h, rules) for h in hosts}


@pytest.mark.parametrize("value,want", [
    (None, None), ("", None), ("https://Sub.Example.co.uk:99/x?y#z", "example.co.uk"), ("//u:p@a.b.com/", "b.com"), ("10.1.2.3", None), ("http://[::1]/", None), ("two words.com", None),
    ("a..com", None), ("xn--bcher-kva.com", "bücher.com"), ("BÜCHER.com", "bücher.com"), ("xn--zzzzzzzzzzzzz9.com", "xn--zzzzzzzzzzzzz9.com"), ("x.xn--p1ai", "x.рф"), ("com", None),
])
def test_values(spark, value, want):
    got = spark.createDataFrame([(value,)], "v string").select(suffix.registered_domain(F.col("v"), suffix.Rules.of(LIST.splitlines()))).first()[0]
    assert got == want


def test_labels_against_the_codec(spark):
    rng = random.Random(3)
    letters = "abcz09-éüßжя中日本🙂𝔘"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 24))) for _ in range(400)]
    good = [("xn--" + w.encode("punycode").decode(), w) for w in words if any(c > "\x7f" for c in w)]
    odd = ["xn--" + "".join(rng.choice("abcxyz0189-!é") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    for x in odd:
        try:
            w = x[4:].encode("ascii").decode("punycode")
            w.encode("utf-8")
            ok = x[4:].rpartition("-")[2] and not x[4:].startswith("-")
        except UnicodeError:
            ok = False
        if not ok:
            good.append((x, None))
    got = {r["l"]: r["u"] for r in spark.createDataFrame([(x,) for x, _ in good], "l string").select("l", suffix.to_unicode(F.col("l")).alias("u")).collect()}
    for x, w in good:
        if w is not None:
            assert got[x] == w.lower()
        elif "!" in x.rpartition("-")[2] or "é" in x or x == "xn--":
            assert got[x] == x  # what isn't well formed stays as it is


def test_no_python_in_plan(spark):
    df = spark.createDataFrame([("a.com",)], "v string").select(suffix.registered_domain(F.col("v")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
