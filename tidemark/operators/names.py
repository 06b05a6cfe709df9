"""The name-similarity join: all pairs of names whose ratio reaches a threshold, by rare grams in common.

A ratio of at least t percent allows D = (1 - t / 100) * (|a| + |b|) characters outside of a longest common
subsequence, Da of them in a and Db in b, with |b| - |a| = Db - Da. A gram of two characters of a is lost only if
one of its characters is (two grams each) or if something stands between them in b (one gram each): at most
2 Da + Db grams of a, and 2 Db + Da of b, have no partner. Order all grams by how rare they are, those of one name by
place too: partners come in one order on both sides, so the first K pairs of partners lie
among the first 2 Da + Db + K grams of a and the first 2 Db + Da + K of b. The join is on K grams in that order, with the
places that their partners can have; common grams are met only where a name has no others. Names too short for K pairs
of grams go by single characters, of which at most Da and Db are lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import normalize_name
from .graph import cut

#: Grams are ordered by the number of names in their bucket of so many: the bound on the table that is broadcast.
BUCKETS = 1 << 16
#: (length of a gram, grams of a key): the first that a pair's lengths allow is used.
SCHEMES = [(2, 2), (1, 3), (1, 2), (1, 1)]
#: Longest name whose characters fit one machine word.
WORD = 64


def indel_ratio(a: str, b: str) -> float:
    """2 LCS / (|a| + |b|) in percent, by bit-parallel longest common subsequence."""
    if not a or not b:
        return 0.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    lcs = len(a) - s.bit_count()
    return 200.0 * lcs / (len(a) + len(b))


def _characters(names: list[str], pad: int):
    width = max(map(len, names))
    x = np.array(names, f"<U{width}").view("<u4").reshape(len(names), width).copy()
    n = np.fromiter(map(len, names), np.int64, len(names))
    x[np.arange(width) >= n[:, None]] = pad
    return x, n


def indel_ratios(a: list[str], b: list[str]):
    """``indel_ratio`` of each pair, a block of pairs at once: the subsequence's bits are one word a pair."""
    out = np.zeros(len(a))
    short = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x and y and len(x) <= WORD]
    short.sort(key=lambda i: len(b[i]))
    held = set(short)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if i not in held:
            out[i] = indel_ratio(x, y)
    for k in range(0, len(short), 4096):
        at = short[k : k + 4096]
        (x, n), (y, m) = _characters([a[i] for i in at], 0xFFFFFFFF), _characters([b[i] for i in at], 0xFFFFFFFE)
        wide = np.full((len(at), WORD), 0xFFFFFFFF, np.uint32)
        wide[:, : x.shape[1]] = x
        full = np.full(len(at), (1 << 64) - 1, np.uint64) >> (WORD - n).astype(np.uint64)
        s = full.copy()
        for j in range(y.shape[1]):
            u = s & np.packbits(wide == y[:, j, None], axis=1, bitorder="little").view("<u8")[:, 0]
            s = ((s + u) | (s - u)) & full
        out[at] = 200.0 * (n - np.bitwise_count(s)) / (n + m)
    return out


@F.pandas_udf(DoubleType())
def name_similarity(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in parts:
        x, y = a.fillna("").tolist(), b.fillna("").tolist()
        equal = np.fromiter((p == q and p != "" for p, q in zip(x, y, strict=True)), bool, len(x))
        yield pd.Series(np.where(equal, 100.0, indel_ratios(x, y)))


def lost(a: int, b: int, share: float) -> tuple[int, int] | None:
    """Of names of ``a`` <= ``b`` characters that are alike: how many have no partner on either side at most; None if no two such are alike."""
    d = int(share * (a + b) + 1e-9)
    return None if d < b - a else ((d - (b - a)) // 2, (d - (b - a)) // 2 + b - a)


def prefixes(lengths: list[int], share: float) -> list[tuple[int, bool, int, int, int]]:
    """(length, shorter, gram, grams of a key, prefix) for names of these lengths: in each role and scheme, among how many of its first grams
    the partners lie, whichever of the lengths the other name has."""
    most: dict[tuple[int, bool, int, int], int] = {}
    for a in lengths:
        for b in lengths:
            if a > b or (gone := lost(a, b, share)) is None:
                continue
            da, db = gone
            for q, k in SCHEMES:
                la, lb = ((2 * da + db, 2 * db + da) if q == 2 else (da, db))
                if a - q + 1 - la >= k:
                    for key, n in (((a, True, q, k), la + k), ((b, False, q, k), lb + k)):
                        most[key] = max(most.get(key, 0), n)
                    break
    return [(*key, n) for key, n in sorted(most.items())]


def _keys(grams: Column, k: int) -> Column:
    """All choices of ``k`` of the list ``grams`` (gram, at), in its order: (key, places)."""
    found = F.transform(grams, lambda g, i: F.struct(i.alias("i"), F.xxhash64(F.lit(k), g["gram"]).alias("key"), F.array(g["at"]).alias("at")))
    for _ in range(k - 1):
        later = lambda c: F.filter(F.transform(grams, lambda g, i: F.struct(i.alias("i"), F.xxhash64(c["key"], g["gram"]).alias("key"), F.concat(c["at"], F.array(g["at"])).alias("at"))), lambda x: x["i"] > c["i"])
        found = F.flatten(F.transform(found, later))
    return found


def keyed(points: DataFrame, share: float) -> DataFrame:
    """The keys of ``points`` (id, n): id, len, shorter, key, at (places of the key's grams)."""
    spark = points.sparkSession
    sized = points.select("id", "n", F.length("n").alias("len"))
    lengths = sorted(r["len"] for r in sized.select("len").distinct().collect())  # at most one a length
    plan = prefixes(lengths, share)
    if not plan:
        return spark.createDataFrame([], f"id {points.schema['id'].dataType.simpleString()}, len int, shorter boolean, key long, at array<int>")
    plans = spark.createDataFrame(plan, "len int, shorter boolean, q int, k int, prefix int")
    used = plans.select("len", "q").distinct()
    gram = F.transform(F.sequence(F.lit(1), F.col("len") - F.col("q") + 1), lambda i: F.struct(F.substring(F.col("n"), i, F.col("q")).alias("gram"), i.alias("at")))
    grams = sized.join(F.broadcast(used), "len").select("id", "len", "q", F.inline(gram))
    grams = cut(grams.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")), "grams")
    rare = grams.groupBy("q", "bucket").agg(F.count("*").alias("f"))
    ordered = grams.join(F.broadcast(rare), ["q", "bucket"]).groupBy("id", "len", "q").agg(F.sort_array(F.collect_list(F.struct("f", "gram", "at"))).alias("grams"))
    ready = ordered.join(F.broadcast(plans), ["len", "q"]).withColumn("grams", F.slice("grams", 1, F.col("prefix")))
    each = [ready.where(F.col("k") == k).select("id", "len", "shorter", F.inline(F.transform(_keys(F.col("grams"), k), lambda c: F.struct(c["key"], c["at"])))) for k in sorted({p[3] for p in plan})]
    return reduce(DataFrame.unionByName, each)


def candidates(points: DataFrame, share: float) -> DataFrame:
    """Pairs (a, b) of ids of ``points`` (id, n) that share a key at places that partners can have: all pairs that are alike, and some others."""
    keys = cut(keyed(points, share), "keys")
    a = keys.where("shorter").select("key", F.col("id").alias("a"), F.col("len").alias("la"), F.col("at").alias("pa"))
    b = keys.where("NOT shorter").select("key", F.col("id").alias("b"), F.col("len").alias("lb"), F.col("at").alias("pb"))
    allowed = F.floor(share * (F.col("la") + F.col("lb")) + 1e-9)
    delta = F.col("lb") - F.col("la")
    fewer = F.floor((allowed - delta) / 2)
    moved = lambda i: F.get("pb", F.lit(i)) - F.get("pa", F.lit(i))
    near = reduce(Column.__and__, [F.coalesce(moved(i).between(-fewer, fewer + delta), F.lit(True)) for i in range(3)])
    return a.join(b, "key").where((F.col("la") <= F.col("lb")) & (allowed >= delta) & ((F.col("la") < F.col("lb")) | (F.col("a") < F.col("b"))) & near).select("a", "b").distinct()


def name_pairs(names: DataFrame, threshold: float = 92.0, normalized: bool = False) -> DataFrame:
    """Pairs (a_id, b_id, score) of distinct normalized names whose ratio reaches ``threshold`` (over 50), with no country in conflict.

    ``names``: id, name, country. Names are one point per normalized form and country. Equal names link by a star to the smallest
    id. ``normalized``: the names are in that form.
    """
    if not 50 < threshold <= 100:
        raise ValueError("a threshold over 50 and up to 100")
    norm = names.select("id", (F.col("name") if normalized else normalize_name(F.col("name"))).alias("n"), F.coalesce("country", F.lit("")).alias("c")).where("n <> ''")
    points = cut(norm.groupBy("n", "c").agg(F.min("id").alias("id")), "points")
    # names of one form are alike whatever their countries: one point stands for the form in the join, and countries are compared behind it
    forms = points.groupBy("n").agg(F.min("id").alias("id"))
    found = candidates(forms, 1 - threshold / 100)
    text = forms.select(F.col("id").alias("form"), "n")
    named = found.join(text.toDF("a", "x"), "a").join(text.toDF("b", "y"), "b").select("x", "y")
    scored = named.withColumn("score", name_similarity("x", "y")).where(F.col("score") >= threshold)
    side = lambda n, c, i: points.select(F.col("n").alias(n), F.col("c").alias(c), F.col("id").alias(i))
    guard = (F.col("ca") == "") | (F.col("cb") == "") | (F.col("ca") == F.col("cb"))
    pair = [F.least("ida", "idb").alias("a_id"), F.greatest("ida", "idb").alias("b_id")]
    pairs = scored.join(side("x", "ca", "ida"), "x").join(side("y", "cb", "idb"), "y").where(guard).select(*pair, "score")
    # one form in several countries: none is in conflict with all
    whole = side("x", "ca", "ida").where("ca = ''").join(side("x", "cb", "idb").where("cb <> ''"), "x").select(*pair, F.lit(100.0).alias("score"))
    first = norm.join(points.select("n", "c", F.col("id").alias("first")), ["n", "c"]).where(F.col("id") != F.col("first"))
    return pairs.unionByName(whole).unionByName(first.select(F.col("first").alias("a_id"), F.col("id").alias("b_id"), F.lit(100.0).alias("score")))
