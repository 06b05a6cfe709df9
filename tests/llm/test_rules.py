"""Op 12 against plain Python: counts of whole texts, and the estimate over all votes."""

import math
import re
from collections import Counter

from tidemark.llm import rules

KIND = "doc_id long, text string, lang string, TEXT string, w string, votes int, patterns string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(windows)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_lines": len(lines),
        "n_repeat_words": len({i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)}), "n_letters": sum(c.isalpha() for c in text), "n_capitals": sum(c.isupper() for c in text),
        "n_letter_words": sum(any(c.isalpha() for c in x) for x in w), "n_function_words": sum(x.lower() in rules.FUNCTION_WORDS for x in w), "n_ends": sum(c in ".?…" for c in text),
        "n_exclamations": text.count("!"), "n_distinct": len(set(w)),
    }


def votes(c):
    """The rules in Python: their conditions are comparisons that both languages read alike."""
    python = lambda s: s.replace(" AND ", " and ").replace(" = ", " == ")
    between = re.compile(r"(\w+) (NOT )?BETWEEN (\S+ \* \w+) and (\S+ \* \w+)")
    said = []
    for _, good, bad in rules.RULES:
        good, bad = (between.sub(lambda m: f"{'not ' if m[2] else ''}({m[3]} <= {m[1]} <= {m[4]})", python(x)) for x in (good, bad))
        said.append(-1 if eval(bad, {}, c) else 1 if good != "false" and eval(good, {}, c) else 0)
    return tuple(said)


def estimate(texts):
    """Posterior by pattern of votes."""
    seen = Counter(votes(counted(t)) for t in texts)
    p0, g0, b0 = rules.START
    k = 1 + len(texts) / rules.PRIOR
    p, g, b = p0, [g0] * len(rules.RULES), [b0] * len(rules.RULES)

    def good(v):
        odds = math.log(p / (1 - p)) + sum(math.log(g[r] / (1 - b[r])) if x == 1 else math.log((1 - g[r]) / b[r]) if x == -1 else 0 for r, x in enumerate(v))
        return 1 / (1 + math.exp(-odds))

    for _ in range(rules.ROUNDS):
        q = {v: good(v) for v in seen}
        p = (k * p0 + sum(n * q[v] for v, n in seen.items())) / (k + len(texts))
        for r in range(len(rules.RULES)):
            gg, gb = (k * s + sum(n * q[v] for v, n in seen.items() if v[r] == x) for s, x in ((g0, 1), (1 - g0, -1)))
            bg, bb = (k * s + sum(n * (1 - q[v]) for v, n in seen.items() if v[r] == x) for s, x in ((1 - b0, 1), (b0, -1)))
            g[r], b[r] = gg / (gg + gb), bb / (bg + bb)
            if gg * bb < gb * bg:
                g[r], b[r] = (gg + bg) / (gg + gb + bg + bb), (gb + bb) / (gg + gb + bg + bb)
    return {v: good(v) for v in seen}


PROSE = "The river was wide and the boats that came from the north were slow.\nMany people waited on the shore for news of the harvest, which had been poor.\nNobody knew what the winter would bring to them. "
TEXTS = (
    [(i, PROSE + " ".join(f"word{i}{k}" for k in range(40)) + ".") for i in range(30)]
    + [(100 + i, " ".join(f"w{i}x{k}***" for k in range(80))) for i in range(3)]
    + [(200 + i, "\n".join(["BUY NOW!! CHEAP!!"] * 30) + f" {i}") for i in range(2)]
    + [(300, None), (301, ""), (302, " \t\n\x0b\x0c\r "), (303, "one two"), (304, "a b c a b c a"), (305, "x\n\nx\n y\nx \nx"), (306, "ein wort und wieder é̂ 日本語 𝔘𝔫"), (307, "a\x0bb\x1cc"), (None, PROSE), (None, PROSE), (0, PROSE)]
    + [(400, "very long " * 40_000), (401, " ".join(f"t{k % 997}" for k in range(30_000))), (402, " ".join(f"u{k}" for k in range(20_000)))]
)


def test_against_plain_python(spark):
    df = spark.createDataFrame([(i, t, "en", "other", "w", 7, "p") for i, t in TEXTS], KIND)
    got = rules.quality_verdicts(df).collect()
    assert len(got) == len(TEXTS)
    want = [counted(t) for _, t in TEXTS]
    post = estimate([t for _, t in TEXTS])
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    names = list(want[0])
    rows = sorted(((r["doc_id"], *(r[n] for n in names), r["base_failed"], round(r["posterior"], 9), r["kept"]) for r in got), key=key)
    plain = []
    for (i, _), c in zip(TEXTS, want, strict=True):
        failed, q = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"], post[votes(c)]
        plain.append((i, *(c[n] for n in names), failed, round(q, 9), not failed and q >= 0.5))
    assert rows == sorted(plain, key=key)
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert set(range(30)) <= kept and not kept & {100, 101, 102, 200, 201, 300, 400}


def test_equal_hashes_decide_nothing(spark, monkeypatch):
    """With a hash of two bits nearly all windows look alike: words decide."""
    monkeypatch.setattr(rules, "_PLACE", 62)
    df = spark.createDataFrame([(i, t, "en", "o", "w", 7, "p") for i, t in TEXTS if i in (304, 305, 5, 100)], KIND)
    from pyspark.sql import functions as F

    monkeypatch.setattr(rules, "_alike", lambda keys: F.transform(keys, lambda x: x.bitwiseAND(F.lit((1 << 62) - 1)).cast("int")))
    got = {r["doc_id"]: r["n_repeat_words"] for r in rules.counts(df).collect()}
    assert got == {i: counted(t)["n_repeat_words"] for i, t in TEXTS if i in got}


def test_no_rows(spark):
    assert rules.quality_verdicts(spark.createDataFrame([], KIND)).count() == 0


def test_no_python_in_plan(spark):
    df = spark.createDataFrame([(1, PROSE, "en", "o", "w", 7, "p")], KIND)
    for d in (rules.counts(df), rules.quality_verdicts(df), rules.posteriors(rules.counts(df).withColumn("votes", rules._votes()))):
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_good_rows_stay(spark, data_dir):
    """Of labelled rows that pass the base nearly all good ones are kept and most bad ones go."""
    found = rules.op12_weak_supervision(spark, data_dir).join(spark.read.parquet(f"{data_dir}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    good, bad = [r["kept"] for r in found if r["quality"]], [r["kept"] for r in found if not r["quality"]]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_against_sql(spark, duck, same, data_dir):
    same(rules.op12_weak_supervision(spark, data_dir).toPandas(), duck.sql(rules.OP12_SQL).df())
