"""Quality rules (op 12) by weak supervision. DataFrame functions only.

Each rule reads counts of a text and votes good (1), bad (-1) or abstains (0). No rule has to be passed: expectation
maximisation over the votes of all documents estimates, for every rule, how often it is right about good texts and about bad ones
(of those it votes on), and each text's probability of being good follows from its votes. A rule that says "good" of nearly everything then weighs nothing when it does,
and a rule that hardly ever says "bad" of a good text weighs much when it does. A rule that turns out to say "bad" more often of good texts than
of bad ones counts for nothing.

Every text is read once, by its own task, and leaves counts and votes only. Votes are counted by pattern, of which there are at most
3 ** len(RULES), whatever the input; the rounds of the estimate are one expression over the row that holds them, and the
patterns' probabilities, bounded likewise, are broadcast to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, pick, table

#: Of every text: fewer words, or a larger percentage of words in repeated windows, and it fails whatever the rules say.
MIN_WORDS, MAX_REPEAT = 50, 50
#: A text is kept from this probability on.
KEEP = 0.5
ROUNDS = 25
#: Before the first round: share of good texts, share of good texts that a rule calls good, share of bad ones that it calls bad.
#: Every round adds texts that fit these shares: one, and one more for each PRIOR of all texts. So a rule that fires for one kind of
#: bad texts keeps its weight while another kind is the most frequent.
START, PRIOR = (0.9, 0.95, 0.5), 100
#: Common function words of four languages.
FUNCTION_WORDS = (
    "the be to of and that have with is in for was not are but from this which "
    "de la que el en los se las por con una "
    "le les et des un une du est dans pour qui "
    "der die und das ist den nicht mit von ein"
).split()
_SPACE = r"[\x20\x09-\x0D]+"
#: (name, votes good if, votes bad if), each over counts of the text; where neither holds it abstains.
RULES = [
    ("word_length", "word_chars BETWEEN 3 * n_words AND 10 * n_words", "n_words > 0 AND word_chars NOT BETWEEN 3 * n_words AND 10 * n_words"),
    ("symbols", "100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    ("repeats", "10 * n_repeat_words <= n_words", "10 * n_repeat_words > 3 * n_words"),
    ("lines", "n_lines >= 3 AND n_dup_lines = 0", "10 * n_dup_lines > 3 * n_lines"),
    ("capitals", "n_letters > 0 AND 10 * n_capitals <= n_letters", "10 * n_capitals > 3 * n_letters"),
    ("letters", "10 * n_letter_words >= 9 * n_words", "10 * n_letter_words < 8 * n_words"),
    ("function_words", "20 * n_function_words >= n_words", "50 * n_function_words < n_words"),
    ("sentences", "100 * n_ends >= 2 * n_words", "200 * n_ends < n_words"),
    ("exclamations", "false", "10 * n_exclamations > n_words"),
    ("variety", "n_distinct * n_distinct >= 25 * n_words", "n_distinct * n_distinct < 9 * n_words"),
]
PATTERNS = 3 ** len(RULES)


def _without(text: Column, kept: str) -> Column:
    """Characters of ``text`` that the class ``kept`` holds."""
    return F.char_length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


#: A window's key: the place of its first word in the low bits, its hash in the others.
_PLACE = 31


def _keys(w: Column) -> Column:
    """The keys of all three-word windows of the list ``w``, sorted as longs."""
    at = lambda i, k: F.get(w, i + k)
    key = lambda i: F.shiftleft(F.xxhash64(at(i, 0), at(i, 1), at(i, 2)), _PLACE).bitwiseOR(i.cast("long"))
    return F.sort_array(F.transform(F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>")), key))


def _alike(keys: Column) -> Column:
    """The places of windows whose hash stands twice or more among the sorted ``keys``: few, and all that can be equal."""
    high = lambda x: F.shiftright(x, _PLACE)
    twice = F.filter(keys, lambda x, j: F.coalesce(high(x) == high(F.get(keys, j + 1)), F.lit(False)) | F.coalesce(high(x) == high(F.get(keys, j - 1)), F.lit(False)))
    return F.transform(twice, lambda x: x.bitwiseAND(F.lit((1 << _PLACE) - 1)).cast("int"))


def _repeated(w: Column, places: Column) -> Column:
    """Words of those windows at ``places`` in ``w`` whose words stand twice or more, compared as they are."""
    window = lambda i: F.struct(*[F.get(w, i + k).alias(c) for k, c in enumerate("abc")], i.alias("i"))
    equal = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
    # a list of one is a name for its element: the windows are sorted once a text
    found = F.transform(F.array(F.sort_array(F.transform(places, window))), lambda s: F.transform(F.filter(s, lambda x, j: equal(x, F.get(s, j + 1)) | equal(x, F.get(s, j - 1))), lambda x: x["i"]))
    words = F.flatten(F.transform(F.get(found, F.lit(0)), lambda i: F.array(i, i + 1, i + 2)))
    return F.size(F.array_distinct(words)).cast("long")


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules read, of every row of ``docs`` (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    d = pick(docs, "doc_id", "text").select("doc_id", text.alias("text"))
    d = d.select("doc_id", "text", F.filter(F.split("text", _SPACE), lambda x: x != "").alias("w"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    d = d.withColumn("keys", _keys(F.col("w"))).withColumn("places", _alike(F.col("keys"))).drop("keys")
    size = lambda c: F.size(c).cast("long")
    t = F.col("text")
    return d.select(
        "doc_id",
        size(F.col("w")).alias("n_words"),
        F.char_length(F.regexp_replace(t, _SPACE, "")).cast("long").alias("word_chars"),
        _without(t, "#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("w"), F.col("places")).alias("n_repeat_words"),
        size(F.col("lines")).alias("n_lines"),
        _without(t, r"\p{L}").alias("n_letters"),
        _without(t, r"\p{Lu}").alias("n_capitals"),
        size(F.filter("w", lambda x: x.rlike(r"\p{L}"))).alias("n_letter_words"),
        size(F.filter("w", lambda x: F.lower(x).isin(FUNCTION_WORDS))).alias("n_function_words"),
        _without(t, r".?…").alias("n_ends"),
        _without(t, "!").alias("n_exclamations"),
        size(F.array_distinct("w")).alias("n_distinct"),
    )


def _votes() -> Column:
    """The rules' votes as one number: a digit 0 (bad), 1 (abstains) or 2 (good) a rule, the first rule's lowest."""
    digits = [F.when(F.expr(bad), 0).when(F.expr(good), 2).otherwise(1) * 3**i for i, (_, good, bad) in enumerate(RULES)]
    return sum(digits[1:], digits[0]).cast("int")


def _estimate() -> tuple[str, str]:
    """SQL over ``patterns``, a list of (v: votes by rule, n: texts): the estimate after all rounds, and by the estimate ``s`` a pattern ``x``'s probability of being good.

    The estimate is (p: share of good texts; g, b: by rule, how often it is right about good and about bad texts); ``k`` is the number
    of texts added that fit START, so that none is ever 0 or 1.
    """
    n = len(RULES)
    p, g, b = START
    log_odds = f"""aggregate(sequence(0, {n - 1}), ln(s.p / (1 - s.p)),
        (a, r) -> a + CASE x.v[r] WHEN 1 THEN ln(s.g[r] / (1 - s.b[r])) WHEN -1 THEN ln((1 - s.g[r]) / s.b[r]) ELSE 0D END)"""
    good = f"1 / (1 + exp(-{log_odds}))"
    shared = f"transform(patterns, x -> transform(array({good}), q -> named_struct('v', x.v, 'g', x.n * q, 'b', x.n * (1 - q)))[0])"
    total = lambda of, vote, share: f"aggregate(e, k * {share:.3}D, (a, x) -> a + IF(x.v[r] = {vote}, x.{of}, 0D))"
    sums = f"transform(sequence(0, {n - 1}), r -> named_struct('gg', {total('g', 1, g)}, 'gb', {total('g', -1, 1 - g)}, 'bg', {total('b', 1, 1 - b)}, 'bb', {total('b', -1, b)}))"
    # right about neither more often than a coin: the rule's votes say the same of good and of bad texts
    split = """named_struct('g', IF(t.gg * t.bb < t.gb * t.bg, (t.gg + t.bg) / (t.gg + t.gb + t.bg + t.bb), t.gg / (t.gg + t.gb)),
        'b', IF(t.gg * t.bb < t.gb * t.bg, (t.gb + t.bb) / (t.gg + t.gb + t.bg + t.bb), t.bb / (t.bg + t.bb)))"""
    both = lambda of, share: f"aggregate(e, k * {share:.3}D, (a, x) -> a + x.{of})"
    step = f"""transform(array({shared}), e -> transform(array(transform({sums}, t -> {split})),
        m -> named_struct('p', {both("g", p)} / ({both("g", p)} + {both("b", 1 - p)}), 'g', transform(m, t -> t.g), 'b', transform(m, t -> t.b)))[0])[0]"""
    start = f"named_struct('p', {p}D, 'g', array_repeat({g}D, {n}), 'b', array_repeat({b}D, {n}))"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, i) -> {step})", good


def posteriors(voted: DataFrame) -> DataFrame:
    """votes, posterior: of each pattern of votes in ``voted`` (votes: as numbered by the rules) the probability that its texts are good."""
    digits = F.array(*[(F.floor(F.col("votes") / 3**i) % 3 - 1).cast("int") for i in range(len(RULES))])
    seen = voted.groupBy("votes").agg(F.count("*").cast("double").alias("n")).select("votes", digits.alias("v"), "n")
    one = seen.agg(F.sort_array(F.collect_list(F.struct("votes", "v", "n"))).alias("patterns"))
    estimate, good = _estimate()
    one = one.withColumn("k", F.expr(f"aggregate(patterns, 1D, (a, x) -> a + x.n / {PRIOR})")).select("patterns", F.expr(estimate).alias("s"))
    return one.selectExpr("s", "explode(patterns) AS x").selectExpr("x.votes AS votes", f"{good} AS posterior")


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, votes, posterior, kept for every row of ``docs`` (doc_id, text).

    Null and empty texts, and texts of white space, hold no word and fail; what fails still votes in the estimate. Repeated rows are
    judged and counted each, and alike; null ids stay null. A very long text is one task's work, its words and windows held in
    memory (some 20 times its size). Other columns play no part, whatever their names; an empty table gives no rows.
    """
    c = counts(docs)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    voted = cut(c.withColumns({"base_failed": failed, "votes": _votes()}), "votes")
    judged = voted.join(F.broadcast(cut(posteriors(voted), "posteriors")), "votes")  # at most PATTERNS rows
    return judged.select(*voted.columns, "posterior", (~F.col("base_failed") & (F.col("posterior") >= KEEP)).alias("kept"))


def op12_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_verdicts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    """The same with windows counted by grouping, and rounds that are queries."""
    listed = ", ".join(f"'{w}'" for w in FUNCTION_WORDS)
    no = lambda kept: f"length(regexp_replace(t, '[^{kept}]+', '', 'g'))"
    rules = [f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END" for _, good, bad in RULES]
    p, g, b = START
    n = len(RULES)
    steps = [f"m0 AS MATERIALIZED (SELECT {p}::DOUBLE AS p, {[g] * n}::DOUBLE[] AS g, {[b] * n}::DOUBLE[] AS b)"]

    def shared(k: int) -> str:
        odds = " + ".join(f"CASE v[{r}] WHEN 1 THEN ln(g[{r}] / (1 - b[{r}])) WHEN -1 THEN ln((1 - g[{r}]) / b[{r}]) ELSE 0 END" for r in range(1, n + 1))
        return f"SELECT v, n, 1 / (1 + exp(-(ln(p / (1 - p)) + {odds}))) AS q FROM pat CROSS JOIN m{k}"

    for k in range(ROUNDS):
        steps.append(f"q{k} AS MATERIALIZED ({shared(k)})")
        kinds = (("gg", "n * q", 1, g), ("gb", "n * q", -1, 1 - g), ("bg", "n * (1 - q)", 1, 1 - b), ("bb", "n * (1 - q)", -1, b))
        cells = ", ".join(f"(1 + sum(n) / {PRIOR}) * {share:.3}::DOUBLE + coalesce(sum({of}) FILTER (v[{r}] = {vote}), 0) AS {name}{r}" for r in range(1, n + 1) for name, of, vote, share in kinds)
        odd = lambda r: f"gg{r} * bb{r} < gb{r} * bg{r}"
        every = lambda r: f"(gg{r} + gb{r} + bg{r} + bb{r})"
        gs = ", ".join(f"CASE WHEN {odd(r)} THEN (gg{r} + bg{r}) / {every(r)} ELSE gg{r} / (gg{r} + gb{r}) END" for r in range(1, n + 1))
        bs = ", ".join(f"CASE WHEN {odd(r)} THEN (gb{r} + bb{r}) / {every(r)} ELSE bb{r} / (bg{r} + bb{r}) END" for r in range(1, n + 1))
        steps.append(f"m{k + 1} AS MATERIALIZED (SELECT p, [{gs}] AS g, [{bs}] AS b FROM (SELECT ({p}::DOUBLE * (1 + sum(n) / {PRIOR}) + sum(n * q)) / (1 + sum(n) / {PRIOR} + sum(n)) AS p, {cells} FROM q{k}))")
    return f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
tri AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM d CROSS JOIN LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
twice AS (SELECT r, i FROM tri QUALIFY count(*) OVER (PARTITION BY r, a, b, c) > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice CROSS JOIN range(3) AS o(k) GROUP BY r),
f AS MATERIALIZED (
  SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(list_sum(list_transform([''] || w, lambda x: length(x))) AS BIGINT) AS word_chars, {no("#*$%&|<>")} AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines, {no("\\p{L}")} AS n_letters, {no("\\p{Lu}")} AS n_capitals,
    len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_letter_words, len(list_filter(w, lambda x: lower(x) IN ({listed}))) AS n_function_words,
    length(regexp_replace(t, '[^.?…]+', '', 'g')) AS n_ends, {no("!")} AS n_exclamations, len(list_distinct(w)) AS n_distinct
  FROM d LEFT JOIN rep USING (r)),
x AS MATERIALIZED (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed, [{", ".join(rules)}] AS v FROM f),
pat AS MATERIALIZED (SELECT v, CAST(count(*) AS DOUBLE) AS n FROM x GROUP BY v),
{", ".join(steps)},
post AS ({shared(ROUNDS)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND q >= {KEEP} AS kept FROM x JOIN post USING (v)"""


OP12_SQL = _sql()
