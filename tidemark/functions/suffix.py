"""Registrable domains by public-suffix rules, and hosts in letters of any script. Expressions only.

Rules have the public list's form: ``com``, ``co.uk``, ``*.ck`` (any label below ck), ``!www.ck`` (but not this one). They form a trie of
labels from the right, kept as one set of suffixes for each depth: a host's own suffixes are looked up from the
shortest on, so that a lookup costs as many steps as the deepest rule has labels, whatever the number of rules.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import MULTI_PART_SUFFIXES
from .binding import let
from .url import host_of

#: Rules where none are given: fixed values.
RULES = (*MULTI_PART_SUFFIXES, *"com net org io ai dev *.ck !www.ck *.kawasaki.jp !city.kawasaki.jp *.bd *.er *.mm *.np xn--p1ai xn--80asehdb xn--fiqs8s xn--55qx5d.cn".split())
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"


def unicode_label(label: str) -> str:
    """A rule's label in its own letters."""
    if not label.startswith("xn--"):
        return label
    try:
        return label[4:].encode("ascii").decode("punycode")
    except UnicodeError:
        return label


@dataclass
class Rules:
    """Suffixes in letters by depth: rules, labels under which any label is one, and exceptions from those."""

    exact: dict[int, set[str]] = field(default_factory=dict)
    wild: dict[int, set[str]] = field(default_factory=dict)
    exempt: dict[int, set[str]] = field(default_factory=dict)

    @classmethod
    def of(cls, lines) -> Rules:
        """Rules of the lines of a list; comments (//) and what follows a space are left out."""
        out = cls()
        for line in lines:
            rule = line.split()[0].lower().strip(".") if line.split() and not line.lstrip().startswith("//") else ""
            if not rule:
                continue
            kind = out.exempt if rule[0] == "!" else out.wild if rule.startswith("*.") else out.exact
            labels = [unicode_label(x) for x in rule.removeprefix("!").removeprefix("*.").split(".")]
            kind.setdefault(len(labels), set()).add(".".join(labels))
        return out


def _decoded(label: Column) -> Column:
    """The letters of a label ``xn--...``; null where it isn't well formed."""
    basic, coded = F.regexp_extract(label, "^xn--(.*)-", 1), F.regexp_replace(label, "^xn--(.*-)?", "")
    state = "named_struct('n', {n}, 'i', {i}, 'bias', {bias}, 'out', {out}, 'old', {old}, 'w', {w}, 'k', {k}, 'ok', {ok})".format
    # the bias after a delta: its size, damped, in digits
    damped = "transform(array(IF(s.old = 0, (x.i - s.old) div 700, (x.i - s.old) div 2)), d -> d + d div x.size)[0]"
    halved = f"aggregate(sequence(1, 12), named_struct('d', {damped}, 'k', 0L), (a, r) -> IF(a.d > 455, named_struct('d', a.d div 35, 'k', a.k + 36), a))"
    bias = f"transform(array({halved}), a -> a.k + (36 * a.d) div (a.d + 38))[0]"
    put = "concat(slice(s.out, 1, cast(x.i % x.size AS INT)), array(s.n + x.i div x.size), slice(s.out, cast(x.i % x.size AS INT) + 1, size(s.out)))"
    ends = state(n="s.n + x.i div x.size", i="x.i % x.size + 1", bias=bias, out=put, old="x.i % x.size + 1", w="1L", k="36L", ok="s.n + x.i div x.size < 1114112")
    goes = state(n="s.n", i="x.i", bias="s.bias", out="s.out", old="s.old", w="s.w * (36 - x.t)", k="s.k + 36", ok="x.i < 2147483648 AND s.w < 100000000")
    bad = state(n="s.n", i="0L", bias="s.bias", out="s.out", old="s.old", w="1L", k="36L", ok="false")
    read = f"transform(array(named_struct('i', s.i + d * s.w, 't', greatest(1L, least(26L, s.k - s.bias)), 'size', size(s.out) + 1L)), x -> IF(d < x.t, {ends}, {goes}))[0]"
    start = state(n="128L", i="0L", bias="72L", out="transform(filter(split(l.basic, ''), c -> c != ''), c -> cast(ascii(c) AS BIGINT))", old="0L", w="1L", k="36L", ok="length(l.coded) > 0 AND length(l.basic) = octet_length(l.basic)")
    digits = f"transform(filter(split(l.coded, ''), c -> c != ''), c -> cast(instr('{_DIGITS}', c) - 1 AS BIGINT))"
    last = f"aggregate({digits}, {start}, (s, d) -> IF(NOT s.ok OR d < 0, {bad}, {read}))"
    whole = "IF(s.ok AND s.w = 1 AND s.k = 36 AND NOT exists(s.out, c -> c BETWEEN 55296 AND 57343), decode(unhex(array_join(transform(s.out, c -> lpad(hex(c), 8, '0')), '')), 'UTF-32'), null)"
    one = F.array(F.struct(basic.alias("basic"), coded.alias("coded")))
    return F.get(F.call_function("transform", one, F.expr(f"l -> transform(array({last}), s -> {whole})[0]")), F.lit(0))


def to_unicode(host: Column) -> Column:
    """A host in lower case with its coded labels in their letters; a label that isn't well formed stays as it is."""
    return F.array_join(F.transform(F.split(F.lower(host), r"\."), lambda x: F.when(F.startswith(x, F.lit("xn--")), F.coalesce(_decoded(x), x)).otherwise(x)), ".")


def suffix_labels(labels: Column, rules: Rules) -> Column:
    """How many labels of the host's end are a public suffix: by an exception one less than it has, else by the longest rule, else one."""
    n = F.size(labels)
    tail = lambda k: F.array_join(F.slice(labels, -k, k), ".")
    of = lambda k, names: (n >= k) & tail(k).isin(sorted(names))
    found = [F.when(of(k, x), k) for k, x in rules.exact.items()] + [F.when((n > k) & of(k, x), k + 1) for k, x in rules.wild.items()]
    longest = F.greatest(F.lit(1), F.lit(1), *[F.coalesce(c, F.lit(1)) for c in found])
    for k, x in rules.exempt.items():
        longest = F.when(of(k, x), k - 1).otherwise(longest)
    return longest


def registered_domain(value: Column, rules: Rules | None = None) -> Column:
    """The public suffix of a URL's or host's end with one more label, in letters; null for a suffix alone, addresses and what is no host."""
    rules = Rules.of(RULES) if rules is None else rules

    def of(labels: Column) -> Column:
        whole = F.size(labels) > suffix_labels(labels, rules)
        good = ~F.exists(labels, lambda x: x.rlike(r"^$|[\s:\[\]]")) & ~F.array_join(labels, ".").rlike(r"^[0-9.]+$")
        return F.when(whole & good, let(suffix_labels(labels, rules) + 1, lambda k: F.array_join(F.slice(labels, -k, k), ".")))

    return let(F.split(to_unicode(host_of(value)), r"\."), of)
