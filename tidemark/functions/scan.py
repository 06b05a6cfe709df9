"""Patterns tried only where a text holds one of their words: one automaton finds the words of all patterns in one pass.

The automaton is built once a worker and runs over Arrow batches; of a text without a word nothing more is done. Patterns are read as
they are by the engines: letters, blanks and word bounds of ASCII.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .. import config as C


@cache
def _automaton():
    """The words of all patterns, each with the numbers of the patterns that it tells of."""
    import ahocorasick

    of: dict[str, set[int]] = {}
    for i, (name, _) in enumerate(C.INJECTION_PATTERNS):
        for w in C.INJECTION_WORDS[name]:
            of.setdefault(w, set()).add(i)
    found = ahocorasick.Automaton()
    for w, own in of.items():
        found.add_word(w, tuple(sorted(own)))
    found.make_automaton()
    return found


@cache
def _patterns() -> list[tuple[str, re.Pattern]]:
    return [(name, re.compile(p, re.ASCII)) for name, p in C.INJECTION_PATTERNS]


def reasons(text: str | None) -> list[str]:
    """Names of the patterns that a text matches, in their order."""
    if not text:
        return []
    maybe = {i for _, own in _automaton().iter(text.lower()) for i in own}
    return [name for i, (name, p) in enumerate(_patterns()) if i in maybe and p.search(text)]


@F.pandas_udf(ArrayType(StringType()))
def injection_reasons(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series([reasons(t) for t in s], dtype=object)
