"""Order-dependent state machines: one transition function each, used in batch and on streams.

In batch a key's rows are folded in order, in Arrow batches of rows sorted by (key, time): a key may hold any number of
rows, as only its state is held. On streams the same function runs in ``transformWithStateInPandas``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..config import BREAKER_FAILURES, BREAKER_SECONDS, HYSTERESIS, THERMAL_BANDS


def governor(state: str | None, temp: float | None, undervoltage: bool) -> str:
    """The next thermal state: up at once, down only past the hysteresis; no reading never looks cool."""
    now = state or "nominal"
    if undervoltage:
        return "throttled"
    if temp is None or temp != temp:
        return {"throttled": "hot"}.get(now, now)
    held = [name for name, (begins, holds) in THERMAL_BANDS.items() if temp >= begins - (HYSTERESIS if now in holds else 0.0)]
    return held[-1] if held else "nominal"


def breaker(state: tuple[str, int, float] | None, at: float, ok: bool, threshold: int = BREAKER_FAILURES,
    cooldown: float = BREAKER_SECONDS) -> tuple[tuple[str, int, float], bool]:
    """A call at ``at`` with outcome ``ok``, if let through: ((state, failures, opened at), was it let through).

    Closed lets calls through; ``threshold`` failures in a row open it; past the cooldown one call probes, and its
    outcome closes it or opens it anew.
    """
    name, failures, opened = state or ("closed", 0, 0.0)
    if name == "open" and at - opened < cooldown:
        return (name, failures, opened), False
    if ok:
        return ("closed", 0, 0.0), True
    if name == "open":
        return ("open", failures, at), True
    failures += 1
    return ("open", failures, at) if failures >= threshold else ("closed", failures, 0.0), True


def budget(state: list[tuple[int, float]] | None, hour: int, units: float, soft_cap: float, hours: int) -> tuple[list[tuple[int, float]], bool]:
    """Reserve ``units`` in the rolling window if the soft cap allows; a refused request spends nothing. State: (hour, units) of each grant of the window."""
    held = [(h, u) for h, u in state or [] if h > hour - hours]
    ok = _added(held) + units <= soft_cap
    return [*held, (hour, units)] if ok else held, ok


def _added(held: Iterable[tuple[int, float]]) -> float:
    """The units of grants, added one by one in their order as SQL does: ``sum`` compensates, and rounds to another side of the cap."""
    total = 0.0
    for _, u in held:
        total += u
    return total


def fold(rows: DataFrame, key: str, order: list[str], step: Callable[..., tuple[Any, tuple]], out: str, columns: list[str]) -> DataFrame:
    """Fold each key's rows in order: ``step(state, key, *columns) -> (state, output row)``; ``out`` is the output's schema.

    A key's rows lie in one partition, in order; only its state is held, and rows are read column by column.
    """
    names = list(dict.fromkeys([key, *order, *columns]))
    dealt = rows.select(*names).repartition(key).sortWithinPartitions(key, *order)
    arrow = to_arrow_schema(_parse_datatype_string(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for b in batches:
            made = []
            for own, *values in zip(b.column(key).to_pylist(), *(b.column(c).to_pylist() for c in columns), strict=True):
                if own != now:
                    now, state = own, None
                state, result = step(state, own, *values)
                made.append(result)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), arrow, strict=True)], schema=arrow)

    return dealt.mapInArrow(run, out)


def _with_micros(rows: DataFrame) -> DataFrame:
    """``rows`` with ``us``: microseconds of ``at`` since the epoch; a time without a zone counts as UTC, on every worker alike."""
    naive = rows.schema["at"].dataType.simpleString() == "timestamp_ntz"
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return rows.withColumn("us", F.timestamp_diff("MICROSECOND", zero, "at") if naive else F.unix_micros("at"))


def governor_states(samples: DataFrame) -> DataFrame:
    """unit, seq, state for samples (unit, at, seq, value, undervoltage)."""

    def step(state, unit, seq, value, undervoltage):
        new = governor(state, value, bool(undervoltage))
        return new, (unit, seq, new)

    return fold(samples, "unit", ["at", "seq"], step, "unit string, seq long, state string", ["seq", "value", "undervoltage"])


def circuit_states(calls: DataFrame, threshold: int = BREAKER_FAILURES, cooldown: float = BREAKER_SECONDS) -> DataFrame:
    """source, seq, state, admitted for calls (source, at, seq, ok)."""

    def step(state, source, us, seq, ok):
        new, admitted = breaker(state, us, bool(ok), threshold, cooldown * 1e6)
        return new, (source, seq, new[0], admitted)

    return fold(_with_micros(calls), "source", ["at", "seq"], step, "source string, seq long, state string, admitted boolean", ["us", "seq", "ok"])


def budget_grants(requests: DataFrame, soft_cap: float, hours: int = 24) -> DataFrame:
    """provider, seq, granted for requests (provider, at, seq, units)."""

    def step(state, provider, us, seq, units):
        # as ``budget``, but grants are added anew only when one has left the window
        held, total = state or (deque(), 0.0)
        hour, units = us // 3_600_000_000, float(units)
        if held and held[0][0] <= hour - hours:
            while held and held[0][0] <= hour - hours:
                held.popleft()
            total = _added(held)
        ok = total + units <= soft_cap
        if ok:
            held.append((hour, units))
            total += units
        return (held, total), (provider, seq, ok)

    return fold(_with_micros(requests), "provider", ["at", "seq"], step, "provider string, seq long, granted boolean", ["us", "seq", "units"])
