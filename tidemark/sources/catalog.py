"""The catalogue of sources, checked when it is loaded."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

CLASSES = ("A", "B", "C", "D")


@dataclass(frozen=True)
class Source:
    id: str
    legality: str
    role: str
    costed: bool = False
    budget: str | None = None
    ttl_hours: int = 24
    enabled: bool = True


def checked(sources: list[Source]) -> list[Source]:
    """The sources, or an error: ids repeat, an unknown class, a costed source without a budget, no lifetime."""
    if len({s.id for s in sources}) != len(sources):
        raise ValueError("source ids repeat")
    for s in sources:
        if s.legality not in CLASSES:
            raise ValueError(f"{s.id}: unknown class {s.legality!r}")
        if s.costed and not s.budget:
            raise ValueError(f"{s.id}: a costed source needs a budget")
        if s.ttl_hours <= 0:
            raise ValueError(f"{s.id}: a lifetime is positive")
    return sources


def frame(spark: SparkSession, sources: list[Source]) -> DataFrame:
    rows = [(s.id, s.legality, s.role, s.costed, s.budget, s.ttl_hours, s.enabled) for s in checked(sources)]
    return spark.createDataFrame(rows, "id string, legality string, role string, costed boolean, budget string, ttl_hours int, enabled boolean")


def by_role(catalog: DataFrame, role: str) -> DataFrame:
    return catalog.where("enabled").where(catalog["role"] == role)
