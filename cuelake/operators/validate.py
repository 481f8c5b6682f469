"""Data-quality rules over contract relations. A rule is a list of tests; each test turns relations into issues.

Issues are rows (check, ref). Tests are filters, anti-joins, grouped conditions and windows, so a rule costs a scan or
one shuffle on its key, whatever the number of documents. Conditions are SQL expressions over a relation's columns;
one that is null is no issue.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Frames = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Where:
    """Rows for which a condition holds."""

    table: str
    condition: str
    ref: str

    def refs(self, frames: Frames) -> DataFrame:
        return frames(self.table).where(F.expr(self.condition)).select(F.expr(self.ref).alias("ref"))


@dataclass(frozen=True)
class Unique:
    """Every occurrence of a key but the first in `order`; null keys are not compared."""

    table: str
    keys: tuple[str, ...]
    order: str
    ref: str

    def refs(self, frames: Frames) -> DataFrame:
        df = frames(self.table).where(F.expr(" AND ".join(f"{k} IS NOT NULL" for k in self.keys)))
        nth = F.row_number().over(W.partitionBy(*self.keys).orderBy(F.expr(self.order)))
        return df.withColumn("__nth", nth).where("__nth > 1").select(F.expr(self.ref).alias("ref"))


@dataclass(frozen=True)
class Exists:
    """Rows (that `where` selects) without a row of `parent` (that `parent_where` selects) of the same keys."""

    table: str
    parent: str
    on: tuple[tuple[str, str], ...]
    ref: str
    where: str = "TRUE"
    parent_where: str = "TRUE"

    def refs(self, frames: Frames) -> DataFrame:
        child, keys = frames(self.table).where(F.expr(self.where)), [f"__k{i}" for i in range(len(self.on))]
        parent = frames(self.parent).where(F.expr(self.parent_where)).select(*[F.col(p).alias(k) for (_, p), k in zip(self.on, keys, strict=True)])
        same = reduce(Column.__and__, [child[c] == parent[k] for (c, _), k in zip(self.on, keys, strict=True)])
        return child.join(parent, same, "left_anti").select(F.expr(self.ref).alias("ref"))


@dataclass(frozen=True)
class ExactlyOne:
    """Rows with no or several matching rows of `parent`."""

    table: str
    parent: str
    on: tuple[tuple[str, str], ...]
    ref: str
    where: str = "TRUE"
    parent_where: str = "TRUE"

    def refs(self, frames: Frames) -> DataFrame:
        child, keys = frames(self.table).where(F.expr(self.where)), [f"__k{i}" for i in range(len(self.on))]
        parent = frames(self.parent).where(F.expr(self.parent_where)).select(*[F.col(p).alias(k) for (_, p), k in zip(self.on, keys, strict=True)])
        counted = parent.groupBy(*keys).agg(F.count("*").alias("__n"))
        same = reduce(Column.__and__, [child[c] == counted[k] for (c, _), k in zip(self.on, keys, strict=True)])
        return child.join(counted, same, "left").where("coalesce(__n, 0) <> 1").select(F.expr(self.ref).alias("ref"))


@dataclass(frozen=True)
class Group:
    """Groups for which a condition over aggregates holds."""

    table: str
    keys: tuple[str, ...]
    having: str
    ref: str
    where: str = "TRUE"

    def refs(self, frames: Frames) -> DataFrame:
        groups = frames(self.table).where(F.expr(self.where)).groupBy(*self.keys).agg(F.expr(self.having).alias("__bad"))
        return groups.where("__bad").select(F.expr(self.ref).alias("ref"))


@dataclass(frozen=True)
class Over:
    """Rows for which a condition over window functions holds; `columns` names the windows."""

    table: str
    columns: tuple[tuple[str, str], ...]
    condition: str
    ref: str

    def refs(self, frames: Frames) -> DataFrame:
        df = frames(self.table).select("*", *[F.expr(e).alias(c) for c, e in self.columns])
        return df.where(F.expr(self.condition)).select(F.expr(self.ref).alias("ref"))


@dataclass(frozen=True)
class Pair:
    """Rows joined with `right` on equal column names for which a condition holds; with `left`, also rows without a partner."""

    table: str
    right: str
    on: tuple[str, ...]
    condition: str
    ref: str
    left: bool = False

    def refs(self, frames: Frames) -> DataFrame:
        joined = frames(self.table).join(frames(self.right), list(self.on), "left" if self.left else "inner")
        return joined.where(F.expr(self.condition)).select(F.expr(self.ref).alias("ref"))


Test = Where | Unique | Exists | ExactlyOne | Group | Over | Pair


def issues(check: str, tests: list[Test], frames: Frames) -> DataFrame:
    """(check, ref) of all issues that a rule's tests find."""
    found = reduce(DataFrame.unionByName, [t.refs(frames).select(F.col("ref").cast("string").alias("ref")) for t in tests])
    return found.select(F.lit(check).alias("check"), "ref")


def report(rules: dict[str, list[Test]], frames: Frames) -> DataFrame:
    """All issues of some rules, each once."""
    return reduce(DataFrame.unionByName, [issues(c, t, frames) for c, t in rules.items()]).distinct()
