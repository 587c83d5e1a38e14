"""Declarative metrics: pick measures and dimensions, get one DataFrame.

A model names dimensions, measures and many-to-one relationships as Spark SQL expressions. A query
turns into joins, filters and one aggregation per table that owns a requested measure. Each measure
keeps the grain of its own table: joining never multiplies the rows it counts.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medwarden.operators.gold import one_row_per_key


@dataclass(frozen=True)
class Dimension:
    name: str
    table: str
    expr: str
    unique: bool = False


@dataclass(frozen=True)
class Measure:
    name: str
    table: str
    expr: str


@dataclass(frozen=True)
class Relationship:
    """Many rows of ``left`` to one of ``right``, on (left column, right column) pairs.

    ``how`` inner leaves out rows of ``left`` without a partner, wherever ``right`` is used.
    """

    name: str
    left: str
    right: str
    keys: tuple[tuple[str, str], ...]
    how: str = "left"


@dataclass(frozen=True)
class VerifiedQuery:
    name: str
    question: str
    sql: str


Filter = tuple[str, Callable[[Column], Column]]


@dataclass(frozen=True)
class MetricModel:
    fact: str
    dimensions: tuple[Dimension, ...]
    measures: tuple[Measure, ...]
    relationships: tuple[Relationship, ...]
    # (full name, table) pairs, and queries by name: what a model file says besides.
    base_tables: tuple[tuple[str, str], ...] = ()
    verified: tuple[VerifiedQuery, ...] = ()

    def _dimension(self, name: str) -> Dimension:
        """By ``table.name``, or by name with the fact table's first."""
        table, _, plain = name.rpartition(".")
        found = [
            d for d in self.dimensions if d.name == plain and (not table or d.table == table)
        ]
        if not found:
            raise KeyError(f"unknown dimension {name!r}")
        return min(found, key=lambda d: d.table != self.fact)

    def _measure(self, name: str) -> Measure:
        for m in self.measures:
            if m.name == name:
                return m
        raise KeyError(f"unknown measure {name!r}")

    def _relationship(self, right: str) -> Relationship:
        for r in self.relationships:
            if r.left == self.fact and r.right == right:
                return r
        raise KeyError(f"{self.fact} has no relationship to {right}")

    def query(
        self,
        frames: Mapping[str, DataFrame],
        measures: Sequence[str],
        dimensions: Sequence[str] = (),
        filters: Sequence[Filter] = (),
        order_by: Sequence[str] = (),
        limit: int | None = None,
    ) -> DataFrame:
        """``frames`` maps table names to DataFrames; filters are (dimension, predicate) pairs.

        ``order_by`` takes output names, with a leading ``-`` for descending; the dimensions are
        the tie-break.
        """
        wanted = [self._dimension(d) for d in dimensions]
        tests = [(self._dimension(d), test) for d, test in filters]
        chosen = [self._measure(m) for m in measures]
        parts = [
            self._part(frames, table, [m for m in chosen if m.table == table], wanted, tests)
            for table in dict.fromkeys(m.table for m in chosen)
        ]
        result = reduce(lambda a, b: _join_parts(a, b, [d.name for d in wanted]), parts)
        result = result.select(*[d.name for d in wanted], *measures)
        if order_by or limit is not None:
            keys = list(order_by) + [d.name for d in wanted]
            result = result.orderBy(
                *[
                    F.desc_nulls_last(k[1:]) if k.startswith("-") else F.asc_nulls_last(k)
                    for k in keys
                ]
            )
        return result if limit is None else result.limit(limit)

    def _part(
        self,
        frames: Mapping[str, DataFrame],
        table: str,
        measures: Sequence[Measure],
        wanted: Sequence[Dimension],
        tests: Sequence[tuple[Dimension, Callable[[Column], Column]]],
    ) -> DataFrame:
        used = [*wanted, *[d for d, _ in tests]]
        names = {d: f"_dim{i}" for i, d in enumerate(dict.fromkeys(used))}
        def kept(rows: DataFrame) -> DataFrame:
            for d, test in tests:
                rows = rows.filter(test(F.col(names[d])))
            return rows

        if table == self.fact:
            rows = kept(self._fact_rows(frames, names))
        elif all(d.table == table for d in used):
            rows = kept(frames[table].withColumns({n: F.expr(d.expr) for d, n in names.items()}))
        else:
            # Filtered facts tell which groups each row of this table belongs to, once per group.
            keys = self._relationship(table).keys
            groups = kept(self._fact_rows(frames, names)).select(
                *[F.col(k).alias(f"_key{i}") for i, (k, _) in enumerate(keys)],
                *[names[d] for d in wanted],
            )
            own = frames[table]
            match = [F.col(f"_key{i}") == own[k] for i, (_, k) in enumerate(keys)]
            rows = groups.distinct().join(own, match)
        return rows.groupBy(*[F.col(names[d]).alias(d.name) for d in wanted]).agg(
            *[F.expr(m.expr).alias(m.name) for m in measures]
        )

    def _fact_rows(
        self, frames: Mapping[str, DataFrame], names: Mapping[Dimension, str]
    ) -> DataFrame:
        rows = frames[self.fact]
        for d, name in names.items():
            if d.table == self.fact:
                rows = rows.withColumn(name, F.expr(d.expr))
        for table in dict.fromkeys(d.table for d in names if d.table != self.fact):
            link = self._relationship(table)
            keys = link.keys
            own = {name: d for d, name in names.items() if d.table == table}
            dim = frames[table].withColumns({n: F.expr(d.expr) for n, d in own.items()})
            dim = one_row_per_key(dim, [k for _, k in keys], list(own))
            dim = dim.select(
                *[F.col(k).alias(f"_{table}_{i}") for i, (_, k) in enumerate(keys)], *own
            )
            match = [F.col(k) == F.col(f"_{table}_{i}") for i, (k, _) in enumerate(keys)]
            rows = rows.join(dim, match, link.how)
        return rows

    def check_relationship(self, frames: Mapping[str, DataFrame], name: str) -> DataFrame:
        """How many keys of the one side have several rows, and how many rows that is."""
        link = next((r for r in self.relationships if r.name == name), None)
        if link is None:
            raise KeyError(f"unknown relationship {name!r}")
        per_key = frames[link.right].groupBy(*[k for _, k in link.keys]).agg(
            F.count(F.lit(1)).alias("n")
        )
        return per_key.filter(F.col("n") > 1).agg(
            F.lit(name).alias("relationship"),
            F.count(F.lit(1)).alias("duplicate_keys"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"),
        )

    @classmethod
    def from_mapping(cls, config: Mapping, fact: str | None = None) -> MetricModel:
        """A model from parsed YAML or JSON (see ``medwarden.plans.model_file``)."""
        from medwarden.plans.model_file import model_of

        return model_of(config, fact)


def _join_parts(a: DataFrame, b: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Aggregates of two tables side by side, one row per group of either."""
    if not dims:
        # One row each.
        for name in b.columns:
            a = a.withColumn(name, b.select(name).scalar())
        return a
    b = b.withColumnsRenamed({d: f"_{d}" for d in dims})
    match = reduce(
        lambda x, y: x & y, [F.col(d).eqNullSafe(F.col(f"_{d}")) for d in dims]
    )
    joined = a.join(b, match, "full")
    both = {d: F.coalesce(d, f"_{d}") for d in dims}
    return joined.withColumns(both).drop(*[f"_{d}" for d in dims])
