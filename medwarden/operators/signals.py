"""Disproportionality signals over drug-event pairs.

Every measure needs pair, drug, event and grand totals. The rows are aggregated once to pairs; the
other totals are sums of the pairs, so the fact table is scanned and shuffled a single time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medwarden.functions.numbers import ratio


def _with_totals(
    cells: DataFrame, drug: str, event: str, extra: Column | None = None
) -> DataFrame:
    """Pairs with n, drug_total, event_total and grand_total (and ``extra``, an aggregate).

    ``cells`` are counts ``n`` per drug, event and perhaps more. All four sums come from it, and
    its shuffle is done once and reused: null-safe joins keep the branches identical, and the
    last filter reads both join sides, so it cannot be pushed into one of them.
    """
    pairs = cells
    if extra is not None:
        pairs = cells.groupBy(drug, event).agg(F.sum("n").alias("n"), extra)
    by_drug = cells.groupBy(F.col(drug).alias("_drug")).agg(F.sum("n").alias("drug_total"))
    by_event = cells.groupBy(F.col(event).alias("_event")).agg(F.sum("n").alias("event_total"))
    grand = cells.agg(F.sum("n")).scalar()
    named = F.when(F.col("drug_total") > 0, F.col(drug)).isNotNull() & F.when(
        F.col("event_total") > 0, F.col(event)
    ).isNotNull()
    return (
        pairs.join(by_drug, F.col(drug).eqNullSafe(F.col("_drug")))
        .join(by_event, F.col(event).eqNullSafe(F.col("_event")))
        .filter(named)
        .withColumn("grand_total", grand)
        .drop("_drug", "_event")
    )


def _cells(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def exceeds(value: Column, threshold: float, inclusive: bool) -> Column:
    """Whether a ratio is over the threshold; an undefined ratio is not."""
    over = value >= threshold if inclusive else value > threshold
    return F.coalesce(over, F.lit(False))


def relative_rates(
    fact: DataFrame, drug: str = "drug_name", event: str = "ae_soc_class", digits: int = 2
) -> DataFrame:
    """Share of the event within the drug over its share within all reports, for every pair.

    Reports without an event class count in the totals but make no pair.
    """
    rows = _with_totals(_cells(fact, drug, event), drug, event)
    expected = ratio(F.col("event_total"), F.col("grand_total"))
    rate = ratio(F.col("n"), F.col("drug_total")) / F.nullif(expected, F.lit(0.0))
    return rows.select(
        drug, event, F.col("n").alias("de_count"), F.round(rate, digits).alias("prr")
    )


def signal_relative_rate(
    fact: DataFrame,
    drug: str = "drug_name",
    event: str = "ae_soc_class",
    min_cases: int = 3,
    top: int = 15,
) -> DataFrame:
    """The ranking of the signal dashboard: pairs with enough cases, highest rate first."""
    return (
        relative_rates(fact, drug, event)
        .filter(F.col("de_count") >= min_cases)
        .orderBy(F.desc_nulls_last("prr"), drug, event)
        .limit(top)
    )


def flag_baseline(rates: DataFrame, factor: float = 2.0, inclusive: bool = False) -> DataFrame:
    """Adds ``exceeds_baseline``: the rate is more than ``factor`` times the expected one."""
    return rates.withColumn("exceeds_baseline", exceeds(F.col("prr"), factor, inclusive))


def _prr(
    cells: DataFrame,
    drug: str,
    event: str,
    threshold: float,
    min_cases: int,
    inclusive: bool,
    digits: int,
    extra: Column | None = None,
    extra_name: str | None = None,
) -> DataFrame:
    a = F.col("n")
    kept = [extra_name] if extra_name else []
    table = _with_totals(cells, drug, event, extra).select(
        drug,
        event,
        a.alias("a"),
        (F.col("drug_total") - a).alias("b"),
        (F.col("event_total") - a).alias("c"),
        (F.col("grand_total") - F.col("drug_total") - F.col("event_total") + a).alias("d"),
        *kept,
    )
    within = ratio(F.col("a"), F.col("a") + F.col("b"))
    others = ratio(F.col("c"), F.col("c") + F.col("d"))
    value = within / F.nullif(others, F.lit(0.0))
    flagged = exceeds(value, threshold, inclusive) & (F.col("a") >= min_cases)
    return table.select(
        drug,
        event,
        "a",
        "b",
        "c",
        "d",
        F.round(value, digits).alias("prr"),
        flagged.alias("is_signal"),
        *kept,
    )


def signal_prr(
    fact: DataFrame,
    drug: str = "drug_name",
    event: str = "ae_soc_class",
    threshold: float = 2.0,
    min_cases: int = 3,
    inclusive: bool = True,
    digits: int = 4,
) -> DataFrame:
    """Proportional reporting ratio (a/(a+b)) / (c/(c+d)) with its 2x2 counts.

    It is NULL, and no signal, where the event occurs with no other drug. The flag uses the
    unrounded ratio.
    """
    cells = _cells(fact, drug, event)
    return _prr(cells, drug, event, threshold, min_cases, inclusive, digits)


# --- several sources ----------------------------------------------------------------------


def unified_records(
    sources: dict[str, DataFrame], soc_map: DataFrame | None = None
) -> DataFrame:
    """Drug, class and source of the records of all sources.

    ``soc_map`` (source_class, unified_class) lines up class names; unmapped ones stay. A repeated
    source class counts once, with the smallest class it is mapped to.
    """
    rows: DataFrame | None = None
    for name, frame in sources.items():
        part = frame.select("drug_name", "ae_soc_class", F.lit(name).alias("data_source"))
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ValueError("at least one source is needed")
    if soc_map is None:
        return rows
    mapped = rows.join(
        soc_map.groupBy(F.col("source_class").alias("ae_soc_class")).agg(
            F.min("unified_class").alias("unified_class")
        ),
        "ae_soc_class",
        "left",
    )
    return mapped.select(
        "drug_name",
        F.coalesce("unified_class", "ae_soc_class").alias("ae_soc_class"),
        "data_source",
    )


def unified_signal_counts(fact: DataFrame, calls: DataFrame) -> DataFrame:
    """Records per drug, class and source."""
    rows = unified_records({"FAERS": fact, "CALL_CENTER": calls})
    return rows.groupBy("drug_name", "ae_soc_class", "data_source").agg(
        F.count(F.lit(1)).alias("case_count")
    )


def unified_prr(
    fact: DataFrame,
    calls: DataFrame,
    soc_map: DataFrame | None = None,
    threshold: float = 2.0,
    min_cases: int = 3,
    inclusive: bool = True,
    digits: int = 4,
) -> DataFrame:
    """``signal_prr`` over the records of both sources, naming the sources of each pair."""
    drug, event = "drug_name", "ae_soc_class"
    rows = unified_records({"FAERS": fact, "CALL_CENTER": calls}, soc_map)
    # One element per source name.
    sources = F.array_join(F.array_sort(F.collect_set("data_source")), ", ").alias("sources")
    cells = _cells(rows, drug, event, "data_source")
    return _prr(
        cells, drug, event, threshold, min_cases, inclusive, digits, sources, "sources"
    )


def unified_sources(counts: DataFrame) -> DataFrame:
    """Rows and distinct drugs per source of the unified counts."""
    return counts.groupBy("data_source").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_distinct("drug_name").alias("unique_drugs"),
    )
