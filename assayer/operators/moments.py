"""Rules on the distance from the mean, and a column's moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer import spec


def measured(value: Column, kind: str, nulls_as_zero: bool = False) -> Column:
    """What enters the moments: the value as double; nulls as 0 if asked for."""
    wide = value.cast("double")
    return F.coalesce(wide, F.lit(0.0)) if nulls_as_zero else wide


def moments(value: Column) -> tuple[Column, Column]:
    """Mean and sample deviation; 0 deviation for fewer than two values."""
    return F.avg(value), F.coalesce(F.stddev_samp(value), F.lit(0.0))


def statistical_violation(rule: spec.RuleSpec, value: Column, mean: float | None, deviation: float | None) -> Column:
    """The condition given the column's moments."""
    x = value.cast("double")
    if mean is None or rule.kind == "std_dev" and not deviation:
        return F.lit(False)
    if rule.kind == "std_dev":
        far = F.abs(x - F.lit(mean)) / F.lit(deviation) >= F.lit(float(rule.arg("max_std_dev")))
    else:
        far = F.abs(F.lit(mean) - x) > F.lit(mean * float(rule.arg("max_variance_percent")) / 100.0)
    return F.coalesce(far & ~F.isnan(x) & F.lit(mean == mean), F.lit(False))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: count, mean, deviation, sample and population variance, min, max."""
    if not columns:
        raise ValueError("no columns to profile")
    figures = {
        "n": lambda c: F.count(c).cast("double"), "mean": F.avg, "std_dev": lambda c: F.when(F.count(c) > 0, F.coalesce(F.stddev_samp(c), F.lit(0.0))),
        "variance": lambda c: F.when(F.count(c) > 0, F.coalesce(F.var_samp(c), F.lit(0.0))), "population_variance": lambda c: F.when(F.count(c) > 1, F.var_pop(c)).when(F.count(c) == 1, 0.0), "min": F.min, "max": F.max,
    }
    row = df.agg(*(f(F.col(f"`{c}`").cast("double")).alias(f"{i}_{k}") for i, c in enumerate(columns) for k, f in figures.items()))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"{i}_{k}").alias(k) for k in figures)) for i, c in enumerate(columns)))
    return row.select(F.explode(rows).alias("r")).select("r.column", F.col("r.n").cast("long").alias("n"), *(f"r.{k}" for k in figures if k != "n"))
