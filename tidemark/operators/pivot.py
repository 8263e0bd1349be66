"""Which columns have values, and the split of a stream in two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def schema_pivot(df: DataFrame, columns: list[str] | None = None, name: str = "non_null_column") -> DataFrame:
    """The name of each column that has a non-null value. One pass, one row per partition in the shuffle."""
    columns = df.columns if columns is None else columns
    if not columns:
        return df.sparkSession.createDataFrame([], f"{name} string")
    seen = df.agg(*[F.max(F.col(f"`{c}`").isNotNull()).alias(f"c{i}") for i, c in enumerate(columns)])
    names = F.array_compact(F.array(*[F.when(F.col(f"c{i}"), F.lit(c)) for i, c in enumerate(columns)]))
    return seen.select(F.explode(names).alias(name))


def stream_split(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows where the condition is true, and rows where it is false or null."""
    holds = F.coalesce(condition, F.lit(False))
    return df.filter(holds), df.filter(~holds)
