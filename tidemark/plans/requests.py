"""The fixed time-series requests: metadata listings, filtered reads, grouped aggregates and window aggregates.

Each request is a DataFrame plan over one table; :class:`Database` fans requests out over its tables in name order.
Tables that lack a column of the predicate are skipped. Output is sorted nulls first, columns are in name order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.selectors import SELECTORS, selector
from tidemark.functions.windows import Span, window_stop
from tidemark.operators.pivot import schema_pivot
from tidemark.plans.predicate import FIELD_REF, MEASUREMENT_REF, Predicate
from tidemark.plans.schema import TIME, SchemaError, TsTable

PLAIN = ("sum", "count", "mean")
WINDOWED = ("sum", "count", "min", "max", "mean")


class RequestError(ValueError):
    """A request that cannot be answered as asked."""


def _field(name: str) -> Column:
    return F.col(f"`{name}`")


def aggregate(kind: str, column: Column, unsigned: bool = False) -> Column:
    """Plain aggregates ignore nulls; the mean of an unsigned field is taken over doubles."""
    if kind == "mean":
        return F.avg(column.cast("double") if unsigned else column)
    if kind == "sum":
        return F.sum(column)
    if kind == "count":
        return F.count(column)
    if kind in ("min", "max"):
        return getattr(F, kind)(column)
    raise RequestError(f"aggregate not supported: {kind}")


def reorder_prefix(prefix: list[str], tags: list[str]) -> list[str]:
    """``tags`` with the group columns first; they must be distinct and tags."""
    if len(set(prefix)) != len(prefix):
        raise RequestError(f"repeated group column: {prefix}")
    if unknown := [p for p in prefix if p not in tags]:
        raise RequestError(f"group column is no tag: {unknown}")
    return [*prefix, *(t for t in tags if t not in prefix)]


def window_arguments(aggregates: list[str], every: Span | None, offset: Span | None, window: tuple[Span, Span] | None) -> tuple[str, Span, Span]:
    """(aggregate, every, offset) of a window request; non-zero ``every`` and ``offset`` override ``window``."""
    if len(aggregates) != 1:
        raise RequestError("a window request has exactly one aggregate")
    given = [s for s in (every, offset) if s is not None and (s.ns or s.months)]
    if not given and window is None:
        raise RequestError("neither a window nor its width is given")
    width, shift = window if not given else (every or Span(), offset or Span())
    if width.ns <= 0 and width.months <= 0:
        raise RequestError("the window width must be positive")
    return aggregates[0], width, shift


def group_arguments(kind: str, keys: list[str], aggregate_name: str | None) -> tuple[list[str], str | None]:
    """Checked group mode (``none`` or ``by``), keys and aggregate."""
    if kind not in ("none", "by"):
        raise RequestError(f"unknown group: {kind}")
    if kind == "none" and keys:
        raise RequestError("group none takes no keys")
    if aggregate_name not in (None, "none", *PLAIN, *SELECTORS):
        raise RequestError(f"unknown aggregate: {aggregate_name}")
    return keys, None if aggregate_name == "none" else aggregate_name


def _chosen_fields(table: TsTable, predicate: Predicate) -> list[str]:
    return [f for f in table.schema.fields if predicate.includes_field(f)]


def read_filter(table: TsTable, predicate: Predicate, prefix: list[str] | None = None) -> DataFrame | None:
    """All matching rows: tags, fields, time; sorted by tags and time. Without chosen fields the rows remain."""
    rows = predicate.apply(table)
    if rows is None:
        return None
    tags = reorder_prefix(prefix or [], table.schema.tags)
    chosen = [*tags, *_chosen_fields(table, predicate), TIME]
    return rows.select(*map(_field, chosen)).orderBy(*map(_field, tags), TIME)


def read_group(table: TsTable, predicate: Predicate, kind: str | None, group: list[str] | None = None) -> DataFrame | None:
    """One row per full tag set; the group columns only order it. Sums and the like give one ``time``, the largest;
    selectors give ``time_<field>`` beside each field."""
    if kind is None:
        return read_filter(table, predicate, group)
    rows = predicate.apply(table)
    if rows is None:
        return None
    tags = reorder_prefix(group or [], table.schema.tags)
    outputs: list[Column] = []
    for name in _chosen_fields(table, predicate):
        if kind in SELECTORS:
            value, time = selector(kind, _field(name), F.col(TIME))
            outputs += [value.alias(name), time.alias(f"time_{name}")]
        elif kind in PLAIN:
            outputs.append(aggregate(kind, _field(name), table.schema.columns[name] == "unsigned").alias(name))
        else:
            raise RequestError(f"aggregate not supported: {kind}")
    if kind not in SELECTORS:
        outputs.append(F.max(TIME).alias(TIME))
    return rows.groupBy(*map(_field, tags)).agg(*outputs).orderBy(*map(_field, tags))


def read_columns(table: TsTable, columns: list[str], predicate: Predicate) -> DataFrame | None:
    """Chosen columns of the matching rows, unordered; filters and columns reach the scan."""
    rows = predicate.apply(table)
    return None if rows is None else rows.select(*map(_field, columns))


def satisfies(table: TsTable, predicate: Predicate) -> DataFrame:
    """``found``: whether any row matches; the scan stops at the first. A table that lacks a column has no match."""
    rows = predicate.apply(table)
    one = table.df.limit(0) if rows is None else rows
    return one.select(F.lit(1).alias("x")).limit(1).agg((F.count("x") > 0).alias("found"))


def group_columns(table: TsTable, group: list[str], wanted: list[tuple[str, str]], predicate: Predicate = Predicate()) -> DataFrame | None:
    """Aggregates by any tags, unordered: ``<column>_<kind>`` for each wanted (column, kind). Only tags can be grouped by."""
    reorder_prefix(group, table.schema.tags)
    rows = predicate.apply(table)
    if rows is None:
        return None
    one = lambda column, kind: selector(kind, _field(column), F.col(TIME))[0] if kind in ("first", "last") else aggregate(kind, _field(column), table.schema.columns[column] == "unsigned")
    return rows.groupBy(*map(_field, group)).agg(*[one(c, k).alias(f"{c}_{k}") for c, k in wanted])


def read_window_aggregate(table: TsTable, predicate: Predicate, kind: str, every: Span | int, offset: Span | int = 0) -> DataFrame | None:
    """One row per tag set and window that has rows; ``time`` is the window's stop."""
    if kind not in WINDOWED:
        raise RequestError(f"aggregate not supported: {kind}")
    rows = predicate.apply(table)
    if rows is None:
        return None
    tags = table.schema.tags
    stop = window_stop(F.col(TIME), every, offset)
    outputs = [aggregate(kind, _field(f), table.schema.columns[f] == "unsigned").alias(f) for f in _chosen_fields(table, predicate)]
    grouped = rows.groupBy(*map(_field, tags), stop.alias(TIME))
    out = grouped.agg(*outputs) if outputs else grouped.agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    return out.orderBy(*map(_field, tags), TIME)


def tag_keys(table: TsTable, predicate: Predicate) -> DataFrame | None:
    """Tags with a non-null value among the matching rows."""
    rows = predicate.apply(table)
    return None if rows is None else schema_pivot(rows, table.schema.tags, "tag_key")


def tag_values(table: TsTable, tag: str, predicate: Predicate) -> DataFrame | None:
    """Distinct non-null values of a tag; tables without it are skipped, and it must be a tag."""
    if tag not in table.schema.columns:
        return None
    if table.schema.role(tag) != "tag":
        raise RequestError(f"{tag} is no tag")
    rows = predicate.apply(table)
    return None if rows is None else rows.filter(_field(tag).isNotNull()).select(_field(tag).alias("tag_value")).distinct()


def field_columns(table: TsTable, predicate: Predicate) -> DataFrame | None:
    """(name, type, last_timestamp) of the fields with a non-null value; one pass over the rows."""
    rows = predicate.apply(table)
    fields = _chosen_fields(table, predicate)
    if rows is None or not fields:
        return None
    last = rows.agg(*[F.max(F.when(_field(f).isNotNull(), F.col(TIME))).alias(f"c{i}") for i, f in enumerate(fields)])
    entries = F.array(*[F.struct(F.lit(f).alias("name"), F.lit(table.schema.columns[f]).alias("type"), F.col(f"c{i}").alias("last_timestamp")) for i, f in enumerate(fields)])
    return last.select(F.inline(entries)).filter("last_timestamp IS NOT NULL")


@dataclass
class Database:
    """Tables by name, and the requests over all of them."""

    spark: SparkSession
    tables: dict[str, TsTable] = field(default_factory=dict)

    def _fan_out(self, predicate: Predicate, request: Callable[[TsTable], DataFrame | None]) -> list[tuple[str, DataFrame]]:
        found = []
        for name in sorted(self.tables):
            if predicate.includes_table(name) and (df := request(self.tables[name])) is not None:
                found.append((name, df))
        return found

    def _together(self, parts: list[tuple[str, DataFrame]], schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, (df for _, df in parts)) if parts else self.spark.createDataFrame([], schema)

    def measurement_names(self, predicate: Predicate = Predicate()) -> DataFrame:
        """Tables with a matching row. Each table stops at its first."""
        one = lambda t: None if (rows := predicate.apply(t)) is None else rows.select(F.lit(1)).limit(1)
        parts = [(n, df.select(F.lit(n).alias("measurement"))) for n, df in self._fan_out(predicate, one)]
        return self._together(parts, "measurement string").orderBy("measurement")

    def tag_keys(self, predicate: Predicate = Predicate(), pseudo: bool = False) -> DataFrame:
        """Tag keys of all tables; ``pseudo`` adds the names of the measurement and field as requests expect."""
        keys = self._together(self._fan_out(predicate, lambda t: tag_keys(t, predicate)), "tag_key string").distinct()
        if pseudo:
            keys = keys.union(self.spark.createDataFrame([(MEASUREMENT_REF[1],), (FIELD_REF[1],)], "tag_key string"))
        return keys.orderBy("tag_key")

    def tag_values(self, tag: str, predicate: Predicate = Predicate()) -> DataFrame:
        """Values of a tag; the pseudo tags give the measurements and the field names."""
        if tag in MEASUREMENT_REF:
            if predicate.exprs:
                raise RequestError("the measurement's values take no predicate")
            return self.measurement_names(predicate).withColumnRenamed("measurement", "tag_value")
        if tag in FIELD_REF:
            return self.field_columns(predicate).select(F.col("name").alias("tag_value"))
        parts = self._fan_out(predicate, lambda t: tag_values(t, tag, predicate))
        return self._together(parts, "tag_value string").distinct().orderBy("tag_value")

    def field_columns(self, predicate: Predicate = Predicate()) -> DataFrame:
        """Fields of all tables; a name with two types is an error."""
        kinds: dict[str, str] = {}
        for name in sorted(self.tables):
            for f in self.tables[name].schema.fields if predicate.includes_table(name) else ():
                if kinds.setdefault(f, self.tables[name].schema.columns[f]) != self.tables[name].schema.columns[f]:
                    raise SchemaError(f"field {f} has two types")
        parts = self._fan_out(predicate, lambda t: field_columns(t, predicate))
        whole = self._together(parts, "name string, type string, last_timestamp bigint")
        return whole.groupBy("name", "type").agg(F.max("last_timestamp").alias("last_timestamp")).orderBy("name")

    def read_filter(self, predicate: Predicate = Predicate()) -> list[tuple[str, DataFrame]]:
        return self._fan_out(predicate, lambda t: read_filter(t, predicate))

    def read_group(self, predicate: Predicate, kind: str | None, group: list[str] | None = None) -> list[tuple[str, DataFrame]]:
        return self._fan_out(predicate, lambda t: read_group(t, predicate, kind, group))

    def read_window_aggregate(self, predicate: Predicate, kind: str, every: Span | int, offset: Span | int = 0) -> list[tuple[str, DataFrame]]:
        return self._fan_out(predicate, lambda t: read_window_aggregate(t, predicate, kind, every, offset))

    def series_cardinality(self, predicate: Predicate = Predicate()) -> DataFrame:
        """The number of distinct (table, tag set)."""
        def one(t: TsTable) -> DataFrame | None:
            rows = predicate.apply(t)
            return None if rows is None else rows.select(*map(_field, t.schema.tags)).distinct().agg(F.count(F.lit(1)).alias("series"))

        whole = self._together(self._fan_out(predicate, one), "series bigint")
        return whole.agg(F.coalesce(F.sum("series"), F.lit(0)).alias("series"))

    @staticmethod
    def capabilities() -> dict[str, list[str]]:
        """Which aggregates are pushed down to which request."""
        return {"WindowAggregate": ["Count", "Sum", "Min", "Max", "Mean"], "Group": ["First", "Last", "Min", "Max"]}
