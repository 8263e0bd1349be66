"""Column roles and the strict merge of table schemas.

A table has tags (nullable strings), typed fields and one BIGINT ``time`` in nanoseconds. The role of a column travels
in its field metadata and, as metadata does not survive expressions, in the :class:`TsSchema` beside the DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME = "time"
ROLE_KEY, SORT_KEY = "ts.role", "ts.sort"
#: Spark types of the logical field types. Spark has no unsigned long.
FIELD_TYPES: dict[str, T.DataType] = {
    "float": T.DoubleType(), "integer": T.LongType(), "unsigned": T.DecimalType(20, 0), "string": T.StringType(), "boolean": T.BooleanType(),
}


class SchemaError(ValueError):
    """Schemas that cannot be merged, or a column that is not what a request needs."""


def logical_type(kind: T.DataType) -> str:
    for name, known in FIELD_TYPES.items():
        if kind == known:
            return name
    raise SchemaError(f"no logical type for {kind.simpleString()}")


@dataclass(frozen=True)
class TsSchema:
    """Columns by name: ``tag``, ``time`` or the logical type of a field."""

    columns: dict[str, str] = field(default_factory=dict)
    measurement: str | None = None

    @property
    def tags(self) -> list[str]:
        return sorted(c for c, kind in self.columns.items() if kind == "tag")

    @property
    def fields(self) -> list[str]:
        return sorted(c for c, kind in self.columns.items() if kind not in ("tag", "time"))

    @property
    def primary_key(self) -> list[str]:
        """All tags by name, then time."""
        return [*self.tags, TIME]

    def role(self, name: str) -> str:
        kind = self.columns[name]
        return kind if kind in ("tag", "time") else "field"

    def merge(self, other: TsSchema) -> TsSchema:
        """Union of columns; role, type and measurement must agree exactly."""
        if self.measurement and other.measurement and self.measurement != other.measurement:
            raise SchemaError(f"measurements differ: {self.measurement}, {other.measurement}")
        for name in self.columns.keys() & other.columns.keys():
            if self.columns[name] != other.columns[name]:
                raise SchemaError(f"column {name} is {self.columns[name]} and {other.columns[name]}")
        return TsSchema(self.columns | other.columns, self.measurement or other.measurement)

    def struct(self) -> T.StructType:
        kinds = {"tag": T.StringType(), "time": T.LongType()} | FIELD_TYPES
        return T.StructType([T.StructField(c, kinds[self.columns[c]], c != TIME, {ROLE_KEY: self.role(c)}) for c in sorted(self.columns)])


@dataclass(frozen=True)
class TsTable:
    """A DataFrame with its schema. Columns beyond the schema (such as the write order) are kept but not shown."""

    df: DataFrame
    schema: TsSchema

    @classmethod
    def of(cls, df: DataFrame, tags: list[str], measurement: str | None = None, hidden: tuple[str, ...] = ("_seq",)) -> TsTable:
        kinds = {}
        for f in df.schema.fields:
            if f.name not in hidden:
                kinds[f.name] = "tag" if f.name in tags else "time" if f.name == TIME else logical_type(f.dataType)
        if TIME not in kinds:
            raise SchemaError("a table needs a time column")
        return cls(df, TsSchema(kinds, measurement))

    def shown(self) -> DataFrame:
        """Columns in name order, with their roles as metadata."""
        return self.df.select(*[F.col(f"`{c}`").alias(c, metadata={ROLE_KEY: self.schema.role(c)}) for c in sorted(self.schema.columns)])


def union_tables(tables: list[TsTable]) -> TsTable:
    """One table of many, after the strict check that Spark's own merging does not make; missing columns are null."""
    if not tables:
        raise SchemaError("no tables")
    schema = reduce(TsSchema.merge, (t.schema for t in tables))
    return TsTable(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (t.df for t in tables)), schema)


def sort_key(table: TsTable) -> list[str]:
    """Tags by ascending number of distinct values, then time. Numbers are estimates, made in one pass of partial
    aggregates; one row comes to the driver. Tags of about the same number may come in either order."""
    tags = table.schema.tags
    if not tags:
        return [TIME]
    counts = table.df.agg(*[F.approx_count_distinct(F.col(f"`{t}`")).alias(f"d{i}") for i, t in enumerate(tags)]).first()
    number = {t: counts[i] for i, t in enumerate(tags)}
    return [*sorted(tags, key=lambda t: (number[t], t)), TIME]
