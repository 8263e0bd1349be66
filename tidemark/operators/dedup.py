"""Upsert semantics: one row per primary key, each field with its last non-null value in write order.

``max_by`` over a write sequence that is null where the value is keeps a hash aggregate for numbers and booleans, is
combined before the shuffle, and lets Catalyst push conditions on the key below it but none on the fields, which is the
only correct pushdown for upserts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.schema import TsTable, union_tables

SEQ = "_seq"


def dedup_last_non_null(table: TsTable, seq: str = SEQ) -> TsTable:
    """The table with one row per (tags, time); null keys equal each other. Of equal ``seq`` an arbitrary one counts."""
    kept = []
    for name in table.schema.fields:
        c = F.col(f"`{name}`")
        kept.append(F.max_by(c, F.when(c.isNotNull(), F.col(seq))).alias(name))
    keys = [F.col(f"`{k}`") for k in table.schema.primary_key]
    return TsTable(table.df.groupBy(*keys).agg(*kept, F.max(seq).alias(seq)), table.schema)


def duplicate_count(table: TsTable) -> DataFrame:
    """``rows``, ``keys`` and the number of rows that deduplication removes."""
    per_key = table.df.groupBy(*table.schema.primary_key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("keys")).withColumn("removed", F.col("rows") - F.col("keys"))


def overlap_groups(bounds: list[dict[str, tuple | None]]) -> list[list[int]]:
    """Groups of chunks whose key bounds may overlap, given for each chunk the (min, max) of each key column.

    A chunk without bounds for a column the other has may hold anything there. Groups that a chunk bridges are merged.
    """
    parent = list(range(len(bounds)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    # Sorted by the time bounds, only chunks whose times still overlap need the full test.
    order = sorted(range(len(bounds)), key=lambda i: (bounds[i].get("time") is not None, bounds[i].get("time") or ()))
    active: list[int] = []
    for i in order:
        time = bounds[i].get("time")
        active = [j for j in active if time is None or bounds[j].get("time") is None or bounds[j]["time"][1] >= time[0]]
        for j in active:
            if find(i) != find(j) and _may_overlap(bounds[i], bounds[j]):
                parent[find(i)] = find(j)
        active.append(i)
    groups: dict[int, list[int]] = {}
    for i in range(len(bounds)):
        groups.setdefault(find(i), []).append(i)
    return sorted(groups.values())


def key_bounds(chunks: list[TsTable]) -> list[dict[str, tuple | None]]:
    """The bounds of each chunk's key columns, one small aggregate for each chunk. A tag with nulls has no bounds, as its
    nulls may meet those of any other chunk. Stored chunks know their bounds from their statistics."""
    found = []
    for chunk in chunks:
        keys = chunk.schema.primary_key
        c = lambda k: F.col(f"`{k}`")
        row = chunk.df.agg(F.count(F.lit(1)), *[x for k in keys for x in (F.count(c(k)), F.min(c(k)), F.max(c(k)))]).first()
        found.append({k: (row[3 * i + 2], row[3 * i + 3]) if row[0] and row[3 * i + 1] == row[0] else None for i, k in enumerate(keys)})
    return found


def _may_overlap(a: dict[str, tuple | None], b: dict[str, tuple | None]) -> bool:
    for column in a.keys() & b.keys():
        x, y = a[column], b[column]
        if x is not None and y is not None and (x[1] < y[0] or y[1] < x[0]):
            return False
    return True


def scan(chunks: list[TsTable], bounds: list[dict] | None = None, clean: list[bool] | None = None) -> TsTable:
    """The deduplicated table of its chunks. Only groups that may overlap, or a chunk not known to be free of
    duplicates, pay for the aggregate; the rest is read plainly."""
    if bounds is None:
        return dedup_last_non_null(union_tables(chunks))
    clean = clean or [False] * len(chunks)
    plain, parts = [], []
    for group in overlap_groups(bounds):
        if len(group) == 1 and clean[group[0]]:
            plain.append(chunks[group[0]])
        else:
            parts.append(dedup_last_non_null(union_tables([chunks[i] for i in group])))
    return union_tables([*plain, *parts])
