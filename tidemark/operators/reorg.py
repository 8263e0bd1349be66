"""Reorganisation of chunks: compact, and split at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.dedup import dedup_last_non_null
from tidemark.operators.pivot import stream_split
from tidemark.plans.schema import TIME, TsTable, sort_key, union_tables
from tidemark.session import cut_lineage


def compact(chunks: list[TsTable], key: list[str] | None = None) -> tuple[TsTable, list[str]]:
    """The chunks as one deduplicated table sorted by ``key`` (tags with few values first, and time last, if not given).

    Duplicates are removed once: the result is written before it is sampled for the ranges of the sort. The key is
    estimated from the chunks as they are, which has the same order of tags as the deduplicated rows.
    """
    together = union_tables(chunks)
    key = key or sort_key(together)
    order = [F.asc_nulls_last(f"`{k}`") for k in key]
    merged = cut_lineage(dedup_last_non_null(together).df)
    return TsTable(merged.repartitionByRange(*order).sortWithinPartitions(*order), together.schema), key


def split_plan(chunks: list[TsTable], split_time: int, key: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The compacted table up to and including ``split_time``, and the rest."""
    table, _ = compact(chunks, key)
    return stream_split(cut_lineage(table.df), F.col(TIME) <= split_time)
