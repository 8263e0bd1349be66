"""Queries of the text operators p6 to p8, each over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import leakage, packing, sentences
from tidemark.session import cut_lineage, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(f: Query, sql: str | None = None) -> Query:
    QUERIES[f.__name__] = f
    if sql:
        SQL[f.__name__] = sql
    return f


# 6. Filling fixed-capacity containers with items


@query
def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Document (or piece) and container, for each capacity."""
    return packing.containers(table(spark, d, "documents"), table(spark, d, "capacities"))


@query
def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, items, conflicts and the share of space used, for each capacity."""
    capacities = table(spark, d, "capacities")
    return packing.fill(packing.containers(table(spark, d, "documents"), capacities), capacities)


def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    """For each capacity: containers that hold too much, items that are placed twice, documents that are lost, characters
    that are lost, and containers with two copies of a text. All are 0."""
    c, documents, capacities = F.col, table(spark, d, "documents"), table(spark, d, "capacities")
    packed = cut_lineage(packing.containers(documents, capacities))
    load = packed.groupBy("capacity_id", "container_id").agg(F.sum("n_tokens").alias("held")).join(capacities.select("capacity_id", "max_tokens"), "capacity_id")
    over = load.filter("held > max_tokens").groupBy("capacity_id").agg(F.count(F.lit(1)).alias("too_full"))
    twice = packed.groupBy("capacity_id", "doc_id", "piece_no").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").groupBy("capacity_id").agg(F.count(F.lit(1)).alias("twice"))
    texts = documents.filter(F.length("text") > 0).select("doc_id", F.length("text").alias("length"))
    covered = packed.groupBy("capacity_id", "doc_id").agg(F.sum(c("end_pos") - c("start_pos")).alias("covered"))
    both = texts.join(covered, "doc_id", "left")
    whole = both.groupBy("capacity_id").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.abs(c("covered") - c("length"))).alias("characters"))
    n = texts.agg(F.count(F.lit(1))).first()[0]
    shared = packed.filter("conflict").groupBy("capacity_id").agg(F.count(F.lit(1)).alias("shared"))
    out = capacities.filter("max_tokens > 0").select("capacity_id")
    for part in (over, twice, whole, shared):
        out = out.join(part, "capacity_id", "left")
    zero = lambda name: F.coalesce(name, F.lit(0).cast("bigint")).alias(name)
    return out.select("capacity_id", zero("too_full"), zero("twice"), (F.lit(n) - F.coalesce("documents", F.lit(0))).alias("lost"), zero("characters"), zero("shared"))


query(p6_invariants, """SELECT capacity_id, CAST(0 AS BIGINT) AS too_full, CAST(0 AS BIGINT) AS twice, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS characters, CAST(0 AS BIGINT) AS shared
FROM capacities WHERE max_tokens > 0""")


# 7. Evaluation texts leaking into training text


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), edited=False)
    return found.filter(F.col("kind") == "copy").select("doc_id", "eval_id").distinct()


@query
def p7_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Copies and edited copies with their longest run and alignment score."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


# 8. Sentence boundaries across languages and scripts


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "documents"))


def p8_cover(spark: SparkSession, d: str) -> DataFrame:
    """Characters of each document that are no white space, counted in its sentences."""
    c, documents = F.col, table(spark, d, "documents").select("doc_id", "text")
    spans = sentences.sentences(documents)
    cut = spans.join(documents, "doc_id").select("doc_id", F.substring("text", c("start_pos") + 1, c("end_pos") - c("start_pos")).alias("s"))
    solid = F.length(F.regexp_replace("s", r"[\s\p{Z}\x{85}]+", ""))
    return cut.groupBy("doc_id").agg(F.sum(solid).cast("bigint").alias("characters"))


query(p8_cover, r"""SELECT doc_id, CAST(length(regexp_replace(text, '[\s\pZ\x{0085}\x{000B}]+', '', 'g')) AS BIGINT) AS characters
FROM documents WHERE length(regexp_replace(text, '[\s\pZ\x{0085}\x{000B}]+', '', 'g')) > 0""")
