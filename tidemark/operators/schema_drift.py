"""Schemas that drift between files: one consistent table, and a list of every change.

Records are read as path-value pairs that keep their raw JSON type, and path-type statistics are kept per file: what each
path is declared as, joined with the raw types it was seen to hold. Files are put in order by a distributed sort, so that
the statistics of each are compared with those of the one before it by an equi-join on position, however many files a
table has. Changes follow the declarations, and are reported with the types seen before and after. Renames link the spans in which a name is present into lineages (by pointer doubling);
all columns of a lineage become one column, projected to its latest declared type, and every value that cannot be cast
is reported and left null. A path that its file does not declare takes the nearest declaration of its name in the table.

Defined cases: files without declared columns are left out of the comparison, but their records are in the table;
repeated rows count once; null and empty records keep a row without values; a record that is no JSON object, and a path
that no file of the table declares, are reported with their text; nested values are kept as JSON text; names are
compared exactly.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.plans.ranking import carry_last, with_position
from tidemark.session import cut_lineage

TABLE = ["db_name", "table_name"]
#: Separates the parts of a column's signature; it occurs in no name.
SEP = "\u0001"
#: Declared types and the Spark types they are projected to. Fixed values.
SPARK_TYPES = {"F64": "double", "I64": "bigint", "U64": "decimal(20,0)", "String": "string", "Bool": "boolean", "Time": "bigint"}
#: The columns that every row of the wide table has.
WIDE = [*TABLE, "_file_id", "_row_no", "_failed"]


def ordered_files(files: DataFrame, columns: DataFrame, role: str, statistics: DataFrame | None = None) -> DataFrame:
    """(db_name, table_name, file_id, position, columns): files with declared columns, in order, with an array of their
    columns (ordinal, name, kind, seen), where kind joins type and role, and seen the raw types that ``statistics`` (of
    :func:`path_statistics`) has for it; null without statistics or values."""
    kind = F.concat_ws(SEP, F.coalesce("column_type", F.lit("")), F.coalesce(F.col(role), F.lit("")))
    declared = columns.filter(F.col("column_name").isNotNull()).select("file_id", "ordinal", F.col("column_name").alias("name"), kind.alias("kind")).distinct()
    if statistics is None:
        declared = declared.withColumn("seen", F.lit(None).cast("string"))
    else:
        seen = statistics.filter("path IS NOT NULL AND raw_type <> 'VOID'").groupBy("file_id", F.col("path").alias("name")).agg(F.array_join(F.array_sort(F.collect_set("raw_type")), "|").alias("seen"))
        declared = declared.join(seen, ["file_id", "name"], "left")
    per_file = declared.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "name", "kind", "seen"))).alias("columns"))
    keyed = files.select(*TABLE, "file_id", "version", "creation_timestamp").distinct().join(per_file, "file_id")
    order = [F.col("version").asc(), F.col("creation_timestamp").asc(), F.col("file_id").asc()]
    return with_position(keyed, TABLE, order).select(*TABLE, "file_id", "position", "columns")


def _signatures(columns: Column) -> Column:
    return F.transform(columns, lambda c: F.concat(c["name"], F.lit(SEP), c["kind"]))


def _names(columns: Column) -> Column:
    return F.transform(columns, lambda c: c["name"])


def schema_changes(ordered: DataFrame) -> DataFrame:
    """(db_name, table_name, file_id, position, column_name, old_name, change, seen_before, seen) for every file but a
    table's first."""
    c = F.col
    before = ordered.select(*TABLE, (c("position") + 1).alias("position"), c("columns").alias("old"))
    both = ordered.join(before, [*TABLE, "position"])
    # Set differences of strings are hash-based; the pairwise comparison is left with what differs.
    fresh = F.array_except(_signatures(c("columns")), _signatures(c("old")))
    both = both.select(*TABLE, "file_id", "position", "columns", "old", fresh.alias("fresh"), _names(c("old")).alias("old_names"), F.array_except(_names(c("columns")), _names(c("old"))).alias("new"), F.array_except(_names(c("old")), _names(c("columns"))).alias("gone"))
    only = lambda columns, names: F.filter(columns, lambda x: F.array_contains(c(names), x["name"]))
    both = both.withColumn("new_columns", F.when(F.size("new") > 0, only(c("columns"), "new")).otherwise(F.slice("columns", 1, 0)))
    both = both.withColumn("gone_columns", F.when(F.size("gone") > 0, only(c("old"), "gone")).otherwise(F.slice("old", 1, 0)))
    same = lambda a, b: (a["ordinal"] == b["ordinal"]) & (a["kind"] == b["kind"])
    seen = lambda columns, name: F.get(F.filter(columns, lambda x: x["name"] == name), F.lit(0))["seen"]
    row = lambda name, old, change: F.struct(name.alias("column_name"), old.cast("string").alias("old_name"), F.lit(change).alias("change"), seen("old", old).alias("seen_before"), seen("columns", name).alias("seen"))
    retyped = F.transform(F.array_except(F.transform("fresh", lambda s: F.substring_index(s, SEP, 1)), c("new")), lambda n: row(n, n, "retyped"))
    added = F.transform(
        "new_columns",
        lambda x: F.when(F.exists("gone_columns", lambda g: same(x, g)), row(x["name"], F.element_at(F.filter("gone_columns", lambda g: same(x, g)), 1)["name"], "renamed")).otherwise(row(x["name"], F.lit(None), "added")),
    )
    removed = F.transform(F.filter("gone_columns", lambda g: ~F.exists("new_columns", lambda x: same(x, g))), lambda g: row(g["name"], g["name"], "removed"))
    changes = both.select(*TABLE, "file_id", "position", F.explode(F.concat(retyped, added, removed)).alias("x"))
    return changes.select(*TABLE, "file_id", "position", "x.column_name", "x.old_name", "x.change", "x.seen_before", "x.seen")


def path_values(records: DataFrame, every: bool = False) -> DataFrame:
    """(file_id, row_no, path, raw_type, value): one row per path of a record; value is text, null for a JSON null.

    With ``every``, a record without a path keeps one row whose path is null; if it is no JSON object, its text is the
    value, of the type UNREADABLE.
    """
    parsed = records.select("file_id", "row_no", "record", F.try_parse_json("record").alias("v"))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    if every:
        objects = parsed.select("file_id", "row_no", F.when(is_object, F.col("v")).alias("v"), F.when(~is_object, F.col("record")).alias("unread"))
        pairs = objects.lateralJoin(objects.sparkSession.tvf.variant_explode_outer(F.col("v").outer()))
    else:
        objects = parsed.filter(is_object)
        pairs = objects.lateralJoin(objects.sparkSession.tvf.variant_explode(F.col("v").outer()))
    kind = F.schema_of_variant("value")
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    text = F.when(nested, F.to_json("value")).when(kind != "VOID", F.try_variant_get("value", "$", "string"))
    raw = F.when(nested, F.substring_index(kind, "<", 1)).when(kind.startswith("DECIMAL") , "DOUBLE").otherwise(kind)
    if every:
        raw, text = F.when(F.col("unread").isNotNull(), "UNREADABLE").otherwise(raw), F.coalesce("unread", text)
    return pairs.select("file_id", "row_no", F.col("key").alias("path"), raw.alias("raw_type"), text.alias("value"))


def path_statistics(pairs: DataFrame) -> DataFrame:
    """(file_id, path, raw_type, values): how often each path held each raw type, by file."""
    return pairs.groupBy("file_id", "path", "raw_type").agg(F.count(F.lit(1)).alias("values"))


def lineages(ordered: DataFrame, changes: DataFrame, rounds: int = 64) -> DataFrame:
    """(db_name, table_name, file_id, name, start, column, target): the consistent column and type of each name in each
    file, and the position at which the name's span starts.

    A span starts where a name is added or renamed (or in the first file). A rename leads from the span that ends to
    the one that starts; following these links to their last span gives the column's name and its latest type.
    """
    c = F.col
    present = ordered.select(*TABLE, "file_id", "position", F.explode("columns").alias("x")).select(*TABLE, "file_id", "position", c("x.name").alias("name"), F.substring_index("x.kind", SEP, 1).alias("kind"))
    starts = changes.filter(c("change").isin("added", "renamed")).select(*TABLE, c("column_name").alias("name"), c("position").alias("start"), F.when(c("change") == "renamed", c("old_name")).alias("old"))
    starts = present.filter(c("position") == 0).select(*TABLE, "name", c("position").alias("start"), F.lit(None).cast("string").alias("old")).unionByName(starts)
    # The span of a name in a file starts at the latest start that is not after it.
    marked = present.join(starts.select(*TABLE, "name", c("start").alias("position"), c("start").alias("_start")), [*TABLE, "name", "position"], "left")
    spanned = carry_last(marked, [*TABLE, "name"], ["position"], "_start", "start").drop("_start")
    spans = spanned.groupBy(*TABLE, "name", "start").agg(F.max_by("kind", "position").alias("kind"), F.max("position").alias("end"))
    # A rename compares neighbours, so the span it leads from holds the file before.
    links = starts.filter(c("old").isNotNull()).select(*TABLE, c("old").alias("name"), (c("start") - 1).alias("position"), F.struct("name", "start").alias("next"))
    links = links.join(spanned.select(*TABLE, "name", "position", "start"), [*TABLE, "name", "position"]).select(*TABLE, "name", "start", "next")
    node = F.struct("name", "start")
    state = cut_lineage(spans.join(links, [*TABLE, "name", "start"], "left").select(*TABLE, node.alias("node"), F.coalesce("next", node).alias("last"), c("kind"), c("end")))
    for _ in range(rounds):  # doubles the reach each time
        ahead = state.select(*TABLE, c("node").alias("last"), c("last").alias("further"))
        state_next = cut_lineage(state.join(ahead, [*TABLE, "last"]).select(*TABLE, "node", c("further").alias("last"), "kind", "end", (c("further") != c("last")).alias("moved")))
        moved = state_next.filter("moved").limit(1).count()
        state = state_next.drop("moved")
        if not moved:
            break
    ends = state.filter(c("node") == c("last")).select(*TABLE, "last", c("kind").alias("target"))
    # Of lineages that end under one name, those that overlap in time are kept apart.
    spread = state.groupBy(*TABLE, "last").agg(F.min("node.start").alias("low"), F.max("end").alias("high"))
    from pyspark.sql import Window

    of = Window.partitionBy(*TABLE, "last.name").orderBy("low", "last.start")
    reach = F.max("high").over(of.rowsBetween(Window.unboundedPreceding, -1))
    apart = spread.withColumn("clash", F.coalesce((c("low") <= reach).cast("int"), F.lit(0)))
    apart = apart.withColumn("nth", F.sum("clash").over(of)).withColumn("nths", F.max("nth").over(Window.partitionBy(*TABLE, "last.name")))
    label = F.when(c("nth") == c("nths"), c("last.name")).otherwise(F.concat(c("last.name"), F.lit("#"), c("nth")))
    named = apart.select(*TABLE, "last", label.alias("column"), c("last.start").alias("since")).join(ends, [*TABLE, "last"])
    latest = named.groupBy(*TABLE, "column").agg(F.max_by("target", "since").alias("target"))
    whole = state.join(named.drop("target"), [*TABLE, "last"]).join(latest, [*TABLE, "column"])
    whole = whole.select(*TABLE, c("node.name").alias("name"), c("node.start").alias("start"), "column", "target")
    return spanned.join(whole, [*TABLE, "name", "start"]).select(*TABLE, "file_id", "name", "start", "column", "target")


def _tables(files: DataFrame) -> DataFrame:
    """(db_name, table_name, file_id, place): every file, with or without declared columns; place sorts them in order."""
    return files.groupBy(*TABLE, "file_id").agg(F.min(F.struct("version", "creation_timestamp", "file_id")).alias("place"))


def undeclared(pairs: DataFrame, files: DataFrame, columns: DataFrame) -> DataFrame:
    """(file_id, name, column, target) of the paths that records hold and their files do not declare.

    A path takes the column of the latest span of its name that starts in a file before its own, else of the first one
    after. It is left out if no file of the table declares the name, or if its file has that column under another name.
    """
    c = F.col
    held = pairs.filter(c("path").isNotNull()).select("file_id", c("path").alias("name")).distinct()
    placed = _tables(files)
    alone = held.join(columns, ["file_id", "name"], "left_anti").join(placed, "file_id")
    spans = columns.join(placed, [*TABLE, "file_id"]).groupBy(*TABLE, "name", "start", "column", "target").agg(F.min("place").alias("place"))
    span = F.struct(c("place").alias("since"), "start", "column", "target")
    first = spans.groupBy(*TABLE, "name").agg(F.min(span).alias("first"))
    spans = spans.select(*TABLE, F.lit(None).cast("bigint").alias("file_id"), "name", "place", span.alias("span"))
    met = alone.select(*TABLE, "file_id", "name", "place").unionByName(spans, allowMissingColumns=True)
    near = carry_last(met, [*TABLE, "name"], ["place"], "span", "before").filter(c("file_id").isNotNull()).join(first, [*TABLE, "name"])
    near = near.withColumn("near", F.coalesce("before", "first"))
    near = near.select("file_id", "name", c("near.column").alias("column"), c("near.target").alias("target"), c("near.since").alias("since"))
    one = near.groupBy("file_id", "column").agg(F.max_by(F.struct("name", "target"), F.struct("since", "name")).alias("x"))
    one = one.join(columns.select("file_id", "column"), ["file_id", "column"], "left_anti")
    return one.select("file_id", c("x.name").alias("name"), "column", c("x.target").alias("target"))


def consistent_rows(records: DataFrame, files: DataFrame, columns: DataFrame) -> DataFrame:
    """One row per record: ``values``, a map from consistent column to its value in the column's type (as text), and
    ``failed``, the columns whose raw value could not be cast, with that value.

    ``columns`` is the result of :func:`lineages`. ``failed`` also holds the paths :func:`undeclared` finds no column
    for (with the type UNDECLARED) and records that are no JSON object. The table of a file that is not in ``files``
    is null.
    """
    c = F.col
    known = columns.select("file_id", "name", "column", "target").unionByName(undeclared(path_values(records), files, columns))
    pairs = path_values(records, every=True)
    typed = pairs.join(known.withColumnRenamed("name", "path"), ["file_id", "path"], "left")
    cast = F.lit(None).cast("string")
    for declared, kind in SPARK_TYPES.items():
        whole = F.when(c("value").rlike(r"^[-+]?[0-9]+([.]0*)?$"), c("value").try_cast("decimal(38,0)")) if kind in ("bigint", "decimal(20,0)") else c("value")
        done = F.when(whole >= 0, whole.try_cast(kind)) if declared == "U64" else whole.try_cast(kind)
        cast = F.when(c("target") == declared, done.cast("string")).otherwise(cast)
    typed = typed.withColumn("cast", cast)
    lost = c("value").isNotNull() & c("cast").isNull()
    place = F.when(c("column").isNotNull(), F.concat_ws(" ", "column", "target")).when(c("path").isNotNull(), F.concat_ws(" ", "path", F.lit("UNDECLARED")))
    whole = typed.groupBy("file_id", "row_no").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.when(c("column").isNotNull(), F.struct("column", "cast")))))).alias("values"),
        F.array_join(F.array_sort(F.collect_list(F.when(lost, F.concat_ws(" ", place, "raw_type", "value")))), "; ").alias("failed"),
    )
    return whole.join(_tables(files).drop("place"), "file_id", "left").select(*TABLE, "file_id", "row_no", "values", "failed")


def wide_names(columns: DataFrame) -> list[tuple[str, str, str]]:
    """(column, target, label): every consistent column of any database table, and its name in :func:`wide_rows`.

    A column that all tables spell and type alike keeps its name. Tables that do not agree each have a column of their
    own, as ``name:target``, numbered where names differ by case only. Only these names come to the driver.
    """
    known = sorted((r["column"], r["target"]) for r in columns.select("column", "target").distinct().collect())
    # Spark takes names that differ by case only for one column.
    fold = lambda name: name.upper().lower()
    held = Counter([fold(column) for column, _ in known] + WIDE)
    taken, names = set(held), []
    for column, target in known:
        label, n = column, 1
        if held[fold(column)] > 1:
            label = f"{column}:{target}"
            while fold(label) in taken:
                n += 1
                label = f"{column}:{target}:{n}"
            taken.add(fold(label))
        names.append((column, target, label))
    return names


def wide_rows(records: DataFrame, files: DataFrame, columns: DataFrame) -> DataFrame:
    """One row per record of every database table, as typed columns: those of :func:`wide_names`, null where a record's
    table has no such column. ``_failed`` is that of :func:`consistent_rows`, by the names given here."""
    c = F.col
    names = wide_names(columns)
    labels = columns.sparkSession.createDataFrame(names, "column string, target string, label string")
    labelled = columns.join(labels, ["column", "target"]).select(*TABLE, "file_id", "name", "start", c("label").alias("column"), "target")
    # The option keeps a name of any text from being taken for Spark's column of unreadable rows, and the text from
    # being parsed once for each column.
    schema = StructType([StructField(label, StringType()) for _, _, label in names])
    held = F.from_json("values", schema, {"columnNameOfCorruptRecord": SEP}).alias("held")
    rows = consistent_rows(records, files, labelled).select(*TABLE, "file_id", "row_no", held, "failed")
    typed = [c("held").getField(label).cast(SPARK_TYPES.get(target, "string")).alias(label) for _, target, label in names]
    return rows.select(*TABLE, c("file_id").alias("_file_id"), c("row_no").alias("_row_no"), *typed, c("failed").alias("_failed"))
