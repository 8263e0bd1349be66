"""The engine: databases by name, writing, time-series requests, and SQL over tables and system tables."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.sqlnames import outside_quotes, register, write_out
from tidemark.lifecycle.policy import maintain
from tidemark.plans.predicate import Predicate
from tidemark.plans.requests import Database
from tidemark.session import scratch_path
from tidemark.sources import system_tables
from tidemark.store.database import Db, Rules
from tidemark.store.storage import Storage

_NAME = re.compile(r"^[A-Za-z0-9%][A-Za-z0-9_.%-]*$")
#: Schemas in front of a table's name, with the prefix of the views that stand for their tables.
_SCHEMAS = {"system": "_system_", "information_schema": "_information_", "default": ""}
_QUALIFIED = re.compile(r"\b(?:public\.)?(system|information_schema|default)\.([A-Za-z_]\w*)", re.IGNORECASE)
_SHOW_TABLES = re.compile(r"^\s*SHOW\s+TABLES\s*;?\s*$", re.IGNORECASE)
_SHOW_COLUMNS = re.compile(r"^\s*SHOW\s+COLUMNS\s+FROM\s+(?:public\.)?(?:default\.)?[\"`]?([^\"`;]+?)[\"`]?\s*;?\s*$", re.IGNORECASE)
_EXPLAIN = re.compile(r"^\s*EXPLAIN\s+(VERBOSE\s+)?(?=SELECT|WITH|VALUES|TABLE|\()", re.IGNORECASE)


@dataclass
class Engine:
    """Databases under one folder that all executors share."""

    spark: SparkSession
    root: str | None = None
    databases: dict[str, Db] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.root = self.root or scratch_path(self.spark, "databases")

    def create_database(self, name: str, rules: Rules | None = None, **settings) -> Db:  # noqa: ANN003
        """A new database, or one that is found under the folder by its log."""
        if not _NAME.match(name):
            raise ValueError(f"not a name of a database: {name!r}")
        if name in self.databases:
            raise ValueError(f"database exists: {name}")
        self.databases[name] = Db(self.spark, name, self.root, rules or Rules(), **settings)
        return self.databases[name]

    def restore(self) -> list[str]:
        """Open the databases that lie under the folder; their names. Tables are what was persisted."""
        storage = Storage(self.spark, str(self.root).rstrip("/"))
        names = [n for n in map(str, map(PurePosixPath, storage.names(""))) if n not in self.databases and storage.exists(f"{n}/log")]
        for name in names:
            self.create_database(name)
        return names

    def write_lines(self, db: str, lines: str | list[str] | DataFrame, default_time: int | None = None) -> int:
        return self.databases[db].write_lines(lines, default_time)

    def maintain(self) -> dict[str, dict[str, int]]:
        """One round of maintenance of every database."""
        return {name: maintain(db) for name, db in sorted(self.databases.items())}

    def requests(self, db: str, predicate: Predicate = Predicate()) -> Database:
        """The time-series requests over a database; chunks that the predicate cannot meet are left out."""
        held = self.databases[db]
        return Database(self.spark, {n: held.table(n, predicate) for n in sorted(held.schemas) if predicate.includes_table(n)})

    def system(self, db: str, name: str) -> DataFrame:
        return system_tables.SYSTEM[name](self.spark, self.databases[db])

    def observe(self, name: str) -> DataFrame | None:
        """A system table of all databases, with the database's name in front."""
        return system_tables.observed({db: self.system(db, name) for db in self.databases})

    def _views(self, db: str, text: str) -> None:
        """Views of what a statement may name. A view is a plan, so those it does not use cost nothing."""
        held = self.databases[db]
        wanted = text.lower()
        for name in held.schemas:
            if name.lower() in wanted:
                held.table(name).shown().createOrReplaceTempView(f"`{name}`")
        for name in system_tables.SYSTEM:
            if f"_system_{name}" in wanted:
                self.system(db, name).createOrReplaceTempView(f"_system_{name}")
        if "_information_columns" in wanted:
            system_tables.information_columns(self.spark, held.schemas).createOrReplaceTempView("_information_columns")
        if "_information_tables" in wanted:
            system_tables.information_tables(self.spark, {"default": list(held.schemas)}).createOrReplaceTempView("_information_tables")

    def sql(self, db: str, text: str, format: str | None = None) -> DataFrame | str:  # noqa: A002
        """A statement over the tables of a database; as text if a format (pretty, csv, json) is given."""
        held = self.databases[db]
        register(self.spark)
        if _SHOW_TABLES.match(text):
            df = system_tables.information_tables(self.spark, {"default": list(held.schemas)})
        elif shown := _SHOW_COLUMNS.match(text):
            if shown[1] not in held.schemas:
                raise ValueError(f"no table {shown[1]}")
            df = system_tables.information_columns(self.spark, {shown[1]: held.schemas[shown[1]]}).drop("role", "ordinal_position")
        else:
            body = _EXPLAIN.sub(lambda m: "EXPLAIN EXTENDED " if m[1] else "EXPLAIN FORMATTED ", text)
            body = outside_quotes(write_out(body), lambda part: _QUALIFIED.sub(lambda m: _SCHEMAS[m[1].lower()] + m[2], part))
            self._views(db, body)
            df = self.spark.sql(body.rstrip().rstrip(";"))
        return df if format is None else render(df, format)


def render(df: DataFrame, format: str) -> str:  # noqa: A002
    """A result as text: a table, CSV with a header, or a JSON array. Results are for clients, so they come whole."""
    if format == "json":
        return "[" + ",".join(df.toJSON().toLocalIterator()) + "]"
    rows = [["" if v is None else str(v).lower() if isinstance(v, bool) else str(v) for v in row] for row in df.toLocalIterator()]
    if format == "csv":
        quoted = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n\r') else v
        return "\n".join(",".join(map(quoted, r)) for r in [df.columns, *rows]) + "\n"
    if format != "pretty":
        raise ValueError(f"unknown format: {format}")
    widths = [max(map(len, column)) for column in zip(df.columns, *rows, strict=True)]
    line = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    put = lambda row: "|" + "|".join(f" {v:<{w}} " for v, w in zip(row, widths, strict=True)) + "|"
    return "\n".join([line, put(df.columns), line, *map(put, rows), line])


class Repl:
    """A line-by-line client: USE, SHOW DATABASES, OBSERVER, SET FORMAT, HELP, EXIT, and SQL for the rest."""

    HELP = "USE <database>; SHOW DATABASES; OBSERVER; SET FORMAT <pretty|csv|json>; HELP; EXIT; or a SQL statement"

    def __init__(self, engine: Engine) -> None:
        self.engine, self.db, self.format, self.observing = engine, None, "pretty", False

    def run(self, line: str) -> str | None:
        """The answer to one line; None to end."""
        words = line.strip().rstrip(";").split()
        head = [w.upper() for w in words]
        if not words:
            return ""
        if head[0] in ("EXIT", "QUIT"):
            return None
        if head == ["HELP"]:
            return self.HELP
        if head == ["SHOW", "DATABASES"]:
            return json.dumps(sorted(self.engine.databases))
        if head == ["OBSERVER"]:
            self.observing = True
            for name in system_tables.SYSTEM:
                if (seen := self.engine.observe(name)) is not None:
                    seen.createOrReplaceTempView(name)
            return "system tables of all databases: " + ", ".join(system_tables.SYSTEM)
        if head[:2] == ["SET", "FORMAT"] and len(words) == 3:
            if words[2].lower() not in ("pretty", "csv", "json"):
                return f"unknown format: {words[2]}"
            self.format = words[2].lower()
            return f"format is {self.format}"
        if head[0] == "USE" and len(words) in (2, 3):
            if words[-1] not in self.engine.databases:
                return f"no database {words[-1]}"
            self.db, self.observing = words[-1], False
            return f"using {self.db}"
        try:
            if self.observing:
                return render(self.engine.spark.sql(line.strip().rstrip(";")), self.format)
            return "no database in use" if self.db is None else self.engine.sql(self.db, line, self.format)
        except Exception as problem:  # noqa: BLE001
            return f"error: {str(problem).splitlines()[0]}"
