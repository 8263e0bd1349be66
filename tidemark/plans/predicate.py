"""Predicates of the time-series requests: a conjunction of table, field, partition, time-range and column conditions,
and the translation of request trees into it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.schema import TIME, TsTable

# The names requests use for the measurement and the field.
MEASUREMENT_REF, FIELD_REF = ("_measurement", "\x00"), ("_field", "\xff")


class UnsupportedPredicate(ValueError):
    """A condition that requests do not offer."""


@dataclass(frozen=True)
class Ref:
    name: str


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Compare:
    """``= != < <= > >=``, ``=~`` and ``!~`` (unanchored regular expressions)."""

    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Arithmetic:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Logical:
    op: str
    parts: tuple


_COMPARE = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}
_ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b}
#: Look-around, back references, atomic groups and possessive quantifiers.
_LOOK = re.compile(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|\\k<|(?<!\\)[*+?}]\+")


def regex_match(column: Column, pattern: str) -> Column:
    """Unanchored match, null for null. Constructs outside regular languages are refused."""
    if _LOOK.search(pattern):
        raise UnsupportedPredicate(f"only regular languages are supported: {pattern}")
    return column.rlike(pattern)


def to_column(node: Any) -> Column:
    match node:
        case Ref(name):
            return F.col(f"`{name}`")
        case Literal(value):
            return F.lit(value)
        case Compare(op, left, right) if op in _COMPARE:
            return _COMPARE[op](to_column(left), to_column(right))
        case Compare("=~", left, Literal(pattern)):
            return regex_match(to_column(left), pattern)
        case Compare("!~", left, Literal(pattern)):
            return ~regex_match(to_column(left), pattern)
        case Arithmetic(op, left, right) if op in _ARITHMETIC:
            return _ARITHMETIC[op](to_column(left), to_column(right))
        case Logical("and", parts):
            return reduce(lambda a, b: a & b, map(to_column, parts))
        case Logical("or", parts):
            return reduce(lambda a, b: a | b, map(to_column, parts))
    raise UnsupportedPredicate(f"not supported in requests: {node}")


def columns_of(node: Any) -> set[str]:
    match node:
        case Ref(name):
            return {name}
        case Compare(_, left, right) | Arithmetic(_, left, right):
            return columns_of(left) | columns_of(right)
        case Logical(_, parts):
            return set().union(*map(columns_of, parts))
    return set()


@dataclass(frozen=True)
class Predicate:
    """All parts must hold. ``None`` means no restriction; a time range is half-open."""

    tables: frozenset[str] | None = None
    fields: frozenset[str] | None = None
    partition_key: str | None = None
    start: int | None = None
    end: int | None = None
    exprs: tuple = field(default_factory=tuple)

    def table(self, *names: str) -> Predicate:
        return replace(self, tables=frozenset(names) | (self.tables or frozenset()))

    def field_columns(self, *names: str) -> Predicate:
        return replace(self, fields=frozenset(names) | (self.fields or frozenset()))

    def range(self, start: int, end: int) -> Predicate:
        return replace(self, start=start, end=end)

    def where(self, *nodes: Any) -> Predicate:
        return replace(self, exprs=(*self.exprs, *nodes))

    def includes_table(self, name: str) -> bool:
        return self.tables is None or name in self.tables

    def includes_field(self, name: str) -> bool:
        return self.fields is None or name in self.fields

    def condition(self) -> Column | None:
        parts = [to_column(e) for e in self.exprs]
        if self.start is not None:
            parts.append(F.col(TIME) >= F.lit(self.start))
        if self.end is not None:
            parts.append(F.col(TIME) < F.lit(self.end))
        return reduce(lambda a, b: a & b, parts) if parts else None

    def missing(self, table: TsTable) -> set[str]:
        """Columns of the conditions that the table lacks; such a table is skipped."""
        return set().union(*map(columns_of, self.exprs)) - table.schema.columns.keys() if self.exprs else set()

    def apply(self, table: TsTable) -> DataFrame | None:
        """The table's matching rows, or None if it lacks a column the conditions name."""
        if self.missing(table):
            return None
        condition = self.condition()
        df = table.df
        if self.partition_key is not None:
            if "_partition_key" not in df.columns:
                return None
            df = df.filter(F.col("_partition_key") == self.partition_key)
        return df if condition is None else df.filter(condition)


# Request trees: dicts with "type" and, by type, "children", "value", "op" or "name".


def from_tree(tree: dict | None, base: Predicate | None = None) -> Predicate:
    """Predicate of a request tree: unwrapped, split at its ANDs; conditions on the measurement or field become sets."""
    predicate = base or Predicate()
    if not tree:
        return predicate
    for part in _conjuncts(_normal(tree)):
        special = _name_set(part)
        if special is None:
            predicate = predicate.where(_node(part))
        elif special[0] == "table":
            predicate = replace(predicate, tables=special[1] if predicate.tables is None else predicate.tables & special[1])
        else:
            predicate = replace(predicate, fields=special[1] if predicate.fields is None else predicate.fields & special[1])
    return predicate


def _normal(node: dict) -> dict:
    """Parentheses and other nodes that only wrap one child are dropped."""
    children = [_normal(c) for c in node.get("children", ())]
    if len(children) == 1 and node["type"] in ("paren", "root") or node["type"] == "logical" and len(children) == 1:
        return children[0]
    return node | {"children": children} if children else node


def _conjuncts(node: dict) -> list[dict]:
    if node["type"] == "logical" and node["op"].lower() == "and":
        return [part for child in node["children"] for part in _conjuncts(child)]
    return [node]


def _name_set(node: dict) -> tuple[str, frozenset[str]] | None:
    """("table" or "field", names) of ``ref = name`` or of an OR of such."""
    if node["type"] == "logical" and node["op"].lower() == "or":
        parts = [_name_set(c) for c in node["children"]]
        if any(p is None for p in parts):
            return None
        kinds = {p[0] for p in parts}
        return (kinds.pop(), frozenset().union(*(p[1] for p in parts))) if len(kinds) == 1 else None
    if node["type"] != "compare" or node["op"] not in ("=", "equal"):
        return None
    left, right = node["children"]
    if left["type"] in ("tag", "field") and right["type"] == "literal":
        if left["name"] in MEASUREMENT_REF:
            return "table", frozenset([right["value"]])
        if left["name"] in FIELD_REF:
            return "field", frozenset([right["value"]])
    return None


_TREE_OPS = {
    "equal": "=", "not_equal": "!=", "lt": "<", "lte": "<=", "gt": ">", "gte": ">=", "regex": "=~", "not_regex": "!~",
}


def _node(node: dict) -> Any:
    kind, children = node["type"], node.get("children", [])
    if kind == "literal":
        return Literal(node["value"])
    if kind in ("tag", "field"):
        if node["name"] in (*MEASUREMENT_REF, *FIELD_REF):
            raise UnsupportedPredicate("measurement and field can only be compared with names, by equality")
        return Ref(node["name"])
    if kind == "compare":
        op = _TREE_OPS.get(node["op"], node["op"])
        if len(children) != 2 or op not in {*_COMPARE, "=~", "!~"}:
            raise UnsupportedPredicate(f"comparison not supported: {node['op']}")
        return Compare(op, *map(_node, children))
    if kind == "logical":
        if node["op"].lower() not in ("and", "or") or not children:
            raise UnsupportedPredicate(f"logical operator not supported: {node['op']}")
        return Logical(node["op"].lower(), tuple(map(_node, children)))
    raise UnsupportedPredicate(f"node not supported: {kind}")
