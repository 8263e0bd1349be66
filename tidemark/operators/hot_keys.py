"""Per-key results where a handful of keys hold most rows.

Rows are never brought together by key. Each input split (splits are equal in bytes, whatever keys they hold) is
dictionary-encoded and reduced into dense accumulator arrays with ``numpy.bincount`` and scatter-minimum/maximum; what
leaves the split is one page per block of keys: the page's dictionary and its arrays. Pages are then summed block by
block in a distributed reduction of two rounds, so that no task sees more than its share of pages, and a hot key costs
one array slot per split like any other. Blocks are many more than tasks, and a task holds one at a time.

Whole numbers are summed exactly, as their upper and lower 32 bits apart.

Defined cases: a null key is a key of its own; null times and values are not counted in bounds, ``values`` or ``total``
though their row is in ``rows``; NaN counts as a value; a value without an order is never the last; an empty table gives
no rows. Only the named columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT_MIN, INT_MAX = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: A split's dictionary is sent on and started anew beyond this many keys, which bounds a task's memory.
FLUSH_KEYS = 1 << 19


#: Accumulators: how a slot starts, and how two of them are merged. Fixed values.
ADDED = ("rows", "values", "total", "upper", "lower")
START = {"rows": 0, "values": 0, "total": 0.0, "upper": 0, "lower": 0, "low": INT_MAX, "high": INT_MIN, "last_order": INT_MIN, "last_value": np.nan}
FLOATS = ("total", "last_value")


class _Dense:
    """Accumulator arrays over a growing dictionary: ``ids`` maps a key to its slot."""

    def __init__(self, names: list[str]) -> None:
        self.ids: dict[tuple, int] = {}
        self.arrays = {n: np.zeros(0, np.float64 if n in FLOATS else np.int64) for n in names}

    def slots(self, keys: list[tuple]) -> np.ndarray:
        ids = self.ids
        found = np.fromiter((ids.setdefault(k, len(ids)) for k in keys), np.int64, len(keys))
        held = len(self.arrays["rows"])
        if (short := len(ids) - held) > 0:
            room = max(short, held)
            for name, a in self.arrays.items():
                self.arrays[name] = np.concatenate([a, np.full(room, START[name], a.dtype)])
        return found

    def merge(self, slots: np.ndarray, page: dict[str, np.ndarray]) -> None:
        """Scatter one page; its slots are distinct, so plain indexing is enough."""
        held = self.arrays
        for name in ADDED:
            if name in held:
                held[name][slots] += page[name]
        held["low"][slots] = np.minimum(held["low"][slots], page["low"])
        held["high"][slots] = np.maximum(held["high"][slots], page["high"])
        if "last_order" in held:
            order, value = held["last_order"][slots], held["last_value"][slots]
            newer = (page["last_order"] > order) | (page["last_order"] == order) & (page["last_value"] > value)
            held["last_order"][slots] = np.where(newer, page["last_order"], order)
            held["last_value"][slots] = np.where(newer, page["last_value"], value)


def _encode(batch: pa.RecordBatch, n_keys: int) -> tuple[np.ndarray, list[tuple]]:
    """Dense local codes of the key columns, and the key of each code."""
    codes, dictionaries = np.zeros(batch.num_rows, np.int64), []
    for k in range(n_keys):
        column = batch.column(k).dictionary_encode(null_encoding="encode")
        dictionary = column.dictionary.to_pylist()
        # Compacted after every column, so the mixed radix never exceeds rows x dictionary size.
        seen, codes = np.unique(codes * max(1, len(dictionary)) + column.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        dictionaries.append((seen, dictionary))
    keys: list[tuple] = [()]
    for seen, dictionary in dictionaries:
        n = max(1, len(dictionary))
        keys = [keys[s // n] + (dictionary[s % n],) for s in seen.tolist()]
    return codes, keys


def _reduce_split(n_keys: int, key_types: list[pa.DataType], names: list[str], blocks: int):  # noqa: ANN202
    def page_of(batch: pa.RecordBatch, codes: np.ndarray, n: int) -> dict[str, np.ndarray]:
        time, value = batch.column(n_keys), batch.column(n_keys + 1)
        at = np.asarray(time.is_valid())
        t, tc = time.fill_null(0).to_numpy(zero_copy_only=False)[at], codes[at]
        page = {"rows": np.bincount(codes, minlength=n), "low": np.full(n, INT_MAX), "high": np.full(n, INT_MIN)}
        np.minimum.at(page["low"], tc, t)
        np.maximum.at(page["high"], tc, t)
        has = np.asarray(value.is_valid())
        v, vc = value.fill_null(0).to_numpy(zero_copy_only=False)[has], codes[has]
        page["values"] = np.bincount(vc, minlength=n)
        if "upper" in names:  # a batch's sums of 32 bits are exact in doubles
            page["upper"] = np.bincount(vc, weights=v >> 32, minlength=n).astype(np.int64)
            page["lower"] = np.bincount(vc, weights=v & 0xFFFFFFFF, minlength=n).astype(np.int64)
        else:
            page["total"] = np.bincount(vc, weights=v, minlength=n)
        if "last_order" in names:
            order = batch.column(n_keys + 2)
            known = has & np.asarray(order.is_valid())
            o, v, vc = order.fill_null(0).to_numpy(zero_copy_only=False)[known], value.fill_null(0).to_numpy(zero_copy_only=False)[known].astype(np.float64), codes[known]
            page["last_order"], page["last_value"] = np.full(n, INT_MIN), np.full(n, np.nan)
            placed = np.lexsort((v, o, vc))
            ends = placed[np.flatnonzero(np.diff(vc[placed], append=-1))] if len(placed) else placed
            page["last_order"][vc[ends]], page["last_value"][vc[ends]] = o[ends], v[ends]
        return page

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Dense(names)
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, keys = _encode(batch, n_keys)
            held.merge(held.slots(keys), page_of(batch, codes, len(keys)))
            if len(held.ids) > FLUSH_KEYS:
                yield from _pages(held, key_types, blocks)
                held = _Dense(names)
        yield from _pages(held, key_types, blocks)

    return run


def _pages(held: _Dense, key_types: list[pa.DataType], blocks: int) -> Iterator[pa.RecordBatch]:
    """One row for each block of keys: dictionary page and accumulator arrays."""
    if not held.ids:
        return
    keys = list(held.ids)
    block = np.fromiter((_block_of(k, blocks) for k in keys), np.int64, len(keys))
    order = np.argsort(block, kind="stable")
    starts = np.flatnonzero(np.diff(block[order], prepend=-1))
    offsets = pa.array(np.append(starts, len(keys)), pa.int32())
    listed = lambda a: pa.ListArray.from_arrays(offsets, a)
    columns = [pa.array(block[order][starts], pa.int64())]
    columns += [listed(pa.array([keys[i][k] for i in order.tolist()], kind)) for k, kind in enumerate(key_types)]
    columns += [listed(pa.array(a[: len(keys)][order])) for a in held.arrays.values()]
    yield pa.RecordBatch.from_arrays(columns, names=["block", *(f"k{i}" for i in range(len(key_types))), *held.arrays])


def _block_of(key: tuple, blocks: int) -> int:
    """A stable spread of keys over blocks (Python's own string hash differs between workers)."""
    import xxhash

    return xxhash.xxh3_64_intdigest(repr(key).encode("utf-8", "surrogatepass")) % blocks


def _results(held: _Dense, key_types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    if not (n := len(held.ids)):
        return
    arrays = {name: a[:n] for name, a in held.arrays.items()}
    columns = {f"k{i}": pa.array([key[i] for key in held.ids], kind) for i, kind in enumerate(key_types)}
    none, empty = arrays["low"] > arrays["high"], arrays["values"] == 0
    columns |= {"rows": pa.array(arrays["rows"]), "values": pa.array(arrays["values"])}
    if "upper" in arrays:
        columns["total"] = pa.array([None if e else (u << 32) + w for e, u, w in zip(empty.tolist(), arrays["upper"].tolist(), arrays["lower"].tolist(), strict=True)], pa.decimal128(38, 0))
    else:
        columns["total"] = pa.array(arrays["total"], mask=empty)
    columns |= {"low": pa.array(arrays["low"], mask=none), "high": pa.array(arrays["high"], mask=none)}
    if "last_order" in arrays:
        never = arrays["last_order"] == INT_MIN
        columns |= {name: pa.array(arrays[name], mask=never) for name in ("last_order", "last_value")}
    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _reduce_pages(n_keys: int, key_types: list[pa.DataType], names: list[str], blocks: int, final: bool):  # noqa: ANN202
    """Sums the pages of one block after the other; pages come sorted by block."""

    def done(held: _Dense) -> Iterator[pa.RecordBatch]:
        return _results(held, key_types) if final else _pages(held, key_types, blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = _Dense(names), None
        for batch in batches:
            lists = {name: batch.column(name) for name in (*(f"k{i}" for i in range(n_keys)), *names)}
            for row, own in enumerate(batch.column("block").to_pylist()):
                if own != block:
                    yield from done(held)
                    held, block = _Dense(names), own
                page = {name: lists[name][row].values for name in lists}
                keys = list(zip(*(page[f"k{i}"].to_pylist() for i in range(n_keys)), strict=True))
                held.merge(held.slots(keys), {name: page[name].to_numpy(zero_copy_only=False) for name in names})
        yield from done(held)

    return run


def key_totals(df: DataFrame, keys: list[str], time: str = "time", value: str | None = None, order: str | None = None, blocks: int | None = None) -> DataFrame:
    """One row for each key: ``rows``, ``values`` (non-null), ``total``, ``time_min``, ``time_max``; with ``order`` also
    ``last_value``, as a double, and its ``last_order``: of equal orders the larger value counts.

    ``total`` is a decimal(38,0) for whole numbers, else a double. ``blocks`` spreads the dictionary (32 for each shuffle
    partition if not given). Pages go through lanes first, as many as the square root of the number of splits, so that
    both rounds of the reduction merge about as many pages in a task.
    """
    spark, c = df.sparkSession, F.col
    blocks = blocks or 32 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    types = [df.schema[k].dataType for k in keys]
    arrow = [_arrow_type(t) for t in types]
    whole = value is not None and isinstance(df.schema[value].dataType, T.IntegralType)
    number = c(f"`{value}`").cast("bigint" if whole else "double") if value else F.lit(None).cast("double")
    names = ["rows", "values", *(("upper", "lower") if whole else ("total",)), "low", "high", *(("last_order", "last_value") if order else ())]
    rows = df.select(*[c(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], c(f"`{time}`").cast("bigint").alias("t"), number.alias("v"), *([c(f"`{order}`").cast("bigint").alias("o")] if order else []))
    kind = lambda n: T.DoubleType() if n in FLOATS else T.LongType()
    page = T.StructType([T.StructField("block", T.LongType()), *(T.StructField(f"k{i}", T.ArrayType(t)) for i, t in enumerate(types)), *(T.StructField(n, T.ArrayType(kind(n))) for n in names)])
    results = {"rows": T.LongType(), "values": T.LongType(), "total": T.DecimalType(38, 0) if whole else T.DoubleType(), "low": T.LongType(), "high": T.LongType()}
    results |= {"last_order": T.LongType(), "last_value": T.DoubleType()} if order else {}
    out = T.StructType([*(T.StructField(f"k{i}", t) for i, t in enumerate(types)), *(T.StructField(n, t) for n, t in results.items())])
    pages = rows.mapInArrow(_reduce_split(len(keys), arrow, names, blocks), page)
    # Pages of one split go to one lane: the lane is set by where the page was made.
    lanes = max(2, math.isqrt(rows.rdd.getNumPartitions()))
    laned = pages.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(lanes)))
    first = laned.repartition(c("block"), c("lane")).sortWithinPartitions("block").drop("lane").mapInArrow(_reduce_pages(len(keys), arrow, names, blocks, False), page)
    last = first.repartition(c("block")).sortWithinPartitions("block").mapInArrow(_reduce_pages(len(keys), arrow, names, blocks, True), out)
    shown = {"low": "time_min", "high": "time_max"}
    return last.select(*[c(f"k{i}").alias(k) for i, k in enumerate(keys)], *[c(n).alias(shown.get(n, n)) for n in results])


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def heavy_keys(df: DataFrame, keys: list[str], share: tuple[int, int] = (3, 100), time: str = "time") -> DataFrame:
    """The keys that hold more than ``share`` of all rows, with their totals."""
    totals = key_totals(df, keys, time)
    whole = df.select(F.count(F.lit(1)).alias("n")).scalar()
    return totals.filter(F.col("rows") * share[1] > whole * share[0])


def last_values(df: DataFrame, point: list[str], value: str = "value", order: str = "seq") -> DataFrame:
    """The last non-null ``value`` of every point (null if it never had one), as a double, with its ``order`` and the
    number of times the point was written. Of equal ``order`` the larger value counts."""
    totals = key_totals(df, point, order, value, order)
    return totals.select(*[F.col(f"`{p}`") for p in point], F.col("last_value").alias(value), F.col("last_order").alias(order), F.col("rows").alias("writes"))
