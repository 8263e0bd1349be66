"""Filling containers of fixed capacity with texts of varying length.

Lengths are tokens of a public tokenizer, whose file is a parameter. A text longer than the capacity is cut, at token
boundaries that are character boundaries, into pieces that fit; no other text is split. Items are then packed by
conflict-constrained best-fit, largest first:

* open bins are ordered by the space they have left; each carries a bitmap of the duplicate clusters and one of the
  sources it holds;
* the search starts at the bins with the least sufficient space and goes on to the next larger residual until it meets
  a bin without a text of the item's cluster; among bins of one residual those without the item's source come first;
* if every bin that fits holds a copy, the item opens a new bin. Only a cluster with more copies than the bins that the
  total length needs at least, which cannot have a bin for each copy without leaving most of them empty, shares bins
  once that many are open; such rows are marked ``conflict``.

Items are packed in two orders, by falling size and with the texts that have copies first, and the packing with fewer
bins is kept: copies that come late find every open bin taken, copies that come first are in the way of long texts.

Items are spread over shards by a hash of document and piece, so a source or cluster with a third of all rows is spread
too; a shard holds ``SHARD`` items on average and is packed by one task. A shard leaves at most about one half-filled
bin, a share of one in some hundreds.

Defined cases: null texts and texts without tokens are in no container; ``max_tokens`` null or below 1 makes a capacity
without containers; repeated rows of a document id are packed each; null sources count as one source.
"""

from __future__ import annotations

import base64
import os
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, enough_tasks

#: The vocabulary texts are measured with, unless another file is given.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items packed together by one task, on average.
SHARD = 40_000
#: A piece may end so many tokens before the capacity, for it to end at a word's end.
BACK = 16
#: Characters encoded at a time; longer texts are encoded in stretches that end before white space.
STRETCH = 50_000
#: Sources are told apart by this many bits.
SOURCE_BITS = 6
#: Most capacities of one call: a small table of settings.
MOST_CAPACITIES = 1_000


def tokenizer(path: str):  # noqa: ANN201
    """The tokenizer of a rank file, kept for the life of a worker (this code itself is sent anew with each task)."""
    import tiktoken

    held = vars(tiktoken).setdefault("_tidemark_by_path", {})
    if path not in held:
        held[path] = _load(path)
    return held[path]


def _load(path: str):  # noqa: ANN202
    import tiktoken

    if not os.path.exists(path):
        from pyspark import SparkFiles

        path = SparkFiles.get(os.path.basename(path))
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    enc = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    widths = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
    for token, rank in ranks.items():
        widths[rank] = len(token)
    enc.tidemark_widths = widths
    return enc


def _stretches(text: str) -> list[str]:
    parts, start = [], 0
    while len(text) - start > STRETCH:
        end = start + STRETCH
        while end > start + STRETCH // 2 and not text[end].isspace():
            end -= 1
        if end == start + STRETCH // 2:
            end = start + STRETCH
        parts.append(text[start:end])
        start = end
    return [*parts, text[start:]]


def encode(path: str, text: str) -> list[int]:
    """Tokens of a whole text of any length."""
    enc = tokenizer(path)
    if len(text) <= STRETCH:
        return enc.encode_ordinary(text)
    return [t for part in _stretches(text) for t in enc.encode_ordinary(part)]


def _ends(path: str, text: str, tokens: list[int]) -> np.ndarray:
    """Code points of ``text`` that are complete after each token."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    points = np.append(np.flatnonzero((raw & 0xC0) != 0x80)[1:], len(raw))  # where each code point ends
    return np.searchsorted(points, np.cumsum(tokenizer(path).tidemark_widths[np.asarray(tokens)]), side="right")


def pieces(path: str, text: str, tokens: list[int], capacity: int, ends: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the pieces of a text, each of at most ``capacity`` tokens when encoded by itself.

    No word of the tokenizer's pattern holds white space after other characters, so a piece that ends before white space
    has the tokens it has in the whole text. Where there is no such place near the capacity, the piece is encoded again.
    """
    if len(tokens) <= capacity:
        return [(0, len(text), len(tokens))]
    ends = _ends(path, text, tokens) if ends is None else ends
    at_space = lambda e: text[e : e + 1].isspace() and not text[e - 1].isspace()
    found, at, start, aligned = [], 0, 0, True
    while start < len(text):
        stop = min(at + capacity, len(tokens))
        n = 0
        if aligned:
            if stop == len(tokens):
                end, n = len(text), stop - at
            else:
                back = next((k for k in range(stop, max(at, stop - BACK), -1) if at_space(int(ends[k - 1]))), None)
                if back is not None:
                    end, n, stop = int(ends[back - 1]), back - at, back
        if not n:
            end = int(ends[stop - 1]) if stop < len(tokens) else len(text)
            while True:
                end = max(end, start + 1)  # a capacity below one character's tokens still goes forward
                n = len(encode(path, text[start:end]))
                if n <= capacity or end == start + 1:
                    break
                stop -= max(1, n - capacity)
                end = int(ends[stop - 1]) if stop > at else start + 1
        found.append((start, end, n))
        at = int(np.searchsorted(ends, end, side="right"))
        aligned = at > 0 and int(ends[at - 1]) == end and (end >= len(text) or at_space(end))
        start = end
    return found


def _measure(path: str, capacities: list[tuple[int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ("capacity_id", "doc_id", "piece_no", "start_pos", "end_pos", "n_tokens", "source", "cluster")
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(1).to_pylist()
        tokens = [encode(path, t) if t else [] for t in texts]
        counts = np.array([len(t) for t in tokens], np.int64)
        lengths = np.array([len(t) if t else 0 for t in texts], np.int64)
        ends: dict[int, np.ndarray] = {}
        for capacity_id, capacity in capacities:
            whole = np.flatnonzero((counts > 0) & (counts <= capacity))
            rows, numbers, starts, stops, sizes = [whole], [np.zeros(len(whole), np.int64)], [np.zeros(len(whole), np.int64)], [lengths[whole]], [counts[whole]]
            for i in np.flatnonzero(counts > capacity).tolist():
                if i not in ends:
                    ends[i] = _ends(path, texts[i], tokens[i])
                cut = np.array(pieces(path, texts[i], tokens[i], capacity, ends[i]))
                rows.append(np.full(len(cut), i))
                numbers.append(np.arange(len(cut)))
                starts.append(cut[:, 0])
                stops.append(cut[:, 1])
                sizes.append(cut[:, 2])
            at = pa.array(np.concatenate(rows))
            columns = [pa.array(np.full(len(at), capacity_id)), batch.column(0).take(at), *(pa.array(np.concatenate(x)) for x in (numbers, starts, stops, sizes)), batch.column(2).take(at), batch.column(3).take(at)]
            yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds, strict=True)], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                yield from of(batch.slice(at, 1_000))

    return run


class Bins:
    """Open bins by residual: under each residual, bins by their source bitmap; residuals in use are bits of ``used``."""

    def __init__(self, capacity: int, least: int) -> None:
        self.capacity, self.least, self.used = capacity, least, 0
        self.shelves: dict[int, dict[int, list[int]]] = {}
        self.clusters: list[int] = []  # bitmap of duplicate clusters, by bin
        self.sources: list[int] = []
        self.room: list[int] = []

    def _shelve(self, b: int) -> None:
        r = self.room[b]
        if r:
            self.shelves.setdefault(r, {}).setdefault(self.sources[b], []).append(b)
            self.used |= 1 << r

    def _take(self, r: int, mask: int, at: int) -> int:
        shelf = self.shelves[r]
        line = shelf[mask]
        b = line[at]
        line[at] = line[-1]
        line.pop()
        if not line:
            del shelf[mask]
            if not shelf:
                del self.shelves[r]
                self.used &= ~(1 << r)
        return b

    def find(self, size: int, cluster: int, source: int, start: int) -> tuple[int, int, int] | None:
        """Tightest place (residual, source bitmap, index) of a bin without ``cluster``, from residual ``start`` up."""
        r = max(size, start)
        above = self.used >> r << r
        while above:
            r = (above & -above).bit_length() - 1
            shelf = self.shelves[r]
            if not cluster:
                mask = next((m for m in shelf if not m & source), None)
                mask = next(iter(shelf)) if mask is None else mask
                return r, mask, len(shelf[mask]) - 1
            for mask in [*(m for m in shelf if not m & source), *(m for m in shelf if m & source)]:
                line = shelf[mask]
                for at in range(len(line) - 1, -1, -1):
                    if not self.clusters[line[at]] & cluster:
                        return r, mask, at
            above &= above - 1
        return None

    def put(self, size: int, cluster: int, source: int, start: int = 0, shares: bool = False) -> tuple[int, bool, int]:
        """(bin, conflict, residual it had); ``start`` tells below which residual every bin is known to conflict."""
        place, conflict = self.find(size, cluster, source, start), False
        if place is None and shares and len(self.room) >= self.least:
            place = self.find(size, 0, source, size)
            conflict = place is not None
        if place is None:
            b, r = len(self.room), self.capacity
            self.room.append(self.capacity)
            self.clusters.append(0)
            self.sources.append(0)
        else:
            r = place[0]
            b = self._take(*place)
        self.room[b] -= size
        self.clusters[b] |= cluster
        self.sources[b] |= source
        self._shelve(b)
        return b, conflict, r


def least_bins(sizes: list[int], capacity: int) -> int:
    """No packing needs fewer bins: an item over half the capacity has a bin of its own, and for every ``k`` what is at
    least ``k`` must go where the items over ``capacity - k`` are not."""
    counts = np.bincount(np.asarray(sizes, np.int64), minlength=capacity + 1)[: capacity + 1]
    many, room = np.cumsum(counts), np.cumsum(counts * np.arange(capacity + 1))
    k = np.arange(capacity // 2 + 1)
    over_half = many[capacity] - many[capacity // 2]
    below = np.concatenate([[0], room])[k]  # of items under k
    between = room[capacity - k] - below  # of items from k to capacity - k
    half_to = many[capacity - k] - many[capacity // 2]  # items over half that k leaves room beside
    space = half_to * capacity - (room[capacity - k] - room[capacity // 2])
    small = between - (room[capacity - k] - room[capacity // 2])
    return int((over_half + np.maximum(0, -(-(small - space) // capacity))).max()) if len(sizes) else 0


def best_fit(sizes: list[int], clusters: list[int], sources: list[int], capacity: int) -> tuple[list[int], list[bool]]:
    """Bin of each item, and whether it shares the bin with a copy: the better of two orders, both largest first."""
    least = -(-sum(sizes) // capacity)
    counts = Counter(clusters)
    bits: dict[int, int] = {}
    for c, n in counts.items():
        if n > 1:
            bits[c] = 1 << len(bits)
    fewest = max(least, least_bins(sizes, capacity))
    best: tuple[list[int], list[bool]] | None = None
    for first in (False, True):
        order = sorted(range(len(sizes)), key=lambda i: (first and -counts[clusters[i]], -sizes[i], clusters[i]))
        placed, conflict = _in_order(order, sizes, clusters, sources, capacity, least, counts, bits)
        if best is None or (max(placed, default=0), sum(conflict)) < (max(best[0], default=0), sum(best[1])):
            best = placed, conflict
        if max(placed, default=-1) < fewest and not any(conflict):
            break  # no order needs fewer bins
    return best


def _in_order(order: list[int], sizes: list[int], clusters: list[int], sources: list[int], capacity: int, least: int, counts: Counter, bits: dict[int, int]) -> tuple[list[int], list[bool]]:
    bins = Bins(capacity, least)
    placed, conflict = [0] * len(sizes), [False] * len(sizes)
    last, start = None, 0
    for i in order:
        # Copies come one after the other: bins below the residual found last are known to hold one.
        if (sizes[i], clusters[i]) != last:
            last, start = (sizes[i], clusters[i]), 0
        b, shared, r = bins.put(sizes[i], bits.get(clusters[i], 0), 1 << sources[i] % SOURCE_BITS, start, counts[clusters[i]] > least)
        if not shared and bits.get(clusters[i]):
            start = min(r, capacity)
        placed[i], conflict[i] = b, shared
    return placed, conflict


def _pack(capacities: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Shards come whole, one after the other; each is packed as it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key: tuple[int, int] | None = None

        def packed() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            lists = [whole.column(c).to_pylist() for c in ("n_tokens", "cluster", "source")]
            bins, conflict = best_fit(*lists, capacities[key[0]])
            done = whole.drop_columns(["source", "cluster", "shard"])
            done = done.append_column("container_id", pa.array([(key[1] << 32) + b for b in bins], pa.int64()))
            return done.append_column("conflict", pa.array(conflict, pa.bool_())).to_batches()[0]

        for batch in batches:
            keys = list(zip(batch.column("capacity_id").to_pylist(), batch.column("shard").to_pylist(), strict=True))
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for start, end in zip(starts, [*starts[1:], len(keys)], strict=True):
                if keys[start] != key:
                    if held:
                        yield packed()
                    held, key = [], keys[start]
                held.append(batch.slice(start, end - start))
        if held:
            yield packed()

    return run


def containers(documents: DataFrame, capacities: DataFrame, tokenizer_path: str = TOKENIZER, shard: int = SHARD) -> DataFrame:
    """(capacity_id, doc_id, piece_no, start_pos, end_pos, n_tokens, container_id, conflict): one row for each document,
    or piece of one, and capacity. Container ids count within their capacity. Positions are code points of the text."""
    c = F.col
    wanted = [(r[0], r[1]) for r in capacities.filter(c("max_tokens") > 0).select("capacity_id", "max_tokens").distinct().limit(MOST_CAPACITIES + 1).collect()]
    if len(wanted) > MOST_CAPACITIES or len({i for i, _ in wanted}) != len(wanted):
        raise ValueError("capacities must be a small table with distinct ids")
    if os.path.exists(tokenizer_path):
        documents.sparkSession.sparkContext.addFile(tokenizer_path)  # for executors that lack the file
    texts = enough_tasks(documents).select(
        c("doc_id").cast("bigint").alias("doc_id"), c("text").cast("string").alias("text"),
        F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(1 << 20)).alias("source"),
        F.xxhash64(F.lower(F.regexp_replace("text", r"\s+", " "))).alias("cluster"),
    )
    items = "capacity_id int, doc_id bigint, piece_no int, start_pos int, end_pos int, n_tokens int, source bigint, cluster bigint"
    measured = cut_lineage(texts.mapInArrow(_measure(tokenizer_path, wanted), items))
    # Pieces of a text are no copies of each other.
    measured = measured.withColumn("cluster", F.when(c("piece_no") == 0, c("cluster")).otherwise(F.xxhash64("cluster", "piece_no")))
    shards = measured.groupBy("capacity_id").agg(F.ceil(F.count(F.lit(1)) / shard).alias("shards"))
    number = {r[0]: max(1, r[1]) for r in shards.collect()}
    many = F.coalesce(*[F.when(c("capacity_id") == k, F.lit(n)) for k, n in number.items()], F.lit(1)) if number else F.lit(1)
    spread = measured.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece_no"), many))
    tasks = max(1, min(sum(number.values()), int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    sorted_shards = spread.repartition(tasks, "capacity_id", "shard").sortWithinPartitions("capacity_id", "shard", "doc_id", "piece_no")
    out = "capacity_id int, doc_id bigint, piece_no int, start_pos int, end_pos int, n_tokens int, container_id bigint, conflict boolean"
    return sorted_shards.mapInArrow(_pack(dict(wanted)), out)


def fill(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(capacity_id, containers, items, conflicts, fill): the share of the containers' space that is used."""
    per = packed.groupBy("capacity_id").agg(F.countDistinct("container_id").alias("containers"), F.count(F.lit(1)).alias("items"), F.sum(F.col("conflict").cast("int")).alias("conflicts"), F.sum("n_tokens").alias("tokens"))
    joined = per.join(capacities.select("capacity_id", "max_tokens"), "capacity_id")
    return joined.select("capacity_id", "containers", "items", "conflicts", (F.col("tokens") / (F.col("containers") * F.col("max_tokens"))).alias("fill"))
