"""Evaluation texts leaking into training text.

Test items are a stated query set: they are taken in blocks of bounded size, and every block is met by all documents.
For each block:

1. One pass over the texts turns them into numbers of the items' units and keeps the documents that may hold a copy: those
   with short n-grams of the items in a row (or, where edited copies are sought, with at least two). They are written out
   as numbers, and over them it is counted in how many documents each n-gram occurs.
2. Every run of ``min_run`` units of an item is covered by the rarest of the n-grams inside it; these rare n-grams are
   the seeds. A document that holds such a run holds its seed, so no copy can be missed, while common wording (which
   items share) rarely makes a candidate.
   A changed word may fall into just these rare n-grams, so for edited copies every n-gram of an item that some document
   holds is a seed too. As n-grams are three words long, a copy of which every fourth word is changed is still met.
3. Documents are joined to items on the seeds. Each match is extended to its whole run. What is no exact copy of any
   item is aligned with the items whose seeds it holds by Smith-Waterman, which decides on edited and paraphrased
   copies. A stretch that is an exact copy of one item is not reported as an edited copy of items worded like it, nor an
   edited copy as one of items that align with it much worse (``ALIKE``).

Units are words, and for Chinese and Japanese items letters. Texts are compared after Unicode compatibility
composition and case folding, without invisible characters; punctuation and white space only separate words.

Documents stay where they are; the only shuffle is of the n-gram counts, of which there are no more than n-grams in a
block. Copies of a document are judged each by itself.

Defined cases: null, empty and blank texts match nothing, on either side; an item with fewer units than ``min_run``
matches nothing; an item id that repeats with several texts gives a row for each; extra columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, enough_tasks

WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")
INVISIBLE = regex.compile(r"[\p{Cf}\p{Cc}--\s]", regex.V1)
CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
#: Items of one block, and characters of their texts: what is sent to every task.
BLOCK_ITEMS, BLOCK_CHARS = 5_000, 5_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Of items that align with the same stretch of a text as edited copies, those that score so much of the best are reported.
ALIKE = 0.8
#: Cells of an alignment's matrix that are kept for the way back; of a larger one the part that matters is computed again.
CELLS = 1 << 22
#: Characters of texts that are normalised together.
STRETCH = 500_000
#: Stands between texts; a private character, which is part of no word.
APART = "\ue000"
ASCII_WORD, ASCII_CONTROL = re.compile(rb"[a-z0-9]+|\x00"), bytes([*range(1, 9), *range(14, 28), 127])
WORD_OR_APART = regex.compile(WORD.pattern + "|" + APART)


def normal_words(text: str) -> list[str]:
    """The words of ``text`` as they are compared."""
    return _all_words([text])[0]


def _joined(texts: list[str]) -> list[str]:
    """The words of several texts in a row, with ``APART`` after each text."""
    if all(t.isascii() for t in texts):
        raw = "".join(t.replace("\x00", "") + "\x00" for t in texts).encode().translate(None, ASCII_CONTROL)
        return b" ".join(ASCII_WORD.findall(raw.lower())).decode().replace("\x00", APART).split(" ")
    text = INVISIBLE.sub("", unicodedata.normalize("NFKC", "".join(t.replace(APART, " ") + APART for t in texts)))
    return WORD_OR_APART.findall(unicodedata.normalize("NFKC", text.casefold()))


def _all_words(texts: list[str]) -> list[list[str]]:
    found: list[list[str]] = [[]]
    for w in _joined(texts):
        if w == APART:
            found.append([])
        else:
            found[-1].append(w)
    return found[:-1]


def _groups(texts: list[str | None]) -> Iterator[list[int]]:
    """The places of texts that are normalised together: those of one kind, up to ``STRETCH`` characters or one text."""
    held: dict[bool, list[int]] = {True: [], False: []}
    sizes = {True: 0, False: 0}
    for i, text in enumerate(texts):
        if text:
            kind = text.isascii()
            held[kind].append(i)
            sizes[kind] += len(text)
            if sizes[kind] > STRETCH:
                yield held[kind]
                held[kind], sizes[kind] = [], 0
    yield from (places for places in held.values() if places)


@dataclass(frozen=True)
class Rule:
    """What counts as a copy: ``min_run`` units in a row, sought by n-grams of ``gram`` units."""

    min_run: int
    gram: int


WORDS, LETTERS = Rule(10, 3), Rule(20, 5)


@dataclass(eq=False)
class Side:
    """The items of one block that are compared by one kind of unit."""

    rule: Rule
    ids: dict[str, int] = field(default_factory=dict)  # unit -> number from 1
    items: list[tuple[int, np.ndarray]] = field(default_factory=list)
    grams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    seeds: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    places: list[list[tuple[int, int]]] = field(default_factory=list)  # of each seed: item, position

    def add(self, eval_id: int, units: list[str]) -> None:
        if len(units) >= self.rule.min_run:
            self.items.append((eval_id, np.array([self.ids.setdefault(u, len(self.ids) + 1) for u in units], np.uint64)))

    def hashes(self, ids: np.ndarray) -> np.ndarray:
        """Of the n-gram at every place; places whose n-gram holds a unit of no item (0) give 0."""
        n = len(ids) - self.rule.gram + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h, whole = np.zeros(n, np.uint64), np.ones(n, bool)
        for k in range(self.rule.gram):
            part = ids[k : k + n]
            h = (h ^ (part + (h << np.uint64(6)) + (h >> np.uint64(2)))) * MULTIPLIER
            whole &= part != 0
        return np.where(whole, h | np.uint64(1), np.uint64(0))

    def close(self) -> None:
        found = [self.hashes(ids) for _, ids in self.items]
        self.grams = np.unique(np.concatenate(found)) if found else self.grams

    def choose(self, documents: dict[int, int], edited: bool = True) -> None:
        """Seeds: of every window of ``min_run`` units, its rarest n-gram; for edited copies, all that documents hold."""
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        width = self.rule.min_run - self.rule.gram + 1
        for item, (_, ids) in enumerate(self.items):
            h = self.hashes(ids)
            cost = np.array([documents.get(int(x), 0) for x in h])
            chosen = {int(w + np.argmin(cost[w : w + width])) for w in range(len(h) - width + 1)}
            if edited:
                chosen.update(np.flatnonzero(cost).tolist())
            for at in chosen:
                places[int(h[at])].append((item, at))
        self.seeds = np.array(sorted(places), np.uint64)
        self.places = [places[int(s)] for s in self.seeds]


def _sides(items: list[tuple[int, str | None, str | None]], words: Rule, letters: Rule) -> tuple[Side, Side]:
    """The word side and the letter side of a block of (eval_id, lang, text)."""
    by_word, by_letter = Side(words), Side(letters)
    for eval_id, lang, text in items:
        if not text:
            continue
        units = normal_words(text)
        joined = "".join(units)
        code = (lang or "").strip().lower()[:2]
        if code in ("zh", "ja") or (code not in ("en", "de", "fr", "es") and len(CJK.findall(joined)) * 2 > len(joined)):
            by_letter.add(eval_id, list(joined))
        else:
            by_word.add(eval_id, units)
    by_word.close()
    by_letter.close()
    return by_word, by_letter


def _documents(texts: list[str | None], sides: tuple[Side, Side]) -> Iterator[tuple[int, list[int], np.ndarray, np.ndarray]]:
    """Per side and group of texts: number of the side, places of the texts, the units of all of them in a row, with a 0
    after each text, and where each text starts (and the last ends)."""
    by_word, by_letter = sides
    letters = np.array(sorted(map(ord, by_letter.ids)), np.uint32)
    numbers = np.array([by_letter.ids[chr(c)] for c in letters.tolist()], np.int64)
    known = by_word.ids | {APART: -1}
    for places in _groups(texts):
        words = _joined([texts[i] for i in places])
        if by_word.items:
            get = known.get
            ids = np.array([get(w, 0) for w in words], np.int64)
            ends = np.flatnonzero(ids == -1)
            ids[ends] = 0
            yield 0, places, ids.astype(np.uint64), np.concatenate([[0], ends + 1])
        if by_letter.items and not texts[places[0]].isascii():
            whole = "".join(words)
            if CJK.search(whole):
                points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
                at = np.minimum(np.searchsorted(letters, points), len(letters) - 1)
                ids = np.where(letters[at] == points, numbers[at], 0)
                yield 1, places, ids.astype(np.uint64), np.concatenate([[0], np.flatnonzero(points == ord(APART)) + 1])


def _held(grams: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose n-gram is among the sorted ``grams``, and its number there."""
    at = np.flatnonzero(h)
    slot = np.searchsorted(grams, h[at])
    slot[slot == len(grams)] = 0
    real = grams[slot] == h[at] if len(grams) else np.zeros(len(at), bool)
    return at[real], slot[real]


def _encode(sides: tuple[Side, Side], edited: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents that may hold a copy: their units as numbers, and the item n-grams they hold."""

    def of(batch: pa.RecordBatch) -> Iterator[tuple]:
        texts = batch.column(1).to_pylist()
        keys = batch.column(0)
        for number, places, ids, starts in _documents(texts, sides):
            side = sides[number]
            at, slot = _held(side.grams, side.hashes(ids))
            if not len(at):
                continue
            doc = np.searchsorted(starts, at, side="right") - 1
            if edited:
                chosen = np.flatnonzero(np.bincount(doc) > 1)
            else:  # all n-grams of an exact run are item n-grams, one after the other
                need = side.rule.min_run - side.rule.gram
                row = np.flatnonzero(at[need:] - at[: len(at) - need] == need) if len(at) > need else np.zeros(0, np.int64)
                chosen = np.unique(doc[row])
            low, high = np.searchsorted(doc, chosen), np.searchsorted(doc, chosen, side="right")
            for d, a, b in zip(chosen.tolist(), low.tolist(), high.tolist(), strict=True):
                yield keys[places[d]].as_py(), number, ids[starts[d] : starts[d + 1] - 1].astype(np.int32), np.unique(side.grams[slot[a:b]]).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if rows := list(of(batch)):
                keys, numbers, ids, grams = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(numbers, pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(grams, pa.list_(pa.int64()))], names=["doc_id", "side", "ids", "grams"])

    return run


def _score_rows(a: np.ndarray, b: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1) -> Iterator[np.ndarray]:
    """The rows of the Smith-Waterman matrix, one for each unit of ``a``; the same array, overwritten."""
    steps = np.arange(1, len(b) + 1) * -gap
    row = np.zeros(len(b) + 1, np.int64)
    for unit in a:
        step = np.where(b == unit, match, mismatch) if unit else mismatch
        step = np.maximum(np.maximum(row[:-1] + step, row[1:] + gap), 0)
        # A gap along the row costs the same per unit, so the best one ends a running maximum.
        step += steps
        np.maximum.accumulate(step, out=step)
        np.subtract(step, steps, out=row[1:])
        yield row


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of ``a`` with ``b``: its score, and where it ends in each (exclusive)."""
    best = (0, 0, 0)
    for i, row in enumerate(_score_rows(a, b)):
        top = int(row.argmax())
        if row[top] > best[0]:
            best = (int(row[top]), i + 1, top)
    return best


def _stretch(rows: np.ndarray, a: np.ndarray, b: np.ndarray, least_score: float, least_length: int, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, float, int]:
    """Of the alignment that ends with ``a`` and ``b``: length and score (of 1) of its longest stretch of ``least_length``
    or more that scores ``least_score``; of the whole alignment, if there is none. And where the alignment starts in ``a``."""
    i, j, scores = len(a), len(b), []
    while i and j and rows[i][j] > 0:
        score = match if a[i - 1] == b[j - 1] != 0 else mismatch
        if rows[i][j] == rows[i - 1][j - 1] + score:
            i, j = i - 1, j - 1
        else:
            score = gap
            i, j = (i - 1, j) if rows[i][j] == rows[i - 1][j] + gap else (i, j - 1)
        scores.append(score)
    sums = np.concatenate([[0], np.cumsum(scores)])
    over = sums - np.arange(len(sums)) * (match * least_score)
    for length in range(len(scores), least_length - 1, -1):
        starts = np.flatnonzero(over[length:] >= over[: len(over) - length])
        if len(starts):
            return length, float(sums[starts[0] + length] - sums[starts[0]]) / (match * length), i
    return len(scores), float(sums[-1]) / (match * max(1, len(scores))), i


def _most(a: np.ndarray, b: np.ndarray, match: int = 2, miss: int = -1) -> int:
    """No alignment of ``a`` with ``b`` scores more: a unit gains ``match`` only if the other side holds it at all, and
    costs at least a miss or gap in the stretch otherwise."""
    most = []
    for one, other in ((a, b), (b, a)):
        sums = np.cumsum(np.where(np.isin(one, other) & (one != 0), match, miss))
        most.append(int((sums - np.minimum.accumulate(np.concatenate([[0], sums[:-1]]))).max()) if len(sums) else 0)
    return min(most)


def _run_length(a: np.ndarray, i: int, b: np.ndarray, j: int) -> tuple[int, int]:
    """Start in ``a`` and length of the run of equal units around ``a[i]``, ``b[j]``."""
    back = min(i, j)
    same = a[i - back : i][::-1] == b[j - back : j][::-1]
    before = int(same.argmin()) if not same.all() else back
    ahead = min(len(a) - i, len(b) - j)
    same = a[i : i + ahead] == b[j : j + ahead]
    after = int(same.argmin()) if not same.all() else ahead
    return i - before, before + after


def _match(sides: tuple[Side, Side], least_score: float, edited: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "eval_id", "run", "run_start", "score", "align_end", "kind", "stretch", "stretch_score")
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.string(), pa.int32(), pa.float64())
        for batch in batches:
            rows = []
            lists = batch.column(2)
            for k, (key, number) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                ids = lists[k].values.to_numpy(zero_copy_only=False).astype(np.uint64)
                rows += [dict(zip(names, (key, *found), strict=True)) for found in _judge(sides[number], ids, least_score, edited)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(zip(names, kinds, strict=True))))

    return run


def _judge(side: Side, text: np.ndarray, least_score: float, edited: bool) -> Iterator[tuple]:
    """(eval_id, run, run_start, score, align_end, kind, stretch, stretch_score) of every item that the text holds a
    copy or an edited copy of: the longest run, and the best alignment of the stretches in which a seed lies at its
    place in the item. Text that is an exact copy of an item takes no part in edited copies."""
    least = side.rule.min_run
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for place, s in zip(*(x.tolist() for x in _held(side.seeds, side.hashes(text))), strict=True):
        for item, j in side.places[s]:
            hits[item].append((place, j))
    copied = np.zeros(len(text), bool)
    runs: dict[int, tuple[int, int]] = {}
    for item, found in hits.items():
        units = side.items[item][1]
        passed: dict[int, int] = {}  # diagonal -> end of the last run seen on it
        best = (0, 0)
        for i, j in found:
            if i < passed.get(i - j, 0):
                continue
            first, length = _run_length(text, i, units, j)
            passed[i - j] = first + length
            best = max(best, (length, -first))
            if length >= least:
                copied[first : first + length] = True
        runs[item] = best[0], -best[1]
    rest = np.where(copied, np.uint64(0), text) if copied.any() else text
    likely: list[tuple[int, int, int, tuple]] = []
    for item, found in hits.items():
        eval_id, units = side.items[item]
        run, at = runs[item]
        if run >= least:
            yield from (row for *_, row in _aligned(text, units, found, eval_id, run, at, "copy", least, least_score))
        elif edited:
            found = [(i, j) for i, j in found if not copied[i : i + side.rule.gram].any()]
            covered = {i + k for i, _ in found for k in range(side.rule.gram)}
            if 2 * len(covered) >= least:
                likely += _aligned(rest, units, found, eval_id, run, at, "edited", least, least_score)
    for score, low, high, row in likely:
        if not any(low < h and l < high and score < ALIKE * s for s, l, h, _ in likely):
            yield row


def _aligned(text: np.ndarray, units: np.ndarray, found: list[tuple[int, int]], eval_id: int, run: int, at: int, kind: str, least: int, least_score: float) -> Iterator[tuple[int, int, int, tuple]]:
    """(score, start, end, row) of the best alignment, if the item is a copy or the alignment is good enough."""
    stretches: list[list[int]] = []
    for low, high in sorted((max(0, i - j - len(units) // 2), min(len(text), i - j + len(units) + len(units) // 2)) for i, j in found):
        if stretches and low <= stretches[-1][1]:
            stretches[-1][1] = max(stretches[-1][1], high)
        else:
            stretches.append([low, high])
    need = 0 if kind == "copy" else 2 * least_score * least
    best, starts, ends, stretch, share, fits = 0, 0, 0, 0, 0.0, False
    for low, high in stretches:
        if need and _most(text[low:high], units) < need:
            continue
        first = low
        if (high - low) * len(units) <= CELLS:
            rows = np.zeros((high - low + 1, len(units) + 1), np.int64)
            for k, row in enumerate(_score_rows(text[low:high], units)):
                rows[k + 1] = row
            i, j = np.unravel_index(int(rows.argmax()), rows.shape)
            score = int(rows[i, j])
            if not score or score < need:
                continue
        else:
            score, i, j = smith_waterman(text[low:high], units)
            if not score or score < need:
                continue
            # A path with a score above 0 has no more than two gaps for each unit of the item.
            first = max(low, low + i - 3 * j)
            i -= first - low
            rows = np.array([np.zeros(j + 1, np.int64), *(row.copy() for row in _score_rows(text[first : first + i], units[:j]))])
        length, part, begin = _stretch(rows, text[first : first + i], units[:j], least_score, least)
        good = length >= least and part >= least_score
        if (good, score) > (fits, best):
            best, starts, ends, stretch, share, fits = score, first + begin, first + int(i), length, part, good
    if fits or kind == "copy":
        yield best, starts, ends, (eval_id, run, at, best / (2 * len(units)), ends, kind, stretch, share)


def leaks(documents: DataFrame, items: DataFrame, words: Rule = WORDS, letters: Rule = LETTERS, least_score: float = 0.6, edited: bool = True) -> DataFrame:
    """One row per document and item that meet in a seed and are a copy or an edited copy.

    Columns: doc_id, eval_id, ``run`` (units of the item in a row), ``run_start`` (its place among the document's
    units), ``score`` (Smith-Waterman, of the whole item's), ``align_end``, ``kind``, ``stretch`` (units of the aligned
    stretch) and ``stretch_score`` (its score, of the same number of equal units). The kind is ``copy`` if the run has
    ``min_run`` units, else ``edited`` if a stretch of ``min_run`` units or more scores ``least_score`` of its own
    length, however long the item: with the scores of 2 for a match and -1 for a change, 0.6 stands for 73 percent of
    equal units. Without ``edited`` only copies are sought, which needs fewer seeds.
    """
    if not (words.gram <= words.min_run and letters.gram <= letters.min_run):
        raise ValueError("an n-gram must not be longer than the run it seeks")
    texts = enough_tasks(documents).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = [_block(texts, block, words, letters, edited, least_score) for block in _blocks(items)]
    if not parts:
        return texts.limit(0).select("doc_id", *[F.lit(None).cast(k).alias(n) for n, k in (("eval_id", "bigint"), ("run", "int"), ("run_start", "int"), ("score", "double"), ("align_end", "int"), ("kind", "string"), ("stretch", "int"), ("stretch_score", "double"))])
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole if edited else whole.filter(F.col("kind") == "copy")


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str | None, str | None]]]:
    """Items in blocks of bounded number and length; an item longer than a block is a block of its own."""
    rows = items.select(F.col("eval_id").cast("bigint"), "lang", "text").filter(F.col("eval_id").isNotNull() & F.col("text").isNotNull()).toLocalIterator()
    block: list[tuple] = []
    size = 0
    for row in rows:
        if block and (len(block) >= BLOCK_ITEMS or size + len(row[2]) > BLOCK_CHARS):
            yield block
            block, size = [], 0
        block.append(tuple(row))
        size += len(row[2])
    if block:
        yield block


def _block(texts: DataFrame, block: list[tuple], words: Rule, letters: Rule, edited: bool, least_score: float) -> DataFrame:
    sides = _sides(block, words, letters)
    held = cut_lineage(texts.mapInArrow(_encode(sides, edited), "doc_id bigint, side int, ids array<int>, grams array<bigint>"))
    counts = held.select("side", F.explode("grams").alias("gram")).groupBy("side", "gram").agg(F.count(F.lit(1)).alias("documents"))
    per_side: tuple[dict[int, int], dict[int, int]] = ({}, {})
    for side, gram, n in counts.collect():  # no more rows than n-grams of the block
        per_side[side][gram % (1 << 64)] = n
    for side, documents in zip(sides, per_side, strict=True):
        side.choose(documents, edited)
    return held.mapInArrow(_match(sides, least_score, edited), "doc_id bigint, eval_id bigint, run int, run_start int, score double, align_end int, kind string, stretch int, stretch_score double")
