"""Containers hold whole texts within capacity, each once, and no two copies where each can have its own."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import packing

PATH = packing.TOKENIZER


def packed(spark, texts, capacities, **kw):
    documents = spark.createDataFrame([(i, t, "web" if i % 3 else None, "x") for i, t in enumerate(texts)], "doc_id long, text string, source string, container_id string")
    return packing.containers(documents, spark.createDataFrame(capacities, "capacity_id int, max_tokens int"), **kw).collect()


def test_every_text_once_and_within_capacity(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=rng.randint(1, 120))) for _ in range(300)]
    texts += ["copy of one text"] * 20 + ["长" * 200, "word " * 500, "", None, "  "]
    rows = packed(spark, texts, [(1, 32), (2, 256)])
    for capacity_id, capacity in ((1, 32), (2, 256)):
        load, parts = Counter(), defaultdict(list)
        for r in rows:
            if r.capacity_id == capacity_id:
                load[r.container_id] += r.n_tokens
                parts[r.doc_id].append((r.piece_no, r.start_pos, r.end_pos, r.n_tokens))
        assert max(load.values()) <= capacity
        for i, text in enumerate(texts):
            if not text:
                assert i not in parts
                continue
            cut = sorted(parts[i])
            assert [c[0] for c in cut] == list(range(len(cut)))
            assert cut[0][1] == 0 and cut[-1][2] == len(text) and all(a[2] == b[1] for a, b in zip(cut, cut[1:], strict=False))
            assert all(n == len(packing.encode(PATH, text[a:b])) for _, a, b, n in cut)
            assert len(cut) == 1 or len(packing.encode(PATH, text)) > capacity
    assert not any(r.conflict for r in rows)
    # No two copies share a container.
    held = Counter((r.capacity_id, r.container_id) for r in rows if 300 <= r.doc_id < 320)
    assert max(held.values()) == 1


def test_conflicts_only_where_copies_outnumber_bins():
    placed, conflict = packing.best_fit([10] * 30, [1] * 30, [0] * 30, 100)
    assert max(placed) + 1 == 3 and sum(conflict) == 27
    sizes = [50] * 6 + [10] * 12
    placed, conflict = packing.best_fit(sizes, list(range(6)) + [99] * 4 + list(range(100, 108)), [0] * 18, 100)
    assert not any(conflict) and max(Counter(placed[6:10]).values()) == 1


def test_best_fit_is_tight():
    rng = random.Random(5)
    sizes = [rng.randint(1, 90) for _ in range(3000)]
    placed, _ = packing.best_fit(sizes, list(range(3000)), [0] * 3000, 100)
    load = Counter()
    for size, b in zip(sizes, placed, strict=True):
        load[b] += size
    assert max(load.values()) <= 100 and len(load) <= 1.02 * -(-sum(sizes) // 100)


@pytest.mark.parametrize("capacity", [1, 3, 7, 50])
def test_pieces_join_to_the_text(capacity):
    for text in ("a b c " * 40, "日本語のテキスト🙂" * 9, "x" * 300, "tail   \n\n  spaces  " * 8, "é" * 60):
        tokens = packing.encode(PATH, text)
        cut = packing.pieces(PATH, text, tokens, capacity)
        assert "".join(text[a:b] for a, b, _ in cut) == text
        assert all(n == len(packing.encode(PATH, text[a:b])) and (n <= capacity or b - a == 1) for a, b, n in cut)


def test_fill_and_defined_cases(spark):
    capacities = spark.createDataFrame([(1, 8), (2, None), (3, 0)], "capacity_id int, max_tokens int")
    documents = spark.createDataFrame([(1, "one two three", None), (1, "one two three", None), (None, "four", "web")], "doc_id long, text string, source string")
    rows = packing.containers(documents, capacities)
    assert rows.count() == 3 and rows.select("capacity_id").distinct().count() == 1
    assert packing.fill(rows, capacities).select(F.sum("items")).first()[0] == 3
    assert packing.containers(documents.limit(0), capacities).count() == 0
    assert packing.containers(documents, capacities.limit(0)).count() == 0
