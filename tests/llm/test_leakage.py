"""Edited copies of evaluation texts are found, whichever words are changed."""

import random

import pytest

from tidemark.llm import leakage

ITEM = [f"w{n}" for n in range(60)]


def changed(words, every, first):
    return " ".join("other" if i % every == first else w for i, w in enumerate(words))


def found(spark, texts):
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, "en", " ".join(ITEM))], "eval_id long, lang string, text string")
    return {r.doc_id: r for r in leakage.leaks(documents, items).collect()}


def test_copy_changed_every_seventh_word(spark):
    rows = found(spark, ["nothing of the kind", changed(ITEM, 7, 3)])
    assert [(r.doc_id, r.kind) for r in rows.values()] == [(1, "edited")]


def test_edited_part_of_an_item(spark):
    part = changed(ITEM[20:40], 7, 3)
    rows = found(spark, ["nothing of the kind", "before it " + part + " after it", "w1 w2 w3 w4 alone"])
    assert [(r.doc_id, r.kind) for r in rows.values()] == [(1, "edited")]
    assert rows[1].score < 0.5 < rows[1].stretch_score and rows[1].stretch == 20


def test_exact_copies_alone(spark):
    documents = spark.createDataFrame([(1, changed(ITEM, 7, 0)), (2, " ".join(ITEM[20:31]))], "doc_id long, text string")
    items = spark.createDataFrame([(1, "en", " ".join(ITEM))], "eval_id long, lang string, text string")
    assert [(r.doc_id, r.kind) for r in leakage.leaks(documents, items, edited=False).collect()] == [(2, "copy")]


@pytest.mark.parametrize("every", [4, 5, 9])
def test_planted_edited_copies(spark, every):
    """Whole items and middle thirds with every n-th word replaced, inside other text."""
    rng = random.Random(every)
    words = [f"v{n}" for n in range(400)]
    items = [(k, "en", " ".join(rng.choices(words, k=60))) for k in range(12)]
    texts = []
    for k, _, text in items:
        whole = text.split()
        texts.append((k, "some words before " + changed(whole, every, every // 2) + " and some after"))
        texts.append((100 + k, "some words before " + changed(whole[20:40], every, 1) + " and some after"))
    documents = spark.createDataFrame(texts, "doc_id long, text string")
    rows = leakage.leaks(documents, spark.createDataFrame(items, "eval_id long, lang string, text string")).collect()
    assert {(r.doc_id, r.eval_id) for r in rows} == {(d, d % 100) for d, _ in texts}


def test_exact_copy_is_no_edited_copy_of_a_similar_item(spark):
    alike = changed(ITEM, 6, 2)
    items = spark.createDataFrame([(1, "en", " ".join(ITEM)), (2, "en", alike)], "eval_id long, lang string, text string")
    documents = spark.createDataFrame([(1, "x " + " ".join(ITEM) + " y")], "doc_id long, text string")
    assert [(r.eval_id, r.kind) for r in leakage.leaks(documents, items).collect()] == [(1, "copy")]


def brute(documents, items, run):
    found = set()
    for d, text in documents:
        words = leakage.normal_words(text or "")
        have = {tuple(words[i : i + run]) for i in range(len(words) - run + 1)}
        for e, item in items:
            w = leakage.normal_words(item or "")
            if any(tuple(w[i : i + run]) in have for i in range(len(w) - run + 1)):
                found.add((d, e))
    return found


def test_exact_runs_against_brute_force(spark):
    rng = random.Random(7)
    words = [f"k{n}" for n in range(12)]
    items = [(e, " ".join(rng.choices(words, k=25))) for e in range(20)]
    documents = []
    for d in range(120):
        item = items[d % 20][1].split()
        n, at = rng.randint(6, 14), rng.randint(0, 10)
        documents.append((d, " ".join(rng.choices(words, k=8) + item[at : at + n] + rng.choices(words, k=8))))
    got = leakage.leaks(spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame([(e, "en", t) for e, t in items], "eval_id long, lang string, text string"), edited=False)
    assert {(r.doc_id, r.eval_id) for r in got.collect()} == brute(documents, items, 10)


def test_forms_that_are_the_same_text(spark):
    item = "Der Müller aß früh am Morgen zwölf große Äpfel vom alten Baum"
    texts = ["DER M\u0055\u0308LLER ASS, früh — am\u200b Morgen; zwölf\ngroße\tÄpfel! vom alten Baum", item.replace("ü", "u\u0308"), "der müller aß"]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(5, "de", item)], "eval_id long, lang string, text string")
    assert sorted(r.doc_id for r in leakage.leaks(documents, items, edited=False).collect()) == [0, 1]


def test_letters_of_chinese_items(spark):
    item = "青石湾的沉默的养蜂人在狭窄的石桥下清洗了十一只灯笼直到春天的洪水到来"
    documents = spark.createDataFrame([(1, "好。" + item[3:24] + "!"), (2, item[3:20]), (3, " ".join(item[3:24]))], "doc_id long, text string")
    items = spark.createDataFrame([(5, "zh", item)], "eval_id long, lang string, text string")
    assert sorted(r.doc_id for r in leakage.leaks(documents, items, edited=False).collect()) == [1, 3]


def test_defined_cases(spark):
    documents = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "  ", "c"), (None, " ".join(ITEM), "d"), (4, " ".join(ITEM), "e"), (4, " ".join(ITEM), "e")], "doc_id long, text string, eval_id string")
    items = spark.createDataFrame([(1, "en", " ".join(ITEM), 1), (2, None, None, 1), (None, "en", "x", 1), (3, "en", "too short", 1)], "eval_id long, lang string, text string, doc_id int")
    rows = leakage.leaks(documents, items).collect()
    assert sorted((r.doc_id or 0, r.eval_id, r.kind) for r in rows) == [(0, 1, "copy"), (4, 1, "copy"), (4, 1, "copy")]
    assert leakage.leaks(documents.limit(0), items).count() == 0
    assert leakage.leaks(documents, items.limit(0)).count() == 0
