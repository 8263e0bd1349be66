"""Sentence units: given texts, invariants over random texts, and the same rows whichever counts are held by tasks."""

import random

import pytest

from tidemark.llm import sentences

CASES = {
    "He said so to me. Then he left. It was for me and him.": ["He said so to me.", "Then he left.", "It was for me and him."],
    "We met no one. It was late, no doubt. There is no rush.": ["We met no one.", "It was late, no doubt.", "There is no rush."],
    "Dr. Smith paid 3.50 at 6 a.m. in total. Good!": ["Dr. Smith paid 3.50 at 6 a.m. in total.", "Good!"],
    "See www.example.com/a.b?c=d for more. Or not?!": ["See www.example.com/a.b?c=d for more.", "Or not?!"],
    "真的吗？！用了两个月。“很好。请保留。”他说。": ["真的吗？！", "用了两个月。", "“很好。请保留。”他说。"],
    "one\ntwo\r\nthree": ["one", "two", "three"],
    "यह अच्छा है। मुझे पसंद है।": ["यह अच्छा है।", "मुझे पसंद है।"],
    "ดีมาก ชอบเลย": ["ดีมาก", "ชอบเลย"],
    "Great 🙂 Bought it again": ["Great 🙂", "Bought it again"],
    "  \n ": [],
}


def cut(text):
    held = sentences.Evidence()
    sentences.evidence([text], held)
    return [text[a:b] for a, b in sentences.Splitter(held.counts()).spans(text)]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert cut(text) == CASES[text]


def test_sentences_cover_the_text():
    rng = random.Random(1)
    pieces = ["Mr.", "no.", "3.5", "word", "Word", "!", "...", "\n", '"', "(", ")", "🙂", "。", "“", "”", "e.g.", "x@y.org", "ไทย", " ", "U.S.", ":)"]
    for _ in range(400):
        text = " ".join(rng.choices(pieces, k=rng.randint(1, 25))) if rng.random() < 0.7 else "".join(rng.choices(pieces, k=12))
        held = sentences.Evidence()
        sentences.evidence([text], held)
        spans = sentences.Splitter(held.counts()).spans(text)
        assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
        inside = set().union(*(range(a, b) for a, b in spans)) if spans else set()
        assert all(c.isspace() or i in inside for i, c in enumerate(text))


def test_counts_need_no_limit(spark):
    """Rows are the same whether tasks hold the counts of all words or of a few."""
    rng = random.Random(2)
    words = ["kettle", "lid", "Aldern", "the", "The", "approx", "nr", "It", "was", "good", "no", "art", "fig"]
    texts = [(i, " ".join(w + rng.choice(["", "", ".", "!", "..."]) for w in rng.choices(words, k=40))) for i in range(150)]
    documents = spark.createDataFrame([*texts, (1, texts[1][1]), (None, None), (151, "")], "doc_id long, text string")
    rows = lambda **kw: sorted(map(tuple, sentences.sentences(documents, **kw).collect()))
    assert rows() == rows(held_words=3) == rows(held_words=0)


def test_evidence_is_the_same_in_stretches(monkeypatch):
    texts = ["The lid broke. no. 5 went on\nagain", "all in lower case! so what"] * 50
    whole, parts = sentences.Evidence(), sentences.Evidence()
    sentences.evidence(texts, whole)
    monkeypatch.setattr(sentences, "STRETCH", 200)
    sentences.evidence(texts, parts)
    assert whole.counts() == parts.counts()


def test_defined_cases(spark):
    documents = spark.createDataFrame([(1, None, 1), (2, " ", 2), (None, "One. Two!", 3), (3, "One. Two!", 4), (3, "One. Two!", 4)], "doc_id long, text string, start_pos int")
    assert sorted((r.doc_id or 0, r.start_pos, r.end_pos) for r in sentences.sentences(documents).collect()) == [(0, 0, 4), (0, 5, 9)] + [(3, 0, 4)] * 2 + [(3, 5, 9)] * 2
    assert sentences.sentences(documents.limit(0)).count() == 0
