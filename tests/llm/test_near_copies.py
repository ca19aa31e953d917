"""The pipeline's near-dedup stage on planted copies at known similarity."""

import random

import corpus_pipeline
import numpy as np
import pytest

from scriptorium.llm import near_copies
from scriptorium.llm.near_copies import shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def planted(draw, similarity, n=200):
    """Two texts at this similarity or barely above: words are replaced one by one."""
    words = [f"w{draw.randrange(10**6)}" for _ in range(n)]
    text, other = " ".join(words), list(words)
    while True:
        trial = list(other)
        trial[draw.randrange(n)] = f"x{draw.randrange(10**6)}"
        if jaccard(text, " ".join(trial)) < similarity:
            return text, " ".join(other)
        other = trial


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    return sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9])
def test_planted_copies_go(spark, similarity):
    draw = random.Random(similarity)
    pairs = [planted(draw, similarity) for _ in range(60)]
    rows = [(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)]
    assert kept(spark, rows) == sorted((2 * i, p[0]) for i, p in enumerate(pairs))


def test_unlike_texts_stay(spark):
    draw = random.Random(5)
    texts = [t for _ in range(20) for t in planted(draw, 0.8)[:1]]
    half = [" ".join(t.split()[:150] + [f"y{draw.randrange(10**6)}" for _ in range(50)]) for t in texts]
    rows = list(enumerate([*texts, *half, "", "one two", "one three"]))
    assert kept(spark, rows) == sorted(rows)


def chained(draw, n, edits):
    """Texts that were edited one after the other or from the first one: similar to some, not to all."""
    base = [f"w{draw.randrange(10**6)}" for _ in range(80)]
    made = [base]
    for _ in range(n - 1):
        words = list(draw.choice([base, made[-1]]))
        for _ in range(draw.randint(1, edits)):
            words[draw.randrange(80)] = f"x{draw.randrange(10**6)}"
        made.append(words)
    return [" ".join(w) for w in made]


def groups(texts):
    above = list(range(len(texts)))
    sets = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] & sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = above[i], above[j]
                above = [min(a, b) if x in (a, b) else x for x in above]
    return above


@pytest.mark.parametrize("block", [2000, 12])
def test_groups_equal_brute_force(spark, monkeypatch, block):
    """All links of texts that are like some of their group only, in one block of a band and in several."""
    monkeypatch.setattr(near_copies, "BLOCK", block)
    draw = random.Random(block)
    texts = [t for k in range(4) for t in chained(draw, 40, 2 + k)]
    draw.shuffle(texts)
    assert kept(spark, list(enumerate(texts))) == sorted((i, texts[i]) for i in set(groups(texts)))


def test_joining_links_are_few_and_enough():
    draw = random.Random(1)
    texts = chained(draw, 60, 5)
    known, numbers = {}, []
    for t in texts:
        numbers.append(np.array(sorted(known.setdefault(s, len(known)) for s in shingles(t))))
    for component in (np.arange(60), np.arange(60) // 7, np.zeros(60, int)):
        left, right = near_copies.joining_links(numbers, component, np.zeros(60, int))
        assert len(left) < len(set(component.tolist())) or not len(left)
        above = component.tolist()
        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            a, b = above[i], above[j]
            assert a != b
            above = [a if x == b else x for x in above]
        for i in range(60):
            for j in range(i):
                common = len(np.intersect1d(numbers[i], numbers[j]))
                assert above[i] == above[j] or common < 0.8 * (len(numbers[i]) + len(numbers[j]) - common)


def test_a_repeated_id_keeps_its_own_text(spark):
    assert kept(spark, [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "quite another text than that of its id")]) == [(1, "a b c d e f g"), (2, "quite another text than that of its id")]
