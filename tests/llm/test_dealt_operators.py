"""The dealt operators against brute force on small rows with nulls, empty and long texts, ties, repeats and odd columns."""

import base64
import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scriptorium.llm import byte_bpe, decontaminate, fingerprint, license_scan, lm_scoring, quality, simhash, substring_dedup, toxicity, url_filter
from scriptorium.llm.common import ASCII_LOWER, remainder
from scriptorium.llm.queries import op7_url_filter, op8_fingerprint

WORDS = ["ana", "Ben", "čar", "dob", "ena", "fin", "gol", "hit", "iva", "jug"]


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(n))


SHARED = prose("shared", 60)
TEXTS = [
    prose(1, 80), f"{prose(2, 30)}\n{SHARED} {prose(3, 10)}", None, "", f"{SHARED}\t{prose(4, 5)}", prose(1, 80), f"x {prose(1, 80)} y",
    "a b c", "a b c", "  \n ", f"{prose(5, 25)} {prose(5, 25)}", "rep " * 70, prose(6, 6000), f"{prose(7, 19)} \x1c \u00a0 tail", "rep " * 45, prose(6, 6000) + " end",
]
SCHEMA = "doc_id long, text string, score string, fingerprint string, word string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "s", None, "w") for i, t in enumerate(TEXTS)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def test_substring_dedup_equals_brute_force(docs):
    found = {r["doc_id"]: r for r in substring_dedup.remove_repeats(docs).collect()}
    seen, removed = set(), 0
    for i, text in enumerate(TEXTS):
        own = words(text)
        keep = [True] * len(own)
        for s in range(len(own) - 19):
            window = tuple(own[s : s + 20])
            if window in seen:
                keep[s : s + 20] = [False] * 20
            seen.add(window)
        kept = b" ".join(w for w, k in zip(own, keep, strict=True) if k)
        row = found.pop(i * 3)
        assert (row["n_words"], row["n_removed"], row["kept_sha256"]) == (len(own), keep.count(False), hashlib.sha256(kept).hexdigest())
        assert row["kept"] is None if all(keep) else row["kept"] == kept.decode()
        removed += keep.count(False)
    assert removed > 6000 and not found


def test_substring_dedup_of_odd_rows(spark, empty):
    assert substring_dedup.remove_repeats(empty).count() == 0
    rows = spark.createDataFrame([(1, SHARED), (1, SHARED), (None, SHARED), (2, SHARED)], "doc_id long, text string")
    found = sorted(((r["doc_id"] or 0, r["n_removed"]) for r in substring_dedup.remove_repeats(rows).collect()))
    assert found == [(0, 0), (1, 0), (1, 0), (2, 60)]


def removed_by_brute_force(rows, window=20):
    """n_removed of each (doc_id, text): by every window that starts in a smaller doc_id, or earlier in the same text."""
    first = {}
    for i, text in rows:
        own = words(text)
        for s in range(len(own) - window + 1):
            key = tuple(own[s : s + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        own, seen, gone = words(text), set(), set()
        for s in range(len(own) - window + 1):
            key = tuple(own[s : s + window])
            if first[key] < i or key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        out.append((i, text, len(gone)))
    return sorted(out)


def test_substring_dedup_keeps_rows_that_share_an_id(spark):
    a, b = prose("a", 60), prose("b", 60)
    rows = [(1, a), (5, a), (5, b), (7, f"x {a}"), (7, "short one"), (9, b), (9, b), (9, b.replace(" ", "  ", 1)), (12, f"{b} {b}")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["doc_id"], r["text"], r["n_removed"]) for r in substring_dedup.remove_repeats(frame).collect())
    assert found == removed_by_brute_force(rows)
    assert (5, b, 0) in found and (7, "short one", 0) in found and (9, b, 60) in found


def test_substring_dedup_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 400)
    monkeypatch.setattr(substring_dedup, "AUTOMATON", 7)
    draw = random.Random(4)
    passages = [prose(f"p{k}", draw.randint(15, 70)) for k in range(12)]
    rows = [(draw.randrange(60), " ".join([prose(f"{n}x", draw.randint(0, 40)), *draw.sample(passages, 2), prose(f"{n}y", draw.randint(0, 40))])) for n in range(60)]
    frame = spark.createDataFrame([(*r, "n", "k") for r in rows], "doc_id long, text string, kept string, n_words string")
    found = sorted((r["doc_id"], r["text"], r["n_removed"]) for r in substring_dedup.remove_repeats(frame).collect())
    assert found == removed_by_brute_force(rows) and sum(r[2] for r in found) > 2000


def test_without_automata_nothing_is_found(spark, monkeypatch):
    rows = [(1, SHARED), (2, f"x {SHARED}")]
    shard = [(i, i, words(t)) for i, t in rows]
    assert len(substring_dedup.settle(shard, set(), substring_dedup.WordHashes())[1][0]) == 41
    monkeypatch.setattr(substring_dedup, "occurrences", lambda phrases, documents: [(np.empty(0, np.int64), np.empty(0, bool)) for _ in documents])
    assert len(substring_dedup.settle(shard, set(), substring_dedup.WordHashes())[1][0]) == 0


def test_automata_find_every_place():
    texts = [[b"a", b"b", b"a", b"b", b"a", b"bb", b"a", b"b"], [b"b", b"a", b"b"]]
    found = substring_dedup.occurrences([(b"a b", True), (b"b a", False)], texts, most=1)
    assert [sorted(zip(p.tolist(), m.tolist())) for p, m in found] == [[(0, True), (1, False), (2, True), (3, False), (6, True)], [(0, False), (1, True)]]


def test_lm_counts_and_base(docs, empty):
    learn = remainder("doc_id", 5) != 1
    rows = {r["doc_id"]: r for r in lm_scoring.Model(docs, learn).score(docs).collect()}
    tokens = {i * 3: [*(t or "").encode().translate(ASCII_LOWER).split(), b""] for i, t in enumerate(TEXTS)}
    count = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    n, v = sum(count.values()), len(count)
    for i, t in tokens.items():
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        row = rows.pop(i)
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(t), sum(count[w] > 0 for w in t), n)
        assert row["base_score"] == pytest.approx(base) and row["score"] < 0
    assert not rows
    assert lm_scoring.Model(empty, learn).score(empty).count() == 0


def test_lattice_sums_over_segmentations():
    pieces = {"▁a": 0, "b": 1, "ab": 2, "▁": 3, "a": 4, "▁ab": 5}
    weights = np.log(np.array([0.2, 0.2, 0.1, 0.2, 0.1, 0.1, 0.04, 0.03, 0.02, 0.01]))
    lattice = lm_scoring.Lattice(pieces, weights)
    p = lambda *ids: math.prod(math.exp(weights[i]) for i in ids)
    ways = [(0, 1), (3, 4, 1), (3, 2), (5,)]
    assert lattice.log_spelling([b"ab", "ž".encode()]) == pytest.approx([math.log(sum(p(*w) for w in ways)), math.log(p(3, 7))])
    used = lattice.expected([b"ab"])
    assert used[1] == pytest.approx((p(0, 1) + p(3, 4, 1)) / sum(p(*w) for w in ways), rel=1e-5)


def every_way(word, longest):
    if not word:
        yield []
    for n in range(1, min(longest, len(word)) + 1):
        for rest in every_way(word[n:], longest):
            yield [word[:n], *rest]


def test_long_words_score_as_short_ones(monkeypatch):
    """Words of more than LONG characters, in parts, against all segmentations and against the recursion at once."""
    pieces = {"▁a": 0, "b": 1, "ab": 2, "▁": 3, "a": 4, "▁ab": 5, "bba": 6}
    weights = np.log(np.array([0.2, 0.2, 0.05, 0.2, 0.1, 0.1, 0.05, 0.04, 0.03, 0.02, 0.01]))
    draw = random.Random(2)
    words_ = [("".join(draw.choice("abž") for _ in range(n))).encode() for n in (0, 1, 3, 7, 9, 12)] * 2
    short = lm_scoring.Lattice(pieces, weights)
    want, used = short.log_spelling(words_), short.expected(words_)
    price = lambda p: weights[pieces[p]] if p in pieces else weights[len(pieces) + len(p.encode()) - 1] if len(p) == 1 else -np.inf
    for w, log in zip(words_[:5], want, strict=False):
        assert log == pytest.approx(math.log(sum(math.exp(sum(map(price, way))) for way in every_way("▁" + w.decode(), 4))))
    monkeypatch.setattr(lm_scoring, "LONG", 1)
    monkeypatch.setattr(lm_scoring, "BLOCK", 3)
    assert short.log_spelling(words_) == pytest.approx(want) and short.expected(words_) == pytest.approx(used, rel=1e-4)


def test_sets_of_weights_go_side_by_side(monkeypatch):
    """Several sets at once are as each alone, for the words that are in a set; chances too small for plain numbers too."""
    pieces = {"▁a": 0, "b": 1, "ab": 2, "▁": 3, "a": 4, "▁ab": 5, "bba": 6}
    draw = np.random.default_rng(3)
    weights = np.log(draw.dirichlet(np.ones(11), 3))
    weights[2, 7:] = -600.0  # a strange character nearly never
    words_ = ["".join(draw.choice(list("abž"), n)).encode() for n in (0, 1, 3, 7, 9, 40, 40)] + ["ab".encode()]
    there = draw.integers(0, 2, (3, len(words_))).astype(bool)
    for long in (lm_scoring.LONG, 5):
        monkeypatch.setattr(lm_scoring, "LONG", long)
        stacked = lm_scoring.Lattice(pieces, weights)
        alone = [stacked.weighed(w) for w in weights]
        assert np.allclose(stacked.log_spelling(words_), [a.log_spelling(words_) for a in alone])
        used = stacked.expected(words_, there)
        for a, own, row in zip(alone, there, used, strict=True):
            assert np.allclose(a.expected([w for w, t in zip(words_, own, strict=True) if t]), row)
            # Each character of a word is in one used piece.
            sizes = np.array([*map(len, pieces), 1, 1, 1, 1])
            assert row @ sizes == pytest.approx(sum(len("▁" + w.decode()) for w, t in zip(words_, own, strict=True) if t))


def test_very_long_words_need_little_memory():
    tracemalloc.start()
    lattice = lm_scoring.Lattice(pieces := lm_scoring.vocabulary(), lm_scoring.Lattice.first(pieces))
    draw = random.Random(5)
    found = lattice.log_spelling(["".join(draw.choice("abcdefgh漢字") for _ in range(20_000)).encode() for _ in range(4)])
    assert np.isfinite(found).all() and tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()


def test_lm_scores_equal_brute_force(spark):
    """Both scores of each row by hand: one class, no fitted weights."""
    texts = ["the cat sat", "The cat ran on the mat", None, "a dog", "zebra the"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = lm_scoring.Model(rows, F.col("doc_id") < 4, classes=1, rounds=0)
    found = {r["doc_id"]: r for r in model.score(rows).collect()}
    tokens = {i: [*(t or "").lower().encode().split(), b""] for i, t in enumerate(texts)}
    count = Counter(w for i, t in tokens.items() if i < 4 for w in t)
    n, v, ones, twos = sum(count.values()), len(count), sum(c == 1 for c in count.values()), sum(c == 2 for c in count.values())
    discount = min(max((ones + 0.5) / (ones + 2 * twos + 1.0), 0.1), 0.9)
    fresh, spelt = discount * v / n, (ones + 1.0) / (ones + 2.0)
    lattice = lm_scoring.Lattice(model.pieces, lm_scoring.Lattice.first(model.pieces))
    for i, own in tokens.items():
        logs = lattice.log_spelling(own)
        chance = [max(count[w] - discount, 0) / n + fresh * (1 - spelt) * count[w] / n + fresh * spelt * math.exp(x) for w, x in zip(own, logs, strict=True)]
        assert found[i]["score"] == pytest.approx(sum(map(math.log10, chance))) and found[i]["lattice_score"] == pytest.approx(logs.sum() / math.log(10))


def test_classes_are_fitted_to_all_rows(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SAMPLE", 4)
    rows = spark.createDataFrame([(i, ("abab " if i % 4 else "xyxy ") * 30) for i in range(200)], "doc_id long, text string")
    model = lm_scoring.Model(rows, F.lit(True), classes=2, rounds=0)
    assert model.classes == 1 or sorted(np.exp(model.shares)) == pytest.approx([0.25, 0.75], abs=0.02)


def test_unlearned_lm_still_scores(spark):
    rows = spark.createDataFrame([(1, "the cat"), (None, None)], "doc_id long, text string")
    found = lm_scoring.Model(rows, F.lit(False)).score(rows).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in found] == [1, 3] and all(math.isfinite(r["score"]) for r in found)


@pytest.fixture(scope="module")
def toxic(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        extra = f" {random.Random(i).choice(['scum', 'moron', 'loweiab', 'loweixy'])} you {random.Random(-i).choice(['scum', 'moron', 'loweizz'])}" if bad else ""
        rows.append((i, prose(i, 40) + extra))
        labels.append((i, int(bad), int(bad)))
    rows += [(500, None), (501, ""), (502, "scum"), (None, "moron " * 3)]
    labels += [(3, None, 0), (5, 0, 0), (9999, 1, 1), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity_on_held_out_rows(toxic):
    docs, labels = toxic
    index = toxicity.fit(docs, labels, remainder("doc_id", 3) != 1)
    rows = toxicity.score(docs, index).withColumn("out", remainder("doc_id", 3) == 1).collect()
    held = [r for r in rows if r["out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert len(held) > 80 and all(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held)
    assert all(0 <= r["score"] <= 1 for r in rows) and len(rows) == 404
    assert next(r for r in rows if r["doc_id"] == 0)["evidence"][0]["toxic"] > 0.5


def toxicity_by_brute_force(examples, texts, k=15):
    """Scores of texts from (doc_id, text, label) of examples that stand for themselves: every cosine, vote and curve."""

    def terms(text):
        return Counter(re.findall(r"\w+", (text or "").lower()))

    known = [(terms(t), y) for _, t, y in sorted(examples)]
    n, of = len(known), Counter(y for _, y in known)
    df = Counter((t, y) for c, y in known for t in c)

    def weight(t):
        one, zero = df[t, 1], df[t, 0]
        if not one + zero:
            return math.log(1 + n) * 0.05
        p = (one + zero + 1) / (n + 2)
        z = (one / of[1] - zero / of[0]) / math.sqrt(p * (1 - p) * (1 / of[0] + 1 / of[1]))
        return math.log(1 + n / (one + zero)) * (0.05 + min(abs(z) / 8, 1) ** 2)

    def vector(counts):
        v = {t: (1 + math.log(c)) * weight(t) for t, c in counts.items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1
        return {t: x / size for t, x in v.items()}

    groups = defaultdict(list)
    for c, y in known:
        groups[tuple(sorted(c.items()))].append(y)
    entries = [(vector(dict(c)), ys) for c, ys in groups.items()]
    prior = of[1] / n

    def cosines(counts):
        v = vector(counts)
        return [sum(x * e.get(t, 0) for t, x in v.items()) for e, _ in entries]

    def vote(cos, without=None):
        near = sorted(((-round(c, 12), i) for i, c in enumerate(cos) if c > 0))[:k]
        up = down = 0.0
        for c, i in near:
            ys = list(entries[i][1])
            if without is not None and i == without[0]:
                ys.remove(without[1])
            if ys:
                w = math.log2(1 + len(ys)) / (min(max(1 + c, 0), 1) + 0.05) ** 2
                up, down = up + w * sum(ys) / len(ys), down + w
        return (up + 0.5 * prior) / (down + 0.5), bool(near)

    logit = lambda p: math.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4)))
    rows = []
    for i, (c, ys) in enumerate(zip(map(dict, groups), (ys for _, ys in entries), strict=True)):
        cos = cosines(c)
        rows += [(logit(vote(cos, (i, y))[0]), y, ys.count(y)) for y in (0, 1) if y in ys and any(x > 0 for x in cos)]
    x, y, w = (np.array(r, float) for r in zip(*rows, strict=True))
    ones, zeros = y.sum(), (1 - y).sum()
    goal = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a, b = 1.0, 0.0
    for _ in range(4000):  # plain gradient steps to the same optimum
        p = 1 / (1 + np.exp(-(a * x + b)))
        a, b = a - ((w * (p - goal) * x).sum() + a - 1) / w.sum() / 4, b - ((w * (p - goal)).sum() + 0.1 * b) / w.sum()
    out = []
    for text in texts:
        v, near = vote(cosines(terms(text)))
        out.append(1 / (1 + math.exp(-(a * logit(v) + b))) if near else prior)
    return out


def test_toxicity_equals_brute_force(spark, toxic):
    """Few examples of each label, so that all are learned and each stands for itself; a text repeats, once with either label."""
    docs, labels = toxic
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    rows |= {600: rows[0], 601: rows[0], 602: rows[1]}
    marks = {r["doc_id"]: r["toxic"] for r in labels.where("doc_id < 90 and toxic is not null").collect()} | {5: 1, 600: 1, 601: 0, 602: 0}
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    index = toxicity.fit(frame, spark.createDataFrame(list(marks.items()), "doc_id long, toxic int"), F.lit(True))
    asked = [(i, t) for i, t in rows.items()] + [(700, "moron"), (701, "unheard of wordsonly"), (702, "loweizz " * 3 + prose(8, 300))]
    found = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(asked, "doc_id long, text string"), index).collect()}
    expected = toxicity_by_brute_force([(i, rows[i], y) for i, y in marks.items()], [t for _, t in asked])
    assert [found[i] for i, _ in asked] == pytest.approx(expected, abs=2e-3)


def test_toxicity_index_is_exact(toxic):
    """Block bounds lose no neighbour: the k best of every entry's cosine, from an index of many blocks."""
    docs, labels = toxic
    docs = docs.withColumn("text", F.concat(F.lit("and the "), "text"))
    index = toxicity.fit(docs, labels, remainder("doc_id", 3) != 1)
    assert index.blocks > 3 and len(index.common) and len(index.entry)
    for text in ("the " + prose(7, 20), "the", "scum moron", "loweizz " * 3 + prose(8, 300), "moron"):
        ids, weights = index.vector(toxicity.terms_of(text))
        ((at, cosines),) = index.nearest([(ids, weights)])
        term = np.repeat(np.repeat(np.arange(len(index.terms)), np.diff(index.first)), index.end - index.start)
        matrix = np.zeros((len(index.terms), index.size))
        matrix[term, index.entry] = index.value
        matrix[index.row[:-1] >= 0] = index.common
        every = weights @ matrix[ids]
        assert sorted(every[every > 0])[::-1][: index.k] == pytest.approx(cosines.tolist())


def test_toxicity_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(docs, toxicity.fit(docs, none, F.lit(True))).collect()} == {0.0}
    assert toxicity.score(empty, toxicity.fit(empty, none, F.lit(True))).count() == 0


LICENSES = [
    "All rights reserved. CC BY 4.0", "Licensed under the Apache License, Version 2.0", "GNU General Public License, version 3 or later", "cc by cc by; CC-BY-SA 3.0",
    None, "", "mit", "Released under the MIT License.", "all rights  reserved " * 30, "generally public licenses", "Ärights all rights reserved",
]


def test_license_base_counts(spark):
    rows = spark.createDataFrame(list(enumerate(LICENSES)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in license_scan.scan(rows).collect()}
    cut = set(range(0x30)) | set(range(0x3A, 0x61)) | set(range(0x7B, 0x80))
    for i, text in enumerate(LICENSES):
        low = (text or "").encode().translate(ASCII_LOWER).decode()
        own = "".join(" " if ord(c) in cut else c for c in low).split()
        places = [(s, label) for phrase, label in license_scan.BASE.items() for s in range(len(own)) if own[s : s + len(phrase.split())] == phrase.split()]
        row = found[i]
        starts = [s for s, _ in places]
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"]) == (len(own), len(places), min(starts, default=None), max(starts, default=None))
        assert row["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(",")) and 0 <= row["score"] <= 1
    assert found[1]["labels"] == "apache-2.0,licensed"
    assert found[2]["labels"] == "gpl,gpl-3.0-or-later"
    assert "cc-by-sa-3.0" in found[3]["labels"] and "mit" in found[7]["labels"]
    assert found[9]["labels"] == "" and found[9]["score"] == 0


def scanned(text, every):
    """(n_words, base places, detections, labels, score) by trying every rule at every word."""
    low = (text or "").encode().translate(ASCII_LOWER).decode()
    own = [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low) if w]
    base = [(s, label) for phrase, label in license_scan.BASE.items() for s in range(len(own)) if own[s : s + len(phrase.split())] == phrase.split()]
    spans = []
    for i in range(len(own)):
        ahead = " ".join(own[i : i + license_scan.REACH])
        for order, (label, keyword, expression, rank) in enumerate(every):
            if (ahead + " ").startswith(keyword + " ") and (hit := re.match(f"(?:{expression})(?= |$)", ahead)):
                spans.append((i, i + len(hit[0].split()), rank, -order, label))
    kept = [s for s in spans if not any(t != s and t[0] <= s[0] and t[1] >= s[1] and t[2] >= s[2] and (t[:2] != s[:2] or t[2:4] > s[2:4]) for t in spans)]
    labels = sorted({label for _, label in base} | {s[4] for s in kept})
    return len(own), sorted(base), sorted((s[0], s[1], s[4]) for s in kept), labels, max([license_scan.CONFIDENCE[s[2]] for s in kept], default=0.0)


def test_license_scan_equals_brute_force(spark):
    """Every rule's own words, alone and run together, in random order, cut short, repeated; nulls, empties, clashing columns."""
    draw = random.Random(9)
    every = license_scan.rules()
    plain = [re.sub(r"\[a-z0-9 \]\{1,60\}", "acme", re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", e)).replace("[a-z0-9 ]{1,60}", "acme").replace("[cs]", "c").replace("[0-9]{2}", "07").replace(" ?", " ").replace("?", "").replace("(?:", "").replace(")", "") for _, _, e, _ in every]
    texts = [*LICENSES, *plain, "cc by " * 300, "all rights reserved " * 70, "word " * 2000, "x" * 50_000]
    for _ in range(120):
        some = draw.sample(plain, 4)
        words_ = " and ".join(some).split() if draw.random() < 0.5 else " ".join(some).split()
        cut = draw.randrange(len(words_))
        texts.append(", ".join(words_[cut:] + words_[:cut]).upper())
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("labels", F.lit("old")).repartition(4)
    found = license_scan.scan(frame).collect()
    assert len(found) == len(texts)
    for row in found:
        n_words, base, detections, labels, score = scanned(texts[row["doc_id"]], every)
        starts = [s for s, _ in base]
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"]) == (n_words, len(base), min(starts, default=None), max(starts, default=None))
        assert sorted((d["word"], d["end"], d["label"]) for d in row["detections"] or []) == detections, texts[row["doc_id"]]
        assert (row["labels"], row["score"], row["base_labels"]) == (",".join(labels), score, ",".join(sorted({x for _, x in base})))
    alone = {i: scanned(t, every)[3] for i, t in enumerate(plain)}
    assert sum(every[i][0] in labels for i, labels in alone.items()) > 0.9 * len(every)
    assert license_scan.scan(frame.limit(0)).count() == 0


def test_license_rules_are_many():
    every = license_scan.rules()
    assert len(every) > 300 and len({e for _, _, e, _ in every}) == len(every)
    assert max(e.count(" ") for _, _, e, _ in every) < license_scan.REACH


def test_decontamination_finds_edited_items(spark, docs):
    items = [(1, prose("i1", 30)), (2, prose("i2", 20)), (3, None), (4, "a b c"), (5, prose("i1", 30))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    edited = prose("i1", 30).split()
    edited[4], edited[11] = "changed", "also"
    del edited[20]
    far = prose("i2", 20).split()
    for k in range(0, 20, 3):
        far[k] = "other"
    rows = spark.createDataFrame(
        [(1, f"{prose(1, 50)} {' '.join(edited)} {prose(2, 50)}"), (2, f"{prose(3, 9)} {prose('i2', 20).upper()}!"), (3, " ".join(far)), (4, None), (5, "a, b, c"), (None, prose("i2", 20)), (6, prose(9, 3000))],
        "doc_id long, text string",
    )
    found = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find(rows, benchmark).collect()}
    assert set(found) == {(1, 1), (1, 5), (2, 2), (5, 4), (None, 2)}
    assert found[(1, 1)]["distance"] == 3 and found[(2, 2)]["first_word"] == 9 and found[(2, 2)]["end_word"] == 29
    assert {r["doc_id"] for r in decontaminate.without_items(rows, benchmark).collect()} == {3, 4, 6}
    assert decontaminate.find(rows, benchmark.limit(0)).count() == 0


def test_edit_distance_equals_plain_one():
    draw = random.Random(5)
    for _ in range(200):
        a = [draw.choice([b"x", b"y", b"z"]) for _ in range(draw.randint(1, 9))]
        b = [draw.choice([b"x", b"y", b"z"]) for _ in range(draw.randint(0, 12))]
        mask = {}
        for at, w in enumerate(a):
            mask[w] = mask.get(w, 0) | 1 << at
        last = list(range(len(a) + 1))
        best = last[-1]
        for j, w in enumerate(b[: len(a) + 3], 1):
            row = [j]
            for i, x in enumerate(a, 1):
                row.append(min(last[i] + 1, row[-1] + 1, last[i - 1] + (x != w)))
            last, best = row, min(best, row[-1])
        assert decontaminate.edit_within(mask, len(a), b, 3)[0] == best


def test_decontamination_recall():
    draw = random.Random(11)
    items = [(i, prose(f"r{i}", draw.randint(14, 50))) for i in range(80)]
    walks, hits = decontaminate.Walks(items), 0
    for i, text in items:
        own = text.split()
        for _ in range(max(1, len(own) // 10)):
            at = draw.randrange(len(own))
            own[at : at + 1] = draw.choice([["zz"], [], [own[at], "zz"]])
        hits += any(m[0] == i for m in walks.matches(f"{prose('before', 40)} {' '.join(own)} {prose('after', 40)}"))
    assert hits >= 72


def test_quality_on_held_out_rows(spark, toxic):
    docs, labels = toxic
    graded = labels.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("quality"))
    texts = docs.where("doc_id < 400").select("doc_id", F.concat("text", F.repeat(F.lit(" !! spam"), ((2 - F.col("doc_id") % 3) * 6).cast("int"))).alias("text"))
    model, grades = quality.fit(texts, graded, remainder("doc_id", 3) != 1)
    assert grades == [0, 1, 2] and model.cuts[0] < model.cuts[1]
    held = quality.score(texts, model, grades).where(remainder("doc_id", 3) == 1).collect()
    means = [np.mean([r["expected_grade"] for r in held if r["doc_id"] % 3 == g]) for g in range(3)]
    assert means[0] < means[1] - 0.3 < means[2] - 0.6
    assert all(0 <= r["tail_prob"] <= 1 for r in held)


def test_ordinal_fit_is_the_optimum():
    """At the fitted weights and thresholds no small step lowers the loss, written here from its definition."""
    draw = np.random.default_rng(4)
    x = np.hstack([draw.normal(size=(150, 3)), np.ones((150, 1)), np.zeros((150, quality.SHAPES))])
    grades = np.digitize(x[:, :3] @ [1.5, -1.0, 0.0] + draw.logistic(size=150), [-1.0, 1.0, 2.0])
    rows = [(np.arange(x.shape[1], dtype=np.int32), row) for row in x]
    model = quality.Ordinal(4, dimensions=4).fit(rows, grades, steps=4000)
    share = np.bincount(grades, minlength=4)

    def loss(weights, cuts):
        above = 1 / (1 + np.exp(-((x @ weights)[:, None] - cuts)))
        chance = np.hstack([np.ones((150, 1)), above])[np.arange(150), grades] - np.hstack([above, np.zeros((150, 1))])[np.arange(150), grades]
        weight = 1 / share[grades]
        return -(weight / weight.mean() * np.log(chance)).mean() + quality.RIDGE / 2 * (weights**2).sum()

    best = loss(model.weights, model.cuts)
    assert (np.diff(model.cuts) > 0).all() and best < loss(0 * model.weights, model.cuts) - 0.1
    for size in (0.02, 0.2):
        for _ in range(100):
            assert loss(model.weights + draw.normal(size=len(model.weights)) * size, model.cuts + draw.normal(size=3) * size) > best - 1e-5


@pytest.mark.parametrize("tail, cut", [(None, 1), (2, 1), (1, 0), (0, None)])
def test_quality_tail(spark, tail, cut):
    frame = spark.createDataFrame([(1, "a good text"), (2, None)], "doc_id long, text string").withColumn("keep", F.lit("old"))
    model = quality.Ordinal(3)
    model.cuts = np.array([-1.0, 0.5])
    for row in quality.score(frame, model, [0, 1, 2], tail=tail).collect():
        above = model.above(*quality.features({1: "a good text"}.get(row["doc_id"], "")))
        assert row["tail_prob"] == pytest.approx(1.0 if cut is None else above[cut]) and row["expected_grade"] == pytest.approx(above.sum()) and row["keep"] == (row["tail_prob"] >= 0.5)


def test_quality_of_odd_rows(docs, empty):
    none = docs.select("doc_id", F.lit(None).cast("int").alias("quality"))
    model, grades = quality.fit(docs, none, F.lit(True))
    assert {r["expected_grade"] for r in quality.score(docs, model, grades).collect()} == {0.0}
    assert quality.score(empty, model, grades).count() == 0


URLS = [
    "http://A.Example.com/en/7?x", "https://example.com/en/", "http://x.net/de/8", "http://www.example.net/de/81#t", "http://net/de/", "ftp://org", "no url", None, "http://sub.org/es/a://b",
    "http://example.net?/de/8", "http://example.com/en/7", "http://example.com/en/7", "http://.com/en/", "//x", "http://notexample.com/en/7", "http://" + "a." * 300 + "com/en/" + "z" * 9000,
]


def test_urls_equal_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS)], "page_id long, url string, html string, rules string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    found = {r["page_id"]: r for r in url_filter.judge(pages, rules).collect()}
    assert sorted(found.values(), key=str) == sorted(url_filter.judge(pages, rules, sweep_rows=2).collect(), key=str)  # in parts
    for i, url in enumerate(URLS):
        host = path = ""
        if url and "://" in url:
            rest = url.partition("://")[2]
            end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
            host, rest = rest[:end].encode().translate(ASCII_LOWER).decode(), rest[end:]
            path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        assert (found[i]["host"], found[i]["path"], found[i]["rule"], found[i]["verdict"]) == (host, path, rule, verdict)
    assert len(found) == len(URLS)
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_url_verdicts_are_those_of_the_contract(spark, tmp_path):
    """Each rule's word as the contract has it, not as the code or the SQL has it."""
    expected = {
        "http://a.com/en/1": ("com/en/", "block"), "http://example.com/en/71": ("example.com/en/7", "allow"), "http://x.net/de/1": ("net/de/", "allow"),
        "http://www.example.net/de/8": ("example.net/de/8", "block"), "http://example.net/de/9": ("net/de/", "allow"), "http://a.org/es/": ("org/es/", "block"), "http://a.org/de/": (None, "allow"),
    }
    spark.createDataFrame(list(enumerate(expected)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in op7_url_filter(spark, str(tmp_path)).collect()}
    assert found == dict(enumerate(expected.values()))


def test_fingerprints(spark, docs, empty):
    rows = {(r["doc_id"], r["nth"]): r for r in fingerprint.with_edited(docs).collect()}
    ids = sorted(i for i, _ in rows)
    text = {i * 3: t or "" for i, t in enumerate(TEXTS)}
    for i, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        half = len(text[i]) // 2
        assert rows[(i, 1)]["edited"] == text[i][: len(text[i]) - half] + text[after][:half]
    assert fingerprint.with_edited(empty).count() == 0 and fingerprint.fingerprints(empty).count() == 0


def jaccard_of_bags(a, b):
    a, b = (Counter(fingerprint_words(t)) for t in (a, b))
    return sum((a & b).values()) / sum((a | b).values())


def fingerprint_words(text):
    return re.split(f"[{' '}\t\n\x0b\x0c\r]+", text.strip(" \t\n\x0b\x0c\r"))


def test_fingerprint_query_equals_brute_force(spark, tmp_path):
    """All columns; likeness against the exact generalised Jaccard similarity, within the error of 64 samples."""
    rows = [*((i * i * 7 - 40, t) for i, t in enumerate(TEXTS)), (10**15, TEXTS[1]), (None, "no id"), (None, None), (3, "same id"), (3, "id, same")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = op8_fingerprint(spark, str(tmp_path)).collect()
    placed = sorted(((i, t or "") for i, t in rows if i is not None))
    errors = []
    for (i, text), (_, after) in zip(placed, [*placed[1:], placed[0]], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        (row,) = [r for r in found if (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (i, len(text), digest) and not found.remove(r)][:1] or [None]
        errors += [row["near_edited"] - jaccard_of_bags(text, edited), row["near_next"] - jaccard_of_bags(text, after)]
        assert len(row["fingerprint"]) == 8 * fingerprint.SAMPLES
    assert np.abs(errors).max() < 0.25 and np.abs(errors).mean() < 0.05
    assert sorted(r["n_chars"] for r in found) == [0, 5]
    assert all(r["fingerprint"] and r["edited_sha256"] is r["edited_fingerprint"] is r["near_edited"] is r["near_next"] is None for r in found)


def test_equal_texts_have_equal_fingerprints(spark):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a", "a a b", "", None, "a b", "a b a"])], "doc_id long, text string")
    found = {r["doc_id"]: r["own"] for r in fingerprint.fingerprints(frame).collect()}
    assert found[0] == found[1] == found[5] != found[4] and found[2] == found[3]


def test_ranges_hold_as_many_rows_each(spark):
    frame = spark.createDataFrame([(i,) for i in [*range(1000), 10**15, -5]], "doc_id long")
    ranged, parts = fingerprint.in_ranges(frame)
    sizes = {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}
    assert max(sizes.values()) < 2 * 1002 / parts and ranged.agg(F.corr("part", F.least("doc_id", F.lit(1001)))).first()[0] > 0.99


@pytest.mark.parametrize("samples", [20, 256, 4096])
def test_collisions_estimate_generalised_jaccard(spark, samples):
    a, b = Counter({f"w{i}": 1 + i % 4 for i in range(40)}), Counter({f"w{i}": 1 + i % 3 for i in range(12, 50)})
    exact = sum((a & b).values()) / sum((a | b).values())
    texts = [(0, 1, i, " ".join(c.elements())) for i, c in enumerate((a, b))]
    frame = spark.createDataFrame(texts, "part int, doc_id long, nth int, text string")
    own, other = (r["own"] for r in fingerprint.signatures(frame, ["part", "doc_id", "nth"], {"own": "text"}, samples=samples).orderBy("nth").collect())
    assert len(own) == samples and abs(np.mean([x == y for x, y in zip(own, other, strict=True)]) - exact) < 1.6 / samples**0.5


def test_byte_bpe_equals_tiktoken(spark, docs):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(byte_bpe.VOCABULARY), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = ["<|endoftext|>", "  \n\n x", "naïve 漢字 🙂👩‍👩‍👧", "\x00\x01 Ġ ▁", "don't  stop" * 50, "a" * 5000, None, "", "\u2028é\u0301"]
    rows = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    coded = byte_bpe.decode(byte_bpe.encode(rows)).collect()
    for r in coded:
        assert list(r["ids"]) == plain.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    trip = {r["doc_id"]: (list(r["ids"]), r["round_trip"]) for r in byte_bpe.round_trip(rows).collect()}
    assert trip == {r["doc_id"]: (list(r["ids"]), True) for r in coded}
    short = {r["doc_id"]: r for r in byte_bpe.digests(rows).collect()}
    for r in coded:
        got = short[r["doc_id"]]
        assert (got["n_tokens"], got["ids_sha256"]) == (len(r["ids"]), hashlib.sha256(" ".join(map(str, r["ids"])).encode()).hexdigest())


def test_outputs_replace_clashing_columns_and_empty_tables_stay_empty(spark):
    rows = spark.createDataFrame([(1, "a text", "http://a.com/en/"), (1, "a text", "http://a.com/en/"), (None, None, None)], "doc_id long, text string, url string")
    clashing = rows.withColumns({c: F.lit("old") for c in ("n_tokens", "ids_sha256", "decoded_sha256", "expected_grade", "tail_prob", "keep", "host", "path", "rule", "verdict", "score", "predicted", "evidence", "ids", "decoded", "word", "labels", "n_words")})
    values = ", ".join(map(str, url_filter.RULES))
    rules = spark.sql(f"select * from values {values} as r(host, path, verdict)")
    index = toxicity.fit(rows, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), F.lit(True))
    operators = {
        "n_tokens": byte_bpe.digests, "ids": byte_bpe.encode, "keep": lambda d: quality.score(d, quality.Ordinal(2), [0, 1]), "verdict": lambda d: url_filter.judge(d, rules),
        "predicted": lambda d: toxicity.score(d, index), "labels": license_scan.scan, "n_words": substring_dedup.remove_repeats,
    }
    for name, operator in operators.items():
        out = operator(clashing)
        assert [c.lower() for c in out.columns].count(name) == 1 and [r[name] != "old" for r in out.collect()] == [True] * 3, name
        assert operator(clashing.limit(0)).count() == 0


def test_one_very_long_word(spark):
    """A text without white space, of 300,000 characters, through each operator that reads texts."""
    rows = spark.createDataFrame([(1, "xy漢" * 100_000), (2, "short text")], "doc_id long, text string")
    index = toxicity.fit(rows, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), F.lit(True))
    assert toxicity.score(rows, index).count() == 2 and license_scan.scan(rows).first()["n_words"] >= 1
    assert {r["n_removed"] for r in substring_dedup.remove_repeats(rows).collect()} == {0}
    assert simhash.near_duplicates(rows).count() == 2 and fingerprint.fingerprints(rows).count() == 2
    assert decontaminate.find(rows, rows.select(F.col("doc_id").alias("item_id"), "text")).count() == 2
    assert byte_bpe.decode(byte_bpe.encode(rows)).where("cast(decoded as string) != text").count() == 0
    assert all(math.isfinite(r["score"]) for r in lm_scoring.Model(rows, F.lit(True), rounds=1).score(rows).collect())


def test_toxicity_ties_go_by_position(spark):
    rows = spark.createDataFrame([(i, "scum here" if i % 2 else "fine words") for i in range(60)], "doc_id long, text string")
    labels = rows.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    found = {tuple(map(str, r["evidence"])) + (r["score"],) for r in toxicity.score(rows, toxicity.fit(rows, labels, F.lit(True))).collect()}
    assert len(found) == 2  # equal texts, equal evidence and score


def bits_of(text):
    own = (text or "").encode().translate(ASCII_LOWER).split()
    shingles = [b" ".join(own[k : k + 4]) for k in range(len(own) - 3)] or ([b" ".join(own)] if own else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_fingerprints(docs):
    found = {r["doc_id"]: r["bits"] for r in simhash.near_duplicates(docs).collect()}
    assert found == {i * 3: int(np.uint64(bits_of(t)).astype(np.int64)) for i, t in enumerate(TEXTS)}


def classes(values, distance=4):
    above = list(range(len(values)))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= distance:
                above[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(values)):
        groups[root(i)].append(i)
    return sorted(sorted(g) for g in groups.values())


def test_simhash_links_lose_nothing(spark):
    draw = random.Random(2)
    values = [draw.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    for v in values[:30]:
        for _ in range(6):
            for b in draw.sample(range(64), draw.randint(1, 6)):
                v ^= 1 << b
            values.append(v)
    hub = draw.getrandbits(64)
    values = list(dict.fromkeys([*values, *(hub ^ (i << 20) for i in range(300)), *(hub ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i))]))
    frame = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "bits long")
    member = {r["node"]: r["component"] for r in simhash.components(frame, simhash.links(frame)).collect()}
    groups = defaultdict(list)
    for i, (bits,) in enumerate(frame.collect()):
        groups[member.get(bits, bits)].append(i)
    order = {int(np.uint64(v).astype(np.int64)): i for i, v in enumerate(values)}
    found = sorted(sorted(order[frame_bits] for frame_bits in g) for g in _by_bits(frame, member))
    assert found == classes(values)


def _by_bits(frame, member):
    groups = defaultdict(list)
    for (bits,) in frame.collect():
        groups[member.get(bits, bits)].append(bits)
    return groups.values()


def family(seed=3):
    draw = np.random.default_rng(seed)
    base = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([base ^ (np.uint64(1) << draw.integers(0, 63, 40).astype(np.uint64)) for _ in range(20)]))
    return values[np.argsort(simhash.gray_rank(values))]


def test_gray_index_finds_all_pairs():
    values = family()
    levels = simhash.index_levels(values)
    none = [np.full(len(fixed), -1) for fixed, _ in levels]
    found = {(int(i), int(j)) for a, b in simhash.node_pairs(levels, 2, none) for x, y in [simhash.near_pairs(values, a, b, 2)] for i, j in zip(x, y, strict=True)}
    assert found == {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if bin(int(values[i] ^ values[j])).count("1") <= 2}


def test_links_of_a_shard_are_a_forest():
    hub = np.uint64(0x0123456789ABCDEF)
    star = np.unique([hub ^ np.uint64(1 << i) ^ np.uint64(1 << j) for i in range(40) for j in range(i)])
    for values in (family(), star[np.argsort(simhash.gray_rank(star))], hub + np.arange(5, dtype=np.uint64), np.array([hub])):
        for distance in (2, 4):
            left, right = simhash.spanning_links(values, distance)
            assert len(left) < len(values) and all(bin(int(values[i] ^ values[j])).count("1") <= distance for i, j in zip(left, right, strict=True))
            above = list(range(len(values)))
            for i, j in zip(left.tolist(), right.tolist(), strict=True):
                a, b = above[i], above[j]
                assert a != b
                above = [a if x == b else x for x in above]
            groups = defaultdict(list)
            for i, x in enumerate(above):
                groups[x].append(i)
            assert sorted(groups.values()) == classes([int(v) for v in values], distance)


def test_simhash_of_odd_rows(spark, empty):
    assert simhash.near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(2, None), (1, ""), (None, " "), (7, "a b"), (None, "only here"), (7, "a b")], "doc_id long, text string")
    found = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash.near_duplicates(rows).collect())
    assert found == [("1", "1"), ("2", "1"), ("7", "7"), ("7", "7"), ("None", "1"), ("None", "None")]


def test_decontamination_finds_edits_wherever_they_are():
    draw = np.random.default_rng(8)
    items = [(i, " ".join(f"w{x}" for x in draw.integers(0, 3000, 15 + i % 45))) for i in range(180)]
    around = lambda words: " ".join(["before"] * 20 + words + ["behind"] * 20)
    edited = []
    for i, text in items:
        words = text.split()
        k = len(words) // 5
        edited += [(i, around(w)) for w in (["new"] * k + words[k:], words[k:], words[:-k] + ["new"] * k, words[:-k])]
    for short in ([], [(999, "w1")]):  # a one-word item changes nothing for the others
        found = decontaminate.Walks(items + short).all_matches(t for _, t in edited)
        assert all(i in {m[0] for m in own} for (i, _), own in zip(edited, found, strict=True))


def test_lm_weights_are_fitted_in_three_rounds(spark):
    documents = spark.createDataFrame([(i, f"the cat{i} sat on the mat and sang again") for i in range(12)], "doc_id long, text string")
    own, thrice = (lm_scoring.Model(documents, F.lit(True), classes=1, **more).weights[0] for more in ({}, {"rounds": 3}))
    assert np.allclose(own, thrice)


def test_equal_passages_are_verified_few_times(monkeypatch):
    """Once a passage equal to the item is found no other place can be better, so no further edit distance is computed."""
    item = " ".join(f"w{i}" for i in range(60))
    calls = []
    plain = decontaminate.edit_within
    monkeypatch.setattr(decontaminate, "edit_within", lambda *a, **k: calls.append(1) or plain(*a, **k))
    walks = decontaminate.Walks([(7, item)])
    assert walks.matches(f"some words before {item} and {item} after") == [(7, 3, 63, 0, 1.0)]
    assert len(calls) <= 16  # one for the passage, and one for each of the places up to it


def test_signatures_do_not_depend_on_the_step(spark, docs, monkeypatch):
    """Samples are made some at a time; how many is a matter of compiled code only, and stays under nine."""
    assert fingerprint.STEP <= 8
    frame, found = fingerprint.with_edited(docs), []
    for step in (4, 8, 16):
        monkeypatch.setattr(fingerprint, "STEP", step)
        rows = fingerprint.signatures(frame, ["part", "doc_id", "nth"], {"own": "text", "changed": "edited"}, 16).collect()
        found.append(sorted((r["doc_id"], r["nth"], r["own"], r["changed"]) for r in rows))
    assert found[0] == found[1] == found[2]
