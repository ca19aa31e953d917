"""License scans: ordered signature rules over normalised words, behind a keyword prefilter.

A text is lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters. A rule is a label, a
keyword of one or two words, a regular expression over the words from the keyword on (REACH words at most), and a
priority. Texts without the keyword of any rule go no further; in the others each rule is tried where its keyword stands.
What a rule finds is an interval of words. It is suppressed if it lies inside an interval of the same or a higher
priority; of the same interval, the higher priority and then the earlier rule stays. Base phrases are exempt.

An interval has REACH words at most, so what could contain it starts at most so many words before it: each keyword looks
back over the keywords of these words, and a text costs as much as it has words and keywords, however many repeat.

The whole scan is one projection over each row in DataFrame functions: no shuffle, no key, so one row in gives one row
out, whatever its id; repeated rows are scanned each, and an empty table gives an empty one. A null text counts as
empty: no words, no labels, score 0. The added columns replace input columns of the same names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, others, whole_text
from .license_rules import EXACT, FAMILY, KEYWORD, NOTICE, rules

#: Phrases that every scan counts, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

CONFIDENCE = {NOTICE: 0.4, FAMILY: 0.7, EXACT: 0.95}
NOT_WORDS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Words from a keyword on that an expression may take.
REACH = 32
OUTPUT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "detections", "score")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_of(keywords: list[str]) -> str:
    """An expression for any of the keywords, with their common beginnings shared."""
    by_first = defaultdict(list)
    for keyword in sorted(set(keywords)):
        by_first[keyword[:1]].append(keyword[1:])
    # A keyword ends before a space.
    parts = ["(?= )" if first == "" else first + any_of(rest) for first, rest in by_first.items()]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _by_keyword(every: list[tuple[str, str, str, int]]) -> Column:
    """A map from a keyword to its rules, as one literal."""
    grouped = defaultdict(list)
    for order, (label, keyword, expression, priority) in enumerate(every):
        grouped[keyword].append(f"named_struct('expression', {_text(f'^(?:{expression})(?= |$)')}, 'rank', {priority}, 'order', {order}, 'label', {_text(label)})")
    return F.expr(f"map({', '.join(f'{_text(keyword)}, array({', '.join(own)})' for keyword, own in grouped.items())})")


def _found(words: Column, at: Column, table: Column) -> Column:
    """at, and spans: what the rules of the keywords at this word find, with the word behind each end."""
    word = F.get(words, at)
    pair = F.concat(word, F.lit(" "), F.get(words, at + 1))
    none = F.filter(F.array(F.struct(F.lit("").alias("expression"), F.lit(0).alias("rank"), F.lit(0).alias("order"), F.lit("").alias("label"))), lambda r: F.lit(False))
    own = F.concat(F.coalesce(F.try_element_at(table, pair), none), F.coalesce(F.try_element_at(table, word), none))

    def tried(text: Column) -> Column:
        hits = F.transform(own, lambda r: F.struct(F.regexp_substr(text, r["expression"]).alias("hit"), r["rank"].alias("rank"), r["order"].alias("order"), r["label"].alias("label")))
        size = lambda hit: F.length(hit) - F.length(F.replace(hit, F.lit(" "))) + 1
        return F.transform(F.filter(hits, lambda h: h["hit"].isNotNull()), lambda h: F.struct((at + size(h["hit"])).alias("end"), h["rank"].alias("rank"), h["order"].alias("order"), h["label"].alias("label")))

    return F.struct(at.alias("at"), let(F.array_join(F.slice(words, at + 1, REACH), " "), tried).alias("spans"))


def _unsuppressed(found: Column) -> Column:
    """The spans, with the word where they start, that no other contains at the same or a higher priority."""

    def kept(own: Column, n: Column) -> Column:
        back = F.slice(found, F.greatest(n - REACH + 2, F.lit(1)), F.least(n, F.lit(REACH - 1)))

        def stays(s: Column) -> Column:
            inside = F.exists(back, lambda b: F.exists(b["spans"], lambda t: (t["end"] >= s["end"]) & (t["rank"] >= s["rank"])))
            beside = F.exists(
                own["spans"],
                lambda t: ((t["end"] > s["end"]) & (t["rank"] >= s["rank"])) | ((t["end"] == s["end"]) & ((t["rank"] > s["rank"]) | ((t["rank"] == s["rank"]) & (t["order"] < s["order"])))),
            )
            return ~inside & ~beside

        return F.transform(F.filter(own["spans"], stays), lambda s: F.struct(own["at"].alias("word"), s["end"].alias("end"), s["label"].alias("label"), s["rank"].alias("rank")))

    return F.flatten(F.transform(found, kept))


def _scanned(words: Column, every: list[tuple[str, str, str, int]]) -> Column:
    """base (word, label) and kept (word, end, label, rank) of a text by its words."""
    table = _by_keyword(every)
    known = [F.lit(sorted({r[1] for r in every if (" " in r[1]) == two})) for two in (False, True)]
    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.array_contains(known[0], F.get(words, i)) | F.array_contains(known[1], F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1))))

    def placed(phrase: str, label: str, at: Column) -> Column:
        """Where the phrase's words stand consecutively, of the places at which a keyword does."""

        def stands(i: Column) -> Column:
            together = F.lit(True)
            for k, word in enumerate(phrase.split()):
                together &= F.get(words, i + k) == word
            return F.coalesce(together, F.lit(False))

        return F.transform(F.filter(at, stands), lambda i: F.struct(i.alias("word"), F.lit(label).alias("label")))

    def both(at: Column) -> Column:
        base = [placed(phrase, label, at) for phrase, label in BASE.items()]
        found = F.filter(F.transform(at, lambda i: _found(words, i, table)), lambda f: F.size(f["spans"]) > 0)
        return F.struct(F.concat(*base).alias("base"), let(found, _unsuppressed).alias("kept"))

    return let(places, both)


def scan(documents: DataFrame, text: str = "text", more: list[tuple[str, str, str, int]] | None = None) -> DataFrame:
    """The rows with n_words, n_base, first_word, last_word, base_labels, labels, detections and score.

    more: further rules, after the built-in ones: label, keyword (the expression's first one or two words), expression,
    priority. detections: (word, end, label) of what was not suppressed.
    """
    every = [*rules(), *(more or [])]
    gate = " " + any_of([rule[1] for rule in every] + [KEYWORD.match(phrase)[0] for phrase in BASE])
    columns = others(documents, *OUTPUT)
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(whole_text(text)), NOT_WORDS, " ")), F.lit(" "))
    frame = documents.select(*columns, norm.alias("_norm"))
    norm = F.col("_norm")
    n_words = F.when(norm == "  ", F.lit(0)).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "))) - 1).cast("long")
    found = F.when(norm.rlike(gate), let(F.split(F.trim(norm), " "), lambda words: _scanned(words, every)))
    frame = frame.select(*columns, n_words.alias("n_words"), found.alias("_found"))
    base, kept = F.col("_found.base"), F.col("_found.kept")
    starts, names = F.transform(base, lambda x: x["word"].cast("long")), F.transform(base, lambda x: x["label"])
    joined = lambda labels: F.coalesce(F.array_join(F.array_sort(F.array_distinct(labels)), ","), F.lit(""))
    rank = F.array_max(F.transform(kept, lambda x: x["rank"]))
    score = F.lit(0.0)
    for priority, confidence in CONFIDENCE.items():
        score = F.when(rank == priority, confidence).otherwise(score)
    return frame.select(
        *columns,
        "n_words",
        F.coalesce(F.size(F.when(base.isNotNull(), base)), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(names).alias("base_labels"),
        joined(F.concat(names, F.transform(kept, lambda x: x["label"]))).alias("labels"),
        F.transform(kept, lambda x: F.struct(x["word"].alias("word"), x["end"].alias("end"), x["label"].alias("label"))).alias("detections"),
        score.alias("score"),
    )
