"""Text functions as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop words of the lexical index.
STOP_WORDS = [
    "i", "u", "na", "je", "su", "se", "da", "sa", "od", "do", "za", "o", "te", "ili", "kao", "ne", "nije", "a", "ako", "bi",
    "s", "k", "pa", "što", "kada", "koji", "koja", "koje", "koju", "kojih",
]

# The token pattern, letters that fold to ASCII, and publication lines that carry no content.
TOKEN = "[a-zčćđšžáéíóú0-9][a-zčćđšžáéíóú0-9\\-/]*"
FOLD_FROM, FOLD_TO = "đĐčČćĆšŠžŽ", "ddccccsszz"
BOILERPLATE_LINES = [
    "upute za korištenje", "elektronička pošta", "početna stranica", "hrvatski sabor", "sabor rh", "narodne novine",
    "natrag na vrh", "uvoz u favorites",
]
BOILERPLATE_START = "(?iu)^(klasa|urbroj|zagreb|predsjednik|proglašavam|na temelju članka 89|odlukom|nn\\s+\\d+/\\d{2,4}|s\\.r\\.|br\\.\\s*\\d+)"

# Identifiers that an answer must ground in its sources. `(?U)` makes \b and \s follow Unicode.
CASE_NUMBER = "(?U)\\b[A-ZŠĐČĆŽ][a-zčćđšž]*-?\\s*\\d+/\\d{2,4}(?:-\\d+)?\\b"
LOOKUP_CASE_NUMBER = "(?U)\\b[A-ZŠĐČĆŽ][a-zčćđšž]*(?:\\s+[A-ZŠĐČĆŽ])?-?\\s*\\d+/\\d{2,4}(?:-\\d+)?\\b"
ARTICLE = "(?iuU)(?:\\bčlan(?:ak|ka|ku|kom)|\\bčl\\.)\\s*\\d+(?:\\.\\s*stav(?:ak|ka)?\\s*\\d+)?"
ECLI = "ECLI:[A-Z0-9:\\-]+"
GAZETTE = "(?U)\\bNN\\s+\\d+/\\d{2,4}\\b"
DATE = "(?U)\\b\\d{4}-\\d{2}-\\d{2}\\b|\\b\\d{1,2}\\.\\s*\\d{1,2}\\.\\s*\\d{4}\\."
PROPER_NOUN = "(?U)\\b[A-ZŠĐČĆŽ][a-zčćđšž]{3,}\\b"
HARD_ENTITIES = [CASE_NUMBER, ARTICLE, ECLI, GAZETTE, DATE]
COMMON_NOUNS = [
    "Prema", "Pasus", "Odgovor", "Priloženi", "Ovdje", "Nije", "Kada", "Ovo", "Ova", "Ovaj", "Ako", "Član", "Pitanje",
    "Priloženim", "Dostupni", "Oslanjam", "Izvori", "Stoga", "Odluka", "Postupku", "Pravnik", "Članak",
]

# Phrases of a refusal, of sentences that claim nothing, and where a model's reply ends.
REFUSALS = [
    "ne mogu odgovoriti", "nije moguće odgovoriti", "ne sadrže", "nisam siguran", "priloženi izvori ne", "dostupni izvodi",
    "nije pokrivena", "nije povezano", "nema odgovora", "preporučujem konzultirati", "u priloženim izvorima nema", "u izvorima nema",
]
NO_CLAIM = "(?iu)(ne mogu odgovoriti|nije moguće odgovoriti|priloženi izvori|dostupni izvodi|nisam siguran|preporučujem|sažetak izvoda)"
STOP_MARKERS = ["--- END CONTEXT ---", "--- CONTEXT ---", "\n---\n", "\nPitanje:", "Pitanje:", "\n[/END]", "<|endoftext|>"]
ABBREVIATIONS = ["čl", "st", "tč", "br", "god", "str", "al", "npr", "tzv"]


#: White space of any script, with the four separators that Java's class leaves out.
SPACE = "(?U)[\\s\\x1c-\\x1f]+"
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def collapsed(text: Column) -> Column:
    """Runs of white space of any script as one space, trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def _pairs() -> tuple[dict[str, str], dict[str, list[str]]]:
    """Small letters with one combining mark that have a composed form: those that tokens are made of, to that form; for
    the other letters their marks."""
    kept, other = {}, {}
    for letter in "abcdefghijklmnopqrstuvwxyz":
        for mark in map(chr, range(0x300, 0x370)):
            one = unicodedata.normalize("NFC", letter + mark)
            if len(one) == 1 and re.fullmatch(TOKEN, one):
                kept[letter + mark] = one
            elif len(one) == 1:
                other.setdefault(letter, []).append(mark)
    return kept, other


def composed(low: Column) -> Column:
    """A lower-case text whose decomposed letters are as tokens see them: composed if tokens have them, else no token's."""
    kept, other = _pairs()
    out = low
    for pair, one in kept.items():
        out = F.replace(out, F.lit(pair), F.lit(one))
    foreign = "|".join(f"{letter}[{''.join(marks)}]" for letter, marks in other.items())
    return F.when(low.rlike("[\u0300-\u036f]"), F.regexp_replace(out, foreign, "\u00f1")).otherwise(low)


def normalized(text: Column) -> Column:
    """NFC, lower case, white space collapsed. Only NFC of texts with more than ASCII needs Python."""

    @F.pandas_udf("string")
    def nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))

    return collapsed(F.lower(nfc(text)))


def token_list(text: Column) -> Column:
    """The tokens of the lexical index: of more than one character, without stop words; letters may be decomposed."""
    found = F.regexp_extract_all(composed(F.lower(text)), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slug(text: Column) -> Column:
    out = F.trim(F.lower(F.translate(text, FOLD_FROM, FOLD_TO)))
    for pattern, to in (("[^a-z0-9\\s-]", ""), (SPACE, "-"), ("-+", "-"), ("^-|-$", "")):
        out = F.regexp_replace(out, pattern, to)
    return out


def xml_escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def without_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", " ")


def plain(text: Column, most: int = 300) -> Column:
    """Tags and extra white space away; an ellipsis where it was cut."""
    flat = collapsed(without_tags(F.coalesce(text, F.lit(""))))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def rfc2822(moment: Column) -> Column:
    return F.date_format(moment, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def clean_space(text: Column) -> Column:
    """Blanks and tabs as one space, at most one blank line, trimmed."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, "[ \\t]+", " "), "\\n{3,}", "\n\n"), F.lit(" \n\t\r"))


def without_boilerplate(text: Column) -> Column:
    """Lines of publication data go: known lines, known starts, page numbers, Roman numerals. Never leaves nothing."""

    def kept(line: Column) -> Column:
        s = F.btrim(line, F.lit(" \t\r\f\v"))
        drop = F.lower(s).isin(BOILERPLATE_LINES) | s.rlike(BOILERPLATE_START) | s.rlike("^\\d{1,6}\\.?$") | s.rlike("^[IVX]{1,5}\\.?$")
        return (s == "") | ~drop

    def line_of(line: Column) -> Column:
        return F.when(F.btrim(line, F.lit(" \t\r\f\v")) == "", F.lit("")).otherwise(line)

    lines = F.transform(F.filter(F.split(text, "\n"), kept), line_of)
    body = F.btrim(F.regexp_replace(F.array_join(lines, "\n"), "\\n{3,}", "\n\n"), F.lit(" \n\t\r\f\v"))
    return F.coalesce(F.nullif(body, F.lit("")), text)


def entities(text: Column, patterns: list[str], *, nouns: bool = False) -> Column:
    """Distinct trimmed matches of the patterns, and capitalised words that are not common ones."""
    found = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda m: F.trim(m)) for p in patterns]
    if nouns:
        found.append(F.array_except(F.regexp_extract_all(text, F.lit(PROPER_NOUN), F.lit(0)), F.array(*map(F.lit, COMMON_NOUNS))))
    return F.array_distinct(F.flatten(F.array(*found)))


def citations(text: Column) -> Column:
    """The numbers N of [N], in order."""
    return F.transform(F.regexp_extract_all(text, F.lit("\\[(\\d{1,9})\\]"), F.lit(1)), lambda n: n.cast("int"))


def is_refusal(text: Column) -> Column:
    low = F.lower(text)
    return F.exists(F.array(*map(F.lit, REFUSALS)), lambda p: F.contains(low, p))


def is_claim(sentence: Column) -> Column:
    return (F.length(sentence) >= 15) & ~sentence.rlike(NO_CLAIM)


def until_marker(text: Column) -> Column:
    """Cut at the first of the stop markers, trimmed."""
    for marker in STOP_MARKERS:
        text = F.substring_index(text, marker, 1)
    return F.btrim(text, F.lit(" \n\t\r"))


def verdict(reply: Column, *, legacy: bool = False) -> Column:
    """The verdict that a judge's reply names. The longest name is tried first, as one contains another;
    legacy tries the shorter first, so that UNSUPPORTED is never found."""
    order = ["SUPPORTED", "PARTIAL", "UNSUPPORTED", "NEUTRAL"] if legacy else ["UNSUPPORTED", "SUPPORTED", "PARTIAL", "NEUTRAL"]
    upper = F.upper(reply)
    return F.coalesce(*(F.when(F.contains(upper, F.lit(v)), F.lit(v)) for v in order), F.lit("PARSE_ERROR"))


def sentences(text: Column) -> Column:
    """Split after . ! ? before a capital, digit or bracket, but not at a blank after common abbreviations; stripped, without
    blank ones. White space and what bounds a word are of any script."""
    abbreviated = f"(?<![\\p{{L}}\\p{{N}}_])(?:{'|'.join(ABBREVIATIONS)})\\."
    parts = F.split(text, f"(?<=[.!?])(?:(?<!{abbreviated})|(?! )){SPACE}(?=[A-ZŠĐČĆŽ0-9\\[])")
    return F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit(WHITE))), lambda p: p != "")


def json_items(text: Column, schema: str) -> Column:
    """The rows of the JSON array in a model's reply; null where there is none."""
    return F.from_json(F.nullif(F.regexp_extract(text, "(?s)\\[\\s*\\{.*\\}\\s*\\]", 0), F.lit("")), f"array<struct<{schema}>>")


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the folded words, each padded by two blanks before and one after."""
    folded = F.concat(F.lit("  "), collapsed(F.regexp_replace(F.lower(F.translate(text, FOLD_FROM, FOLD_TO)), "[^a-z0-9]+", " ")), F.lit(" "))
    each = lambda t: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3))))
    return let(folded, lambda t: F.when(F.length(t) < 4, F.array().cast("array<string>")).otherwise(each(t)))


def jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(both / either)


def bucket(*parts: Column, of: int) -> Column:
    """A reproducible number from 0 to of - 1: the first seven hex digits of an md5, modulo."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 7), 16, 10).cast("long") % of
