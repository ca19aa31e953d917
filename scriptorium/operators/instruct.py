"""Instruction sets: templates, message rows, splits, prompts and answers, rows with retrieved context.

Random choices are numbers from hashes of a seed and the row's key, so any run and any partitioning gives the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ARTICLE, CASE_NUMBER, bucket
from .corpus import kind, shown_kind

# Modes with their shares in hundredths, passages in a context, excerpt lengths.
MODES = [("naked", 40), ("grounded", 30), ("multi", 10), ("refusal", 10), ("contra", 5), ("off_topic", 5)]
MIXES = [("grounded", 85), ("refusal", 10), ("naked", 5)]
PASSAGES_LEAST, PASSAGES_MOST = 3, 6
#: Cells that candidates of distractors are numbered by.
CELLS = 4096
REFUSAL = "Na temelju priloženih izvora ne mogu pouzdano odgovoriti na ovo pitanje. Preporučujem konzultirati izvornu zakonsku odredbu ili nadležni sud."


def message_row(system: Column, question: Column, answer: Column) -> Column:
    parts = (("system", system), ("user", question), ("assistant", answer))
    return F.array(*(F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in parts))


def messages(turns: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """key and messages: its turns (role, text) in order. A conversation is one row, so it fits a task by nature."""
    rows = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(turn, "role", F.col("text").alias("content")))).alias("m"))
    return rows.select(key, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


@dataclass(frozen=True)
class Template:
    """question and answer are format strings over the fields named in `slots`, which must all be there; where `least` is
    given, the last of them must have so many characters."""

    slots: tuple[str, ...]
    question: str
    answer: str
    least: int = 0

    def pair(self, fields: dict[str, Column], pos: int) -> Column:
        ok = F.lit(True)
        for slot in self.slots:
            ok = ok & (F.coalesce(fields[slot], F.lit("")) != "")
        if self.least:
            ok = ok & (F.length(fields[self.slots[-1]]) >= self.least)
        values = [F.trim(fields[slot]) if self.least else fields[slot] for slot in self.slots]
        filled = []
        for text in (self.question, self.answer):
            text = text.replace("%", "%%")
            for number, slot in enumerate(self.slots, 1):
                text = text.replace(f"{{{slot}}}", f"%{number}$s")
            filled.append(F.format_string(text, *values))
        return F.when(ok, F.struct(F.lit(pos).alias("pos"), filled[0].alias("question"), filled[1].alias("answer")))


#: What template_pairs makes of a document, by name and in this order; others are added to it.
TEMPLATES: dict[str, Template] = {
    "court": Template(("case", "court"), "Koji sud je donio odluku u predmetu {case}?", "Predmet {case} donesen je u {court}."),
    "date": Template(("case", "date"), "Kojeg datuma je donesena odluka u predmetu {case}?", "Odluka u predmetu {case} donesena je {date}."),
    "ecli": Template(("case", "ecli"), "Koji je ECLI identifikator predmeta {case}?", "Predmet {case} ima ECLI: {ecli}."),
    "summary": Template(("case", "summary"), "Sažmi kratko predmet {case}.", "{summary}", least=30),
}


def template_pairs(documents: DataFrame, key: str, court: str, case: str, date: str, ecli: str, summary: str, templates: dict[str, Template] | None = None, **more: str) -> DataFrame:
    """key, pos, question, answer: a row for each template whose data is there (a summary of at least 30 characters).
    templates: those of TEMPLATES if none are given; `more` names the columns of further slots."""
    names = {"court": court, "case": case, "date": date, "ecli": ecli, "summary": summary, **more}
    fields = {slot: F.col(column) for slot, column in names.items()}
    pairs = [t.pair(fields, pos) for pos, t in enumerate((TEMPLATES if templates is None else templates).values())]
    return documents.select(key, F.explode(F.array_compact(F.array(*pairs))).alias("p")).select(key, "p.pos", "p.question", "p.answer")


def sane(question: Column, answer: Column) -> Column:
    return (F.length(question) >= 15) & (F.length(answer) >= 30) & (F.lower(question) != F.lower(answer))


def held_out(seed: str, key: Column, share: float = 0.05) -> Column:
    """True for about that share of the keys."""
    return bucket(F.lit(seed), key.cast("string"), of=10_000) < round(share * 10_000)


def sampled(rows: DataFrame, seed: str, key: str, n: int) -> DataFrame:
    """n rows, as a seeded shuffle would have them first."""
    return rows.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def picked(seed: str, key: Column, shares: list[tuple[str, int]]) -> Column:
    """One of the names, by their shares of the sum."""
    number, low = bucket(F.lit(seed), key.cast("string"), of=sum(n for _, n in shares)), 0
    out = None
    for name, n in shares:
        low += n
        out = F.when(number < low, name) if out is None else out.when(number < low, name)
    return out


def framed(style: Column, context: Column, question: Column) -> Column:
    """The prompt in one of six frames, numbered from 0."""
    bullets = F.concat(F.lit("• "), F.replace(context, F.lit("\n\n"), F.lit("\n• ")))
    forms = [
        F.concat(F.lit("--- CONTEXT ---\n"), context, F.lit("\n--- END CONTEXT ---\n\nPitanje: "), question),
        F.concat(F.lit("Kontekst:\n"), context, F.lit("\n\nPitanje: "), question),
        F.concat(F.lit("Izvori:\n"), bullets, F.lit("\n\nPitanje: "), question),
        F.concat(context, F.lit("\n\n"), question),
        F.concat(F.lit("Odgovori na sljedeće pitanje koristeći priložene izvore. Citiraj brojem pasusa u uglatim zagradama:\n\n"), context, F.lit("\n\nPitanje: "), question),
        F.concat(question, F.lit("\n\n(Raspoloživi izvori — pogledaj ih prije odgovora:)\n"), context),
    ]
    return F.get(F.array(*forms), style.cast("int"))


def cited_answer(style: Column, body: Column, cites: Column) -> Column:
    """The answer with its citations in one of four styles, numbered from 0: inline, trailing, explicit, preamble."""
    mark = F.array_join(F.transform(cites, lambda c: F.concat(F.lit("["), c.cast("string"), F.lit("]"))), "")
    bare = F.rtrim(body)
    ends = F.endswith(bare, F.lit("."))
    named = F.array_join(F.transform(cites, lambda c: F.concat(F.lit("izvoru ["), c.cast("string"), F.lit("]"))), " i ")
    forms = [
        F.when(ends, F.concat(F.substring(bare, F.lit(1), F.length(bare) - 1), F.lit(" "), mark, F.lit("."))).otherwise(F.concat(body, F.lit(" "), mark)),
        F.concat(body, F.when(ends, F.lit("")).otherwise(F.lit(".")), F.lit(" "), mark),
        F.concat(F.lit("Prema "), named, F.lit(", "), F.lower(F.substring(body, 1, 1)), F.substring(body, F.lit(2), F.length(body))),
        F.concat(F.lit("Na temelju priloženih izvoda: "), body, F.lit(" "), mark),
    ]
    return F.get(F.array(*forms), style.cast("int"))


def excerpt(text: Column, want: Column | int, question: Column | None = None, before: int = 60) -> Column:
    """`want` characters: from shortly before the identifier that the question names, if the text has it, else from the start."""
    want = F.lit(want) if isinstance(want, int) else want
    at = F.lit(0)
    if question is not None:
        names = [F.nullif(F.regexp_extract(question, p, 0), F.lit("")) for p in (CASE_NUMBER, ARTICLE)]
        at = F.coalesce(F.instr(F.lower(text), F.lower(F.coalesce(*names))), F.lit(0))
    start = F.when(at > 0, F.greatest(at - before, F.lit(1))).otherwise(F.lit(1))
    return F.when(F.length(text) <= want, text).otherwise(F.trim(F.substring(text, start, want)))


def passage(number: Column, source_type: Column, title: Column, author: Column, body: Column) -> Column:
    """A numbered passage with kind, title (120) and author (80)."""
    name = F.substring(F.coalesce(author, F.lit("")), 1, 80)
    head = F.concat(F.lit("["), number.cast("string"), F.lit("] "), shown_kind(kind(source_type, title, author, author_mark="sud")), F.lit(": "), F.substring(F.coalesce(title, F.lit("")), 1, 120))
    return F.concat(head, F.when(name != "", F.concat(F.lit(" · "), name)).otherwise(F.lit("")), F.lit("\n"), body)


def contradicted(text: Column, seed: str, key: Column) -> Column:
    """The first range of years ("2 do 5 godina") with other numbers; unchanged without one."""
    pattern = "(\\d{1,2})\\s*(?:do|-)\\s*(\\d{1,2})\\s*godin"
    whole = F.regexp_extract(text, pattern, 0)
    a, b = (F.regexp_extract(text, pattern, i).cast("int") for i in (1, 2))
    down, up = bucket(F.lit(f"{seed}a"), key.cast("string"), of=3) + 1, bucket(F.lit(f"{seed}b"), key.cast("string"), of=5) + 1
    changed = F.concat(F.greatest(F.lit(1), a - down).cast("string"), F.lit(" do "), (b + up).cast("string"), F.lit(" godin"))
    at = F.instr(text, whole)
    return F.when(whole == "", text).otherwise(F.concat(F.substring(text, F.lit(1), at - 1), changed, F.substring(text, at + F.length(whole), F.length(text))))


def ring_number(*parts: Column) -> Column:
    """A reproducible number from the first fifteen hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def distractors(questions: DataFrame, candidates: DataFrame, n: int, seed: str, key: str = "question_id", source: str = "source_id") -> DataFrame:
    """key, pos (from 0) and source_id: n other sources for each question, or all others where there are fewer.

    Sources stand in a ring in the order of a hash; a question takes those from a place of its own on, without its
    source. A place in the ring is a row's place in its cell, one of CELLS, behind the rows of the cells before; a
    question meets n + 1 places by equality, so none meets all sources.
    """
    ring = candidates.select(F.col(source).alias("other")).where("other is not null").distinct()
    ring = ring.withColumns({"hash": ring_number(F.lit(seed), F.col("other").cast("string"))}).withColumn("cell", F.col("hash") % CELLS)
    # At most CELLS rows.
    before = ring.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).withColumn("before", F.sum("rows").over(Window.orderBy("cell")) - F.col("rows"))
    placed = ring.withColumn("nth", F.row_number().over(Window.partitionBy("cell").orderBy("hash", "other"))).join(F.broadcast(before.select("cell", "before")), "cell")
    placed = placed.select("other", (F.col("before") + F.col("nth") - 1).alias("place"))
    total = ring.count()
    if not total:
        return questions.select(key, F.lit(0).alias("pos"), source).limit(0)
    start = ring_number(F.lit(f"{seed}q"), F.col(key).cast("string")) % total
    asked = questions.select(key, source, start.alias("start")).join(placed.select(F.col("other").alias(source), F.col("place").alias("own")), source, "left")
    skipped = F.pmod(F.col("own") - F.col("start"), F.lit(total))
    steps = F.filter(F.sequence(F.lit(0), F.lit(min(n, total - 1))), lambda i: ~i.eqNullSafe(skipped.cast("int")))
    each = asked.select(key, F.posexplode(F.slice(steps, 1, n)).alias("pos", "step"), "start").withColumn("place", (F.col("start") + F.col("step")) % total)
    return each.join(placed, "place").select(key, "pos", F.col("other").alias(source))


def sibling(chunks: DataFrame, source: str = "source_id", text: str = "text", order: str = "ord") -> DataFrame:
    """source_id, ord and sibling: for each chunk the first other one of its source with another text.

    It is the source's first chunk, or, for chunks that say the same as the first, the first that says something else.
    """
    first = chunks.groupBy(source).agg(F.min(F.struct(order, text)).alias("first"))
    paired = chunks.join(first, source)
    differing = paired.where(F.col(text) != F.col(f"first.{text}")).groupBy(source).agg(F.min(order).alias("second"))
    same = F.col(text) == F.col(f"first.{text}")
    return paired.join(differing, source, "left").select(source, order, F.when(same, F.col("second")).otherwise(F.col(f"first.{order}")).alias("sibling"))


def context_rows(questions: DataFrame, sources: DataFrame, seed: str) -> DataFrame:
    """question_id, mode, user, assistant: questions rewritten over numbered passages.

    questions: question_id, source_id, question, answer. sources: source_id (unique), source_type, title, author, text.
    Modes that need the gold source fall back to a refusal where it is missing; a context takes what distractors there are.
    """
    key = F.col("question_id").cast("string")
    rows = questions.join(sources.select("source_id", F.lit(True).alias("has_gold")), "source_id", "left")
    mode = picked(seed, F.col("question_id"), MODES)
    rows = rows.withColumn("mode", F.when(mode.isin("grounded", "multi", "contra") & F.col("has_gold").isNull(), "refusal").otherwise(mode))
    size = bucket(F.lit(f"{seed}k"), key, of=PASSAGES_MOST - PASSAGES_LEAST + 1) + PASSAGES_LEAST
    gold = F.when(F.col("mode").isin("grounded", "multi"), 1).when(F.col("mode") == "contra", 2).otherwise(0)
    rows = rows.withColumns({"size": size, "gold": gold}).withColumn("slot", F.when(F.col("gold") > 0, bucket(F.lit(f"{seed}s"), key, of=1_000_000) % (F.col("size") - F.col("gold") + 1) + 1))
    others = distractors(rows, sources, PASSAGES_MOST, seed).join(rows.where("mode != 'naked'").select("question_id", "size", "gold", "slot"), "question_id")
    others = others.where(F.col("pos") < F.col("size") - F.col("gold"))
    # The gold passage, and for a contradiction its altered copy, push later distractors back.
    place = F.col("pos") + 1
    others = others.select("question_id", "source_id", F.when(F.col("slot").isNotNull() & (place >= F.col("slot")), place + F.col("gold")).otherwise(place).alias("place"), F.lit(False).alias("altered"))
    own = rows.where("gold > 0").select("question_id", "source_id", F.posexplode(F.sequence(F.lit(1), F.col("gold"))).alias("i", "_"), "slot")
    own = own.select("question_id", "source_id", (F.col("slot") + F.col("i")).alias("place"), (F.col("i") == 1).alias("altered"))
    shown = others.unionByName(own).join(sources, "source_id").join(rows.select("question_id", "question"), "question_id")
    body = F.when(F.col("altered"), contradicted(F.col("text"), seed, F.col("question_id"))).otherwise(F.col("text"))
    shown = shown.withColumn("p", passage(F.col("place"), F.col("source_type"), F.col("title"), F.col("author"), excerpt(body, 500, F.col("question"))))
    contexts = shown.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "p"))), lambda x: x["p"]), "\n\n").alias("context"))
    joined = rows.join(contexts, "question_id", "left")
    style = bucket(F.lit(f"{seed}f"), key, of=6)
    grounded = cited_answer(bucket(F.lit(f"{seed}a"), key, of=4), F.col("answer"), F.array(F.col("slot")))
    differs = F.format_string("Oslanjam se na pasus [%d] kao autoritativni: %s [%d]. Pasus [%d] navodi drugačije brojke.", F.col("slot"), F.col("answer"), F.col("slot"), F.col("slot") + 1)
    reply = (
        F.when(F.col("mode") == "naked", F.col("answer"))
        .when(F.col("mode").isin("grounded", "multi"), grounded)
        .when(F.col("mode") == "contra", differs)
        .when(F.col("mode") == "off_topic", F.concat(F.lit(REFUSAL), F.lit(" Postavljeno pitanje nije povezano s priloženim izvorima.")))
        .otherwise(F.lit(REFUSAL))
    )
    user = F.when(F.col("context").isNull(), F.col("question")).otherwise(framed(style, F.col("context"), F.col("question")))
    return joined.select("question_id", "mode", user.alias("user"), reply.alias("assistant"))


def bucket_rows(questions: DataFrame, sources: DataFrame, seed: str, excerpts: int = PASSAGES_MOST) -> DataFrame:
    """question_id, bucket, slot, user, assistant: questions in three buckets by the shares of MIXES.

    grounded: the gold source at a slot (from 1) among others, the answer as it is. refusal: others alone, and a refusal.
    naked: the question and answer as they are. A grounded question without its source falls back to naked. An excerpt
    looks for what the question names in the gold source alone. questions and sources as in context_rows().
    """
    key = F.col("question_id").cast("string")
    rows = questions.join(sources.select("source_id", F.lit(True).alias("has_gold")), "source_id", "left")
    mix = picked(seed, F.col("question_id"), MIXES)
    rows = rows.withColumn("bucket", F.when((mix == "grounded") & F.col("has_gold").isNull(), "naked").otherwise(mix))
    rows = rows.withColumn("slot", F.when(F.col("bucket") == "grounded", (bucket(F.lit(f"{seed}s"), key, of=excerpts) + 1).cast("int")))
    asked = rows.where("bucket != 'naked'").select("question_id", "slot", "question")
    others = distractors(rows, sources, excerpts, seed).join(asked, "question_id").where(F.col("pos") < excerpts - F.col("slot").isNotNull().cast("int"))
    place = F.col("pos") + 1 + (F.coalesce("slot", F.lit(excerpts + 1)) <= F.col("pos") + 1).cast("int")
    gold = rows.where("slot is not null").select("question_id", "source_id", F.col("slot").alias("place"), "question")
    shown = others.select("question_id", "source_id", place.alias("place"), F.lit(None).cast("string").alias("question")).unionByName(gold).join(sources, "source_id")
    body = F.when(F.col("question").isNull(), excerpt(F.col("text"), 500)).otherwise(excerpt(F.col("text"), 500, F.col("question")))
    shown = shown.withColumn("p", passage(F.col("place"), F.col("source_type"), F.col("title"), F.col("author"), body))
    contexts = shown.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "p"))), lambda x: x["p"]), "\n\n").alias("context"))
    joined = rows.join(contexts, "question_id", "left")
    context = F.coalesce("context", F.lit("(nema dostupnih izvoda)"))
    naked = F.col("bucket") == "naked"
    user = F.when(naked, F.col("question")).otherwise(framed(F.lit(0), context, F.col("question")))
    return joined.select("question_id", "bucket", "slot", user.alias("user"), F.when(F.col("bucket") == "refusal", F.lit(REFUSAL)).otherwise(F.col("answer")).alias("assistant"))
