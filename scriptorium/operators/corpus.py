"""Corpus rows: headers, titles, kinds, normal form, precedence between sources, resuming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The least length that each stage takes, and where titles are cut.
CHUNK_LEAST, TITLE_MOST = 120, 400


def header(lines: dict[str, Column], body: Column) -> Column:
    """`label: value` for each value that is there, then a blank line and the body."""
    shown = F.concat_ws("\n", *(F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{label}: "), v)) for label, v in lines.items()))
    return F.when(shown != "", F.concat(shown, F.lit("\n\n"), body)).otherwise(body)


def title_or(title: Column, court: Column, case: Column, other: Column) -> Column:
    """The title; else court and case, where both are there; else another name."""
    filled = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(filled(title), F.concat(filled(court), F.lit(" — "), filled(case)), other)


def kind(source_type: Column, title: Column, author: Column, *, author_mark: str = "court") -> Column:
    """legislation, decision, commentary or other, in that precedence."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    law = F.contains(low(source_type), F.lit("legislation")) | F.contains(low(title), F.lit("zakon"))
    ruling = F.contains(low(source_type), F.lit("decision")) | F.contains(low(author), F.lit(author_mark))
    return F.when(law, "legislation").when(ruling, "decision").when(F.contains(low(source_type), F.lit("commentary")), "commentary").otherwise("other")


def shown_kind(of: Column) -> Column:
    return F.when(of == "legislation", "PROPIS").when(of == "decision", "SUDSKA ODLUKA").when(of == "commentary", "KOMENTAR").otherwise("IZVOR")


def area_type(area: Column, source_type: Column) -> Column:
    return F.when(F.coalesce(area, F.lit("")) != "", F.concat_ws(".", area, source_type)).otherwise(source_type)


def normal_chunks(rows: DataFrame) -> DataFrame:
    """Rows of source_id, source_type, source, title, text, url, author, chunk_index, year as chunks; short or nameless ones go."""
    text = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \n\t\r"))
    rows = rows.withColumn("text", text).where((F.length("text") >= CHUNK_LEAST) & F.col("source_id").isNotNull() & (F.col("source_id").cast("string") != ""))
    name = F.col("source_id").cast("string")
    return rows.select(
        F.when(F.col("chunk_index").isNotNull(), F.concat(name, F.lit(":"), F.col("chunk_index").cast("string"))).otherwise(name).alias("chunk_id"),
        name.alias("source_id"),
        kind(F.col("source_type"), F.col("title"), F.col("source")).alias("kind"),
        F.substring(F.coalesce("title", F.lit("")), 1, TITLE_MOST).alias("title"),
        "text",
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("author", F.lit("")).alias("author"),
        "year",
    )


def first_of(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key by a total order; each task keeps one row of a key before the shuffle."""
    columns = [c for c in rows.columns if c not in keys]
    place = F.struct(*(F.expr(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)))
    kept = rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), place).alias("_row"))
    return kept.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in columns)).select(*rows.columns)


def by_precedence(sources: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Rows of all sources in one schema; of a key the row of the earliest source stays."""
    tagged = [s.withColumn("_rank", F.lit(i)) for i, s in enumerate(sources)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return first_of(union, keys, ["_rank", *order]).drop("_rank")


def longest(rows: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """key, n (its longest text's length) and first_order of it: the first of equally long ones."""
    best = rows.groupBy(key).agg(F.max(F.struct(F.length(text).alias("n"), (-F.col(order)).alias("back"))).alias("b"))
    return best.select(key, F.col("b.n").cast("long").alias("n"), (-F.col("b.back")).alias("first_order"))


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been written yet; null keys are never done."""
    return rows.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def first_n(rows: DataFrame, group: list[str], order: list[str | Column], n: int) -> DataFrame:
    """At most n rows of each group."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
