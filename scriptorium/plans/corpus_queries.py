"""Queries of corpus building: scans, cleaning, chunks, precedence, instruction sets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking, corpus, instruct
from ..sources import tables
from ..sources.hooks import Collection
from ..sources.keyed import KeyedTable
from ..sources.scratch import folder
from .common import query, sql_bucket, sql_collapsed, sql_fold, sql_stripped, sql_tokens, table


@query("scan_laws", "select doc_id, cast(length(text) as bigint) as n from documents where text is not null and length(text) >= 400")
def scan_laws(spark: SparkSession, d: str) -> DataFrame:
    return tables.long_texts(table(spark, d, "documents"), "text").select("doc_id", F.length("text").cast("long").alias("n"))


@query(
    "scan_decisions",
    """select doc_id, text_lang, court_name from (
         select doc_id, d.lang as text_lang, c.court_name from documents d
         left join (select distinct source, upper(source) as court_name from documents where source <> 'src3') c on d.source = c.source
         where d.text is not null and length(d.text) >= 400)""",
)
def scan_decisions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    courts = docs.where("source != 'src3'").select("source").distinct().withColumn("court_name", F.upper("source"))
    return tables.long_texts(docs, "text").join(courts, "source", "left").select("doc_id", F.col("lang").alias("text_lang"), "court_name")


@query("filter_sources", "select source, cast(count(*) as bigint) as n from documents where source in ('src1', 'src4', 'src7') group by source")
def filter_sources(spark: SparkSession, d: str) -> DataFrame:
    return tables.of_sources(table(spark, d, "documents"), ["src1", "src4", "src7"]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("discover_ids", "select distinct p_type as id from part where starts_with(p_type, 'ST') and length(p_type) >= 5 union select distinct p_brand from part where starts_with(p_brand, 'Brand#1') and length(p_brand) >= 8")
def discover_ids(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    pick = lambda c, start, n: part.where(F.startswith(c, F.lit(start)) & (F.length(c) >= n)).select(F.col(c).alias("id"))
    return pick("p_type", "ST", 5).union(pick("p_brand", "Brand#1", 8)).distinct()


@query("url_ids", "select page_id, url, substr(sha1(url), 1, 16) as source_id, md5(html) as digest from pages where length(html) >= 500")
def url_ids(spark: SparkSession, d: str) -> DataFrame:
    pages = tables.long_texts(table(spark, d, "pages"), "html", 500)
    return pages.select("page_id", "url", tables.url_id(F.col("url")).alias("source_id"), F.md5("html").alias("digest"))


@query("link_extract", """select page_id, href from (select page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) as href from pages)""")
def link_extract(spark: SparkSession, d: str) -> DataFrame:
    return tables.links(table(spark, d, "pages"), "page_id", "html")


@query(
    "capped_per_year",
    """select yr, cast(o_orderkey as bigint) as o_orderkey from (
         select year(o_orderdate) as yr, o_orderkey, row_number() over (partition by year(o_orderdate) order by o_orderkey) as n from orders) where n <= 25""",
)
def capped_per_year(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("yr"), F.col("o_orderkey").cast("long"))
    return corpus.first_n(orders, ["yr"], ["o_orderkey"], 25)


@query("html_extract")
def html_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tables.html_title(F.col("html")).alias("title"), tables.html_text(F.col("html")).alias("text"))


@query("ocr_route", "select doc_id, (length(text) = 0 or length(text) < 100 * (doc_id % 40)) as ocr from documents")
def ocr_route(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tables.needs_ocr(F.col("text"), F.col("doc_id") % 40).alias("ocr"))


@query(
    "header_lines",
    """select doc_id, 'Jezik: ' || lang || case when doc_id % 3 = 0 then '' else chr(10) || 'Izvor: ' || source end || chr(10) || chr(10) || text as body,
              case when doc_id % 3 = 0 then 'x' || doc_id else source || ' — ' || doc_id end as title from documents""",
)
def header_lines(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("court", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")))
    name = F.col("doc_id").cast("string")
    return docs.select(
        "doc_id",
        corpus.header({"Jezik": F.col("lang"), "Izvor": F.col("court")}, F.col("text")).alias("body"),
        corpus.title_or(F.lit(""), F.col("court"), name, F.concat(F.lit("x"), name)).alias("title"),
    )


SOURCE_TYPE = "case doc_id % 4 when 0 then 'eu.legislation' when 1 then 'court_decision' when 2 then 'commentary' else 'web' end"


@query(
    "kind_classify",
    f"""select case when contains(st, 'legislation') or contains(lower(text), 'zakon') then 'legislation'
                    when contains(st, 'decision') or contains(lower(source), 'src1') then 'decision'
                    when contains(st, 'commentary') then 'commentary' else 'other' end as kind,
               cast(count(*) as bigint) as n
        from (select *, {SOURCE_TYPE} as st from documents) group by 1""",
)
def kind_classify(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("st", F.expr(SOURCE_TYPE))
    kind = corpus.kind(F.col("st"), F.col("text"), F.col("source"), author_mark="src1")
    return docs.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("area_types", "select doc_id, case when doc_id % 5 = 0 then source else lang || '.' || source end as qualified from documents")
def area_types(spark: SparkSession, d: str) -> DataFrame:
    area = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.col("lang"))
    return table(spark, d, "documents").select("doc_id", corpus.area_type(area, F.col("source")).alias("qualified"))


@query(
    "normalize_chunks",
    f"""select doc_id || ':' || (doc_id % 7) as chunk_id, cast(doc_id as varchar) as source_id,
               case when {SOURCE_TYPE} = 'eu.legislation' then 'legislation' when {SOURCE_TYPE} = 'court_decision' or contains(source, 'court') then 'decision'
                    when {SOURCE_TYPE} = 'commentary' then 'commentary' else 'other' end as kind,
               substr(text, 1, 400) as title, cast(length(trim(text, ' ' || chr(10) || chr(9) || chr(13))) as bigint) as n, '' as url, lang as author, cast(null as integer) as year
        from documents where length(trim(text, ' ' || chr(10) || chr(9) || chr(13))) >= 120 and not contains(lower(text), 'zakon')""",
)
def normalize_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(~F.contains(F.lower("text"), F.lit("zakon")))
    rows = docs.select(
        F.col("doc_id").alias("source_id"), F.expr(SOURCE_TYPE).alias("source_type"), "source", F.col("text").alias("title"), "text",
        F.lit(None).cast("string").alias("url"), F.col("lang").alias("author"), (F.col("doc_id") % 7).alias("chunk_index"), F.lit(None).cast("int").alias("year"),
    )
    return corpus.normal_chunks(rows).withColumn("n", F.length("text").cast("long")).drop("text")


@query(
    "dedupe_first",
    "select cast(min(doc_id) as bigint) as doc_id, cast(count(*) as bigint) as copies from documents group by text",
)
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("key"))
    copies = docs.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    return corpus.first_of(docs, ["key"], ["doc_id"]).join(copies, "key").select("doc_id", "copies")


@query(
    "source_precedence",
    """select key, origin, n from (
         select *, row_number() over (partition by key order by rank, n) as r from (
           select cast(doc_id as bigint) as key, 'chunks' as origin, 1 as rank, cast(length(text) as bigint) as n from documents where doc_id % 2 = 0
           union all select cast(page_id as bigint), 'pages', 0, cast(length(url) as bigint) from pages
           union all select cast(item_id as bigint), 'items', 2, cast(length(text) as bigint) from benchmark)) where r = 1""",
)
def source_precedence(spark: SparkSession, d: str) -> DataFrame:
    part = lambda name, key, text, origin: table(spark, d, name).select(F.col(key).cast("long").alias("key"), F.lit(origin).alias("origin"), F.length(text).cast("long").alias("n"))
    chunks = part("documents", "doc_id", "text", "chunks").where("key % 2 = 0")
    return corpus.by_precedence([part("pages", "page_id", "url", "pages"), chunks, part("benchmark", "item_id", "text", "items")], ["key"], ["n"])


@query(
    "longest_chunk",
    """select source, cast(length(text) as bigint) as n, cast(doc_id as bigint) as first_order from (
         select *, row_number() over (partition by source order by length(text) desc, doc_id) as r from documents) where r = 1""",
)
def longest_chunk(spark: SparkSession, d: str) -> DataFrame:
    return corpus.longest(table(spark, d, "documents"), "source", "text", "doc_id")


@query("resume_antijoin", "select doc_id from documents where doc_id not in (select doc_id from labels)")
def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    return corpus.not_done(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("metadata_join", "select d.doc_id, l.quality from documents d join labels l on d.doc_id = l.doc_id")
def metadata_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")


TRIM = "trim({}, ' ' || chr(10) || chr(9) || chr(13))"


CLEANED = "regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"


@query("clean_text", f"select doc_id, md5({TRIM.format(CLEANED)}) as digest from documents")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(X.clean_space(F.col("text"))).alias("digest"))


@query("normalize_text", f"select doc_id, md5({sql_collapsed('lower(text)')}) as digest from documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(X.normalized(F.col("text"))).alias("digest"))


#: The boilerplate rules as DuckDB states them; white space at a line's ends is ASCII here.
LINE = "trim(l, ' ' || chr(9) || chr(13) || chr(12) || chr(11))"
KNOWN_LINES = ", ".join(f"'{x}'" for x in X.BOILERPLATE_LINES)
KEPT_LINE = f"""({LINE} = '' or not (list_contains([{KNOWN_LINES}], lower({LINE})) or regexp_matches({LINE}, '(?i)^(klasa|urbroj|zagreb|predsjednik|proglašavam|na temelju članka 89|odlukom|nn\\s+\\d+/\\d{{2,4}}|s\\.r\\.|br\\.\\s*\\d+)')
    or regexp_matches({LINE}, '^\\d{{1,6}}\\.?$') or regexp_matches({LINE}, '^[IVX]{{1,5}}\\.?$')))"""


@query(
    "strip_boilerplate",
    f"""select doc_id, case when body = '' then whole else body end as text from (
          select doc_id, whole, trim(regexp_replace(array_to_string(list_transform(list_filter(string_split(whole, chr(10)), lambda l: {KEPT_LINE}), lambda l: case when {LINE} = '' then '' else l end), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'),
                                     ' ' || chr(10) || chr(9) || chr(13) || chr(12) || chr(11)) as body
          from (select doc_id, 'Narodne novine' || chr(10) || '12' || chr(10) || 'IV.' || chr(10) || 'KLASA: 1' || chr(10) || chr(10) || chr(10) || chr(10) || text as whole from documents))""",
)
def strip_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    lines = F.concat(F.lit("Narodne novine\n12\nIV.\nKLASA: 1\n\n\n\n"), F.col("text"))
    return table(spark, d, "documents").select("doc_id", X.without_boilerplate(lines).alias("text"))


@query(
    "slugify",
    f"""select p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(lower({sql_fold("p_name || ' Šđ Ž-' || p_brand || ' -'")})), '[^a-z0-9\\s-]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') as slug from part""",
)
def slugify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.slug(F.concat("p_name", F.lit(" Šđ Ž-"), "p_brand", F.lit(" -"))).alias("slug"))


DECOMPOSED = "'c' || chr(780) || 'lanak' || chr(160) || 'kuc' || chr(769) || 'a' || chr(8195) || 'S' || chr(780) || 'uma mn' || chr(771) || 'ogo de' || chr(769) || 'ja' || chr(160) || text"


@query("token_forms", f"select doc_id, md5(array_to_string({sql_tokens(DECOMPOSED)}, ' ')) as tokens, md5({sql_collapsed(f'lower(nfc_normalize({DECOMPOSED}))')}) as normal from documents")
def token_forms(spark: SparkSession, d: str) -> DataFrame:
    """Letters in decomposed form, white space that is not ASCII."""
    text = F.concat(F.lit("c\u030clanak\u00a0kuc\u0301a\u2003S\u030cuma mn\u0303ogo de\u0301ja\u00a0"), "text")
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(X.token_list(text), " ")).alias("tokens"), F.md5(X.normalized(text)).alias("normal"))


@query(
    "token_stats",
    f"select lang, cast(count(*) as bigint) as n, cast(count(distinct t) as bigint) as n_distinct from (select lang, unnest({sql_tokens('text')}) as t from documents) group by lang",
)
def token_stats(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "documents").select("lang", F.explode(X.token_list(F.col("text"))).alias("t")).groupBy("lang", "t").agg(F.count(F.lit(1)).alias("n"))
    return tokens.groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_distinct"))


@query("escape_xml", "select page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) as digest from pages")
def escape_xml(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(X.xml_escaped(F.col("html"))).alias("digest"))


#: Of texts with blank lines the pieces' ends are found a piece at a time: at the last blank line, if beyond half, else
#: after 2,000 characters.
CHUNKED = f"""
    with recursive texts as materialized (
      select row_number() over () as r, doc_id, text, length(text) as n, contains(text, chr(10) || chr(10)) as broken from documents where text is not null
    ), long as materialized (
      select * from texts where n > 2000 and broken
    ), found(r, i, start_at, end_at) as (
      select r, cast(-1 as bigint), cast(0 as bigint), cast(200 as bigint) from long
      union all
      select r, i + 1, next, case when next + 2000 < n and blank > 1000 then next + blank else least(n, next + 2000) end from (
        select s.r, s.i, s.end_at - 200 as next, t.n, length(regexp_extract(substr(t.text, s.end_at - 199, 2000), '(?s)^(.*)\\n\\n', 1)) as blank
        from found s join long t on s.r = t.r where s.end_at < t.n)
    ), spans as (
      select r, i, start_at, end_at from found where i >= 0
      union all
      select r, start_at // 1800, start_at, least(n, start_at + 2000) from (
        select r, n, unnest(generate_series(0, greatest(0, n - 201), 1800)) as start_at from texts where n > 2000 and not broken)
    ), cut as (
      select s.r, doc_id, i, {sql_stripped('substr(text, start_at + 1, end_at - start_at)')} as chunk from spans s join texts t on s.r = t.r
    ), kept as (
      select doc_id, row_number() over (partition by r order by i) - 1 as chunk_index, count(*) over (partition by r) as chunk_count, chunk from (
        select * from cut where length(chunk) >= 200
        union all select r, doc_id, 0, text from texts where n <= 2000 and {sql_stripped('text')} <> '')
    )
"""


@query("chunk_fixed", CHUNKED + "select doc_id, cast(chunk_index as bigint) as chunk_index, cast(chunk_count as bigint) as chunk_count, md5(chunk) as digest from kept")
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    return chunking.fixed_chunks(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "chunk_index", "chunk_count", F.md5("chunk").alias("digest"))


@query("chunk_stats", CHUNKED + "select cast(count(*) as bigint) as chunks, cast(max(chunk_count) as bigint) as most, cast(sum(length(chunk)) as bigint) as chars from kept")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    chunks = chunking.fixed_chunks(table(spark, d, "documents").select("doc_id", "text"))
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.max("chunk_count").alias("most"), F.sum(F.length("chunk")).alias("chars"))


@query(
    "chunk_paragraphs",
    """with recursive p as (select doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) as ps from documents),
       f(doc_id, i, held, size, chunk) as (
         select doc_id, 0, cast([] as varchar[]), cast(0 as bigint), cast(null as varchar) from p
         union all
         select doc_id, i + 1, case when flush then [x] else list_append(held, x) end, case when flush then length(x) else size + length(x) + 2 end, case when flush then array_to_string(held, chr(10) || chr(10)) end
         from (select f.doc_id, f.i, f.held, f.size, p.ps[f.i + 1] as x, f.size + length(p.ps[f.i + 1]) > 3500 and f.size >= 500 as flush from f join p on f.doc_id = p.doc_id where f.i < len(p.ps))),
       c as (select doc_id, i, chunk from f where chunk is not null union all select f.doc_id, f.i + 1, array_to_string(f.held, chr(10) || chr(10)) from f join p on f.doc_id = p.doc_id where f.i = len(p.ps)),
       kept as (select * from c where length(chunk) >= 500)
       select doc_id, cast(count(*) over (partition by doc_id) as bigint) as chunk_count, cast(row_number() over (partition by doc_id order by i) - 1 as bigint) as chunk_index, chunk from kept""",
)
def chunk_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return chunking.paragraph_chunks(table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))).drop("text")


#: Two articles of each text: the second's heading ends the first, which is long where the text is.
ENDS = "' ' || chr(10) || chr(9) || chr(13)"


ARTICLES = f"""with recursive a as (
          select doc_id, 1 as n, '1' as number, 'Članak 1.' || chr(10) as header, trim('Članak 1.' || chr(10) || text || chr(10) || chr(10) || 'Naslov drugi', {ENDS}) as body from documents
          union all select doc_id, 2, '2a', '', trim('Naslov drugi' || chr(10) || 'Članak 2a.' || chr(10) || text, {ENDS}) from documents),
        parts(doc_id, n, i, number, header, rest, chunk) as (
          select doc_id, n, 0, number, header, body, cast(null as varchar) from a where length(body) >= 180
          union all
          select doc_id, n, i + 1, number, header, header || ltrim(substr(rest, cut + 1), {ENDS}), rtrim(substr(rest, 1, cut), {ENDS}) from (
            select *, case when gap > 0 and 3500 - gap - 1 >= 1750 then 3500 - gap - 1 else 3500 end as cut from (
              select *, instr(reverse(substr(rest, 1, 3500)), chr(10) || chr(10)) as gap from parts where length(rest) > 3500))),
        c as (select doc_id, n, i, number, chunk from parts where chunk is not null union all select doc_id, n, i + 1, number, trim(rest, {ENDS}) from parts where length(rest) <= 3500 and trim(rest, {ENDS}) <> '')"""


@query(
    "chunk_articles",
    ARTICLES
    + """select doc_id, cast(count(*) over (partition by doc_id) as bigint) as chunk_count, cast(row_number() over (partition by doc_id order by n, i) - 1 as bigint) as chunk_index, number as article_number, chunk from c""",
)
def chunk_articles(spark: SparkSession, d: str) -> DataFrame:
    return numbered_chunks(spark, d).drop("text")


def numbered_chunks(spark: SparkSession, d: str) -> DataFrame:
    numbered = F.concat(F.lit("Uvod\n\nČlanak 1.\n"), F.col("text"), F.lit("\n\nNaslov drugi\nČlanak 2a.\n"), F.col("text"))
    return chunking.article_chunks(table(spark, d, "documents").select("doc_id", numbered.alias("text")))


@query("sft_messages", "select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) as said, cast(count(*) as bigint) as n from conversations group by conv_id")
def sft_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = instruct.messages(table(spark, d, "conversations"))
    return rows.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("said"), F.size("messages").cast("long").alias("n"))


@query(
    "instruct_templates",
    """with d as (select doc_id, source as court, case when doc_id % 4 = 0 then '' else 'P-' || doc_id || '/2020' end as c, case when doc_id % 3 = 0 then '2020-01-01' end as dt, trim(text) as s from documents)
       select doc_id, 0 as pos, 'Koji sud je donio odluku u predmetu ' || c || '?' as question, 'Predmet ' || c || ' donesen je u ' || court || '.' as answer from d where c <> ''
       union all select doc_id, 1, 'Kojeg datuma je donesena odluka u predmetu ' || c || '?', 'Odluka u predmetu ' || c || ' donesena je ' || dt || '.' from d where c <> '' and dt is not null
       union all select doc_id, 3, 'Sažmi kratko predmet ' || c || '.', s from d where c <> '' and length(s) >= 30""",
)
def instruct_templates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(
        "doc_id", F.col("source").alias("court"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.format_string("P-%d/2020", "doc_id")).alias("c"),
        F.when(F.col("doc_id") % 3 == 0, "2020-01-01").alias("dt"), F.lit("").alias("e"), F.trim("text").alias("s"),
    )
    return instruct.template_pairs(docs, "doc_id", "court", "c", "dt", "e", "s")


PAIRS = """select u.conv_id, u.turn, u.text as q, a.text as a from conversations u join conversations a on u.conv_id = a.conv_id and a.turn = u.turn + 1 and u.role = 'user' and a.role = 'assistant'"""


@query("qa_filter", f"select conv_id, turn from ({PAIRS}) where length(q) >= 15 and length(a) >= 30 and lower(q) <> lower(a)")
def qa_filter(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).where(instruct.sane(F.col("q"), F.col("a"))).select("conv_id", "turn")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    u = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q"))
    a = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("a"))
    return u.join(a, ["conv_id", "turn"])


@query("split_holdout", f"select doc_id, {sql_bucket(chr(39) + 'split|' + chr(39) + ' || doc_id', 10000)} < 500 as held_out from documents")
def split_holdout(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", instruct.held_out("split", F.col("doc_id")).alias("held_out"))


@query("seeded_sample", "select doc_id from documents order by md5('seed' || doc_id), doc_id limit 50")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return instruct.sampled(table(spark, d, "documents").select("doc_id"), "seed", "doc_id", 50)


def _picked(seed: str, shares: list[tuple[str, int]]) -> str:
    low, cases, number = 0, "", sql_bucket(f"'{seed}|' || doc_id", sum(n for _, n in shares))
    for name, n in shares:
        low += n
        cases += f" when {number} < {low} then '{name}'"
    return f"case{cases} end"


@query("mode_assign", f"select {_picked('modes', instruct.MODES)} as mode, {_picked('mixes', instruct.MIXES)} as mix, cast(count(*) as bigint) as n from documents group by 1, 2")
def mode_assign(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(instruct.picked("modes", F.col("doc_id"), instruct.MODES).alias("mode"), instruct.picked("mixes", F.col("doc_id"), instruct.MIXES).alias("mix"))
    return docs.groupBy("mode", "mix").agg(F.count(F.lit(1)).alias("n"))


@query(
    "source_sibling",
    """with f as (select source, min(doc_id) as first from documents group by source),
            t as (select f.source, f.first, d.text from f join documents d on d.doc_id = f.first),
            s as (select d.source, min(d.doc_id) as second from documents d join t on d.source = t.source where d.text <> t.text group by d.source)
       select d.doc_id, d.source, case when d.text = t.text then s.second else t.first end as sibling from documents d join t on d.source = t.source left join s on d.source = s.source""",
)
def source_sibling(spark: SparkSession, d: str) -> DataFrame:
    return instruct.sibling(table(spark, d, "documents").select("source", "doc_id", "text"), "source", "text", "doc_id").select("doc_id", "source", "sibling")


@query(
    "cited_answers",
    """select doc_id, case doc_id % 4 when 0 then case when b like '%.' then substr(b, 1, length(b) - 1) || ' [1][2].' else b || ' [1][2]' end
              when 1 then b || case when b like '%.' then '' else '.' end || ' [1][2]'
              when 2 then 'Prema izvoru [1] i izvoru [2], ' || lower(substr(b, 1, 1)) || substr(b, 2) else 'Na temelju priloženih izvoda: ' || b || ' [1][2]' end as answer from (select doc_id, rtrim(text) as b from documents)""",
)
def cited_answers(spark: SparkSession, d: str) -> DataFrame:
    body = F.rtrim("text")
    return table(spark, d, "documents").select("doc_id", instruct.cited_answer(F.col("doc_id") % 4, body, F.array(F.lit(1), F.lit(2))).alias("answer"))


@query(
    "prompt_frames",
    """select item_id, case item_id % 6 when 0 then '--- CONTEXT ---' || n || c || n || '--- END CONTEXT ---' || n || n || 'Pitanje: Što?' when 1 then 'Kontekst:' || n || c || n || n || 'Pitanje: Što?'
              when 2 then 'Izvori:' || n || '• ' || text || n || '• ' || text || n || n || 'Pitanje: Što?' when 3 then c || n || n || 'Što?'
              when 4 then 'Odgovori na sljedeće pitanje koristeći priložene izvore. Citiraj brojem pasusa u uglatim zagradama:' || n || n || c || n || n || 'Pitanje: Što?'
              else 'Što?' || n || n || '(Raspoloživi izvori — pogledaj ih prije odgovora:)' || n || c end as prompt
       from (select item_id, chr(10) as n, text, text || chr(10) || chr(10) || text as c from benchmark)""",
)
def prompt_frames(spark: SparkSession, d: str) -> DataFrame:
    context = F.concat("text", F.lit("\n\n"), "text")
    return table(spark, d, "benchmark").select("item_id", instruct.framed(F.col("item_id") % 6, context, F.lit("Što?")).alias("prompt"))


@query("excerpts", "select doc_id, case when length(t) <= 300 then t when instr(lower(t), 'p-17/2020') > 0 then trim(substr(t, greatest(instr(lower(t), 'p-17/2020') - 60, 1), 300)) else trim(substr(t, 1, 300)) end as excerpt from (select doc_id, case when doc_id % 2 = 0 then substr(text, 1, 400) || ' P-17/2020 ' || substr(text, 401) else text end as t from documents)")
def excerpts(spark: SparkSession, d: str) -> DataFrame:
    named = F.concat(F.substring("text", 1, 400), F.lit(" P-17/2020 "), F.substring(F.col("text"), F.lit(401), F.length("text")))
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, named).otherwise(F.col("text")).alias("t"))
    return docs.select("doc_id", instruct.excerpt(F.col("t"), 300, F.lit("Što kaže P-17/2020 o tome?")).alias("excerpt"))


def _altered(seed: str) -> str:
    """"a do b godin" of the text's first range of years, with a lower and b higher."""
    down, up = (sql_bucket(f"'{seed}{x}|' || doc_id", n) for x, n in (("a", 3), ("b", 5)))
    return f"greatest(1, cast(regexp_extract(t, p, 1) as bigint) - ({down} + 1)) || ' do ' || (cast(regexp_extract(t, p, 2) as bigint) + {up} + 1) || ' godin'"


@query(
    "contradictions",
    f"""select doc_id, substr(t, 1, instr(t, regexp_extract(t, p)) - 1) || {_altered('c')} || substr(t, instr(t, regexp_extract(t, p)) + length(regexp_extract(t, p))) as text
        from (select doc_id, text || ' kazna 2 do 5 godina; 1 do 9 godina ' || text as t, '([0-9]{{1,2}})\\s*(?:do|-)\\s*([0-9]{{1,2}})\\s*godin' as p from documents)""",
)
def contradictions(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("text", F.lit(" kazna 2 do 5 godina; 1 do 9 godina "), "text")
    return table(spark, d, "documents").select("doc_id", instruct.contradicted(text, "c", F.col("doc_id")).alias("text"))


def _ring(seed: str) -> str:
    number = lambda parts: f"cast('0x' || substr(md5({parts}), 1, 15) as bigint)"
    return f"""ring as (select doc_id as other, row_number() over (order by h % {instruct.CELLS}, h, doc_id) - 1 as place from (select doc_id, {number(f"'{seed}|' || doc_id")} as h from documents)),
       asked as (select d.doc_id as question_id, {number(f"'{seed}q|' || d.doc_id")} % (select count(*) from ring) as start from documents d)"""


@query(
    "distractor_sample",
    f"""with {_ring('d')} select question_id, cast(row_number() over (partition by question_id order by step) - 1 as integer) as pos, source_id from (
          select a.question_id, s.step, r.other as source_id from asked a cross join (select unnest(range(0, 5)) as step) s join ring r on r.place = (a.start + s.step) % (select count(*) from ring) where r.other <> a.question_id
        ) qualify pos < 4""",
)
def distractor_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("question_id"), F.col("doc_id").alias("source_id"))
    return instruct.distractors(docs, docs.select("source_id"), 4, "d")


@query("context_rows")
def context_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    questions = docs.select(F.col("doc_id").alias("question_id"), F.col("doc_id").alias("source_id"), F.lit("Što piše u ovom izvoru?").alias("question"), F.col("text").alias("answer"))
    sources = docs.select(F.col("doc_id").alias("source_id"), F.expr(SOURCE_TYPE).alias("source_type"), F.col("text").alias("title"), F.col("source").alias("author"), "text")
    return instruct.context_rows(questions, sources, "rows")


@query("llm_json_items", """select doc_id, 'P' || doc_id as question, source as answer from documents where doc_id % 3 <> 0""")
def llm_json_items(spark: SparkSession, d: str) -> DataFrame:
    reply = F.when(F.col("doc_id") % 3 == 0, "nema").otherwise(F.format_string('Evo: [ {"question": "P%d", "answer": "%s"} ] kraj', "doc_id", "source"))
    items = table(spark, d, "documents").select("doc_id", F.explode(X.json_items(reply, "question:string,answer:string")).alias("i"))
    return items.select("doc_id", "i.question", "i.answer")


@query("rich_text", f"select doc_id, coalesce(nullif({sql_stripped('text')}, '') || ' ', '') || 'kraj' as text from documents")
def rich_text(spark: SparkSession, d: str) -> DataFrame:
    tree = F.to_json(F.struct(F.struct(F.array(F.struct(F.array(F.struct("text")).alias("children")), F.struct(F.array(F.struct(F.lit("kraj").alias("text"))).alias("children"))).alias("children")).alias("root")))
    return table(spark, d, "documents").select("doc_id", tables.rich_text(tree).alias("text"))


@query("dataset_scan", f"select cast(count(*) as bigint) as n, cast(sum(k) as bigint) as tokens from (select conv_id, turn, len({sql_tokens('text')}) as k from conversations) where k > 8")
def dataset_scan(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").withColumn("k", F.size(X.token_list(F.col("text"))).cast("long"))
    return turns.where("k > 8").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("tokens"))


@query("article_counts", ARTICLES + "select doc_id, cast(count(distinct number) as bigint) as articles, cast(count(*) as bigint) as chunks from c group by doc_id")
def article_counts(spark: SparkSession, d: str) -> DataFrame:
    chunks = numbered_chunks(spark, d).groupBy("doc_id", "article_number").agg(F.count(F.lit(1)).alias("n"))
    return chunks.groupBy("doc_id").agg(F.count("article_number").alias("articles"), F.sum("n").alias("chunks"))


@query("url_parts", "select page_id, regexp_extract(url, '://([^/?#]+)', 1) as host, regexp_extract(url, '/([a-z]{2})/([0-9]+)', 1) as lang, try_cast(regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2) as bigint) as number from pages")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    part = lambda pattern, i: F.regexp_extract("url", pattern, i)
    return table(spark, d, "pages").select("page_id", part("://([^/?#]+)", 1).alias("host"), part("/([a-z]{2})/([0-9]+)", 1).alias("lang"), F.nullif(part("/([a-z]{2})/([0-9]+)", 2), F.lit("")).try_cast("long").alias("number"))


@query("without_fields", "select doc_id, source from documents")
def without_fields(spark: SparkSession, d: str) -> DataFrame:
    nested = table(spark, d, "documents").select("doc_id", F.struct("source", "lang", "text").alias("r"))
    return nested.select("doc_id", F.col("r").dropFields("lang", "text").alias("r")).select("doc_id", "r.source")


@query(
    "hooked_writes",
    """select p_partkey, upper(trim(p_name)) as p_name, p_size + case when p_partkey % 3 = 0 then 1 else 0 end as p_size,
              lower(p_name || ' ' || p_brand) as search_text, cast(case when p_partkey % 3 = 0 then 2 else 1 end as bigint) as version from part""",
)
def hooked_writes(spark: SparkSession, d: str) -> DataFrame:
    """All parts, then a third of them with another size, through hooks that are registered here."""
    parts = Collection(KeyedTable(spark, f"{folder(spark)}/parts-{uuid.uuid4().hex}", ["p_partkey"], buckets=16))
    parts.before_change("p_name")(lambda name: F.upper(F.trim(name)))
    parts.after_change("search_text", "p_name", "p_brand")(lambda name, brand: F.lower(F.concat_ws(" ", name, brand)))
    rows = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", F.col("p_size").cast("long").alias("p_size"))
    parts.save(rows)
    parts.save(rows.where("p_partkey % 3 = 0").withColumn("p_size", F.col("p_size") + 1))
    return parts.table.read().select("p_partkey", "p_name", "p_size", "search_text", "version")
