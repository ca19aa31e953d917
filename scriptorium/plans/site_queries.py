"""Queries of the site: search, lookups, fees, access, feeds, places, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import listing, publishing, site
from ..streaming import limits
from .common import literal_rows, query, sql_collapsed, sql_fold, sql_plain, sql_tokens, stored_index, table

WORDS = "the that"
PLAIN_TOKENS = f"(select doc_id, lang, source, list_transform({sql_tokens('text')}, lambda t: {sql_plain('t')}) as ts from documents)"
FOUND = f"""
    found as (select d.doc_id, d.lang, c.court_name, round(len(list_filter(ts, lambda t: t in ('the', 'that'))) / len(ts), 6) as rank
              from {PLAIN_TOKENS} d
              left join (select distinct source, upper(source) as court_name from documents where source <> 'src3') c on d.source = c.source
              where d.lang = 'en' and list_contains(ts, 'the') and list_contains(ts, 'that'))
"""


def found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    courts = docs.where("source != 'src3'").select("source").distinct().withColumn("court_name", F.upper("source"))
    hits = docs.where(site.facets({"lang": "en", "source": None})).join(stored_index(spark, d).search(WORDS), F.col("doc_id") == F.col("id"))
    return hits.join(courts, "source", "left").select("doc_id", "lang", "court_name", "rank")


@query("decisions_search", f"with {FOUND} select * from found order by rank desc, doc_id limit 20")
def decisions_search(spark: SparkSession, d: str) -> DataFrame:
    return site.page(found(spark, d), [F.desc("rank"), F.asc("doc_id")], 1, 20)


@query("search_page2", f"with {FOUND} select * from found order by rank desc, doc_id limit 10 offset 10")
def search_page2(spark: SparkSession, d: str) -> DataFrame:
    return site.page(found(spark, d), [F.desc("rank"), F.asc("doc_id")], 2, 10)


#: A phrase spelt with accents that the texts have not.
PHRASE = "Thé ánd"


@query(
    "phrase_search",
    f"""select doc_id, array_to_string(places, ',') as places from (
          select doc_id, list_filter(range(0, len(ts) - 1), lambda i: ts[i + 1] = 'the' and ts[i + 2] = 'and') as places from {PLAIN_TOKENS}) where len(places) > 0""",
)
def phrase_search(spark: SparkSession, d: str) -> DataFrame:
    return stored_index(spark, d).phrase(PHRASE).select(F.col("id").alias("doc_id"), F.array_join("places", ",").alias("places"))


@query("search_count", f"with {FOUND} select cast(count(*) as bigint) as total_docs, 2 as page, 10 as size, cast(ceil(count(*) / 10) as bigint) as total_pages, ceil(count(*) / 10) > 2 as has_next, true as has_prev from found")
def search_count(spark: SparkSession, d: str) -> DataFrame:
    return site.envelope(found(spark, d), 2, 10)


@query(
    "search_headline",
    """with w as (select doc_id, string_split_regex(trim(text), '\\s+') as ws from documents),
            p as (select doc_id, ws, coalesce(list_position(list_transform(ws, lambda x: regexp_replace(lower(x), '[^\\p{L}\\p{N}-]', '', 'g')), 'that'), 0) as hit from w),
            f as (select *, greatest(hit - 15, 1) as first from p)
       select doc_id, array_to_string(list_transform(list_slice(ws, first, first + 29), lambda x, i: case when i + first - 1 = hit then '<mark>' || x || '</mark>' else x end), ' ') as headline from f""",
)
def search_headline(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", site.headline(F.col("text"), "that").alias("headline"))


@query("date_facets", "select o_orderstatus, cast(count(*) as bigint) as n from orders where o_orderstatus = 'F' and o_orderdate >= timestamp '1994-01-01' and o_orderdate <= timestamp '1997-06-30' group by o_orderstatus")
def date_facets(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").where(site.facets({"o_orderstatus": "F"}, "o_orderdate", "1994-01-01", "1997-06-30"))
    return orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    "global_search",
    """select type, id, title from (select *, row_number() over (partition by type order by title, id) as n from (
         select 'customer' as type, c_custkey as id, c_name as title from customer where contains(lower(c_name), '01') or contains(lower(c_mktsegment), '01')
         union all select 'supplier', s_suppkey, s_name from supplier where contains(lower(s_name), '01')
         union all select 'part', p_partkey, p_name from part where contains(lower(p_name), '01') or contains(lower(p_brand), '01')
         union all select 'order', o_orderkey, o_orderpriority from orders where contains(lower(o_orderpriority), '01'))) where n <= 3""",
)
def global_search(spark: SparkSession, d: str) -> DataFrame:
    sources = {
        "customer": (table(spark, d, "customer"), "c_custkey", ["c_name", "c_mktsegment"]),
        "supplier": (table(spark, d, "supplier"), "s_suppkey", ["s_name"]),
        "part": (table(spark, d, "part"), "p_partkey", ["p_name", "p_brand"]),
        "order": (table(spark, d, "orders"), "o_orderkey", ["o_orderpriority"]),
    }
    return site.global_search(sources, "01")


@query("latest_three", "select cast(o_orderkey as bigint) as o_orderkey from orders order by o_orderdate desc, o_orderkey desc limit 3")
def latest_three(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(3).select(F.col("o_orderkey").cast("long"))


PADDED = "'  ' || trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g')) || ' '"
GRAMS = "list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3)))"


@query(
    "trigram_names",
    f"""with g as (select p_partkey, p_name as name, {GRAMS.format('t')} as a, {GRAMS.format('u')} as b from (select p_partkey, p_name, {PADDED.format(sql_fold('p_name'))} as t, {PADDED.format("'smal rign'")} as u from part)),
            s as (select p_partkey, name, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) as similarity from g)
       select * from s where similarity >= 0.3 order by similarity desc, p_partkey limit 20""",
)
def trigram_names(spark: SparkSession, d: str) -> DataFrame:
    return site.similar_names(table(spark, d, "part"), "p_name", "šmal rign".replace("š", "s"), "p_partkey")


FEE = """case when v <= 0 then 0.0 when v <= 497.92 then 6.64 when v <= 4979.20 then 6.64 + 0.01 * (v - 497.92) when v <= 24896.02 then 51.46 + 0.005 * (v - 4979.20) else least(151.05 + 0.0025 * (v - 24896.02), 663.61) end"""


@query(
    "court_fee",
    f"""select o_orderkey, base, floor(base * m * 100 + 0.5) / 100 as fee from (
          select o_orderkey, m, floor(({FEE.replace('0.01 *', '0.01::double *').replace('0.005 *', '0.005::double *').replace('0.0025 *', '0.0025::double *')})::double * 100 + 0.5) / 100 as base from (
            select o_orderkey, o_totalprice / (1 + o_orderkey % 200) as v, case o_orderpriority when '1-URGENT' then 2.0::double when '2-HIGH' then 1.5::double when '3-MEDIUM' then 1.0::double when '4-NOT SPECIFIED' then 0.5::double else 3.0::double end as m from orders))""",
)
def court_fee(spark: SparkSession, d: str) -> DataFrame:
    names = {"1-URGENT": "civil_judgment", "2-HIGH": "civil_appeal", "3-MEDIUM": "civil_complaint", "4-NOT SPECIFIED": "land_registry", "5-LOW": "commercial_judgment"}
    kind = F.coalesce(*(F.when(F.col("o_orderpriority") == k, v) for k, v in names.items()))
    claims = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / (1 + F.col("o_orderkey") % 200)).alias("v"), kind.alias("kind"))
    return site.with_fee(claims, "v", "kind").select("o_orderkey", "base", "fee")


@query(
    "trigram_pairs",
    f"""with g as (select p_partkey as k, {GRAMS.format('t')} as a from (select p_partkey, {PADDED.format(sql_fold('p_name'))} as t from part)),
            s as (select x.k as asked_key, y.k as key, round(len(list_intersect(x.a, y.a)) / len(list_distinct(list_concat(x.a, y.a))), 6) as similarity from g x, g y where x.k % 50 = 0)
       select * from s where similarity >= 0.5""",
)
def trigram_pairs(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    return site.similar_pairs(parts.where("p_partkey % 50 = 0"), parts, "p_name", "p_partkey", 0.5)


KINDS = {"1-URGENT": "civil_judgment", "2-HIGH": "civil_appeal", "3-MEDIUM": "civil_complaint", "4-NOT SPECIFIED": "land_registry", "5-LOW": "commercial_judgment"}


@query(
    "fee_types",
    "select t.*, coalesce(n, 0) as claims from (values " + ", ".join(f"('{a}', {b}::double, '{c}', '{x}', '{e}')" for a, b, c, x, e in site.PROCEEDINGS) + ") t(proceeding, multiplier, label_hr, label_en, tariff) left join (select case o_orderpriority "
    + " ".join(f"when '{k}' then '{v}'" for k, v in KINDS.items()) + " end as proceeding, count(*) as n from orders group by 1) c on c.proceeding = t.proceeding",
)
def fee_types(spark: SparkSession, d: str) -> DataFrame:
    """The proceedings and how many claims there are of each."""
    kind = F.coalesce(*(F.when(F.col("o_orderpriority") == k, v) for k, v in KINDS.items()))
    claims = table(spark, d, "orders").groupBy(kind.alias("proceeding")).agg(F.count(F.lit(1)).alias("claims"))
    return site.proceedings(spark).join(claims, "proceeding", "left").withColumn("claims", F.coalesce("claims", F.lit(0).cast("long")))


#: Two rings: a square and a triangle, which overlap; the second feature has two polygons.
FEATURES = [(0, [[[[-0.1, -0.1], [0.1, -0.1], [0.1, 0.1], [-0.1, 0.1]]]]), (1, [[[[0.0, 0.0], [0.4, 0.0], [0.0, 0.4]]], [[[-0.4, -0.4], [-0.2, -0.4], [-0.2, -0.2], [-0.4, -0.2]]]])]
RINGS = [(0, 0, FEATURES[0][1][0][0]), (1, 0, FEATURES[1][1][0][0]), (1, 1, FEATURES[1][1][1][0])]
EDGES = ", ".join(f"({o}, {p}, {r[i][0]}::double, {r[i][1]}::double, {r[i - 1][0]}::double, {r[i - 1][1]}::double)" for o, p, r in RINGS for i in range(len(r)))


@query(
    "jurisdiction_pip",
    f"""with e(ord, polygon, xi, yi, xj, yj) as (values {EDGES}), p as (select vec_id, embedding[1]::double as x, embedding[2]::double as y from embeddings),
            c as (select vec_id, ord, polygon, count(*) as n from p, e where (yi > y) <> (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi) + xi group by vec_id, ord, polygon)
       select vec_id, min(ord) as ord from c where n % 2 = 1 group by vec_id""",
)
def jurisdiction_pip(spark: SparkSession, d: str) -> DataFrame:
    features = literal_rows(spark, FEATURES, "ord int, coordinates array<array<array<array<double>>>>")
    points = table(spark, d, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return site.located(points, features, "vec_id", "x", "y")


@query(
    "polygon_click",
    f"""with e(ord, polygon, xi, yi, xj, yj) as (values {EDGES}), p as (select vec_id, embedding[1]::double as x, embedding[2]::double as y from embeddings),
            c as (select vec_id, ord, polygon, count(*) as n from p, e where (yi > y) <> (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi) + xi group by vec_id, ord, polygon),
            l as (select vec_id, min(ord) as ord from c where n % 2 = 1 group by vec_id)
       select vec_id, ord, n_name from l left join (select n_regionkey, min(n_name) as n_name from nation where n_regionkey <> 1 group by 1) on n_regionkey = ord""",
)
def polygon_click(spark: SparkSession, d: str) -> DataFrame:
    courts = table(spark, d, "nation").where("n_regionkey != 1").select("n_regionkey", "n_name")
    return site.responsible(jurisdiction_pip(spark, d), courts, "vec_id", "n_regionkey", ["n_name"])


@query("coordinate_guard", "select vec_id, (44 + embedding[1] * 10) between 42 and 47 and (16 + embedding[2] * 10) between 13.5 and 19.5 as ok from embeddings")
def coordinate_guard(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", site.in_country(44 + v[0].cast("double") * 10, 16 + v[1].cast("double") * 10).alias("ok"))


@query(
    "court_lookup",
    """select o.o_orderkey, case when o.o_orderkey % 3 <> 0 then n1.n_name else n2.n_name end as court_name from orders o
       left join nation n1 on n1.n_nationkey = case when o.o_orderkey % 3 <> 0 then o.o_orderkey % 40 end left join nation n2 on lower(n2.n_name) = 'nation_' || (o.o_orderkey % 30)""",
)
def court_lookup(spark: SparkSession, d: str) -> DataFrame:
    courts = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lower("n_name").alias("slug"), F.col("n_name").alias("name"))
    key = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", F.when(key % 3 != 0, key % 40).alias("court_id"), F.concat(F.lit("nation_"), (key % 30).cast("string")).alias("court_slug"))
    return site.by_id_or_slug(rows, courts).select("o_orderkey", "court_name")


@query("populated_relations", "select c.c_custkey, coalesce(n1.n_name || ',', '') || coalesce(n2.n_name, '') as names from customer c left join nation n1 on n1.n_nationkey = c.c_nationkey left join nation n2 on n2.n_nationkey = (c.c_nationkey + 1) % 25")
def populated_relations(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), "n_name")
    rows = table(spark, d, "customer").select("c_custkey", F.array("c_nationkey", (F.col("c_nationkey") + 1) % 25, F.lit(999)).alias("nations"))
    return site.populated(rows, nations, "c_custkey", "nations", "nation", "n_name").select("c_custkey", F.array_join("names", ",").alias("names"))


@query("rls_published", "select o_orderkey from orders where o_orderdate is not null and o_orderdate <= timestamp '1996-01-01'")
def rls_published(spark: SparkSession, d: str) -> DataFrame:
    return site.visible(table(spark, d, "orders"), "member", "o_orderdate", "1996-01-01").select("o_orderkey")


@query("rls_own", "select c_custkey, c_name from customer where c_custkey = 7")
def rls_own(spark: SparkSession, d: str) -> DataFrame:
    return site.own_or_admin(table(spark, d, "customer"), "member", 7, "c_custkey").select("c_custkey", "c_name")


@query("mask_contact", "select c_custkey, cast(null as varchar) as c_name, cast(null as double) as c_acctbal from customer")
def mask_contact(spark: SparkSession, d: str) -> DataFrame:
    return site.masked(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), ["c_name", "c_acctbal"], member=False)


@query("role_rule", "select c_custkey, case when c_custkey % 3 = 0 then c_mktsegment when c_custkey % 2 = 0 then 'member' end as role from customer")
def role_rule(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", site.granted_role(F.when(key % 2 == 0, "create").otherwise("update"), F.col("c_mktsegment"), key % 3 == 0).alias("role"))


@query(
    "validate_contact",
    """select conv_id, turn, concat_ws(',', case when turn % 5 = 0 then 'name' end, case when turn % 2 = 0 then 'email' end, case when turn % 3 = 0 then 'subject' end, case when length(trim(text)) < 20 then 'message' end) as errors from conversations""",
)
def validate_contact(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn")
    errors = site.contact_errors(F.when(t % 5 != 0, F.col("role")), F.when(t % 2 == 0, "x.y").otherwise("a@b.hr"), F.when(t % 3 == 0, "spam").otherwise("press"), F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(errors, ",").alias("errors"))


@query("question_guard", "select conv_id, turn, length(trim(text)) between 3 and 2000 and turn between 1 and 20 as ok from conversations")
def question_guard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", site.question_ok(F.col("text"), F.col("turn")).alias("ok"))


@query(
    "rss_latest",
    f"""select doc_id, '<item><title>' || source || ' &amp; ' || lang || '</title><link>https://example.org/d/' || doc_id || '</link><description>' ||
               replace(replace(replace(replace(replace(case when length(f) > 300 then substr(f, 1, 300) || '…' else f end, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') ||
               '</description><pubDate>' || strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') || '</pubDate></item>' as item
        from (select doc_id, source, lang, timestamp '2024-01-01' + to_days(cast(doc_id % 97 as integer)) as ts, {sql_collapsed("regexp_replace('<p>' || text || '</p>', '<[^>]+>', ' ', 'g')")} as f from documents)
        order by ts desc, doc_id desc limit 50""",
)
def rss_latest(spark: SparkSession, d: str) -> DataFrame:
    date = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 97 as int))")
    docs = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit(" & "), "lang").alias("title"), F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("body"), date.alias("ts"))
    return site.feed_items(docs, "title", "body", "ts", "doc_id", "https://example.org/d/")


@query("search_text", "select p_partkey, lower(p_name || ' ' || p_brand || ' ' || p_type) as search_text from part")
def search_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", site.search_text(F.col("p_name"), F.lit(None).cast("string"), tags=F.array("p_brand", "p_type")).alias("search_text"))


@query("law_lookup", "select p_partkey, p_name from part where p_brand = 'Brand#7' and p_type = 'ECONOMY'")
def law_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(site.facets({"p_brand": "Brand#7", "p_type": "ECONOMY"})).select("p_partkey", "p_name")


def _limited(most: int, seconds: int, expired: str) -> str:
    return f"""
        with recursive e as (select event_id, user_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as i from events),
        w as (select user_id, i, event_id, us as start_at, 1 as n, true as passed from e where i = 1
              union all
              select e.user_id, e.i, e.event_id, case when e.us - w.start_at {expired} {seconds * 1_000_000} then e.us else w.start_at end,
                     case when e.us - w.start_at {expired} {seconds * 1_000_000} then 1 when w.n >= {most} then w.n else w.n + 1 end,
                     e.us - w.start_at {expired} {seconds * 1_000_000} or w.n < {most}
              from w join e on e.user_id = w.user_id and e.i = w.i + 1)
        select user_id, event_id, passed from w
    """


@query("rate_limit_gt", _limited(3, 43_200, ">"))
def rate_limit_gt(spark: SparkSession, d: str) -> DataFrame:
    return limits.replay(table(spark, d, "events"), "user_id", "ts", "event_id", 3, 43_200)


@query("rate_limit_ge", _limited(5, 86_400, ">="))
def rate_limit_ge(spark: SparkSession, d: str) -> DataFrame:
    return limits.replay(table(spark, d, "events"), "user_id", "ts", "event_id", 5, 86_400, inclusive=True)


@query("answer_parts", "select doc_id, 'a|[1]|b|[2]|' as parts from documents")
def answer_parts(spark: SparkSession, d: str) -> DataFrame:
    """Text and link parts of an answer, as a page shows them."""
    answer = F.lit("a[1]b[2]")
    parts = F.split(answer, "(?=\\[\\d+\\])|(?<=\\])")
    return table(spark, d, "documents").select("doc_id", F.concat(F.array_join(F.filter(parts, lambda p: p != ""), "|"), F.lit("|")).alias("parts"))


@query("language_fallback", "select doc_id, case lang when 'en' then 'Search' when 'de' then 'Suche' else 'Pretraga' end as label from documents")
def language_fallback(spark: SparkSession, d: str) -> DataFrame:
    labels = F.create_map(*(F.lit(x) for x in ("en", "Search", "de", "Suche", "hr", "Pretraga")))
    return table(spark, d, "documents").select("doc_id", F.coalesce(labels[F.col("lang")], labels["hr"]).alias("label"))


@query("token_overlap", f"select item_id, cast(len({sql_tokens('text')}) as bigint) as n from benchmark")
def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.size(X.token_list(F.col("text"))).cast("long").alias("n"))


#: A filter as a list endpoint gets it: numbers, dates and texts, nested.
WHERE = "where[o_totalprice][gte]=1000&where[or][0][o_orderstatus][in]=F,P&where[or][1][and][0][o_orderdate][gte]=1996-01-01&where[or][1][and][1][o_orderpriority][like]=high 2&where[o_orderkey][not_equals]=7"


@query("where_list", "select o_orderkey, o_orderstatus from orders where o_totalprice >= 1000 and (o_orderstatus in ('F', 'P') or (o_orderdate >= timestamp '1996-01-01' and contains(lower(o_orderpriority), 'high') and contains(lower(o_orderpriority), '2'))) and o_orderkey <> 7")
def where_list(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return orders.where(listing.where(orders.schema, listing.from_query_string(WHERE))).select("o_orderkey", "o_orderstatus")


@query("where_page", "select c_custkey, c_acctbal from customer where c_acctbal > 0 and c_mktsegment <> 'BUILDING' order by c_acctbal desc, c_custkey limit 100 offset 100")
def where_page(spark: SparkSession, d: str) -> DataFrame:
    tree = {"and": [{"c_acctbal": {"greater_than": 0}}, {"c_mktsegment": {"not_equals": "BUILDING"}}]}
    return listing.listing(table(spark, d, "customer"), tree, "c_custkey", "-c_acctbal", 2, 1_000).select("c_custkey", "c_acctbal")


@query(
    "redirect_targets",
    """with recursive r as (select l_orderkey * 8 + l_linenumber as old, case when (l_orderkey + l_linenumber) % 50 = 0 then l_orderkey * 8 + l_linenumber else (l_orderkey * 8 + l_linenumber) // 3 end as new from lineitem),
       m as (select old, min(new) as new from r group by old),
       w as (select old, new as goal, cast(1 as bigint) as hops from m union all select w.old, m.new, w.hops + 1 from w join m on m.old = w.goal where m.new <> w.goal),
       e as (select old, arg_max(goal, hops) as goal, max(hops) as hops from w group by old)
       select e.old, case when m.old is null then goal end as target, case when m.old is null then hops end as hops, case when m.old is null then 'ok' else 'cycle' end as state from e left join m on m.old = goal""",
)
def redirect_targets(spark: SparkSession, d: str) -> DataFrame:
    old = F.col("l_orderkey").cast("long") * 8 + F.col("l_linenumber")
    new = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 50 == 0, old).otherwise(F.floor(old / 3))
    return publishing.resolved(table(spark, d, "lineitem").select(old.alias("old"), new.alias("new")))


SITEMAP_MOST = 100


@query(
    "sitemap_files",
    f"""with u as (select distinct url from pages where url <> ''), n as (select url, row_number() over (order by url) - 1 as n from u)
        select n // {SITEMAP_MOST} + 1 as file, count(*) as entries, md5('<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || chr(10) ||
               string_agg('<url><loc>' || replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') || '</loc></url>', chr(10) order by n) || chr(10) || '</urlset>' || chr(10)) as xml_md5
        from n group by 1""",
)
def sitemap_files(spark: SparkSession, d: str) -> DataFrame:
    return publishing.sitemap(table(spark, d, "pages"), "url", most=SITEMAP_MOST).select("file", "entries", F.md5("xml").alias("xml_md5"))


@query(
    "pin_clusters",
    """with p as (select vec_id, 44 + embedding[1]::double * 10 as lat, 16 + embedding[2]::double * 10 as lon from embeddings),
            t as (select *, floor((lon + 180.0) / 360.0 * 4096)::bigint as x, floor((1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * 4096)::bigint as y from p),
            z as (select unnest(range(0, 13)) as zoom)
       select cast(zoom as integer) as zoom, x >> (12 - zoom) as x, y >> (12 - zoom) as y, count(*) as n, round(avg(lat), 6) as lat, round(avg(lon), 6) as lon, case when count(*) = 1 then min(vec_id) end as key
       from t, z group by 1, 2, 3""",
)
def pin_clusters(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    points = table(spark, d, "embeddings").select("vec_id", (44 + v[0].cast("double") * 10).alias("lat"), (16 + v[1].cast("double") * 10).alias("lon"))
    return publishing.clustered(points, "vec_id", "lat", "lon")
