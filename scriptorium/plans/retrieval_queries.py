"""Queries of retrieval, verification and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vectors import dot, unit
from ..operators import corpus, instruct, retrieval, verification
from ..sources.keyed import KeyedTable
from ..sources.scratch import folder
from .common import query, sql_stripped, sql_tokens, stored_index, table
from .corpus_queries import PAIRS, pairs

K, WIDE = 6, 24
#: Questions: the benchmark's items whose id is divisible by 50, and the vectors whose id is.
QUESTIONS = "(select item_id as query_id, text as query from benchmark where item_id % 50 = 0)"

INDEX = f"""
    toks as (select doc_id as id, {sql_tokens('text')} as ts from documents),
    lens as (select id, cast(len(ts) as bigint) as dl from toks),
    post as (select term, id, count(*) as tf from (select id, unnest(ts) as term from toks) group by term, id),
    raw as (select term, count(*) as df, round(ln((select count(*) from lens) - count(*) + 0.5) - ln(count(*) + 0.5), 12) as raw from post group by term),
    idfs as (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw)
"""
SCORES = f"""
    {INDEX},
    wanted as (select query_id, term, count(*) as times from (select query_id, unnest({sql_tokens('query')}) as term from {QUESTIONS}) group by query_id, term),
    scored as (select query_id, p.id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (select avg(dl) from lens)))), 6) as s
               from post p join wanted w on p.term = w.term join idfs i on i.term = w.term join lens l on l.id = p.id group by query_id, p.id),
    lexical as (select * from (
        select q.query_id, l.id, coalesce(s.s, 0.0) as bm25_score, cast(row_number() over (partition by q.query_id order by coalesce(s.s, 0.0) desc, l.id desc) - 1 as integer) as bm25_rank
        from {QUESTIONS} q cross join lens l left join scored s on s.query_id = q.query_id and s.id = l.id) where bm25_rank < {WIDE})
"""
DENSE = f"""
    dense as (select * from (
        select q.vec_id as query_id, v.vec_id as id, round(list_inner_product(cast(q.embedding as double[]), cast(v.embedding as double[])), 6) as dense_score,
               cast(row_number() over (partition by q.vec_id order by round(list_inner_product(cast(q.embedding as double[]), cast(v.embedding as double[])), 6) desc, v.vec_id) - 1 as integer) as dense_rank
        from embeddings q cross join embeddings v where q.vec_id % 50 = 0) where dense_rank < {WIDE})
"""
FUSED = f"""
    {SCORES}, {DENSE},
    hybrid as (select coalesce(l.query_id, d.query_id) as query_id, coalesce(l.id, d.id) as id, bm25_score, bm25_rank, dense_score, dense_rank,
                      round(coalesce(1.0 / (60 + bm25_rank), 0.0) + coalesce(1.0 / (60 + dense_rank), 0.0), 6) as fused_score
               from lexical l full join dense d on l.query_id = d.query_id and l.id = d.id)
"""
#: Each document's identifier; a question names two, one of which is there.
EXACT = """
    exact as (select query_id, id, cast(row_number() over (partition by query_id order by pos) - 1 as integer) as exact_pos
              from (select query_id, query_id * 3 + 1 as id, 0 as pos from questions union all select query_id, query_id * 5 + 2, 1 from questions where query_id * 5 + 2 <> query_id * 3 + 1)
              where id in (select doc_id from documents)),
    placed as (select coalesce(h.query_id, e.query_id) as query_id, coalesce(h.id, e.id) as id, exact_pos, bm25_score, dense_score,
                      case when exact_pos is not null then coalesce(fused_score, 1.0) + 10.0 else fused_score end as fused_score
               from hybrid h full join exact e on h.query_id = e.query_id and h.id = e.id),
    ranked as (select *, cast(row_number() over (partition by query_id order by exact_pos nulls last, fused_score desc, id) - 1 as integer) as pos from placed)
"""


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def lexical(spark: SparkSession, d: str, k: int = WIDE) -> DataFrame:
    return retrieval.top_bm25(stored_index(spark, d).lexical(), questions(spark, d), k)


def dense(spark: SparkSession, d: str, k: int = WIDE) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return retrieval.top_dense(vectors, asked, k)


def hybrid(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.fused(lexical(spark, d), dense(spark, d))


def placed(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.format_string("P-%d/2020", "doc_id").alias("case_number"))
    asked = questions(spark, d).select("query_id", F.format_string("Što je s P-%d/2020, P-%d/2020 i P-%d/2020?", F.col("query_id") * 3 + 1, F.col("query_id") * 5 + 2, F.lit(999_999_999)).alias("query"))
    return retrieval.promoted(hybrid(spark, d), retrieval.exact_hits(named, asked), K)


@query("bm25_stats", f"with {INDEX} select cast(count(*) as bigint) as terms, cast(sum(df) as bigint) as postings, round(avg(idf), 6) as mean_idf, (select cast(sum(dl) as bigint) from lens) as tokens from idfs")
def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    index = stored_index(spark, d).lexical()
    terms = index.terms.agg(F.count(F.lit(1)).alias("terms"), F.sum("df").alias("postings"), F.round(F.avg("idf"), 6).alias("mean_idf"))
    return terms.join(F.broadcast(index.lengths.agg(F.sum("dl").alias("tokens"))))


@query("bm25_topk", f"with {SCORES} select * from lexical")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical(spark, d)


@query("dense_topk", f"with {DENSE} select * from dense")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return dense(spark, d)


@query("unit_vectors", "select vec_id, round(list_inner_product(cast(embedding as double[]), cast(embedding as double[])), 6) as norm2 from embeddings")
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    size = dot(F.col("embedding"), F.col("embedding"))
    tripled = unit(F.transform("embedding", lambda x: x * 3))
    return table(spark, d, "embeddings").select("vec_id", F.round(dot(tripled, tripled) * size, 6).alias("norm2"))


@query(
    "vector_upsert",
    """with e as (select vec_id, list_inner_product(cast(embedding as double[]), cast(embedding as double[])) as n from embeddings)
       select vec_id, round(case when vec_id % 10 = 0 then 4 * n else n end, 6) as norm2, cast(case when vec_id % 10 = 0 then 2 else 1 end as bigint) as version from e
       union all select vec_id + 1000000, round(n, 6), 1 from e where vec_id % 25 = 0""",
)
def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    """All vectors, then a batch of changed, unchanged and new ones, then that batch again."""
    vectors = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    stored = KeyedTable(spark, f"{folder(spark)}/vectors-{uuid.uuid4().hex}", ["vec_id"])
    stored.merge(vectors)
    changed = vectors.where("vec_id % 5 = 0").withColumn("embedding", F.when(F.col("vec_id") % 10 == 0, F.transform("embedding", lambda x: x * 2)).otherwise(F.col("embedding")))
    batch = changed.unionByName(vectors.where("vec_id % 25 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000))
    stored.merge(batch)
    stored.merge(batch)
    return stored.read().select("vec_id", F.round(dot(F.col("embedding"), F.col("embedding")), 6).alias("norm2"), "version")


@query("rrf_hybrid", f"with {FUSED} select * from hybrid")
def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return hybrid(spark, d)


@query("hybrid_exact", f"with questions as {QUESTIONS}, {FUSED}, {EXACT} select query_id, id, pos, exact_pos, round(fused_score, 6) as fused_score from ranked where pos < {K}")
def hybrid_exact(spark: SparkSession, d: str) -> DataFrame:
    return placed(spark, d).select("query_id", "id", "pos", "exact_pos", F.round("fused_score", 6).alias("fused_score"))


GATES = f"""with {FUSED}, best as (
          select query_id, max(coalesce(dense_score, 0.0)) as max_dense, max(coalesce(bm25_score, 0.0)) as max_bm25, bool_or(fused_score >= 1.0) as exact_match from hybrid where query_id <> 50 group by query_id)
        select q.query_id, coalesce(max_dense, 0.0) as max_dense, coalesce(max_bm25, 0.0) as max_bm25, coalesce(exact_match, false) as exact_match,
               case when b.query_id is null then false when exact_match then true else not (max_dense < 1.1 and max_bm25 < 30.0) end as confident,
               case when b.query_id is null then 'no hits' when exact_match then 'exact case-id match' when max_dense < 1.1 and max_bm25 < 30.0 then 'low confidence' else 'ok' end as reason
        from (select query_id from {QUESTIONS} union select vec_id from embeddings where vec_id % 50 = 0) q left join best b on q.query_id = b.query_id"""


@query("confidence_gate", GATES)
def confidence_gate(spark: SparkSession, d: str) -> DataFrame:
    asked = questions(spark, d).select("query_id").union(table(spark, d, "embeddings").where("vec_id % 50 = 0").select("vec_id")).distinct()
    return retrieval.gate(asked, hybrid(spark, d).where("query_id != 50"), 1.1, 30.0)


#: What a model would say to a question, and a judge to what it says: by the question's number.
REPLIES = ["Ne mogu odgovoriti na ovo pitanje.", "Odgovor stoji u izvoru [7], kako je rečeno.", "Ova tvrdnja nije točna prema izvoru [1].", "Ova tvrdnja je točna prema izvoru [2].\n---\nPitanje: novo?"]


@query(
    "answered_questions",
    f"""with gates as ({GATES}),
            shown as (select query_id, count(*) as n from (with {DENSE} select d.query_id, d.dense_rank from dense d join documents doc on doc.doc_id = d.id where dense_rank < {K}) group by query_id),
            said as (select s.query_id, s.n, g.confident, (s.query_id // 50) % 5 as r from shown s join gates g on s.query_id = g.query_id)
       select query_id, n, case when not confident then '' when r = 0 then '' when r = 1 then '{REPLIES[0]}' when r = 2 then '{REPLIES[1]}' when r = 3 then '{REPLIES[2]}' else 'Ova tvrdnja je točna prema izvoru [2].' end as answer,
              case when not confident then 'refused_low_retrieval' when r = 0 then 'llm_error' when r = 1 then 'refused_by_model' when r = 2 then 'flagged' when r = 3 then 'flagged_nli' else 'answered' end as status,
              confident and r = 4 as trustworthy, case when confident and r > 1 then cast(1 as bigint) end as n_claims, case when confident and r > 1 then r <> 3 end as faithful from said""",
)
def answered_questions(spark: SparkSession, d: str) -> DataFrame:
    """From retrieval over context, model, citations and the judge to the status, with stand-ins for model and judge."""
    shown = dense(spark, d, K).join(table(spark, d, "documents"), F.col("id") == F.col("doc_id"))
    asked = shown.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("dense_rank", "text"))).alias("p"))
    asked = asked.select("query_id", F.lit("Što?").alias("query"), F.transform("p", lambda x: x["text"]).alias("passages"))
    model = lambda query, context: F.get(F.array(*map(F.lit, REPLIES)), (F.floor(F.col("query_id") / 50) % 5 - 1).cast("int"))
    judge = lambda sentence, evidence: F.when(F.contains(sentence, F.lit("nije točna")) | (evidence == ""), "UNSUPPORTED").otherwise("SUPPORTED")
    done = verification.answered(asked, confidence_gate(spark, d), model, judge)
    return done.select("query_id", F.size("passages").cast("long").alias("n"), "answer", "status", "trustworthy", "n_claims", "faithful")


@query("chunk_by_id", "select doc_id, cast(length(text) as bigint) as n from documents where doc_id = 17")
def chunk_by_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("doc_id = 17").select("doc_id", F.length("text").cast("long").alias("n"))


@query("context_blocks", "select query_id, string_agg('[' || (dense_rank + 1) || '] IZVOR: ' || substr(text, 1, 120) || chr(10) || text, chr(10) || chr(10) order by dense_rank) as context from (" + f"with {DENSE} select d.query_id, d.dense_rank, doc.text from dense d join documents doc on doc.doc_id = d.id where dense_rank < 6) group by query_id")
def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    shown = dense(spark, d, K).join(table(spark, d, "documents"), F.col("id") == F.col("doc_id"))
    line = instruct.passage(F.col("dense_rank") + 1, F.lit(""), F.col("text"), F.lit(""), F.col("text"))
    return shown.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("dense_rank", line.alias("p")))).alias("p")).select("query_id", F.array_join(F.transform("p", lambda x: x["p"]), "\n\n").alias("context"))


#: Answers over three passages: one that is refused, one with a missing citation, one with an identifier that is nowhere.
ANSWER = """case doc_id % 4 when 0 then 'Ne mogu odgovoriti na ovo.' when 1 then 'Odluka P-' || doc_id || '/2020 navodi ovo [1][3].' when 2 then 'Prema izvoru [7] i [2].' else 'Odluka P-1/1999 od 2020-01-01 [2].' end"""


def answers(spark: SparkSession, d: str) -> DataFrame:
    passages = F.array(F.format_string("predmet p-%d/2020", "doc_id"), F.col("text"), F.lit("dana 2020-01-01"))
    return table(spark, d, "documents").select("doc_id", F.expr(ANSWER).alias("answer"), passages.alias("passages"))


@query(
    "citation_verify",
    """select doc_id, case doc_id % 4 when 1 then '1,3' when 2 then '2' when 3 then '2' else '' end as cited, case doc_id % 4 when 2 then '7' else '' end as invalid,
              doc_id % 4 <> 2 as citations_valid, case doc_id % 4 when 1 then 'P-' || doc_id || '/2020' when 3 then '2020-01-01' else '' end as grounded,
              case doc_id % 4 when 3 then 'P-1/1999' else '' end as ungrounded, doc_id % 4 <> 3 as entities_grounded, doc_id % 4 = 0 as refusal from documents""",
)
def citation_verify(spark: SparkSession, d: str) -> DataFrame:
    flat = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return verification.with_verification(answers(spark, d)).select("doc_id", flat("cited"), flat("invalid"), "citations_valid", flat("grounded"), flat("ungrounded"), "entities_grounded", "refusal")


@query("status_machine", """select case when doc_id % 10 = 9 then 'refused_low_retrieval' when doc_id % 11 = 0 then 'llm_error' when doc_id % 4 = 0 then 'refused_by_model' when doc_id % 4 in (2, 3) then 'flagged' when doc_id % 7 = 0 then 'flagged_nli' else 'answered' end as status, cast(count(*) as bigint) as n from documents group by 1""")
def status_machine(spark: SparkSession, d: str) -> DataFrame:
    checked = verification.with_verification(answers(spark, d))
    faithful = F.when(F.col("doc_id") % 3 != 2, F.lit(None)).otherwise(F.col("doc_id") % 7 != 0)
    faithful = F.when(F.col("doc_id") % 7 == 0, F.lit(False)).otherwise(faithful)
    state = verification.status(F.col("doc_id") % 10 != 9, F.col("doc_id") % 11 == 0, F.col("refusal"), F.col("citations_valid"), F.col("entities_grounded"), faithful)
    return checked.groupBy(state.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "entity_grounding",
    """select doc_id, case doc_id % 4 when 0 then '' when 1 then 'P-' || doc_id || '/2020' when 2 then '' else '2020-01-01,P-1/1999' end as entities from documents""",
)
def entity_grounding(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).select("doc_id", F.array_join(F.array_sort(X.entities(F.col("answer"), X.HARD_ENTITIES, nouns=True)), ",").alias("entities"))


@query("model_replies", """select doc_id, 'odgovor ' || doc_id as reply from documents""")
def model_replies(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit(" odgovor "), F.col("doc_id").cast("string"), F.lit("\nPitanje: novo?\n---\nostatak"))
    return table(spark, d, "documents").select("doc_id", X.until_marker(raw).alias("reply"))


def _sentences(text: str) -> str:
    """A mark before what opens a sentence after . ! ?, unless a blank after an abbreviation stands there, which has a mark
    of its own. That one is set in two passes, as abbreviations in a row share the blank between them. Marks are
    character 1 and a second character; a text's own character 1 gets another second one meanwhile."""
    own, held, cut = "chr(1) || chr(3)", "chr(1) || chr(4)", "chr(1) || chr(5)"
    marked = f"replace({text}, chr(1), {own})"
    for _ in range(2):
        marked = f"regexp_replace({marked}, '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(X.ABBREVIATIONS)})\\. ', '\\1\\2.' || {held} || ' ', 'g')"
    marked = f"regexp_replace({marked}, '([.!?])[\\s\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+([A-ZŠĐČĆŽ0-9\\[])', '\\1' || {cut} || '\\2', 'g')"
    stripped = sql_stripped(f"replace(replace(s, {held}, ''), {own}, chr(1))")
    return f"list_filter(list_transform(string_split({marked}, {cut}), lambda s: {stripped}), lambda s: s <> '')"


#: Without regard to case, for which both dotless and dotted i are an i.
NO_CLAIM_SQL = f"regexp_matches(translate(s, 'ıİ', 'ii'), '{X.NO_CLAIM.replace('(?iu)', '(?i)')}')"


@query(
    "claim_sentences",
    f"""with chosen as (select doc_id, list_slice(list_filter({_sentences('text')}, lambda s: length(s) >= 15 and not {NO_CLAIM_SQL}), 1, 8) as c from documents)
        select doc_id, cast(generate_subscripts(c, 1) - 1 as integer) as pos, unnest(c) as sentence from chosen""",
)
def claim_sentences(spark: SparkSession, d: str) -> DataFrame:
    return verification.claims(table(spark, d, "documents").select("doc_id", F.col("text").alias("answer")), "doc_id")


VERDICTS = "case doc_id % 5 when 0 then 'SUPPORTED' when 1 then 'UNSUPPORTED' when 2 then 'partial' when 3 then 'NEUTRAL.' else '?' end"


@query(
    "nli_roll_up",
    """select source, cast(count(*) as bigint) as n_claims, cast(count(*) filter (doc_id % 5 = 0) as bigint) as n_supported, cast(count(*) filter (doc_id % 5 = 2) as bigint) as n_partial,
              cast(count(*) filter (doc_id % 5 = 1) as bigint) as n_unsupported, cast(count(*) filter (doc_id % 5 = 3) as bigint) as n_neutral, bool_and(doc_id % 5 <> 1) as faithful from documents group by source""",
)
def nli_roll_up(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("source", F.col("doc_id").alias("sentence"), F.lit("").alias("evidence"))
    judge = lambda sentence, evidence: F.expr(VERDICTS.replace("doc_id", "sentence"))
    return verification.roll_up(verification.judged(rows, judge), "source")


@query("claim_evidence", "select doc_id, case when doc_id % 3 = 0 then 'b' when doc_id % 3 = 1 then 'c,a' else 'a,b,c' end as evidence from documents")
def claim_evidence(spark: SparkSession, d: str) -> DataFrame:
    sentence = F.when(F.col("doc_id") % 3 == 0, "Tvrdnja [2] [9]").when(F.col("doc_id") % 3 == 1, "Tvrdnja [3][1]").otherwise("Tvrdnja [8]")
    return table(spark, d, "documents").select("doc_id", F.array_join(verification.cited_passages(sentence, F.array(F.lit("a"), F.lit("b"), F.lit("c"))), ",").alias("evidence"))


@query(
    "eval_summary",
    f"""select cast(count(*) as bigint) as n, round(avg((turn % 3 = 0)::int), 6) as answered, round(avg((turn % 3 = 1)::int), 6) as flagged, round(avg((turn % 3 = 2)::int), 6) as refused,
               round(coalesce(avg(case when turn % 4 <> 0 then (turn % 2)::double end), 0.0), 6) as retrieval_recall, round(avg(least(length(a), 500) / 500.0), 6) as entity_recall,
               cast(sum(case when turn % 2 = 0 then 4 end) as bigint) as claims, 0.75 as supported, 0.25 as unsupported, round(avg(case when turn % 2 = 0 then (turn % 4 = 0)::int end), 6) as faithful from ({PAIRS})""",
)
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    turn = F.col("turn")
    even = lambda c: F.when(turn % 2 == 0, c)
    rows = pairs(spark, d).select(
        F.when(turn % 3 == 0, "answered").when(turn % 3 == 1, "flagged").otherwise("refused_by_model").alias("status"),
        F.when(turn % 4 != 0, (turn % 2).cast("double")).alias("retrieval_recall"),
        (F.least(F.length("a"), F.lit(500)) / 500.0).alias("entity_recall"),
        even(F.lit(4)).alias("n_claims"), even(F.lit(3)).alias("n_supported"), even(F.lit(1)).alias("n_unsupported"), even(turn % 4 == 0).alias("faithful"),
    )
    return verification.summary(rows)


@query("entity_recall", "select doc_id, case doc_id % 3 when 0 then 0.5 when 1 then 1.0 else 0.0 end as recall from documents")
def entity_recall(spark: SparkSession, d: str) -> DataFrame:
    gold = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("P-1/2020"), F.lit("P-2/2020"))).otherwise(F.array().cast("array<string>"))
    said = F.when(F.col("doc_id") % 3 == 2, " ").otherwise("vidi p-2/2020")
    return table(spark, d, "documents").select("doc_id", verification.entity_recall(said, gold).alias("recall"))


@query("recall_at_k", f"""with {SCORES} select q.query_id, case when q.query_id % 4 = 3 then null else (max(case when l.id = q.query_id * 7 then 1 else 0 end))::double end as recall from {QUESTIONS} q left join lexical l on l.query_id = q.query_id group by q.query_id""")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    found = lexical(spark, d).groupBy("query_id").agg(F.collect_list("id").alias("ids"))
    rows = questions(spark, d).join(found, "query_id", "left")
    gold = F.when(F.col("query_id") % 4 != 3, F.col("query_id") * 7)
    return rows.select("query_id", verification.retrieval_recall(gold, F.coalesce("ids", F.array().cast("array<bigint>"))).alias("recall"))


@query("probe_score", "select lang, round(avg(((contains(lower(text), 'the'))::double + (contains(lower(text), 'que') or contains(lower(text), 'und'))::double) / 2), 6) as score from documents group by lang")
def probe_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.round(F.avg(verification.probe_score(F.col("text"), ["the"], [["que", "und"]])), 6).alias("score"))


@query("kind_counts", "select lang, source, cast(count(*) as bigint) as n from documents group by lang, source")
def kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("shown_kinds", "select doc_id, case doc_id % 2 when 0 then 'PROPIS' else 'IZVOR' end as shown from documents")
def shown_kinds(spark: SparkSession, d: str) -> DataFrame:
    kind = corpus.kind(F.when(F.col("doc_id") % 2 == 0, "legislation"), F.lit(""), F.lit(""))
    return table(spark, d, "documents").select("doc_id", corpus.shown_kind(kind).alias("shown"))
