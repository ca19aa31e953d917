"""Verification of generated answers: citations, grounding of identifiers, claims, status; and evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import HARD_ENTITIES, citations, entities, is_claim, is_refusal, sentences, until_marker, verdict


def with_verification(answers: DataFrame, answer: str = "answer", passages: str = "passages") -> DataFrame:
    """Adds cited, invalid, citations_valid, grounded, ungrounded, entities_grounded, n_cited and refusal.

    passages: an array of texts; [N] cites the N-th from 1. An identifier is grounded if any passage has it, in any case.
    """
    found = citations(F.col(answer))
    count = F.size(passages)
    texts = F.transform(passages, lambda p: F.lower(p))
    frame = answers.withColumns({"_found": found, "_texts": texts, "_entities": entities(F.col(answer), HARD_ENTITIES)})
    out_of_range = F.filter("_found", lambda n: (n < 1) | (n > count))
    has = lambda e: F.exists(F.col("_texts"), lambda t: F.contains(t, F.lower(e)))
    frame = frame.withColumns(
        {
            "cited": F.array_sort(F.array_except(F.col("_found"), out_of_range)),
            "invalid": out_of_range,
            "grounded": F.array_sort(F.filter("_entities", has)),
            "ungrounded": F.array_sort(F.filter("_entities", lambda e: ~has(e))),
            "refusal": is_refusal(F.col(answer)),
        }
    )
    return frame.withColumns({"citations_valid": F.size("invalid") == 0, "entities_grounded": F.size("ungrounded") == 0, "n_cited": F.size("cited")}).drop("_found", "_texts", "_entities")


def status(confident: Column, error: Column, refusal: Column, citations_valid: Column, entities_grounded: Column, faithful: Column) -> Column:
    """The first that holds; faithful is null where no claims were judged."""
    flagged = ~citations_valid | ~entities_grounded
    return (
        F.when(~confident, "refused_low_retrieval")
        .when(error, "llm_error")
        .when(refusal, "refused_by_model")
        .when(flagged, "flagged")
        .when(~F.coalesce(faithful, F.lit(True)), "flagged_nli")
        .otherwise("answered")
    )


def trustworthy(of: Column) -> Column:
    return of == "answered"


def claims(answers: DataFrame, key: str, answer: str = "answer", most: int = 8) -> DataFrame:
    """key, pos and sentence of the first sentences of each answer that claim something, at most `most`."""
    chosen = F.slice(F.filter(sentences(F.col(answer)), is_claim), 1, most)
    return answers.select(key, F.posexplode(chosen).alias("pos", "sentence"))


def cited_passages(sentence: Column, passages: Column) -> Column:
    """The passages that a sentence cites, in its order; all where it cites none that exists."""
    named = F.filter(citations(sentence), lambda n: (n >= 1) & (n <= F.size(passages)))
    return F.when(F.size(named) > 0, F.transform(named, lambda n: F.get(passages, n - 1))).otherwise(passages)


def judged(claim_rows: DataFrame, judge: Callable[[Column, Column], Column], sentence: str = "sentence", evidence: str = "evidence", *, legacy: bool = False) -> DataFrame:
    """Adds verdict, read from the reply of an injected judge (a column function, say a pandas UDF around a model)."""
    return claim_rows.withColumn("verdict", verdict(judge(F.col(sentence), F.col(evidence)), legacy=legacy))


def roll_up(verdicts: DataFrame, key: str) -> DataFrame:
    """Counts of each verdict and faithful (no UNSUPPORTED) by answer."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    return verdicts.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_claims"), n("SUPPORTED").alias("n_supported"), n("PARTIAL").alias("n_partial"), n("UNSUPPORTED").alias("n_unsupported"), n("NEUTRAL").alias("n_neutral"), F.bool_and(F.col("verdict") != "UNSUPPORTED").alias("faithful")
    )


def judged_answers(answers: DataFrame, key: str, judge: Callable[[Column, Column], Column], answer: str = "answer", passages: str = "passages", most: int = 8) -> DataFrame:
    """key, the counts of verdicts and faithful of the answers that claim something: claims, the passages that each
    cites, the judge's verdicts and their roll-up as one query."""
    rows = claims(answers, key, answer, most).join(answers.select(key, passages), key)
    evidence = F.array_join(cited_passages(F.col("sentence"), F.col(passages)), "\n\n")
    return roll_up(judged(rows.withColumn("evidence", evidence), judge), key)


def answered(asked: DataFrame, gates: DataFrame, model: Callable[[Column, Column], Column], judge: Callable[[Column, Column], Column] | None = None, key: str = "query_id", legacy_refusal: str = "") -> DataFrame:
    """Questions answered and checked: adds answer, status, trustworthy, what verification found and what the judge did.

    asked: key, query, passages (an array of texts). gates: key and confident, as retrieval.gate() gives them. model: a
    column function of question and context (say a pandas UDF around a chat model) whose null reply is an error. Only
    questions with a confident retrieval reach the model, only answers that are no refusal the judge.
    """
    context = F.array_join(F.transform(F.col("passages"), lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p)), "\n\n")
    joined = asked.join(gates.select(key, "confident"), key, "left").withColumn("confident", F.coalesce("confident", F.lit(False)))
    sure = joined.where("confident").withColumn("reply", model(F.col("query"), context))
    unsure = joined.where("not confident").withColumn("reply", F.lit(None).cast("string"))
    rows = sure.unionByName(unsure).withColumns({"error": F.col("confident") & F.col("reply").isNull(), "answer": F.when(F.col("confident"), F.coalesce(until_marker(F.col("reply")), F.lit(""))).otherwise(F.lit(legacy_refusal))})
    checked = with_verification(rows, "answer", "passages")
    if judge is None:
        checked = checked.withColumn("faithful", F.lit(None).cast("boolean"))
    else:
        worth = checked.where("confident and not error and not refusal and trim(answer) != ''")
        checked = checked.join(judged_answers(worth, key, judge), key, "left")
    state = status(F.col("confident"), F.col("error"), F.col("refusal"), F.col("citations_valid"), F.col("entities_grounded"), F.col("faithful"))
    return checked.withColumn("status", state).withColumn("trustworthy", trustworthy(F.col("status"))).drop("reply")


def entity_recall(predicted: Column, gold: Column) -> Column:
    """The share of gold entities that the answer contains; without gold ones, 1 if it says anything."""
    low = F.lower(predicted)
    distinct = F.array_distinct(gold)
    hits = F.size(F.filter(distinct, lambda e: F.contains(low, F.lower(e))))
    return F.when(F.size(distinct) == 0, F.when(F.trim(predicted) != "", 1.0).otherwise(0.0)).otherwise(hits / F.size(distinct))


def retrieval_recall(gold: Column, retrieved: Column) -> Column:
    """1 or 0, null without a gold id."""
    return F.when(gold.isNotNull(), F.array_contains(retrieved, gold).cast("double"))


def probe_score(answer: Column, all_of: list[str], any_of: list[list[str]]) -> Column:
    """The share of single tokens and alternatives that the answer has."""
    low = F.lower(answer)
    has = lambda t: F.contains(low, F.lit(t.lower()))
    parts = [has(t) for t in all_of]
    for group in any_of:
        one = F.lit(False)
        for t in group:
            one = one | has(t)
        parts.append(one)
    return sum((p.cast("double") for p in parts), F.lit(0.0)) / len(parts) if parts else F.lit(0.0)


def summary(rows: DataFrame) -> DataFrame:
    """One row over evaluation rows (status, retrieval_recall, entity_recall, n_claims, n_supported, n_unsupported, faithful)."""
    share = lambda state: F.round(F.count_if(F.col("status") == state) / F.count(F.lit(1)), 6)
    ran = F.count("n_claims")
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        share("answered").alias("answered"),
        share("flagged").alias("flagged"),
        F.round(F.count_if(F.startswith("status", F.lit("refused"))) / F.count(F.lit(1)), 6).alias("refused"),
        F.round(F.coalesce(F.avg("retrieval_recall"), F.lit(0.0)), 6).alias("retrieval_recall"),
        F.round(F.coalesce(F.avg("entity_recall"), F.lit(0.0)), 6).alias("entity_recall"),
        F.when(ran > 0, F.coalesce(F.sum("n_claims"), F.lit(0))).alias("claims"),
        F.when(F.sum("n_claims") > 0, F.round(F.sum("n_supported") / F.sum("n_claims"), 6)).alias("supported"),
        F.when(F.sum("n_claims") > 0, F.round(F.sum("n_unsupported") / F.sum("n_claims"), 6)).alias("unsupported"),
        F.when(ran > 0, F.round(F.avg(F.col("faithful").cast("double")), 6)).alias("faithful"),
    )
