"""One query for each operator of this subpackage, over whole tables, and DuckDB SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import remainder
    from .lm_scoring import Model

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = Model(documents, remainder("doc_id", 5) != 1).score(documents)
    return scored.select("doc_id", (remainder("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import remainder
    from .toxicity import fit, score

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = fit(documents, table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    return score(documents, index).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "evidence")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find

    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import remainder
    from .quality import fit, score

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Grades: 0 junk, 1 of quality but toxic, 2 of quality. What is selected has quality: grade 1 at least.
    labels = table(spark, sf_dir, "labels")
    rated = labels.select("doc_id", (F.col("quality") * (2 - F.coalesce("toxic", F.lit(0)))).cast("int").alias("grade"))
    model, grades = fit(documents, rated, remainder("doc_id", 3) != 1, rating="grade")
    return score(documents, model, grades, tail=1).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "expected_grade", "tail_prob", "keep")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import RULES, judge

    values = ", ".join(str(rule) for rule in RULES)
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), spark.sql(f"select * from values {values} as rules(host, path, verdict)")).select("page_id", "host", "path", "rule", "verdict")


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import as_text, fingerprints, likeness

    return fingerprints(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import digests

    return digests(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id", "copies")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import remainder
    from .quality_rules import fit, judge

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(documents, table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    return judge(documents, model).drop("text").withColumn("held_out", remainder("doc_id", 3) == 1)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import trie

    return trie(table(spark, sf_dir, "conversations")).drop("first", "last")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_toxicity": op3_toxicity,
    "op4_license_scan": op4_license_scan,
    "op5_decontaminate": op5_decontaminate,
    "op6_quality": op6_quality,
    "op7_url_filter": op7_url_filter,
    "op8_fingerprint": op8_fingerprint,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_simhash": op10_simhash,
    "op11_quality_rules": op11_quality_rules,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_importance": op13_importance,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
        with own as (
            select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
        ), each as (
            select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as i from own
        ), windows as (
            select doc_id, word, i, count(*) over w as n, string_agg(word, ' ') over w as words from each
            window w as (partition by doc_id order by i rows between current row and 19 following)
        ), flagged as (
            select doc_id, word, i, case when n = 20 and row_number() over (partition by words order by doc_id, i) > 1 then 1 else 0 end as again from windows
        ), judged as (
            select doc_id, word, i, max(again) over (partition by doc_id order by i rows between 19 preceding and current row) as gone from flagged
        ), kept as (
            select doc_id, count(*) as n_words, cast(sum(gone) as bigint) as n_removed, coalesce(string_agg(case when gone = 0 then word end, ' ' order by i), '') as text from judged group by doc_id
        )
        select own.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from own left join kept on kept.doc_id = own.doc_id
    """,
    "op7_url_filter": r"""
        with parts as (
            select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
        ), split_up as (
            select page_id,
                   translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path
            from parts
        ), rules(h, p, v) as (
            values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
        ), best as (
            select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as v
            from split_up join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
            group by page_id
        )
        select s.page_id, s.host, s.path, b.rule, coalesce(b.v, 'allow') as verdict from split_up s left join best b on s.page_id = b.page_id
    """,
    "op12_prefix_trie": r"""
        with crc as (
            select list_transform(range(256), lambda n: list_reduce([cast(n as bigint), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as t
        ), turns as (
            select conv_id as c, row_number() over (partition by conv_id order by turn nulls first) as i, sha256(coalesce(role, '') || chr(31) || coalesce(text, '')) as turn, length(coalesce(text, '')) as chars
            from conversations where conv_id is not null
        ), own as (
            select c, n, list_reduce(list_prepend(4294967295, list_transform(range(1, length(c::varchar) + 1), lambda j: cast(ord(substr(c::varchar, cast(j as int), 1)) as bigint))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])) as raw
            from (select c, max(i) as n from turns group by c) as sizes, crc
        ), convs as (
            select own.c, own.n, xor(own.raw, 4294967295) % 6 as h, own.c - own.c % 100 as base, coalesce(bases.n, 0) as base_n from own left join own as bases on bases.c = own.c - own.c % 100
        ), rebuilt as (
            select convs.c, i as d, turn, chars from convs join turns on turns.c = base and i <= h
            union all
            select convs.c, i - h + least(h, base_n), turn, chars from convs join turns on turns.c = convs.c and i > h
        ), paths as (
            select convs.c, coalesce(string_agg(turn, '' order by d), '') as path, list_prepend(0, coalesce(list(chars order by d), [])) as chars, count(turn) as size
            from convs left join rebuilt on rebuilt.c = convs.c group by convs.c
        ), steps as (
            select c, path, chars, size, unnest(range(0, size + 1)) as d from paths
        ), nodes as (
            select substr(path, 1, cast(64 * d as int)) as k, d, min(c) as conv_id, count(*) as n_convs, max(chars[d + 1]) as chars, string_agg(case when size = d then c::varchar end, ',' order by c) as ends
            from steps group by 1, 2
        ), kids as (
            select substr(k, 1, cast(64 * (d - 1) as int)) as k, count(*) as n from nodes where d > 0 group by 1
        ), facts as (
            select nodes.*, coalesce(kids.n, 0) as n_children, (n_convs - 1) * chars as saving from nodes left join kids on kids.k = nodes.k
        ), above as (
            select k, n_children, saving, unnest(range(0, d + 1)) as e from facts
        ), subtrees as (
            select substr(k, 1, cast(64 * e as int)) as k, count(case when n_children = 0 then 1 end) as n_leaves, sum(saving) as saved from above group by 1
        )
        select facts.conv_id, facts.d as depth, parents.conv_id as parent_conv_id, facts.n_convs, facts.n_children, n_leaves, cast(saved as bigint) as saved_tokens, sha256(coalesce(facts.ends, '')) as ends_sha256
        from facts join subtrees on subtrees.k = facts.k left join nodes as parents on facts.d > 0 and parents.k = substr(facts.k, 1, cast(64 * (facts.d - 1) as int))
    """,
    "op13_importance": r"""
        with crc as (
            select list_transform(range(256), lambda n: list_reduce([cast(n as bigint), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as t
        ), texts as (
            select doc_id, true as doc, text from documents union all select item_id, false, text from benchmark
        ), cut as (
            select doc_id, doc, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from texts
        ), each as (
            select doc_id, doc, unnest(ws) as a, unnest(range(1, len(ws) + 1)) as i from cut
        ), beside as (
            select doc_id, doc, a, lead(a, 1) over w as b, lead(a, 2) over w as c from each window w as (partition by doc, doc_id order by i)
        ), runs as (
            select doc_id, doc, a as run from beside union all select doc_id, doc, a || ' ' || b from beside where b is not null
            union all select doc_id, doc, a || ' ' || b || ' ' || c from beside where c is not null
        ), known as (
            select run, hex(encode(run)) as h from (select distinct run from runs)
        ), places as (
            select run, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda j: cast('0x' || substr(h, cast(2 * j + 1 as int), 2) as bigint))), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) % 10000 as bucket from known, crc
        ), counted as (
            select bucket, doc, count(*) as n from runs join places using (run) group by 1, 2
        ), sums as (
            select coalesce(sum(n) filter (where doc), 0) as all_s, coalesce(sum(n) filter (where not doc), 0) as all_t from counted
        ), gains as (
            select bucket, cast(floor(1000 * ln((t + 1.0::double) * (all_s + 10000) / ((s + 1.0::double) * (all_t + 10000)))) as bigint) as gain
            from (select bucket, coalesce(sum(n) filter (where doc), 0) as s, coalesce(sum(n) filter (where not doc), 0) as t from counted group by bucket), sums
        ), weighed as (
            select doc_id, count(*) as n_features, sum(gain) as weight from runs join places using (run) join gains using (bucket) where doc group by doc_id
        ), scored as (
            select cut.doc_id, len(ws) as n_words, coalesce(n_features, 0) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
                   cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || substr(sha256('42:' || cut.doc_id::varchar), 1, 8) as bigint) + 0.5::double) / 4294967296))) as bigint) as score
            from cut left join weighed on weighed.doc_id = cut.doc_id where doc
        ), placed as (
            select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as place, count(*) over (partition by n_words >= 20) as n from scored
        )
        select doc_id, n_features, weight, score, case when n_words >= 20 and place <= 5 * n // 100 then place end as rank from placed
    """,
}
