"""Operators without SQL, on rows whose results were worked out by hand."""

import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.operators import chunking, corpus, instruct, retrieval, site, verification
from scriptorium.sources import settings as settings_file
from scriptorium.sources import tables
from scriptorium.streaming import limits


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_slug(spark):
    assert one(spark, X.slug(F.col("t")), t="Županijski sud u Đakovu") == "zupanijski-sud-u-dakovu"


def test_normalized_composes(spark):
    assert one(spark, X.normalized(F.col("t")), t="  Č  Š\n") == "č š"


def test_boilerplate(spark):
    text = "Narodne novine\nKLASA: 1\n12\nIV.\n\n\n\n(1) Sadržaj.\n"
    assert one(spark, X.without_boilerplate(F.col("t")), t=text) == "(1) Sadržaj."
    assert one(spark, X.without_boilerplate(F.col("t")), t="HRVATSKI SABOR") == "HRVATSKI SABOR"


def test_sentences_keep_abbreviations(spark):
    text = "Prema čl. 5. ZKP vrijedi to. Drugo! [1] Treće? ne"
    assert one(spark, X.sentences(F.col("t")), t=text) == ["Prema čl. 5. ZKP vrijedi to.", "Drugo!", "[1] Treće? ne"] or one(spark, X.sentences(F.col("t")), t=text)[0].startswith("Prema čl. 5.")


def test_verdicts(spark):
    assert one(spark, X.verdict(F.col("t")), t="unsupported") == "UNSUPPORTED"
    assert one(spark, X.verdict(F.col("t"), legacy=True), t="unsupported") == "SUPPORTED"
    assert one(spark, X.verdict(F.col("t")), t="?") == "PARSE_ERROR"


def test_case_numbers_differ_by_use(spark):
    assert one(spark, F.regexp_extract_all("t", F.lit(X.LOOKUP_CASE_NUMBER), F.lit(0)), t="Gž R-130/2024-2") == ["Gž R-130/2024-2"]
    assert one(spark, F.regexp_extract_all("t", F.lit(X.CASE_NUMBER), F.lit(0)), t="Gž R-130/2024-2") == ["R-130/2024-2"]


def test_reply_is_cut_and_refusals_are_seen(spark):
    assert one(spark, X.until_marker(F.col("t")), t=" Da. \n--- END CONTEXT ---\nx") == "Da."
    assert one(spark, X.is_refusal(F.col("t")), t="Na to NE MOGU odgovoriti") is True


@pytest.mark.parametrize("value, base", [(0, 0.0), (497.92, 6.64), (1_000_000, 663.61), (4979.20, 51.45)])
def test_fee_base(spark, value, base):
    assert one(spark, site.cents(site.fee_base(F.lit(float(value))))) == pytest.approx(base)


def test_fee(spark):
    rows = spark.createDataFrame([(1e6, "civil_judgment"), (10.0, "nothing"), (-1.0, "civil_appeal")], "v double, k string")
    assert [r["fee"] for r in site.with_fee(rows, "v", "k").orderBy(F.desc("v")).collect()] == [1327.22, None, None]


def fixed(spark, text):
    return one(spark, chunking.fixed_pieces(F.col("t")), t=text)


def test_fixed_pieces(spark):
    assert fixed(spark, " \u00a0 ") == [] and fixed(spark, "") == []
    assert fixed(spark, "a" * 2000) == ["a" * 2000]
    assert [len(p) for p in fixed(spark, "a" * 4000)] == [2000, 2000, 400]
    # A blank line in the second half ends a piece; the next begins 200 before it. One in the first half does not.
    found = fixed(spark, "a" * 1500 + "\n\n" + "b" * 2000)
    assert found == ["a" * 1500, "a" * 200 + "\n\n" + "b" * 1798, "b" * 402]
    assert [len(p) for p in fixed(spark, "a" * 900 + "\n\n" + "b" * 2000)] == [2000, 1102]
    assert fixed(spark, "a" * 1990 + "\n\n" + "b" * 150) == ["a" * 1990, "a" * 200 + "\n\n" + "b" * 150]
    # A last piece of fewer than 200 goes.
    assert [len(p) for p in fixed(spark, "a" * 1500 + " " * 500 + "c" * 50)] == [1500]
    assert "".join(p[-1800:] if i else p for i, p in enumerate(fixed(spark, "xyz" * 40_000)[:-1])).startswith("xyz")


def test_fixed_pieces_come_from_the_text(spark):
    draw = random.Random(3)
    texts = ["".join(draw.choice(["a", "b ", "\n", "\n\n"] + ["word "] * 9) for _ in range(draw.randint(0, 3000))) for _ in range(60)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunking.fixed_pieces(F.col("t")).alias("p")).collect()
    assert all(p in r["t"] and len(p) <= 2000 and (len(p) >= 200 or len(r["t"]) <= 2000) for r in rows for p in r["p"])
    assert all(sum(map(len, r["p"])) >= 0.7 * len(r["t"].strip()) for r in rows if len(r["t"]) > 4000)


def test_paragraph_chunks(spark):
    text = "\n\n".join(["a" * 300, "b" * 300, "c" * 3000, "d" * 100])
    frame = spark.createDataFrame([(1, text), (2, "short")], "id long, text string")
    rows = chunking.paragraph_chunks(frame).orderBy("chunk_index").collect()
    assert [(r["id"], len(r["chunk"])) for r in rows] == [(1, 602), (1, 3102)]


def split(spark, text):
    return [(p["number"], p["body"]) for p in one(spark, chunking.articles(F.col("t")), t=text)]


def test_articles(spark):
    body = "x" * 200
    text = f"{'Uvod ' * 50}\n\nNaslov članka\nČlanak 1.\n{body}\n\nČlanak 2a.\nkratko"
    opening = "Uvod " * 50
    # The heading stands in front of its article and still ends what comes before it.
    assert split(spark, text) == [(None, f"{opening}\n\nNaslov članka"), ("1", f"Naslov članka\nČlanak 1.\n{body}")]
    assert split(spark, "ništa") == [(None, "ništa")]
    # A short opening goes; an article's number may have a letter; indented; without a full stop.
    assert split(spark, f"Uvod\n  Članak\u00a012b \n{body}") == [("12b", f"Članak\u00a012b \n{body}")]
    # What is directly behind the number belongs to it: no second article starts there.
    assert [n for n, _ in split(spark, f"Članak 1\nČlanak 2.\n{body}")] == ["1"]


@pytest.mark.parametrize(
    "before, title",
    [
        ("tekst.\n\nPrvi naslov\nDrugi naslov\n", "Prvi naslov\nDrugi naslov"), ("Još jedan red\nPrvi naslov\nDrugi naslov", "Prvi naslov\nDrugi naslov"), ("Kraj rečenice.\nNaslov ovdje\n", "Naslov ovdje"),
        ("Vidi i čl. 3. st.\n", "Vidi i čl. 3. st."), ("(1) stavak jedan\n", ""), ("1 stavak jedan\n", ""), ("Naslov\n\n\n", "Naslov"), ("abcd\n", ""), ("a" * 81, ""), ("", ""),
    ],
)
def test_heading(spark, before, title):
    assert one(spark, chunking.heading(F.col("t")), t=before) == title


def test_long_article_repeats_its_header(spark):
    parts = one(spark, chunking.long_parts(F.col("t")), t="Članak 5.\n" + "x" * 8000)
    assert [len(p) for p in parts] == [3500, 3500, 1030] and all(p.startswith("Članak 5.\n") for p in parts)
    # At the last blank line of the second half; without a header; a header too long to repeat.
    assert one(spark, chunking.long_parts(F.col("t")), t="a" * 2000 + "\n\n" + "b" * 3000) == ["a" * 2000, "b" * 3000]
    assert [len(p) for p in one(spark, chunking.long_parts(F.col("t")), t="a" * 1000 + "\n\n" + "b" * 3000)] == [3500, 502]
    assert [len(p) for p in one(spark, chunking.long_parts(F.col("t")), t=f"Članak{' ' * 2000}5.\n" + "x" * 3000)] == [3500, 1509]


def test_rich_text(spark):
    tree = json.dumps({"root": {"children": [{"text": "a"}, {"children": [{"text": " b "}, {"text": " "}]}]}})
    assert one(spark, tables.rich_text(F.col("t")), t=tree) == "a b"
    assert one(spark, tables.rich_text(F.col("t")), t="{") == ""


def test_html_text(spark):
    html = "<body><nav>n</nav><p>a<b>b</b></p><main><script>s</script> c <br>d</main></body>"
    assert one(spark, tables.html_text(F.col("t")), t=html) == "c\nd"
    assert tables.page_text("<div class='x clanak-txt'>q</div><main>w</main>") == "q"


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"source": "s", "source_id": "1", "text": "t"}\n\n{bad\n')
    assert tables.json_lines(spark, [str(tmp_path / "a.json")], tables.RAW_DOCUMENT, strict=False).count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.json_lines(spark, [str(tmp_path / "a.json")], tables.RAW_DOCUMENT).collect()


def test_ranked_files(spark, tmp_path):
    for folder, sources in (("b", "xyz"), ("a", "pq")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.json").write_text("".join(json.dumps({"source": s, "source_id": "1"}) + "\n" for s in sources))
    rows = tables.ranked_files(spark, [str(tmp_path / "b" / "*.json"), str(tmp_path / "a" / "same.json")], tables.RAW_DOCUMENT)
    assert "".join(r["source"] for r in rows.orderBy(*tables.FILE_ORDER).collect()) == "xyzpq"
    assert corpus.first_of(rows, ["source_id"], tables.FILE_ORDER).first()["source"] == "x"


def test_line_sinks_count(spark, tmp_path):
    rows, path = spark.range(5), str(tmp_path / "out")
    assert (tables.append_lines(rows, path), tables.append_lines(rows.limit(2), path), spark.read.json(path).count()) == (5, 2, 7)
    assert (tables.replace_lines(rows.limit(0), path), tables.append_lines(rows.limit(1), path), spark.read.json(path).count()) == (0, 1, 1)


def test_evaluation_is_saved(spark, tmp_path):
    rows = spark.createDataFrame([("answered", 1.0, 0.5, 2, 1, 1, False), ("refused_by_model", None, 0.0, None, None, None, None)], "status string, retrieval_recall double, entity_recall double, n_claims int, n_supported int, n_unsupported int, faithful boolean")
    assert tables.save_evaluation(rows, verification.summary(rows), str(tmp_path), model="m", k=6) == 2
    summary = spark.read.json(str(tmp_path / "summary")).first()
    assert (summary["n"], summary["answered"], summary["supported"], summary["model"], summary["k"]) == (2, 0.5, 0.5, "m", 6)


def test_settings(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("db:\n  host: h\n  password_env: SECRET\n  user_env: NONE\nlist: [1]\n")
    assert settings_file.load(spark, str(tmp_path / "c.yaml"), {"SECRET": "s"}) == {"db": {"host": "h", "password_env": "SECRET", "user_env": "NONE", "password": "s", "user": ""}, "list": [1]}


def test_joined_text(spark):
    tree = json.dumps({"children": [{"text": "a", "children": [{"text": "lost"}]}, {"children": [{"text": " b "}, {"x": 1}, ["c", "d"]]}]})
    assert one(spark, tables.joined_text(F.col("t")), t=tree) == "a\n b \n\nc\nd"
    assert [one(spark, tables.joined_text(F.col("t")), t=t) for t in ("{", '"s"', "3", "[]")] == ["", "s", "", ""]


def test_law_page(spark):
    html = "<body><p>x</p><div id='TexteOnly'>Zakon<script>s</script></div><main>m</main></body>"
    assert one(spark, tables.html_text(F.col("t"), tables.LAW_CONTENT), t=html) == "Zakon"
    assert one(spark, tables.html_text(F.col("t"), tables.LAW_CONTENT), t="<main>m</main>") == "m"


def test_one_bad_pdf_page_is_empty(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|!|three")
    read = lambda b: [(lambda t=t: t if t != "!" else 1 / 0) for t in b.decode().split("|")]
    assert tables.pdf_texts(spark, str(tmp_path), read).first()["text"] == "one\n\n\n\nthree"


def test_answers_from_retrieval_to_status(spark):
    passages = ["Rok je 8 dana prema P-1/2020.", "Žalba se podnosi sudu."]
    asked = spark.createDataFrame([(i, f"pitanje {i}", passages) for i in range(7)], "query_id long, query string, passages array<string>")
    gates = spark.createDataFrame([(i, i != 0) for i in range(6)], "query_id long, confident boolean")
    replies = ["", None, "Ne mogu odgovoriti na to.", "Rok je osam dana prema P-1/2020 [1].\n---\nPitanje: x", "Rok je osam dana prema P-9/2020 [1].", "Ovo je netočna tvrdnja o roku [2]."]
    model = lambda query, context: F.get(F.array(*map(F.lit, replies)), F.regexp_extract(query, "(\\d+)", 1).cast("int"))
    judge = lambda sentence, evidence: F.when(F.contains(sentence, F.lit("netočna")), "UNSUPPORTED").otherwise(F.when(F.contains(evidence, F.lit("8 dana")), "SUPPORTED"))
    rows = {r["query_id"]: r for r in verification.answered(asked, gates, model, judge).collect()}
    assert [rows[i]["status"] for i in range(7)] == ["refused_low_retrieval", "llm_error", "refused_by_model", "answered", "flagged", "flagged_nli", "refused_low_retrieval"]
    assert [i for i in range(7) if rows[i]["trustworthy"]] == [3] and (rows[3]["answer"], rows[3]["n_supported"]) == ("Rok je osam dana prema P-1/2020 [1].", 1)
    assert {r["status"] for r in verification.answered(asked.where("query_id = 5"), gates, model).collect()} == {"answered"}


def test_three_buckets(spark):
    sources = spark.createDataFrame([(i, "legislation", f"t{i}", "", f"tekst izvora {i} " * 60) for i in range(40)], "source_id long, source_type string, title string, author string, text string")
    questions = spark.createDataFrame([(i, i % 45, f"Što piše u {i}?", f"odgovor {i}") for i in range(200)], "question_id long, source_id long, question string, answer string")
    rows = instruct.bucket_rows(questions, sources, "b").collect()
    assert len(rows) == 200 and {r["bucket"] for r in rows} == {"grounded", "refusal", "naked"}
    for r in rows:
        own = r["question_id"] % 45
        blocks = r["user"].split("--- END CONTEXT ---")[0].split("\n\n")
        if r["bucket"] == "naked":
            assert (r["user"], r["assistant"], r["slot"]) == (f"Što piše u {r['question_id']}?", f"odgovor {r['question_id']}", None)
            continue
        assert len(blocks) == 6 and [b.lstrip("- CONTEX\n")[:3] for b in blocks] == [f"[{n}]" for n in range(1, 7)]
        assert [n for n, b in enumerate(blocks, 1) if f"izvora {own} " in b] == ([r["slot"]] if r["bucket"] == "grounded" else [])
        assert r["assistant"] == (instruct.REFUSAL if r["bucket"] == "refusal" else f"odgovor {r['question_id']}")


def test_geojson(spark, tmp_path):
    square = [[[0, 0], [2, 0], [2, 2], [0, 2]]]
    features = [{"properties": {"jurisdictionName": n}, "geometry": {"type": t, "coordinates": c}} for n, t, c in (("A", "Polygon", square), ("B", "MultiPolygon", [square]))]
    (tmp_path / "f.json").write_text(json.dumps({"features": features}))
    read = tables.features(spark, str(tmp_path / "f.json"))
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 1.0)], "id long, x double, y double")
    assert [(r["id"], r["ord"]) for r in site.located(points, read, "id", "x", "y").collect()] == [(1, 0)]


def test_pdf_reader_errors_give_no_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    (tmp_path / "b.pdf").write_bytes(b"\xff")
    rows = tables.pdf_texts(spark, str(tmp_path), lambda b: b.decode("ascii").split("|")).orderBy("path").collect()
    assert [(r["text"], r["pages"]) for r in rows] == [("one\n\ntwo", 2), ("", 0)]


def test_rrf(spark):
    a = spark.createDataFrame([(1, 5, 3.0, 0), (1, 6, 1.0, 3)], "query_id long, id long, bm25_score double, bm25_rank int")
    b = spark.createDataFrame([(1, 5, 0.9, 0)], "query_id long, id long, dense_score double, dense_rank int")
    assert {r["id"]: r["fused_score"] for r in retrieval.fused(a, b).collect()} == {5: round(2 / 60, 6), 6: round(1 / 63, 6)}


def test_bm25_without_tokens_still_ranks(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (2, None), (3, "cc")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "!"), (2, "bb bb")], "query_id long, query string")
    rows = retrieval.top_bm25(retrieval.build_lexical(docs), asked, 2).collect()
    assert sorted((r["query_id"], r["bm25_rank"], r["id"]) for r in rows) == [(1, 0, 3), (1, 1, 2), (2, 0, 1), (2, 1, 3)]


def test_lexical_index_is_built_anew_the_dense_one_kept_unless_forced(spark, tmp_path):
    path, letters = str(tmp_path / "i"), lambda texts: np.array([[t.count(c) for c in "abc"] for t in texts], float)
    first, second = (spark.createDataFrame([(1, t), (2, None)], "id long, text string") for t in ("aa bb", "cc"))
    for frame in (first, second):
        retrieval.build_lexical(frame, "id").save(path)
    assert [r["term"] for r in retrieval.LexicalIndex.load(spark, path).terms.collect()] == ["cc"]
    assert [retrieval.save_dense(f, path, letters, force=force) for f, force in ((first, False), (second, False), (second, True))] == [True, False, True]
    assert {r["id"]: r["embedding"] for r in spark.read.parquet(f"{path}/dense").collect()} == {1: [0, 0, 1], 2: [0, 0, 0]}


def test_saved_index_scores_as_the_built_one(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"t{(i * k) % 17}" for k in range(i % 9))) for i in range(60)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "t3 t5 t5"), (2, "t1"), (3, "nothing")], "query_id long, query string")
    index = retrieval.build_lexical(docs)
    index.save(str(tmp_path / "i"))
    built, saved = (sorted(map(tuple, retrieval.top_bm25(i, asked, 5).collect())) for i in (index, retrieval.LexicalIndex.load(spark, str(tmp_path / "i"))))
    assert built == saved and len(built) == 15


def test_dense_search_in_blocks_equals_brute_force(spark, monkeypatch):
    draw = np.random.default_rng(1)
    every = draw.normal(size=(90, 8)).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(every)] + [(90, None), (91, every[3].tolist())]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    asked = vectors.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    found = {(r["query_id"], r["dense_rank"]): r["id"] for r in retrieval.top_dense(vectors, asked, 5).collect()}
    held = [(i, np.array(v)) for i, v in rows if v]
    for q in range(0, 90, 7):
        best = sorted((-round(float(v @ every[q]), 6), i) for i, v in held)[:5]
        assert [found[q, n] for n in range(5)] == [i for _, i in best]
    assert len(found) == 14 * 5  # id 91 asks too


def test_exact_hits_in_the_query_order(spark):
    docs = spark.createDataFrame([(1, "P-1/2020"), (2, "Gž R-2/2021"), (3, "P-1/2020")], "id long, case_number string")
    asked = spark.createDataFrame([(1, "Usporedi Gž  R-2/2021 i P-1/2020.")], "query_id long, query string")
    assert [r["id"] for r in retrieval.exact_hits(docs, asked).orderBy("exact_pos").collect()] == [2, 1]


def test_verification(spark):
    frame = spark.createDataFrame([("Vidi [1] [9].", ["a"])], "answer string, passages array<string>")
    row = verification.with_verification(frame).first()
    assert (row["cited"], row["invalid"], row["citations_valid"], row["entities_grounded"]) == ([1], [9], False, True)


@pytest.mark.parametrize("sources, n", [(300, 4), (3, 4), (5, 4), (1, 2), (0, 2)])
def test_distractors_are_others_and_as_many_as_there_are(spark, sources, n):
    rows = spark.range(sources).select(F.col("id").alias("question_id"), F.col("id").alias("source_id"))
    asked = rows.union(spark.createDataFrame([(1000, 1000), (1001, None)], "question_id long, source_id long"))
    found = instruct.distractors(asked, rows.select("source_id"), n, "s").collect()
    for q in [*range(sources), 1000, 1001]:
        own = sorted((r["pos"], r["source_id"]) for r in found if r["question_id"] == q)
        assert [p for p, _ in own] == list(range(min(n, sources - (q < sources)))) and len({i for _, i in own} - {q}) == len(own)


def test_contradiction(spark):
    changed = one(spark, instruct.contradicted(F.col("t"), "s", F.lit(1)), t="kazna 2 do 5 godina, 1 do 9 godina")
    assert changed.endswith(", 1 do 9 godina") and not changed.startswith("kazna 2 do 5 ")


def test_limits():
    passes = [limits.accepted(None, 0, 1, 10, inclusive=False)[1]]
    assert passes == [True]
    assert limits.accepted((0, 1), 10, 1, 10, inclusive=False) == ((0, 1), False)
    assert limits.accepted((0, 1), 10, 1, 10, inclusive=True) == ((10, 1), True)


@given(st.lists(st.integers(0, 100), max_size=40), st.integers(1, 5))
@settings(max_examples=50, deadline=None)
def test_no_window_passes_more(times, most):
    window, passed = None, {}
    for t in sorted(times):
        window, ok = limits.accepted(window, t, most, 10, inclusive=False)
        passed[window[0]] = passed.get(window[0], 0) + ok
    assert all(n <= most for n in passed.values())


def test_points_by_bands_equal_brute_force(spark):
    draw = random.Random(6)
    rings = [[[[draw.uniform(0, 10), draw.uniform(0, 10)] for _ in range(draw.randint(3, 9))]] for _ in range(12)]
    table = spark.createDataFrame([(i, [r]) for i, r in enumerate(rings)], "ord int, coordinates array<array<array<array<double>>>>")
    spots = [(i, draw.uniform(-1, 11), draw.uniform(-1, 11)) for i in range(300)]
    points = spark.createDataFrame(spots, "id long, x double, y double")

    def inside(ring, x, y):
        odd = False
        for (xi, yi), (xj, yj) in zip(ring, [ring[-1], *ring[:-1]], strict=True):
            odd ^= (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi) + xi
        return odd

    want = {i: min([n for n, r in enumerate(rings) if inside(r[0], x, y)], default=None) for i, x, y in spots}
    found = {r["id"]: r["ord"] for r in site.located(points, table, "id", "x", "y").collect()}
    assert found == {i: n for i, n in want.items() if n is not None} and len(found) > 100
    assert site.located(points, table.limit(0), "id", "x", "y").count() == 0


def test_contact_trap(spark):
    rows = spark.createDataFrame([("x", ["name"]), ("", ["name"]), (None, []), ("", [])], "trap string, errors array<string>")
    assert [r["o"] for r in rows.select(site.contact_outcome(F.col("trap"), F.col("errors")).alias("o")).collect()] == ["dropped", "rejected", "sent", "sent"]


def test_global_search_outlives_a_broken_source(spark):
    good = spark.createDataFrame([(1, "Ana"), (2, "Iva")], "id long, name string")
    found = site.global_search({"good": (good, "id", ["name"]), "broken": (good, "id", ["title"])}, "an")
    assert [(r["type"], r["title"]) for r in found.collect()] == [("good", "Ana")]
