"""Where filters, redirects, sitemaps, pins and dense search against brute force."""

import datetime as dt
import random
import re
import xml.etree.ElementTree as ET

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.functions.text import jaccard, trigrams
from scriptorium.operators import listing, publishing, retrieval, site
from scriptorium.operators.listing import FilterError

SCHEMA = "id long, name string, n int, price double, at timestamp, day date, ok boolean, tags array<string>, place struct<city:string>"
ROWS = [
    (1, "Ana Horvat", 5, 1.5, dt.datetime(2024, 1, 2), dt.date(2024, 1, 2), True, ["a", "b"], ("Split",)),
    (2, "Iva Ana", None, 2.5, None, None, False, [], ("Zagreb",)),
    (3, None, 7, None, dt.datetime(2025, 1, 2, 3), dt.date(2025, 1, 2), None, None, None),
    (4, "hor", 5, 0.0, dt.datetime(2023, 6, 1), dt.date(2023, 6, 1), True, ["b"], (None,)),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("tree, ids", [
    ({}, [1, 2, 3, 4]), ({"n": {"equals": "5"}}, [1, 4]), ({"n": {"not_equals": 5}}, [2, 3]), ({"name": {"like": "ANA  hor"}}, [1]), ({"name": {"contains": "a h"}}, [1]),
    ({"n": {"in": "5,7"}}, [1, 3, 4]), ({"n": {"not_in": [5]}}, [2, 3]), ({"n": {"in": []}}, []), ({"n": {"exists": "false"}}, [2]), ({"tags": {"in": ["a", "x"]}}, [1]),
    ({"tags": {"all": "a,b"}}, [1]), ({"tags": {"not_in": ["a"]}}, [2, 3, 4]), ({"place.city": {"equals": "Split"}}, [1]), ({"ok": {"equals": True}}, [1, 4]),
    ({"at": {"gte": "2024-01-01", "lt": "2025-01-01"}}, [1]), ({"day": {"lte": "2024-01-02"}}, [1, 4]), ({"price": {"greater_than": 0}}, [1, 2]), ({"n": {"equals": None}}, [2]),
    ({"or": [{"n": {"equals": 7}}, {"and": [{"name": {"like": "ana"}}, {"price": {"gt": "2"}}]}]}, [2, 3]), ({"and": []}, [1, 2, 3, 4]), ({"or": []}, [1, 2, 3, 4]),
])
def test_filters(rows, tree, ids):
    assert sorted(r["id"] for r in rows.where(listing.where(rows.schema, tree)).collect()) == ids


@pytest.mark.parametrize("tree", [
    {"x": {"equals": 1}}, {"n": {"near": 1}}, {"n": {"equals": "five"}}, {"n": 5}, {"and": {"n": 5}}, {"name": {"all": "a"}}, {"n": {"like": "5"}}, {"tags": {"equals": "a"}},
    {"place.street": {"equals": "a"}}, {"ok": {"equals": "maybe"}}, {"day": {"gt": "soon"}}, {"n": {"gt": [1]}}, [], {"n": {}}, {"id; drop": {"equals": 1}},
])
def test_filters_that_cannot_be_read(rows, tree):
    with pytest.raises(FilterError):
        listing.where(rows.schema, tree)


def test_query_strings():
    text = "page=2&where[or][1][n][gte]=5&where[or][0][name][like]=Ana+H%25&where[date][gte]=2024-01-01"
    assert listing.from_query_string(text) == {"or": [{"name": {"like": "Ana H%"}}, {"n": {"gte": "5"}}], "date": {"gte": "2024-01-01"}}
    with pytest.raises(FilterError):
        listing.from_query_string("where[or][x][n][equals]=1")


def test_filters_reach_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    tree = {"o_totalprice": {"gte": "1000"}, "o_orderstatus": {"in": "F,P"}, "o_orderdate": {"lt": "1996-01-01"}}
    spark.conf.set("spark.sql.maxMetadataStringLength", 2_000)
    plan = orders.where(listing.where(orders.schema, tree)).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan)[1]
    assert all(x in pushed for x in ("GreaterThanOrEqual(o_totalprice", "In(o_orderstatus", "LessThan(o_orderdate"))


def test_pages_of_a_list(rows):
    assert [r["id"] for r in listing.listing(rows, {}, "id", "-n,name", 1, 3).collect()] == [3, 1, 4]
    assert [r["id"] for r in listing.listing(rows, {}, "id", "-n,name", 2, 3).collect()] == [2]
    with pytest.raises(FilterError):
        listing.listing(rows, {}, "id", "-nothing")


def test_redirects_equal_walking(spark):
    draw = random.Random(3)
    steps = {i: i + 1 for i in range(1000)}  # a chain of 1,000
    steps |= {i: draw.randrange(2000, 4300) for i in range(2000, 4000)}
    steps |= {5000: 5001, 5001: 5002, 5002: 5000, 5003: 5001, 5004: 5004}
    steps |= {i: 1000 for i in range(6000, 6500)}  # many to one
    found = {r["old"]: (r["target"], r["hops"], r["state"]) for r in publishing.resolved(spark.createDataFrame([*steps.items(), (None, 1), (7, None)], "old long, new long")).collect()}
    assert found.keys() == steps.keys()
    for old in steps:
        at, hops, seen = old, 0, set()
        while at in steps and at not in seen:
            seen.add(at)
            at, hops = steps[at], hops + 1
        assert found[old] == ((None, None, "cycle") if at in steps else (at, hops, "ok"))
    assert publishing.resolved(spark.createDataFrame([], "old long, new long")).count() == 0


def test_sitemaps_hold_every_page_once(spark):
    urls = [f"https://x.hr/{i % 700}?a=1&b=<{i % 3}>" for i in range(2000)] + ["", None]
    pages = spark.createDataFrame([(u, f"2024-01-{1 + i % 28:02d}T00:00") for i, u in enumerate(urls)], "url string, changed string").repartition(5)
    files = sorted(publishing.sitemap(pages, "url", "changed", most=300).collect())
    known = sorted({u for u in urls if u})
    assert [f["entries"] for f in files] == [300] * (len(known) // 300) + [len(known) % 300] * (len(known) % 300 > 0)
    space = "{http://www.sitemaps.org/schemas/sitemap/0.9}"
    assert [u.findtext(f"{space}loc") for f in files for u in ET.fromstring(f["xml"].encode())] == known
    first = ET.fromstring(files[0]["xml"].encode())[0]
    assert first.findtext(f"{space}lastmod") == max(f"2024-01-{1 + i % 28:02d}" for i, u in enumerate(urls) if u == known[0])
    index = publishing.sitemap_index(publishing.sitemap(pages, "url", most=300), "https://x.hr/sitemap-{}.xml").first()["xml"]
    assert [s[0].text for s in ET.fromstring(index.encode())] == [f"https://x.hr/sitemap-{f['file']}.xml" for f in files]


def test_pins_add_up(spark):
    draw = random.Random(5)
    points = [(i, draw.uniform(42, 46.5), draw.uniform(13.5, 19.4)) for i in range(300)] + [(900, None, 15.0), (901, 89.0, 15.0), (902, 45.0, 15.0), (903, 45.0, 15.0)]
    pins = publishing.clustered(spark.createDataFrame(points, "id long, lat double, lon double"), "id", "lat", "lon", 9).collect()
    for zoom in range(10):
        own = [p for p in pins if p["zoom"] == zoom]
        assert sum(p["n"] for p in own) == 302 and all((p["key"] is not None) == (p["n"] == 1) for p in own)
        tiles = {}
        for i, lat, lon in points:
            if lat is not None and lat < 86:
                x, y = int((lon + 180) / 360 * 2**zoom), int((1 - np.log(np.tan(np.radians(lat)) + 1 / np.cos(np.radians(lat))) / np.pi) / 2 * 2**zoom)
                tiles.setdefault((x, y), []).append((i, lat, lon))
        assert {(p["x"], p["y"]): (p["n"], p["lat"], p["lon"]) for p in own} == {t: (len(m), pytest.approx(np.mean([p[1] for p in m]), abs=1e-6), pytest.approx(np.mean([p[2] for p in m]), abs=1e-6)) for t, m in tiles.items()}


@pytest.mark.parametrize("sent", [32, 0])
def test_dense_search_of_many_queries(spark, monkeypatch, sent):
    """3,000 queries in blocks, sent or shuffled, against all products; ties by id; null and repeated vectors."""
    monkeypatch.setattr(retrieval, "SENT_BLOCKS", sent)
    draw = np.random.default_rng(1)
    known, asked = np.round(draw.normal(size=(500, 8)), 2), np.round(draw.normal(size=(3000, 8)), 2)
    known[200:260] = known[100]
    rows = [(i, v.tolist()) for i, v in enumerate(known)] + [(9999, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    exact = np.array(vectors.where("vec_id < 9999").orderBy("vec_id").select("embedding").toPandas()["embedding"].tolist(), np.float64)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)] + [(7777, None)], "query_id long, query_vector array<double>")
    top = retrieval.top_dense(vectors, queries, 5)
    assert top._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2  # vectors once, queries once
    found = {}
    for r in top.collect():
        found.setdefault(r["query_id"], []).append((r["dense_rank"], r["id"], r["dense_score"]))
    scores = np.round(asked @ exact.T, 6)
    assert len(found) == 3000
    for q in range(0, 3000, 7):
        best = np.lexsort((np.arange(500), -scores[q]))[:5]
        own = sorted(found[q])
        assert [x[1] for x in own] == best.tolist() and [x[2] for x in own] == pytest.approx(scores[q][best].tolist(), abs=2e-6)
    assert retrieval.top_dense(vectors.limit(0), queries, 5).count() == 0 and retrieval.top_dense(vectors, queries.limit(0), 5).count() == 0


@pytest.mark.parametrize("least", [0.3, 0.8])
def test_similar_pairs_equal_all_pairs(spark, least):
    draw = random.Random(8)
    names = ["".join(draw.choice(["an", "iv", "šo", "ba", " ", "le"]) for _ in range(draw.randrange(1, 7))) for _ in range(160)] + ["", None, "ana", "ana", "   "]
    rows = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    grams = {r["id"]: set(r["g"] or []) for r in rows.select("id", trigrams(F.col("name")).alias("g")).collect()}
    asked = [i for i in grams if i % 4 == 0]
    expected = {(i, j): round(len(grams[i] & grams[j]) / len(grams[i] | grams[j]), 6) for i in asked for j in grams if grams[i] & grams[j]}
    found = {(r["asked_key"], r["key"]): r["similarity"] for r in site.similar_pairs(rows.where("id % 4 = 0"), rows, "name", "id", least).collect()}
    assert found == {p: s for p, s in expected.items() if s >= least} and len(found) > 40


def test_headline_cuts_each_text_once(spark):
    texts = [" ".join(f"w{i}" for i in range(40)) + " (That), and that " + "z " * 20, "no such word", "That's that", "", None, "  that"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", site.headline(F.col("t"), "that").alias("h"))
    # Cut again for each of its words, a text cost its length times thirty.
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    found = {r["id"]: r["h"] for r in frame.collect()}
    assert found[0] == " ".join(f"w{i}" for i in range(25, 40)) + " <mark>(That),</mark> and that " + " ".join("z" * 12)
    assert [found[i] for i in range(1, 6)] == ["no such word", "That's <mark>that</mark>", "", None, "<mark>that</mark>"]


def test_similar_pairs_compare_a_name_once(spark, monkeypatch):
    names = ["blue ring", "blue rings", "old gear", "hot plate"]
    rows = spark.range(4000).select("id", F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 4 + 1).cast("int")).alias("name"))
    compared = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(_):
        compared.add(1)
        return 0

    monkeypatch.setattr(site, "jaccard", lambda a, b: jaccard(a, b) + counted(a))
    found = site.similar_pairs(rows.where("id % 50 = 0"), rows, "name", "id", 0.5).groupBy(F.col("asked_key") % 4, F.col("key") % 4).count()
    # Of 80 rows asked for two names have 40 each, the others none; one has a name that is much like it.
    assert sorted(map(tuple, found.collect())) == [(0, 0, 40_000), (0, 1, 40_000), (2, 2, 40_000)]
    assert 0 < compared.value <= 20
