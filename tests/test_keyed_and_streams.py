"""Tables by key, the limiter on a stream and the maintainer of derived columns."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import instruct
from scriptorium.sources.hooks import Collection
from scriptorium.sources.keyed import KeyedTable
from scriptorium.streaming import limits


def rows_of(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def files(path):
    return {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_merged_batches_equal_a_dictionary(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], "at", buckets=8)
    draw, expected = random.Random(1), {}
    assert table.read() is None
    for _ in range(4):
        batch = [(draw.randrange(60), draw.randrange(100), draw.choice("abc")) for _ in range(50)] + [(None, 1, "no key")]
        newest = {}
        for k, at, v in batch:
            newest.setdefault(k, []).append((at, v))
        ties = {k for k, own in newest.items() if len({v for at, v in own if at == max(own)[0]}) > 1}
        batch = [r for r in batch if r[0] not in ties]
        changed = 0
        for k, at, v in sorted(r for r in batch if r[0] is not None and r[1] == max(newest[r[0]])[0]):
            old = expected.get(k)
            if old is None or at >= old[0] and (at, v) != old[:2]:
                changed += 1
                expected[k] = (at, v, 1 if old is None else old[2] + (v != old[1]))
        frame = spark.createDataFrame(batch, "k long, at int, v string")
        assert table.merge(frame) == changed
        assert rows_of(table.read(), "k", "at", "v", "version") == sorted((k, *x) for k, x in expected.items())
        before = files(tmp_path / "t")
        assert table.merge(frame) == 0 and files(tmp_path / "t") == before  # a repeated batch changes nothing


def test_untouched_folders_keep_their_files(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=16)
    table.merge(spark.range(500).selectExpr("id as k", "id * 2 as v"))
    before = files(tmp_path / "t")
    assert table.merge(spark.createDataFrame([(7, 1), (8, 16)], "k long, v long")) == 1  # 8 has what it had
    after = files(tmp_path / "t")
    folder = {p.parent.name for p in before.keys() - after.keys()}
    assert len(folder) == 1 and {p.parent.name for p in after.keys() - before.keys()} == folder
    assert table.read().count() == 500 and table.read().where("k = 7").first()["v"] == 1


def test_order_is_of_its_own_type(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], "at")
    for at, v in ((9, "old"), (10, "new"), (9, "late")):
        table.merge(spark.createDataFrame([(1, at, v)], "k long, at int, v string"))
    assert rows_of(table.read(), "v", "at", "version") == [("new", 10, 2)]
    table.merge(spark.createDataFrame([(1, 20, "new")], "k long, at int, v string"))
    table.merge(spark.createDataFrame([(1, 15, "between")], "k long, at int, v string"))  # older than what is known to hold
    assert rows_of(table.read(), "v", "at", "version") == [("new", 20, 2)]


def test_keys_of_several_columns_and_empty_batches(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["a", "b"], buckets=4)
    schema = "a string, b int, v array<double>"
    table.merge(spark.createDataFrame([], schema))
    table.merge(spark.createDataFrame([("x", 1, [1.0]), ("x", 2, None), ("x", None, [3.0])], schema))
    assert table.merge(spark.createDataFrame([], schema)) == 0
    assert table.merge(spark.createDataFrame([("x", 2, [2.0])], schema)) == 1
    assert rows_of(table.read(), "a", "b", "v") == [("x", 1, [1.0]), ("x", 2, [2.0])]


def test_search_text_is_written_where_it_changed(spark, tmp_path):
    def run(rows):
        spark.createDataFrame(rows, "id long, t string, at int").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long, t string, at int").parquet(str(tmp_path / "in"))
        limits.keep_search_text(stream, F.lower("t"), "id", str(tmp_path / "out"), str(tmp_path / "cp"), "at").awaitTermination(120)
        return rows_of(spark.read.parquet(str(tmp_path / "out")), "id", "search_text", "version")

    assert run([(1, "A", 9), (1, "Z", 8), (2, "B", 3)]) == [(1, "a", 1), (2, "b", 1)]
    assert run([(1, "A", 10), (2, "C", 4), (2, "OLD", 1)]) == [(1, "a", 1), (2, "c", 2)]
    assert run([(2, "LATE", 2), (1, "LATE", 9)]) == [(1, "a", 1), (2, "c", 2)]
    assert run([(1, "TEN", 11)]) == [(1, "ten", 2), (2, "c", 2)]


def limited(spark, tmp_path, batches, most, seconds, **options):
    """What a stream says of requests that come in these batches, one a trigger, and its rows of state after each."""
    schema, state = "event_id long, user_id long, ts timestamp", []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        frame = limits.limit_stream(stream, "user_id", "ts", "event_id", most, seconds, **options)
        query = frame.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        state.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    return {(r["user_id"], r["event_id"]): r["passed"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}, state


@pytest.mark.parametrize("inclusive", [False, True])
def test_stream_equals_replay_with_late_and_expired_keys(spark, tmp_path, inclusive):
    start, draw = dt.datetime(2024, 5, 1), random.Random(4)
    at = lambda s: start + dt.timedelta(seconds=s)
    # Some 40 minutes of requests of five users, which come in three batches, each shuffled; half an hour back is in time.
    events = [(i, draw.randrange(5), at(draw.choice([draw.randrange(2400), 600 * draw.randrange(4)]))) for i in range(150)]
    events.sort(key=lambda e: e[2])
    batches = [events[:60], events[60:110], events[110:]]
    swapped = [batches[0][:-10] + batches[1][:10], batches[0][-10:] + batches[1][10:], batches[2]]
    for b in swapped:
        draw.shuffle(b)
    late = [(900, 1, at(30))]  # an hour and more behind when it comes
    ending = [(901, 99, at(20_000))]
    found, state = limited(spark, tmp_path, [*swapped, ending, [*late, (902, 99, at(40_000))]], 3, 300, inclusive=inclusive, late="30 minutes")
    frame = spark.createDataFrame(events, "event_id long, user_id long, ts timestamp")
    expected = {(r["user_id"], r["event_id"]): r["passed"] for r in limits.replay(frame, "user_id", "ts", "event_id", 3, 300, inclusive=inclusive).collect()}
    found.pop((99, 901), None)  # it waits until the watermark has passed it, which the last batch brings about
    assert found == expected and set(expected.values()) == {True, False}
    assert (1, 900) not in found  # late requests are dropped
    assert max(state[:3]) > 20 and state[-1] <= 4  # nothing is kept of the five users


def test_only_the_limit_of_a_window_passes_on_a_stream(spark, tmp_path):
    start = dt.datetime(2024, 5, 1)
    rows = [(i, 1, start + dt.timedelta(microseconds=i)) for i in range(5000)]
    found, _ = limited(spark, tmp_path, [rows[::-1], [(9999, 2, start + dt.timedelta(hours=5))]], 7, 60)
    assert [e for (u, e), ok in sorted(found.items()) if ok and u == 1] == list(range(7)) and len(found) == 5000


def test_hooks_are_registered_from_outside(spark, tmp_path):
    """Derived columns follow their inputs, and are computed only where one of them differs."""
    schema = "k long, name string, n int"
    c = Collection(KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=4))
    c.before_change("name")(F.trim)
    c.after_change("search", "name")(F.lower)
    c.after_change("size", "search")(F.length)
    assert c.save(spark.createDataFrame([(1, " Ana", 1), (2, None, 2)], schema)) == 2
    assert rows_of(c.table.read(), "k", "name", "search", "size", "version") == [(1, "Ana", "ana", 3, 1), (2, None, None, None, 1)]
    assert c.save(spark.createDataFrame([(1, "Ana  ", 1)], schema)) == 0
    # A hook that says when it is computed: only where its input has changed.
    c.after_change("search", "name")(lambda name: F.concat(F.lower(name), F.lit("!")))
    assert c.save(spark.createDataFrame([(1, "Ana", 9), (2, "Iva", 2), (3, "Eva", 3)], schema)) == 3
    assert rows_of(c.table.read(), "k", "search", "size", "version") == [(1, "ana", 3, 2), (2, "iva!", 4, 2), (3, "eva!", 4, 1)]
    with pytest.raises(ValueError):
        c.after_change("search", "search")


def test_templates_are_registered_from_outside(spark):
    rows = spark.createDataFrame([(1, "Sud", "P-1", None, "", "kratko", "Ana"), (2, "", "P-2", "1.1.2024.", "E:1", " s" * 20, None)], "k long, court string, c string, date string, ecli string, summary string, judge string")
    templates = {**instruct.TEMPLATES, "judge": instruct.Template(("case", "judge"), "Tko je sudio u {case}?", "U {case} sudio je {judge}.")}
    found = rows_of(instruct.template_pairs(rows, "k", "court", "c", "date", "ecli", "summary", templates, judge="judge"), "k", "pos", "answer")
    assert found == [(1, 0, "Predmet P-1 donesen je u Sud."), (1, 4, "U P-1 sudio je Ana."), (2, 1, "Odluka u predmetu P-2 donesena je 1.1.2024.."), (2, 2, "Predmet P-2 ima ECLI: E:1."), (2, 3, ("s " * 20).strip())]
