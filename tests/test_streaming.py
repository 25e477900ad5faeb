import datetime as dt
import json

import pytest

from wardline.streaming import ingest as I
from wardline.streaming import state

GOOD = "Diabetes and heart disease were seen in many patients. The stroke rate was low. Insulin helped. " * 4


def test_ingest_adds_new_and_changed_documents_once(spark, tmp_path):
    src, target, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    src.mkdir()
    put = lambda name, rows: (src / name).write_text("\n".join(json.dumps({"doc_id": i, "source": "s", "content": t}) for i, t in rows))
    run = lambda: I.ingest(spark, str(src), "doc_id string, source string, content string", target, mark)
    put("1.json", [("a", GOOD), ("b", GOOD + "More."), ("short", "too short"), ("a", GOOD)])
    run()
    assert {r.doc_id for r in spark.read.parquet(target).collect()} == {"a", "b"}
    put("2.json", [("a", GOOD), ("b", GOOD + "Changed text."), ("c", GOOD + "New.")])
    run()
    run()
    rows = spark.read.parquet(target)
    assert sorted(r.doc_id for r in rows.collect()) == ["a", "b", "b", "c"]
    now = {r.doc_id: r.content for r in I.current(spark, target).collect()}
    assert set(now) == {"a", "b", "c"} and now["b"].endswith("Changed text.")


def test_asof_against_brute_force(spark):
    import random

    rng = random.Random(2)
    base = dt.datetime(2024, 1, 1)
    when = lambda: base + dt.timedelta(minutes=rng.randint(0, 20000))
    left = [(i, rng.choice("hhhx"), when()) for i in range(200)]
    right = list({(k, t): (k, t, i) for i, (k, t) in enumerate([(rng.choice("hhhy"), when()) for _ in range(150)])}.values())
    got = I.asof(spark.createDataFrame(left, "i int, k string, t timestamp"), spark.createDataFrame(right, "k string, t timestamp, v int"), "k", "t", "v").collect()
    for r in got:
        before = [(t, v) for k, t, v in right if k == r.k and t <= r.t]
        assert r.v == (max(before)[1] if before else None)
    assert len(got) == 200


def test_ranges(spark):
    points = spark.createDataFrame([(float(x),) for x in range(0, 100, 3)], "x double")
    ranges = spark.createDataFrame([(1, 0.0, 10.0), (2, 5.0, 95.0), (3, 7.0, 7.0)], "r int, lo double, hi double")
    got = {(r.x, r.r) for r in I.in_ranges(points, ranges, "x", "lo", "hi", 8.0).collect()}
    assert got == {(float(x), r) for x in range(0, 100, 3) for r, lo, hi in ((1, 0, 10), (2, 5, 95), (3, 7, 7)) if lo <= x < hi}


def test_late_windows_run_on_a_stream(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, h), "t", 1.0) for h in range(10)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "e"))
    events = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    q = I.windowed(events, "2 hours", late="1 hour").writeStream.format("memory").queryName("late_windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("late_windows").count() >= 3


def test_a_document_that_returns_to_an_older_content_is_current_again(spark, tmp_path):
    src, target, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    src.mkdir()
    for n, text in enumerate([GOOD, GOOD + "Changed text.", GOOD, GOOD]):
        (src / f"{n}.json").write_text(json.dumps({"doc_id": "a", "source": "s", "content": text}))
        I.ingest(spark, str(src), "doc_id string, source string, content string", target, mark)
    assert [r.content for r in I.current(spark, target).collect()] == [GOOD.strip()]
    assert spark.read.parquet(target).count() == 3


@pytest.fixture
def deliver(spark, tmp_path):
    """Adds rows to a folder and runs a stream over it to its end; what came out by then."""
    def go(rows, schema, change, name="s"):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/{name}-in")
        with state.keyed_store(spark):
            stream = change(spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}-in"))
            stream.writeStream.format("parquet").option("path", f"{tmp_path}/{name}-out").option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{tmp_path}/{name}-out")

    return go


def test_versions_against_a_plain_loop(spark, deliver):
    """Random deliveries in six restarts of the stream, with late ones, repeats and several a batch."""
    import random

    rng, base = random.Random(7), dt.datetime(2024, 1, 1)
    last, want = {}, []
    for n in range(6):
        rows = [(rng.choice(["a", "b", "c", "d", None]), rng.choice("xyz"), base + dt.timedelta(hours=24 * n + rng.randint(-40, 20))) for _ in range(rng.randint(1, 9))]
        best = {}
        for d, h, at in rows:
            best[d] = max(best.get(d, (at, h)), (at, h))
        for d, (at, h) in best.items():
            if d in last and at < last[d][1]:
                continue
            if d not in last or last[d][0] != h:
                want.append((d, h, at, "changed" if d in last else "new"))
            last[d] = (h, at)
        got = deliver(rows, "doc_id string, hash string, at timestamp", state.track)
        assert sorted([(r.doc_id, r.hash, r.at, r.change) for r in got.collect()], key=str) == sorted(want, key=str)
    changes = got.collect()
    numbers = {(r.doc_id, r.version) for r in changes}
    assert len(numbers) == len(changes) and all(r.replaces is None or (r.doc_id, r.replaces) in numbers for r in changes)


def test_documents_not_seen_for_long_expire(spark, deliver):
    day = lambda n: dt.datetime(2024, 1, 1 + n)
    change = lambda s: state.track(s, late="0 seconds", ttl_seconds=3 * 86400)
    schema = "doc_id string, hash string, at timestamp"
    deliver([("a", "1", day(0)), ("b", "1", day(0))], schema, change)
    deliver([("b", "1", day(2))], schema, change)
    got = deliver([("c", "1", day(4))], schema, change)
    assert sorted((r.doc_id, r.change) for r in got.collect()) == [("a", "expired"), ("a", "new"), ("b", "new"), ("c", "new")]
    got = deliver([("a", "1", day(9)), ("a", "2", day(1))], schema, change)  # a comes again; its older version is late
    assert sorted((r.doc_id, r.change) for r in got.collect()) == [("a", "expired"), ("a", "new"), ("a", "new"), ("b", "expired"), ("b", "new"), ("c", "expired"), ("c", "new")]


@pytest.mark.parametrize("buckets", [1, 5])
def test_state_is_kept_by_bucket(spark, tmp_path, deliver, buckets):
    """Many documents, few values in the store; keys may be null, NaN or bytes, and those of a bucket expire one by one."""
    day = lambda n: dt.datetime(2024, 1, 1 + n)
    nan, schema = float("nan"), "doc_id double, hash string, at timestamp"
    change = lambda s: state.track(s, late="0 seconds", ttl_seconds=3 * 86400, buckets=buckets)
    keys = [None, nan, *map(float, range(200))]
    deliver([(k, "1", day(0)) for k in keys], schema, change)
    deliver([(k, "2" if k == 7 else "1", day(2)) for k in [None, nan, 7.0, 8.0]], schema, change)
    got = deliver([(-1.0, "1", day(4))], schema, change)
    some = [str(r.doc_id) for r in got.where("change = 'expired'").collect()]
    assert sorted(some) == sorted(str(float(k)) for k in range(200) if k not in (7, 8))
    assert got.where("change <> 'expired'").groupBy("change").count().orderBy("change").collect() == [("changed", 1), ("new", 203)]
    rows = spark.read.format("statestore").load(f"{tmp_path}/s-state", stateVarName="kept")
    assert rows.count() <= buckets
    for _ in range(2):
        out = deliver([(bytes([1, n]), "1", day(0)) for n in range(9)], "doc_id binary, hash string, at timestamp", lambda s: state.track(s, buckets=buckets), "b")
    assert out.count() == 9


def test_schedules_call_sources_when_due(spark, deliver):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    schema = "source string, every_seconds long, at timestamp"
    deliver([("a", 6 * 3600, at(0)), ("b", 24 * 3600, at(0)), ("clock", None, at(0))], schema, state.due_updates)
    deliver([("clock", None, at(25))], schema, state.due_updates)
    got = deliver([("a", 0, at(26)), ("b", 12 * 3600, at(26)), ("clock", None, at(26))], schema, state.due_updates)
    got = deliver([("clock", None, at(51)), ("x", -1, at(51))], schema, state.due_updates)
    assert sorted((r.source, r.due) for r in got.collect()) == [*[("a", at(h)) for h in (6, 12, 18, 24)], ("b", at(24)), ("b", at(38)), ("b", at(50))]


def test_expired_documents_are_not_current(spark, tmp_path):
    src, target, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    src.mkdir()
    for n, (i, day) in enumerate([("a", 1), ("b", 3), ("a", 4), ("c", 20)]):
        (src / f"{n}.json").write_text(json.dumps({"doc_id": i, "source": "s", "content": GOOD + f"Text {n} here.", "day": f"2024-01-{day:02d}"}))
        I.ingest(spark, str(src), "doc_id string, source string, content string, day string", target, mark, at="day", ttl_seconds=5 * 86400, late="0 seconds")
    for few in (0, 100):
        assert [(r.doc_id, r.content[-12:]) for r in I.current(spark, target, few).collect()] == [("c", "Text 3 here.")]
    assert spark.read.parquet(target).groupBy("change").count().orderBy("change").collect() == [("changed", 1), ("expired", 2), ("new", 3)]
