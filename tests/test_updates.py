"""Versions in buckets, points in time, online feedback and sketches, against plain models."""

import datetime as dt
import random
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F
from tessera.operators import knowledge as K
from tessera.operators.learning import folded
from tessera.operators.pointintime import in_force
from tessera.operators.sketches import estimates, merged, sketched
from tessera.sources.versions import Versions
from tessera.streaming.feedback import current_weights, learnt_online, start_learning

DOC = "doc_id string, text string, tags array<string>, status string, supersedes string"


def doc(k, text="t", old=None, status="active"):
    return (k, text, [text[:1]], status, old)


def rows(df):
    return sorted(df.select("doc_id", "text", "tags", "status", "supersedes").collect(), key=str)


def test_versions_equal_whole_tables(spark, tmp_path):
    rng = random.Random(5)
    store, whole = Versions(spark, str(tmp_path / "v"), buckets=8), None
    for step in range(6):
        ids = rng.sample(range(40), 12)
        batch = spark.createDataFrame([doc(f"d{k}", f"text {step} {k}", rng.choice([None, None, f"d{rng.randrange(40)}"])) for k in ids], DOC)
        whole = kept(spark, tmp_path / f"w{step}", K.retire(batch) if whole is None else K.ingest(whole, batch))
        assert store.upsert(batch) == step
        assert rows(store.read()) == rows(whole)
    gone = spark.createDataFrame([(f"d{k}",) for k in range(0, 40, 3)], "doc_id string")
    store.delete(gone)
    assert rows(store.read()) == rows(K.delete(whole, gone))
    assert rows(store.read(5)) == rows(whole)
    # All come back, active and naming nobody: no edge is left of those that did.
    back = spark.createDataFrame([doc(f"d{k}", "again") for k in range(40)], DOC)
    store.upsert(back)
    assert {r.status for r in store.read().collect()} == {"active"}


def kept(spark, path, df):
    df.write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "v"), buckets=32)
    store.upsert(spark.createDataFrame([doc(f"d{k}") for k in range(500)], DOC))
    first = store.manifest()
    batch = spark.createDataFrame([doc("d7", "new", old="d8")], DOC)
    assert store.upsert(batch) == 1
    changed = {b for b, f in store.manifest().items() if f != first[b]}
    assert 1 <= len(changed) <= 2 and {r.doc_id for r in store.read(1).where("status = 'superseded'").collect()} == {"d8"}
    written = list((tmp_path / "v" / "data" / "v=1").rglob("*.parquet"))
    assert {int(p.parent.name.split("=")[1]) for p in written} == changed
    # The same batch again changes nothing and makes no version; with a number it does, but writes no rows.
    assert store.upsert(batch) == 1 and store.numbers() == [0, 1]
    assert store.upsert(batch, number=4) == 4 and store.manifest(4) == store.manifest(1)
    assert not (tmp_path / "v" / "data" / "v=4").exists()
    # A batch that restores an active status is a change: nothing else names d8.
    assert store.upsert(spark.createDataFrame([doc("d7", "new")], DOC)) == 5
    assert store.upsert(spark.createDataFrame([doc("d8")], DOC)) == 6
    assert store.read().where("status = 'superseded'").count() == 0


def test_a_version_without_its_manifest_does_not_exist(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "v"), buckets=4)
    store.upsert(spark.createDataFrame([doc("a")], DOC))
    (tmp_path / "v" / "manifest" / "v=1").mkdir()  # a writer that was lost
    assert store.numbers() == [0]
    assert store.upsert(spark.createDataFrame([doc("b")], DOC)) == 1 and store.read().count() == 2


def test_versions_refuse_what_has_no_meaning(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "v"))
    with pytest.raises(LookupError):
        store.read()
    with pytest.raises(LookupError):
        store.delete(spark.createDataFrame([("a",)], "doc_id string"))
    for bad in ([doc("a"), doc("a", "other")], [doc(None)]):
        with pytest.raises(ValueError, match="null or repeated"):
            store.upsert(spark.createDataFrame(bad, DOC))
    assert store.upsert(spark.createDataFrame([], DOC)) == 0 and store.read().count() == 0
    store.upsert(spark.createDataFrame([doc("a")], DOC))
    with pytest.raises(ValueError, match="other columns"):
        store.upsert(spark.createDataFrame([("a", "active", None, 1)], "doc_id string, status string, supersedes string, extra int"))


def test_stream_of_documents_into_buckets(spark, tmp_path):
    import json

    from tessera.streaming.ingest import start_versioned_ingest

    arriving, store = tmp_path / "in", Versions(spark, str(tmp_path / "v"), buckets=4)
    arriving.mkdir()
    line = lambda k, text, **more: json.dumps({"doc_id": k, "domain": "technical", "title": "T", "text": text, **more})
    for n, lines in enumerate([[line("a", "one"), line("b", "two")], [line("a", "three"), line("c", "four", supersedes="b"), line(None, "no id")]]):
        (arriving / f"{n}.json").write_text("\n".join(lines))
        q = start_versioned_ingest(store, str(arriving), str(tmp_path / "c"))
        q.awaitTermination()
        assert q.exception() is None
    assert store.numbers() == [0, 1]
    assert sorted((r.doc_id, r.text, r.status) for r in store.read().collect()) == [("a", "three", "active"), ("b", "two", "superseded"), ("c", "four", "active")]
    assert sorted((r.doc_id, r.text) for r in store.read(0).collect()) == [("a", "one"), ("b", "two")]


@pytest.mark.parametrize("width", [3600, 86400 * 5, 86400 * 4000])
def test_in_force_equals_bisection(spark, width):
    rng = random.Random(width)
    day = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 90))
    versions = [(rng.choice(["x", "x", "x", "y", None]), day() if rng.random() > 0.05 else None, k) for k in range(300)]
    versions += [(k, e, i + 1000) for k, e, i in versions[:40]]  # ties of key and moment
    asked = [(n, rng.choice(["x", "x", "y", "z", None]), day() if rng.random() > 0.05 else None) for n in range(400)]
    asked += asked[:25]  # repeated questions
    got = in_force(spark.createDataFrame(asked, "n int, key string, on timestamp"), spark.createDataFrame(versions, "key string, since timestamp, id int"), ["key"], "on", "since", ["id"], ["id", "since"], width)
    assert got.columns == ["n", "key", "on", "id", "since"]
    held = {}
    for k, e, i in versions:
        if k is not None and e is not None:
            held[k, e] = max(i, held.get((k, e), -1))
    want = []
    for n, k, on in asked:
        times = sorted(e for key, e in held if key == k)
        at = bisect_right(times, on) if k is not None and on is not None else 0
        want.append((n, k, on, held[k, times[at - 1]], times[at - 1]) if at else (n, k, on, None, None))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_in_force_over_nothing(spark):
    q, v = spark.createDataFrame([], "key int, on date"), spark.createDataFrame([], "key int, since date, id int")
    assert in_force(q, v, ["key"], "on", "since", ["id"], ["id"]).count() == 0
    one = spark.createDataFrame([(1, dt.date(2024, 5, 1))], "key int, on date")
    assert [tuple(r) for r in in_force(one, v, ["key"], "on", "since", ["id"], ["id"]).collect()] == [(1, dt.date(2024, 5, 1), None)]


EVENT = "user string, at timestamp, id int, step double"


def test_online_feedback_over_batches(spark, tmp_path):
    rng = random.Random(3)
    start = dt.datetime(2024, 3, 1)
    events = sorted((start + dt.timedelta(seconds=rng.randrange(6 * 3600)), k, rng.choice(["hot", "hot", "a", "b"]), rng.choice([0.08, 0.02, -0.08])) for k in range(900))
    source = tmp_path / "in"
    spark.createDataFrame([], EVENT).write.parquet(str(source))
    late = (start, 5000, "a", 0.5)  # comes when the watermark is hours past it
    batches = [events[:300], events[300:600], [*events[600:], late], [(start + dt.timedelta(hours=30), 6000, "end", 0.0)]]
    for n, batch in enumerate(batches):
        rng.shuffle(batch)
        spark.createDataFrame([(u, at, k, s) for at, k, u, s in batch], EVENT).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(EVENT).parquet(str(source))
        query = start_learning(learnt_online(stream, ["user"], "step", "at", ["id"], "10 minutes", "30 minutes"), str(tmp_path / "t"), str(tmp_path / "c"))
        query.awaitTermination()
        assert query.exception() is None
    table = spark.read.parquet(str(tmp_path / "t"))
    assert table.where("user = 'hot'").count() >= 3, "weights move as time goes on"
    got = {r.user: (r.events, round(r.value, 9)) for r in current_weights(table, ["user"]).collect()}
    whole = spark.createDataFrame([(u, at, k, s) for at, k, u, s in events], EVENT)
    counts = {r.user: r["count"] for r in whole.groupBy("user").count().collect()}
    assert got == {r.user: (counts[r.user], round(r.value, 9)) for r in folded(whole, ["user"], "step", ["at", "id"]).collect()}


def test_sketches_by_day_merge_within_bounds(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/events.parquet").withColumn("day", F.col("ts").cast("date"))
    daily = sketched(e, ["day"], "value", "event_id")
    p = {"p10": 0.1, "p50": 0.5, "p95": 0.95}
    got = estimates(merged(daily.withColumn("one", F.lit(1)), ["one"]), ["one"], p).first()
    values = sorted(r.value for r in e.select("value").collect() if r.value is not None)
    assert (got.n, got.least, got.greatest) == (len(values), values[0], values[-1])
    for name, share in p.items():
        assert abs(bisect_right(values, got[name]) / len(values) - share) < 0.03
    assert abs(got.distinct_members - e.select("event_id").distinct().count()) < 0.06 * len(values)
    none = estimates(merged(sketched(e.where("false"), ["day"], "value", "event_id"), ["day"]), ["day"], p)
    assert none.count() == 0
    nulls = spark.createDataFrame([("k", None, None), ("k", None, "m")], "k string, v double, m string")
    assert [tuple(r) for r in estimates(sketched(nulls, ["k"], "v", "m"), ["k"], {"p50": 0.5}).collect()] == [("k", 0, None, None, None, None, 1)]


def test_whole_rows_move_once(spark, tmp_path):
    """Rows, ids that go and ids that are retired meet in one exchange; joins see ids, status and digests alone."""
    store = Versions(spark, str(tmp_path / "v"), buckets=8)
    plans, write = [], store._write

    def seen(folder, part, paths, changed, rows):
        plans.append((part, rows._jdf.queryExecution().executedPlan().toString()))
        write(folder, part, paths, changed, rows)

    store._write = seen
    store.upsert(spark.createDataFrame([doc(f"d{k}", "text " * 50, f"d{k + 1}" if k % 3 == 0 else None) for k in range(20)], DOC))
    store.upsert(spark.createDataFrame([doc(f"d{k}", "other", f"d{k + 1}" if k % 4 == 0 else None) for k in range(5, 25)], DOC))
    store.delete(spark.createDataFrame([("d3",), ("d8",)], "doc_id string"))
    whole = [p for part, p in plans if part == 0]
    assert len(whole) == 3 and all(p.count("Exchange") == 1 and "Join" not in p for p in whole)
    assert {r.doc_id: r.status for r in store.read().collect()} == {f"d{k}": "superseded" if k in (1, 4, 9, 13, 17, 21) else "active" for k in range(25) if k not in (3, 8)}
