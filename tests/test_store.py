from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from halyard.functions.encode import hashing_encoder
from halyard.operators import catalog as C
from halyard.operators import index as N
from halyard.sources import files
from halyard.sources.index_store import SCHEMA, IndexStore, format_file, parse_file, read_files, write_files
from halyard.sources.state import State
from halyard.streaming.index_stream import CATALOG, cancel, catalog_stream, reconcile, start
from halyard.streaming.queue import after_failure, claim, queue_status, reclaim


def at(s):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)


@pytest.fixture
def items(spark):
    rows = [(1, "a", "A", at(0.5)), (2, "b", " ", at(1.0)), (3, None, "x", at(2.0)), (4, "a", "late", at(2.9)), (5, "a", None, at(2.2))]
    return spark.createDataFrame(rows, "id long, bucket_id string, bucket_name string, date_added timestamp")


def ids(df):
    return [r["id"] for r in df.collect()]


def test_scans(items):
    mark = int(at(1.9).timestamp() * 1000)
    assert ids(C.scan_all(items)) == [4, 5, 2, 1]
    assert ids(C.scan_albums(items, ["b"])) == [2]
    assert ids(C.scan_new(items, [], mark)) == [5, 4]  # rows of the mark's own second are not new
    assert ids(C.scan_new(items, [], 0)) == [4, 5, 2, 1]
    assert ids(C.scan_new_or_all(items, [], int(at(99).timestamp() * 1000))) == [4, 5, 2, 1]


def test_albums(spark, items):
    albums = C.album_rollup(items)
    assert [tuple(r) for r in albums.collect()] == [("a", "late", 3), ("b", "Unnamed album", 1)]
    kept = C.kept_selection(spark.createDataFrame([("b",), ("zz",)], "id string"), albums)
    assert {r["id"]: r["selected"] for r in C.album_flags(albums, kept).collect()} == {"a": False, "b": True}


def test_chunks(spark):
    df = spark.range(103).select((F.lit(1000) - F.col("id")).alias("id"))
    out = {r["id"]: r["chunk"] for r in C.numbered(df, ["id"], 4).collect()}
    assert out == {1000 - i: (102 - i) // 4 for i in range(103)}
    ties = spark.createDataFrame([(i, None if i < 3 else i % 2) for i in range(11)], "id int, k int")
    out = {r["id"]: r["chunk"] for r in C.numbered(ties, ["k", "id"], 4).collect()}
    order = sorted(range(11), key=lambda i: (i >= 3, i % 2 if i >= 3 else 0, i))
    assert out == {i: n // 4 for n, i in enumerate(order)}


def vec(*x):
    return [float(v) for v in x]


def test_store_versions(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    assert store.load().count() == 0
    store.save(spark.createDataFrame([("a", vec(1, 0), 1), ("b", vec(0, 1), 1), ("zero", vec(0, 0), 1), (None, vec(1), 1)], SCHEMA))
    assert sorted(r["uri"] for r in store.load().collect()) == ["a", "b"]
    store.checkpoint(spark.createDataFrame([("b", vec(0, 2), 2), ("c", vec(3, 0), 1)], SCHEMA))
    before = {r["uri"]: r["embedding"] for r in store.snapshot().collect()}
    store.compact()
    assert {r["uri"]: r["embedding"] for r in store.load().collect()} == before == {"a": [1, 0], "b": [0, 2], "c": [3, 0]}


def test_upsert_keeps_the_rest(spark):
    old = spark.createDataFrame([("a", vec(1), 1), ("b", vec(1), 5)], SCHEMA)
    new = spark.createDataFrame([("a", vec(2), 1), ("b", vec(2), 4), ("c", vec(2), 0)], SCHEMA)
    assert {r["uri"]: r["embedding"][0] for r in N.upsert(old, new).collect()} == {"a": 2.0, "b": 1.0, "c": 2.0}
    bad = N.quarantine(spark.createDataFrame([("", vec(1), 1), ("x", vec(0), 1), ("y", vec(1), 1), ("z" * 5000, vec(1), 1)], SCHEMA))
    assert sorted(r["reason"] for r in bad.collect()) == ["bounds", "bounds", "vector"]


def test_single_file_format(spark, tmp_path):
    rows = [("content://é/1", [1.0, -2.5]), ("b", [0.25])]
    raw = format_file(rows)
    assert parse_file(raw) == rows
    for broken in (raw[:-1], b"", raw[:4] + b"\0\0\0\7" + raw[8:], b"x" * 40, raw[:12] + np.array([9999], ">i4").tobytes() + raw[16:]):
        assert parse_file(broken) is None
    (tmp_path / "good.bin").write_bytes(raw)
    (tmp_path / "bad.bin").write_bytes(raw[:-3])
    out = read_files(spark, str(tmp_path)).collect()
    assert sorted(r["uri"] or "-" for r in out) == ["-", "b", "content://é/1"]
    assert (tmp_path / "bad.bin").exists()


def test_state(spark, tmp_path):
    state = State(spark, str(tmp_path / "state"))
    assert tuple(state.read().first()) == ([], 0, 0)
    state.write(selected_albums=["a"], last_indexed_ms=5)
    state.write(threads=4)
    assert tuple(state.read().first()) == (["a"], 5, 4)


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for n in ("a.JPG", "sub/b.webp", "c.txt", "d.png.bak"):
        (tmp_path / n).write_bytes(b"x")
    found = [r["path"].rsplit("/", 1)[1] for r in files.find_images(spark, str(tmp_path)).orderBy("path").collect()]
    assert found == ["a.JPG", "b.webp"] and files.find_images(spark, str(tmp_path), 1).count() == 1
    graph = spark.createDataFrame([('[{"node": "n1", "op_type": "Conv", "inputs": ["x", "w"]}]',)], "value string")
    assert [tuple(r) for r in files.model_graph(graph).collect()] == [("n1", "Conv", ["x", "w"])]
    a = files.noise(spark, 3, 5, seed=1, normal=True).collect()
    assert a == files.noise(spark, 3, 5, seed=1, normal=True).repartition(3).orderBy("id").collect()
    files.write_report(spark.createDataFrame([("q", float("nan"))], "query string, best_score double"), str(tmp_path / "report"))
    assert "NaN" in "".join(r["value"] for r in spark.read.text(str(tmp_path / "report")).collect())
    (tmp_path / "t.json").write_text('{"do_normalize": false}')
    text = files.read_text(spark, str(tmp_path / "t.json"))
    assert text.select(files.do_normalize("value")).first()[0] is False
    assert bytes(files.read_bytes(spark, str(tmp_path / "t.json")).first()["content"]).startswith(b"{")


def test_stream_equals_rebuild(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    rows = [(f"u{i}", f"word{i} thing", at(i)) for i in range(30)]
    late = ("late", "older than the last run", at(-5))
    for part in (rows[:20], rows[10:] + [late]):
        spark.createDataFrame(part, CATALOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        start(catalog_stream(spark, str(tmp_path / "in")), store, hashing_encoder, str(tmp_path / "ck")).awaitTermination()
    assert {r["uri"] for r in store.snapshot().collect()} == {r[0] for r in rows} | {"late"}
    assert store.snapshot().count() == 31


def test_stream_takes_items_of_any_age(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    months = 90 * 86_400
    for part in ([("new", "a thing", at(0)), ("new", "a thing", at(1))], [("old", "other thing", at(-months)), ("new", "a thing", at(0))], [("older", "third thing", at(-2 * months)), (None, "no uri", at(0))]):
        spark.createDataFrame(part, CATALOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        start(catalog_stream(spark, str(tmp_path / "in"), 1), store, hashing_encoder, str(tmp_path / "ck")).awaitTermination()
    assert sorted(r["uri"] for r in store.pending().collect()) == ["new", "old", "older"]


def test_queue(spark):
    rows = [(1, 2, "PENDING", at(0), 0, at(0)), (2, 0, "PENDING", at(5), 3, at(0)), (3, 0, "PROCESSING", at(1), 0, at(0)), (4, 0, "PROCESSING", at(1), 0, at(900)), (5, 0, "PENDING", at(1), 0, at(0))]
    q = spark.createDataFrame(rows, "media_id long, priority int, status string, created timestamp, retries int, heartbeat timestamp")
    assert [r["media_id"] for r in claim(q, 2).collect()] == [5, 2]
    assert [r["media_id"] for r in claim(q, 2, F.lit(at(1000))).collect()] == [3, 5]
    assert {r["media_id"]: r["status"] for r in reclaim(q, F.lit(at(1000))).collect()} == {1: "PENDING", 2: "PENDING", 3: "PENDING", 4: "PROCESSING", 5: "PENDING"}
    out = {r["media_id"]: (r["status"], r["retries"]) for r in after_failure(q, q.filter("media_id in (1, 2)")).collect()}
    assert out[1] == ("PENDING", 1) and out[2] == ("FAILED", 4) and out[5] == ("PENDING", 0)


def test_queue_stream(spark, tmp_path):
    from halyard.plans.streams import run_once

    events = [(1, "added", at(0)), (1, "claimed", at(1)), (2, "claimed", at(2)), (2, "failed", at(3)), (3, "claimed", at(3000)), (3, "done", at(3001))]
    df = spark.createDataFrame(events, "media_id long, event string, ts timestamp").coalesce(1)
    df.filter("media_id < 3").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    first = run_once(queue_status(stream), "update", str(tmp_path / "ck"))
    assert {(r["media_id"], r["status"], r["retries"]) for r in first.collect()} == {(1, "PROCESSING", 0), (2, "PENDING", 1)}
    df.filter("media_id = 3").write.mode("append").parquet(str(tmp_path / "in"))
    later = run_once(queue_status(stream), "update", str(tmp_path / "ck"))
    last = {r["media_id"]: r["status"] for r in later.collect()}
    assert last[3] == "DONE" and last.get(1) == "PENDING"  # silent for ten minutes of event time


def test_reconcile_drops_what_is_gone_or_edited(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    rows = [(f"u{i}", [1.0, float(i)], 0) for i in range(6)]
    store.save(spark.createDataFrame(rows[:4], SCHEMA))
    store.checkpoint(spark.createDataFrame(rows[4:], SCHEMA))
    alive = spark.createDataFrame([(f"u{i}",) for i in (0, 1, 2, 4, 4)], "uri string")
    stamps = spark.createDataFrame([("u0", 5, 5), ("u1", 7, 5), ("u2", None, 3), ("u9", 1, 2)], "uri string, modified long, indexed long")
    reconcile(store, alive, stamps)
    assert {r["uri"] for r in store.snapshot().collect()} == {"u0", "u4"}


def test_a_running_stream_is_cancelled(spark, tmp_path):
    spark.createDataFrame([("u", "words", at(0))], CATALOG).write.parquet(str(tmp_path / "in"))
    store = IndexStore(spark, str(tmp_path / "index"))
    assert not cancel(spark, "to-cancel")
    q = start(catalog_stream(spark, str(tmp_path / "in")), store, hashing_encoder, str(tmp_path / "checkpoint"), name="to-cancel", once=False, interval="1 hour")
    assert cancel(spark, "to-cancel") and not q.isActive


def test_a_damaged_store_is_not_an_empty_one(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    assert store.load().count() == 0 and store.pending().count() == 0
    (tmp_path / "index" / "current").mkdir(parents=True)
    (tmp_path / "index" / "current" / "part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer|file"):
        store.load().count()


def test_single_files_are_written_and_read(spark, tmp_path):
    rows = [(i % 3, f"ü{i}", [float(i), -0.5]) for i in range(9)]
    write_files(spark.createDataFrame(rows, "file long, uri string, embedding array<float>"), str(tmp_path / "files"))
    assert sorted((r["uri"], list(r["embedding"])) for r in read_files(spark, str(tmp_path / "files")).collect()) == sorted((u, v) for _, u, v in rows)
