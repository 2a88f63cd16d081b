"""Catalog, index, vector, quantisation, queue and progress queries."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import image as I
from halyard.functions import text as X
from halyard.functions import vectors as V
from halyard.operators import catalog as C
from halyard.operators import evaluate as E
from halyard.operators import index as N
from halyard.operators import quant as Q
from halyard.operators import search as S
from halyard.plans.retrieval import rounded
from halyard.plans.tables import CATALOG, catalog, shared, table, vectors
from halyard.sources import files, state
from halyard.sources.index_store import put_bytes, read_files, write_files
from halyard.streaming import progress as P
from halyard.streaming import queue as W

#: An index run's mark: the first ten days of the events and some milliseconds.
MARK_MS = 1_704_844_800_456


def stamped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("date_added", F.unix_micros("date_added"))


def full_scan(spark: SparkSession, d: str) -> DataFrame:
    return stamped(C.scan_all(catalog(spark, d)))


def album_scan(spark: SparkSession, d: str) -> DataFrame:
    return stamped(C.scan_albums(catalog(spark, d), ["view", "click"]))


def incremental_scan(spark: SparkSession, d: str) -> DataFrame:
    return stamped(C.scan_new(catalog(spark, d), ["view", "error"], MARK_MS))


def album_rollup(spark: SparkSession, d: str) -> DataFrame:
    return C.album_rollup(catalog(spark, d))


def album_selection(spark: SparkSession, d: str) -> DataFrame:
    albums = C.album_rollup(catalog(spark, d))
    stored = spark.createDataFrame([("view",), ("gone",), ("error",)], "id string")
    flags = C.album_flags(albums, C.kept_selection(stored, albums))
    return flags.select("id", X.album_label("name", "n").alias("label"), "selected")


def selection_summary(spark: SparkSession, d: str) -> DataFrame:
    c = catalog(spark, d).groupBy("bucket_id").agg(F.count(F.lit(1)).alias("n"))
    return c.select("bucket_id", X.summary_text("n", F.size(F.filter(F.array("bucket_id"), lambda x: x.isNotNull()))).alias("summary"), X.visible_text(F.col("n") % 3).alias("visible"), X.found_text(F.col("n") % 60).alias("found"))


def chunks_of_four(spark: SparkSession, d: str) -> DataFrame:
    return C.numbered(catalog(spark, d).select("id", "date_added"), ["date_added", "id"], 4).select("id", "chunk")


def list_diff(spark: SparkSession, d: str) -> DataFrame:
    c = catalog(spark, d)
    return C.change_set(c.filter("id % 3 = 0"), c.filter("id % 5 = 0"))


TAKEN = ("ECONOMY", "ECONOMY_2", "STANDARD_1", "STANDARD_2", "PROMO_7", "SMALL_01")


def unique_names(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name"))
    return C.unique_names(wanted, spark.createDataFrame([(x,) for x in TAKEN], "name string")).select("id", "unique_name")


def unique_names_mixed(spark: SparkSession, d: str) -> DataFrame:
    """Some rows want what numbering would make of others' names."""
    k = F.col("p_partkey")
    name = F.concat("p_type", F.when(k % 7 == 0, "_1").when(k % 11 == 0, "_1_2").when(k % 13 == 0, "_3").otherwise(""))
    wanted = table(spark, d, "part").select(k.alias("id"), name.alias("name"))
    return C.unique_names(wanted, spark.createDataFrame([(x,) for x in TAKEN], "name string"))


def scan_backfill(spark: SparkSession, d: str) -> DataFrame:
    """After a mark within the events there are new rows; after one behind them all, nothing is, and all are scanned."""
    c = catalog(spark, d)
    parts = [C.scan_new_or_all(c, ["view", "error"], since).select(F.lit(name).alias("mark"), "id") for name, since in (("within", MARK_MS), ("behind", 4_000_000_000_000))]
    return parts[0].unionByName(parts[1])


def items(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select(F.concat(F.lit("item/"), F.col("vec_id").cast("string")).alias("uri"), "embedding", F.col("label").cast("long").alias("version"))


def names(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    return catalog(spark, d).filter(where).select(F.concat(F.lit("item/"), F.col("id").cast("string")).alias("uri"))


def unindexed_images(spark: SparkSession, d: str) -> DataFrame:
    return N.unindexed(names(spark, d), items(spark, d))


def cached_index(spark: SparkSession, d: str) -> DataFrame:
    return N.cached(items(spark, d), names(spark, d, "bucket_id = 'view'")).select("uri", "version")


def deletion_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return N.gone(items(spark, d), names(spark, d, "bucket_id is not null")).select("uri")


def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Every vector has a new one of version 5; labels are the old versions."""
    fresh = items(spark, d).withColumn("version", F.lit(5).cast("long")).withColumn("embedding", F.reverse("embedding"))
    out = N.build(items(spark, d), fresh)
    return out.select("uri", "version", F.round(F.element_at("embedding", 1).cast("double"), 5).alias("first"))


def index_file(spark: SparkSession, d: str) -> DataFrame:
    """All vectors written in the single-file format, a file for each label, and read back; one file is damaged."""
    folder = shared(spark, "index-file")
    rows = vectors(spark, d).select(F.col("label").alias("file"), F.concat(F.lit("item/"), F.col("vec_id").cast("string")).alias("uri"), "embedding")
    write_files(rows.filter("embedding is not null"), folder)
    put_bytes(spark, f"{folder}/damaged.bin", b"GSIX and no more")
    back = read_files(spark, folder)
    return back.select("uri", F.coalesce(F.size("embedding"), F.lit(0)).cast("long").alias("n"), F.round(V.total(F.transform("embedding", lambda x: x.cast("double"))), 5).alias("total"))


def edit_detection(spark: SparkSession, d: str) -> DataFrame:
    c = catalog(spark, d)
    old = c.select("id", F.unix_micros("date_added").alias("modified"))
    now = c.select("id", (F.unix_micros("date_added") + F.when(F.col("id") % 10 == 0, 5).otherwise(0)).alias("modified"))
    return N.edited(old, now, "id")


def record_bounds(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).select(F.repeat(F.lit("u"), (F.col("vec_id") * 20).cast("int")).alias("uri"), F.when(F.col("vec_id") % 9 != 0, F.col("embedding")).alias("embedding"), "vec_id")
    return rows.select("vec_id", N.in_bounds().alias("in_bounds"))


def vocab_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Brands on an even number of parts are the vocabulary."""
    parts = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("token"))
    vocab = parts.groupBy("token").agg(F.min("p_partkey").alias("id"), F.count(F.lit(1)).alias("n")).filter("n % 2 = 0")
    return N.with_default(parts, vocab, "token", "id", F.lit(49407).cast("long")).select("p_partkey", "token", "id")


def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).select("vec_id", F.transform("embedding", lambda x: x.cast("double") * F.when(F.col("vec_id") % 11 == 0, 1e-10).otherwise(3.0)).alias("v"))
    n = v.select("vec_id", V.norm("v").alias("before"), V.l2_normalize("v").alias("v"))
    return rounded(n.select("vec_id", "before", V.norm("v").alias("after"), F.element_at("v", 1).alias("first")), "before", "after", "first")


def troubled(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with what can be wrong with one, by id."""
    e, k = F.col("embedding").cast("array<double>"), F.col("vec_id") % 8
    bad = F.when(k == 0, F.transform(e, lambda x: F.lit(float("nan")))).when(k == 1, F.concat(e, F.array(F.lit(float("inf"))))).when(k == 2, F.slice(e, 1, 0)).when(k == 3, F.transform(e, lambda x: F.lit(1e-9)))
    return vectors(spark, d).select("vec_id", bad.when(k == 4, F.slice(e, 1, 10)).when(k == 5, F.lit(None)).otherwise(e).alias("embedding"))


def embedding_validity(spark: SparkSession, d: str) -> DataFrame:
    return troubled(spark, d).select("vec_id", V.is_valid("embedding").alias("is_valid"))


def cosines(spark: SparkSession, d: str) -> DataFrame:
    t = vectors(spark, d)
    pairs = t.alias("a").join(t.alias("b"), F.expr("b.vec_id = a.vec_id + 1"))
    zero = F.when(F.col("a.vec_id") % 5 == 0, F.transform("a.embedding", lambda x: x * 0)).otherwise(F.slice("a.embedding", 1, 40))
    rows = pairs.select(F.col("a.vec_id").alias("vec_id"), zero.alias("a"), F.col("b.embedding").alias("b"))
    return rounded(rows.select("vec_id", V.dot("a", "b").alias("dot"), V.cosine("a", "b").alias("cosine"), V.cosine_or_zero("a", "b").alias("safe")), "dot", "cosine", "safe")


def quantize_int8(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).withColumn("scale", V.quantize_scale("embedding"))
    v = v.withColumn("q", V.quantize("embedding", F.col("scale")))
    return v.select("vec_id", F.round("scale", 9).alias("scale"), F.array_join(F.transform("q", lambda x: x.cast("string")), ",").alias("q"))


def channel_scales(spark: SparkSession, d: str) -> DataFrame:
    w = vectors(spark, d).select(F.col("label").cast("string").alias("name"), F.posexplode("embedding").alias("channel", "value"))
    return rounded(Q.channel_scales(w.withColumn("value", F.col("value").cast("double"))).withColumn("scale", F.col("scale") * 1000), "scale").withColumn("channel", F.col("channel").cast("long"))


def model_agreement(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).withColumn("scale", V.quantize_scale("embedding"))
    q = v.select("vec_id", V.dequantize(V.quantize("embedding", F.col("scale")), F.col("scale")).alias("embedding"))
    return rounded(Q.agreement(v, q), "avg_cos", "min_cos", "max_cos")


def op_histogram(spark: SparkSession, d: str) -> DataFrame:
    return Q.op_histogram(table(spark, d, "events"), "event_type")


def op_report(spark: SparkSession, d: str) -> DataFrame:
    return Q.op_report(table(spark, d, "events"), ["view", "click", "missing"], "event_type")


def graph(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    op = F.element_at(F.array(*[F.lit(x) for x in ("Conv", "MatMul", "Gemm", "Softmax", "LayerNorm")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select(F.concat("p_name", F.lit("/"), F.col("p_partkey").cast("string")).alias("node"), op.alias("op_type"), F.array(F.lit("x"), F.concat(F.lit("w"), (F.col("p_partkey") % 97).cast("string"))).alias("inputs"))


def quantization_targets(spark: SparkSession, d: str) -> DataFrame:
    weights = spark.range(60).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("name"))
    return Q.targets(graph(spark, d), weights, sensitive="ring|gemm")


def model_graph(spark: SparkSession, d: str) -> DataFrame:
    """Graphs exported as JSON lists, one for each brand, read as nodes."""
    g = graph(spark, d).join(table(spark, d, "part").select(F.concat("p_name", F.lit("/"), F.col("p_partkey").cast("string")).alias("node"), "p_brand"), "node")
    exported = g.groupBy("p_brand").agg(F.to_json(F.collect_list(F.struct("node", "op_type", "inputs"))).alias("value"))
    return files.model_graph(exported).select("node", "op_type", F.array_join("inputs", ",").alias("inputs"))


def provider_selection(spark: SparkSession, d: str) -> DataFrame:
    from halyard.functions.encode import agreeing

    e = table(spark, d, "events").groupBy("event_type").agg(F.sum("value").alias("elapsed"), F.count(F.lit(1)).alias("n"))
    return rounded(agreeing(e.select(F.col("event_type").alias("provider"), (F.lit(0.98) + F.col("n") % 3 * 0.01).alias("cosine"), "elapsed")), "elapsed")


def thread_argmin(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("threads"), F.floor("o_totalprice").alias("elapsed"), F.col("o_orderkey").alias("ord"))
    return E.fastest(o)


def image_geometry(spark: SparkSession, d: str) -> DataFrame:
    w, h = (F.col("event_id") * 7 % 3000 + 1).cast("int"), (F.col("event_id") * 13 % 2000 + 1).cast("int")
    rows = table(spark, d, "events").select("event_id", w.alias("w"), h.alias("h"))
    rw, rh = I.resized(F.col("w"), F.col("h"))
    cw, ch = I.capped(F.col("w"), F.col("h"))
    return rows.select("event_id", rw.alias("rw"), rh.alias("rh"), I.crop_offset(rw).alias("x"), I.crop_offset(rh).alias("y"), cw.alias("cw"), ch.alias("ch"), I.sample_size(F.col("w"), F.col("h")).alias("sample"))


def job_progress(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", (F.col("event_id") % 250).alias("current"), (F.col("user_id") % 200).alias("total"))
    return rows.select("event_id", P.bounded(F.col("current"), F.col("total")).alias("bounded"), P.percent(F.col("current"), F.col("total")).alias("percent"), P.is_refresh(F.col("current")).alias("refresh"))


def stage_timers(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.stage_times(table(spark, d, "events"), "event_type", "value"), "total_ms")


def flatten_output(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).withColumn("nested", F.array(F.slice("embedding", 1, 3), F.lit(None), F.transform(F.slice("embedding", 4, 2), lambda x: F.when(x > 0, x))))
    flat = V.flat("nested")
    return v.select("vec_id", F.size(flat).cast("long").alias("n"), F.round(V.total(flat.cast("array<double>")), 6).alias("total"))


def split_batches(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d).select("vec_id", F.posexplode(V.split_rows("embedding", 4)).alias("part", "v"))
    return v.select("vec_id", F.col("part").cast("long").alias("part"), F.size("v").cast("long").alias("n"), F.round(V.total(V.doubles("v")), 6).alias("total"))


def adjacent_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.split("p_name", "").alias("c"))
    pairs = V.adjacent_pairs("c")
    return p.select("p_partkey", F.array_join(F.transform(pairs, lambda x: F.concat(x["l"], x["r"])), ",").alias("pairs"))


def json_config(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    json = F.when(k == 0, '{"do_normalize": false}').when(k == 1, '{"do_normalize": true}').when(k == 2, F.col("props")).otherwise("not json")
    return table(spark, d, "events").select("event_id", files.do_normalize(json).alias("do_normalize"), F.get_json_object("props", "$.k").cast("long").alias("k"))


def tokenizer_file(spark: SparkSession, d: str) -> DataFrame:
    text = '{"model": {"vocab": {"a": 0, "b": 1, "ab</w>": 2}, "merges": ["a b</w>", "odd one out", "c d"]}}'
    one = spark.createDataFrame([(text,)], "value string")
    v = files.vocabulary(one).select(F.lit("vocab").alias("kind"), F.col("token").alias("what"), F.col("id").cast("long").alias("id"))
    m = files.merge_ranks(one).select(F.lit("merge").alias("kind"), F.concat("left", F.lit(" "), "right").alias("what"), F.col("rank").cast("long").alias("id"))
    return v.unionByName(m)


def image_listing(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("url", F.element_at(F.array(*[F.lit(x) for x in (".jpg", ".PNG", ".gif", "", ".webp", ".jpeg.txt")]), (F.col("page_id") % 6 + 1).cast("int")))
    return table(spark, d, "pages").select("page_id", name.alias("path")).filter(files.is_image("path")).orderBy("path", "page_id").limit(25).select("page_id")


def find_images(spark: SparkSession, d: str) -> DataFrame:
    """A folder tree of files, some of them images by their names."""
    folder = shared(spark, "images")
    for i, name in enumerate(("a.jpg", "b.JPEG", "c.txt", "deep/er/d.png", "deep/e.webp", "deep/f.jpg.bak", "g.gif", "h.PnG")):
        put_bytes(spark, f"{folder}/{name}", b"x" * (i + 1))
    found = files.find_images(spark, folder, limit=4)
    return found.select(F.substring_index("path", "/", -1).alias("name"), "length")


def file_contents(spark: SparkSession, d: str) -> DataFrame:
    """Whole files, as bytes and as text."""
    folder = shared(spark, "files")
    for name, content in (("one.txt", "first\nsecond\n"), ("two.txt", "é")):
        put_bytes(spark, f"{folder}/{name}", content.encode())
    raw = files.read_bytes(spark, folder).select(F.substring_index("path", "/", -1).alias("name"), F.octet_length("content").cast("long").alias("n"))
    text = files.read_text(spark, f"{folder}/one.txt").select(F.lit("as text").alias("name"), F.length("value").cast("long").alias("n"))
    return raw.unionByName(text)


def bitmap(width: int, height: int, rgb: tuple[int, int, int]) -> bytes:
    """An uncompressed image file of one colour, its first pixel black: a header, rows from the bottom up, blue first."""
    line = bytes(rgb[::-1]) * width
    rows = [line + bytes(-len(line) % 4) for _ in range(height)]
    rows[-1] = bytes(3) + rows[-1][3:]
    body = b"".join(rows)
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def image_decode(spark: SparkSession, d: str) -> DataFrame:
    """Image files as pixels, the longer edge at most 512; a damaged one gives none."""
    folder = shared(spark, "pictures")
    for name, content in (("small.bmp", bitmap(5, 3, (200, 10, 30))), ("wide.bmp", bitmap(1024, 16, (9, 8, 7))), ("damaged.png", b"no image")):
        put_bytes(spark, f"{folder}/{name}", content)
    rows = I.read_images(spark, folder)
    byte = lambda i: F.hex(F.substring("rgb", i, 3))
    return rows.select(F.substring_index("path", "/", -1).alias("name"), *[F.coalesce(c, F.lit(0)).alias(n) for n, c in (("width", F.col("width")), ("height", F.col("height")), ("bytes", F.octet_length("rgb")))], F.when(F.col("width") < 9, byte(1)).alias("first"), byte(-3).alias("last"))


def calibration_rows(spark: SparkSession, d: str) -> DataFrame:
    """Inputs that could be made of images, every ninth of which has too few bytes."""
    pixels = F.unhex(F.repeat(F.lit("0a141e"), F.when(F.col("vec_id") % 9 == 8, 7).otherwise(9 * 8)))
    rows = vectors(spark, d).select("vec_id", I.preprocess(target=8)(pixels, F.lit(9), F.lit(8)).alias("input"))
    return files.not_null(rows, "input").select("vec_id", F.size("input").cast("long").alias("n"))


def state_defaults(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") == "view", F.array("event_type", F.col("user_id").cast("string"))).alias("selected_albums"), F.when(F.col("event_type") == "click", F.col("event_id")).alias("last_indexed_ms"), F.lit(None).cast("int").alias("threads"))
    s = state.with_defaults(e)
    return s.select(F.array_join("selected_albums", ",").alias("albums"), "last_indexed_ms", F.col("threads").cast("long").alias("threads"))


def work_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("media_id"),
        F.left("o_orderpriority", F.lit(1)).cast("int").alias("priority"),
        F.element_at(F.create_map(F.lit("O"), F.lit("PENDING"), F.lit("P"), F.lit("PROCESSING"), F.lit("F"), F.lit("PENDING")), F.col("o_orderstatus")).alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("created"),
        (F.col("o_custkey") % 5).cast("int").alias("retries"),
    )


def work_queue(spark: SparkSession, d: str) -> DataFrame:
    return W.claim(work_items(spark, d), 16).select("media_id", "priority")


def queue_failures(spark: SparkSession, d: str) -> DataFrame:
    q = work_items(spark, d)
    out = W.after_failure(q, q.filter("media_id % 10 = 0"))
    return out.groupBy("status", "retries").agg(F.count(F.lit(1)).alias("n"))


def orphan_reclaim(spark: SparkSession, d: str) -> DataFrame:
    q = work_items(spark, d).withColumn("heartbeat", F.timestamp_seconds(F.lit(1_700_000_000) - F.col("media_id") % 1200))
    return W.reclaim(q, F.timestamp_seconds(F.lit(1_700_000_000))).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def debounce(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return W.debounced(e, key="event_type", gap="15 minutes").select("event_type", "n", F.unix_micros("last_ts").alias("last_us"))


def latency_p95(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.latency(table(spark, d, "events"), key="event_type", ts="ts", value="value"), "p50", "p95")


def ann_trigger(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.needs_ann(table(spark, d, "events"), 40_000, p95_over=20.0), "p95")


def adaptive_batch(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", W.batch_size(F.col("event_id") % 5, F.col("user_id") % 2 == 0, F.col("event_id") % 100).cast("long").alias("batch"))


QUERIES = {
    f.__name__: f
    for f in (full_scan, album_scan, incremental_scan, album_rollup, album_selection, selection_summary, chunks_of_four, list_diff, unique_names, unique_names_mixed, scan_backfill, index_file, model_graph, find_images, file_contents, image_decode, calibration_rows, unindexed_images, cached_index, deletion_reconcile, index_upsert, edit_detection, record_bounds, vocab_lookup, l2_normalize, embedding_validity, cosines, quantize_int8, channel_scales, model_agreement, op_histogram, op_report, quantization_targets, provider_selection, thread_argmin, image_geometry, job_progress, stage_timers, flatten_output, split_batches, adjacent_pairs, json_config, tokenizer_file, image_listing, state_defaults, work_queue, queue_failures, orphan_reclaim, debounce, latency_p95, ann_trigger, adaptive_batch)
}

WORK = """w as (select o_orderkey as media_id, left(o_orderpriority, 1)::int as priority, case o_orderstatus when 'P' then 'PROCESSING' else 'PENDING' end as status, o_orderdate as created, (o_custkey % 5)::int as retries from orders)"""
SCALE = "max_abs as (select vec_id, embedding::double[] as e, list_max(list_transform(embedding::double[], lambda x: abs(x))) as m from embeddings), sc as (select vec_id, e, case when m = 0 then 1.0 else m / 127 end as scale from max_abs)"
QUANT = "qz as (select vec_id, e, scale, list_transform(e, lambda x: greatest(-128, least(127, round_even(x / scale, 0)))::int) as q from sc)"

ORACLE_SQL = {
    "full_scan": f"with {CATALOG} select id, bucket_id, epoch_us(date_added) as date_added from c where bucket_id is not null",
    "album_scan": f"with {CATALOG} select id, bucket_id, epoch_us(date_added) as date_added from c where bucket_id in ('view', 'click')",
    "incremental_scan": f"with {CATALOG} select id, bucket_id, epoch_us(date_added) as date_added from c where bucket_id in ('view', 'error') and epoch_us(date_added) // 1000000 > {MARK_MS} // 1000",
    "album_rollup": f"with {CATALOG}, g as (select bucket_id as id, arg_max(bucket_name, (epoch_us(date_added), -id)) as name, count(*) as n from c where bucket_id is not null group by bucket_id) select id, case when trim(name) = '' then 'Unnamed album' else name end as name, n from g",
    "album_selection": f"with {CATALOG}, g as (select bucket_id as id, arg_max(bucket_name, (epoch_us(date_added), -id)) as name, count(*) as n from c where bucket_id is not null group by bucket_id) select id, case when trim(name) = '' then 'Unnamed album' else name end || ' (' || n || ')' as label, id in ('view', 'error') as selected from g",
    "selection_summary": f"""with {CATALOG}, g as (select bucket_id, count(*) as n from c group by bucket_id)
select bucket_id, 'Ready - ' || n || ' indexed (' || case when bucket_id is null then 'All albums' else '1 albums' end || ')' as summary,
  case n % 3 when 0 then 'No photos found' when 1 then '1 photo' else (n % 3) || ' photos' end as visible,
  case when n % 60 = 0 then 'No results found' when n % 60 <= 30 then 'Found ' || (n % 60) || ' photos' else 'Found ' || (n % 60) || ' photos — scroll to see more' end as found from g""",
    "chunks_of_four": f"with {CATALOG} select id, (row_number() over (order by date_added, id) - 1) // 4 as chunk from c",
    "list_diff": f"with {CATALOG} select id, case when id % 5 = 0 then 'insert' else 'remove' end as change from c where (id % 3 = 0) <> (id % 5 = 0)",
    "unique_names": f"""with t(name) as (values {", ".join(f"('{x}')" for x in TAKEN)}), r as (select p_partkey as id, p_type as name, row_number() over (partition by p_type order by p_partkey) as nth from part),
c as (select name, k, case when k = 0 then name else name || '_' || k end as made from (select name, unnest(range(0, count(*) + 10)) as k from r group by name)),
f as (select name, made, row_number() over (partition by name order by k) as nth from c where made not in (select name from t)) select id, made as unique_name from r join f using (name, nth)""",
    "unique_names_mixed": f"""with recursive w as (select p_partkey as id, p_type as family, p_type || case when p_partkey % 7 = 0 then '_1' when p_partkey % 11 = 0 then '_1_2' when p_partkey % 13 = 0 then '_3' else '' end as name,
  row_number() over (partition by p_type order by p_partkey) as nth from part),
r(family, nth, id, name, made, used) as (select distinct family, 0::bigint, null::bigint, null::varchar, null::varchar, [{", ".join(f"'{x}'" for x in TAKEN)}] from w
  union all select family, nth, id, name, made, list_append(used, made) from (select w.family, w.nth, w.id, w.name, r.used,
    case when not list_contains(r.used, w.name) then w.name else w.name || '_' || list_filter(range(1, len(r.used) + 2), lambda k: not list_contains(r.used, w.name || '_' || k))[1] end as made
    from r join w on w.family = r.family and w.nth = r.nth + 1))
select id, name, made as unique_name from r where nth > 0""",
    "unindexed_images": "select 'item/' || event_id as uri from events where event_id not in (select vec_id from embeddings)",
    "cached_index": f"with {CATALOG} select 'item/' || vec_id as uri, cast(label as bigint) as version from embeddings where vec_id in (select id from c where bucket_id = 'view')",
    "deletion_reconcile": f"with {CATALOG} select 'item/' || vec_id as uri from embeddings where vec_id not in (select id from c where bucket_id is not null)",
    "index_upsert": """with o as (select vec_id, cast(label as bigint) as version, 0 as fresh, embedding[1]::double as first from embeddings),
f as (select vec_id, cast(5 as bigint) as version, 1 as fresh, embedding[64]::double / sqrt(list_dot_product(embedding::double[], embedding::double[])) as first from embeddings),
u as (select * from o union all select * from f) select 'item/' || vec_id as uri, version, round(first::float::double, 5) as first from u qualify row_number() over (partition by vec_id order by version desc, fresh desc) = 1""",
    "edit_detection": f"with {CATALOG} select id, epoch_us(date_added) as indexed, epoch_us(date_added) + 5 as current from c where id % 10 = 0",
    "record_bounds": "select vec_id, vec_id * 20 between 1 and 4096 and vec_id % 9 <> 0 as in_bounds from embeddings",
    "vocab_lookup": "with v as (select p_brand as token, min(p_partkey) as id from part group by p_brand having count(*) % 2 = 0) select p_partkey, p_brand as token, coalesce(v.id, 49407) as id from part left join v on v.token = p_brand",
    "scan_backfill": f"with {CATALOG} select 'within' as mark, id from c where bucket_id in ('view', 'error') and epoch_us(date_added) // 1000000 > {MARK_MS} // 1000 union all select 'behind', id from c where bucket_id in ('view', 'error')",
    "index_file": "select 'item/' || vec_id as uri, len(embedding) as n, round(list_sum(embedding::double[]), 5) as total from embeddings union all select null, 0, null",
    "model_graph": "select p_name || '/' || p_partkey as node, ['Conv', 'MatMul', 'Gemm', 'Softmax', 'LayerNorm'][p_partkey % 5 + 1] as op_type, 'x,w' || (p_partkey % 97) as inputs from part",
    "file_contents": "select * from (values ('one.txt', 13::bigint), ('two.txt', 2), ('as text', 13)) t(name, n)",
    "image_decode": "select * from (values ('small.bmp', 5, 3, 45, '000000', 'C80A1E'), ('wide.bmp', 512, 8, 12288, null, '090807'), ('damaged.png', 0, 0, 0, null, null)) t(name, width, height, bytes, first, last)",
    "calibration_rows": "select vec_id, 192::bigint as n from embeddings where vec_id % 9 <> 8",
    "find_images": "select * from (values ('a.jpg', 1::bigint), ('b.JPEG', 2), ('d.png', 4), ('e.webp', 5)) t(name, length)",
    "l2_normalize": """with v as (select vec_id, list_transform(embedding::double[], lambda x: x * case when vec_id % 11 = 0 then 1e-10 else 3.0 end) as v from embeddings),
n as (select vec_id, v, sqrt(list_dot_product(v, v)) as n from v), u as (select vec_id, n, case when n < 1e-8 then v else list_transform(v, lambda x: x / n) end as v from n)
select vec_id, round(n, 6) as before, round(sqrt(list_dot_product(v, v)), 6) as after, round(v[1], 6) as first from u""",
    "embedding_validity": "select vec_id, vec_id % 8 in (4, 6, 7) as is_valid from embeddings",
    "cosines": """with p as (select a.vec_id, case when a.vec_id % 5 = 0 then list_transform(a.embedding::double[], lambda x: 0.0) else a.embedding[1:40]::double[] end as a, b.embedding::double[] as b from embeddings a join embeddings b on b.vec_id = a.vec_id + 1),
d as (select vec_id, list_dot_product(a, b[1:len(a)]) as dot, sqrt(list_dot_product(a, a)) as na, sqrt(list_dot_product(b, b)) as nb from p)
select vec_id, round(dot, 6) as dot, round(dot / ((na + 1e-8) * (nb + 1e-8)), 6) as cosine, round(case when na = 0 or nb = 0 then 0.0 else dot / (na * nb) end, 6) as safe from d""",
    "quantize_int8": f"with {SCALE}, {QUANT} select vec_id, round(scale, 9) as scale, array_to_string(q, ',') as q from qz",
    "channel_scales": "with u as (select label::varchar as name, unnest(embedding)::double as value, unnest(range(64)) as channel from embeddings) select name, channel, round(case when max(abs(value)) = 0 then 1.0 else max(abs(value)) / 127 end * 1000, 6) as scale from u group by name, channel",
    "model_agreement": f"""with {SCALE}, {QUANT}, p as (select e, list_transform(q, lambda x: x::double * scale) as r from qz),
c as (select list_dot_product(e, r) / ((sqrt(list_dot_product(e, e)) + 1e-8) * (sqrt(list_dot_product(r, r)) + 1e-8)) as c from p) select count(*) as n, round(avg(c), 6) as avg_cos, round(min(c), 6) as min_cos, round(max(c), 6) as max_cos from c""",
    "op_histogram": "select event_type, count(*) as n from events group by event_type",
    "op_report": "select count(*) filter (where event_type = 'view') as n_view, count(*) filter (where event_type = 'click') as n_click, count(*) filter (where event_type = 'missing') as n_missing from events",
    "quantization_targets": """with g as (select p_name || '/' || p_partkey as node, ['Conv', 'MatMul', 'Gemm', 'Softmax', 'LayerNorm'][p_partkey % 5 + 1] as op_type, 'w' || (p_partkey % 97) as weight, p_partkey % 97 as w from part)
select weight, node, op_type from g where op_type in ('Conv', 'MatMul', 'Gemm') and w < 60 and not regexp_matches(lower(node), 'ring|gemm') and not regexp_matches(lower(op_type), 'ring|gemm')""",
    "provider_selection": "with e as (select event_type as provider, 0.98::double + count(*) % 3 * 0.01::double as cosine, sum(value) as elapsed from events group by event_type) select arg_min(provider, (elapsed, provider)) as provider, round(min(elapsed), 6) as elapsed from e where cosine >= 0.99",
    "thread_argmin": "select arg_min(o_custkey, (floor(o_totalprice)::bigint, o_orderkey)) as threads, min(floor(o_totalprice))::bigint as elapsed from orders",
    "image_geometry": """with r as (select event_id, (event_id * 7 % 3000 + 1)::int as w, (event_id * 13 % 2000 + 1)::int as h from events),
s as (select *, greatest(floor(w * (256.0::double / least(w, h)) + 0.5), 256)::int as rw, greatest(floor(h * (256.0::double / least(w, h)) + 0.5), 256)::int as rh, greatest(w, h) as l from r)
select event_id, rw, rh, ((rw - 256) // 2)::int as x, ((rh - 256) // 2)::int as y, case when l <= 512 then w else greatest(floor(w * (512.0::double / l) + 0.5), 1)::int end as cw,
  case when l <= 512 then h else greatest(floor(h * (512.0::double / l) + 0.5), 1)::int end as ch, pow(2, floor(log2(greatest(least(w, h) // 256, 1))))::int as sample from s""",
    "job_progress": "with r as (select event_id, event_id % 250 as current, user_id % 200 as total from events) select event_id, least(current, total) as bounded, least(current, total) * 100 // greatest(total, 1) as percent, current = 1 or (current > 0 and current % 20 = 0) as refresh from r",
    "stage_timers": "select event_type, count(*) as n, round(sum(value), 6) as total_ms from events group by event_type",
    "flatten_output": "with f as (select vec_id, list_filter(list_concat(embedding[1:3], list_transform(embedding[4:5], lambda x: case when x > 0 then x end)), lambda x: x is not null)::double[] as v from embeddings) select vec_id, len(v) as n, round(list_sum(v), 6) as total from f",
    "split_batches": "select vec_id, p as part, 16::bigint as n, round(list_sum(embedding[p * 16 + 1 : p * 16 + 16]::double[]), 6) as total from embeddings, range(4) t(p)",
    "adjacent_pairs": """with u as (select p_partkey, unnest(range(1, length(p_name))) as i, p_name from part), q as (select p_partkey, substr(p_name, i, 2) as pair, min(i) as i from u group by all)
select p_partkey, string_agg(pair, ',' order by i) as pairs from q group by p_partkey""",
    "json_config": "select event_id, event_id % 4 <> 0 as do_normalize, cast(json_extract(props, '$.k') as bigint) as k from events",
    "tokenizer_file": "select * from (values ('vocab', 'a', 0::bigint), ('vocab', 'b', 1), ('vocab', 'ab</w>', 2), ('merge', 'a b</w>', 0), ('merge', 'c d', 2)) t(kind, what, id)",
    "image_listing": "with p as (select page_id, url || ['.jpg', '.PNG', '.gif', '', '.webp', '.jpeg.txt'][page_id % 6 + 1] as path from pages) select page_id from p where regexp_matches(lower(path), '\\.(jpg|jpeg|png|webp)$') order by path, page_id limit 25",
    "state_defaults": "select (select event_type || ',' || user_id from events where event_type = 'view' order by ts desc limit 1) as albums, (select event_id from events where event_type = 'click' order by ts desc limit 1) as last_indexed_ms, 0::bigint as threads",
    "work_queue": f"with {WORK} select media_id, priority from w where status = 'PENDING' order by priority, created, media_id limit 16",
    "queue_failures": f"with {WORK}, f as (select case when media_id % 10 = 0 then case when retries + 1 > 3 then 'FAILED' else 'PENDING' end else status end as status, case when media_id % 10 = 0 then retries + 1 else retries end as retries from w) select status, retries, count(*) as n from f group by all",
    "orphan_reclaim": f"with {WORK} select case when status = 'PROCESSING' and media_id % 1200 > 600 then 'PENDING' else status end as status, count(*) as n from w group by 1",
    "debounce": """with l as (select event_type, ts, case when ts >= lag(ts) over (partition by event_type order by ts, event_id) + interval 15 minutes then 1 else 0 end as new, event_id from events),
s as (select *, sum(new) over (partition by event_type order by ts, event_id) as burst from l) select event_type, count(*) as n, epoch_us(max(ts)) as last_us from s group by event_type, burst""",
    "latency_p95": """with r as (select event_id, event_type, list(value) over (partition by event_type order by ts, event_id rows between 49 preceding and current row) as v from events)
select event_id, event_type, round(list_aggregate(v, 'quantile_cont', 0.5), 6) as p50, round(list_aggregate(v, 'quantile_cont', 0.95), 6) as p95 from r""",
    "ann_trigger": "select round(quantile_cont(round(value / 1e-3) / 1e3, 0.95), 6) as p95, quantile_cont(round(value / 1e-3) / 1e3, 0.95) > 20.0 as migrate from events where ts > (select max(ts) from events) - interval 7 days",
    "adaptive_batch": "select event_id, cast(case when event_id % 5 >= 3 then 2 when event_id % 100 < 20 and user_id % 2 <> 0 then 4 when user_id % 2 = 0 then 32 else 16 end as bigint) as batch from events",
}
