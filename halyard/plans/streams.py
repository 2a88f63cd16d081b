"""Streams driven over the test tables to their end: the index kept up from files, and item status from queue events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.functions.encode import hashing_encoder
from halyard.plans.retrieval import EVERY, SCORED, rounded
from halyard.plans.tables import shared, table, vectors
from halyard.sources.index_store import IndexStore
from halyard.streaming.index_stream import CATALOG, catalog_stream, live_search, reconcile, start
from halyard.streaming.queue import debounced, queue_status


def stream_index(spark: SparkSession, d: str) -> DataFrame:
    """All parts as catalog files in two deliveries that overlap, dealt by hashes, indexed by two runs of one stream."""
    base = shared(spark, "stream-index")
    items = table(spark, d, "part").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("uri"), F.col("p_name").alias("item"), F.timestamp_seconds(F.col("p_partkey") + 1_700_000_000).alias("date_added"))
    store = IndexStore(spark, f"{base}/index")
    deal = F.pmod(F.xxhash64("uri"), F.lit(15))
    for lo, hi in ((0, 10), (8, 15)):
        items.filter(deal.between(lo, hi - 1)).select(*CATALOG.names).coalesce(1).write.mode("append").parquet(f"{base}/in")
        start(catalog_stream(spark, f"{base}/in"), store, hashing_encoder, f"{base}/checkpoint").awaitTermination()
    store.compact()
    return store.load().select("uri", F.size("embedding").cast("long").alias("dim"))


def stream_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """All parts indexed by one periodic run; those that are larger by the next, which adds nothing, are gone."""
    base = shared(spark, "stream-reconcile")
    parts = table(spark, d, "part").select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("uri"), F.col("p_name").alias("item"), F.timestamp_seconds(F.col("p_partkey")).alias("date_added"), "p_size")
    store = IndexStore(spark, f"{base}/index")
    parts.select(*CATALOG.names).coalesce(1).write.parquet(f"{base}/in")
    for most in (50, 25):
        alive = parts.filter(F.col("p_size") <= most).select("uri")
        start(catalog_stream(spark, f"{base}/in"), store, hashing_encoder, f"{base}/checkpoint").awaitTermination()
        reconcile(store, alive)
    return store.load().select("uri")


def stream_live_search(spark: SparkSession, d: str) -> DataFrame:
    """The best three of each query after each of three deliveries of the vectors, dealt by id."""
    base = shared(spark, "stream-live")
    index = vectors(spark, d).select("vec_id", "embedding")
    queries = index.filter(F.col("vec_id") % EVERY == 0).withColumnRenamed("vec_id", "query_id")
    for delivery in range(3):
        index.filter(F.col("vec_id") % 3 == delivery).coalesce(1).write.mode("append").parquet(f"{base}/in")
        live_search(spark.readStream.schema(index.schema).parquet(f"{base}/in"), queries, f"{base}/out", f"{base}/checkpoint", k=3, exclude_self=True).awaitTermination()
    return rounded(spark.read.parquet(f"{base}/out").select(F.col("batch").cast("long").alias("delivery"), "query_id", "vec_id", "rank", "score"), "score")


def run_once(stream: DataFrame, mode: str, where: str) -> DataFrame:
    """All the stream has, with its batch, written beside its checkpoint: a folder for each batch, so a repeated batch
    replaces itself."""
    out = f"{where}-out-{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", where).trigger(availableNow=True)
    q.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}")).start().awaitTermination()
    return stream.sparkSession.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)


def stream_queue(spark: SparkSession, d: str) -> DataFrame:
    """events as a queue's: each user is an item, and its last status is kept."""
    base = shared(spark, "stream-queue")
    kinds = F.create_map(*[F.lit(x) for x in ("signup", "added", "view", "claimed", "click", "beat", "purchase", "done", "error", "failed")])
    events = table(spark, d, "events").select(F.col("user_id").alias("media_id"), kinds[F.col("event_type")].alias("event"), F.col("ts").cast("timestamp").alias("ts"))
    events.coalesce(1).write.parquet(f"{base}/in")
    source = spark.readStream.schema(events.schema).parquet(f"{base}/in")
    out = run_once(queue_status(source), "update", f"{base}/checkpoint")
    last = out.groupBy("media_id").agg(F.max_by(F.struct("status", "retries"), "batch").alias("last"))
    return last.select("media_id", "last.status", F.col("last.retries").cast("long").alias("retries"))


def stream_debounce(spark: SparkSession, d: str) -> DataFrame:
    """Bursts closed by the watermark."""
    base = shared(spark, "stream-debounce")
    events = table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    events.coalesce(1).write.parquet(f"{base}/in")
    source = spark.readStream.schema(events.schema).parquet(f"{base}/in")
    out = run_once(debounced(source, key="event_type", gap="15 minutes", late="1 hour"), "append", f"{base}/checkpoint")
    return out.select("event_type", "n", F.unix_micros("last_ts").alias("last_us"))


QUERIES = {f.__name__: f for f in (stream_index, stream_reconcile, stream_live_search, stream_queue, stream_debounce)}
ORACLE_SQL = {
    "stream_index": "select 'part/' || p_partkey as uri, 64::bigint as dim from part",
    "stream_reconcile": "select 'part/' || p_partkey as uri from part where p_size <= 25",
    "stream_live_search": f"""with {SCORED}, x as (select deliver.d as delivery, s.* from s, (select unnest(range(3)) as d) deliver where s.id % 3 <= deliver.d),
r as (select *, row_number() over (partition by delivery, query_id order by score desc, id) as rank from x) select delivery, query_id, id as vec_id, rank, round(score, 6) as score from r where rank <= 3""",
    "stream_queue": """with f as (select user_id, event_type, ts, event_id, sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id) as r from events),
g as (select user_id, count(*) filter (where event_type = 'error') as retries, max(ts) as beat,
  max_by(case event_type when 'purchase' then 'DONE' when 'error' then case when r > 3 then 'FAILED' else 'PENDING' end else 'PROCESSING' end, (ts, event_id)) filter (where event_type <> 'signup') as status from f group by user_id)
select user_id as media_id, case when status is null or (status = 'PROCESSING' and beat + interval 600 seconds < (select max(ts) from events) - interval 1 minute) then 'PENDING' else status end as status, retries from g""",
    "stream_debounce": """with l as (select event_type, ts, event_id, case when ts >= lag(ts) over (partition by event_type order by ts, event_id) + interval 15 minutes then 1 else 0 end as new from events),
s as (select *, sum(new) over (partition by event_type order by ts, event_id) as burst from l),
b as (select event_type, count(*) as n, max(ts) as last from s group by event_type, burst)
select event_type, n, epoch_us(last) as last_us from b where last + interval 15 minutes <= (select max(ts) from events) - interval 1 hour""",
}
