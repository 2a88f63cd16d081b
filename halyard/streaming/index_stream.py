"""The index kept up from a stream of catalog rows.

Offsets of the source replace a clock as high-water mark, so rows that arrive during a run are the next run's.  A batch
is encoded, checked and appended to the store's checkpoints; repeating a batch after a failure changes nothing.  Each batch
leaves out repeats and what the store has, so items may arrive however long after their date.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from halyard.functions.encode import Encoder, encode_batches
from halyard.operators.index import cached, edited, unindexed
from halyard.operators.search import nearest, ranked, top_k
from halyard.sources.index_store import IndexStore

CATALOG = T.StructType([T.StructField("uri", T.StringType()), T.StructField("item", T.StringType()), T.StructField("date_added", T.TimestampType())])


def catalog_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(CATALOG).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def index_batch(store: IndexStore, load: Callable[[], Encoder]) -> Callable[[DataFrame, int], None]:
    """What one micro-batch does: leave out what has a vector, encode, append."""

    def run(batch: DataFrame, number: int) -> None:
        fresh = unindexed(batch.dropDuplicates(["uri"]), store.snapshot())
        encoded = encode_batches(fresh.select("uri", "item"), load, source="item")
        store.checkpoint(encoded.select("uri", "embedding", F.lit(number).cast("long").alias("version")))

    return run


def start(catalog: DataFrame, store: IndexStore, load: Callable[[], Encoder], checkpoint: str, *, name: str = "index", once: bool = True, interval: str = "6 hours") -> StreamingQuery:
    """Everything there is and stop, or a run each interval.  A running query of the name is kept."""
    for q in catalog.sparkSession.streams.active:
        if q.name == name:
            return q
    writer = catalog.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(index_batch(store, load))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def restart(catalog: DataFrame, *args: object, name: str = "index", **options: object) -> StreamingQuery:
    """start(), after stopping a running query of the name."""
    for q in catalog.sparkSession.streams.active:
        if q.name == name:
            q.stop()
            q.awaitTermination()
    return start(catalog, *args, name=name, **options)


def live_search(index: DataFrame, queries: DataFrame, out: str, checkpoint: str, *, k: int = 1, key: str = "vec_id", **options: object) -> StreamingQuery:
    """Queries asked anew as a stream of vectors arrives: each batch searches what it brings, merges it with the results
    before it, and writes the first k of each query up to now as out/batch=N, so a repeated batch replaces itself.  A
    search costs the batch, not the index."""
    spark = index.sparkSession

    def run(batch: DataFrame, number: int) -> None:
        found = nearest(batch, queries, k, key=key, **options).drop("rank")
        if number:
            before = spark.read.parquet(f"{out}/batch={number - 1}")
            found = top_k(found.unionByName(before.drop("rank")), k, key=key).drop("rank")
        ranked(found, key=key).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return index.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).trigger(availableNow=True).start()


def reconcile(store: IndexStore, alive: DataFrame, stamps: DataFrame | None = None) -> None:
    """What a periodic run does beside indexing: vectors of items that are gone leave the index, and with stamps(uri,
    modified, indexed) those of items that were edited since, so that they are encoded anew when they come by again."""
    kept = cached(store.snapshot(), alive.select("uri").distinct())
    if stamps is not None:
        old = stamps.select("uri", F.col("indexed").alias("modified"))
        kept = unindexed(kept, edited(old, stamps.select("uri", "modified")))
    store.replace(kept)


def cancel(spark: SparkSession, name: str = "index") -> bool:
    """Stops the running query of the name after its current batch's jobs are cancelled; whether there was one."""
    running = [q for q in spark.streams.active if q.name == name]
    for q in running:
        spark.sparkContext.cancelJobGroup(str(q.runId))
        q.stop()
    return bool(running)
