"""The incremental behaviours as Structured Streaming jobs.

What a trigger compares with lies in buckets by key, and a trigger opens only the buckets that its own rows fall into.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from epochlens.functions.times import to_utc
from epochlens.plans.ordered import ordered
from epochlens.sources.tables import upsert
from epochlens.streaming.keyed import KeyedTable, bucket_of, touched

Sink = Callable[[DataFrame, int], None]


#: Buckets of the stored rows of a job.
BUCKETS = 64


def _stored(spark: SparkSession, path: str, before: int, schema: str, buckets: list[int]) -> DataFrame:
    """What earlier batches have written to some buckets of a folder partitioned by batch and bucket; a replayed batch
    doesn't see itself. Both are partition columns, so files of other buckets are not read."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, batch bigint, bucket int").parquet(path)
    return rows.where((F.col("batch") < before) & F.col("bucket").isin(buckets)).drop("batch", "bucket")


def _append(rows: DataFrame, path: str, batch_id: int, keys: list[str]) -> None:
    """Write the rows of a batch by bucket, ordered by key, so that row groups hold narrow ranges of keys."""
    placed = rows.withColumn("bucket", bucket_of(keys, BUCKETS)).repartition("bucket").sortWithinPartitions("bucket", *keys)
    placed.write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/batch={batch_id}")


def ingest_sink(path: str, event_time: str = "ts") -> Sink:
    """foreachBatch sink that appends the first arrival of every file hash, whatever the age of the one before.

    Copies inside a batch collapse before the shuffle; the stored catalog is read for its hashes only, and only in the
    buckets of the batch's hashes.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c not in ("file_hash", event_time)]
        first = batch.groupBy("file_hash").agg(F.min(F.struct(event_time, *rest)).alias("_f")).select("file_hash", "_f.*")
        known = _stored(spark, path, batch_id, "file_hash string", touched(batch, ["file_hash"], BUCKETS))
        _append(first.join(known, "file_hash", "left_anti"), path, batch_id, ["file_hash"])

    return write


COUNTS = "series_id string, start timestamp, observation_count bigint, earliest timestamp, latest timestamp"


def counts_sink(path: str, window: str = "1 day") -> Sink:
    """foreachBatch sink of partial counts per series and time window. No row is late: it adds to its window's count."""

    def write(batch: DataFrame, batch_id: int) -> None:
        time = to_utc(F.col("acquisition_time"))
        partial = batch.groupBy("series_id", F.window(time, window).alias("_w")).agg(
            F.count(F.lit(1)).alias("observation_count"), F.min(time).alias("earliest"), F.max(time).alias("latest")
        )
        partial.withColumn("start", F.col("_w.start")).drop("_w").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def counts_table(spark: SparkSession, path: str) -> DataFrame:
    """Counts of all windows so far, the open ones too."""
    return spark.read.schema(COUNTS).parquet(path).groupBy("series_id", "start").agg(
        F.sum("observation_count").alias("observation_count"), F.min("earliest").alias("earliest"), F.max("latest").alias("latest")
    )


SEEN = "series_id string, observation_id string, acquisition_time timestamp"
PAIRS = "series_id string, earlier_id string, later_id string"


def adjacent_sink(folder: str) -> Sink:
    """foreachBatch sink that keeps the pairs of chronological neighbours, late arrivals included.

    Of the stored observations, those of the series in the batch are put in order with the new ones; only their buckets
    are read. A pair is
    written if either side is new; the pair that a late arrival splits is thereby replaced, as the later side
    names a pair and its newest version counts.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.select("series_id", "observation_id", to_utc(F.col("acquisition_time")).alias("acquisition_time"))
        stored = _stored(spark, f"{folder}/seen", batch_id, SEEN, touched(batch, ["series_id"], BUCKETS))
        # An observation that is sent again is no second one.
        new = new.dropDuplicates(["series_id", "observation_id"]).join(stored, ["series_id", "observation_id"], "left_anti")
        _append(new, f"{folder}/seen", batch_id, ["series_id"])
        new = spark.read.schema(f"{SEEN}, bucket int").parquet(f"{folder}/seen/batch={batch_id}").drop("bucket")
        own = stored.join(new.select("series_id").distinct(), "series_id", "left_semi")
        both = own.withColumn("is_new", F.lit(False)).unionByName(new.withColumn("is_new", F.lit(True)))
        neighbours = ordered(both, ["series_id"], "acquisition_time", "observation_id", prev="_e", payload=["is_new"])
        pairs = neighbours.where("_e IS NOT NULL AND (is_new OR _e.is_new)")
        pairs.select("series_id", F.col("_e.observation_id").alias("earlier_id"), F.col("observation_id").alias("later_id")).write.mode("overwrite").parquet(
            f"{folder}/pairs/batch={batch_id}"
        )

    return write


def adjacent_table(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs that hold now: of each later observation the version written last."""
    rows = spark.read.schema(f"{PAIRS}, batch bigint").parquet(f"{folder}/pairs")
    return rows.groupBy("series_id", "later_id").agg(F.max_by("earlier_id", "batch").alias("earlier_id"))


INDEX = "tile_id string, v array<double>, source_hash string, model_id string, preprocessing string"


def index_table(spark: SparkSession, path: str) -> KeyedTable:
    """The vector index that `refresh_sink` keeps."""
    return KeyedTable(spark, path, INDEX, ("tile_id",), BUCKETS)


def refresh_sink(path: str, model_id: str, preprocessing: str, embed: Callable[[DataFrame], DataFrame]):
    """foreachBatch sink that recomputes stale vectors only and rewrites the buckets of the index that hold them.

    The batch number names the version, so a batch that is replayed writes the same version again. Of several
    rows of a tile in a batch the last by `arrived` counts.
    """
    from epochlens.operators.search import stale_embeddings
    from epochlens.session import cut

    def write(batch: DataFrame, batch_id: int) -> None:
        table = index_table(batch.sparkSession, path)
        held = table.manifest(batch_id + 1)
        latest = batch.groupBy("tile_id").agg(F.max_by(F.struct(*[c for c in batch.columns if c != "tile_id"]), "arrived").alias("_t")).select("tile_id", "_t.*")
        stale = cut(stale_embeddings(latest, table.read(held, touched(batch, ["tile_id"], BUCKETS)), model_id, preprocessing).where("state <> 'skipped'"))
        buckets = touched(stale, ["tile_id"], BUCKETS)
        fresh = embed(stale).select(
            "tile_id", F.col("v").cast("array<double>"), F.col("sha256_hash").alias("source_hash"), F.lit(model_id).alias("model_id"), F.lit(preprocessing).alias("preprocessing"), "arrived"
        )
        table.rewrite(batch_id + 1, held, upsert(table.read(held, buckets), fresh, ["tile_id"], "arrived"), buckets)

    return write


REVIEWS = """review_id string, investigation_id string, region_id string, revision bigint, ts timestamp, event_id bigint, decision string, note string,
    reason string, analyst_id string, previous_decision string, created_at timestamp, audit_hash string"""


def review_sink(path: str):
    """foreachBatch sink that appends new review revisions, by batch and by bucket of the reviewed region; of the log so
    far it reads the buckets of the batch only."""
    from epochlens.operators.reviews import review_append

    keys = ["investigation_id", "region_id"]

    def write(batch: DataFrame, batch_id: int) -> None:
        log = _stored(batch.sparkSession, path, batch_id, REVIEWS, touched(batch, keys, BUCKETS)) if batch_id > 0 else None
        _append(review_append(log, batch), path, batch_id, keys)

    return write


def run_once(stream: DataFrame, folder: str, sink: Callable[[DataFrame, int], None] | None = None) -> None:
    """Process what is there and stop, into `folder/table` or into a foreachBatch sink."""
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    started = writer.foreachBatch(sink).start() if sink else writer.format("parquet").option("path", f"{folder}/table").start()
    started.awaitTermination()
