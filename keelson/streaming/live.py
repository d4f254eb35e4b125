"""Incremental forms: streams of claims, parked blobs, standing queries, and queues of copies."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keelson.model import SCHEMAS, Store
from keelson.operators import replay
from keelson.plans.search import Search
from keelson.runtime import shared_dir


def claim_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMAS["claims"]).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


@dataclass
class ClaimTable:
    """Claims in a folder, written by batch, with the batch and a bucket of objects as partitions.

    Writing a batch again replaces it, so that a restarted stream adds nothing
    twice. Claims may come in any order: attributes are replayed from the table,
    for touched objects only, of which just the buckets are read.
    """

    spark: SparkSession
    folder: str
    touched: Callable[[DataFrame, int], None] | None = None
    buckets: int = 64

    def rows(self) -> DataFrame:
        return self.spark.read.schema(SCHEMAS["claims"] + ", batch bigint, bucket int").parquet(self.folder)

    def claims(self) -> DataFrame:
        """All claims, each once."""
        return self.rows().dropDuplicates(["claim_ref"]).drop("batch", "bucket")

    def claims_of(self, objects: DataFrame) -> DataFrame:
        """The claims on some objects (permanode), each once."""
        buckets = [r["bucket"] for r in objects.select(self._bucket().alias("bucket")).distinct().collect()]  # at most the number of buckets
        rows = self.rows().where(F.col("bucket").isin(buckets)).join(objects.select("permanode").distinct(), "permanode", "left_semi")
        return rows.dropDuplicates(["claim_ref"]).drop("batch", "bucket")

    def _bucket(self):
        return F.pmod(F.xxhash64("permanode"), F.lit(self.buckets)).cast("int")

    def write(self, batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").sortWithinPartitions("bucket", "attr", "permanode")
        rows.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{self.folder}/batch={number}")
        if self.touched:
            self.touched(replay.attributes(self.claims_of(batch.select("permanode"))), number)

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@dataclass
class Parking:
    """Documents that wait for blobs which they name; they leave when the last one has arrived."""

    pending: DataFrame  # (ref, needed)

    def arrived(self, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """What still waits, and (ref) of documents that are complete now."""
        rest = self.pending.join(refs.select(F.col("ref").alias("needed")), "needed", "left_anti").select("ref", "needed")
        ready = self.pending.select("ref").distinct().join(rest.select("ref"), "ref", "left_anti")
        return rest, ready


@dataclass
class StandingQueries:
    """Queries by tag, run again after each batch with a schema blob; listeners hear of changes only.

    A result is compared by a digest over its rows in order, so no earlier
    result is kept on the driver.
    """

    queries: dict[str, dict] = field(default_factory=dict)
    last: dict[str, str] = field(default_factory=dict)

    def subscribe(self, tag: str, query: dict | None) -> None:
        """Without a query, the tag is unsubscribed."""
        self.last.pop(tag, None)
        if query is None:
            self.queries.pop(tag, None)
        else:
            self.queries[tag] = query

    def refresh(self, store: Store, batch: DataFrame | None, push: Callable[[str, DataFrame], None]) -> list[str]:
        """Run all queries if the batch (or none: the first time) has a schema blob; the tags that changed."""
        if batch is not None and batch.where("camli_type <> ''").isEmpty():
            return []
        search, changed = Search(store), []
        for tag, query in self.queries.items():
            rows = search.query(query)
            row = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64("ref", "time").cast("decimal(38,0)")).cast("string").alias("s")).first()
            digest = json.dumps([row["n"], row["s"]])
            if self.last.get(tag) != digest:
                self.last[tag] = digest
                changed.append(tag)
                push(tag, rows)
        return changed


def arrivals(stream: DataFrame, checkpoint: str, hear: Callable[[DataFrame], None], refs: DataFrame | None = None) -> StreamingQuery:
    """Tell a listener of the blobs (ref) of each batch, of all or of some references."""

    def batch(rows: DataFrame, _: int) -> None:
        got = rows.select("ref").distinct() if refs is None else rows.select("ref").distinct().join(refs.select("ref"), "ref", "left_semi")
        if not got.isEmpty():
            hear(got)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def wait_for_any(stream: DataFrame, checkpoint: str, refs: DataFrame | None, seconds: float) -> bool:
    """Whether a blob (of some references) arrived before the time was up."""
    heard = threading.Event()
    query = arrivals(stream, checkpoint, lambda _: heard.set(), refs)
    try:
        end = time.monotonic() + seconds
        while not heard.is_set() and time.monotonic() < end and query.isActive:
            heard.wait(0.05)
        return heard.is_set()
    finally:
        query.stop()


def copy_queue(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Copy blobs to a target at least once; the file sink's log makes it once."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay_as_stream(spark: SparkSession, claims: DataFrame, batches: int = 4) -> DataFrame:
    """Attributes after claims went through a stream in batches of mixed order: equal to the batch replay.

    A batch has many files, as many as the session deals a shuffle over, so that no
    task writes or reads a whole batch. They are sorted, as the table is, so that files and
    what is shuffled from them stay small; what came twice is left out of the lists at their end.
    """
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    files = max(batches, int(spark.conf.get("spark.sql.shuffle.partitions")))
    claims.repartition(files, "claim_ref").sortWithinPartitions("attr", "permanode").write.option("compression", "zstd").parquet(f"{folder}/in")
    target = ClaimTable(spark, f"{folder}/table")
    query = target.follow(claim_stream(spark, f"{folder}/in", -(-files // batches)), f"{folder}/checkpoint")
    query.awaitTermination()
    return replay.attributes(target.rows(), again=True)
