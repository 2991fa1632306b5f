"""Records that keep coming: JSON lines read as a stream and upserted into a corpus, a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import embed as E
from ..operators import corpora, ingest
from ..sources import feeds


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(value): lines of text files as they arrive in a folder."""
    return spark.readStream.text(folder)


def stamped(records: DataFrame, field: str | None, tenant: str | None) -> DataFrame:
    """Records with the tenant that sent them in their metadata; a missing tenant is an error where a field is set."""
    if field is None:
        return records
    if not tenant:
        raise corpora.RequestError("the request names no tenant")
    return records.withColumn("tenant_" + field, F.lit(tenant))


def batch_rows(lines: DataFrame, config: feeds.RecordConfig, embedder=E.HashEmbedder(), tenant_field: str | None = None, tenant: str | None = None) -> DataFrame:
    """Corpus rows of a table of JSON lines; of several lines with one id the one with the greatest text hash stays."""
    r = feeds.records(lines, config)
    r = r.groupBy("external_id").agg(F.max_by(F.struct("content_hash", "text", "source_json"), "content_hash").alias("r")).select("external_id", "r.*")
    rows = stamped(r.select(F.xxhash64("external_id").alias("id"), "external_id", F.col("external_id").alias("path"), F.lit(0).cast("long").alias("chunk_index"), F.col("text").alias("chunk_text"), F.col("source_json").alias("source"), F.col("content_hash").alias("hash")), tenant_field, tenant)
    return E.embed(rows, "chunk_text", embedder)


def upsert_batch(spark: SparkSession, corpus: str, rows: DataFrame) -> dict[str, int]:
    """Puts rows into a corpus: equal hashes are left, others replace or join it. Returns counts of new, changed and unchanged."""
    if corpora.manifest_of(spark, corpus) is None:
        corpora.save(rows, corpus)
        return {"new": corpora.load(spark, corpus).count()}
    old = corpora.load(spark, corpus)
    plan = ingest.upsert_plan(old.select("external_id", "hash"), rows.select("external_id", F.lit(0).alias("line"), "hash"))
    counts = {r.action: r["count"] for r in plan.where("action <> 'kept'").groupBy("action").count().collect()}  # three actions
    changed = plan.where("action IN ('new', 'changed')").select("external_id")
    if set(counts) - {"unchanged"}:
        corpora.save(old.join(changed, "external_id", "left_anti").unionByName(rows.join(changed, "external_id", "left_semi"), allowMissingColumns=True), corpus)
    return counts


def ingest_stream(lines: DataFrame, corpus: str, config: feeds.RecordConfig, checkpoint: str, embedder=E.HashEmbedder(), tenant_field: str | None = None, tenant: str | None = None, available_now: bool = True):
    """Starts the stream into a corpus. An upsert of one batch twice gives the same corpus, so a restart from the checkpoint is safe."""

    def put(batch: DataFrame, _: int) -> None:
        upsert_batch(batch.sparkSession, corpus, batch_rows(batch, config, embedder, tenant_field, tenant))

    w = lines.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
