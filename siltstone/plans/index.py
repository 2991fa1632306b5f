"""From a folder of files to a corpus: scan, plan against the corpus's files, parse, chunk, clean, situate, embed, write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import embed as E
from ..operators import chunking, context, corpora, hygiene, ingest
from ..sources import files


def found_files(scanned: DataFrame, root: str) -> DataFrame:
    """(root, path, size, mtime, hash) of scanned files."""
    return scanned.select(F.lit(root).alias("root"), "path", "size", F.col("modified").cast("double").alias("mtime"), F.sha2("content", 256).alias("hash"))


def chunk_rows(scanned: DataFrame, side: DataFrame | None = None, given: dict[str, str] | None = None, strategy: str = "recursive", limit: int = 1000, overlap: int = 200, profile: bool = False, embedder=E.HashEmbedder(), contextualizer=None, cache: DataFrame | None = None) -> DataFrame:
    """(id, external_id, path, chunk_index, section, chunk_text, source, metadata, v) of files: an external_id is a path, an id the hash of it and the chunk's place."""
    parsed = files.with_metadata(files.parse(scanned).where("error IS NULL"), side, given)
    chunks = chunking.chunk(files.elements(parsed), strategy, limit, overlap)
    about = parsed.select(F.col("path").alias("doc_id"), "title", "metadata")
    if profile:
        status = about.select("doc_id", F.try_element_at("metadata", F.lit("vuln_status")).alias("vuln_status"))
        chunks = hygiene.security_profile(chunks, status)[0].drop("kev_flag")
    chunks = chunks.join(about, "doc_id")
    said = F.col("text")
    if contextualizer is not None:
        held = cache if cache is not None else chunks.sparkSession.createDataFrame([], context.CACHE)
        held = context.upserted(held, context.new_rows(chunks, held, contextualizer))
        chunks = context.with_contexts(chunks, held, contextualizer)
        said = F.coalesce("contextualized_text", "text")
    section = F.col("section") if "section" in chunks.columns else F.lit(None).cast("string")
    rows = chunks.select(F.xxhash64("doc_id", "chunk_index").alias("id"), F.col("doc_id").alias("external_id"), F.col("doc_id").alias("path"), "chunk_index", section.alias("section"), F.col("text").alias("chunk_text"), F.to_json("metadata").alias("source"), "metadata", said.alias("_said"))
    return E.embed(rows, "_said", embedder).drop("_said")


def index_folder(spark: SparkSession, folder: str, corpus: str, **how) -> dict:
    """Brings a corpus up to date with a folder: only new and changed files are parsed, files that are gone lose their chunks. Returns counts by state."""
    scanned = files.scan(spark, folder)
    now = found_files(scanned, folder)
    m = corpora.manifest_of(spark, corpus)
    before = spark.read.parquet(f"{corpus}/files/v{m['version']}") if m else spark.createDataFrame([], now.schema)
    plan = ingest.incremental_plan(before.where(F.col("root") == folder), now)
    todo = scanned.join(plan.where("state IN ('new', 'changed')"), "path", "left_semi")
    fresh = chunk_rows(todo, files.sidecars(spark, folder), **how)
    if m:
        stale = plan.where("state IN ('changed', 'deleted')").select("path")
        fresh = corpora.load(spark, corpus).join(stale, "path", "left_anti").unionByName(fresh)
    kept = before.where(F.col("root") != folder).unionByName(now)
    version = (m["version"] if m else 0) + 1
    kept.write.mode("overwrite").parquet(f"{corpus}/files/v{version}")
    counts = {r.state: r["count"] for r in plan.groupBy("state").count().collect()}  # five states
    corpora.save(fresh, corpus, model=how.get("embedder", E.HashEmbedder()).model, chunking=f"{how.get('strategy', 'recursive')}:{how.get('limit', 1000)}:{how.get('overlap', 200)}")
    return counts
