"""Corpus maintenance: upsert plans, incremental plans, deletes, inference of record fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def upsert_plan(corpus: DataFrame, incoming: DataFrame) -> DataFrame:
    """corpus(external_id, hash), incoming(external_id, line, hash) -> (external_id, action): new, changed, unchanged or kept. The last line of an id wins."""
    last = incoming.withColumn("_r", F.row_number().over(Window.partitionBy("external_id").orderBy(F.desc("line")))).where("_r = 1").select("external_id", F.col("hash").alias("new_hash"))
    action = F.when(F.col("hash").isNull(), "new").when(F.col("new_hash").isNull(), "kept").when(F.col("hash") == F.col("new_hash"), "unchanged").otherwise("changed")
    return corpus.select("external_id", "hash").join(last, "external_id", "full_outer").select("external_id", action.alias("action"))


def upsert(corpus: DataFrame, incoming: DataFrame) -> DataFrame:
    """The corpus after the upsert: rows of ids that do not come in, and the last incoming line of each id."""
    last = incoming.withColumn("_r", F.row_number().over(Window.partitionBy("external_id").orderBy(F.desc("line")))).where("_r = 1")
    return corpus.join(last.select("external_id"), "external_id", "left_anti").unionByName(last.select(*corpus.columns))


def incremental_plan(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """manifest and found (root, path, size, mtime, hash) -> (root, path, state): unchanged, touched, changed, new or deleted."""
    m = manifest.select("root", "path", F.col("size").alias("s0"), F.col("mtime").alias("t0"), F.col("hash").alias("h0"))
    j = m.join(found, ["root", "path"], "full_outer")
    state = F.when(F.col("h0").isNull(), "new").when(F.col("hash").isNull(), "deleted").when((F.col("s0") == F.col("size")) & (F.col("t0") == F.col("mtime")), "unchanged").when(F.col("h0") == F.col("hash"), "touched").otherwise("changed")
    return j.select("root", "path", state.alias("state"))


def delete(corpus: DataFrame, ids: DataFrame) -> DataFrame:
    return corpus.join(ids.select("external_id").distinct(), "external_id", "left_anti")


def infer_kind(value: str) -> Column:
    """Kind of a JSON value held as a variant: bool, numeric, date, string, array; null for objects and nulls."""
    s = f"schema_of_variant({value})"
    text = f"try_variant_get({value}, '$', 'string')"
    return F.expr(f"CASE WHEN {s} = 'BOOLEAN' THEN 'bool' WHEN {s} LIKE 'ARRAY%' THEN 'array' WHEN {s} = 'STRING' THEN if({text} rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' AND try_to_date({text}, 'yyyy-MM-dd') IS NOT NULL, 'date', 'string') WHEN {s} LIKE 'OBJECT%' OR {s} = 'VOID' THEN NULL ELSE 'numeric' END")


def infer_fields(records: DataFrame, json: str) -> DataFrame:
    """(field, kind, n): how often each field has each kind."""
    e = records.select(F.explode(F.expr(f"cast(try_parse_json({json}) AS map<string, variant>)")).alias("field", "v"))
    return e.select("field", infer_kind("v").alias("kind")).where("kind IS NOT NULL").groupBy("field", "kind").agg(F.count("*").alias("n"))
