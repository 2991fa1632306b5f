"""Tables of records: JSON lines with typed metadata, vulnerability feeds and catalogues, evaluation sets, weakness lists."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import infer_kind


class RecordError(ValueError):
    pass


@dataclass(frozen=True)
class RecordConfig:
    """Which fields of a record are its text, its id and its metadata, with kinds that are known and fields that are lists."""

    text_fields: tuple[str, ...]
    id_field: str = "id"
    metadata_fields: tuple[str, ...] = ()
    metadata_types: dict[str, str] = field(default_factory=dict)
    array_fields: tuple[str, ...] = ()
    cwe_field: str | None = None


# Configurations of two kinds of records, pages of an assistant and findings of a security review.
PRESETS = {
    "assistant_page": RecordConfig(
        text_fields=("text", "title", "section", "summary"),
        metadata_fields=("url", "category", "ports", "tools", "tags", "cves", "mitre_ids", "risk_signals", "requires_credentials", "risk_level", "source_file", "content_hash", "schema_version"),
        metadata_types={"requires_credentials": "bool", "schema_version": "numeric"},
        array_fields=("ports", "tools", "tags", "cves", "mitre_ids", "risk_signals"),
    ),
    "finding": RecordConfig(
        text_fields=("title", "description", "impact", "remediation", "mitigation", "replication_steps", "finding_guidance"),
        metadata_fields=("severity", "status", "source_tool", "cvss_score", "cvss_v4_score", "cwe_id", "owasp_id", "published", "false_positive", "raw_ref", "remediation_due", "tags", "attack_ids", "attack_tactics", "affected_hosts", "compliance_refs", "source_tools", "methodology_items"),
        metadata_types={"cvss_score": "numeric", "cvss_v4_score": "numeric", "cwe_id": "numeric", "published": "bool", "false_positive": "bool", "remediation_due": "date"},
        array_fields=("tags", "attack_ids", "attack_tactics", "affected_hosts", "compliance_refs", "source_tools", "methodology_items"),
        cwe_field="cwe_id",
    ),
}


def _typed(value: str, kind: Column) -> Column:
    """struct(kind, string, number, bool, date, items) of a variant; `fits` is false where it is no such value."""
    get = lambda t: F.expr(f"try_variant_get({value}, '$', '{t}')")
    is_ = lambda p: F.expr(f"schema_of_variant({value})").rlike(p)
    text = F.when(is_("^STRING$"), get("string"))
    date = F.when(text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    items = F.when(is_("^ARRAY"), get("array<string>")).otherwise(F.array(get("string")))
    number = F.when(is_(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)"), get("double"))
    flag = F.when(is_("^BOOLEAN$"), get("boolean"))
    pick = lambda k, c: F.when(kind == k, c)
    out = F.struct(kind.alias("kind"), pick("string", text).alias("string"), pick("numeric", number).alias("number"), pick("bool", flag).alias("bool"), pick("date", date).alias("date"), pick("array", items).alias("items"))
    fits = F.coalesce(out["string"].isNotNull() | out["number"].isNotNull() | out["bool"].isNotNull() | out["date"].isNotNull() | out["items"].isNotNull(), F.lit(False))
    return F.struct(out.alias("v"), fits.alias("fits"))


def records(lines: DataFrame, config: RecordConfig, line: str = "value") -> DataFrame:
    """(external_id, content_hash, text, source_json, metadata) of a column of JSON lines; blank ones are skipped.

    metadata is a map from field to struct(kind, string, number, bool, date, items). A line that is no object, an id that
    is neither string nor number, and a value that does not fit a known kind are errors when read. Null lines: skipped.
    """
    d = lines.where(F.col(line).isNotNull() & (F.trim(line) != "")).select(F.col(line).alias("source_json"), F.expr(f"try_parse_json(`{line}`)").alias("j"))
    at = lambda f: F.expr(f"try_variant_get(j, '$[\"{f}\"]', 'variant')")
    kind_of_id = F.schema_of_variant(at(config.id_field))
    the_id = F.when(kind_of_id.rlike("^(STRING|BIGINT|DOUBLE|DECIMAL)"), F.expr(f"try_variant_get(j, '$[\"{config.id_field}\"]', 'string')"))
    why = F.concat(F.when(F.col("j").isNull(), "not JSON: ").otherwise(f"no usable {config.id_field}: "), F.substring("source_json", 1, 200))
    text = F.array_join(F.array(*[F.when(F.schema_of_variant(at(f)) == "STRING", F.expr(f"try_variant_get(j, '$[\"{f}\"]', 'string')")) for f in config.text_fields]), "\n\n")
    d = d.select(F.coalesce(the_id, F.raise_error(why).cast("string")).alias("external_id"), F.sha2("source_json", 256).alias("content_hash"), text.alias("text"), "source_json", *[at(f).alias(f"_v{i}") for i, f in enumerate(config.metadata_fields)])
    entries = []
    for i, f in enumerate(config.metadata_fields):
        kind = F.lit("array") if f in config.array_fields else F.lit(config.metadata_types[f]) if f in config.metadata_types else infer_kind(f"_v{i}")
        t = _typed(f"_v{i}", kind)
        there = F.col(f"_v{i}").isNotNull() & (F.schema_of_variant(f"_v{i}") != "VOID") & kind.isNotNull()
        good = F.when(t["fits"], t["v"]).otherwise(F.raise_error(F.concat(F.lit(f"{f} does not fit its kind in record "), F.col("external_id"))).cast("struct<kind:string,string:string,number:double,bool:boolean,date:date,items:array<string>>"))
        entries.append(F.when(there, F.struct(F.lit(f).alias("key"), good.alias("value"))))
    meta = F.map_from_entries(F.filter(F.array(*entries), lambda x: x.isNotNull())) if entries else F.lit(None)
    return d.select("external_id", "content_hash", "text", "source_json", meta.alias("metadata"))


def field_kinds(recs: DataFrame, config: RecordConfig) -> DataFrame:
    """(field, kind) of all metadata fields seen, and of those whose kind is given; a field seen with several kinds has the one seen most (ties: the first by name)."""
    seen = recs.select(F.explode("metadata").alias("field", "v")).groupBy("field", "v.kind").agg(F.count("*").alias("n"))
    seen = seen.groupBy("field").agg(F.max_by("kind", F.struct("n", "kind")).alias("kind"))
    given = recs.sparkSession.createDataFrame(list(config.metadata_types.items()), "field string, kind string")
    return given.unionByName(seen.join(given, "field", "left_anti"))


def read_records(spark: SparkSession, path: str, config: RecordConfig | str) -> DataFrame:
    return records(spark.read.text(path), PRESETS[config] if isinstance(config, str) else config)


def nvd_records(feed: DataFrame) -> DataFrame:
    """feed(vulnerabilities ARRAY<STRUCT<cve>>) -> (id, status, year, severity, vendor, product, lang, text, source): English descriptions, else all; without text, dropped."""
    c = feed.select(F.explode("vulnerabilities.cve").alias("c")).select("c.*")
    english = F.expr("filter(descriptions, x -> x.lang = 'en')")
    text = F.array_join(F.when(F.size(english) > 0, english["value"]).otherwise(F.col("descriptions.value")), "\n\n")
    cpe = F.expr("split(try_element_at(flatten(flatten(transform(configurations, x -> transform(x.nodes, n -> n.cpeMatch.criteria)))), 1), ':')")
    return c.select("id", F.col("vulnStatus").alias("status"), F.expr("try_cast(substring(published, 1, 4) AS int)").alias("year"), F.expr("try_element_at(metrics.cvssMetricV31.cvssData.baseSeverity, 1)").alias("severity"), F.get(cpe, 3).alias("vendor"), F.get(cpe, 4).alias("product"), F.expr("try_element_at(descriptions.lang, 1)").alias("lang"), text.alias("text"), F.lit("nvd").alias("source")).where("text <> ''")


def known_exploited(catalogues: DataFrame, json: str = "value") -> DataFrame:
    """(cve_id): ids of catalogues, a JSON text a row, of either shape: {vulnerabilities: [{cveID}]} or {cve_ids: []}; another is an error."""
    j = catalogues.select(F.col(json).alias("t"), F.expr(f"from_json(`{json}`, 'vulnerabilities array<struct<cveID:string>>, cve_ids array<string>')").alias("j"))
    bad = F.raise_error(F.concat(F.lit("not a known-exploited catalogue: "), F.substring("t", 1, 100))).cast("array<string>")
    ids = F.when(F.col("j.vulnerabilities").isNotNull(), F.col("j.vulnerabilities.cveID")).when(F.col("j.cve_ids").isNotNull(), F.col("j.cve_ids")).otherwise(bad)
    return j.select(F.explode(ids).alias("cve_id")).distinct()


class DatasetError(ValueError):
    pass


def _check(missing: DataFrame, what: str) -> None:
    """An error that names some of the ids in missing(id), if there are any."""
    if some := [r[0] for r in missing.select("id").distinct().orderBy("id").limit(5).collect()]:
        raise DatasetError(f"{what}: {some}")


def retrieval_set(corpus: DataFrame, queries: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, queries, qrels) of tables as read from the usual retrieval benchmarks' files.

    corpus(_id, title, text), queries(_id, text), qrels(query-id, corpus-id, score). Texts are trimmed, blank titles null,
    queries without a judgement dropped; a judgement of an unknown query or document is an error.
    """
    docs = corpus.select(F.col("_id").alias("id"), F.expr("nullif(trim(title), '')").alias("title"), F.trim("text").alias("text"))
    rel = qrels.select(F.col("`query-id`").alias("query_id"), F.col("`corpus-id`").alias("doc_id"), F.col("score").cast("int").alias("relevance"))
    judged = rel.select(F.col("query_id").alias("id")).distinct()
    q = queries.select(F.col("_id").alias("id"), F.trim("text").alias("text")).join(judged, "id", "left_semi")
    _check(judged.join(q, "id", "left_anti"), "judgements of missing queries")
    _check(rel.select(F.col("doc_id").alias("id")).join(docs, "id", "left_anti"), "judgements of missing documents")
    return docs, q, rel


def read_retrieval_set(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    text = "_id string, title string, text string"
    qrels = spark.read.csv(f"{folder}/qrels/test.tsv", sep="\t", header=True, schema="`query-id` string, `corpus-id` string, score int", enforceSchema=False)
    return retrieval_set(spark.read.schema(text).json(f"{folder}/corpus.jsonl"), spark.read.schema(text).json(f"{folder}/queries.jsonl"), qrels)


def question_set(docs: DataFrame, questions: DataFrame, qrels: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(queries, qrels): strict, any judgement of an unknown query or document and any query without one is an error; else judgements of unknown documents and queries left without one are dropped."""
    ids = docs.select(F.col("id").alias("doc_id"))
    if strict:
        _check(qrels.join(questions.select(F.col("id").alias("query_id")), "query_id", "left_anti").select(F.col("query_id").alias("id")), "judgements of missing queries")
        _check(qrels.join(ids, "doc_id", "left_anti").select(F.col("doc_id").alias("id")), "judgements of missing documents")
        _check(questions.join(qrels.select(F.col("query_id").alias("id")), "id", "left_anti"), "queries without judgements")
        return questions, qrels
    kept = qrels.join(ids.distinct(), "doc_id", "left_semi")
    return questions.join(kept.select(F.col("query_id").alias("id")), "id", "left_semi"), kept


_WEAKNESS = "_ID long, _Name string, Description string, Extended_Description string, Related_Weaknesses struct<Related_Weakness:array<struct<_Nature:string,_View_ID:string,_CWE_ID:long>>>"


def read_weaknesses(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the weakness catalogue's XML."""
    return spark.read.format("xml").option("rowTag", "Weakness").schema(_WEAKNESS).load(path)


def weakness_documents(weaknesses: DataFrame, ids: list[int]) -> DataFrame:
    """(id, title, text) of the listed ones: description and extended description, a line each."""
    text = F.concat_ws("\n", *[F.expr(f"nullif(trim({c}), '')") for c in ("Description", "Extended_Description")])
    return weaknesses.where(F.col("_ID").isin(ids)).select(F.concat(F.lit("CWE-"), F.col("_ID").cast("string")).alias("id"), F.trim("_Name").alias("title"), text.alias("text"))


def weakness_edges(weaknesses: DataFrame, view: str) -> DataFrame:
    """(child, parent) of the ChildOf relations of one view."""
    e = weaknesses.select(F.col("_ID").alias("child"), F.explode("Related_Weaknesses.Related_Weakness").alias("r"))
    return e.where((F.col("r._Nature") == "ChildOf") & (F.col("r._View_ID") == view)).select("child", F.col("r._CWE_ID").alias("parent")).distinct()
