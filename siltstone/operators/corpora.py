"""Corpora: searches over several of them, lookups, hits with their rows, field selection, request checks, files on disk.

A corpus is a table of chunks(id, external_id, chunk_index, chunk_text, source, v, ...fields) kept as Parquet under a folder
with a manifest; a registry maps names to such folders.
"""

from __future__ import annotations

import datetime
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters
from . import retrieval


class RequestError(ValueError):
    pass


# --- registry and several corpora


def parse_corpora(arguments: list[str]) -> dict[str, str]:
    """name=path, or a bare path under the name `default`."""
    out = {}
    for a in arguments:
        name, found, path = a.partition("=")
        name, path = (name, path) if found else ("default", a)
        if not name or not path:
            raise RequestError(f"a corpus is given as name=path, not {a!r}")
        if name in out:
            raise RequestError(f"two corpora are called {name!r}")
        out[name] = path
    return out


def corpus_table(spark: SparkSession, registry: dict[str, str], loaded: set[str] = frozenset()) -> DataFrame:
    """(name, path, loaded), by name."""
    return spark.createDataFrame([(n, p, n in loaded) for n, p in sorted(registry.items())], "name string, path string, loaded boolean").orderBy("name")


def together(corpora: dict[str, DataFrame]) -> DataFrame:
    """The rows of all corpora with their corpus's name; one search of it is the fan-out."""
    out = None
    for name, rows in corpora.items():
        named = rows.withColumn("corpus", F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    return out


def similar(queries: DataFrame, corpora: dict[str, DataFrame], threshold: float, most: int) -> tuple[DataFrame, DataFrame]:
    """(hits, stats) of a threshold search over corpora(id, v, ...): each query's best `most`, ties by corpus and id; candidates, above and returned of each query and corpus."""
    rows = together(corpora)
    found = retrieval.scored(queries, rows, threshold=threshold)
    rank = F.row_number().over(retrieval.Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus", "id"))
    hits = found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)
    seen = rows.groupBy("corpus").agg(F.count("*").alias("candidates"))
    each = found.groupBy("query_id", "corpus").agg(F.count("*").alias("above"))
    back = hits.groupBy("query_id", "corpus").agg(F.count("*").alias("returned"))
    asked = queries.select("query_id").crossJoin(F.broadcast(seen))  # a row a corpus
    stats = asked.join(each, ["query_id", "corpus"], "left").join(back, ["query_id", "corpus"], "left").fillna(0, ["above", "returned"])
    return hits, stats


# --- hits


def filtered_ids(hits: DataFrame, metadata: DataFrame, condition) -> DataFrame:
    """hits(query_id, id, score, ...) whose metadata(id, ...) meets a filter (text, JSON or Column); those without metadata go."""
    ok = metadata.where(condition) if isinstance(condition, Column) else filters.apply(metadata, condition)
    return hits.join(ok.select("id"), "id", "left_semi").select(*hits.columns)


def hydrated(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, external_id, score, source, chunks) of hits(query_id, id, score): chunks of one document together, its score their best."""
    j = hits.select("query_id", "id", "score").join(chunks.select("id", "external_id", "chunk_index", "chunk_text", "source"), "id")
    part = F.struct((-F.col("score")).alias("o"), "id", "chunk_index", "chunk_text", "score")
    g = j.groupBy("query_id", "external_id").agg(F.max("score").alias("score"), F.first("source", ignorenulls=True).alias("source"), F.array_sort(F.collect_list(part)).alias("c"))
    return g.select("query_id", "external_id", "score", "source", F.transform("c", lambda x: F.struct(x["id"].alias("id"), x["chunk_index"].alias("chunk_index"), x["chunk_text"].alias("chunk_text"), x["score"].alias("score"))).alias("chunks"))


def hit_rows(hits: DataFrame, chunks: DataFrame, snippet: Column | None = None) -> DataFrame:
    """A row a chunk: hits with the chunk's text, document, metadata fields, and a snippet."""
    out = hits.join(chunks.drop("v", *[c for c in hits.columns if c in chunks.columns and c != "id"]), "id")
    return out.withColumn("snippet", snippet) if snippet is not None else out


def lookup(corpus: DataFrame, field: str, value: str) -> DataFrame:
    """At most one row whose field has the value, read as the field's type: strings, numbers and booleans; other types are an error. An unknown field or an unreadable value: none."""
    if field not in corpus.columns:
        return corpus.limit(0)
    kind = corpus.schema[field].dataType.typeName()
    if kind == "string":
        return corpus.where(F.col(field) == value).limit(1)
    if kind in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        return corpus.where(F.col(field) == F.expr(f"try_cast('{float(value)}' AS double)")).limit(1) if _number(value) else corpus.limit(0)
    if kind == "boolean":
        if value not in ("true", "1", "false", "0"):
            return corpus.limit(0)
        return corpus.where(F.col(field) == F.lit(value in ("true", "1"))).limit(1)
    raise RequestError(f"{field} is {kind}; lookups are by string, number or boolean")


def _number(value: str) -> bool:
    try:
        float(value)
        return "_" not in value
    except ValueError:
        return False


def lookup_cve(corpus: DataFrame, cve: str) -> DataFrame:
    return lookup(corpus, "cve_id", cve.upper())


def lookup_known_exploited(corpus: DataFrame, cve: str) -> DataFrame:
    """The record of a CVE that is flagged as known to be exploited."""
    return lookup_cve(corpus, cve).where(F.coalesce(F.col("kev_flag").cast("string") == "true", F.lit(False)))


def lookup_weakness(corpus: DataFrame, cwe: str) -> DataFrame:
    return lookup(corpus, "cwe_id", cwe.upper().removeprefix("CWE-"))


# --- fields


def parse_fields(text: str | None) -> tuple[str, list[str]]:
    """('all', []), ('include', names) or ('exclude', names) of a comma-separated list; a minus excludes, and the two can't be mixed."""
    parts = [p.strip() for p in (text or "").split(",") if p.strip()]
    if not parts:
        return "all", []
    out = [p.startswith("-") for p in parts]
    if any(out) and not all(out):
        raise RequestError("fields are either all included or all excluded")
    return ("exclude", [p.lstrip("-") for p in parts]) if out[0] else ("include", parts)


def project(rows: DataFrame, fields: str | None) -> DataFrame:
    """The selected columns; `source.x` stands for a field of the struct or map `source`. Unknown names are passed over."""
    how, names = parse_fields(fields)
    if how == "all":
        return rows
    subs = [n.removeprefix("source.") for n in names if n.startswith("source.")]
    tops = [n for n in names if not n.startswith("source.")]
    kind = rows.schema["source"].dataType if "source" in rows.columns else None
    inner = kind.names if kind is not None and kind.typeName() == "struct" else None
    if how == "include":
        out = rows.select(*[c for c in rows.columns if c in tops or (subs and c == "source")])
        return _sub(out, inner, subs) if subs and kind is not None else out
    out = rows.drop(*tops)
    if subs and "source" in out.columns:
        out = out.withColumn("source", F.col("source").dropFields(*[s for s in subs if s in inner])) if inner and any(s in inner for s in subs) else out if inner else out.withColumn("source", F.map_filter("source", lambda k, v: ~k.isin(subs)))
    return out


def _sub(rows: DataFrame, inner: list[str] | None, subs: list[str]) -> DataFrame:
    if inner is not None:
        return rows.withColumn("source", F.struct(*[F.col("source")[s].alias(s) for s in inner if s in subs]))
    return rows.withColumn("source", F.map_filter("source", lambda k, v: k.isin(subs)))


# --- requests


def for_tenant(condition, field: str, tenant: str | None):
    """The filter and the tenant's own; a missing tenant is an error."""
    if not tenant:
        raise RequestError("the request names no tenant")
    own = filters.Compare(field, "=", tenant)
    return own if condition is None else filters.Bool("AND", (filters.parse(condition) if isinstance(condition, str) else condition, own))


def check_verify(block: dict) -> float:
    """The threshold of {method: minhash, threshold: 0..1}."""
    if not isinstance(block, dict):
        raise RequestError("verify must be an object")
    if extra := sorted(set(block) - {"method", "threshold"}):
        raise RequestError(f"verify has the unknown field {extra[0]!r}")
    if block.get("method") != "minhash":
        raise RequestError(f"verify.method must be 'minhash', not {block.get('method')!r}")
    t = block.get("threshold")
    if isinstance(t, bool) or not isinstance(t, (int, float)) or not 0 <= t <= 1:
        raise RequestError("verify.threshold must be a number from 0 to 1")
    return float(t)


RANKING = ("hybrid", "rrf_k", "rrf_overfetch", "time_decay_field", "time_decay_halflife", "time_decay_weight", "time_decay_dateless_prior", "time_decay_blend", "cwe_expand", "rerank")


def check_similar(request: dict, known: set[str]) -> list[str]:
    """The corpora that a similarity request is for, after checks of its text, threshold, size and corpora; ranking options are refused."""
    if used := [k for k in RANKING if request.get(k) is not None]:
        raise RequestError(f"a similarity search has no {used[0]}")
    if not request.get("text"):
        raise RequestError("text must not be empty")
    if not 0 <= request.get("threshold", -1) <= 1:
        raise RequestError("threshold must be from 0 to 1")
    if not 1 <= request.get("max_results", 10) <= 1000:
        raise RequestError("max_results must be from 1 to 1000")
    one, many = request.get("corpus"), request.get("corpora")
    if one is not None and many is not None:
        raise RequestError("either corpus or corpora")
    if many is not None and not many:
        raise RequestError("corpora must not be empty")
    names = [one] if one is not None else many or ["default"]
    if missing := [n for n in names if n not in known]:
        raise RequestError(f"no corpus is called {missing[0]!r}")
    if request.get("verify") is not None:
        check_verify(request["verify"])
    return list(names)


# --- on disk

FORMAT = 5


def _text(spark: SparkSession, path: str, content: str | None = None):
    """Reads or writes a small text file in any store that Spark reaches; None where it is missing."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if content is None:
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
    out = fs.create(p, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()
    return None


def save(corpus: DataFrame, folder: str, tombstones: DataFrame | None = None, **manifest) -> dict:
    """Writes the rows under a new version and then the manifest that points to it: readers see the old corpus or the new one."""
    spark = corpus.sparkSession
    before = manifest_of(spark, folder)
    version = (before["version"] if before else 0) + 1
    corpus.write.mode("overwrite").parquet(f"{folder}/rows/v{version}")
    if tombstones is not None:
        tombstones.select("id").write.mode("overwrite").parquet(f"{folder}/tombstones/v{version}")
    now = datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds")
    m = {"created_at": now, **{k: v for k, v in (before or {}).items() if k not in ("version", "tombstones")}, **manifest, "format": FORMAT, "version": version, "tombstones": tombstones is not None, "updated_at": now}
    _text(spark, f"{folder}/manifest.json", json.dumps(m, indent=1))
    return m


def manifest_of(spark: SparkSession, folder: str) -> dict | None:
    found = _text(spark, f"{folder}/manifest.json")
    if found is None:
        return None
    m = json.loads(found)
    if m.get("format") != FORMAT:
        raise RequestError(f"{folder} has format {m.get('format')}, not {FORMAT}")
    return m


def load(spark: SparkSession, folder: str, live: bool = True) -> DataFrame:
    """The corpus's rows, without those that have a tombstone."""
    m = manifest_of(spark, folder)
    if m is None:
        raise RequestError(f"{folder} holds no corpus")
    rows = spark.read.parquet(f"{folder}/rows/v{m['version']}")
    if live and m["tombstones"]:
        rows = rows.join(spark.read.parquet(f"{folder}/tombstones/v{m['version']}"), "id", "left_anti")
    return rows


def compact(spark: SparkSession, folder: str) -> dict:
    """Rewrites the corpus without tombstones."""
    return save(load(spark, folder), folder)


def info(spark: SparkSession, folder: str) -> tuple[dict, DataFrame]:
    """(manifest, files): the distinct source files, by name."""
    return manifest_of(spark, folder), load(spark, folder).select("path").distinct().orderBy("path")


def stats(spark: SparkSession, folder: str) -> DataFrame:
    """One row: live and tombstoned chunks, documents, bytes, and the manifest's model, chunking and times."""
    m, every, live = manifest_of(spark, folder), load(spark, folder, live=False), load(spark, folder)
    a = live.agg(F.count("*").alias("live"), F.count_distinct("external_id").alias("documents"), F.coalesce(F.sum(F.octet_length("chunk_text").cast("long")), F.lit(0)).alias("bytes"))
    b = every.agg(F.count("*").alias("rows"))
    j = a.crossJoin(b)  # one row each
    return j.select("live", (F.col("rows") - F.col("live")).alias("tombstoned"), "documents", "bytes", *[F.lit(m.get(k)).cast("string").alias(k) for k in ("model", "chunking", "created_at", "updated_at")])


BUNDLE = 1


def check_bundle(spark: SparkSession, folder: str) -> dict:
    """The bundle's manifest after checks: its version, at least one corpus, each with a manifest, and the taxonomy's file."""
    found = _text(spark, f"{folder}/bundle.json")
    if found is None:
        raise RequestError(f"{folder} has no bundle.json")
    m = json.loads(found)
    if m.get("schema_version") != BUNDLE:
        raise RequestError(f"the bundle has version {m.get('schema_version')}, not {BUNDLE}")
    if not m.get("corpora"):
        raise RequestError("the bundle names no corpus")
    for name in m["corpora"]:
        if manifest_of(spark, f"{folder}/corpora/{name}") is None:
            raise RequestError(f"the bundle's corpus {name!r} is missing")
    if _text(spark, f"{folder}/taxonomy/{m['taxonomy']}") is None:
        raise RequestError(f"the bundle's taxonomy {m['taxonomy']!r} is missing")
    return m


def load_bundle(spark: SparkSession, folder: str) -> tuple[dict, dict[str, DataFrame], dict]:
    """(manifest, corpora by name, taxonomy)"""
    m = check_bundle(spark, folder)
    return m, {n: load(spark, f"{folder}/corpora/{n}") for n in m["corpora"]}, json.loads(_text(spark, f"{folder}/taxonomy/{m['taxonomy']}"))
