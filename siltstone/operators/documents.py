"""Element tables: text parsing, hierarchy, captions, titles, context, rejected and known documents. Lengths are UTF-8 bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRIM = r"^\s+|\s+$"


def parse_text(docs: DataFrame, separator: str = r"\n\s*\n") -> DataFrame:
    """docs(doc_id, text) -> (doc_id, pos, kind, depth, text): a block an element; short capitals are titles, short blocks ending in a colon headings."""
    e = docs.select("doc_id", F.posexplode(F.split("text", separator)).alias("pos", "text")).withColumn("text", F.regexp_replace("text", TRIM, "")).where("text <> ''")
    size = F.octet_length("text")
    title = (size <= 100) & (F.col("text") == F.upper("text")) & F.col("text").rlike("[A-Z]")
    heading = (size <= 80) & F.col("text").endswith(":")
    kind = F.when(title, "title").when(heading, "heading").otherwise("paragraph")
    return e.select("doc_id", F.col("pos").cast("long").alias("pos"), kind.alias("kind"), F.when(kind == "heading", 1).otherwise(0).cast("long").alias("depth"), "text")


def hierarchy(elements: DataFrame, depths: int = 8) -> DataFrame:
    """Adds id, parent_id and children. A heading's parent is the nearest heading before it of smaller depth; anything else hangs on the heading before it. Depths from `depths` on count as the deepest."""
    e = elements.withColumn("id", F.concat(F.lit("el-"), "pos")).withColumn("_d", F.when(F.col("kind") == "title", 0).when(F.col("kind") == "heading", F.col("depth")))
    # the last heading of each depth that occurs, carried down the document; the nearest of smaller depth is the parent
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("_d") == k, F.struct("pos", "id")), ignorenulls=True).over(before) for k in range(depths)]
    other = F.max(F.when(F.col("_d") >= depths, F.struct("pos", "id"))).over(before)
    e = e.withColumns({f"_l{k}": c for k, c in enumerate(last)} | {"_o": other})
    nearest = lambda n: F.array_max(F.array(*[F.col(f"_l{k}") for k in range(n)]))["id"]
    parent = F.coalesce(*[F.when(F.col("_d") == k, nearest(k)) for k in range(1, depths)], F.when(F.col("_d").isNull(), F.array_max(F.array(*[F.col(f"_l{k}") for k in range(depths)], F.col("_o")))["id"]), F.when(F.col("_d") >= depths, nearest(depths)))
    e = e.withColumn("parent_id", parent).drop("_d", "_o", *[f"_l{k}" for k in range(depths)])
    kids = e.where("parent_id IS NOT NULL").groupBy("doc_id", "parent_id").agg(F.expr("transform(array_sort(collect_list(struct(pos, id))), x -> x.id)").alias("children"))
    return e.join(kids.select(F.col("doc_id").alias("_d"), F.col("parent_id").alias("_p"), "children"), (F.col("doc_id") == F.col("_d")) & (F.col("id") == F.col("_p")), "left").drop("_d", "_p").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))


def context(template: str, title: Column, section: Column, text: Column) -> Column:
    out = F.lit(template)
    for name, c in (("{document_title}", title), ("{section}", section), ("{chunk_text}", text)):
        out = F.replace(out, F.lit(name), F.coalesce(c, F.lit("")))
    return out


# Statuses that a record is dropped for.
REJECTED = ("Rejected", "Disputed")


def reject(docs: DataFrame, status: str = "vuln_status", values: tuple = REJECTED) -> DataFrame:
    return docs.where(~F.coalesce(F.col(status).isin(*values), F.lit(False)))


def tag_known(docs: DataFrame, catalogue: DataFrame, key: str, flag: str = "kev_flag") -> DataFrame:
    """flag is true where docs.key is in catalogue.key, else null."""
    known = catalogue.select(F.col(key).alias("_k"), F.lit(True).alias(flag)).distinct()
    return docs.join(known, docs[key] == known["_k"], "left").drop("_k")


# What a caption begins with, in any case, before its number.
CAPTIONS = ["figure ", "figure\u00a0", "fig. ", "fig ", "table ", "image ", "illustration ", "plate "]
NEAR = 3


def is_caption(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"(?U)\A\s+", "").rlike("\\A(" + "|".join(c.replace(".", "[.]") for c in CAPTIONS) + ")[0-9]")


def captions(elements: DataFrame) -> DataFrame:
    """elements with caption_id on images and image_id on captions (ids as in hierarchy()).

    Each image takes, in order, the nearest caption paragraph within NEAR elements that no image before it took; of two at
    one distance the one behind. The fold over a document holds its images' candidates only, not its elements.
    """
    e = elements.withColumn("_c", is_caption(F.col("text")) & (F.col("kind") == "paragraph"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    e = e.withColumn("_n", F.row_number().over(w))
    around = F.filter(F.array(*[F.when((F.lead("_c", k) if k > 0 else F.lag("_c", -k)).over(w), F.col("_n") + k) for k in (1, -1, 2, -2, 3, -3)]), lambda x: x.isNotNull())
    e = e.withColumn("_near", F.when(F.col("kind") == "image", around))
    d = e.where(F.size("_near") > 0).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("_n", "_near"))).alias("x"))
    none = "cast(array() AS array<struct<i:int,c:int>>)"
    fold = f"aggregate(x, {none}, (s, y) -> concat(s, transform(slice(filter(y._near, n -> NOT exists(slice(s, -{2 * NEAR}, {2 * NEAR}), t -> t.c = n)), 1, 1), n -> named_struct('i', y._n, 'c', n))))"
    fold = fold.replace(f"slice(s, -{2 * NEAR}, {2 * NEAR})", f"slice(s, greatest(1, size(s) - {2 * NEAR - 1}), {2 * NEAR})")
    pairs = d.select("doc_id", F.explode(F.expr(fold)).alias("p")).select("doc_id", "p.i", "p.c")
    ids = e.select("doc_id", "_n", F.concat(F.lit("el-"), "pos").alias("id"))
    both = pairs.select("doc_id", F.col("i").alias("_n"), F.col("c").alias("to"), F.lit(True).alias("img")).unionByName(pairs.select("doc_id", F.col("c").alias("_n"), F.col("i").alias("to"), F.lit(False).alias("img")))
    both = both.join(ids.select("doc_id", F.col("_n").alias("to"), "id"), ["doc_id", "to"])
    j = e.join(both.select("doc_id", "_n", "id", "img"), ["doc_id", "_n"], "left")
    return j.select(*elements.columns, F.when(F.col("img"), F.col("id")).alias("caption_id"), F.when(~F.col("img"), F.col("id")).alias("image_id"))


def document_titles(elements: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """(doc_id, title): the given(doc_id, title), else the first title or heading that is not blank."""
    found = elements.where(F.col("kind").isin("title", "heading") & (F.trim("text") != "")).groupBy("doc_id").agg(F.min_by("text", "pos").alias("title"))
    if given is None:
        return found
    g = given.select("doc_id", F.col("title").alias("_given"))
    return g.join(found, "doc_id", "full_outer").select("doc_id", F.coalesce(F.when(F.trim("_given") != "", F.col("_given")), F.col("title")).alias("title"))
