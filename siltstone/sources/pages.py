"""Layout of pages from positioned text: rows, tables, columns, footnotes, images, tables that go on.

items(doc_id, page, seq, x, y, text): text at a place, y growing upwards. A page is a bounded group (what one page holds);
documents are never gathered, except for the tables of a document, which are merged by windows over them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How far apart items of one row (y) and of one column (x) may lie; the least rows and columns of a table; the
# share of a page that is footnotes; superscript digits.
ROW_GAP, COLUMN_GAP, LEAST_ROWS, LEAST_COLUMNS, NOTES = 3.0, 10.0, 2, 2, 0.15
SUPERSCRIPTS = "\u2070\u00b9\u00b2\u00b3\u2074\u2075\u2076\u2077\u2078\u2079"


def page_columns(items: DataFrame, gap: float = 40.0) -> DataFrame:
    """items(page, seq, x, y) -> with column_no and reading_order: columns are split where distinct x lie more than gap apart."""
    w = Window.partitionBy("page").orderBy("x")
    xs = items.select("page", "x").distinct().withColumn("_new", F.when(F.col("x") - F.lag("x").over(w) > gap, 1).otherwise(0)).withColumn("column_no", F.sum("_new").over(w).cast("long")).drop("_new")
    j = items.join(xs, ["page", "x"])
    return j.withColumn("reading_order", F.row_number().over(Window.partitionBy("page").orderBy("column_no", F.desc("y"), "x", "seq")).cast("long"))


def _each(starts: np.ndarray, ends: np.ndarray, first, step) -> None:
    """A fold over each group of items at once: first(groups, items), then step(groups, items) for the second item of each, the third and so on."""
    groups = np.argsort(starts - ends, kind="stable")  # the longest first
    size = (ends - starts)[groups]
    first(groups, starts[groups])
    for k in range(1, int(size[0]) if len(size) else 0):
        groups = groups[: np.searchsorted(-size, -k)]
        step(groups, starts[groups] + k)


def _row_starts(y: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether an item begins a row, of pages whose items are sorted from top to bottom: a row holds what lies less than ROW_GAP below its first item."""
    new, top = np.zeros(len(y), bool), np.zeros(len(starts))

    def first(g, i):
        new[i], top[g] = True, y[i]

    def step(g, i):
        far = np.abs(y[i] - top[g]) >= ROW_GAP
        new[i[far]], top[g[far]] = True, y[i[far]]

    _each(starts, ends, first, step)
    return new


def _columns(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The column of each item of tables that lie end to end: columns are the means of groups of sorted places, a place within COLUMN_GAP of a group's mean so far joins it; an item belongs to the nearest."""
    of = np.repeat(np.arange(len(starts)), ends - starts)
    sorted_x = x[np.lexsort((x, of))]
    last, total, n, mean = np.zeros(len(starts), np.int64), np.zeros(len(starts)), np.ones(len(starts)), np.full(len(x), np.nan)

    def first(g, i):
        total[g] = mean[i] = sorted_x[i]

    def step(g, i):
        v = sorted_x[i]
        joins = np.abs(v - total[g] / n[g]) < COLUMN_GAP
        total[g], n[g], last[g] = np.where(joins, total[g] + v, v), np.where(joins, n[g] + 1, 1), last[g] + ~joins
        mean[starts[g] + last[g]] = total[g] / n[g]

    _each(starts, ends, first, step)
    column, best, left = np.zeros(len(x), np.int64), np.abs(x - mean[starts[of]]), np.arange(len(x))
    for k in range(1, int(last.max(initial=0)) + 1):
        left = left[last[of[left]] >= k]
        d = np.abs(x[left] - mean[starts[of[left]] + k])
        nearer = (d < best[left]) | (np.isnan(d) & ~np.isnan(best[left]))
        best[left[nearer]], column[left[nearer]] = d[nearer], k
    return column


def _laid_out(x: np.ndarray, y: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row_no, place, table_no, column_no) of items of pages that lie end to end; -1 outside tables."""
    new = _row_starts(y, starts, ends)
    row = np.cumsum(new) - 1
    at = np.append(np.flatnonzero(new), len(x))  # where rows begin
    page = np.repeat(np.arange(len(starts)), ends - starts)
    wide, of_page = np.diff(at) >= LEAST_COLUMNS, page[at[:-1]]
    # runs of rows of one page that are all wide, or all not
    run = np.flatnonzero(np.concatenate([[True], (wide[1:] != wide[:-1]) | (of_page[1:] != of_page[:-1])])[: len(wide)])
    upto = np.append(run[1:], len(wide))
    good = wide[run] & (upto - run >= LEAST_ROWS)
    a, z = at[run[good]], at[upto[good]]  # the tables' items
    number, tables_of = np.arange(len(a)), of_page[run[good]]
    number = number - np.searchsorted(tables_of, tables_of)
    table, column = np.full(len(x), -1), np.full(len(x), -1)
    size = z - a
    ends_in = np.cumsum(size)
    items = np.repeat(a - (ends_in - size), size) + np.arange(int(size.sum()))
    table[items] = np.repeat(number, size)
    column[items] = _columns(x[items], ends_in - size, ends_in)
    order = np.lexsort((np.arange(len(row)), x, row))
    place = np.empty(len(row), np.int64)
    place[order] = np.arange(len(row)) - at[row]  # rows lie in order
    return row - row[starts][page], place, table, column


def _whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole pages from rows sorted by the two keys in front, with where pages begin."""

    def starts(t: pa.Table | pa.RecordBatch) -> np.ndarray:
        codes = [pa.array(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c).dictionary_encode("encode").indices.to_numpy() for c in (t.column(0), t.column(1))]
        return np.flatnonzero(np.concatenate([[True], (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])]))

    def done(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(parts).combine_chunks()
        return t, starts(t)

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cut = int(starts(b)[-1])
        key = lambda x, i: [repr(x.column(k)[i].as_py()) for k in (0, 1)]
        if held and key(held[-1], held[-1].num_rows - 1) != key(b, 0):
            yield done(held)
            held = []
        if cut:
            yield done([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield done(held)


def rows_and_tables(items: DataFrame) -> DataFrame:
    """items with row_no (from the top), place in the row, table_no and column_no (null outside tables).

    A table is a run of LEAST_ROWS and more rows with LEAST_COLUMNS and more items each; its columns are the groups of its
    items' places, and an item belongs to the nearest. Items are sorted by page, and the pages of a batch laid out together.
    """
    keys = ["doc_id", "page"]
    kinds = [items.schema[k].dataType.simpleString() for k in keys]
    rows = items.select(*keys, "seq", "x", "y", "text").repartition(*keys).sortWithinPartitions(*keys, -F.col("y"), "seq", "x", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _whole_pages(batches):
            seq, text = t.column("seq").cast(pa.int64()), t.column("text").cast(pa.string())
            x, y = (t.column(c).cast(pa.float64()).to_numpy().astype(np.float64) for c in ("x", "y"))
            row, place, table, column = _laid_out(x, y, starts, np.append(starts[1:], len(x)))
            made = [pa.array(x), pa.array(y), text, pa.array(row), pa.array(place), pa.array(table, mask=table < 0), pa.array(column, mask=column < 0)]
            yield from pa.table([t.column(0), t.column(1), seq, *made], names=[*keys, "seq", "x", "y", "text", "row_no", "place", "table_no", "column_no"]).to_batches(max_chunksize=1 << 16)

    return rows.mapInArrow(run, f"doc_id {kinds[0]}, page {kinds[1]}, seq long, x double, y double, text string, row_no long, place long, table_no long, column_no long")


def _table_markdown(rows: Column) -> Column:
    """An array of arrays of cells as a Markdown table."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = line(F.transform(rows[0], lambda c: F.lit("---")))
    return F.array_join(F.concat(F.array(line(rows[0]), rule), F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), line)), "\n")


def tables(marked: DataFrame) -> DataFrame:
    """(doc_id, page, table_no, rows, text) of rows_and_tables(): cells of a row and column are joined by spaces."""
    cell = marked.where("table_no IS NOT NULL").groupBy("doc_id", "page", "table_no", "row_no", "column_no").agg(F.array_join(F.array_sort(F.collect_list(F.struct("place", "text")))["text"], " ").alias("cell"))
    by = cell.groupBy("doc_id", "page", "table_no", "row_no").agg(F.map_from_entries(F.collect_list(F.struct("column_no", "cell"))).alias("m"), (F.max("column_no") + 1).alias("w"))
    whole = by.groupBy("doc_id", "page", "table_no").agg(F.array_sort(F.collect_list(F.struct("row_no", F.map_entries("m").alias("m")))).alias("x"), F.max("w").alias("w"))
    cells = F.expr("transform(x, r -> transform(array(map_from_entries(r.m)), m -> transform(sequence(0L, w - 1), k -> coalesce(try_element_at(m, k), '')))[0])")
    out = whole.select("doc_id", "page", "table_no", cells.alias("rows"))
    return out.withColumn("text", _table_markdown(F.col("rows")))


def outside_tables(marked: DataFrame) -> DataFrame:
    """The items that belong to no table."""
    return marked.where("table_no IS NULL").drop("row_no", "place", "table_no", "column_no")


def table_rows(text: Column) -> Column:
    """Cells of each row of a Markdown table; rules between rows are left out."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.regexp_replace(x, r"^\|*\s*", "").startswith("---"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"), lambda c: F.trim(c)))


def continued(tables_: DataFrame) -> DataFrame:
    """(doc_id, page, table_no, text, page_span) of tables(doc_id, page, table_no, text): a table on the page behind, with as many columns, goes on; a repeated header is left out.

    A run of such tables is one: where it begins is told by the table before, so runs are sums over a window of the
    document's tables.
    """
    w = Window.partitionBy("doc_id").orderBy("page", "table_no")
    t = tables_.withColumn("r", table_rows(F.col("text"))).withColumn("n", F.size(F.col("r")[0]))
    joins = (F.col("page") == F.lag("page").over(w) + 1) & (F.col("n") == F.lag("n").over(w)) & (F.size("r") > 0)
    t = t.withColumn("run", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(w))
    g = t.groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(F.struct("page", "table_no", "r"))).alias("x"))
    head = F.col("x")[0]["r"][0]
    more = F.flatten(F.transform(F.col("x")["r"], lambda r, i: F.when(i == 0, r).when(r[0] == head, F.slice(r, 2, F.size(r))).otherwise(r)))
    last = F.element_at("x", -1)["page"]
    span = F.when(last > F.col("x")[0]["page"], F.concat_ws("-", F.col("x")[0]["page"], last))
    return g.select("doc_id", F.col("x")[0]["page"].alias("page"), F.col("x")[0]["table_no"].alias("table_no"), _table_markdown(more).alias("text"), span.alias("page_span"))


def footnotes(items: DataFrame, height: Column) -> DataFrame:
    """items with reference_id and note: set where an item in the lowest part of a page begins with a mark: [N], a superscript digit, N. or N and a space."""
    t = F.regexp_replace("text", r"\A\s+|\s+\z", "")
    low = (height > 0) & (F.col("y") < height * NOTES)
    bracket, plain = r"\A\[([0-9]+)\]\s*((?s).*)\z", r"\A([0-9]+)(?:[ \t]|\.)\.*\s*((?s).*)\z"
    sup = rf"\A([{SUPERSCRIPTS}])\s*((?s).*)\z"
    pick = lambda g: F.when(t.rlike(bracket), F.regexp_extract(t, bracket, g)).when(t.rlike(sup), F.regexp_extract(t, sup, g)).when(t.rlike(plain), F.regexp_extract(t, plain, g))
    return items.withColumn("reference_id", F.when(low, F.translate(pick(1), SUPERSCRIPTS, "0123456789"))).withColumn("note", F.when(low, pick(2)))


def image_kind(width: Column, height: Column) -> Column:
    """chart for wide images of more than 200 points, else figure."""
    ratio = F.try_divide(width.cast("float"), height)
    return F.when((width > 200) & (height > 0) & ratio.between(1.2, 3.0), "chart").otherwise("figure")


def is_scanned(text: Column, images: Column) -> Column:
    """A page with an image and less than ten bytes of text."""
    return (F.octet_length(F.trim(F.coalesce(text, F.lit("")))) < 10) & (F.coalesce(images, F.lit(0)) > 0)
