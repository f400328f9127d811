"""Tables in Markdown as rows, cells and sentences."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: What stands for "as above" in a cell, in lower case.
IDEM = ("", "id.", "id", "idem")


def lines(c: Column) -> Column:
    """The cleaned table lines of a text, without the separator below the header."""
    return F.filter(F.transform(F.split(c, r"\r?\n"), T.clean_table_line), lambda s: s.rlike(r"^\|.*\|$") & ~T.is_separator(s))


def rows(tables: DataFrame, text: str = "raw_table_text", names: Mapping[str, str] | None = None) -> DataFrame:
    """table_id, header, row_idx (from 0), cells.  Tables without a row under the header have none."""
    found = tables.withColumn("_l", lines(F.col(text))).where(F.size("_l") > 1)
    header = T.pipe_cells(F.col("_l")[0])
    if names:
        header = F.transform(header, lambda c: T.rename(c, names))
    return found.select(*[c for c in tables.columns if c != text], header.alias("header"), F.posexplode(F.slice("_l", 2, 1 << 30)).alias("row_idx", "_row")).withColumn("cells", T.pipe_cells(F.col("_row"))).drop("_row")


def cells(tables: DataFrame, text: str = "raw_table_text", names: Mapping[str, str] | None = None) -> DataFrame:
    """Unpivot: one row for each cell that isn't empty, with its column's name and place."""
    each = rows(tables, text, names)
    wide = each.select(*[c for c in each.columns if c not in ("header", "cells")], F.posexplode(F.arrays_zip(F.col("header").alias("col_name"), F.col("cells").alias("cell_value"))).alias("col_idx", "x"))
    return wide.select(*[c for c in wide.columns if c != "x"], "x.col_name", "x.cell_value").where("col_name is not null and cell_value <> ''")


def forward_fill(cells: DataFrame, by: list[str], order: str, value: str = "cell_value") -> DataFrame:
    """``filled``: the value, or for an empty one or a variant of 'idem' the last other value above it.

    What has nothing above it stays as it is.  A null counts as empty."""
    idem = F.lower(F.trim(F.coalesce(F.col(value), F.lit("")))).isin(list(IDEM))
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("filled", F.coalesce(F.last(F.when(~idem, F.col(value)), ignorenulls=True).over(w), F.col(value)))


def narrated(tables: DataFrame, text: str = "raw_table_text", title: str = "summary_text") -> DataFrame:
    """A sentence for each row: the table's title and ``column est value`` for its cells; rows of empty cells have none."""
    each = rows(tables, text)
    pairs = F.array_join(T.row_pairs(F.col("header"), F.col("cells")), ", ")
    return each.withColumn("_p", pairs).where("_p <> ''").select("id", "row_idx", F.concat(T.title_before_colon(F.col(title)), F.lit(" : "), F.col("_p")).alias("text"))


def row_chunks(tables: DataFrame, text: str = "raw_table_text", title: str = "summary_text") -> DataFrame:
    """A small Markdown table of the header and one row, for each row."""
    line = lambda c: F.concat(F.lit("| "), F.array_join(c, " | "), F.lit(" |"))
    each = rows(tables, text)
    body = F.concat_ws("\n", T.title_before_colon(F.col(title)), line(F.col("header")), line(F.col("cells")))
    return each.select(F.concat("id", F.lit("-r"), F.lpad(F.col("row_idx").cast("string"), 3, "0")).alias("id"), F.col("id").alias("table_id"), body.alias("text"))


def targeted_rows(tables: DataFrame, wanted: list[str], units: Mapping[str, str], text: str = "raw_table_text") -> DataFrame:
    """Rows of some tables as sentences, with cells filled from above and units after numbers."""
    own = cells(tables.where(F.col("id").isin(wanted)).select("id", text), text)
    filled = forward_fill(own, ["id", "col_name"], "row_idx").withColumn("v", T.with_unit(F.col("filled"), F.col("col_name"), units))
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col_idx", "col_name", "v"))), lambda x: F.concat_ws(" est ", x["col_name"], x["v"])), ", ")
    return filled.groupBy("id", "row_idx").agg(said.alias("text")).select(F.concat("id", F.lit("-tr"), F.lpad(F.col("row_idx").cast("string"), 3, "0")).alias("id"), F.col("id").alias("table_id"), "text")


def strip_repeated_headings(docs: DataFrame, key: str, text: str, least: int = 3) -> DataFrame:
    """Texts without the repetitions of heading lines that occur ``least`` times: the first of each stays."""
    split = docs.select(F.col(key), F.posexplode(F.split(text, "\n")).alias("_pos", "_line"))
    heading = F.col("_line").rlike(r"^#{1,6}\s+\S")
    same = F.trim(F.regexp_replace("_line", r"^#+\s*", ""))
    w = Window.partitionBy(key, "_h")
    marked = split.withColumn("_h", F.when(heading, same)).withColumn("_n", F.count("*").over(w)).withColumn("_k", F.row_number().over(w.orderBy("_pos")))
    kept = marked.where(F.col("_h").isNull() | (F.col("_n") < least) | (F.col("_k") == 1))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_line"))), lambda x: x["_line"]), "\n")
    return kept.groupBy(key).agg(joined.alias("text"))


def _in_chunks(df: DataFrame, by: str | None, order: str, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows with the ``_chunk`` they lie in: consecutive ranges of (by, order), whose number only grows with the order.

    A group of any size is so spread over many chunks; they are written down, as a second run may cut elsewhere."""
    keys = [order] if by is None else [by, order]
    return checkpoint(df.repartitionByRange(*keys).withColumn("_chunk", F.spark_partition_id()).withColumn("_by", F.lit("") if by is None else F.col(by)))


def _join_chunks(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """``chunks``: _by, _chunk and more; at most one row for each partition and group."""
    c = chunks.select(F.col("_by").alias("_c_by"), F.col("_chunk").alias("_c"), *[x for x in chunks.columns if x not in ("_by", "_chunk")])
    return rows.join(c, rows["_by"].eqNullSafe(F.col("_c_by")) & (rows["_chunk"] == F.col("_c")), "left").drop("_c_by", "_c")


def carry_pages(lines: DataFrame, by: str, order: str, page: str, checkpoint: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """``carried``: the last page known at or before each line, else the least of its document.

    Each chunk of lines carries its own pages on, and starts with what the chunks before it end with."""
    cut = _in_chunks(lines, by, order, checkpoint)
    ends = cut.groupBy("_by", "_chunk").agg(F.max_by(page, F.when(F.col(page).isNotNull(), F.col(order))).alias("_end"), F.min(page).alias("_least"))
    before = Window.partitionBy("_by").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("_by", "_chunk", F.last("_end", ignorenulls=True).over(before).alias("_start"), F.min("_least").over(Window.partitionBy("_by")).alias("_least"))
    within = Window.partitionBy("_by", "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = cut.withColumn("carried", F.last(page, ignorenulls=True).over(within))
    return _join_chunks(own, ends).withColumn("carried", F.coalesce("carried", "_start", "_least")).drop("_by", "_chunk", "_start", "_least")


def sequences(df: DataFrame, order: str, number: str, by: str | None = None, checkpoint: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """``sequence``: a new one starts whenever the number is 1 again (and isn't the first row).

    The first sequence is 0; chunks count their own starts, and what the chunks before them counted."""
    cut = _in_chunks(df, by, order, checkpoint).withColumn("_one", F.coalesce((F.col(number) == 1).cast("int"), F.lit(0)))
    counts = cut.groupBy("_by", "_chunk").agg(F.sum("_one").alias("_ones"), F.min_by("_one", order).alias("_first"))
    whole = Window.partitionBy("_by").orderBy("_chunk")
    counts = counts.select("_by", "_chunk", F.coalesce(F.sum("_ones").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.first("_first").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_lead"))
    within = Window.partitionBy("_by", "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = cut.withColumn("_ones", F.sum("_one").over(within))
    # a one in the very first row starts nothing anew
    return _join_chunks(own, counts).withColumn("sequence", F.col("_before") + F.col("_ones") - F.col("_lead")).drop("_by", "_chunk", "_one", "_ones", "_before", "_lead")
