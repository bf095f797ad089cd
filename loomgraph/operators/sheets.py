"""Spreadsheet cells (sheet, r, c, value) to tables and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

FOOTER_WORDS = ["total", "sum", "tong", "subtotal", "grand total"]


def table_regions(cells: DataFrame, gap: int = 0, max_rounds: int = 1000) -> DataFrame:
    """(sheet, r0, c0, r1, c1, cells): boxes of 4-connected cells; boxes at most `gap` apart are joined until none is.

    Components by smallest label over neighbour joins, so that a sheet of any size is spread over all tasks.
    """
    rows = cells.where("value is not null and trim(value) != ''").select("sheet", "r", "c").distinct()
    state = cut(rows.withColumn("label", F.struct("r", "c")))
    for _ in range(max_rounds):
        near = state.select("sheet", "label", F.explode(F.array(*[F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c")) for dr, dc in ((0, 0), (0, 1), (1, 0), (0, -1), (-1, 0))])).alias("at")).select("sheet", "at.r", "at.c", "label")
        low = near.groupBy("sheet", "r", "c").agg(F.min("label").alias("low"))
        nxt = cut(state.join(low, ["sheet", "r", "c"]).select("sheet", "r", "c", F.col("low").alias("label"), (F.col("low") < F.col("label")).alias("moved")))
        jump = nxt.select("sheet", F.col("r").alias("lr"), F.col("c").alias("lc"), F.col("label").alias("next"))
        nxt = nxt.withColumn("lr", F.col("label.r")).withColumn("lc", F.col("label.c"))
        nxt = cut(nxt.join(jump, ["sheet", "lr", "lc"]).select("sheet", "r", "c", F.col("next").alias("label"), (F.col("moved") | (F.col("next") < F.col("label"))).alias("moved")))
        state = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            break
    boxes = state.groupBy("sheet", "label").agg(F.min("r").alias("r0"), F.min("c").alias("c0"), F.max("r").alias("r1"), F.max("c").alias("c1"), F.count("*").alias("cells")).drop("label")
    while gap > 0:
        boxes = cut(boxes.withColumn("box", F.struct("r0", "c0", "r1", "c1")))
        a, b = boxes.alias("a"), boxes.alias("b")
        close = (F.col("a.sheet") == F.col("b.sheet")) & (F.col("a.r0") - F.col("b.r1") <= gap + 1) & (F.col("b.r0") - F.col("a.r1") <= gap + 1) & (F.col("a.c0") - F.col("b.c1") <= gap + 1) & (F.col("b.c0") - F.col("a.c1") <= gap + 1)
        to = a.join(b, close).groupBy("a.sheet", "a.r0", "a.c0", "a.r1", "a.c1", "a.cells").agg(F.min("b.box").alias("to"))
        merged = cut(to.groupBy("sheet", "to").agg(F.min("r0").alias("r0"), F.min("c0").alias("c0"), F.max("r1").alias("r1"), F.max("c1").alias("c1"), F.sum("cells").alias("cells"), F.count("*").alias("n")))
        boxes = merged.select("sheet", "r0", "c0", "r1", "c1", "cells")
        if merged.where("n > 1").isEmpty():
            break
    return boxes


def cell_text(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def header_rows(cells: DataFrame, most: int = 3) -> DataFrame:
    """(sheet, r): leading rows that look like headers: half text or more, half numbers at most, over one cell."""
    numeric = F.col("value").rlike(r"^\s*[-+]?[0-9][0-9.,]*\s*$").cast("int")
    rows = cells.where("value is not null and trim(value) != ''").groupBy("sheet", "r").agg(F.count("*").alias("n"), F.sum(numeric).alias("numbers"))
    rows = rows.withColumn("ok", (F.col("n") > 1) & ((F.col("n") - F.col("numbers")) / F.col("n") >= 0.5) & (F.col("numbers") / F.col("n") <= 0.5)).where("n > 1")
    w = Window.partitionBy("sheet").orderBy("r")
    rows = rows.withColumn("nth", F.row_number().over(w)).withColumn("broken", F.sum((~F.col("ok")).cast("int")).over(w))
    return rows.where((F.col("broken") == 0) & (F.col("nth") <= most)).select("sheet", "r")


def fill_merged(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Cells with the value of the top-left cell laid over the empty cells of merged ranges (sheet, r0, c0, r1, c1)."""
    top = ranges.join(cells.select("sheet", F.col("r").alias("r0"), F.col("c").alias("c0"), F.col("value").alias("top")), ["sheet", "r0", "c0"])
    spread = top.select("sheet", "top", F.explode(F.sequence("r0", "r1")).alias("r"), "c0", "c1").select("sheet", "top", "r", F.explode(F.sequence("c0", "c1")).alias("c"))
    return cells.join(spread, ["sheet", "r", "c"], "full").select("sheet", "r", "c", F.coalesce(F.nullif(F.trim("value"), F.lit("")), "top").alias("value"))


def unique_headers(headers: DataFrame) -> DataFrame:
    """Headers (sheet, c, name) with _2, _3, ... behind repeated names; an empty one is column_<c>."""
    name = F.coalesce(F.nullif(cell_text(F.col("name")), F.lit("")), F.concat(F.lit("column_"), F.col("c").cast("string")))
    w = Window.partitionBy("sheet", "name").orderBy("c")
    rows = headers.withColumn("name", name).withColumn("nth", F.row_number().over(w))
    return rows.select("sheet", "c", F.when(F.col("nth") > 1, F.concat_ws("_", "name", F.col("nth").cast("string"))).otherwise(F.col("name")).alias("name"))


def row_hash(*parts: Column) -> Column:
    """sha1 of the parts, each followed by a pipe; null counts as empty."""
    return F.sha1(F.concat(*[x for p in parts for x in (F.coalesce(p.cast("string"), F.lit("")), F.lit("|"))]))


def serialised(values: Column) -> Column:
    """`k: v. k: v` of a map's entries that aren't empty, in key order."""
    entries = F.array_sort(F.map_entries(F.map_filter(values, lambda k, v: v.isNotNull() & (F.trim(v) != ""))))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ". ")


def is_footer(values: Column) -> Column:
    """Whether a value of the map has a word for a total in it, as a substring."""
    return F.exists(F.map_values(values), lambda v: F.lower(F.coalesce(v, F.lit(""))).rlike("|".join(FOOTER_WORDS)))


def column_entities(values: Column, types: dict[str, str]) -> Column:
    """(name, type) of the columns that stand for entities, each once."""
    pairs = [F.struct(F.trim(F.try_element_at(values, F.lit(c))).alias("name"), F.lit(t).alias("type")) for c, t in sorted(types.items())]
    return F.array_distinct(F.filter(F.array(*pairs), lambda e: e["name"].isNotNull() & (e["name"] != "")))


def joined_headers(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(sheet, c, name): labels of header rows (sheet, r) of cells (sheet, r, c, value) joined by ` / ` from top to bottom;
    a column without one is col_<c>; repeated names get _2, _3, ... behind them."""
    labels = cells.join(headers, ["sheet", "r"], "left_semi").withColumn("label", cell_text(F.coalesce("value", F.lit("")))).where("label != ''")
    parts = labels.groupBy("sheet", "c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda x: x["label"]), " / ").alias("name"))
    columns = cells.select("sheet", "c").distinct().join(parts, ["sheet", "c"], "left")
    return unique_headers(columns.withColumn("name", F.coalesce("name", F.concat(F.lit("col_"), F.col("c").cast("string")))))
