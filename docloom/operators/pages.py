"""Blocks of paged documents from what a page reader finds: texts, tables and scans.

Elements: doc_id, page (from 1), kind (text, table or scan), top, seq (order of finding), content, raw_rows (array of rows of strings). Scans stand for whole pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import blocks as B


def placed(elements: DataFrame) -> DataFrame:
    """Texts, non-empty tables and scans with pos, session (of tables), ord (of the block they belong to), closed, pages and section_path.

    One shuffle and one sort by document: texts and tables by page and place on it, a text before a table at the same height, then scans by page. The rest
    counts for the number of pages alone. Everything runs along that order, so nothing is joined and no document is held as a whole.
    """
    table = (F.col("kind") == "table") & (F.size("raw_rows") > 0)
    part = F.when((F.col("kind") == "text") | table, 0).when(F.col("kind") == "scan", 1).otherwise(2)
    e = elements.withColumns({
        "part": part, "late": F.when(F.col("kind") == "text", 0).otherwise(1), "ncols": F.when(table, F.size(F.col("raw_rows")[0])), "sec": F.when(F.col("kind") == "text", T.section_number(F.col("content"))),
    })
    place = Window.partitionBy("doc_id").orderBy("part", "page", "top", "late", "seq")
    upto, whole = place.rowsBetween(Window.unboundedPreceding, 0), place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = e.withColumns({
        "pos": F.row_number().over(place), "before": F.lag(F.struct("part", "kind", "ncols", "page")).over(place), "closed": F.lead(F.when(F.col("part") == 0, F.col("page"))).over(place),
        "pages": F.max("page").over(whole), "section_path": F.last("sec", ignorenulls=True).over(upto),
    })
    goes_on = F.coalesce((F.col("before.kind") == "table") & (F.col("before.ncols") == F.col("ncols")), F.lit(False))
    fresh = (F.col("part") == 0) & (F.col("kind") == "table") & ~goes_on
    same_scan = F.coalesce(F.col("before.part") == 1, F.lit(False)) & F.col("before.page").eqNullSafe(F.col("page"))
    begins = F.when(F.col("part") == 0, (F.col("kind") == "text") | fresh).otherwise(~same_scan)
    numbered = near.withColumns({"session": F.sum(fresh.cast("int")).over(upto), "ord": (F.sum(begins.cast("int")).over(upto) - 1).cast("int")})
    return numbered.where("part < 2").drop("part", "late", "before", "sec")


def scan_id(page: Column) -> Column:
    return F.format_string("%s_scan_%03d", F.col("doc_id").cast("string"), page)


def page_blocks(elements: DataFrame) -> DataFrame:
    """doc_id, ord, block_id, type, page, page_end, content, section_path, col_count, rows, ocr_status.

    Tables that follow one another without a text between them and are as wide are one. Texts and tables count together (``_b``), tables also for
    themselves (``_tbl_``). A table ends on the page where the next text or other table begins, the last one on the last page. Scans come last, by page.
    """
    part = F.struct(
        F.col("pos").alias("o"), F.transform("raw_rows", lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit("")))).alias("r"),
        "kind", "page", "content", "section_path", "session", "ncols", "closed", "pages",
    )
    blocks = placed(elements).groupBy("doc_id", "ord").agg(F.sort_array(F.collect_list(part)).alias("p"))
    one, key = F.col("p")[0], F.col("doc_id").cast("string")
    kind, width = one["kind"], one["ncols"]
    typed = F.transform(B.stitched(F.col("p")), lambda r, i: F.struct(B.row_class(r, i == 0, width, strict=False).alias("row_type"), F.transform(r, T.clean).alias("cells")))
    name = F.when(kind == "table", F.format_string("%s_tbl_%03d", key, one["session"])).when(kind == "text", F.format_string("%s_b%03d", key, F.col("ord") + 1)).otherwise(scan_id(one["page"]))
    return blocks.select(
        "doc_id", "ord", name.alias("block_id"), F.when(kind == "scan", "image").otherwise(kind).alias("type"), F.array_min(F.col("p")["page"]).alias("page"),
        F.when(kind == "table", F.coalesce(F.element_at("p", -1)["closed"], one["pages"])).alias("page_end"), F.when(kind == "text", one["content"]).alias("content"),
        F.when(kind != "scan", one["section_path"]).alias("section_path"), F.when(kind == "table", width).alias("col_count"), F.when(kind == "table", typed).alias("rows"), F.when(kind == "scan", "pending").alias("ocr_status"),
    )


def scan_blocks(elements: DataFrame) -> DataFrame:
    """doc_id, ord, block_id, page of page_blocks' scans, without putting tables together."""
    scans = placed(elements).where("kind = 'scan'")
    return scans.groupBy("doc_id", "ord").agg(F.first("page").alias("page")).select("doc_id", "ord", scan_id(F.col("page")).alias("block_id"), "page")


def outside(words: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Words (x0, top, x1, bottom) that lie in none of their page's boxes, by their middle; empty boxes don't count."""
    b = boxes.where("x0 < x1 AND top < bottom").select(*[F.col(k).alias(f"b_{k}") for k in keys], *[F.col(c).alias(f"b_{c}") for c in ("x0", "top", "x1", "bottom")])
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    on = [F.col(k) == F.col(f"b_{k}") for k in keys] + [x >= F.col("b_x0"), x < F.col("b_x1"), y >= F.col("b_top"), y < F.col("b_bottom")]
    return words.join(b, on, "left_anti")


def page_text(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys, top, content: each page's words in reading order, lines by their top; top is the least."""
    item = F.struct("top", "x0", "text")
    g = words.groupBy(*keys).agg(F.min("top").alias("top"), F.array_sort(F.collect_list(item)).alias("w"))
    joined = F.aggregate("w", F.struct(F.lit("").alias("t"), F.lit(None).cast("double").alias("y")), lambda s, w: F.struct(F.when(s["y"].isNull(), w["text"]).otherwise(F.concat(s["t"], F.when(w["top"] > s["y"], "\n").otherwise(" "), w["text"])).alias("t"), w["top"].cast("double").alias("y")))
    return g.select(*keys, "top", joined["t"].alias("content"))
