"""Document algebra: sections, numbering, packing lines into chunks, tables, and text and HTML of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

MIN_CHUNK, MAX_CHUNK = 50, 2000
OVERLAP_CHARS = 200


def _upto(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def fill_section(rows: DataFrame, keys: list[str], order: str, section: str, out: str = "section") -> DataFrame:
    """The last section number before or at each row."""
    return rows.withColumn(out, F.last(section, ignorenulls=True).over(_upto(keys, order)))


def fill_section_reset(rows: DataFrame, keys: list[str], order: str, section: str, heading: str, out: str = "section") -> DataFrame:
    """fill_section, begun anew at headings without a number."""
    reset = F.sum((F.col(heading) & F.col(section).isNull()).cast("int")).over(_upto(keys, order))
    return fill_section(rows.withColumn("__reset", reset), [*keys, "__reset"], order, section, out).drop("__reset")


def section_runs(rows: DataFrame, keys: list[str], order: str, section: str, label: str = "label", run: str = "run", first: str = "__header__") -> DataFrame:
    """Runs of rows in one section: a row whose section is set and isn't the current one begins a run, other rows go with it."""
    s = F.nullif(F.col(section), F.lit(""))
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    begins = s.isNotNull() & ~s.eqNullSafe(F.last(s, ignorenulls=True).over(before))
    marked = rows.withColumn(run, F.sum(begins.cast("int")).over(_upto(keys, order)))
    return marked.withColumn(label, F.coalesce(F.last(s, ignorenulls=True).over(_upto(keys, order)), F.lit(first)))


def number_blocks(rows: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """block_id: texts ``_bNNN`` and tables ``_tbl_NNN``, each kind numbered for itself."""
    n = F.sum(F.lit(1)).over(_upto([key, kind], order))
    name = F.when(F.col(kind) == "table", F.format_string("%s_tbl_%03d", F.col(key).cast("string"), n)).otherwise(F.format_string("%s_b%03d", F.col(key).cast("string"), n))
    return rows.withColumn("block_id", name)


def number_together(rows: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """block_id as paged documents have it: texts by their place among all blocks, tables by their place among tables."""
    n, t = F.sum(F.lit(1)).over(_upto([key], order)), F.sum(F.lit(1)).over(_upto([key, kind], order))
    name = F.when(F.col(kind) == "table", F.format_string("%s_tbl_%03d", F.col(key).cast("string"), t)).otherwise(F.format_string("%s_b%03d", F.col(key).cast("string"), n))
    return rows.withColumn("block_id", name)


def _strings() -> Column:
    return F.array().cast("array<string>")


def pack_lines(t: Column, limit: int = MAX_CHUNK) -> Column:
    """Greedy chunks of whole lines: a line that would pass the limit begins the next chunk; one longer than it stays whole."""
    return _packed(t, limit)


def pack_overlapping(t: Column, limit: int, overlap: int = OVERLAP_CHARS) -> Column:
    """Chunks of whole lines of at most limit characters, line ends counted, each begun with the last lines of the one before, of overlap characters at most."""
    return _packed(t, limit, overlap)


def _packed(t: Column, limit: int, overlap: int | None = None) -> Column:
    """One pass over a text's lines that keeps only where chunks begin and how long they are, in bytes (s, k); they are cut out of the text once these are known.

    Nothing is held but the text at hand, whatever the size of a batch: no rows go to Python.
    """
    length, size = F.length, F.octet_length

    def record(a: Column) -> Column:
        """Bytes, not an array: a fold copies the arrays of its state at every line."""
        return F.concat(a["s"].cast("string"), F.lit(" "), (a["at"] - a["s"] - 1).cast("string")).cast("binary")

    def kept(cur: Column) -> Column:
        """How many of the last lines the next chunk begins with, their characters and, line ends counted, bytes."""
        made = lambda k, n, b, on: F.struct(k.alias("k"), n.alias("n"), b.alias("b"), on.alias("on"))
        more = lambda a, x: F.when(a["on"] & (a["n"] + x["n"] <= overlap), made(a["k"] + 1, a["n"] + x["n"], a["b"] + x["b"] + 1, F.lit(True))).otherwise(made(a["k"], a["n"], a["b"], F.lit(False)))
        return F.aggregate(F.reverse(cur), made(F.lit(0), F.lit(0), F.lit(0), F.lit(True)), more)

    def step(a: Column, line: Column) -> Column:
        one = F.array(F.struct(length(line).alias("n"), size(line).alias("b")))
        at = a["at"] + size(line) + 1
        state = lambda cuts, s, n, cur: F.struct(cuts.alias("cuts"), s.alias("s"), (n + length(line) + 1).alias("n"), at.alias("at"), cur.alias("cur"))
        cuts = F.concat(a["cuts"], record(a), F.lit(b"\n"))
        if overlap is None:
            fresh, on = state(cuts, a["at"], F.lit(0), one), a["cur"]  # one line is enough to tell that there are some
        else:
            fresh = _let(kept(a["cur"]), lambda x: state(cuts, a["at"] - x["b"], x["n"], F.concat(F.slice(a["cur"], F.size(a["cur"]) - x["k"] + 1, x["k"]), one)))
            on = F.concat(a["cur"], one)
        full = (a["at"] > 0) & (a["n"] + length(line) + int(overlap is not None) > limit)
        return F.when(full, fresh).otherwise(state(a["cuts"], a["s"], a["n"], on))

    none = F.lit(b"").alias("cuts"), F.lit(0).alias("s"), F.lit(0).alias("n"), F.lit(0).alias("at"), F.array().cast("array<struct<n:int,b:int>>").alias("cur")
    cuts = F.aggregate(F.split(t, "\n", -1), F.struct(*none), step, lambda a: F.split(F.concat(a["cuts"], record(a)).cast("string"), "\n", -1))
    number = lambda c, i: F.split_part(c, F.lit(" "), F.lit(i)).cast("int")
    return _let(t.cast("binary"), lambda whole: F.transform(cuts, lambda c: F.substring(whole, number(c, 1) + 1, number(c, 2)).cast("string")))


def section_chunks(blocks: DataFrame, key: str = "doc_id", order: str = "ord", section: str = "section_path", text: str = "text", block: str = "block_id", least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """doc_id, chunk_no, section_path, text, text_preview, text_length, block_ids: each run of a section, blank blocks aside, joined;
    short runs go, long ones are packed by lines and the parts after the first are named ``section#i``."""
    runs = section_runs(blocks.where(T.strip(F.col(text)) != "") if section is None else blocks, [key], order, section)
    visible = T.strip(F.coalesce(F.col(text), F.lit(""))) != ""
    item = F.struct(F.col(order).alias("o"), F.col(text).alias("t"), F.col(block).alias("b"))
    joined = runs.groupBy(key, "run").agg(F.first("label").alias("label"), F.min(order).alias("at"), F.array_sort(F.collect_list(F.when(visible, item))).alias("x"))
    full = joined.withColumn("full", F.array_join(F.transform("x", lambda i: i["t"]), "\n")).where(F.length("full") >= least)
    parts = full.select(key, "run", "label", F.transform("x", lambda i: i["b"]).alias("block_ids"), F.posexplode(F.coalesce(pack_lines(F.when(F.length("full") > most, F.col("full")), most), F.array("full"))).alias("i", "text"))
    return parts.select(
        F.col(key).alias("doc_id"), (F.row_number().over(Window.partitionBy(key).orderBy("run", "i")) - 1).alias("chunk_no"),
        F.when(F.col("i") > 0, F.concat("label", F.lit("#"), F.col("i").cast("string"))).otherwise(F.col("label")).alias("section_path"),
        "text", F.substring("text", 1, 200).alias("text_preview"), F.length("text").alias("text_length"), "block_ids",
    )


def row_class(cells: Column, first: Column, width: Column, strict: bool = True) -> Column:
    """header, section or data. strict: a section row needs some text, all of it short; otherwise an empty row is one too."""
    filled = F.filter(cells, lambda c: c.rlike(r"(?U)\S"))
    section = (width >= 4) & (F.size(filled) <= 2)
    if strict:
        section = section & (F.size(filled) > 0) & F.forall(filled, lambda c: F.length(c) < 200)
    return F.when(first, "header").when(section, "section").otherwise("data")


def table_width(spans: Column) -> Column:
    """Widest row: spans is array<array<int>> of column spans."""
    return F.array_max(F.transform(spans, lambda r: F.aggregate(r, F.lit(0), lambda a, x: a + x)))


def grid_starts(spans: Column) -> Column:
    """First column (from 1) of each cell."""
    return F.transform(spans, lambda _, i: F.aggregate(F.slice(spans, F.lit(1), i), F.lit(1), lambda a, x: a + x))


def column_width(cells: Column) -> Column:
    """Sheet column width for its cells: the longest word or a third of the text, within 8..60, and two more within 60."""
    need = F.transform(F.filter(cells, lambda c: c != ""), lambda c: F.least(F.greatest(F.array_max(F.transform(F.filter(F.split(c, "\\s+"), lambda w: w != ""), lambda w: F.length(w))), F.floor(F.length(c) / 3).cast("int")), F.lit(60)))
    return F.least(F.greatest(F.coalesce(F.array_max(need), F.lit(8)), F.lit(8)) + 2, F.lit(60))


def merge_split_row(a: Column, b: Column) -> Column:
    """Row a continued by row b of the same width, cell by cell; null if the widths differ or b is empty."""
    cell = lambda x, y: F.when((x != "") & (y != ""), F.trim(F.concat(x, F.lit(" "), y))).when(x != "", x).otherwise(y)
    return F.when((F.size(a) == F.size(b)) & F.exists(b, lambda c: c != ""), F.zip_with(a, b, cell))


def same_row(a: Column, b: Column) -> Column:
    return F.coalesce((a == b) | (F.transform(a, T.strip) == F.transform(b, T.strip)), F.lit(False))


def _let(value: Column, body) -> Column:
    """body of a value that is reckoned once: in a fold, an expression is reckoned again wherever it is named."""
    return F.transform(F.array(value), body)[0]


def stitch_sessions(elements: DataFrame, key: str = "doc_id", order: str = "seq", kind: str = "kind", width: str = "ncols") -> DataFrame:
    """session of each table element: it goes on with the table right before it if that is as wide; a text closes it."""
    w = Window.partitionBy(key).orderBy(order)
    joins = (F.lag(kind).over(w) == "table") & (F.lag(width).over(w) == F.col(width))
    fresh = (F.col(kind) == "table") & ~F.coalesce(joins, F.lit(False))
    return elements.withColumn("session", F.sum(fresh.cast("int")).over(_upto([key], order))).where(F.col(kind) == "table")


def stitched(parts: Column) -> Column:
    """Rows of a session's tables as one: a repeated header goes, a row split by the page end is put together. parts: array of structs whose r is a table's rows, in their order."""

    def step(done: Column, part: Column) -> Column:
        more = part["r"]
        more = F.when((F.size(more) > 1) & same_row(done[0], more[0]), F.slice(more, F.lit(2), F.size(more))).otherwise(more)
        return _let(more, lambda m: _let(merge_split_row(F.element_at(done, -1), m[0]), lambda both: (
            F.when(both.isNotNull(), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(both), F.slice(m, F.lit(2), F.size(m)))).otherwise(F.concat(done, m))
        )))

    return F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), parts[0]["r"], step)


def stitch(tables: DataFrame, keys: list[str], order: str = "seq", rows: str = "rows") -> DataFrame:
    """rows of each session's tables as one."""
    parts = tables.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(rows).alias("r")))).alias("p"))
    return parts.select(*keys, stitched(F.col("p")).alias("rows"))


def scan_pages(pages: DataFrame, images: DataFrame, keys: list[str], threshold: int = 50) -> DataFrame:
    """Pages with less text than the threshold that images cover by more than half."""
    area = images.groupBy(*keys).agg(F.sum(F.abs(F.col("x1") - F.col("x0")) * F.abs(F.col("bottom") - F.col("top"))).alias("area"))
    return pages.where(F.length(T.strip(F.coalesce("text", F.lit("")))) < threshold).join(area, keys).where(F.col("area") > F.col("width") * F.col("height") * 0.5)


def clamp_box(x0: Column, top: Column, x1: Column, bottom: Column, width: Column, height: Column) -> Column:
    """The box within its page; null where nothing is left."""
    a, b, c, d = F.greatest(x0, F.lit(0.0)), F.greatest(top, F.lit(0.0)), F.least(x1, width), F.least(bottom, height)
    return F.when((a < c) & (b < d), F.struct(a.alias("x0"), b.alias("top"), c.alias("x1"), d.alias("bottom")))


def row_text(cells: Column) -> Column:
    return F.array_join(cells, " | ")


def block_text(kind: Column, content: Column, rows: Column, ocr: Column) -> Column:
    """What a block gives to the index."""
    return F.when(kind == "text", content).when(kind == "table", F.array_join(F.transform(rows, row_text), "\n")).otherwise(F.coalesce(ocr, F.lit("")))


def prompt_text(kind: Column, content: Column, level: Column, rows: Column, ocr: Column, page: Column) -> Column:
    """What a block gives to a prompt; null where it gives nothing. The first three rows of a table stand for it."""
    cut = lambda r: F.array_join(F.transform(r["cells"], lambda c: F.substring(c, 1, 50)), " | ")
    n = F.size(rows)
    head = F.format_string("[Table: %d columns, %d rows]", F.array_max(F.transform(rows, lambda r: F.size(r["cells"]))), n)
    shown = F.transform(F.slice(rows, 1, 3), lambda r: F.concat(F.lit("  "), r["row_type"], F.lit(": "), cut(r)))
    rest = F.when(n > 3, F.array(F.format_string("  ... %d more rows", n - 3))).otherwise(_strings())
    where = F.when(page.isNotNull(), F.format_string(" (page %d)", page)).otherwise("")
    return (
        F.when(kind == "text", F.when(level > 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), content)).otherwise(content))
        .when(kind == "table", F.array_join(F.concat(F.array(head), shown, rest), "\n"))
        .when(ocr != "", F.concat(F.lit("[OCR"), where, F.lit("]\n"), ocr))
    )


def as_cells(cells: Column) -> Column:
    """Plain strings as cells that span nothing."""
    return F.transform(cells, lambda v: F.struct(v.alias("value"), F.lit(1).alias("colspan"), F.lit(1).alias("rowspan")))


def block_html(kind: Column, block: Column, content: Column, level: Column, rows: Column, ocr: Column, meta: Column, image: Column | None = None) -> Column:
    """rows: row_type and cells of value, colspan and rowspan. image: the address of the block's picture, null where there is none."""
    tag = F.when(level > 0, F.concat(F.lit("h"), level.cast("string"))).otherwise("p")
    body = F.concat(F.lit("<"), tag, F.lit(">"), T.html_escape(content), F.lit("</"), tag, F.lit(">"))

    def span(name: str, n: Column) -> Column:
        return F.when(n > 1, F.format_string(f' {name}="%d"', n)).otherwise("")

    def line(r: Column) -> Column:
        c = F.when(r["row_type"] == "header", "th").otherwise("td")
        cell = lambda x: F.concat(F.lit("<"), c, span("colspan", x["colspan"]), span("rowspan", x["rowspan"]), F.lit(">"), T.html_escape(x["value"]), F.lit("</"), c, F.lit(">"))
        return F.concat(F.lit('<tr class="'), T.html_escape(r["row_type"]), F.lit('">'), F.array_join(F.transform(r["cells"], cell), ""), F.lit("</tr>"))

    table = F.concat(F.lit("<table>"), F.array_join(F.transform(rows, line), ""), F.lit("</table>"))
    shown = F.lit("") if image is None else F.coalesce(F.concat(F.lit('<img src="'), T.html_escape(image), F.lit('" alt="'), T.html_escape(block), F.lit('" />')), F.lit(""))
    picture = F.concat(shown, F.when(ocr != "", F.concat(F.lit('<pre class="ocr-text">'), T.html_escape(ocr), F.lit("</pre>"))).otherwise(""))
    inner = F.when(kind == "text", body).when(kind == "table", table).otherwise(picture)
    return F.concat(F.lit('<section class="block '), kind, F.lit('-block" data-block-id="'), T.html_escape(block), F.lit('"><div class="block-meta">'), meta, F.lit("</div>"), inner, F.lit("</section>"))


def of_kind(blocks: Column, kind: str) -> Column:
    """The blocks of one kind of an array of blocks, in their order."""
    return F.filter(blocks, lambda b: b["type"] == kind)


def rows_of(rows: Column, kind: str) -> Column:
    """The rows of one kind of a table: headers, data, ..."""
    return F.filter(rows, lambda r: r["row_type"] == kind)


def header_of(rows: Column) -> Column:
    """Cells of a table's first header row; null where it has none."""
    return F.get(rows_of(rows, "header"), F.lit(0))["cells"]


def merge_repeated(cells: Column) -> Column:
    """Of cells (id, value) that follow one another with one id the first: a merged cell is listed once for each column that it covers."""
    return F.filter(cells, lambda c, i: (i == 0) | ~c["id"].eqNullSafe(F.get(cells, i - 1)["id"]))


def pick_blocks(blocks: DataFrame, wanted: list[str] | None, block: str = "block_id") -> DataFrame:
    """Blocks whose id one of the comma-separated lists names; all where none names any."""
    ids = {i.strip() for w in wanted or [] for i in w.split(",")} - {""}
    return blocks.where(F.col(block).isin(sorted(ids))) if ids else blocks
