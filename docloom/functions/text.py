"""Text and scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LLM_PRICES = {"grok-4-fast": (2, 5), "grok-4-fast-reasoning": (2, 5), "mini": (2, 5)}
OCR_PRICES = {"ocr-latest": 2000}
ARCHIVES = ["zip", "rar", "7z"]
NATIVE = ["docx", "pdf", "xlsx"]
CONVERTED = "doc ods odp odt ppt pptx rtf xls".split()
UNPARSED = "csv htm html jpeg jpg png tif tiff txt xml".split()
MIME = {f"image/{kind}": f".{ending}" for kind, ending in [x.split(":") for x in "gif:gif bmp:bmp tiff:tiff png:png jpeg:jpg x-wmf:wmf x-emf:emf".split()]}
CHARS_PER_TOKEN = 2.7
CONTEXT_TOKENS, OUTPUT_TOKENS, RESERVED_TOKENS = 131072, 8192, 2500


def strip(t: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def section_number(t: Column) -> Column:
    """Dotted number at the start, if a dot, blank or bracket follows it; else null. Backtracks: ``1.10`` gives ``1``."""
    found = F.regexp_extract(strip(t), r"(?U)^(\p{Nd}+(?:[.]\p{Nd}+)*)[\s.)]", 1)
    return F.nullif(found, F.lit(""))


def clean(t: Column) -> Column:
    """Line ends become blanks, runs of blanks (U+0020 alone) one; stripped."""
    cleaned = strip(F.regexp_replace(F.regexp_replace(t, "[\r\n]", " "), " {2,}", " "))
    return F.when(t.rlike(r"(?U)\s"), cleaned).otherwise(t)  # the cheap test first: most cells have no white space


def cell_text(v: Column) -> Column:
    return strip(F.coalesce(v.cast("string"), F.lit("")))


def heading_level(style: Column) -> Column:
    """``heading N`` -> N within 1..6, else null."""
    n = F.regexp_extract(F.lower(style), r"heading\s+(\d+)", 1).try_cast("int")
    return F.when(n.isNotNull(), F.least(F.greatest(n, F.lit(1)), F.lit(6)))


def estimate_tokens(t: Column) -> Column:
    return F.floor(F.length(F.coalesce(t, F.lit(""))) / F.lit(CHARS_PER_TOKEN)).cast("int")


def fits_context(t: Column, reserve: int = RESERVED_TOKENS) -> Column:
    return estimate_tokens(t) <= CONTEXT_TOKENS - OUTPUT_TOKENS - reserve


def prices(model: Column, table: dict, i: int | None = None) -> Column:
    pairs = [x for name, p in table.items() for x in (F.lit(name), F.lit(p if i is None else p[i]))]
    return F.try_element_at(F.create_map(*pairs), model)


def llm_cost(model: Column, prompt: Column, completion: Column) -> Column:
    """decimal(10,6) dollars, half up; null for unknown models and for no or zero prompt tokens."""
    tenths = prompt * prices(model, LLM_PRICES, 0) + F.coalesce(completion, F.lit(0)) * prices(model, LLM_PRICES, 1)
    cost = (F.floor((tenths.cast("long") + 5) / 10).cast("decimal(18,0)") / F.lit(1000000).cast("decimal(7,0)")).cast("decimal(10,6)")
    return F.when(prompt > 0, cost)


def ocr_cost(model: Column, pages: Column) -> Column:
    return (pages * prices(model, OCR_PRICES)).cast("decimal(18,0)").__truediv__(F.lit(1000000).cast("decimal(7,0)")).cast("decimal(10,6)")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ" + "Ё"


def tokens(t: Column) -> Column:
    """Lower-case runs of Cyrillic and plain Latin letters and digits. Only those letters are lowered, before the search, so no others become them."""
    return F.regexp_extract_all(F.translate(t, _UPPER, _UPPER.lower()), F.lit("([0-9a-zа-яё]+)"), F.lit(1))


def has_tokens(t: Column) -> Column:
    return t.rlike("[0-9A-Za-zЁёА-Яа-я]")


UPLOADED = "uploaded_document"


def safe_upload_name(t: Column) -> Column:
    """Stem and suffix of a file name made safe each for itself: the suffix in lower case, of plain letters, digits and dots alone."""
    base = F.regexp_extract(t, r"([^/]*)$", 1)
    ending = F.regexp_extract(base, r"^.+?([.][^.]+)$", 1)
    stem = F.substring(base, F.lit(1), F.length(base) - F.length(ending))
    return F.concat(safe_name(stem), F.regexp_replace(F.lower(ending), "[^a-z0-9.]+", ""))


def safe_name(t: Column, default: str = UPLOADED) -> Column:
    kept = F.regexp_replace(F.regexp_replace(t, "[^._0-9a-zа-яA-ZА-Я-]+", "_"), "^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(default))


def extension(name: Column) -> Column:
    """Lower-case suffix with its dot; empty for dot files and names without one."""
    base = F.regexp_extract(name, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(base, r"^.+(\.[^.]+)$", 1))


def extension_class(ext: Column) -> Column:
    bare = F.ltrim(ext, F.lit("."))
    return F.when(bare.isin(ARCHIVES), "archive").when(bare.isin(NATIVE + CONVERTED + UNPARSED), "document").otherwise("ignored")


def route(ext: Column) -> Column:
    """Reader that a document's extension leads to."""
    bare = F.ltrim(ext, F.lit("."))
    return (
        F.when(bare.isin(NATIVE), bare).when(bare.isin("doc", "odt", "rtf"), "docx").when(bare.isin("xls", "ods"), "xlsx")
        .when(bare.isin("ppt", "odp", "pptx"), "pdf").otherwise("unsupported")
    )


def html_escape(t: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def unfence(t: Column) -> Column:
    """Text without its code-fence lines, if it starts with one."""
    s = strip(t)
    lines = F.filter(F.split(s, "\n"), lambda x: ~strip(x).startswith("```"))
    return strip(F.when(s.startswith("```"), F.array_join(lines, "\n")).otherwise(s))


def provider(url: Column) -> Column:
    return F.when(F.lower(url).contains("mistral"), "mistral").when(F.lower(url).contains("openai"), "openai").otherwise("xai")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def host_in(url: Column, suffixes: list[str]) -> Column:
    """Whether the host is one of suffixes or lies under one."""
    h = host(url)
    found = F.lit(False)
    for s in suffixes:
        found = found | (h == s.lower()) | h.endswith("." + s.lower())
    return found


def redact(url: Column) -> Column:
    return F.regexp_replace(url, "^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@", "$1***@")


def image_extension(mime: Column) -> Column:
    pairs = [F.lit(x) for kv in MIME.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(mime)), F.lit(".png"))


def backoff_seconds(attempt: Column, limited: Column, attempts: int = 3) -> Column:
    """Seconds before the next try: doubled and at most 30 where the rate was limited, none after the last attempt otherwise."""
    step = F.pow(F.lit(2.0), attempt)
    return F.when(limited, F.least(step * 2, F.lit(30.0))).when(attempt < attempts, step)


def elapsed_ms(begin: Column, end: Column) -> Column:
    """Whole milliseconds between two times."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(begin.cast("timestamp"))
    return F.floor(micros / F.lit(1000)).cast("long")


def stage_name(ext: Column) -> Column:
    return F.concat(F.lit("parse_"), F.ltrim(ext, F.lit(".")))


def numbered(prefix: str, n: Column, width: int = 3) -> Column:
    return F.format_string(f"{prefix}%0{width}d", n)


def passport_strategy(t: Column) -> Column:
    return F.when(F.coalesce(strip(t), F.lit("")) == "", "skip").when(fits_context(t), "single").otherwise("chunked")


def merge_ordered(a: Column, b: Column) -> Column:
    """Elements of a, then those of b that are new."""
    return F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))


def metadata_line(block: Column, page: Column, page_end: Column, section: Column) -> Column:
    """``block: b | page: 1-2 | section: s``, without what is null, each part escaped."""
    span = F.when(page_end != page, F.concat(F.lit("-"), page_end.cast("string"))).otherwise("")
    return F.concat_ws(
        " | ", F.concat(F.lit("block: "), html_escape(block)), F.when(page != 0, F.concat(F.lit("page: "), page.cast("string"), F.coalesce(span, F.lit("")))),
        F.when(section != "", F.concat(F.lit("section: "), html_escape(section))),
    )
