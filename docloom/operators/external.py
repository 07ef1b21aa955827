"""Calls to outside services row by row: chat, structured answers, OCR, embeddings, downloads, conversions, with retries and cost rows.

A client is a function given by the caller (there is none here). Results and usage are columns, so a retried task gives the
same rows and nothing is kept between rows. Calls go out once per row that needs one: filter before.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T

ATTEMPTS = 3
TRY = "status string, duration_ms long, prompt_tokens long, completion_tokens long, cost_usd double, error string"
USAGE = f"answer string, status string, attempts int, prompt_tokens long, completion_tokens long, cost_usd double, error string, tries array<struct<{TRY.replace(' ', ':').replace(',:', ',')}>>"
EMPTY_SUMMARY = "The document has no text that could be read (a scan without recognition, or an empty file)."


class RateLimited(Exception):
    pass


class Fatal(Exception):
    """Not worth another try (no connection, wrong key)."""


class DownloadError(Exception):
    pass


class Unauthorized(DownloadError):
    pass


class NotFound(DownloadError):
    pass


class EmptyBody(DownloadError):
    pass


class ConversionError(Exception):
    pass


def wait_seconds(attempt: int, limited: bool, attempts: int = ATTEMPTS) -> float:
    if limited:
        return min(2.0**attempt * 2, 30.0)
    return 2.0**attempt if attempt < attempts else 0.0


def cost_of(model: str, prompt: int | None, completion: int | None) -> float | None:
    price = T.LLM_PRICES.get(model)
    if price is None or not prompt:
        return None
    return (prompt * price[0] + (completion or 0) * price[1] + 5) // 10 / 1e6


def unfenced(text: str) -> str:
    s = text.strip()
    return "\n".join(x for x in s.split("\n") if not x.strip().startswith("```")).strip() if s.startswith("```") else s


def call(client: Callable, prompt: str, model: str, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep, schema: str | None = None) -> tuple:
    """client gives {"text", "prompt_tokens", "completion_tokens"} or raises; it is told the JSON schema of the answer where there is one.

    Gives the answer, status, number of tries, tokens, cost and error of the last try, and a row for every try.
    """
    tries: list[tuple] = []
    for i in range(1, attempts + 1):
        began, error, text, p, c = time.monotonic(), None, None, None, None
        try:
            r = client(prompt) if schema is None else client(prompt, schema)
            text, status, p, c = r["text"], "success", r.get("prompt_tokens"), r.get("completion_tokens")
        except RateLimited as e:
            error, status = str(e), "rate_limited"
        except TimeoutError as e:
            error, status = str(e), "timeout"
        except Exception as e:  # noqa: BLE001
            error, status = str(e), "fatal" if isinstance(e, Fatal) else "error"
        fatal, status = status == "fatal", "error" if status == "fatal" else status
        tries.append((status, int((time.monotonic() - began) * 1000), p, c, cost_of(model, p, c), None if error is None else error[:2000]))
        if status == "success" or fatal:
            break
        if i < attempts:
            sleep(wait_seconds(i, status == "rate_limited", attempts))
    status, _, p, c, cost, error = tries[-1]
    return text, status, len(tries), p, c, cost, error, tries


def ask(rows: DataFrame, client: Callable, model: str, key: str = "id", prompt: str = "prompt", kind: str = "string", schema: str | None = None) -> DataFrame:
    """key and the usage columns for each row."""
    names = ["answer", "status", "attempts", "prompt_tokens", "completion_tokens", "cost_usd", "error", "tries"]
    fields = [f.split(" ")[0] for f in TRY.split(", ")]

    def run(batches):
        for b in batches:
            out = [(k, *call(client, p, model, schema=schema)) for k, p in zip(b[key], b[prompt])]
            frame = pd.DataFrame(out, columns=[key, *names]).astype({"prompt_tokens": "Int64", "completion_tokens": "Int64", "cost_usd": "float64"})
            frame["tries"] = [[dict(zip(fields, t)) for t in row[-1]] for row in out]
            yield frame

    return rows.select(key, prompt).mapInPandas(run, f"{key} {kind}, {USAGE}")


def usage_rows(asked: DataFrame, service: str, action: str, model: str, url: str, key: str = "id", collection: Column | None = None) -> DataFrame:
    """A fact row for every try of ask(), as the usage log has them; the error is cut to 2000 characters."""
    one = asked.select(key, F.posexplode("tries").alias("attempt", "t"), (collection if collection is not None else F.lit(None).cast("string")).alias("tender_id"))
    tokens = F.coalesce("t.prompt_tokens", F.lit(0)) + F.coalesce("t.completion_tokens", F.lit(0))
    return one.select(
        F.lit(service).alias("service"), F.lit(action).alias("action"), T.provider(F.lit(url)).alias("provider"), F.lit(model).alias("model"), "tender_id", F.col(key).alias("doc_id"), (F.col("attempt") + 1).alias("attempt"),
        "t.prompt_tokens", "t.completion_tokens", F.when(F.col("t.prompt_tokens").isNotNull(), tokens).alias("total_tokens"), "t.cost_usd", "t.duration_ms", "t.status", F.col("t.error").alias("error_message"),
    )


def structured(answers: DataFrame, schema: str, text: str = "answer") -> DataFrame:
    """The answers' JSON (fences taken off) as column ``value``; null where it isn't JSON."""
    return answers.withColumn("value", F.from_json(T.unfence(F.col(text)), schema))


def ask_structured(rows: DataFrame, client: Callable[[str, str], dict], model: str, schema: str, key: str = "id", prompt: str = "prompt", kind: str = "string") -> DataFrame:
    """ask() with the answer's schema told to the client, and ``value`` read by it."""
    return structured(ask(rows, client, model, key, prompt, kind, schema), schema)


def ping(client: Callable[[str], dict]) -> bool:
    """Whether the service answers at all."""
    try:
        client("ping")
    except Exception:  # noqa: BLE001
        return False
    return True


def embed(rows: DataFrame, client: Callable[[list[str]], list[list[float]]], key: str = "id", text: str = "text", batch: int = 32, kind: str = "string") -> DataFrame:
    """Vectors in batches, answers in the order of the texts."""

    def run(batches):
        for b in batches:
            texts = list(b[text])
            vectors = [v for i in range(0, len(texts), batch) for v in client(texts[i : i + batch])]
            yield pd.DataFrame({key: b[key], "vector": vectors})

    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, vector array<float>")


def embed_query(client: Callable[[list[str]], list[list[float]]], query: str) -> list[float]:
    """One text's vector."""
    return [float(x) for x in client([query])[0]]


def passports(chunks: DataFrame, client: Callable, model: str, schema: str | None = None) -> DataFrame:
    """doc_id, answer, cost_usd, status: map and reduce of (doc_id, chunk_no, text) into a summary for each document.

    A document without text isn't sent: its summary says that it is empty. One chunk is asked once; several are summed up each, then together in their order;
    a chunk that fails stands as an error note, a merge that fails as a null answer with status error.
    """
    key = F.concat_ws("#", F.col("doc_id").cast("string"), F.col("chunk_no").cast("string"))
    filled = chunks.groupBy(F.col("doc_id").cast("string").alias("doc_id")).agg(F.count_if(T.strip(F.coalesce("text", F.lit(""))) != "").alias("n"))
    blank = F.to_json(F.struct(F.lit("empty").alias("doc_type"), F.col("doc_id").alias("title"), F.lit(EMPTY_SUMMARY).alias("summary")))
    empty = filled.where("n = 0").select("doc_id", blank.alias("answer"), F.lit(0.0).alias("cost_usd"), F.lit("skipped").alias("status"))
    sent = chunks.withColumn("doc_id", F.col("doc_id").cast("string")).join(filled.where("n > 0").select("doc_id"), "doc_id")
    first = ask(sent.select(key.alias("id"), F.col("text").alias("prompt")), client, model, schema=schema)
    number = F.element_at(F.split("id", "#"), -1)
    note = F.concat(F.lit('{"error": "chunk '), (number.cast("int") + 1).cast("string"), F.lit(' failed"}'))
    parts = first.select(F.expr("substring(id, 1, length(id) - length(element_at(split(id, '#'), -1)) - 1)").alias("doc_id"), number.cast("int").alias("n"), "answer", F.coalesce("answer", note).alias("a"), "cost_usd", "status")
    joined = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "a", "answer", "status"))).alias("p"), F.sum("cost_usd").alias("cost_usd"))
    single = joined.where("size(p) = 1").select("doc_id", F.col("p")[0]["answer"].alias("answer"), F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"), F.col("p")[0]["status"].alias("status"))
    several = joined.where("size(p) > 1").select(F.col("doc_id").alias("id"), F.array_join(F.transform("p", lambda x: x["a"]), "\n---\n").alias("prompt"), F.col("cost_usd").alias("spent"))
    merged = ask(several, client, model, schema=schema).join(several.select("id", "spent"), "id")
    merged = merged.select(F.col("id").alias("doc_id"), "answer", (F.coalesce("cost_usd", F.lit(0.0)) + F.coalesce("spent", F.lit(0.0))).alias("cost_usd"), "status")
    return empty.unionByName(single).unionByName(merged)


def recognised(blocks: DataFrame, client: Callable[[str], str], key: str = "block_id", image: str = "image_ref") -> DataFrame:
    """OCR text, status, time and error of pending image blocks, one call for each; one that fails is skipped by itself. Other blocks aren't sent."""

    def run(batches):
        for b in batches:
            out = []
            for k, ref in zip(b[key], b[image]):
                began = time.monotonic()
                try:
                    text, status, error = client(ref) or "", "completed", None
                except Exception as e:  # noqa: BLE001
                    text, status, error = None, "skipped", str(e)[:200]
                out.append((k, text, status, int((time.monotonic() - began) * 1000), error))
            yield pd.DataFrame(out, columns=[key, "ocr_text", "ocr_status", "duration_ms", "error"])

    return blocks.where((F.col("ocr_status") == "pending") & F.col(image).isNotNull()).select(key, image).mapInPandas(run, f"{key} string, ocr_text string, ocr_status string, duration_ms long, error string")


def recognised_pages(documents: DataFrame, client: Callable[[bytes], list[tuple[int, str]]]) -> DataFrame:
    """doc_id, page (from 1), ocr_text of whole documents (doc_id, content) sent once each; a document that fails gives no page.

    To be matched with scan blocks by catalog's page_match_left: a page without a block is left out, a block without a page is skipped.
    """

    def run(batches):
        for b in batches:
            out = []
            for doc, data in zip(b["doc_id"], b["content"]):
                try:
                    out += [(doc, index + 1, text or "") for index, text in client(bytes(data))]
                except Exception:  # noqa: BLE001
                    continue
            yield pd.DataFrame(out, columns=["doc_id", "page", "ocr_text"]).astype({"page": "int32"})

    return documents.select("doc_id", "content").mapInPandas(run, "doc_id string, page int, ocr_text string")


def rendered_pages(scans: DataFrame, documents: DataFrame, renderer: Callable[[bytes, int, float], tuple[bytes, int, int]], done: DataFrame | None = None, scale: float = 2.0) -> DataFrame:
    """block_id, name, content, width_px, height_px of the pictures of scan pages (doc_id, block_id, page); blocks whose name done has aren't drawn again."""
    wanted = scans.where("page > 0").withColumn("name", F.concat(F.lit("images/"), "block_id", F.lit(".png")))
    wanted = wanted if done is None else wanted.join(done.select("name"), "name", "left_anti")

    def run(batches):
        for b in batches:
            out = []
            for block, name, page, data in zip(b["block_id"], b["name"], b["page"], b["content"]):
                png, width, height = renderer(bytes(data), int(page) - 1, scale)
                out.append((block, name, png, width, height))
            yield pd.DataFrame(out, columns=["block_id", "name", "content", "width_px", "height_px"]).astype({"width_px": "int32", "height_px": "int32"})

    return wanted.join(documents.select("doc_id", "content"), "doc_id").select("block_id", "name", "page", "content").mapInPandas(run, "block_id string, name string, content binary, width_px int, height_px int")


def download(fetch: Callable[[str, dict], tuple[int, Iterable[bytes]]], url: str, token: str, have: bool = False, force: bool = False) -> bytes | None:
    """The bytes of an archive; None where it is there already and force isn't set.

    fetch(url, headers) gives the response's status and its parts. 401 and 404, other statuses of failure and an empty body raise errors of
    their own; so does a fetch that fails.
    """
    if have and not force:
        return None
    try:
        status, parts = fetch(url, {"Authorization": f"Bearer {token}", "Accept": "application/zip"})
        if status in (401, 404):
            raise {401: Unauthorized, 404: NotFound}[status](f"{url}: {status}")
        if status >= 400:
            raise DownloadError(f"{url}: {status}")
        data = b"".join(parts)
    except DownloadError:
        raise
    except Exception as e:
        raise DownloadError(f"{url}: {e}") from e
    if not data:
        raise EmptyBody(url)
    return data


def downloads(wanted: DataFrame, fetch: Callable[[str, dict], tuple[int, Iterable[bytes]]], token: str, force: bool = False) -> DataFrame:
    """tender_id, content, error (the class and message) of the archives of (tender_id, url, have); those already there have neither."""

    def run(batches):
        for b in batches:
            out = []
            for key, url, have in zip(b["tender_id"], b["url"], b["have"]):
                try:
                    out.append((key, download(fetch, url, token, bool(have), force), None))
                except DownloadError as e:
                    out.append((key, None, f"{type(e).__name__}: {e}"[:2000]))
            yield pd.DataFrame(out, columns=["tender_id", "content", "error"])

    return wanted.select("tender_id", "url", "have").mapInPandas(run, "tender_id string, content binary, error string")


STEPS = {"doc": ["docx"], "odt": ["docx"], "rtf": ["docx"], "xls": ["xlsx"], "ods": ["xlsx"], "ppt": ["pptx", "pdf"], "odp": ["pptx", "pdf"], "pptx": ["pdf"]}


def conversions(ext: str) -> list[str]:
    """The formats that a document of this extension goes through before it can be read."""
    return STEPS.get(ext.lstrip(".").lower(), [])


def converted(run: Callable[[bytes, str, str, float], tuple[int, bytes | None, str]], timeout: float = 120.0) -> Callable[[bytes, str, str], bytes]:
    """A converter for files.read_blocks from an office program: run(bytes, extension, target, timeout) gives its return code, the new file
    (None if there is none) and its messages. Anything but code 0 and a file raises ConversionError, a timeout too."""

    def convert(data: bytes, ext: str, target: str) -> bytes:
        try:
            code, new, said = run(data, ext, target, timeout)
        except TimeoutError as e:
            raise ConversionError(f"timeout after {timeout} s") from e
        if code != 0 or new is None:
            raise ConversionError(f".{ext} to .{target}: code {code}, {said[:200]}")
        return new

    return convert

