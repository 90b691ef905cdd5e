"""Sections of HTML documents and how they change."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberlog.operators.inventory import difference

_REGIONS = [re.compile(rf"(?is)<{tag}\b.*</{tag}\s*>", re.A) for tag in ("main", "article", "body")]
#: Content that changes without the document changing: gone before headings are looked for.
_VOLATILE = "script|style|noscript|svg|template|footer|time"
_STRIPPED = [re.compile(x, re.A) for x in (r"(?s)<!--.*?-->", rf"(?is)<({_VOLATILE})\b.*?</\1\s*>", rf"(?is)</?({_VOLATILE})\b[^>]*>")]
_HEADING = re.compile(r"(?is)<h[1-3]\b[^>]*>.*?</h[1-3]\s*>", re.A)
_ENTITY = re.compile(r"&(#x?[0-9a-fA-F]+|[a-zA-Z]+);")
_SPACE = re.compile("[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]+")
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}


def region(html: str) -> str:
    """The main element, else the article, else the body, else all of it."""
    return next((m[0] for x in _REGIONS if (m := x.search(html))), html)


def character(entity: re.Match) -> str:
    """What an entity stands for; one that is unknown or beyond the last code point stays as it is."""
    name = entity[1]
    if name[0] != "#":
        return _NAMED.get(name.lower(), entity[0])
    digits = name[2:] if name[1] == "x" else re.match("[0-9]*", name[1:])[0]
    digits = digits.lstrip("0") or digits[:1]
    code = int(digits, 16 if name[1] == "x" else 10) if 0 < len(digits) < 9 else 0x110000
    return entity[0] if code > 0x10FFFF else "\ufffd" if 0xD800 <= code < 0xE000 else chr(code)


def plain(html: str) -> str:
    """Without tags and with entities decoded, with white space as single spaces."""
    return _SPACE.sub(" ", _ENTITY.sub(character, re.sub("<[^>]*>", " ", html))).strip(" ")


def slug(heading: str) -> str:
    """Lower case, runs of other signs as one dash, 80 characters at most; ``untitled`` if none is left."""
    return re.sub("[^a-z0-9]+", "-", heading.lower()).strip("-")[:80] or "untitled"


def parts(html: str) -> Iterator[tuple[int, str, str]]:
    """position, slug, hash from each h1, h2 or h3 to the next; text before the first is ``__intro__`` at 0."""
    clean = region(html)
    for x in _STRIPPED:
        clean = x.sub(" ", clean)
    start, heading, position = 0, None, 0
    for m in [*_HEADING.finditer(clean), None]:
        body = plain(clean[start : m.start() if m else len(clean)])
        if heading is not None:
            yield position, slug(heading), hashlib.sha256(f"{heading}\n{body}".encode()).hexdigest()
        elif body:
            yield position, "__intro__", hashlib.sha256(body.encode()).hexdigest()
        if m:
            start, heading, position = m.end(), plain(m[0]), position + 1


def split_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, *part) for i, html in enumerate(batch.column("html").to_pylist()) if html is not None for part in parts(html)]
        row, position, base, digest = zip(*rows, strict=True) if rows else ((), (), (), ())
        columns = [batch.column("page_id").take(pa.array(row, pa.int64())), pa.array(position, pa.int32()), pa.array(base, pa.string()), pa.array(digest, pa.string())]
        yield pa.record_batch(columns, ["page_id", "position", "base", "hash"])


def sections(pages: DataFrame) -> DataFrame:
    """page_id, position, slug, hash: the parts of each page; repeated slugs get ``#n``."""
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, position int, base string, hash string"
    rows = pages.select("page_id", "html").mapInArrow(split_pages, schema)
    again = F.row_number().over(W.partitionBy("page_id", "base").orderBy("position"))
    return rows.withColumn("slug", F.when(again == 1, F.col("base")).otherwise(F.concat_ws("#", "base", again.cast("string")))).select("page_id", "position", "slug", "hash")


def section_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """key (page and slug), change, for the sections of two states of the same pages."""
    keyed = lambda df: df.withColumn("key", F.concat_ws("/", F.col("page_id").cast("string"), "slug"))
    return difference(keyed(old), keyed(new), "key", ["hash"])
