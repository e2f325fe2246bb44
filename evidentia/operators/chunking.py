"""Marked-up text to typed sections and token-bounded, identified chunks."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.config import CHUNK_TOKENS
from evidentia.functions import lexicons as lex
from evidentia.functions import text as X

TEI = "{http://www.tei-c.org/ns/1.0}"
COUNT_CHARS = 4000
_WINDOW = re.compile(rf"(?s).{{1,{COUNT_CHARS}}}")
TokenCounter = Callable[[str], int]


def count_words(text: str) -> int:
    return len(text.split())


def tidy(parts: Iterator[str]) -> str:
    return " ".join("".join(parts).split())


def visible(node: ET.Element) -> Iterator[str]:
    """Text of a node without formulas and references to notes or literature."""
    blank = node.tag == f"{TEI}formula" or (node.tag == f"{TEI}ref" and node.get("type") in ("bibr", "foot"))
    if not blank:
        yield node.text or ""
        for child in node:
            yield from visible(child)
            yield child.tail or ""


def tei_sections(xml: str | None) -> list[tuple[str, list[str]]]:
    """(head, paragraphs) of the body's direct divisions; [] of what is no XML.

    Declarations of entities are refused, so none is ever expanded.
    """
    if not xml or "<!ENTITY" in xml:
        return []
    try:
        body = ET.fromstring(xml.encode()).find(f".//{TEI}body")
    except ET.ParseError:
        return []
    out = []
    for div in body.findall(f"{TEI}div") if body is not None else ():
        if div.get("type") in lex.SKIPPED_DIVS:
            continue
        head = div.find(f"{TEI}head")
        paragraphs = [t for p in div.iter(f"{TEI}p") if (t := tidy(visible(p)))]
        if paragraphs:
            out.append(((head.text or "") if head is not None else "", paragraphs))
    return out


class Packer:
    """Order-preserving packing of units under a token threshold.

    A unit over the threshold closes the open chunk and is broken up by itself:
    into sentences, else words, else characters. Its pieces never join others.
    """

    LEVELS = ((re.compile(r"(?<=[.!?])\s+"), " "), (re.compile(r"\s+"), " "), (None, ""))

    def __init__(self, count: TokenCounter = count_words, threshold: int = CHUNK_TOKENS):
        self.count, self.threshold = count, threshold

    def size(self, text: str) -> int:
        """Tokens, from pieces that are short enough to count at once."""
        pieces = [text]
        for cut in (*(pattern.split for pattern, _ in self.LEVELS[:2]), _WINDOW.findall):
            if max(map(len, pieces), default=0) <= COUNT_CHARS:
                break
            pieces = [q for p in pieces for q in (cut(p) if len(p) > COUNT_CHARS else (p,)) if q]
        return sum(map(self.count, pieces))

    def pack(self, units: list[str], sep: str = "\n\n") -> list[str]:
        joint = self.size(sep) if sep else 0
        sizes = [self.size(u) for u in units]
        # A chunk begins at every index in ``starts``.
        starts, used = [], self.threshold + 1
        for i, n in enumerate(sizes):
            alone = n > self.threshold or (i and sizes[i - 1] > self.threshold)
            if alone or used + joint + n > self.threshold:
                starts.append(i)
                used = n
            else:
                used += joint + n
        out: list[str] = []
        for a, b in pairwise([*starts, len(units)]):
            if sizes[a] > self.threshold:
                out += self.split(units[a])
            else:
                out.append(sep.join(units[a:b]))
        return out

    def split(self, text: str) -> list[str]:
        for splitter, sep in self.LEVELS:
            parts = [p for p in splitter.split(text) if p] if splitter else list(text)
            if len(parts) > 1:
                return self.pack(parts, sep)
        return [text]


def chunk_sections(
    sections: DataFrame, key: str = "arxiv_id", count: TokenCounter = count_words, threshold: int = CHUNK_TOKENS
) -> DataFrame:
    """Chunks of ``key, sections array<struct<section_type, paragraphs>>``.

    ``section_order`` runs over the whole paper. Narrow; null or empty section
    lists give no chunk.
    """
    packer = Packer(count, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for paper, parts in zip(batch.column(key).to_pylist(), batch.column("sections").to_pylist(), strict=True):
                packed = ((s["section_type"], c) for s in parts or () for c in packer.pack(s["paragraphs"] or []))
                rows += [(paper, kind, order, c, packer.size(c)) for order, (kind, c) in enumerate(packed)]
            names = [key, "section_type", "section_order", "chunk_text", "token_count"]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32()]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return sections.select(key, "sections").mapInArrow(
        run, f"{key} string, section_type string, section_order int, chunk_text string, token_count int"
    )


def with_uuid(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_uuid", X.chunk_uuid("arxiv_id", "section_type", "section_order"))


def typed_sections(raw: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """``key, sections`` of ``key, raw array<struct<head, paragraphs>>``, heads classified natively."""
    return raw.select(
        key,
        F.transform(
            "raw", lambda s: F.struct(X.classify_section(s["head"]).alias("section_type"), s["paragraphs"].alias("paragraphs"))
        ).alias("sections"),
    )


RAW = "array<struct<head: string, paragraphs: array<string>>>"


def _parsed(rows: DataFrame, key: str, source: str, parse: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("head", pa.string()), ("paragraphs", pa.list_(pa.string()))]))
        for batch in batches:
            out = [[{"head": h, "paragraphs": p} for h, p in parse(x)] for x in batch.column(source).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, kind)], names=[key, "raw"])

    return rows.select(key, source).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, raw {RAW}")


def extract_tei(files: DataFrame, key: str = "arxiv_id", source: str = "xml") -> DataFrame:
    return _parsed(files, key, source, tei_sections)


_ARTICLE = re.compile(r"(?s)<article>(.*?)(?:</article>|$)")
_BLOCK = re.compile(r"(?s)<(h1|p|li)\b[^>]*>(.*?)(?=</\1>|<(?:h1|p|li|ul|ol|article|footer)\b|$)")
_MARK = re.compile(r"<[^>]+>")


def html_sections(html: str | None) -> list[tuple[str, list[str]]]:
    """One section of each article: its first heading, paragraphs and list items."""
    out = []
    for article in _ARTICLE.findall(html or ""):
        blocks = [(tag, " ".join(_MARK.sub(" ", body).split())) for tag, body in _BLOCK.findall(article)]
        head = next((t for tag, t in blocks if tag == "h1"), "")
        paragraphs = [t for tag, t in blocks if tag != "h1" and t]
        if paragraphs:
            out.append((head, paragraphs))
    return out


def extract_html(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    return _parsed(pages, key, source, html_sections)


def windows(sentences: list[str], budget: int, overlap: int, count: TokenCounter = count_words) -> list[str]:
    """Stretches of sentences within a token budget; each begins with as many of
    the sentences before it as fit the overlap."""
    out, open_ = [], []
    for s in sentences:
        if open_ and sum(map(count, [*open_, s])) > budget:
            out.append(" ".join(open_))
            tail: list[str] = []
            for t in reversed(open_):
                if sum(map(count, [t, *tail])) > overlap:
                    break
                tail.insert(0, t)
            open_ = tail if sum(map(count, [*tail, s])) <= budget else []
        open_.append(s)
    return [*out, " ".join(open_)] if open_ else out
