"""Tables of contents: lines from spans, and entries from lines.

Grouping by baseline carries a running midpoint from span to span, and the entry grammar reads a
line's spans from both ends; neither is a relational operator, so both run as Python over small
groups (the spans of one contents page) and over Arrow batches of lines.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LEADERS, normalize_text

TOLERANCE, TOC_PAGES = 3.0, 6
_LEADER = re.compile(f"[{re.escape(LEADERS)} ]+")
#: What markers and page numbers look like.
_FILL = rf"[\s{re.escape(LEADERS)}]*"
_ENDS_WITH_PAGE = re.compile(rf"(.*?){_FILL}(\d{{1,4}})\s*$", re.S)
_PAGE = re.compile(r"\d{1,4}$")
_CODE = re.compile(r"([A-E]\.\d{1,2}(?:\.\d{1,2})?)\b", re.I)
_LETTER_DOT = re.compile(r"([A-E])\.$", re.I)
_LETTER_TITLE = re.compile(r"([A-E])\.\s+(.+)$", re.I | re.S)
_LETTER_REST = re.compile(r"([A-E])\.\s*(.*)$", re.I | re.S)
_PART = re.compile(r"(?:Teil|Abschnitt)\s*([A-E])\.?$", re.I)
_LETTER = re.compile(r"([A-E])$", re.I)
_SUBSECTION = re.compile(r"[A-E]\.\d", re.I)
_ONE_SPAN = re.compile(rf"\s*((?:[A-E]\.\d{{1,2}}(?:\.\d{{1,2}})?|[A-E])\.?)\s+(.*?){_FILL}(\d{{1,4}})\s*$", re.I | re.S)
ITEM = "struct<title: string, marker: string, page: int>"
HIT = "struct<letter: string, title: string, page: int>"


def clean(spans: DataFrame) -> DataFrame:
    """Spans of the contents pages with normalised, non-empty texts."""
    return spans.where(F.col("page_index") < TOC_PAGES).withColumn("text", normalize_text(F.col("text"))).where("text != ''")


def lines(spans: DataFrame) -> DataFrame:
    """doc_id, page_index, line_seq, tokens (array of texts from left to right).

    Spans are scanned by (rounded y, x); one joins the line while it is within TOLERANCE of the
    line's y, which then moves halfway to the span's.
    """

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_y=pdf["y0"].round()).sort_values(["_y", "x0", "span_seq"], kind="stable")
        rows: list[list[tuple[float, str]]] = []
        level = None
        for y, x, text in zip(pdf["y0"], pdf["x0"], pdf["text"], strict=True):
            if level is not None and abs(y - level) <= TOLERANCE:
                level = (level + y) / 2
            else:
                rows.append([])
                level = y
            rows[-1].append((x, text))
        tokens = [[t for _, t in sorted(r, key=lambda p: p[0])] for r in rows]
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[0], "page_index": pdf["page_index"].iloc[0], "line_seq": range(len(tokens)), "tokens": tokens})

    return clean(spans).select("doc_id", "page_index", "span_seq", "text", "x0", "y0").groupBy("doc_id", "page_index").applyInPandas(group, "doc_id string, page_index int, line_seq int, tokens array<string>")


def _one_space(text: str) -> str:
    return " ".join(text.split())


def _split_page(text: str) -> tuple[str, int] | None:
    """A text that ends with a page number: what stands before leaders and number, and the number."""
    m = _ENDS_WITH_PAGE.match(text)
    return (m[1].strip(), int(m[2])) if m else None


def _page_of(tokens: list[str]) -> tuple[int, int, str] | None:
    """Index of the token with the page, the page, and the title in that token: the rightmost number, else the last token's end."""
    alone = [i for i, t in enumerate(tokens) if _PAGE.match(t)]
    if alone:
        return alone[-1], int(tokens[alone[-1]]), ""
    merged = _split_page(tokens[-1])
    return (len(tokens) - 1, merged[1], merged[0]) if merged else None


def _letter_alone(tokens: list[str], i: int, stop: int) -> tuple[int, bool] | None:
    """For a token of one letter: the marker's last token, and whether a dot of its own follows."""
    if not _LETTER.match(tokens[i]):
        return None
    dotted = i + 1 < stop and tokens[i + 1] == "."
    return i + dotted, dotted


def _section_marker(tokens: list[str]) -> tuple[int, str, str] | None:
    """Index of the marker's last token, its letter, and title text in that token; each form is sought in the whole line."""
    for form in (_LETTER_DOT, _LETTER_TITLE, _PART):
        for i, t in enumerate(tokens):
            if m := form.match(t):
                return i, m[1].upper(), m[2].strip() if form is _LETTER_TITLE else ""
    for i, t in enumerate(tokens):
        if found := _letter_alone(tokens, i, len(tokens)):
            return found[0], t.upper(), ""
    return None


def _item_marker(left: list[str]) -> tuple[int, str, str]:
    """Index of the marker's last token (-1: none), the marker, and title text in that token; the first token of any form counts."""
    for i, t in enumerate(left):
        if m := _CODE.match(t):
            return i, m[1].upper(), t[m.end() :].strip()
        if m := _LETTER_DOT.match(t):
            return i, f"{m[1].upper()}.", ""
        if m := _PART.match(t):
            return i, f"Teil {m[1].upper()}", ""
        if found := _letter_alone(left, i, len(left)):
            return found[0], t.upper() + "." * found[1], ""
    return -1, "", ""


def parse_section(tokens: list[str] | None) -> tuple[str, str, int] | None:
    """(letter, title, page) of a top-level entry; lines of subsections and others give None."""
    if not tokens:
        return None
    for t in tokens:  # the first token that is an entry of its own decides, unless a subsection stands before
        if _SUBSECTION.match(t):
            return None
        if (m := _LETTER_REST.match(t)) and (own := _split_page(m[2].strip())) and own[0]:
            return m[1].upper(), _one_space(own[0]), own[1]
    marker, found = _section_marker(tokens), _page_of(tokens)
    if not marker or not found or marker[0] >= found[0]:
        return None
    (i, letter, prefix), (at, page, before) = marker, found
    title = _one_space(" ".join([prefix, *(t for t in tokens[i + 1 : at] if not _LEADER.fullmatch(t))])) or _one_space(before)
    return (letter, title, page) if title else None


def parse_item(tokens: list[str] | None) -> tuple[str, str, int] | None:
    """(title, marker, page) of any entry; the marker may be empty."""
    if not tokens:
        return None
    if len(tokens) == 1 and (m := _ONE_SPAN.match(tokens[0])):
        marker = m[1].upper()
        return _one_space(m[2]), marker.rstrip(".") if _SUBSECTION.match(marker) else marker, int(m[3])
    found = _page_of(tokens)
    if not found:
        return None
    at, page, before = found
    i, marker, prefix = _item_marker(tokens[:at])
    title = _one_space(" ".join([prefix, *(t for t in tokens[i + 1 : at] if not _LEADER.fullmatch(t))])) or _one_space(before)
    return (title, marker, page) if title else None


def items(rows: DataFrame) -> DataFrame:
    """Contents entries, the first of each (page, title, marker): doc_id, seq, page, title, left_marker."""

    @F.pandas_udf(ITEM)
    def parse(tokens: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_item(None if t is None else list(t)) or (None, None, None) for t in tokens], columns=["title", "marker", "page"]).astype({"page": "Int64"})

    r = rows.withColumn("item", parse("tokens")).where("item.page is not null")
    key = Window.partitionBy("doc_id", "item.page", F.lower("item.title"), F.lower("item.marker")).orderBy("page_index", "line_seq")
    r = r.withColumn("rn", F.row_number().over(key)).where("rn = 1")
    return r.select("doc_id", (F.col("page_index") * 10000 + F.col("line_seq")).alias("seq"), F.col("item.page").alias("page"), F.col("item.title").alias("title"), F.col("item.marker").alias("left_marker"))


def heading_hits(rows: DataFrame) -> DataFrame:
    """Top-level entries: doc_id, hit_seq, letter, page, title."""

    @F.pandas_udf(HIT)
    def parse(tokens: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_section(None if t is None else list(t)) or (None, None, None) for t in tokens], columns=["letter", "title", "page"]).astype({"page": "Int64"})

    r = rows.withColumn("hit", parse("tokens")).where("hit.page is not null")
    return r.select("doc_id", (F.col("page_index") * 10000 + F.col("line_seq")).alias("hit_seq"), F.col("hit.letter").alias("letter"), F.col("hit.page").alias("page"), F.col("hit.title").alias("title"))
