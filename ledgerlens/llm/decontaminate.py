"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Items and texts are lower-cased (A-Z only) and cut into words of ASCII letters, digits and
non-ASCII characters.  Every word that occurs in an item becomes one letter of the automaton's
alphabet, all other words are one further letter, and each window of ``width`` consecutive item
words is a pattern; an item of fewer words is one pattern.  A text is scanned once; the words
that occurrences cover are mapped back to code-point offsets of the original text.

Size bound: items reach the workers in blocks of at most ``block_bytes`` of text, so neither the
driver nor a worker holds more than one block.  A test set beyond that costs one further scan
for each block; the intermediate table is written to the shared folder between blocks.

Defined results: null and empty texts have no words and no hits; null and empty items match
nothing; rows of one item id count as one item; a null item id is the empty id; an empty test set
or table leaves nothing hit; repeated rows are scanned alike; very long texts are scanned whole;
other columns stay, and one named as ``into`` is replaced.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BYTES, materialize, tidied, workers

FOUND = "n_words bigint, runs array<struct<first: bigint, last: bigint, start: bigint, stop: bigint>>, items array<string>"
_RUN = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
_FOUND = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("items", pa.list_(pa.string()))])
_words = re.compile(WORD_BYTES)


def _letter(i: int) -> str:
    """The i-th letter of the automaton's alphabet; surrogates are left out."""
    return chr(i if i < 0xD800 else i + 0x800)


class WindowIndex:
    """The automaton of one block of items."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        import ahocorasick

        self.letters: dict[bytes, str] = {}
        patterns: dict[str, set[str]] = defaultdict(set)
        for item, text in items:
            coded = "".join(self.letters.setdefault(w, _letter(len(self.letters) + 2)) for w in _words.findall(text.lower()))
            for i in range(max(len(coded) - width, 0) + 1 if coded else 0):
                patterns[coded[i : i + width]].add(item)
        self.automaton = ahocorasick.Automaton()
        for pattern, owners in patterns.items():
            self.automaton.add_word(pattern, (len(pattern), owners))
        if patterns:
            self.automaton.make_automaton()
        self.empty = not patterns

    def scan(self, text: bytes | None) -> dict:
        """Number of words, covered runs of words (last exclusive) with code-point offsets, and item ids."""
        low = (text or b"").lower()
        words = _words.findall(low)
        out = {"n_words": len(words), "runs": [], "items": []}
        if self.empty or not words:
            return out
        letter = self.letters.get
        coded = "".join([letter(w, "\x01") for w in words])
        spans, owners = [], set()
        for end, (size, of) in self.automaton.iter(coded):
            spans.append((end - size + 1, end + 1))
            owners |= of
        if spans:
            places = [m.span() for m in _words.finditer(low)]
            at = offset = 0
            for first, last in joined(spans):
                offset += len(text[at : places[first][0]].decode())
                at = places[first][0]
                stop = offset + len(text[at : places[last - 1][1]].decode())
                out["runs"].append({"first": first, "last": last, "start": offset, "stop": stop})
            out["items"] = sorted(owners)
        return out


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open intervals; those that touch become one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], last)
        else:
            out.append((first, last))
    return out


def merge_found(a: dict | None, b: dict) -> dict:
    """What the scans of two blocks found in one text."""
    if a is None:
        return b
    runs: list[dict] = []
    for r in sorted(a["runs"] + b["runs"], key=lambda r: (r["first"], -r["last"])):
        if runs and r["first"] <= runs[-1]["last"]:
            if r["last"] > runs[-1]["last"]:
                runs[-1] = runs[-1] | {"last": r["last"], "stop": r["stop"]}
        else:
            runs.append(r)
    return {"n_words": b["n_words"], "runs": runs, "items": sorted({*a["items"], *b["items"]})}


def _scan_block(df: DataFrame, text: str, items, width: int, before: str | None):
    state: dict = {}

    def scan(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        if "index" not in state:
            state["index"] = WindowIndex(items.value, width)
        for batch, *earlier in batches:
            found = [state["index"].scan(t) for t in batch.cast(pa.binary()).to_pylist()]
            if before:
                found = [merge_found(a, b) for a, b in zip(earlier[0].to_pylist(), found, strict=True)]
            yield pa.array(found, _FOUND)

    scan = tidied(scan)
    scan.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    # the text twice: an iterator over tuples needs two columns
    return F.arrow_udf(scan, FOUND)(df[text].cast("string"), df[before or text])


def find_contamination(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 13, block_bytes: int = 1 << 20, into: str = "contamination") -> DataFrame:
    """Add a struct column ``into``: n_words, runs (first, last word; start, stop code point; ends exclusive), items.

    All other columns and all rows stay.
    """
    spark = df.sparkSession
    workers(spark)
    units = items.select(F.coalesce(items[item_id].cast("string"), F.lit("")).alias("item"), items[item_text].cast("string").alias("text")).where("text is not null and text != ''").distinct()
    total = units.agg(F.sum(F.octet_length("text")), F.max(F.octet_length("text"))).head()
    blocks = max(1, -(-(total[0] or 0) // block_bytes) + ((total[0] or 0) > block_bytes))
    for b in range(blocks):
        part = units if blocks == 1 else units.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        held = spark.sparkContext.broadcast([(r.item, r.text.encode()) for r in part.toLocalIterator()])
        df = df.withColumn(into, _scan_block(df, text, held, width, into if b else None))
        if b + 1 < blocks:
            df = materialize(df, "decontaminate")
    return df


def n_hit(found: str = "contamination"):
    """The number of words that runs cover."""
    return F.aggregate(F.col(found).runs, F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"])


def is_contaminated(found: str = "contamination", share: float = 0.05):
    """Whether occurrences cover at least this share of the words; exact for shares of one twentieth."""
    hits, parts = n_hit(found), round(1 / share)
    return (hits > 0) & (hits * parts >= F.col(found).n_words)
