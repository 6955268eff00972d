"""Substring dedup by content-defined chunks.

A gear rolling hash runs over the text, its white space taken as single spaces: the state after a
byte is twice the state before plus the byte's random value, in eight bits, so that only the last
eight bytes count.  A text may be cut before any word, and is cut where that state is the smallest
of ``w`` words in a row.  Cuts hang on the bytes around them only, so an insertion moves no cut
but those beside it, and no chunk is longer than ``w`` words: a mask in place of the minimum would leave chunks
without a bound, and passages of just over 50 words would be missed.  The ends of a text are cuts too.

Variable chunks are deduplicated by digest.  A chunk of a few words stands in many texts by
chance, so its key is the digest of the chunk and the ``KEY_CHUNKS - 1`` chunks after it.  Keys are counted over all
texts with partial aggregation; keys of two or more places are joined back to the chunks by an
equi-join that adaptive execution splits where one key is very common.  Repeated chunks of a
document that overlap or touch form a run, and a run of ``min_words`` words or more is reported;
chance repeats of single keys and digest collisions are too short for that.  Two places of one
passage have the same cuts, but for its first eight bytes and w words and its last w words, so
passages of 50 words or more are always reported, with at most that much missing at their ends.  A
run is reported in parts: what keys cover that a smaller document has too, or the same text before,
is a duplicate, the rest is the copy to keep.  A key that overlaps its own first place is no duplicate,
so a word repeated over and over keeps a few of its kind, at the beginning and at the end.

Defined results: words count, not the white space between them; null and empty texts and those of
too few chunks have no keys; an empty table gives an empty one; rows of one id are one document, and what repeats only
between them is reported but never a duplicate, as cuts go by id; rows without an id are left out; offsets are code points;
very long texts are taken whole; other columns are not carried by spans, and stay where spans are cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tidied, workers

#: Words that repeated keys must cover: a passage of 51 words loses 18 of them at most, 8 bytes of words of a letter included.
MIN_WORDS = 33
#: Words of which one is a cut, at least, and chunks in a key.
WINNOW, KEY_CHUNKS = 7, 4
#: Bytes that the gear's state remembers.
GEAR_BYTES = 8
_RANDOM = np.random.RandomState(20240229)
BYTES = _RANDOM.randint(0, 2**63, 256, dtype=np.uint64)
GEAR = _RANDOM.randint(0, 1 << GEAR_BYTES, 256).astype(np.uint8)
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: BASE times this is 1 in 64 bits.
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
CHUNKS = "doc_id bigint, at int, words int, start int, chars int, again boolean, digest bigint"


def spacing(min_words: int) -> int:
    """Words of which one is a cut, at least, for runs of min_words words."""
    return min(WINNOW, max(1, min_words * WINNOW // MIN_WORDS))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


def _word_digests(data: np.ndarray, starts: np.ndarray, space: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each word: its bytes' random values weighted by powers of BASE."""
    lengths = np.diff(np.append(starts, len(data)))
    begin = int(starts[0])
    place = np.arange(begin, len(data)) - np.repeat(starts, lengths)
    values = BYTES[data[begin:]] * _powers(BASE, int(lengths.max()))[place]
    values[space[begin:]] = 0
    return _mixed(np.add.reduceat(values, starts - begin))


def gear_states(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The state of the gear before each word, over the words and single spaces before it."""
    lengths = ends - starts + 1  # with the space behind
    at = np.concatenate([[0], np.cumsum(lengths)])
    plain = np.full(at[-1] + GEAR_BYTES, 32, np.uint8)
    inside = np.arange(at[-1]) - np.repeat(at[:-1], lengths)
    from_ = np.repeat(starts, lengths) + inside
    plain[GEAR_BYTES:] = np.where(inside < np.repeat(lengths - 1, lengths), data[np.minimum(from_, len(data) - 1)], 32)
    state = np.zeros(len(starts), np.uint8)
    for back in range(GEAR_BYTES):
        state += GEAR[plain[at[:-1] + GEAR_BYTES - 1 - back]] << np.uint8(back)
    return state


def cuts(state: np.ndarray, w: int) -> np.ndarray:
    """The words before which a text is cut, both ends included: the first smallest state of each w words in a row."""
    n = len(state)
    near = np.lib.stride_tricks.sliding_window_view(state, min(w, n))
    picked = np.zeros(n + 1, bool)
    picked[near.argmin(axis=1) + np.arange(len(near))] = True
    picked[[0, n]] = True
    return np.flatnonzero(picked)


def chunks(text: bytes, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The keys of a text's chunks in order: digests, code points where they stop, (first word, last word exclusive, code point of the start), byte ends."""
    data = np.frombuffer(text, np.uint8)
    space = _SPACE[data]
    edges = np.diff(np.concatenate([[True], space, [True]]).view(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    cut = cuts(gear_states(data, starts, ends), spacing(min_words)) if len(starts) else starts
    if len(cut) <= KEY_CHUNKS:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none.reshape(0, 3), none
    at, till = cut[:-KEY_CHUNKS], cut[KEY_CHUNKS:]
    # a polynomial of the words' digests, its lowest power that of the first word
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_word_digests(data, starts, space) * _powers(BASE, len(starts)))])
    digests = _mixed((sums[till] - sums[at]) * _powers(UNBASE, len(starts))[at] + (till - at).astype(np.uint64))
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    stop = ends[till - 1]
    return digests, points[stop], np.stack([at, till, points[starts[at]]], axis=1), stop


def _later(digests: np.ndarray, at: np.ndarray, till: np.ndarray) -> np.ndarray:
    """Whether a key stands before in its text, without overlapping that first place."""
    _, first, which = np.unique(digests, return_index=True, return_inverse=True)
    return at >= till[first][which]


def _chunk_rows(min_words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("at", pa.int32()), ("words", pa.int32()), ("start", pa.int32()), ("chars", pa.int32()), ("again", pa.bool_()), ("digest", pa.int64())])

    def run(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frame:
            columns: list[list[np.ndarray]] = [[] for _ in schema]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if not text or doc is None:
                    continue
                found, stop, place, _ = chunks(text, min_words)
                at, till, start = place[:, 0], place[:, 1], place[:, 2]
                # lengths, not ends: small numbers shuffle in fewer bytes
                row = np.full(len(found), doc, np.int64), at, till - at, start, stop - start, _later(found, at, till), found.view(np.int64)
                for column, values in zip(columns, row, strict=True):
                    column.append(values)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def repeated_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start, stop, n_words, first_doc_id, duplicate: every span that stands in another place too.

    Runs of min_words words are cut where keys that smaller documents or earlier places of the
    document have begin and end to cover them, and each part is a row.  first_doc_id: the smallest
    document with a key of the part; duplicate: such places have all of it, so that removing
    the spans marked leaves one copy.
    """
    workers(df.sparkSession)
    docs = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].cast("string").alias("text"))
    rows = docs.mapInArrow(tidied(_chunk_rows(min_words)), CHUNKS)
    counted = rows.select("digest", "doc_id").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("places"))
    shared = materialize(counted.where("places > 1").select("digest", "first"), "repeated-chunks")
    hits = docs.mapInArrow(tidied(_chunk_rows(min_words)), CHUNKS).join(shared, "digest").select(
        "doc_id", "at", (F.col("at") + F.col("words")).alias("till"), "start", (F.col("start") + F.col("chars")).alias("stop"), "first", (F.col("again") | (F.col("first") != F.col("doc_id"))).alias("again"))
    w = Window.partitionBy("doc_id").orderBy("at", "till", "start", "stop")
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    marked = hits.select(
        "doc_id", "at", "till", "start", "stop", F.when(F.col("again"), F.col("first")).alias("first"),
        F.coalesce((F.lag("till").over(w) < F.col("at")).cast("int"), F.lit(1)).alias("begins"), F.lead("at").over(w).alias("next"), F.lead("start").over(w).alias("next_start"),
        # keys that start later end later, so the last duplicate reaches furthest
        F.max(F.when(F.col("again"), F.col("till"))).over(so_far).alias("reach"), F.max(F.when(F.col("again"), F.col("stop"))).over(so_far).alias("reach_stop"))
    # what a key adds ends where the next one starts; up to the reach of duplicates it is one
    inner = F.col("next") <= F.col("till")
    marked = marked.withColumns({"to": F.when(inner, F.col("next")).otherwise(F.col("till")), "to_stop": F.when(inner, F.col("next_start")).otherwise(F.col("stop"))})
    marked = marked.withColumn("cut", F.least("to", F.greatest("at", F.coalesce("reach", "at"))))
    marked = marked.withColumn("cut_stop", F.when(F.col("cut") == F.col("to"), F.col("to_stop")).when(F.col("cut") == F.col("at"), F.col("start")).otherwise(F.col("reach_stop")))
    head, tail = F.when(F.col("to") > F.col("at"), F.col("cut") > F.col("at")), F.when(F.col("to") > F.col("at"), F.col("cut") == F.col("to"))
    marked = marked.withColumn("was", F.last(tail, ignorenulls=True).over(before)).withColumn("turns", F.greatest("begins", F.coalesce((F.col("was") != head).cast("int"), F.lit(0))))
    split = (head & ~tail).cast("int")
    marked = marked.withColumn("run", F.sum("begins").over(so_far)).withColumn("part", F.sum("turns").over(so_far) + F.coalesce(F.sum(split).over(before), F.lit(0)))
    piece = lambda duplicate, part, start, stop, words, first: F.struct(F.lit(duplicate).alias("duplicate"), part.alias("part"), start.alias("start"), stop.alias("stop"), words.alias("words"), first.alias("first"))
    pieces = F.array(
        piece(True, F.col("part"), F.col("start"), F.col("cut_stop"), F.col("cut") - F.col("at"), F.col("first")),
        piece(False, F.col("part") + split, F.col("cut_stop"), F.col("to_stop"), F.col("to") - F.col("cut"), F.col("doc_id")))
    pieces = marked.select("doc_id", "run", F.inline(F.filter(pieces, lambda x: x["words"] > 0)))
    parts = pieces.groupBy("doc_id", "run", "part", "duplicate").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum("words").alias("n_words"), F.min("first").alias("first_doc_id"))
    parts = parts.withColumn("run_words", F.sum("n_words").over(Window.partitionBy("doc_id", "run")))
    return parts.where(F.col("run_words") >= min_words).select("doc_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "n_words", "first_doc_id", "duplicate")


def cut_spans(df: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The table with the spans marked as duplicates taken out of its texts; other columns stay."""
    per = spans.where("duplicate").groupBy(F.col("doc_id").alias("__doc")).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("__cut"))
    joined = df.join(per, df[doc_id] == per["__doc"], "left")
    kept = F.aggregate(
        "__cut",
        F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(F.concat(a.done, F.substr(F.col(text), (a.at + 1).cast("int"), F.greatest(s["start"] - a.at, F.lit(0)).cast("int"))).alias("done"), F.greatest(a.at, s["stop"]).alias("at")),
        lambda a: F.concat(a.done, F.substr(F.col(text), (a.at + 1).cast("int"), F.length(text))),
    )
    return joined.withColumn(text, F.when(F.col("__cut").isNotNull(), kept).otherwise(F.col(text))).drop("__doc", "__cut")
