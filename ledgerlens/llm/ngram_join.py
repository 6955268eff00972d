"""N-gram Jaccard join: rare-first prefix filtering, one verification a pair, connected components.

Sets.  A text is lower-cased (A-Z) and cut at ASCII white space; its set holds the distinct
``width``-word shingles as 64-bit hashes (fewer words: the whole sequence; none: the empty set,
which links with nothing).  Texts of one set are one class, found by a 128-bit digest, so copies
never meet in a pair.

Prefixes.  Shingles are ordered by how often they occur, rarest first, then by hash.  Frequencies
are counts over all texts in a table of 2**sketch_bits counters.  A task counts in bytes and
passes its table on in segments of a fixed size, each segment is summed by one streaming task, and
a byte a counter, on a logarithmic scale, is all that is broadcast: 4 MB, whatever the input.  Any
order gives right results, a rare-first one short blocks.  Two sets of
similarity t or more share one of their first n - ceil(t n) + 1 shingles.

Candidates.  Members of a block (texts that share a prefix shingle) are sorted by size and each is
tried with the last one before that has the shingle in the prefix which sets of one size need, and
with the block's hub, the member whose prefix holds the shingle first: it has the fewest shingles of
its own, as the original has among its edited copies.  Both are linear in the block.  Where components
still share many blocks, this is repeated in other orders between members of different components.
Blocks whose counter says they are large are first dealt into parts, whose heads are tried with
one another.  What is connected is then one component, and only pairs of *different* components
that share a prefix shingle are still listed, all of them, so that no link is missed while the
square of a group is never written.  Length, prefix and positional filters act in these steps; the suffix
filter acts on distinct pairs: each set has a bitmap of SIGNATURE_BITS bits a shingle or more, and two
bitmaps cannot differ in more places than their sets.  What remains is verified once, exactly, on
the whole sets.

Defined results: null and empty texts have size 0 and are their own component; rows with a null
id have a null component; repeated rows are copies; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import discard, materialize, may_be_in, tidied, workers
from .graph import components

WIDTH = 5
#: Similarity as a fraction.
NUMERATOR, DENOMINATOR = 3, 4
SKETCH_BITS = 22
#: Counters in a segment, and steps of the logarithmic scale in each doubling.
SEGMENT, STEPS = 1 << 14, 8
#: Blocks that the counters put above this are dealt into parts of about this many members.
BLOCK = 4000
#: While blocks hold more pairs of different components than this a row, and the last time has taken a quarter of them or more,
#: members are chained anew in another order, so many times at most; all pairs that are left are listed afterwards.
PAIRS_A_ROW, ROUNDS = 2, 2
#: Bits a shingle in the bitmaps of the suffix filter, at least; their sizes are powers of two.
SIGNATURE_BITS = 4
_M = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MEMO = 200_000


class Shingler:
    """Shingle hashes of texts; remembers the hashes of words."""

    def __init__(self, width: int = WIDTH):
        self.width = width
        self.known: dict[bytes, int] = {}

    def words(self, text: bytes) -> np.ndarray:
        import xxhash

        known, hashed = self.known, xxhash.xxh3_64_intdigest
        words = text.lower().split()
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            if len(known) > _MEMO:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = hashed(w)
            return np.array([known[w] for w in words], np.uint64)

    def members(self, text: bytes | None) -> np.ndarray:
        """The sorted distinct shingle hashes."""
        w = self.words(text or b"")
        if not len(w):
            return w
        size = min(self.width, len(w))
        h = np.full(len(w) - size + 1, size, np.uint64)
        for k in range(size):
            h = h * _M + w[k : len(w) - size + 1 + k]
            h ^= h >> np.uint64(29)
        h *= _MIX
        h ^= h >> np.uint64(32)
        return np.unique(h)


def _batches(frame: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    for batch in frame:
        yield batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()


_SETS = "kind int, key bigint, n bigint, d1 bigint, d2 bigint, bits array<bigint>, counts binary"


def signature(members: np.ndarray) -> np.ndarray:
    """The bitmap of a set as 64-bit words; its number of words is a power of two, so that halves fold onto each other."""
    places = 64
    while places < SIGNATURE_BITS * len(members):
        places *= 2
    held = np.zeros(places, bool)
    held[(members & np.uint64(places - 1)).astype(np.int64)] = True
    return np.packbits(held, bitorder="little").view(np.int64)


def _describe(width: int, bits: int):
    """Pass 1: a row for each text (kind 0) and the counter segments of this partition (kind 1)."""
    fields = [("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bits", pa.list_(pa.int64())), ("counts", pa.binary())]
    kinds = pa.schema(fields)

    def run(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler, counters, seen = Shingler(width), np.zeros(1 << bits, np.uint8), set()
        for ids, texts in _batches(frame):
            n, digests, signs = [], [], []
            for text in texts:
                members = shingler.members(text)
                n.append(len(members))
                digest = xxhash.xxh3_128_digest(members.tobytes())
                digests.append(digest)
                signs.append(signature(members))
                if digest not in seen:
                    if len(seen) < _MEMO:
                        seen.add(digest)
                    at = (members & np.uint64((1 << bits) - 1)).astype(np.int64)
                    now = counters[at]
                    counters[at] = now + (now < 255)
            if n:
                d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                ends = np.cumsum([0, *map(len, signs)]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(signs)))
                columns = [pa.array(np.zeros(len(n), np.int32)), pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), flat, pa.nulls(len(n), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=kinds)
        for at in range(0, 1 << bits, SEGMENT):
            part = counters[at : at + SEGMENT]
            if part.any():
                row = {"kind": 1, "key": at // SEGMENT, "n": None, "d1": None, "d2": None, "bits": None, "counts": part.tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema=kinds)

    return run


def _sum_segments(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of counters added up, a byte each on the logarithmic scale; all rows of a segment are in one partition."""
    sums: dict[int, np.ndarray] = {}
    for batch in frame:
        for key, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(counts, np.uint8)
            sums[key] = sums[key] + part if key in sums else part.astype(np.int64)
    for key, total in sums.items():
        scaled = np.minimum(255, np.rint(STEPS * np.log2(1.0 + total))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([scaled.tobytes()], pa.binary())], ["key", "counts"])


def _counters(base: DataFrame, bits: int) -> np.ndarray:
    """The scaled counters of the corpus: 2**bits bytes."""
    counters = np.zeros(1 << bits, np.uint8)
    segments = base.where("kind = 1").select("key", "counts")
    spread = segments.repartition(max(1, (1 << bits) // SEGMENT // 8), "key").mapInArrow(tidied(_sum_segments), "key bigint, counts binary")
    # one row a segment, whatever the input
    for r in spread.collect():
        part = np.frombuffer(r.counts, np.uint8)
        counters[r.key * SEGMENT : r.key * SEGMENT + len(part)] = part
    return counters


def _prefixes(width: int, bits: int, counters, block: int):
    """Pass 2: the prefix shingles of every text, by set; copies within a partition once."""

    def run(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler, seen, counts = Shingler(width), set(), counters.value
        members_of_block = np.exp2(np.arange(256) / STEPS) - 1
        schema = pa.schema([("token", pa.int64()), ("part", pa.int32()), ("sid", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])
        for _, texts in _batches(frame):
            columns: list[list[np.ndarray]] = [[], [], [], [], []]
            for text in texts:
                members = shingler.members(text)
                n = len(members)
                if not n:
                    continue
                digest = xxhash.xxh3_128_digest(members.tobytes())
                if digest in seen:
                    continue
                if len(seen) < _MEMO:
                    seen.add(digest)
                sid = np.frombuffer(digest, np.int64)[0]
                often = counts[(members & np.uint64((1 << bits) - 1)).astype(np.int64)]
                first = np.lexsort((members, often))[: n - -(-NUMERATOR * n // DENOMINATOR) + 1]
                parts = np.ceil(members_of_block[often[first]] / block).astype(np.int64)
                columns[0].append(members[first].view(np.int64))
                columns[1].append(np.where(parts > 1, 1 + (int(sid) & 0x7FFFFFFF) % np.maximum(parts, 1), 0).astype(np.int32))
                columns[2].append(np.full(len(first), sid, np.int64))
                columns[3].append(np.full(len(first), n, np.int32))
                columns[4].append(np.arange(len(first), dtype=np.int32))
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], schema=schema)

    return run


def _overlap(width: int):
    """Sizes and overlap of the sets of two texts."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        shingler = Shingler(width)
        none = b"", shingler.members(b"")
        last = [none, none]
        for left, right in batches:
            na, nb, both = [], [], []
            for pair in zip(left.cast(pa.binary()).to_pylist(), right.cast(pa.binary()).to_pylist(), strict=True):
                for k, x in enumerate(pair):  # pairs come sorted by one side
                    if x != last[k][0]:
                        last[k] = x, shingler.members(x)
                p, q = last[0][1], last[1][1]
                na.append(len(p))
                nb.append(len(q))
                both.append(len(np.intersect1d(p, q, assume_unique=True)))
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (na, nb, both)], ["na", "nb", "both"])

    run = tidied(run)
    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "na bigint, nb bigint, both bigint")


def _needed(na: Column, nb: Column) -> Column:
    """The overlap that two sets of these sizes need: ceil(t / (1 + t) (na + nb))."""
    return F.ceil((na + nb) * NUMERATOR / F.lit(float(NUMERATOR + DENOMINATOR)) - 1e-9)


def _may_link(na: Column, ia: Column, nb: Column, ib: Column) -> Column:
    """Length, prefix and positional filters of a shingle that both sets have at these places.

    Sets that overlap in o shingles share one of the first na - o + 1 and nb - o + 1, and o is
    known once both sizes are: nearer copies in size need shorter prefixes than one set alone.
    """
    length = (F.least(na, nb) * DENOMINATOR >= F.greatest(na, nb) * NUMERATOR)
    needed = _needed(na, nb)
    prefix = (ia <= na - needed) & (ib <= nb - needed)
    most = F.least(ia, ib) + 1 + F.least(na - ia - 1, nb - ib - 1)
    return length & prefix & (most >= needed)


def _pair(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b).alias("x"), F.greatest(a, b).alias("y")


def _near(n: str, pos: str) -> Column:
    """The place is in the prefix that sets of one size need."""
    return F.col(pos) <= F.col(n) - _needed(F.col(n), F.col(n))


def _partners(order: list, *fields: str) -> tuple[Column, Column]:
    """The last near member before a row in its block, and the near member of least place in its prefix, the hub."""
    member, block = F.when(_near("n", "pos"), F.struct(*fields)), Window.partitionBy("token", "part")
    before = block.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(member, ignorenulls=True).over(before), F.first(member, ignorenulls=True).over(block.orderBy("pos", "n", "sid").rowsBetween(Window.unboundedPreceding, 0))


def _tried(rows: DataFrame, differ: str) -> DataFrame:
    """Pairs of each row and those in ``near`` and ``hub``, where these differ in a column and may link."""

    def fits(p: Column) -> Column:
        return (p[differ] != F.col(differ)) & (p["sid"] != F.col("sid")) & _may_link(F.col("n"), F.col("pos"), p["n"], p["pos"])

    some = rows.select("sid", F.explode(F.transform(F.filter(F.array("near", "hub"), lambda p: p.isNotNull() & fits(p)), lambda p: p["sid"])).alias("other"))
    return some.select(*_pair("sid", "other")).distinct()


def _left_to_try(mixed: DataFrame) -> tuple[int, int]:
    """Rows, and how many pairs of rows of different components their blocks hold, in near prefixes."""
    per = mixed.where(_near("n", "pos")).groupBy("token", "root").count().groupBy("token").agg(F.sum("count").alias("c"), F.sum(F.col("count") * F.col("count").cast("double")).alias("own"))
    rows, left = per.agg(F.sum("c"), F.sum((F.col("c") * F.col("c").cast("double") - F.col("own")) / 2)).head()
    return rows or 0, int(left or 0)


def _differ(x: Column, y: Column) -> Column:
    """In how many places two bitmaps differ; the longer one is folded to the size of the other."""
    folded = lambda r, o: F.when(
        F.size(r) > F.size(o), F.zip_with(F.slice(r, 1, F.size(o)), F.slice(r, F.size(o) + 1, F.size(o)), lambda p, q: p.bitwiseOR(q))).otherwise(r)
    return F.aggregate(F.zip_with(folded(x, y), folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)


def _verify(pairs: DataFrame, docs: DataFrame, groups: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (x, y of sids) that pass the suffix filter, and the links (a, b of representatives) among them."""
    side = lambda s, rep: groups.select(F.col("d1").alias(s), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"b{s}"), F.col("rep").alias(rep))
    known = pairs.join(side("x", "a"), "x").join(side("y", "b"), "y")
    # sets of sizes in reach of each other have bitmaps of one size or of two in a row
    near = F.col("nx") + F.col("ny") - 2 * _needed(F.col("nx"), F.col("ny"))
    kept = materialize(known.where(_differ(F.col("bx"), F.col("by")) <= near).select("x", "y", "a", "b").distinct(), "pairs")
    met = kept.select("a", "b").where("a != b").distinct()
    # texts move, not sets: they are smaller; few rows pass the bitmap into the shuffle, which both sides share
    texts = docs.where(may_be_in("doc_id", met.select(F.explode(F.array("a", "b")).alias("doc_id"))))
    left, right = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    met = met.join(left, "a").join(right, "b").select("a", "b", _overlap(width)("ta", "tb").alias("o"))
    # where rows of one id have several texts, or digests collide in 64 bits, all combinations are tried
    links = met.where(F.col("o.both") * (NUMERATOR + DENOMINATOR) >= (F.col("o.na") + F.col("o.nb")) * NUMERATOR).where("o.both > 0").select("a", "b")
    return kept, materialize(links, "links")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, sketch_bits: int = SKETCH_BITS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable by links) of every row."""
    spark = df.sparkSession
    workers(spark)
    docs = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].cast("string").alias("text"))
    base = materialize(docs.mapInArrow(tidied(_describe(width, sketch_bits)), _SETS), "shingles")
    held = spark.sparkContext.broadcast(_counters(base, sketch_bits))
    sets = base.where("kind = 0").select(F.col("key").alias("doc_id"), "n", "d1", "d2", "bits")
    groups = materialize(sets.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.max("n").cast("int").alias("n"), F.any_value("bits").alias("bits")), "classes")

    entries = docs.where("doc_id is not null").mapInArrow(tidied(_prefixes(width, sketch_bits, held, block)), "token bigint, part int, sid bigint, n int, pos int")
    w = Window.partitionBy("token", "part").orderBy("n", "sid", "pos")
    before, hub = _partners(["n", "sid", "pos"], "sid", "n", "pos")
    shared = entries.repartition("token", "part").select(
        "token", "part", "sid", "n", "pos", before.alias("near"), hub.alias("hub"), F.lag("sid").over(w).alias("p_sid"), F.lead("sid").over(w).alias("next"))
    shared = materialize(shared.where("part > 0 or p_sid != sid or next != sid").drop("p_sid", "next"), "shared")
    held.unpersist()

    heads = shared.where("part > 0").groupBy("token", "part").agg(F.min(F.struct((~_near("n", "pos")).alias("far"), "n", "sid", "pos")).alias("h"))
    over = Window.partitionBy("token").orderBy("h", "part")
    heads = heads.withColumn("p", F.lag("h").over(over)).where("p.sid != h.sid").select(*_pair("h.sid", "p.sid"))
    tried, links = _verify(_tried(shared, "sid").unionByName(heads).distinct(), docs, groups, width)
    written = [groups, tried, links]
    tried = tried.select("x", "y")

    def roots(found: DataFrame) -> DataFrame:
        joined = components(found)
        out = materialize(groups.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "rep", F.coalesce("root", "rep").alias("root")), "roots")
        discard(joined)
        return out

    def members_of_several(at: DataFrame) -> DataFrame:
        """Entries of tokens whose members are in more than one component, with the component."""
        member = shared.select("token", "part", "sid", "n", "pos").join(at.groupBy(F.col("d1").alias("sid")).agg(F.min("root").alias("root")), "sid")
        member = materialize(member, "members")
        several = member.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("token")
        mixed = materialize(member.join(several, "token").distinct(), "members")
        discard(member)
        return mixed

    at = roots(links)
    mixed, last = members_of_several(at), float("inf")
    for k in range(1, ROUNDS + 1):
        rows, left = _left_to_try(mixed)
        if left <= PAIRS_A_ROW * rows or 4 * left > 3 * last:
            break
        last = left
        before, hub = _partners(["n", F.xxhash64("sid", F.lit(k)), "pos"], "sid", "n", "pos", "root")
        chained = _tried(mixed.withColumns({"near": before, "hub": hub}), "root")
        again, more = _verify(chained.join(tried, ["x", "y"], "left_anti"), docs, groups, width)
        written += [again, more]
        tried, links = tried.unionByName(again.select("x", "y")), links.unionByName(more)
        discard(mixed, at)
        at = roots(links)
        mixed = members_of_several(at)
    p, q = mixed.drop("part").alias("p"), mixed.drop("part").alias("q")
    cross = p.join(q, (F.col("p.token") == F.col("q.token")) & (F.col("p.root") < F.col("q.root")) & _may_link(F.col("p.n"), F.col("p.pos"), F.col("q.n"), F.col("q.pos"))).select(*_pair("p.sid", "q.sid")).distinct()
    again, more = _verify(cross.join(tried, ["x", "y"], "left_anti"), docs, groups, width)
    discard(mixed, shared)
    if more.head(1):
        discard(at)
        at = roots(links.unionByName(more))
    discard(*written, again, more)
    out = sets.join(at, ["d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))
