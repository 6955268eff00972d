"""Secret scan: known forms by pattern, unknown ones by a battery of randomness tests.

Base kinds are found by pattern: ``assign`` (a named value), ``access`` (an access key id) and
``hex`` (a long run of hex digits).  Every other run of ``MIN_TOKEN`` or more token characters is
a candidate.  Its encoding is inferred (the first of ``ALPHABETS`` that has all its characters), and under the
hypothesis that it is random in that encoding three tests are made: chi-squared uniformity over
the alphabet, the number of runs above and below the mean symbol, and the serial correlation of
neighbours.  A candidate that passes all of them is then held against ordinary text: equal pairs
of characters are frequent there and changes between digits and letters rare, and both
deviations give one p-value.  Of these p-values a Benjamini-Hochberg threshold is taken over the
whole corpus, for each class of token length alone, so that many short candidates do not hide a
long one.  The thresholds come from counts by length class and rounded p-value, which is a table
of fixed size however large the corpus.

All of it is built-in functions over whole texts; nothing is shuffled but those counts.

Defined results: null and empty texts have no spans; repeated rows give repeated rows; positions
are code points, ends exclusive; an empty table gives an empty one; very long texts are scanned
whole; other columns stay, and one named as ``into`` is replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base kinds in their order, with the pattern that finds them (the same text for Java and Python).
KINDS = ("assign", "access", "hex", "random")
PATTERNS = {
    "assign": r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
MIN_TOKEN = 20
TOKEN = r"[A-Za-z0-9+/_-]{%d,}" % MIN_TOKEN
#: Lower bounds of the classes of token length.
LENGTH_CLASSES = (20, 32, 48, 80)
#: Text as the tests expect it: how often two of its letters are equal, and how often neighbours change between digits, cases and signs.
TEXT_EQUAL, TEXT_CHANGE = 0.07, 0.06
FALSE_DISCOVERIES = 0.01
#: |z| beyond which randomness is rejected (about one in 1,700).
REJECT = 3.4
BINS = 400
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Smaller alphabets before those that contain them; ``mixed`` takes what is in neither base 64.
ALPHABETS = {
    "hex": _DIGITS + "abcdef", "HEX": _DIGITS + "ABCDEF", "base32": _UPPER + "234567", "base32_lower": _LOWER + "234567", "base36": _DIGITS + _LOWER, "BASE36": _DIGITS + _UPPER,
    "alnum": _DIGITS + _UPPER + _LOWER, "base64": _UPPER + _LOWER + _DIGITS + "+/", "base64url": _UPPER + _LOWER + _DIGITS + "-_", "mixed": _UPPER + _LOWER + _DIGITS + "+/-_"}


def _once(value: Column, body) -> Column:
    """body(value), with the value computed once (a lambda variable of a one-element array)."""
    return F.transform(F.array(value), body)[0]


def places(text: Column, pattern: str) -> Column:
    """Matches of a pattern, leftmost and not overlapping: array of struct (start, stop, match)."""

    def spans(found: Column) -> Column:
        between = F.split(text, pattern, -1)
        step = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("match"))
        empty = F.array().cast("array<struct<start: bigint, stop: bigint, match: string>>")
        out = F.aggregate(
            step,
            F.struct(F.lit(0).cast("long").alias("at"), empty.alias("spans")),
            lambda a, s: F.struct(
                (a.at + F.length(s["gap"]) + F.length(s["match"])).alias("at"),
                F.concat(a.spans, F.array(F.struct((a.at + F.length(s["gap"])).alias("start"), (a.at + F.length(s["gap"]) + F.length(s["match"])).alias("stop"), s["match"].alias("match")))).alias("spans"),
            ),
            lambda a: a.spans,
        )
        return F.when(F.size(found) == 0, empty).otherwise(out)

    return _once(F.regexp_extract_all(text, F.lit(pattern), 0), spans)


def _ranked(rank: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"))


def base_spans(text: Column) -> Column:
    """Base spans by start, then kind: array of struct (start, rank, stop)."""
    found = []
    for rank, kind in enumerate(KINDS[:3]):
        spans = places(text, PATTERNS[kind])
        if kind == "assign":  # short values are dropped after matching, what they covered stays covered
            spans = F.filter(spans, lambda s: F.length(F.regexp_extract(s["match"], PATTERNS["assign"], 2)) >= 6)
        found.append(F.transform(spans, _ranked(rank)))
    return F.array_sort(F.concat(*found))


def encoding(token: Column) -> Column:
    out = F.lit("mixed")
    for kind, letters in [*ALPHABETS.items()][-2::-1]:
        out = F.when(token.rlike(f"^[{re.escape(letters)}]+$"), kind).otherwise(out)
    return out


def _battery(token: Column) -> Column:
    """Struct: encoding, z values of the three tests, and p (log10, negated) against ordinary text."""

    def measure(v: Column) -> Column:
        kind, chars = v.kind, v.chars
        n = F.size(chars).cast("double")
        letters = v.letters
        size = F.length(letters).cast("double")
        counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)))
        squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
        codes = F.transform(chars, lambda c: F.instr(letters, c).cast("double"))
        kinds = F.transform(chars, lambda c: F.when(c.rlike("[0-9]"), 0).when(c.rlike("[a-z]"), 1).when(c.rlike("[A-Z]"), 2).otherwise(3))

        def tests(x: Column) -> Column:
            chi = size / n * x.squares - n
            uniform = (chi - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
            mean = x.mean
            high = F.aggregate(x.codes, F.lit(0.0), lambda a, c: a + F.when(c > mean, 1.0).otherwise(0.0))
            pairs = F.arrays_zip(F.slice(x.codes, F.lit(1), F.size(x.codes) - 1).alias("a"), F.slice(x.codes, F.lit(2), F.size(x.codes) - 1).alias("b"))
            runs = 1 + F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.when((p["a"] > mean) != (p["b"] > mean), 1.0).otherwise(0.0))
            expected = 2 * high * (n - high) / n + 1
            spread = F.sqrt(F.greatest(F.lit(0.25), (expected - 1) * (expected - 2) / (n - 1)))
            square = F.aggregate(x.codes, F.lit(0.0), lambda a, c: a + (c - mean) * (c - mean))
            along = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - mean) * (p["b"] - mean))
            serial = F.when(square > 0, along / square).otherwise(1.0) * F.sqrt(n)
            equal, usual = (x.squares - n) / 2, n * (n - 1) / 2 * TEXT_EQUAL
            few = F.when(size > 16, (usual - equal) / F.sqrt(2 * usual)).otherwise(0.0)
            steps = F.arrays_zip(F.slice(x.kinds, F.lit(1), F.size(x.kinds) - 1).alias("a"), F.slice(x.kinds, F.lit(2), F.size(x.kinds) - 1).alias("b"))
            changes = F.aggregate(steps, F.lit(0.0), lambda a, p: a + F.when(p["a"] != p["b"], 1.0).otherwise(0.0))
            many = (changes - 0.5 - (n - 1) * TEXT_CHANGE) / F.sqrt((n - 1) * TEXT_CHANGE * (1 - TEXT_CHANGE))
            z = (few + many) / F.sqrt(F.lit(2.0))
            # the upper tail of the normal distribution, -log10: a logistic form, and beyond 4 the leading term
            small = F.log10(1 + F.exp(1.5976 * z + 0.07056 * z * z * z))
            large = (z * z / 2 + F.log(z * 2.5066282746)) / 2.302585092994
            p = F.when(z > 4, large).otherwise(small)
            random = (uniform < REJECT) & (F.abs((runs - expected) / spread) < REJECT) & (F.abs(serial) < REJECT)
            return F.struct(x.kind.alias("encoding"), uniform.alias("uniform"), ((runs - expected) / spread).alias("runs"), serial.alias("serial"), p.alias("p"), random.alias("random"))

        def with_mean(y: Column) -> Column:  # a field, so that it is not taken anew for every character
            mean = F.aggregate(y.codes, F.lit(0.0), lambda a, c: a + c) / n
            return _once(F.struct(y.kind.alias("kind"), y.codes.alias("codes"), y.squares.alias("squares"), y.kinds.alias("kinds"), mean.alias("mean")), tests)

        return _once(F.struct(kind.alias("kind"), codes.alias("codes"), squares.alias("squares"), kinds.alias("kinds")), with_mean)

    def with_letters(u: Column) -> Column:
        letters = F.create_map(*[F.lit(x) for k, a in ALPHABETS.items() for x in (k, a)])[u.kind]
        return _once(F.struct(u.kind.alias("kind"), u.chars.alias("chars"), letters.alias("letters")), measure)

    return _once(F.struct(encoding(token).alias("kind"), F.filter(F.split(token, ""), lambda c: c != "").alias("chars")), with_letters)


def _length_class(start: Column, stop: Column) -> Column:
    n = stop - start
    out = F.lit(0)
    for k, low in enumerate(LENGTH_CLASSES[1:], 1):
        out = F.when(n >= low, k).otherwise(out)
    return out


def _candidates(text: Column) -> Column:
    """Candidates with their tests: array of struct (start, stop, level, bin, random, encoding)."""

    def tested(s: Column) -> Column:
        return _once(_battery(s["match"]), lambda b: F.struct(
            s["start"].alias("start"), s["stop"].alias("stop"), _length_class(s["start"], s["stop"]).alias("level"),
            F.least(F.lit(BINS), F.greatest(F.lit(0), F.floor(b.p * 10).cast("int"))).alias("bin"), b.random.alias("random"), b.encoding.alias("encoding")))

    return F.transform(places(text, TOKEN), tested)


def thresholds(df: DataFrame, text: str = "text", rate: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """For each length class the least bin (tenths of -log10 p) that Benjamini and Hochberg accept over all candidates.

    The counts have at most (length classes) x (bins) rows, whatever the corpus.
    """
    body = F.coalesce(df[text].cast("string"), F.lit(""))
    found = df.select(F.explode(F.transform(_candidates(body), lambda c: F.struct(c["level"].alias("level"), F.when(c["random"], c["bin"]).otherwise(0).alias("bin")))).alias("c"))
    out: dict[int, int] = {}
    counts: dict[int, dict[int, int]] = {}
    for r in found.groupBy("c.level", "c.bin").count().collect():
        counts.setdefault(r["level"], {})[r["bin"]] = r["count"]
    for level, by in counts.items():
        total, above = sum(by.values()), 0
        for b in sorted(by, reverse=True):
            above += by[b]
            if b > 0 and total * 10 ** (-b / 10) <= rate * above:
                out[level] = b
    return out


def find_secrets(df: DataFrame, text: str = "text", into: str = "secrets", limits: dict[int, int] | None = None) -> DataFrame:
    """Add ``into``: array of struct (start, rank, stop) of all spans, by start, then kind; rank is the place in KINDS.

    limits: thresholds fitted before, else they are taken from these rows.
    """
    if limits is None:
        limits = thresholds(df, text)
    body = F.coalesce(df[text].cast("string"), F.lit(""))
    needed = F.lit(BINS + 1)
    df = df.withColumn("__base", base_spans(body))
    if not limits:
        return df.withColumn(into, F.col("__base")).drop("__base")

    def accepted(c: Column) -> Column:
        need = needed
        for level, b in limits.items():
            need = F.when(c["level"] == level, b).otherwise(need)
        return c["random"] & (c["bin"] >= need) & ~F.exists("__base", lambda s: (s["start"] < c["stop"]) & (c["start"] < s["stop"]))

    more = F.transform(F.filter(_candidates(body), accepted), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("rank"), c["stop"].alias("stop")))
    return df.withColumn(into, F.array_sort(F.concat("__base", more))).drop("__base")


def span_list(spans: Column) -> Column:
    """kind:start:stop of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"], s["stop"])), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced; spans that overlap or touch are replaced once."""
    out = F.aggregate(
        spans,
        F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.when(s["stop"] <= a.at, a).otherwise(
            F.struct(
                F.when((s["start"] <= a.at) & (a.at > 0), a.done).otherwise(F.concat(a.done, F.substr(text, (a.at + 1).cast("int"), (F.greatest(s["start"], a.at) - a.at).cast("int")), F.lit(mark))).alias("done"),
                s["stop"].alias("at"),
            )
        ),
        lambda a: F.concat(a.done, F.substr(text, (a.at + 1).cast("int"), F.length(text))),
    )
    return F.when(F.size(spans) > 0, out).otherwise(text)
