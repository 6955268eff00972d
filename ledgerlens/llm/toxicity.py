"""Toxicity by a weighted finite-state pattern grammar.

Texts fall into clauses, and five transducers read each clause from left to right.  *insult* reads
words and emits class symbols, with the learned weight of a word or of the stem that it begins
with; *threat* turns harm within reach of an intention or an address into a menace; *target* raises
insults and menaces that follow an address, *negation* and *report* lower those that follow a denial
or an attribution.  The last four are tables of arcs over one small alphabet, and ``compose`` makes
one machine of them, whose arcs multiply the weights of theirs; each word then costs one look-up.

A clause weighs what its insults and menaces weigh, less a price for its length, since long clauses hold
stems by chance; a clause that does not exceed its price is silent.  The document's log-odds are the intercept and
the weights of its clauses, and its score is their logistic: no word counts outside a clause.

What is learned: insult words and stems with their weights, and the intercept, from a stratified sample of
at most ``SAMPLE`` labelled texts for each label (taken by hash order, a fixed bound), held
against a small seed list.  A word counts once for each distinct left neighbour, so that copies of
one text do not make its words look like evidence.  Labels enter only from the training rows given.

Defined results: null and empty texts have no clauses and get the intercept's score; repeated rows
are scored alike; an empty table gives an empty one; other columns stay, and one named as ``into`` is
replaced; unlabelled corpora are scored with the seed list; very long texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, WORD_BYTES, ascii_lower, materialize, text_of, tidied, workers

#: Labelled texts of each label that fitting may read.
SAMPLE = 3000
#: Learned words at most; a word needs so many distinct neighbours, and so high a ratio of rates.
LEXICON, MIN_CONTEXTS, MIN_RATIO = 200, 12, 12.0
#: Distinct openings (first five words) that the texts with a learned word must have: near copies share theirs.
MIN_OPENINGS = 6
#: Learned stems: lengths of the beginnings of words that are tried, ratio and contexts needed, and the most one is worth.
STEM_LENGTHS, STEM_RATIO, STEM_CONTEXTS, STEM_WEIGHT = (5, 6, 7), 6.0, 30, 3.0
SEED_WEIGHT = 4.0
#: Word classes in English, German, French and Spanish.
SEEDS = (
    "idiot moron stupid loser pathetic worthless trash scum disgusting clown dumb imbecile filth vermin bastard bitch asshole retard "
    "arschloch abschaum trottel dummkopf hurensohn connard ordure crétin imbécile salaud idiota imbécil estúpido basura cabrón"
).split()
HARM = (
    "kill hurt beat destroy stab shoot murder punch strangle umbringen töten schlagen verletzen verprügeln erschießen erstechen "
    "tuer frapper blesser poignarder étrangler matar golpear herir apuñalar estrangular"
).split()
WILL = "will gonna going shall ll must want werde werden wirst wird vais vas va veux allons voy quiero vamos".split()
TARGET = "you your yours he she they him her them his their u du dich dir dein deine ihr euch tu toi ton ta vous tú ti usted ustedes".split()
NEGATION = "not no never isn aren wasn don doesn didn without neither nor nicht kein keine nie niemals pas jamais aucun nunca jamás ni".split()
REPORT = (
    "said says say wrote writes quoted quotes claimed reported reportedly allegedly called sagte sagt schrieb behauptete angeblich nannte "
    "dit disait écrivit prétend dijo dice escribió supuestamente"
).split()
#: How long target, negation and intention reach, in words (a report: to the clause's end).
REACH = 4
THREAT_WEIGHT, TARGET_FACTOR, NEGATION_FACTOR, REPORT_FACTOR = 4.0, 1.25, 0.4, 0.7
MAX_CLAUSE = 8.0
#: The price of a clause: for each word, and at most.
PRICE, MAX_PRICE = 0.1, 1.5
#: Class symbols: insult, menace, harm, intention, target, negation, report, other.
ALPHABET = "imhwtnro"
OTHER = ("o", 1.0)
_MEMO = 100_000
_CLAUSE = re.compile(rb"[.!?;\n]+")
_words = re.compile(WORD_BYTES)


class Transducer:
    """A deterministic transducer: arcs (state, symbol) -> (state, symbol, weight)."""

    def __init__(self, start, arcs: dict[tuple, tuple]):
        self.start, self.arcs = start, arcs

    @classmethod
    def reach(cls, start, step: Callable) -> Transducer:
        """All arcs that can be entered from the start, by a function of state and symbol."""
        arcs, open_ = {}, [start]
        while open_:
            state = open_.pop()
            for symbol in ALPHABET:
                if (state, symbol) not in arcs:
                    arcs[state, symbol] = step(state, symbol)
                    open_.append(arcs[state, symbol][0])
        return cls(start, arcs)

    def read(self, symbols: str) -> list[tuple[str, float]]:
        """What it emits for a string of symbols."""
        state, out = self.start, []
        for symbol in symbols:
            state, emitted, weight = self.arcs[state, symbol]
            out.append((emitted, weight))
        return out


def compose(left: Transducer, right: Transducer) -> Transducer:
    """The transducer that passes what the left one emits to the right one and multiplies their weights."""

    def step(state: tuple, symbol: str) -> tuple:
        p, between, v = left.arcs[state[0], symbol]
        q, emitted, w = right.arcs[state[1], between]
        return (p, q), emitted, v * w

    return Transducer.reach((left.start, right.start), step)


def threat() -> Transducer:
    """Harm within reach of an intention or an address becomes a menace, other harm is an other word."""

    def step(near: int, symbol: str) -> tuple:
        emitted = ("m" if near else "o") if symbol == "h" else symbol
        return REACH if symbol in "wt" else max(0, near - 1), emitted, 1.0

    return Transducer.reach(0, step)


def follows(opening: str, factor: float) -> Transducer:
    """Insults and menaces within reach after a symbol weigh ``factor``."""

    def step(near: int, symbol: str) -> tuple:
        return REACH if symbol == opening else max(0, near - 1), symbol, factor if near and symbol in "im" else 1.0

    return Transducer.reach(0, step)


def report(factor: float) -> Transducer:
    """Insults and menaces after an attribution weigh ``factor``, up to the end of the clause."""
    return Transducer.reach(False, lambda told, symbol: (told or symbol == "r", symbol, factor if told and symbol in "im" else 1.0))


def cascade() -> list[Transducer]:
    """The transducers behind *insult*, in order."""
    return [threat(), follows("t", TARGET_FACTOR), follows("n", NEGATION_FACTOR), report(REPORT_FACTOR)]


class Insult:
    """The first transducer: a word's class symbol and weight, by the word itself or the heaviest stem that it begins with."""

    def __init__(self, weights: dict[str, float], stems: dict[str, float]):
        self.known: dict[bytes, tuple[str, float]] = {w.encode(): (c, 1.0) for w, c in classes().items()}
        self.known |= {w.encode(): ("i", x) for w, x in weights.items()}
        self.stems = {w.encode(): x for w, x in stems.items()}
        self.sizes = sorted({len(x) for x in self.stems})
        self.memo: dict[bytes, tuple[str, float]] = {}

    def read(self, word: bytes) -> tuple[str, float]:
        found = self.known.get(word) or self.memo.get(word)
        if found is None:
            weight = max((self.stems.get(word[:n], 0.0) for n in self.sizes), default=0.0)
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            found = self.memo[word] = ("i", weight) if weight else OTHER
        return found


def classes() -> dict[str, str]:
    """The words of the fixed classes."""
    return {w: c for c, words in (("t", TARGET), ("w", WILL), ("h", HARM), ("n", NEGATION), ("r", REPORT)) for w in words}


class Grammar:
    """The composed transducers over one lexicon."""

    def __init__(self, weights: dict[str, float], intercept: float, stems: dict[str, float] | None = None, transducers: list[Transducer] | None = None):
        self.intercept = intercept
        self.insult = Insult(weights, stems or {})
        machine = reduce(compose, transducers or cascade())
        number: dict = {machine.start: 0}
        for state, _ in machine.arcs:
            number.setdefault(state, len(number))
        #: For each state: symbol -> (state, weight of an insult, weight of a menace).
        self.arcs: list[dict[str, tuple[int, float, float]]] = [{} for _ in number]
        for (state, symbol), (after, emitted, weight) in machine.arcs.items():
            self.arcs[number[state]][symbol] = number[after], weight if emitted == "i" else 0.0, THREAT_WEIGHT * weight if emitted == "m" else 0.0
        emitting = sorted([*(w.encode() for w in (*weights, *HARM))], key=lambda w: (-len(w), w))
        self.any = re.compile(b"(?<![0-9a-z\x80-\xff])(?:(?:" + b"|".join(map(re.escape, emitting)) + b")(?![0-9a-z\x80-\xff])" + b"".join(b"|" + re.escape(x) for x in sorted(self.insult.stems)) + b")")

    def clause(self, clause: bytes) -> float:
        """What a clause weighs: 0 where its matches do not exceed its price."""
        state, total, words, read, arcs = 0, 0.0, _words.findall(clause), self.insult.read, self.arcs
        for word in words:
            symbol, weight = read(word)
            state, insult, menace = arcs[state][symbol]
            total += insult * weight + menace
        return min(MAX_CLAUSE, max(0.0, total - min(MAX_PRICE, PRICE * len(words))))

    def score(self, text: bytes | None) -> tuple[float, int]:
        """Score and number of matched clauses."""
        low = (text or b"").lower()
        odds, matched = self.intercept, 0
        if self.any.search(low):
            for c in _CLAUSE.split(low):
                if self.any.search(c) and (weight := self.clause(c)):
                    odds += weight
                    matched += 1
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))), matched


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Grammar:
    """Fit the lexicon and the intercept on a bounded sample of the labelled rows given."""
    weights = dict.fromkeys(SEEDS, SEED_WEIGHT)
    known = labels.select(labels[doc_id].alias("k"), labels[label].cast("int").alias("y")).where("k is not null and y in (0, 1)").groupBy("k").agg(F.max("y").alias("y"))
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(sample) for y in (0, 1)]
    chosen = {r.k: r.y for p in parts for r in p.collect()}
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    if not counts.get(0) or not counts.get(1):
        return Grammar(weights, -3.0)
    spark = docs.sparkSession
    small = spark.createDataFrame([(int(k), y) for k, y in chosen.items()], "k bigint, y int")
    rows = docs.select(docs[doc_id].alias("k"), text_of(docs, text).alias("t")).join(F.broadcast(small), "k")
    words = F.regexp_extract_all(ascii_lower(F.col("t")), F.lit(WORD), 0)
    pairs = rows.select("y", words.alias("w")).select("y", F.xxhash64(F.slice("w", 1, 5)).alias("opening"), F.explode(F.arrays_zip(F.concat(F.array(F.lit("")), F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0)))).alias("before"), F.col("w").alias("word"))).alias("p"))
    per = pairs.where("p.word is not null").groupBy("p.word", "p.before").agg(F.max("y").alias("y"), F.min("y").alias("least"), F.min(F.when(F.col("y") == 1, F.col("opening"))).alias("opening"))
    parts_of = F.array(F.col("word"), *[F.when(F.length("word") >= n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in STEM_LENGTHS])
    per = per.select(F.explode(parts_of).alias("word"), "y", "least", "opening").where("word is not null")
    per = per.groupBy("word").agg(F.sum("y").alias("a"), F.sum(1 - F.col("least")).alias("b"), F.count_distinct("opening").alias("openings"))
    sizes = {y: max(1, sum(v == y for v in chosen.values())) for y in (0, 1)}
    ratio = ((F.col("a") + 0.5) / sizes[1]) / ((F.col("b") + 0.5) / sizes[0])
    stem = F.col("word").endswith("*")
    enough = F.when(stem, (F.col("a") >= STEM_CONTEXTS) & (F.col("ratio") >= STEM_RATIO)).otherwise((F.col("a") >= MIN_CONTEXTS) & (F.col("ratio") >= MIN_RATIO))
    per = materialize(per.withColumn("ratio", ratio).where((F.col("openings") >= MIN_OPENINGS) & enough), "toxic-words")
    for r in per.where(~stem).orderBy(F.desc("a"), "word").limit(LEXICON).collect():
        weights[r.word] = round(min(6.0, max(2.0, math.log(r.ratio))), 4)
    found = [r for r in per.where(stem).orderBy(F.desc("a"), "word").limit(LEXICON).collect() if not any(w.startswith(r.word[:-1]) for w in SEEDS)]
    stems = {r.word[:-1]: round(min(STEM_WEIGHT, math.log(r.ratio)), 4) for r in found}
    grammar = Grammar(weights, 0.0, stems)
    scored = rows.select("y", matches(F.col("t"), grammar).alias("m")).groupBy("y").agg(F.sum((F.col("m") == 0).cast("int")).alias("n")).collect()
    silent = {r.y: r.n * counts[r.y] / sizes[r.y] for r in scored}
    share = (silent.get(1, 0) + 1) / (silent.get(0, 0) + silent.get(1, 0) + 2)
    grammar.intercept = round(min(-1.5, math.log(share / (1 - share))), 6)
    return grammar


def matches(text: Column, grammar: Grammar) -> Column:
    return _scored(text, grammar).clauses


def _scored(text: Column, grammar: Grammar) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [grammar.score(t) for t in batch.cast(pa.binary()).to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())], ["score", "clauses"])

    run = tidied(run)
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "score double, clauses bigint")(text)


def score_toxicity(df: DataFrame, grammar: Grammar, text: str = "text", into: str = "toxicity") -> DataFrame:
    """Add ``into``: struct (score double, clauses bigint) to every row; other columns stay."""
    workers(df.sparkSession)
    return df.withColumn(into, _scored(text_of(df, text), grammar))


def held_out(doc_id: Column) -> Column:
    """Rows that fitting must not see: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit_on_training_rows(docs: DataFrame, labels: DataFrame) -> Grammar:
    workers(docs.sparkSession)
    return learn(docs, labels.where(~held_out(labels["doc_id"])))
