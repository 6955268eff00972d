"""SentencePiece encoding and decoding by exact backtracking over merge-type (BPE) models.

A sequence of pieces is what the merges of a BPE model make of a text exactly when every piece
is what the merges make of its own characters and every two neighbours stay apart when their
joint characters are merged anew.  The encoder therefore needs no merge queue over the text: an
Aho-Corasick automaton lists, in one scan, all pieces that start at each place; the longest is
tried first, a neighbour check re-merges two pieces, and a place from which nothing fits is marked
in a bitfield and never entered again.  Which piece is the longest that fits behind another is
remembered by their numbers, so that a place mostly takes one look-up.

A piece never holds a space after another character, and in most models none holds letters beside
other characters, so the text falls into segments that are encoded alone; short ones are
remembered, those of the latest texts at least.  A model whose pieces do not allow a cut is served
without it.

Defined results: a null or empty text has no ids and decodes to the empty text; characters that
no piece covers become byte pieces; very long texts need memory in proportion to their length;
repeated rows are encoded alike; an empty table gives an empty one; other columns stay, and columns
named as ``ids`` or ``decoded`` are replaced.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied, workers

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Remembered segments (of each of two generations) and neighbour checks in one worker.
MEMO_ENTRIES, PAIR_ENTRIES = 100_000, 400_000
MEMO_LENGTH = 48
#: What one batch of texts may hold: a worker has its texts, ids and decoded texts at once.
BATCH = "2m"


#: Ways to cut a text, the finest first; an encoder takes the first that cuts none of its pieces.
#: Spaces and letters, or spaces and others; spaces and all up to the next space; all.
SEGMENTS = [f"{SPACE}*[^\\W\\d_{{odd}}]+|{SPACE}*(?:(?!{SPACE})[\\W\\d_{{odd}}])+|{SPACE}+", f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", ".+"]


class Memo(dict):
    """Results for short segments in two generations: when the young one is full it becomes the old one, and what is found there is young again."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, segment: str) -> bytes:
        made = self.old.get(segment)
        if made is None:
            made = self.make(segment)
            if len(segment) > MEMO_LENGTH:
                return made
        if len(self) >= MEMO_ENTRIES:
            self.old = self.copy()
            self.clear()
        self[segment] = made
        return made


class MergeEncoder:
    """Encoder and decoder for one model file of the merge type."""

    def __init__(self, model_file: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2:
            raise ValueError("the model is not of the merge type (BPE)")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only the identity normaliser with escaped spaces is supported")
        if any(p.type in (USER_DEFINED, UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = norm.add_dummy_prefix
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.ids, self.score, self.of_byte, self.plain = {}, {}, {}, []
        for i, p in enumerate(model.pieces):
            if p.type == NORMAL:
                self.ids[p.piece], self.score[p.piece] = i, p.score
                self.plain.append(p.piece.replace(SPACE, " ").encode())
            elif p.type == BYTE:
                self.of_byte[int(p.piece[3:5], 16)] = i
                self.plain.append(bytes([int(p.piece[3:5], 16)]))
            else:
                self.plain.append(" ⁇ ".encode() if p.type == UNKNOWN else b"")
        self.pieces = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if len(piece) > 1:
                self.pieces.add_word(piece, i)
        self.pieces.make_automaton()
        #: Numbers: the ids, then those of characters that occur in pieces without being one, then one for all others.
        self.known = len(model.pieces)
        self.names = [p.piece for p in model.pieces] + sorted({c for p in self.ids for c in p} - set(self.ids)) + [""]
        self.other = len(self.names) - 1
        self.single = {c: i for c, i in self.ids.items() if len(c) == 1} | {c: self.known + i for i, c in enumerate(self.names[self.known : -1])}
        self.size = [len(x) for x in self.names[:-1]] + [1]
        #: The number of the next shorter piece, or first character, that begins a piece; -1: none.
        self.shorter = [-1] * len(self.names)
        for p, i in self.ids.items():
            if len(p) > 1:
                self.shorter[i] = next((self.ids[p[:k]] for k in range(len(p) - 1, 1, -1) if p[:k] in self.ids), self.single[p[0]])
        odd = "".join(sorted({c for p in self.ids for c in p if re.fullmatch(r"[^\W\d_]", c) and not c.isalpha()}))
        self.segments = next(x for x in (re.compile(x.format(odd=odd), re.S) for x in SEGMENTS) if all(len(x.findall(p)) == 1 for p in self.ids)).findall
        self.memo = Memo(self.segment_ids)
        #: By the number of a piece and that of a longest candidate behind it: the longest that fits, or -1. How many these are.
        self.behind: defaultdict[int, dict[int, int]] = defaultdict(dict)
        self.pairs = 0

    def merged(self, text: str) -> list[str]:
        """What the merges make of a short text: best score first, the leftmost among equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, last: int, piece: int) -> bool:
        """Whether the two pieces stay as they are when their characters are merged anew; last is -1 at the start."""
        if piece == self.other or last == self.other:
            return piece == self.other or self.fits(-1, piece)
        parts = [self.names[last]] if last >= 0 else []
        parts.append(self.names[piece])
        return self.merged("".join(parts)) == parts

    def choose(self, last: int, wanted: int) -> int:
        """The longest piece that fits behind last among wanted and the shorter ones that begin it, or -1; remembered for all that were tried."""
        if self.pairs >= PAIR_ENTRIES:
            self.behind.clear()
            self.pairs = 0
        row, tried = self.behind[last], []
        while (found := row.get(wanted)) is None:
            tried.append(wanted)
            if wanted < 0 or self.fits(last, wanted):
                found = wanted
                break
            wanted = self.shorter[wanted]
        row.update(dict.fromkeys(tried, found))
        self.pairs += len(tried)
        return found

    def backtrack(self, text: str) -> list[int]:
        """The numbers of the pieces of a segment."""
        n = len(text)
        size, single, other = self.size, self.single, self.other
        longest: list[int | None] = [None] * n  # of the pieces that start at each place; matches come by ascending end
        for end, piece in self.pieces.iter(text):
            longest[end - size[piece] + 1] = piece
        behind, shorter, failed = self.behind, self.shorter, None
        pieces: list[int] = []
        at, last, wanted = 0, -1, longest[0]
        while True:
            if wanted is None:
                wanted = single.get(text[at], other)
            piece = behind[last].get(wanted)
            if piece is None:
                piece = self.choose(last, wanted)
            if piece >= 0:
                end = at + size[piece]
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    pieces.append(piece)
                    if end == n:
                        return pieces
                    at, last, wanted = end, piece, longest[end]
                else:
                    wanted = shorter[piece]
                continue
            if failed is None:
                failed = bytearray((n >> 3) + 1)
            failed[at >> 3] |= 1 << (at & 7)
            if not pieces:
                raise ValueError("no sequence of pieces fits")
            piece = pieces.pop()
            at -= size[piece]
            last, wanted = pieces[-1] if pieces else -1, shorter[piece]

    def segment_ids(self, segment: str) -> bytes:
        """The ids of a segment as the bytes of 32-bit numbers."""
        pieces = self.backtrack(segment)
        if max(pieces) >= self.known:
            ends = accumulate(map(self.size.__getitem__, pieces))
            pieces = list(chain.from_iterable((x,) if x < self.known else self.piece_ids(segment[end - 1]) for x, end in zip(pieces, ends, strict=True)))
        return array("i", pieces).tobytes()

    def piece_ids(self, character: str) -> tuple[int, ...]:
        """The ids of a character that is no piece."""
        if not self.of_byte:
            return (self.unknown,)
        return tuple(self.of_byte[b] for b in character.encode())

    def packed(self, text: str | None) -> bytes:
        """The ids of a text as the bytes of 32-bit numbers."""
        if not text:
            return b""
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        return b"".join(map(self.memo.__getitem__, self.segments(text)))

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids that an encoder made; the space that encoding put in front goes."""
        plain = b"".join(map(self.plain.__getitem__, ids))
        if self.prefix and plain[:1] == b" ":
            plain = plain[1:]
        return plain.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(model_file: str) -> MergeEncoder:
    """One encoder a worker process and model."""
    return MergeEncoder(model_file)


def encode_decode(df: DataFrame, model_file: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", round_trip: bool = True) -> DataFrame:
    """Add ``ids array<int>`` and, with round_trip, ``decoded string`` to every row; other columns stay.

    model_file must be readable under the same path on every worker (an installed package's file).
    """

    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = encoder(model_file)
        for batch in batches:
            coded = [coder.packed(t) for t in batch.to_pylist()]
            offsets = np.zeros(len(coded) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in coded], out=offsets[1:])
            flat = np.frombuffer(b"".join(coded), np.int32)
            parts = {"ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))}
            parts["decoded"] = pa.array([coder.decode(array("i", x)) if round_trip else None for x in coded], pa.string())
            yield pa.StructArray.from_arrays(list(parts.values()), list(parts))

    workers(df.sparkSession, BATCH)
    both = tidied(both)
    both.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    coded = F.arrow_udf(both, "ids array<int>, decoded string")(df[text].cast("string"))
    out = df.withColumn("__coded", coded).withColumn(ids, F.col("__coded.ids"))
    if round_trip:
        out = out.withColumn(decoded, F.col("__coded.decoded"))
    return out.drop("__coded")
