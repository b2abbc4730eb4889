"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton enumerates the pieces that end at each character; dynamic programming
carries the best score and the number of pieces on the best path, and nothing else. Of equal
scores the path whose last piece is longer stays, as a strictly better score is needed to
replace one that an earlier start has set; a character that is no piece of its own is unknown,
costs 10 more than the worst piece, and counts as its UTF-8 bytes. Spaces are U+2581, and a text
that isn't empty begins with one.

A SentencePiece file of the unigram kind brings its scores. One of pairs that were merged (BPE) only
has the order of its merges; its pieces then are a unigram vocabulary by the law of Zipf and
Mandelbrot, a piece at place r scoring -log(r + ZIPF). Counts by it are those of a unigram tokenizer
with these pieces and scores, and near those of the merges, but not the same.

If no piece goes on from another character to U+2581, a best path is made of best paths of the
runs between, so that each distinct run is searched once and remembered.
"""

from __future__ import annotations

import math
import re
import struct
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The vocabulary that the query counts by: a SentencePiece model file, of unigrams or of merged pairs.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
ZIPF = 100
#: Such scores are multiples of 1 / GRAIN, so that sums of them are exact in any order.
GRAIN = 1 << 20
#: Runs that a worker remembers at most; it forgets them all and begins anew.
REMEMBERED = 500_000


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[tuple[str, float], ...]

    @property
    def unknown(self) -> float:
        return min((s for _, s in self.pieces), default=0.0) - UNKNOWN_PENALTY

    @property
    def splits(self) -> bool:
        """Whether no piece has a space after another character."""
        return not any(SPACE in p.lstrip(SPACE) for p, _ in self.pieces)


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        size = {1: 8, 5: 4}.get(key & 7)
        if key & 7 == 0:
            value, i = varint(i)
            yield key >> 3, value
            continue
        if size is None:
            size, i = varint(i)
        yield key >> 3, data[i : i + size]
        i += size


def load(path: str = MODEL_FILE) -> Vocabulary:
    """The normal pieces of a SentencePiece model file, with their scores, or those that follow from their places if these are merges. The driver reads it."""
    pieces, merges = [], False
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            if piece.get(3, 1) == 1:
                pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0))
        elif number == 2:
            merges = dict(_fields(value)).get(3, 1) == 2
    return Vocabulary(tuple((p, -round(math.log(r + ZIPF) * GRAIN) / GRAIN) for r, (p, _) in enumerate(pieces)) if merges else tuple(pieces))


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        if vocabulary.pieces:
            self.automaton.make_automaton()
        self.unknown, self.splits = vocabulary.unknown, vocabulary.splits
        self.known: dict[str, tuple[int, float]] = {}

    def search(self, text: str) -> tuple[int, float]:
        """(pieces, score) of the best path over the whole of a text whose spaces are U+2581."""
        scores, counts = [0.0] * (len(text) + 1), [0] * (len(text) + 1)
        at = 0  # characters that are done
        best, pieces, single = None, 0, False

        def end(at, best, pieces, single):
            if not single:
                score = scores[at] + self.unknown
                if best is None or score > best:
                    best, pieces = score, counts[at] + len(text[at].encode("utf-8", "surrogatepass"))
            scores[at + 1], counts[at + 1] = best, pieces

        for last, (size, score) in self.automaton.iter(text) if len(self.automaton) else ():
            while at < last:
                end(at, best, pieces, single)
                at += 1
                best, pieces, single = None, 0, False
            score += scores[last + 1 - size]
            if best is None or score > best:  # longer pieces come first
                best, pieces = score, counts[last + 1 - size] + 1
            single = single or size == 1
        while at < len(text):
            end(at, best, pieces, single)
            at += 1
            best, pieces, single = None, 0, False
        return counts[-1], scores[-1]

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        whole = SPACE + text.replace(" ", SPACE)
        if not self.splits:
            return self.search(whole)
        n, total, known = 0, 0.0, self.known
        for run in _RUN.findall(whole):
            found = known.get(run)
            if found is None:
                found = self.search(run)
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(run) <= 64:
                    known[run] = found
            n += found[0]
            total += found[1]
        return n, total


_RUN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def counted(text: Column, vocabulary: Vocabulary) -> Column:
    """A struct (n_tokens, score). Null and empty texts have no tokens and score 0."""
    counter: list[Counter] = []

    @F.arrow_udf("n_tokens long, score double")
    def run(column: pa.Array) -> pa.Array:
        if not counter:
            counter.append(Counter(vocabulary))
        found = [counter[0].count(x) for x in column.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())], names=["n_tokens", "score"])

    return run(F.coalesce(text, F.lit("")))


def token_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", model_file: str = MODEL_FILE) -> DataFrame:
    """(doc_id, n_tokens, score) of each row, over the whole text.

    Null and empty texts have no tokens and score 0. Rows that are alike all stay; null ids stay
    null; other columns, whatever their names, are not looked at; an empty table gives an empty one.
    """
    return docs.select(F.col(f"`{doc_id}`"), counted(F.col(f"`{text}`"), load(model_file)).alias("c")).select(doc_id, "c.n_tokens", "c.score")
