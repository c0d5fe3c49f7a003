"""Token counts by count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates, for each end position, the vocabulary pieces that end there;
dynamic programming carries only the best score and its number of pieces. Ties follow the tokenizer:
of equal scores the piece that starts first stays. A character without a piece of its own costs the
least score minus 10 and counts as its UTF-8 bytes (byte fallback).

Spaces become `▁` and one is put in front. No piece of such vocabularies has `▁` behind another character,
so a text's best path is the sum of its segments' best paths, and segments are remembered.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY = os.environ.get("PIECE_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")
UNKNOWN_COST = 10.0
REMEMBERED = 200_000
_SEGMENT, _BORDER = re.compile("▁*[^▁]+|▁+"), re.compile("[^▁]▁")
#: Characters of a text that are split into segments at a time, and places of a long segment that are held.
STRETCH, KEPT = 1 << 20, 1 << 16


def load_vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a SentencePiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [(model.id_to_piece(i), model.get_score(i)) for i in plain]


class Counter32:
    """Counts pieces; remembers up to `remembered` segments."""

    def __init__(self, vocabulary: list[tuple[str, float]], remembered: int = REMEMBERED):
        if any("▁" in piece.lstrip("▁") for piece, _ in vocabulary):
            raise ValueError("a piece has ▁ behind another character: texts can't be cut into segments")
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in vocabulary if len(piece) == 1}
        self.longest = max((len(piece) for piece, _ in vocabulary), default=0)
        self.unknown = min((score for _, score in vocabulary), default=0.0) - UNKNOWN_COST
        self.remembered, self.known = remembered, {}

    def segment(self, s: str) -> tuple[float, int]:
        """(best score, pieces) of one segment. The program follows the automaton; of places further back than the longest
        piece nothing is kept."""
        n, base, single = len(s), 0, self.single
        best, count = [0.0], [0]
        matches = self.automaton.iter(s)  # long pieces first at one end
        at, piece = next(matches, (n, None))
        for end in range(n):
            top, pieces, here = None, 0, end + 1 - base
            while at == end:
                length, score = piece
                total = best[here - length] + score
                if top is None or total > top:
                    top, pieces = total, count[here - length] + 1
                at, piece = next(matches, (n, None))
            if s[end] not in single:
                total = best[-1] + self.unknown
                if top is None or total > top:
                    top, pieces = total, count[-1] + len(s[end].encode("utf-8", "replace"))
            best.append(top)
            count.append(pieces)
            if len(best) > KEPT + self.longest:
                base += len(best) - self.longest - 1
                del best[: -self.longest - 1], count[: -self.longest - 1]
        return best[-1], count[-1]

    def segments(self, text: str) -> Iterator[Counter]:
        """Counts of the segments of a text, a stretch at a time; stretches end between segments."""
        at = 0
        while at < len(text):
            gap = _BORDER.search(text, min(at + STRETCH, len(text)))
            end = gap.end() - 1 if gap else len(text)
            yield Counter(_SEGMENT.findall(text, at, end))
            at = end

    def text(self, text: str | None) -> tuple[int, float]:
        """(tokens, score) of a text; (0, 0) for null or empty."""
        if not text:
            return 0, 0.0
        tokens, score, known = 0, 0.0, self.known
        for part in self.segments("▁" + text.replace(" ", "▁")):
            for s, n in part.items():
                found = known.get(s)
                if found is None:
                    found = self.segment(s)
                    if len(s) < 64:
                        if len(known) >= self.remembered:
                            known.clear()
                        known[s] = found
                tokens += n * found[1]
                score += n * found[0]
        return tokens, score


_COUNTERS: dict[int, Counter32] = {}


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: list[tuple[str, float]] | None = None) -> DataFrame:
    """(id_col, n_tokens long, score double) for each row of `docs`.

    `vocabulary` defaults to the file at VOCABULARY, read by the driver and sent with the job (a vocabulary
    is of fixed size). Null and empty texts have 0 tokens. Repeated rows stay, other columns are ignored,
    texts are counted whole, however long they or their segments are, in bounded memory beside the text; an empty
    table gives an empty result.
    """
    pieces = load_vocabulary() if vocabulary is None else vocabulary
    key = hash(tuple(pieces))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pixelweave.llm import tokens

        counter = tokens._COUNTERS.get(key)  # a Python worker serves many tasks
        if counter is None:
            tokens._COUNTERS.clear()
            counter = tokens._COUNTERS[key] = tokens.Counter32(pieces)
        for batch in batches:
            found = [counter.text(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64())], names=["id", "n_tokens", "score"])

    counted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, score double")
    return counted.withColumnRenamed("id", id_col)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op9_token_counts": op9_token_counts}
#: Viterbi over a vocabulary file has no SQL; tests/llm compare with a public tokenizer library.
ORACLE_SQL: dict[str, str] = {}
