"""Token counts of a unigram tokenizer without making its tokens.

An Aho-Corasick automaton over the vocabulary gives every match in one pass. Dynamic programming over the
places keeps, for each, the best score of a segmentation that ends there and its number of pieces. The rules
are those of the tokenizers library's Unigram model: of equal scores the one whose last piece begins
first stays (only a higher score replaces another), a character that is no piece by itself may stand as
unknown at the least score of the vocabulary less 10, and an unknown character counts as its bytes in UTF-8
where the vocabulary has byte pieces. Spaces become the mark U+2581, and one mark precedes the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.bpe import Cached
from tallyweave.llm.common import map_arrow

MARK = "▁"
UNKNOWN_PENALTY = 10.0
_CHUNKS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class UnigramCounter:
    """Counts for a vocabulary of (piece, score) pairs."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool, least: float):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.byte_fallback, self.unknown = byte_fallback, least - UNKNOWN_PENALTY
        # where no piece goes from another character on to a mark, texts fall into chunks before marks
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p, _ in pieces)
        self.known = Cached(lambda word: self.count(MARK + word))

    def count(self, chunk: str) -> tuple[int, float]:
        """Pieces and score of the best segmentation of a chunk in which spaces are marks."""
        n = len(chunk)
        best, pieces = [0.0] * (n + 1), [0] * (n + 1)
        done = 0  # places up to here are final

        def unknown(at: int, score: float | None, number: int, single: bool) -> None:
            if not single and (score is None or best[at - 1] + self.unknown > score):
                score = best[at - 1] + self.unknown
                number = pieces[at - 1] + (len(chunk[at - 1].encode("utf-8", "surrogatepass")) if self.byte_fallback else 1)
            best[at], pieces[at] = score, number

        score, number, single = None, 0, False
        for end, (length, gain) in self.automaton.iter(chunk):
            while done < end:
                done += 1
                unknown(done, score, number, single)
                score, number, single = None, 0, False
            start = end + 1 - length
            got = best[start] + gain
            if score is None or got > score:
                score, number = got, pieces[start] + 1
            single = single or length == 1
        while done < n:
            done += 1
            unknown(done, score, number, single)
            score, number, single = None, 0, False
        return pieces[n], best[n]

    def text(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        if not self.apart:
            return self.count(MARK + text.replace(" ", MARK))
        words = text.split(" ")
        if "" in words or MARK in text:
            got = [self.known[c[1:]] for c in _CHUNKS.findall(MARK + text.replace(" ", MARK))]
        else:
            got = list(map(self.known.__getitem__, words))
        return sum(x for x, _ in got), float(np.cumsum([x for _, x in got])[-1])


def load_pieces(path: str) -> tuple[list[tuple[str, float]], bool, float]:
    """Ordinary pieces with their scores, whether there are byte pieces, and the least score, of a .model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    fixed = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
    pieces = [(model.id_to_piece(i), float(model.get_score(i))) for i in range(n) if not fixed[i]]
    return pieces, any(model.is_byte(i) for i in range(n)), min(float(model.get_score(i)) for i in range(n))


_local: dict[tuple, UnigramCounter] = {}


def _of(vocabulary: tuple) -> UnigramCounter:
    key = (len(vocabulary[0]), hash(tuple(vocabulary[0])), *vocabulary[1:])
    if key not in _local:
        _local.clear()
        _local[key] = UnigramCounter(*vocabulary)
    return _local[key]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens long, score double): pieces of the best segmentation of each whole text, and its score.

    A row for each row of ``docs``; other columns are not read. Null and the empty text have no tokens and
    score zero. White space other than the space is an ordinary character. The vocabulary is sent to the
    executors; its size does not grow with the data. Time and memory grow with a text's length only.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_pieces(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _of(vocabulary.value)
        for batch in batches:
            got = [counter.text(x.as_py() or "") for x in batch.column(1)]
            counts, scores = pa.array([x for x, _ in got], pa.int64()), pa.array([x for _, x in got], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, scores], ["doc_id", "n_tokens", "score"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_arrow(picked, run, "doc_id long, n_tokens long, score double")
