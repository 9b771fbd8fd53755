"""Token counts of a unigram vocabulary without building the tokens.

An Aho-Corasick automaton over the vocabulary finds every piece that ends at a
character; the best score and the number of pieces up to each character are
carried along. Nothing crosses a word start, so counts are kept per word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradespark.llm.common import map_texts, narrow

#: Fixed values of unigram tokenizers: the mark of a word start, and how much less than the worst piece an unknown character scores.
WORD_START = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose counts a task remembers, and their greatest length.
REMEMBERED, WORD_CHARS = 300_000, 64


class UnigramCounter(dict):
    """Pieces and score of a word, by the tokenizer's own rules.

    Among segmentations of equal score the one whose last piece starts first
    wins, at every character. A character that no piece of its own covers is
    unknown; it counts as its bytes if the vocabulary has all byte pieces,
    else a run of unknown characters counts once.
    """

    def __init__(self, vocabulary: Sequence[tuple[str, float]]) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        known = {piece for piece, _ in vocabulary}
        self.bytes = all(f"<0x{b:02X}>" in known for b in range(256))
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY

    def of(self, unit: str) -> tuple[int, float]:
        size = len(unit)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        for end, match in self.automaton.iter(unit):  # the longest first
            ends[end].append(match)
        best, count, lost = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        for end, matches in enumerate(ends, 1):
            top, start, single = None, 0, False
            for length, score in matches:
                single = single or length == 1
                if top is None or best[end - length] + score > top:
                    top, start = best[end - length] + score, end - length
            if not single and (top is None or best[end - 1] + self.unknown > top):
                best[end], lost[end] = best[end - 1] + self.unknown, True
                more = len(unit[end - 1].encode("utf-8", "replace")) if self.bytes else not lost[end - 1]
                count[end] = count[end - 1] + more
            else:
                best[end], count[end] = top, count[start] + 1
        return count[size], best[size]

    def __missing__(self, word: str) -> tuple[int, float]:
        found = self.of(WORD_START + word)
        if len(word) <= WORD_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found

    def text(self, text: str) -> tuple[int, float]:
        """Pieces and score of a text: blanks start words, and so does its beginning."""
        if not text:
            return 0, 0.0
        words = text.replace(WORD_START, " ").split(" ")
        if len(words) > 1 and not words[0]:
            del words[0]
        count, score = 0, 0.0
        for c, s in map(self.__getitem__, words):
            count += c
            score += s
        return count, score


def count_tokens(docs: DataFrame, vocabulary: Sequence[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, score)``, one row per input row, over whole texts.

    Null and empty texts have no token and score 0. Ids may be null or repeat.
    """
    vocabulary = list(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter(vocabulary)
        for batch in batches:
            found = [counter.text(t or "") for t in batch.column(1).to_pylist()]
            counts, scores = pa.array([c for c, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, scores], ["doc_id", "n_tokens", "score"])

    rows = narrow(docs, {"doc_id": F.col(id_col).cast("bigint"), "text": F.col(text_col).cast("string")})
    return map_texts(rows, run, "doc_id bigint, n_tokens bigint, score double")


def vocabulary_of(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), float(model.get_score(i))) for i in range(model.vocab_size())]
