"""Token counts of a unigram vocabulary: Aho-Corasick matches and a Viterbi that keeps score and piece count only."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaplane.llm._encode import text_batches

#: The mark that stands for a space and opens every chunk.
MARK = "▁"
RUNS = re.compile(" +[^ ]*")
#: An unknown character scores so much less than the worst piece.
UNKNOWN = 10.0


class Counter:
    """Pieces and score of the best segmentation of a text.

    The text's spaces become marks, and a mark is put before a text that has none there. A run of marks opens a chunk:
    no piece has a mark behind another character, so none crosses the start of a chunk, and each distinct chunk is
    segmented once and remembered. Pieces of several marks count like any other. Of segmentations with equal scores the one whose last piece is longest wins at every position, as scores are compared from the earliest
    start on and replaced only by larger ones. A character without a piece of its own may be unknown; it counts as its
    UTF-8 bytes.
    """

    def __init__(self, pieces: list[tuple[str, float]], most: int = 400_000, longest: int = 48):
        import ahocorasick

        self.most, self.longest = most, longest
        self.known: dict[str, tuple[int, float]] = {}
        pieces = [(p, s) for p, s in pieces if p]
        if any(MARK in p.lstrip(MARK) for p, _ in pieces):
            raise ValueError("a piece has a mark behind another character, so that texts can't be cut there")
        self.unknown = min(s for _, s in pieces) - UNKNOWN
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, s in pieces:
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()

    def segment(self, chunk: str) -> tuple[int, float]:
        """Pieces and score of one chunk."""
        n, unknown, single = len(chunk), self.unknown, self.single
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        done, top, own = 0, None, 0  # ends below `done` are settled; top and own: the best for the end at work

        def settle(end: int) -> None:
            nonlocal done, top
            while done < end:
                done += 1
                c = chunk[done - 1]
                here = top if done == end else None
                # The unknown character comes after the pieces, as it starts last.
                if here is None or c not in single and best[done - 1] + unknown > here:
                    best[done], count[done] = best[done - 1] + unknown, count[done - 1] + len(c.encode())
                else:
                    best[done], count[done] = here, own
            top = None

        for last, (length, score) in self.automaton.iter(chunk):  # by end, longest first
            if last > done:
                settle(done + 1 if top is not None else last)
                if last > done:
                    settle(last)
            s = best[last + 1 - length] + score
            if top is None or s > top:
                top, own = s, count[last + 1 - length] + 1
        if top is not None:
            settle(done + 1)
        settle(n)
        return count[n], best[n]

    def chunk(self, part: str) -> tuple[int, float]:
        found = self.known.get(part)
        if found is None:
            found = self.segment(MARK + part.replace(" ", MARK))
            if len(part) <= self.longest:
                if len(self.known) >= self.most:
                    self.known.clear()
                self.known[part] = found
        return found

    def text(self, text: str | None) -> tuple[int, float]:
        """Pieces and score of a whole text."""
        if not text:
            return 0, 0.0
        text = text.replace(MARK, " ")
        parts = text.split(" ")
        if not parts[0]:
            parts = parts[1:]
        if "" in parts:
            # Runs of spaces: a chunk keeps the spaces before its own mark.
            parts = [p[1:] for p in RUNS.findall(text if text[0] == " " else " " + text)]
        get = self.known.get
        found = [get(p) or self.chunk(p) for p in parts]
        return sum([n for n, _ in found]), sum([s for _, s in found])


@functools.lru_cache(maxsize=2)
def counter(model: str) -> Counter:
    """The counter of a sentencepiece file's pieces and scores, one for each worker process."""
    return Counter(vocabulary(model))


def vocabulary(model: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file with their scores; control, unknown and byte pieces are left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


def token_counts(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, score of the best segmentation of the whole text.

    The scores of the file's pieces are taken as those of a unigram model, so the counts are that model's, which are not
    those of the file's own merges where the file is a BPE one. Null and empty texts have no tokens, score 0. Of
    segmentations with equal scores Counter says which one counts. Repeated rows are each returned; an empty table
    gives an empty result; other columns are ignored, whatever their names. Texts of any length are counted whole.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model)
        for b in text_batches(batches, "text"):
            found = [own.text(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array([n for n, _ in found], np.int64)), pa.array(np.array([s for _, s in found], np.float64))], names=["doc_id", "n_tokens", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, score double")
