"""Token counts of a unigram vocabulary by a Viterbi search that keeps no path.

An Aho-Corasick automaton lists the pieces that end at each character; the best score and its number of pieces
go forward.  Ties follow the Unigram model of the ``tokenizers`` library: sums are 64-bit floats, a path replaces another
only with a strictly higher score, and longer last pieces are tried first; a character that is no piece of its own may
stand for an unknown at a penalty, and unknowns fall back to one piece per byte or, without that, neighbouring ones are one.  No trained unigram vocabulary is at hand,
so the pieces and scores of a public 32k vocabulary are read as one.

A text is cut where no piece can cross: before white space marks and between characters that no piece has side by
side.  Each part is solved once and remembered.  Without byte fallback texts are solved whole.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
PENALTY = 10.0
CACHE_PARTS = 300_000


class UnigramCounter(dict):
    """Pieces by part of a text (a word without its white space mark); missing parts are solved.

    ``pieces``: (piece, score) of the vocabulary without control pieces.
    """

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.pairs = {p[i:i + 2] for p, _ in pieces for i in range(len(p) - 1)}
        if any(b == MARK != a for a, b in self.pairs):
            raise ValueError("a piece crosses the start of a word")
        self.unknown = min(s for _, s in pieces) - PENALTY
        self.byte_fallback = byte_fallback
        self.solved: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        got = self._unit(MARK + word)
        if len(self) >= CACHE_PARTS:
            self.clear()
        if len(word) < 100:
            self[word] = got
        return got

    def _unit(self, unit: str) -> int:
        total, start, pairs = 0, 0, self.pairs
        for i in range(1, len(unit)):
            if unit[i - 1:i + 1] not in pairs:
                total += self._part(unit[start:i])
                start = i
        return total + (self._part(unit[start:]) if start < len(unit) else 0)

    def _part(self, part: str) -> int:
        got = self.solved.get(part)
        if got is None:
            got = self.solve(part)
            if len(self.solved) >= CACHE_PARTS:
                self.solved.clear()
            if len(part) < 100:
                self.solved[part] = got
        return got

    def solve(self, text: str) -> int:
        """Pieces of the best segmentation of ``text``, taken whole."""
        n = len(text)
        best, count = [0.0] + [float("-inf")] * n, [0] * (n + 1)
        alone = [False] * n
        tail = [False] * (n + 1)  # whether the best path to a place ends in an unknown

        def unknown(end: int) -> None:
            score = best[end - 1] + self.unknown
            if score > best[end]:
                best[end], tail[end] = score, True
                if self.byte_fallback:
                    count[end] = count[end - 1] + len(text[end - 1].encode("utf-8", "replace"))
                else:  # neighbouring unknowns are one
                    count[end] = count[end - 1] + (not tail[end - 1])

        done = 0  # ends that are final
        for last, (size, piece) in self.automaton.iter(text):
            end = last + 1
            while done < end - 1:
                done += 1
                if not alone[done - 1]:
                    unknown(done)
            score = best[end - size] + piece
            if score > best[end]:
                best[end], count[end], tail[end] = score, count[end - size] + 1, False
            if size == 1:
                alone[last] = True
        while done < n:
            done += 1
            if not alone[done - 1]:
                unknown(done)
        return count[n]

    def count(self, text: str) -> int:
        """Pieces of ``text`` as the tokenizer writes it: a mark first, a mark for each space."""
        if not text:
            return 0
        if not self.byte_fallback:  # an unknown may go on over any cut
            return self.solve(MARK + text.replace(" ", MARK))
        words = text.replace(MARK, " ").split(" ")
        if "" not in words:
            return sum(map(self.__getitem__, words))
        total, run = 0, ""
        for w in words:  # marks in a row may be pieces of their own
            if w:
                total += self._unit(run + MARK + w) if run else self[w]
                run = ""
            else:
                run += MARK
        return total + (self._unit(run) if run else 0)


def vocabulary(path: str | None = None) -> tuple[list[tuple[str, float]], bool]:
    """Pieces with their scores but for control pieces, the unknown first, and whether unknowns fall back to bytes, of a
    sentencepiece model file."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unused(i))]
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in ids], any(sp.is_byte(i) for i in range(sp.get_piece_size()))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of each row of ``docs`` (doc_id, text, source).

    Null and empty texts have 0 tokens.  Whole texts are counted.  Other columns are ignored; no documents, no rows.
    """
    def count(batches):
        counter = UnigramCounter(*vocabulary(path))
        for b in batches:
            n = [counter.count(t.as_py()) if t.is_valid else 0 for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())],
                                             ["doc_id", "source", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(
        count, "doc_id long, source string, n_tokens long")
