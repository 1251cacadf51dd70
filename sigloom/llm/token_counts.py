"""Token counts of a unigram vocabulary, by a Viterbi pass that carries counts instead of pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .words import small_batches

#: Fixed values of the tokenizer family: the blank, and how far an unknown character lies below the worst piece.
BLANK = "▁"
UNKNOWN_PENALTY = 10.0
#: Chunks remembered by a worker, and the characters of the longest that is; a full memory is emptied.
MEMORY = 1 << 19
MEMORY_CHUNK = 64


class Unigram:
    """Pieces with scores. Characters that no piece covers cost one token a byte, or one a run without byte pieces."""

    def __init__(self, pieces: list[tuple[str, float]], bytes_for_unknown: bool = True):
        self.machine = ahocorasick.Automaton()
        for piece, score in pieces:
            self.machine.add_word(piece, (len(piece), float(score)))
        if pieces:
            self.machine.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.bytes_for_unknown = bytes_for_unknown
        alphabet = {c for piece, _ in pieces for c in piece}
        whole = all(float(s).is_integer() and abs(s) < 2**40 for _, s in pieces)
        apart = all(BLANK not in piece.lstrip(BLANK) for piece, _ in pieces)
        # No piece goes on past a blank or over an unknown character, so a text falls into chunks whose best paths
        # are independent. Whole-numbered scores add up without rounding, so ties fall alike in chunk and text.
        # With every character a piece of its own, nothing inside a chunk is unknown.
        self.alphabet: set[str] | None = None
        alone = {piece for piece, _ in pieces if len(piece) == 1}
        if whole and apart and bytes_for_unknown and alphabet | {BLANK} <= alone and alphabet != {BLANK}:
            self.alphabet = alphabet
            self.gap = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in alphabet)
        self.memory: dict[str, int] = {}

    def count(self, text: str) -> int:
        """Tokens of the best path: highest score, and of equal ones that whose last piece is longest, at every place.

        The automaton names the matches that end at each place, longest first,
        so a later match replaces the path only if it scores strictly higher.
        A character that no piece of its own length covers may be unknown.
        """
        n = len(text)
        best, tokens, fused = [0.0] + [-1e300] * n, [0] * (n + 1), [False] * (n + 1)
        done = 0

        def unknown(end: int) -> None:
            score = best[end - 1] + self.unknown
            if score > best[end]:
                best[end] = score
                cost = len(text[end - 1].encode()) if self.bytes_for_unknown else int(not fused[end - 1])
                tokens[end], fused[end] = tokens[end - 1] + cost, True

        covered = False
        for last, (size, piece_score) in self.machine.iter(text) if len(self.machine) else ():
            end = last + 1
            while done < end - 1:
                done += 1
                if done != end and not covered:
                    unknown(done)
                covered = False
            score = best[end - size] + piece_score
            if score > best[end]:
                best[end], tokens[end], fused[end] = score, tokens[end - size] + 1, False
            covered = covered or size == 1
        while done < n:
            done += 1
            if not covered:
                unknown(done)
            covered = False
        return tokens[n]

    def learn(self, chunks: set[str]) -> None:
        """Remember the counts of chunks: one pass over all that are new, each with a path of its own."""
        if len(self.memory) + len(chunks) > MEMORY:
            self.memory.clear()
        new = [c for c in chunks if c not in self.memory and len(c) <= MEMORY_CHUNK]
        odd = [c for c in new if c[0] not in self.alphabet]
        self.memory.update((c, len(c.encode())) for c in odd)
        new = [c for c in new if c[0] in self.alphabet]
        ends = list(accumulate(len(c) + 1 for c in new))
        best, tokens = [-1e300] * (ends[-1] + 1 if ends else 1), [0] * (ends[-1] + 1 if ends else 1)
        for start in [0, *ends]:
            best[start] = 0.0
        for last, (size, score) in self.machine.iter(self.gap.join(new)):
            end = last + 1
            score += best[end - size]
            if score > best[end]:
                best[end] = score
                tokens[end] = tokens[end - size] + 1
        self.memory.update(zip(new, [tokens[e - 1] for e in ends]))

    def count_texts(self, texts: list[str | None]) -> list[int]:
        """Tokens of texts: a blank goes in front and stands for every space; a text without characters has none."""
        marked = [BLANK + t.replace(" ", BLANK) if t else "" for t in texts]
        if self.alphabet is None:
            return [self.count(t) if t else 0 for t in marked]
        odd = "".join(map(re.escape, sorted(set().union(*marked) - self.alphabet)))
        find = re.compile(f"{BLANK}*[^{BLANK}{odd}]+|{BLANK}+|[\\s\\S]").findall
        found = [find(t) for t in marked]
        self.learn(set().union(*found))
        known = self.memory
        return [sum([known[c] if c in known else self.count(c) for c in chunks]) for chunks in found]


_LOADED: dict[int, tuple[list, Unigram]] = {}


def loaded(pieces: list[tuple[str, float]]) -> Unigram:
    """Built once in each Python worker."""
    key = len(pieces)
    if key not in _LOADED or _LOADED[key][0] != pieces:
        _LOADED.clear()
        _LOADED[key] = (pieces, Unigram(pieces))
    return _LOADED[key][1]


def sentencepiece_pieces(path: str) -> list[tuple[str, float]]:
    """The ordinary pieces of a model file with their scores; control, unknown and byte pieces match no text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return [(model.id_to_piece(i), model.get_score(i)) for i in ordinary]


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_chars) for every document.

    ``pieces`` (a tokenizer's vocabulary, of fixed size) is sent to the tasks.
    Null and empty texts have no tokens. Texts of any length take one pass.
    Repeated rows repeat. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(sent.value)
        for batch in small_batches(batches, "text", 1 << 20):
            texts = batch.column("text").to_pylist()
            counts = pa.array(model.count_texts(texts), pa.int64())
            sizes = pa.array([len(t or "") for t in texts], pa.int64())
            yield pa.record_batch([batch.column("doc_id"), counts, sizes], ["doc_id", "n_tokens", "n_chars"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(run, schema)
