"""Byte-level BPE encoding and decoding by a segment tree of pair ranks."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .words import small_batches

NONE = 1 << 62
#: Pieces remembered by a worker, and the bytes of the longest that is; a full memory is emptied.
MEMORY = 1 << 19
MEMORY_PIECE = 64


class Vocabulary:
    """Byte strings with their ranks, which are also their ids."""

    def __init__(self, rank_file: bytes):
        pairs = (line.split() for line in rank_file.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        splits = {
            (self.ranks[token[:k]] << 32 | self.ranks[token[k:]]): rank
            for token, rank in self.ranks.items()
            for k in range(1, len(token))
            if token[:k] in self.ranks and token[k:] in self.ranks
        }
        splits = splits or {-1: 0}
        self.pairs = np.array(sorted(splits), np.int64)
        self.pieces = Pieces(self)
        self.pair_ranks = np.array([splits[x] for x in self.pairs.tolist()], np.int64)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until no pair has a rank.

        Leaf i of the tree holds (rank of the token at i with its live right
        neighbour, i) in one number, so the root names the next merge. A merge
        changes three leaves: the pair's own, its left neighbour's and the
        swallowed token's.
        """
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        get = ranks.get
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [NONE] * (2 * n)
        for i in range(n - 1):
            if (rank := get(piece[i : i + 2])) is not None:
                tree[n + i] = rank << 32 | i
        for i in range(n - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

        def put(i: int, value: int) -> None:
            i += n
            tree[i] = value
            while i > 1:
                other = tree[i ^ 1]
                if other < value:
                    value = other
                i >>= 1
                if tree[i] == value:
                    return
                tree[i] = value

        def pair(i: int, middle: int) -> int:
            if middle >= n:
                return NONE
            rank = get(piece[i : right[middle]])
            return NONE if rank is None else rank << 32 | i

        while n > 1 and (top := tree[1]) < NONE:
            i = top & 0xFFFFFFFF
            gone = right[i]
            after = right[i] = right[gone]
            if after < n:
                left[after] = i
            put(gone, NONE)
            put(i, pair(i, after))
            if (before := left[i]) >= 0:
                put(before, pair(before, i))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : right[i]]])
            i = right[i]
        return out

    def encode_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Packed ids of pieces of 1 to ``width`` bytes, a power of two; one tree a row, one merge a row at a time."""
        m = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, m)
        ids = self.byte_ids[np.frombuffer(b"".join([x.ljust(width, b"\0") for x in pieces]), np.uint8)]
        place = np.arange(m * width) % width
        row_of = np.arange(m * width) // width
        alive = place < sizes[row_of]
        right, left = place + 1, place - 1
        tree = np.full((m, 2 * width), NONE)
        at = np.flatnonzero(place < sizes[row_of] - 1)
        tree[row_of[at], width + place[at]] = self.pair_keys(ids[at], ids[at + 1], place[at])
        low = width
        while low > 1:
            tree[:, low // 2 : low] = np.minimum(tree[:, low : 2 * low : 2], tree[:, low + 1 : 2 * low : 2])
            low //= 2
        tree = tree.ravel()

        def put(rows: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
            base, node = rows * (2 * width), i + width
            tree[base + node] = value
            for _ in range(width.bit_length() - 1):
                value = np.minimum(value, tree[base + (node ^ 1)])
                node = node >> 1
                tree[base + node] = value

        rows = np.arange(m)
        while len(rows := rows[tree[rows * (2 * width) + 1] < NONE]):
            top = tree[rows * (2 * width) + 1]
            base, i = rows * width, top & 0xFFFFFFFF
            gone = right[base + i]
            after = right[base + gone]
            right[base + i] = after
            ids[base + i] = top >> 32
            alive[base + gone] = False
            put(rows, gone, np.full(len(rows), NONE))
            has = after < sizes[rows]
            left[(base + after)[has]] = i[has]
            value = np.full(len(rows), NONE)
            value[has] = self.pair_keys(ids[(base + i)[has]], ids[(base + after)[has]], i[has])
            put(rows, i, value)
            before = left[base + i]
            has = before >= 0
            b = before[has]
            put(rows[has], b, self.pair_keys(ids[base[has] + b], ids[(base + i)[has]], b))
        packed = ids[alive].astype("<u4").tobytes()
        ends = np.cumsum(np.add.reduceat(alive, np.arange(0, m * width, width), dtype=np.int64)) * 4
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def pair_keys(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Leaf values of neighbouring tokens: the rank of their union and the place of the first, or NONE."""
        pair = a << 32 | b
        found = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[found] == pair, self.pair_ranks[found] << 32 | place, NONE)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids that are packed as little-endian unsigned 32-bit integers."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


class Pieces(dict):
    """Packed ids of pieces. ``learn`` finds those of many new pieces together."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def learn(self, pieces: set[str]) -> None:
        if len(self) + len(pieces) > MEMORY:
            self.clear()
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in [x for x in pieces if x not in self]:
            raw = piece.encode()
            if (rank := self.vocabulary.ranks.get(raw)) is not None:
                self[piece] = struct.pack("<I", rank)
            elif len(raw) <= MEMORY_PIECE:
                by_width.setdefault(1 << (len(raw) - 1).bit_length(), []).append((piece, raw))
        for width, group in by_width.items():
            self.update(zip([x for x, _ in group], self.vocabulary.encode_many([x for _, x in group], width)))

    def __missing__(self, piece: str) -> bytes:
        """A long piece; it is not remembered."""
        ids = self.vocabulary.encode_piece(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, found: list[list[str]]) -> list[bytes]:
        """Packed ids of texts that are given as lists of their pieces."""
        self.learn(set().union(*found))
        return [b"".join(map(self.__getitem__, x)) for x in found]


_LOADED: dict[int, tuple[bytes, Vocabulary]] = {}


def vocabulary_of(rank_file: bytes) -> Vocabulary:
    """Parsed once in each Python worker."""
    key = hash(rank_file)
    if key not in _LOADED or _LOADED[key][0] != rank_file:
        _LOADED.clear()
        _LOADED[key] = (rank_file, Vocabulary(rank_file))
    return _LOADED[key][1]


def encode_decode(
    docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", decode: bool = True
) -> DataFrame:
    """``docs`` with ``token_ids`` (packed little-endian unsigned 32-bit) and, with ``decode``, ``decoded`` bytes.

    Columns: ``row`` (the other columns, whatever their names), ``token_ids``,
    ``n_tokens`` and ``decoded``, read back from the ids. Each match of
    ``pattern`` is encoded by itself and there are no special tokens. Null and
    empty texts have no ids. A match of any length takes n log n steps. The
    vocabulary file is read on the driver (a fixed size) and sent to the tasks.
    """
    with open(ranks_path, "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(sent.value)
        find, pieces = regex.compile(pattern).findall, vocabulary.pieces
        for batch in small_batches(batches, "text", 1 << 20):
            ids = pieces.encode([find(text) if text else [] for text in batch.column("text").to_pylist()])
            columns = {"row": batch.column("row"), "token_ids": pa.array(ids, pa.binary())}
            columns["n_tokens"] = pa.array([len(x) // 4 for x in ids], pa.int64())
            if decode:
                columns["decoded"] = pa.array([vocabulary.decode(x) for x in ids], pa.binary())
            yield pa.record_batch(list(columns.values()), list(columns))

    rest = [F.col(c) for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*rest).alias("row"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("token_ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
    if decode:
        schema = schema.add("decoded", T.BinaryType())
    return rows.mapInArrow(encode, schema)
