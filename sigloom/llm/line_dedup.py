"""Line dedup: hashes of lines in one global order, read as a stream, to a keep bitmap per document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .shared import stored
from .words import small_batches

SPACES = b" \t\n\x0b\x0c\r"
#: What the streams give out: a line to drop, a line whose hash goes on in another task, the count of such a hash.
DROP, OPEN, EDGE = 0, 1, 2
#: Which lines of a repeated key are dropped: all of them, or all but the first by document and position.
ALL, LATER = "all", "later"


def line_key(line: bytes) -> bytes:
    """A line without ASCII white space at its ends, A-Z in lower case."""
    return line.strip(SPACES).lower()


def code_points(data: bytes) -> int:
    return len(data.decode())


def same_text(text: Column) -> Column:
    """Tells rows apart that repeat a document's id with another text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hashed_lines(min_chars: int):
    """(doc, copy, text) to one row per line whose key is long enough: its 128-bit hash in two halves and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            digests, rows, places = [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                for place, line in enumerate((text or "").encode().split(b"\n")):
                    key = line_key(line)
                    if len(key) >= min_chars and (min_chars <= 1 or code_points(key) >= min_chars):
                        digests.append(xxhash.xxh3_128_digest(key))
                        rows.append(row)
                        places.append(place)
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            take = pa.array(rows, pa.int64())
            yield pa.record_batch(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column("doc").take(take),
                 batch.column("copy").take(take), pa.array(places, pa.int32())],
                ["h1", "h2", "doc", "copy", "place"],
            )

    return run


def _changes(column: pa.Array) -> np.ndarray:
    """For every row but the first, whether its value differs from the one before; nulls are equal."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    equal = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return ~equal.to_numpy(zero_copy_only=False)


def repeated_lines(min_docs: int, drop: str):
    """One task's share of the sorted lines to the lines that go.

    A key's documents are counted as they pass. Only the lines of a key that
    has not reached ``min_docs`` yet are held, and a key inside the task is
    decided at once. The task's first and last key may go on in the tasks
    next to it: their counts come out as EDGE, and their undecided lines
    (those of fewer than ``min_docs`` documents, and the first) as OPEN.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: pa.RecordBatch | None = None  # lines of the last key, while undecided
        over = 0  # documents of the last key, once it is over the limit
        last, first_key, names, tail = None, None, None, None

        def out(rows: pa.RecordBatch, kind: np.ndarray, head: np.ndarray, docs: int = 0) -> pa.RecordBatch:
            n = rows.num_rows
            more = [pa.array(kind, pa.int8()), pa.array(head, pa.bool_()), pa.array(np.full(n, docs)), pa.array(np.full(n, part, np.int32))]
            return pa.record_batch([*rows.columns, *more], [*names, "kind", "head", "docs", "part"])

        def some(rows: pa.RecordBatch, kinds: np.ndarray, heads: np.ndarray) -> Iterator[pa.RecordBatch]:
            go = kinds >= 0
            if go.any():
                yield out(rows.filter(pa.array(go)), kinds[go], heads[go])

        def edge(row: pa.RecordBatch, docs: int) -> pa.RecordBatch:
            return out(row, np.array([EDGE]), np.array([False]), docs)

        for batch in batches:
            batch = _unrepeated(tail, batch)
            if not batch.num_rows:
                continue
            names = batch.schema.names
            if over and (h := _key(batch, 0)) != last:
                if last == first_key:
                    yield edge(tail, over)
                over = 0
            rows = batch if held is None else pa.concat_batches([held, batch])
            h1, h2 = rows.column("h1").to_numpy(), rows.column("h2").to_numpy()
            fresh = np.ones(len(h1), bool)
            fresh[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            starts = np.flatnonzero(fresh)
            new_doc = fresh.copy()
            new_doc[1:] |= _changes(rows.column("doc"))
            if over:  # the first rows go on with a key that is over the limit
                new_doc[0] = bool(_changes(pa.concat_arrays([tail.column("doc"), rows.column("doc").slice(0, 1)]))[0])
            docs = np.add.reduceat(new_doc.astype(np.int64), starts)
            sizes = np.diff(np.append(starts, len(h1)))
            heads = fresh.copy()
            if over:
                docs[0] += over
                heads[0] = False
            if first_key is None:
                first_key = _key(rows, 0)
            reached = docs >= min_docs
            begins = first_key == _key(rows, 0)  # the first key here is the task's first
            lines_over = np.repeat(reached, sizes)
            kinds = np.where(lines_over & ~(heads & (drop == LATER)), DROP, -1).astype(np.int8)
            ends_over = bool(reached[-1])
            upto = len(h1) if ends_over else int(starts[-1])
            if begins and (len(starts) > 1 or ends_over):
                mine = slice(0, int(sizes[0]))
                if not reached[0]:
                    kinds[mine] = OPEN
                elif drop == LATER and heads[0]:
                    kinds[0] = OPEN  # an earlier task may have an earlier line
                if len(starts) > 1:
                    yield edge(rows.slice(0, 1), int(docs[0]))
            # A later key's first line is the first of all: tasks hold rising keys.
            yield from some(rows.slice(0, upto), kinds[:upto], heads[:upto])
            last = _key(rows, len(h1) - 1)
            over = int(docs[-1]) if ends_over else 0
            held = None if ends_over else rows.slice(upto)
            tail = rows.slice(len(h1) - 1, 1)
        if over:
            yield edge(tail, over)
        elif held is not None:
            n = held.num_rows
            head = np.zeros(n, bool)
            head[0] = True
            yield out(held, np.full(n, OPEN, np.int8), head)
            yield edge(held.slice(0, 1), int(1 + _changes(held.column("doc")).sum()))

    return run


def _unrepeated(tail: pa.RecordBatch | None, batch: pa.RecordBatch) -> pa.RecordBatch:
    """The sorted rows without those that equal the row before; ``tail`` is the row before the first."""
    rows = batch if tail is None else pa.concat_batches([tail, batch])
    new = np.ones(rows.num_rows, bool)
    if rows.num_rows > 1:
        new[1:] = np.logical_or.reduce([_changes(c) for c in rows.columns])
    return batch.filter(pa.array(new[rows.num_rows - batch.num_rows :]))


def _key(rows: pa.RecordBatch, i: int) -> tuple[int, int]:
    return rows.column("h1")[i].as_py(), rows.column("h2")[i].as_py()


def packed(places: list[int], n_lines: int) -> bytes:
    """A zlib-compressed bitmap of ``n_lines`` bits, most significant first; a dropped line's bit is 0."""
    bits = np.ones(n_lines, np.uint8)
    bits[places] = 0
    return zlib.compress(np.packbits(bits).tobytes())


def kept_lines(bitmap: bytes, n_lines: int) -> np.ndarray:
    """The bitmap's bits as booleans."""
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places, n_lines = batch.column("places").to_pylist(), batch.column("n_lines").to_pylist()
        keep = [packed(p or [], n) for p, n in zip(places, n_lines)]
        dropped = [len(p or ()) for p in places]
        yield pa.record_batch(
            [batch.column("doc"), batch.column("copy"), batch.column("n_lines"), pa.array(dropped, pa.int64()), pa.array(keep, pa.binary())],
            ["doc", "copy", "n_lines", "n_dropped", "keep"],
        )


def keep_bitmaps(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 2,
    min_chars: int = 1,
    drop: str = LATER,
) -> DataFrame:
    """(doc, copy, n_lines, n_dropped, keep): which lines of each document stay, without any text.

    Lines are split at \\n and compared by their key: no ASCII white space at
    the ends, A-Z in lower case. Keys of at least ``min_chars`` code points in
    at least ``min_docs`` documents lose all their lines (``drop="all"``) or
    all but the first by document and position (``"later"``). ``keep`` is a
    compressed bitmap; ``kept_lines`` reads it.

    Line hashes are range-partitioned by (hash, document) and sorted by
    position within, so a line that very many documents share is spread over
    tasks; a task then reads its lines once and holds those of fewer than
    ``min_docs`` documents of one key. What crosses a task's edge is decided
    from one count per task and edge.

    Null or empty text is one empty line. Documents are counted by id, and
    null ids are one document, the first of all. Rows that repeat an id have a
    bitmap each, told apart by ``copy`` (a hash of the text); rows that repeat
    id and text are one document and share one bitmap. No rows give no rows; other columns are not read. Keys are told apart by 128
    bits of hash.
    """
    text = F.col(text_col)
    ids = docs.select(F.col(id_col).alias("doc"), same_text(text).alias("copy"), text.alias("text"))
    lengths = F.char_length("text") - F.char_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    whole = ids.select("doc", "copy", F.coalesce(lengths, F.lit(1)).cast("bigint").alias("n_lines")).distinct()
    kind = ids.schema["doc"].dataType
    line = T.StructType(
        [T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("doc", kind),
         T.StructField("copy", T.LongType()), T.StructField("place", T.IntegerType())]
    )
    lines = stored(ids.mapInArrow(hashed_lines(min_chars), line))
    ordered = lines.repartitionByRange("h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "copy", "place")
    told = T.StructType(
        [*line.fields, T.StructField("kind", T.ByteType()), T.StructField("head", T.BooleanType()),
         T.StructField("docs", T.LongType()), T.StructField("part", T.IntegerType())]
    )
    seen = stored(ordered.mapInArrow(repeated_lines(min_docs, drop), told))
    # At most two keys a task lie on an edge.
    edges = seen.where(F.col("kind") == EDGE).groupBy("h1", "h2").agg(F.sum("docs").alias("n"), F.min("part").alias("lowest"))
    edges = edges.where(F.col("n") >= min_docs)
    opened = seen.where(F.col("kind") == OPEN).join(edges, ["h1", "h2"])
    if drop == LATER:
        opened = opened.where("NOT head OR part > lowest")
    gone = seen.where(F.col("kind") == DROP).select("doc", "copy", "place").unionByName(opened.select("doc", "copy", "place"))
    places = gone.groupBy(F.col("doc").alias("__doc"), F.col("copy").alias("__copy")).agg(F.collect_set("place").alias("places"))
    met = whole.join(places, whole["doc"].eqNullSafe(places["__doc"]) & (whole["copy"] == places["__copy"]), "left")
    bitmap = T.StructType(
        [T.StructField("doc", kind), T.StructField("copy", T.LongType()), T.StructField("n_lines", T.LongType()),
         T.StructField("n_dropped", T.LongType()), T.StructField("keep", T.BinaryType())]
    )
    return met.select("doc", "copy", "n_lines", "places").mapInArrow(_pack, bitmap)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        out = []
        for text, keep, n in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist(), batch.column("n_lines").to_pylist()):
            if keep is not None and text is not None:
                text = "\n".join(line for line, stays in zip(text.split("\n"), kept_lines(keep, n)) if stays)
            out.append(text)
        rest = {k: v for k, v in zip(batch.schema.names, batch.columns) if k not in ("text", "keep")}
        yield pa.record_batch([*rest.values(), pa.array(out, pa.string())], [*rest, "kept_text"])


def without_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, n_lines, n_dropped, kept_text) for every row of ``docs``; ``row`` holds its columns without the text.

    A null text stays null. Documents whose lines all stay need no bitmap, so
    only the others' travel.
    """
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(
        F.struct(*[F.col(c) for c in rest]).alias("row"),
        F.col(text_col).alias("text"),
        F.col(id_col).alias("__id"),
        same_text(F.col(text_col)).alias("__copy"),
    )
    own = rows["__id"].eqNullSafe(bitmaps["doc"]) & (rows["__copy"] == bitmaps["copy"])
    keep = F.when(F.col("n_dropped") > 0, F.col("keep")).alias("keep")
    met = rows.join(bitmaps, own, "left").select("row", "text", "n_lines", "n_dropped", keep)
    schema = T.StructType(
        [met.schema["row"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())]
    )
    return met.mapInArrow(_cut, schema)
