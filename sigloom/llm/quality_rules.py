"""Quality rules: counts within a text, and lines that many documents of one host share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .exact_dedup import squeezed
from .shared import lower_ascii, small_join, split_join, stored
from .words import small_batches, text_buffer, windows, word_hashes, word_spans

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A line is boilerplate if it is in more documents of its host than this, whatever the host's size.
LINE_DOCS = 20
#: Frequent lines of all documents together up to which they are broadcast.
BROADCAST_LINES = 1_000_000

LINES_SCHEMA = "host string, line binary, whole binary"


def normalised(line: bytes) -> bytes:
    """A line in lower case (A-Z) with its words one space apart."""
    return b" ".join(line.lower().split())


def line_hash(line: bytes) -> bytes:
    return xxhash.xxh3_128_digest(line)


def document_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, text, whole) to one row per distinct line, with the document's ``whole``."""
    for batch in batches:
        hosts, lines, wholes = [], [], []
        for host, text, whole in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if not text:
                continue
            found = {x for x in map(normalised, text.encode().split(b"\n")) if x}
            hosts += [host] * len(found)
            lines += map(line_hash, found)
            wholes += [whole] * len(found)
        yield pa.record_batch(
            [pa.array(hosts, pa.string()), pa.array(lines, pa.binary()), pa.array(wholes, pa.binary())],
            ["host", "line", "whole"],
        )


def whole_text(text: Column) -> Column:
    """One value for all copies of a text, whatever their white space and case (A-Z)."""
    return F.unhex(F.md5(lower_ascii(squeezed(text))))


def line_rows(docs: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """(host, line, whole, line_key) once for each document and line; copies of one text are one document."""
    text = F.col(text_col)
    source = docs.select(F.col(host_col).cast("string").alias("host"), text.alias("text"), whole_text(text).alias("whole"))
    # Distinct rows are folded in each task first, so a hot host or line is small by the time it is dealt out.
    rows = source.mapInArrow(document_lines, LINES_SCHEMA).distinct()
    return stored(rows.withColumn("line_key", F.concat("line", host_key(F.col("host")).cast("binary"))))


def shared_by_many(rows: DataFrame, line_docs: int) -> DataFrame:
    """(host, line, line_key) of the lines above the limit."""
    per_line = rows.groupBy("host", "line", "line_key").agg(F.count(F.lit(1)).alias("n"))
    return per_line.where(F.col("n") > line_docs).drop("n")


def frequent_lines(docs: DataFrame, text_col: str = "text", host_col: str = "source", line_docs: int = LINE_DOCS) -> DataFrame:
    """(host, lines): hashes of the normalised lines above the limit.

    Documents are counted by their whole text: copies of one document count
    once, as a line that only they share is no boilerplate; documents that
    differ in any word count each. The count alone decides, so a line stays
    frequent as its host grows. Null hosts are one host.
    """
    over = shared_by_many(line_rows(docs, text_col, host_col), line_docs)
    return over.groupBy("host").agg(F.collect_list("line").alias("lines"))


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of the base rules for each text of an Arrow column."""
    data, offsets = text_buffer(column)
    starts, ends, before = word_spans(data, offsets)
    hashes = word_hashes(data, starts, ends, lower=False)
    n_words = np.diff(before)

    def per_row(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    points = per_row((data & 0xC0) != 0x80)
    blanks = per_row(np.isin(data, np.frombuffer(SPACES, np.uint8)))
    symbols = per_row(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)))

    runs, at = windows(hashes, before, WINDOW)
    repeated = np.zeros(len(n_words), np.int64)
    for i in np.flatnonzero(np.diff(at) > 1):
        own = runs[at[i] : at[i + 1]]
        order = np.sort(own)
        again = order[1:] == order[:-1]
        if again.any():
            hit = np.flatnonzero(np.isin(own, order[1:][again]))
            edge = np.zeros(n_words[i] + 1, np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + WINDOW, -1)
            repeated[i] = int((np.cumsum(edge) > 0).sum())
    return {
        "n_words": n_words.astype(np.int64),
        "word_chars": points - blanks,
        "n_symbols": symbols,
        "n_repeat_words": repeated,
    }


def repeated_lines(lines: list[bytes]) -> int:
    """Lines with a word that equal an earlier line."""
    full = [x for x in lines if x.translate(None, SPACES)]
    return len(full) - len(set(full))


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lines) to counts, verdict and the text without its frequent lines."""
    for batch in small_batches(batches, "text"):
        texts, removed = batch.column("text"), batch.column("lines").to_pylist()
        counts = text_counts(texts)
        n, repeats = counts["n_words"], counts["n_repeat_words"]
        failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
        dup, left, cleaned = [], [], []
        for text, over, words in zip(texts.to_pylist(), removed, n.tolist()):
            lines = (text or "").encode().split(b"\n")
            dup.append(repeated_lines(lines))
            gone = set(over or ())
            if gone:
                stay = [x for x in lines if not (y := normalised(x)) or line_hash(y) not in gone]
                if len(stay) < len(lines):
                    words = sum(len(x.split()) for x in stay)
                    text = b"\n".join(stay).decode()
            left.append(words)
            cleaned.append(text)
        left_words = np.array(left, np.int64)
        out = {
            **{k: v for k, v in zip(batch.schema.names, batch.columns) if k not in ("text", "lines")},
            "n_words": counts["n_words"],
            "word_chars": counts["word_chars"],
            "n_symbols": counts["n_symbols"],
            "n_dup_lines": np.array(dup, np.int64),
            "n_repeat_words": repeats,
            "base_failed": failed,
            "words_left": left_words,
            "kept": ~failed & (left_words >= MIN_WORDS),
            "clean_text": pa.array(cleaned, pa.string()),
        }
        yield pa.record_batch([pa.array(v) if isinstance(v, np.ndarray) else v for v in out.values()], list(out))


def quality_rules(
    docs: DataFrame,
    text_col: str = "text",
    host_col: str = "source",
    line_docs: int = LINE_DOCS,
) -> DataFrame:
    """One row per document: ``row`` (its columns without the text), the counts, ``kept`` and ``clean_text``.

    A document fails the base rules with fewer than 20 words, or if more than
    30 % of its words lie in 8-word windows found twice. Lines above the
    limit for their host are removed; a document left with fewer than 20
    words is rejected. Null or empty text has no words and fails. A null host
    is a host of its own. Repeated rows are judged alike. The verdict of
    repeated lines within a text never removes them; only ``frequent_lines``
    does. No rows give no rows; other columns are carried in ``row``.
    """
    found = line_rows(docs, text_col, host_col)
    over = stored(shared_by_many(found, line_docs).select("line_key"))
    # Each document gets the frequent lines of its own, so no row carries a whole host's.
    own = small_join(found, over, "line_key", F.col("whole"), "inner")
    own = own.groupBy(text_key(F.col("host"), F.col("whole")).alias("text_key")).agg(F.collect_list("line").alias("lines"))
    own = stored(own)
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(
        F.struct(*[F.col(c) for c in rest]).alias("row"),
        F.col(text_col).alias("text"),
        text_key(F.col(host_col), whole_text(F.col(text_col))).alias("text_key"),
    )
    if (own.agg(F.sum(F.size("lines"))).first()[0] or 0) <= BROADCAST_LINES:
        rows = rows.join(F.broadcast(own), "text_key", "left")
    else:
        rows = split_join(rows, own, "text_key", rows.groupBy("text_key").agg(F.count(F.lit(1)).alias("n")), F.col("row"))
    rows = rows.select("row", "text", "lines")
    schema = T.StructType(
        [rows.schema["row"]]
        + [T.StructField(k, T.LongType()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        + [T.StructField("base_failed", T.BooleanType()), T.StructField("words_left", T.LongType())]
        + [T.StructField("kept", T.BooleanType()), T.StructField("clean_text", T.StringType())]
    )
    return rows.mapInArrow(judge, schema)


def host_key(host):
    """A join key for hosts that tells null from every text."""
    return F.concat(F.when(host.isNull(), "-").otherwise("+"), F.coalesce(host.cast("string"), F.lit("")))


def text_key(host, whole):
    """A join key for the copies of a text in one host."""
    return F.concat(whole, host_key(host).cast("binary"))
