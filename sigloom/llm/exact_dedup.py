"""Exact duplicates by 128-bit content hash, with the bytes compared inside each hash group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .shared import split_join, stored

#: What is deleted before texts are compared.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: The packing of (length, id) into one number.
ID_RANGE = 10**20
ID_SHIFT = 10**19
NO_ID = 5 * 10**19


def squeezed(text: Column) -> Column:
    """The text without ASCII white space; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _number(value: int, digits: int) -> Column:
    return F.lit(str(value)).cast(T.DecimalType(digits, 0))


def _rank(doc_id: Column, points: Column) -> Column:
    """A number that is smaller for longer texts, then for smaller ids; a null id comes last."""
    ident = F.coalesce(doc_id.cast(T.DecimalType(20, 0)) + _number(ID_SHIFT, 20), _number(NO_ID, 20))
    return (ident - points.cast(T.DecimalType(10, 0)) * _number(ID_RANGE, 21)).cast(T.DecimalType(38, 0))


def _id_of(rank: Column) -> Column:
    low = F.pmod(rank, _number(ID_RANGE, 21))
    return F.when(low != _number(NO_ID, 20), (low - _number(ID_SHIFT, 20)).cast("bigint"))


def duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = squeezed,
    content_hash: Callable[[Column], Column] = F.md5,
    longest_first: bool = True,
) -> DataFrame:
    """One row per document: which document of its group stays.

    Documents are grouped by ``content_hash`` of the normalised text; inside a
    hash, texts are told apart by their bytes (they are part of the grouping
    key, so partial aggregation folds copies before anything is shuffled). The
    text with the most code points stays, then the smallest id; with
    ``longest_first=False`` the smallest id.

    Null text counts as empty, and all empty texts form one group. A null id
    ranks after every other; if only null ids are in a group, ``keep_id`` is
    null. Rows that repeat the id and length of the one that stays stay with
    it, as ids stand for documents. No rows give no rows. Other columns of
    ``docs`` are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    points = F.char_length(text) if longest_first else F.lit(0)
    rows = docs.select(F.col(id_col).alias("doc_id"), normalise(text).alias("body"), points.alias("points"))
    rows = rows.withColumns({"hash": F.unhex(content_hash(F.col("body"))), "rank": _rank(F.col("doc_id"), F.col("points"))})
    classes = rows.groupBy("hash", "body").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("best"))
    classes = stored(classes.select("hash", "n", "best"))

    # Light rows meet the class of their hash. Where texts share a hash, rows meet it by their bytes.
    clashes = stored(classes.groupBy("hash").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("hash"))
    light = rows.select("hash", "doc_id", "points", "rank", F.sha2("body", 256).alias("sha"))
    if clashes.isEmpty():
        met = split_join(light, classes, "hash", classes, F.struct("doc_id", "points"))
    else:
        alone = classes.join(clashes, "hash", "left_anti")
        met = split_join(light.join(clashes, "hash", "left_anti"), alone, "hash", alone, F.struct("doc_id", "points"))
        apart = rows.join(clashes, "hash", "left_semi")
        exact = apart.groupBy("hash", "body").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("best"))
        apart = apart.join(exact, ["hash", "body"])
        met = met.unionByName(apart.select("hash", "doc_id", "points", "rank", F.sha2("body", 256).alias("sha"), "n", "best"))
    return met.select(
        "doc_id",
        _id_of(F.col("best")).alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("rank") == F.col("best")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that stay, with all their columns.

    Of rows that repeat the id of the one that stays, the longest stays; of
    equally long ones a hash of the row decides.
    """
    judged = duplicate_groups(docs, id_col, text_col, **how).where("group_size > 1")
    judged = stored(judged.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), "kept"))
    normalise = how.get("normalise", squeezed)
    of = lambda table: docs[id_col].eqNullSafe(table["__id"]) & (F.sha2(normalise(docs[text_col]), 256) == table["__sha"])
    dropped = judged.where("NOT kept").drop("kept").distinct()
    ties = judged.groupBy("__id", "__sha").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).where("n > 1 AND kept")
    ties = ties.select("__id", "__sha")
    if ties.isEmpty():
        return docs.join(dropped, of(dropped), "left_anti")
    # Rows with one id and text may differ in length; the shorter ones go with the tie.
    again = stored(docs.join(ties, of(ties), "left_semi"))
    whole = F.struct(*[F.col(c) for c in again.columns])
    longest = F.char_length(F.coalesce(F.col(text_col), F.lit("")))
    order = F.struct(-longest, F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in again.columns]))
    one = again.groupBy(F.col(id_col).alias("__id"), F.sha2(normalise(F.col(text_col)), 256).alias("__sha")).agg(F.min_by(whole, order).alias("row"))
    gone = dropped.unionByName(ties).distinct()
    return docs.join(gone, of(gone), "left_anti").unionByName(one.select("row.*"))
