"""URL filters: rules, and for the rest naive Bayes over the words that host names and paths are made of."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .shared import lower_ascii, split_join, stored
from .words import small_batches

#: Words shorter than this are looked up by themselves, longer ones by their first letters.
HEAD = 8
#: Letters of a unit whose places are looked at as one row.
PIECE = 256
RUNS = r"\p{L}+|\p{N}+"
LETTERS = regex.compile(r"\p{L}+")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for a url without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def apply_rules(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (host, path, verdict) that fits, as text, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (word, n): lower-case letter runs, summed over some megabytes of text."""

    def out(found: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    found: Counter = Counter()
    for batch in small_batches(batches, "text"):
        for text in batch.column("text").to_pylist():
            if text:
                found.update(LETTERS.findall(text.lower()))
        if len(found) > 200_000:
            yield out(found)
            found = Counter()
    yield out(found)


def viterbi(unit: str, words: dict[tuple[int, int], int], total: int) -> list[str]:
    """The most probable split of ``unit``; ``words`` has the counts of its substrings by (start, length).

    A substring that is no word costs ten times more with each character. Of
    equal splits the one whose last word is longest wins, at every end.
    """
    log_total, ten = math.log(total), math.log(10)
    ending: dict[int, list[tuple[int, int]]] = {}
    for (at, n), count in words.items():
        if count:
            ending.setdefault(at + n, []).append((n, count))
    best, back = [0.0], [0]
    # Where the best piece that is no word starts; it is the same for all ends up to the next better start.
    start, top_start = 0, -math.inf
    for end in range(1, len(unit) + 1):
        if best[end - 1] + ten * (end - 1) > top_start:
            start, top_start = end - 1, best[end - 1] + ten * (end - 1)
        n = end - start
        choices = [(best[start] + ten * (1 - n) - log_total, n)]
        choices += [(best[end - n] + math.log(count) - log_total, n) for n, count in ending.get(end, ())]
        top, size = max(choices)
        best.append(top)
        back.append(size)
    out, end = [], len(unit)
    while end:
        out.append(unit[end - back[end] : end])
        end -= back[end]
    return out[::-1]


def segment_units(total: int):
    """(unit, found: array<struct<at, len, n>>) to (unit, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column("unit").to_pylist()
            words = [
                viterbi(unit, {(x["at"], x["len"]): x["n"] for x in found or () if x["n"]}, total)
                for unit, found in zip(units, batch.column("found").to_pylist())
            ]
            yield pa.record_batch([pa.array(units, pa.string()), pa.array(words, pa.list_(pa.string()))], ["unit", "words"])

    return run


def segmented(units: DataFrame, texts: DataFrame) -> DataFrame:
    """(unit, words) for distinct units, by the unigram counts of the words of ``texts``.

    Counts come from all texts. Only words that occur inside a unit travel
    back to it, so no task needs the vocabulary. A place in a unit is looked
    at for words of HEAD letters and more only while its first 8, 16, 32, ...
    letters begin some word, so a very long unit costs a few rows a letter,
    whatever the longest word is.
    """
    counts = texts.mapInArrow(count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stored(counts.withColumn("size", F.char_length("word")))
    seen = counts.agg(F.sum("n").alias("n"), F.max("size").alias("longest")).first()
    total, longest = seen["n"] or 1, seen["longest"] or 1
    units = stored(units.select("unit", F.unhex(F.md5("unit")).alias("uid")))
    # Places come from short pieces of a unit, so that none of their rows carries the whole of a long one.
    pieces = units.select("uid", "unit", F.explode(F.sequence(F.lit(0), F.char_length("unit") - 1, F.lit(PIECE))).alias("from"))
    pieces = pieces.select("uid", "from", F.substr("unit", F.col("from") + 1, F.lit(PIECE + 2 * HEAD)).alias("unit"))
    inside = F.sequence(F.lit(0), F.least(F.lit(PIECE), F.char_length("unit")) - 1)
    places = pieces.select("uid", "from", "unit", F.explode(inside).alias("place"))
    near = places.select("uid", (F.col("from") + F.col("place")).alias("at"), F.substr("unit", F.col("place") + 1, F.lit(2 * HEAD - 1)).alias("text"))
    spans = near.select("uid", "at", "text", F.explode(F.sequence(F.lit(1), F.least(F.lit(HEAD - 1), F.char_length("text")))).alias("len"))
    spans = spans.select("uid", "at", "len", F.substr("text", F.lit(1), F.col("len")).alias("word"))
    uses = spans.groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    met = [split_join(spans, counts.where(F.col("size") < HEAD).drop("size"), "word", uses.withColumnRenamed("uses", "n"), F.struct("uid", "at"), "inner").select("uid", "at", "len", "n")]
    size = HEAD
    while size <= longest:
        head = lambda text: F.xxhash64(F.substring(text, 1, size))
        own = F.when(F.col("size") < 2 * size, F.struct("word", "size", "n"))
        heads = counts.where(F.col("size") >= size).groupBy(head("word").alias("head")).agg(F.collect_list(own).alias("words"))
        rows = near.where(F.char_length("text") >= size).withColumn("head", head("text"))
        uses = rows.groupBy("head").agg(F.count(F.lit(1)).alias("n"))
        rows = stored(split_join(rows, heads, "head", uses, F.struct("uid", "at"), "inner"))
        if rows.isEmpty():
            break
        words = rows.select("uid", "at", "text", F.inline("words")).where(F.startswith("text", "word"))
        met.append(words.select("uid", "at", F.col("size").alias("len"), "n"))
        size *= 2
        near = rows.select("uid", "at").join(units, "uid").select("uid", "at", F.substr("unit", F.col("at") + 1, F.lit(2 * size - 1)).alias("text"))
    found = reduce(DataFrame.unionByName, met).groupBy("uid").agg(F.collect_list(F.struct("at", "len", "n")).alias("found"))
    return units.join(found, "uid", "left").select("unit", "found").mapInArrow(segment_units(total), "unit string, words array<string>")


def judge_urls(
    pages: DataFrame, texts: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", text_col: str = "text"
) -> DataFrame:
    """``row`` (the columns of ``pages``), host, path, rule, verdict and score.

    ``rules`` decide the urls that they fit, and those urls are the examples
    from which a multinomial naive Bayes learns its token counts (all of them,
    weighted by their pages, with one added to each count). Tokens are the
    words of the segmented letter runs of the host and its digit runs, and the
    letter and digit runs of the path. A url that no rule fits is blocked if
    its log odds are above 0; a tie allows. Null urls, and urls without
    ``://``, have no tokens and follow the classes' shares.

    Work is done per distinct url and host, whatever their length; repeated rows are judged alike. No
    rows give no rows. Without texts every letter run is its own word.
    """
    key = F.coalesce(F.col(url_col), F.lit(""))
    urls = pages.groupBy(key.alias("url")).agg(F.count(F.lit(1)).alias("n"))
    host, path = url_parts(F.col("url"))
    urls = urls.select("url", "n", host.alias("host"), path.alias("path"))
    rule, verdict = apply_rules(F.col("host"), F.col("path"), rules)
    urls = stored(urls.withColumns({"rule": rule, "stated": verdict}))

    weight = lambda v: F.sum(F.when(F.col("stated") == v, F.col("n")).otherwise(0))
    votes = [weight("allow").alias("allow"), weight("block").alias("block")]
    hosts = stored(urls.groupBy("host").agg(*votes, F.count(F.lit(1)).alias("urls")))
    runs = hosts.select("host", F.explode(F.regexp_extract_all(F.lower("host"), F.lit(RUNS), F.lit(0))).alias("unit"))
    named = F.regexp_like(F.col("unit"), F.lit(r"^\p{L}"))
    units = stored(runs.where(named).groupBy("unit").agg(F.count(F.lit(1)).alias("n")))
    words = stored(segmented(units.select("unit"), texts.select(F.col(text_col).alias("text"))))
    split = split_join(runs.where(named), words, "unit", units, F.col("host"), "inner")
    host_tokens = split.select("host", F.explode("words").alias("token")).union(runs.where(~named))
    host_tokens = stored(host_tokens.groupBy("host", F.concat(F.lit("host "), F.col("token")).alias("token")).agg(F.count(F.lit(1)).alias("times")))
    path_tokens = urls.select("url", "n", "stated", F.explode(F.regexp_extract_all(F.lower("path"), F.lit(RUNS), F.lit(0))).alias("token"))
    path_tokens = path_tokens.groupBy("url", "n", "stated", F.concat(F.lit("path "), F.col("token")).alias("token")).agg(F.count(F.lit(1)).alias("times"))
    path_tokens = stored(path_tokens)

    from_hosts = host_tokens.join(hosts, "host").select("token", *[(F.col(v) * F.col("times")).alias(v) for v in ("allow", "block")])
    from_paths = path_tokens.select(
        "token", *[F.when(F.col("stated") == v, F.col("n") * F.col("times")).otherwise(0).alias(v) for v in ("allow", "block")]
    )
    model = from_hosts.union(from_paths).groupBy("token").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    model = stored(model)
    seen = model.agg(F.sum("allow"), F.sum("block"), F.count(F.lit(1))).first()
    examples = hosts.agg(F.sum("allow"), F.sum("block")).first()
    allow_all, block_all = ((seen[i] or 0) + seen[2] for i in (0, 1))
    prior = math.log(((examples[1] or 0) + 1) / ((examples[0] or 0) + 1))
    odds = F.log((F.col("block") + 1) / F.lit(float(block_all or 1))) - F.log((F.col("allow") + 1) / F.lit(float(allow_all or 1)))
    model = model.select("token", F.round(odds, 12).alias("odds"))

    def scored(tokens: DataFrame, by: str) -> DataFrame:
        uses = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        met = split_join(tokens.select(by, "token", "times"), model, "token", uses, F.col(by), "inner")
        return met.groupBy(by).agg(F.sum(F.col("odds").cast("decimal(20,12)") * F.col("times")).cast("double").alias(f"{by}_score"))

    of_host = scored(host_tokens, "host")
    whole = split_join(urls, of_host, "host", hosts.select("host", F.col("urls").alias("n")), F.col("url"))
    whole = whole.join(scored(path_tokens.where("stated IS NULL"), "url"), "url", "left")
    score = F.coalesce("host_score", F.lit(0.0)) + F.coalesce("url_score", F.lit(0.0)) + F.lit(prior)
    guess = F.when(score > 0, "block").otherwise("allow")
    whole = whole.select(
        "url", "n", "host", "path", "rule", F.coalesce("stated", guess).alias("verdict"), F.when(F.col("stated").isNull(), score).alias("score")
    )
    whole = stored(whole)
    rows = pages.select(F.struct(*[F.col(c) for c in pages.columns]).alias("row"), key.alias("url"))
    judged = split_join(rows, whole.drop("n"), "url", whole.select("url", "n"), F.monotonically_increasing_id(), "left")
    return judged.select("row", "host", "path", "rule", "verdict", "score")
