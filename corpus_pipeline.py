"""From raw documents to a mixed, tokenised training corpus: five stages, each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sigloom.llm.byte_bpe import encode_decode
from sigloom.llm.exact_dedup import exact_dedup
from sigloom.llm.jaccard_join import jaccard_classes
from sigloom.llm.mixing import poisson_mix
from sigloom.llm.quality_rules import quality_rules
from sigloom.llm.shared import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that many documents of their source share.

    Null and empty texts have no words and go, as do texts left with fewer than 20 words. Texts of any length are read whole.
    Repeated rows are judged alike; a null source is a source of its own. No rows give no rows. Other columns are carried.
    """
    judged = quality_rules(docs).where("kept")
    clean = {"text": F.col("clean_text"), "n_chars": F.char_length("clean_text").cast("bigint")}
    return judged.select(*[clean.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal text: the longest, then the smallest id; null ids last.

    All empty texts are one group, with null among them. Of rows that repeat the id that stays, one stays. No rows give no
    rows; other columns neither decide nor change.
    """
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group that Jaccard links (five words, 0.8) hold together.

    Ids stand for documents; a null id is never dropped. Null and empty texts link with nothing and stay. Texts of any length
    are compared whole; repeated rows are equal sets. No rows give no rows; other columns are not read.
    """
    copies = jaccard_classes(docs, num=80, den=100, width=5).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target weight asks for, in shuffled order.

    A document may go or come several times. Null sources are one source, null ids share one variate, as repeated rows do;
    null text has no characters. No rows give no rows; all columns are carried.
    """
    return poisson_mix(docs).select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (packed little-endian unsigned 32-bit), and the text as decoded from them.

    A null or empty text has no tokens and decodes to the empty text. Texts of any length are encoded whole; repeated rows
    alike. No rows give no rows; other columns are carried.
    """
    coded = encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("row.*", "token_ids", "n_tokens", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("mixing sources", mix),
    ("byte-level BPE", tokens),
]

#: SQL cannot say the last stage; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written and read again; an empty table stays empty."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
