import hashlib
import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sigloom.llm.mixing import poisson_mix, source_rates


def brute_counts(rows, rates, seed=17):
    out = Counter()
    for doc_id, source in rows:
        name = f"{seed}|" + ("null" if doc_id is None else str(doc_id))
        parts = max(math.ceil(rates[source] / 64), 1)
        for own in [name] if parts == 1 else [f"{name}|part|{j}" for j in range(1, parts + 1)]:
            draw = (int(hashlib.md5(own.encode()).hexdigest()[:13], 16) + 0.5) / 16**13
            rate, k = rates[source] / parts, 0
            term = total = math.exp(-rate)
            while total < draw:
                k += 1
                term *= rate / k
                total += term
            out[doc_id, source] += k
    return +out


def check(docs, **how):
    rows = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
    chars = defaultdict(int)
    for _, text, source in rows:
        chars[source] += len(text or "")
    weights, total = how.get("weights"), sum(chars.values())
    want = {s: math.sqrt(n) if weights is None else weights.get(s, 0.0) for s, n in chars.items()}
    rates = {s: want[s] / sum(want.values()) * how.get("epochs", 1.0) * total / n if n else 0.0 for s, n in chars.items()}
    mixed = poisson_mix(docs, **how)
    assert mixed.select("row.*").columns == docs.columns
    got = Counter((r.doc_id, r.source) for r in mixed.select("row.doc_id", "row.source").collect())
    assert got == brute_counts([(i, s) for i, _, s in rows], rates, how.get("seed", 17))


def test_documents_and_odd_rows(spark, odd_docs, sf):
    docs = odd_docs.unionByName(spark.read.parquet(f"{sf}/documents.parquet"), allowMissingColumns=True).select(odd_docs.columns)
    check(docs)
    check(docs, epochs=3.5, seed=4)
    check(docs, weights={"src0": 3.0, "src1": 1.0, "s1": 0.5}, epochs=2.0)


def test_expected_total(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.lit(10)).alias("text"), F.when(F.col("id") % 5 == 0, "a").otherwise("b").alias("source")
    )
    per = {r.source: r["count"] for r in poisson_mix(docs, weights={"a": 0.5, "b": 0.5}).groupBy("row.source").count().collect()}
    assert abs(per["a"] - 10_000) < 400 and abs(per["b"] - 10_000) < 400


def test_rates_above_one_part(spark):
    docs = spark.createDataFrame([(i, "abc", "a") for i in range(5)] + [(9, "x" * 6000, "b")], "doc_id long, text string, source string")
    check(docs, weights={"a": 1.0, "b": 0.2})


def test_a_rate_of_a_million(spark):
    docs = spark.createDataFrame([(1, "a", "a"), (2, "x" * 1_000_000, "b")], "doc_id long, text string, source string")
    assert abs(poisson_mix(docs, weights={"a": 1.0}).count() - 1_000_001) < 5000


def test_large_rate_does_not_underflow(spark):
    docs = spark.createDataFrame([(1, "abc", "a"), (2, "x" * 6000, "b")], "doc_id long, text string, source string")
    n = poisson_mix(docs, weights={"a": 1.0}).count()
    assert abs(n - 2001) < 300


def test_order_and_no_rows(spark, no_docs, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    keys = [r.shuffle_key for r in poisson_mix(docs).coalesce(1).collect()]
    assert len(set(keys)) == len(keys)
    assert poisson_mix(no_docs).count() == 0
    assert source_rates(no_docs, None, 0.5, 1.0, "text", "source").count() == 0


def test_only_dataframe_functions(odd_docs):
    plan = poisson_mix(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
