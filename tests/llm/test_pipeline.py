from collections import Counter

import corpus_pipeline
from test_exact_dedup import brute as exact_brute
from test_jaccard_join import brute as near_brute

from sigloom.llm import queries
from sigloom.llm.shared import hot_keys, split_join, stored


def test_every_stage(spark, odd_docs, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = odd_docs.select((odd_docs["doc_id"] + 100_000).alias("doc_id"), "text", "source")  # ids stand for documents
    docs = stored(docs.unionByName(odd, allowMissingColumns=True))
    names = docs.columns
    before = {}
    for name, stage in corpus_pipeline.STAGES:
        before[name] = docs.select("doc_id", "text").collect()
        docs = stored(stage(spark, docs, sf))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
    rows = lambda k: [(r.doc_id, r.text) for r in before[k]]
    ids = lambda k: Counter(r.doc_id for r in before[k])
    assert ids("exact dedup") and all(len(t.split()) >= 20 for _, t in rows("exact dedup"))
    assert ids("n-gram Jaccard join") == Counter(i for i, _, _, kept in exact_brute(rows("exact dedup")) if kept)
    near = near_brute(rows("n-gram Jaccard join"), num=80, den=100, width=5)
    assert ids("mixing sources") == Counter(i for i, _, c in near if i is None or i == c)
    assert set(ids("byte-level BPE")) <= set(ids("mixing sources"))
    out = docs.collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows("byte-level BPE"))
    assert all(r.n_tokens * 4 == len(r.token_ids) for r in out)


def test_near_copies_by_five_words(spark, sf):
    words = [f"w{i}" for i in range(400)]
    edited = [f"new{i}" if i % 47 == 23 else w for i, w in enumerate(words)]
    docs = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(f"v{i}" for i in range(400)))]
    grams = lambda text, n: set(zip(*(text.split()[i:] for i in range(n))))
    share = lambda n: len(grams(docs[0][1], n) & grams(docs[1][1], n)) / len(grams(docs[0][1], n) | grams(docs[1][1], n))
    assert share(5) >= 0.8 and share(4) < 0.85
    left = corpus_pipeline.near(spark, spark.createDataFrame(docs, "doc_id long, text string"), sf).collect()
    assert {r.doc_id for r in left} == {1, 3}


def test_run_and_registration(spark, sf):
    import __spark_entry__ as entry

    registered = entry.queries()
    assert {k.split("_")[0] for k in registered if k in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert registered["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_hot_keys_are_split(spark):
    rows = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, -1, id) AS k")
    counts = rows.groupBy("k").count().withColumnRenamed("count", "n")
    assert {r.k for r in hot_keys(counts, "k").collect()} == {-1}
    names = counts.selectExpr("k", "k * 2 AS v")
    got = split_join(rows, names, "k", counts, rows["id"]).collect()
    assert len(got) == 3000 and all(r.v == 2 * r.k for r in got)
    assert hot_keys(counts.where("k >= 0"), "k") is None
