from collections import Counter, defaultdict

import pytest

from sigloom.llm.line_dedup import ALL, LATER, keep_bitmaps, kept_lines, line_key, without_lines


def brute(rows, min_docs, drop, min_chars=1):
    """What is left of every (id, text), by reading all documents in order."""
    seen, first = defaultdict(set), {}
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    for doc, text in order:
        for line in (text or "").encode().split(b"\n"):
            key = line_key(line)
            if len(key.decode()) >= min_chars:
                seen[key].add(doc)
                first.setdefault(key, doc)
    over = {k for k, docs in seen.items() if len(docs) >= min_docs}
    out, taken = {}, set()
    for doc, text in order:
        lines = []
        for line in (text or "").split("\n"):
            key = line_key(line.encode())
            if key in over and (drop == ALL or key in taken):
                continue
            taken.add(key)
            lines.append(line)
        out[doc, text or ""] = "\n".join(lines)
    return out


def lines_of(rng, n):
    common = ["Same  Line", "same  line ", "", "  ", "\tÉtat", "état", "x"]
    return "\n".join(rng.choice(common) if rng.random() < 0.6 else f"line {rng.randint(0, 60)}" for _ in range(n))


@pytest.mark.parametrize("drop", [ALL, LATER])
@pytest.mark.parametrize("partitions", [1, 17])
def test_against_brute_force(spark, drop, partitions):
    import random

    rng = random.Random(partitions)
    rows = [(i, lines_of(rng, rng.randint(0, 12))) for i in range(300)] + [(301, None), (302, ""), (None, "x\nSame  Line")]
    rows += [rows[0], rows[1], (303, "same  line\n" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("copy", docs_col("c")).withColumn("keep", docs_col("k"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7 if partitions > 1 else 1000)
        for min_docs, min_chars in ((2, 1), (10, 1), (40, 5)):
            kept = without_lines(docs, keep_bitmaps(docs, min_docs=min_docs, min_chars=min_chars, drop=drop)).collect()
            want = brute(rows, min_docs, drop, min_chars)
            texts = {r[0]: r[1] for r in rows}
            assert Counter(r.row.doc_id for r in kept) == Counter(r[0] for r in rows)
            for r in kept:
                text = texts[r.row.doc_id]
                assert (r.kept_text or "") == want[r.row.doc_id, text or ""], (r, min_docs)
                assert r.n_lines == len((text or "").split("\n"))
                assert r.kept_text is not None or text is None
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def docs_col(name):
    from pyspark.sql import functions as F

    return F.lit(name)


def test_bitmaps_hold_no_text(spark, odd_docs, no_docs):
    maps = keep_bitmaps(odd_docs.select("doc_id", "text"), min_docs=2)
    assert maps.columns == ["doc", "copy", "n_lines", "n_dropped", "keep"]
    got = {(r.doc, r.copy): r for r in maps.collect()}
    assert len(got) == odd_docs.selectExpr("doc_id", "coalesce(text, '')").distinct().count()
    assert all(int((~kept_lines(r.keep, r.n_lines)).sum()) == r.n_dropped for r in got.values())
    kept = {r.row.doc_id: r for r in without_lines(odd_docs, maps).collect()}
    assert kept[2].kept_text == "" and kept[2].n_dropped == 1 and kept[9].n_dropped == 0
    assert kept[2].row.hash == "h" and "text" not in kept[2].row.asDict()
    assert keep_bitmaps(no_docs).count() == 0


def test_a_line_of_most_documents_is_spread(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('shared by all\nown ', id) AS text")
    kept = without_lines(docs, keep_bitmaps(docs, min_docs=10, drop=ALL))
    assert kept.where("kept_text <> concat('own ', row.doc_id) OR n_dropped <> 1").count() == 0
