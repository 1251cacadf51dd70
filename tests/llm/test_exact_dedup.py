from collections import defaultdict

from pyspark.sql import functions as F

from sigloom.llm.exact_dedup import duplicate_groups, exact_dedup

BLANKS = str.maketrans("", "", " \t\n\x0b\x0c\r")


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        text = text or ""
        groups[text.translate(BLANKS)].append((-len(text), i is None, i or 0, i))
    out = []
    for members in groups.values():
        best = min(members)
        out += [(m[3], best[3], len(members), m[:3] == best[:3]) for m in members]
    return sorted(out, key=repr)


def found(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()], key=repr)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_odd_rows(odd_docs):
    assert found(duplicate_groups(odd_docs)) == brute(pairs(odd_docs))


def test_hash_collisions_are_told_apart_by_bytes(odd_docs):
    weak = duplicate_groups(odd_docs, content_hash=lambda c: F.lpad(F.hex(F.char_length(c) % 2), 2, "0"))
    assert found(weak) == brute(pairs(odd_docs))


def test_smallest_id(spark):
    docs = spark.createDataFrame([(2, "a b"), (1, "ab"), (3, "a  b")], "doc_id long, text string")
    got = duplicate_groups(docs, longest_first=False).collect()
    assert {r.keep_id for r in got} == {1}


def test_documents_that_stay(odd_docs, no_docs):
    kept = exact_dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    want = sorted([i for i, k, _, ok in brute(pairs(odd_docs)) if ok], key=repr)
    assert sorted([r.doc_id for r in kept.collect()], key=repr) == want
    assert duplicate_groups(no_docs).count() == 0 and exact_dedup(no_docs).count() == 0


def test_one_of_repeated_rows_stays(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (1, "a b", "y"), (2, "a b", "x"), (3, "c d", "x"), (3, "c  d", "x"), (None, "e", "x"), (None, "e", "x"), (4, "f", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = exact_dedup(docs).collect()
    assert sorted([(r.doc_id, r.text) for r in kept], key=repr) == [(1, "a b"), (3, "c  d"), (4, "f"), (None, "e")]
