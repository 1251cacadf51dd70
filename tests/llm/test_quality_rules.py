from collections import Counter, defaultdict

from sigloom.llm.quality_rules import frequent_lines, line_hash, normalised, quality_rules


def brute_counts(text):
    data = (text or "").encode()
    words = data.split()
    wins = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if wins[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in data.split(b"\n") if x.split()]
    return (
        len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)), len(hit),
    )


def brute_frequent(rows, docs_limit):
    """Lines in more than ``docs_limit`` different texts of their host, white space and case aside."""
    holders = defaultdict(set)
    for host, text in rows:
        whole = b"".join((text or "").encode().lower().split())
        for x in map(normalised, (text or "").encode().split(b"\n")):
            if x:
                holders[host, x].add(whole)
    return {(host, line_hash(x)) for (host, x), texts in holders.items() if len(texts) > docs_limit}


def test_counts_and_verdicts(spark, odd_docs, sf):
    docs = odd_docs.unionByName(spark.read.parquet(f"{sf}/documents.parquet"), allowMissingColumns=True)
    docs = docs.select(odd_docs.columns)
    rows = [(r.source, r.text) for r in docs.collect()]
    over = brute_frequent(rows, 2)
    got = {(r.host, x) for r in frequent_lines(docs, line_docs=2).collect() for x in map(bytes, r.lines)}
    assert got == over and over
    judged = quality_rules(docs, line_docs=2).collect()
    assert len(judged) == len(rows)
    want = Counter()
    for host, text in rows:
        n, *rest = brute_counts(text)
        failed = n < 20 or 100 * rest[-1] > 30 * n
        stay = [x for x in (text or "").encode().split(b"\n") if (host, line_hash(normalised(x))) not in over]
        left = sum(len(x.split()) for x in stay)
        clean = b"\n".join(stay).decode() if text is not None else None
        want[(n, *rest, failed, not failed and left >= 20, clean)] += 1
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text")
    assert Counter(tuple(r[f] for f in fields) for r in judged) == want


def test_copies_of_one_document_are_no_boilerplate(spark):
    text = "alpha beta gamma delta\n" + " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(i, text, "h") for i in range(50)], "doc_id long, text string, source string")
    assert frequent_lines(docs, line_docs=5).count() == 0
    other = spark.createDataFrame([(i, f"share this\n{' '.join(f'w{i}_{k}' for k in range(30))}", "h") for i in range(50)], docs.schema)
    judged = quality_rules(other, line_docs=5).collect()
    assert all(r.kept and "share this" not in r.clean_text for r in judged)


def test_case_beyond_ascii_tells_documents_apart(spark):
    rows = [(i, f"share this\n{'É' if i % 2 else 'é'} own", "h") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert [list(map(bytes, r.lines)) for r in frequent_lines(docs, line_docs=1).collect()] == [[line_hash(b"share this")]]


def test_a_shared_line_may_be_the_longest(spark):
    shared = " ".join(f"shared{i}" for i in range(60))
    own = lambda i: " ".join(f"w{i}_{k}" for k in range(25))
    docs = spark.createDataFrame([(i, f"{shared}\n{own(i)}", "h") for i in range(50)], "doc_id long, text string, source string")
    judged = quality_rules(docs).collect()
    assert len(judged) == 50 and all(r.kept and r.clean_text == own(r.row.doc_id) for r in judged)
    short = docs.selectExpr("doc_id", "left(text, char_length(text) - 100) AS text", "source")
    assert not any(r.kept or r.base_failed for r in quality_rules(short).collect())


def test_a_line_stays_frequent_as_its_host_grows(spark):
    own = lambda i: " ".join(f"w{i}_{k}" for k in range(25))
    rows = [(i, f"share this\n{own(i)}" if i < 21 else own(i), "h") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert [list(map(bytes, r.lines)) for r in frequent_lines(docs).collect()] == [[line_hash(b"share this")]]
    assert all(r.clean_text == own(r.row.doc_id) for r in quality_rules(docs).collect())


def test_many_frequent_lines_are_dealt_out(spark, monkeypatch):
    own = lambda i: " ".join(f"w{i}_{k}" for k in range(25))
    rows = [(i % 400, f"share this\n{own(i % 400)}", None if i % 2 else "h") for i in range(1000)] + [(1000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    whole = sorted(quality_rules(docs).collect(), key=str)
    monkeypatch.setattr("sigloom.llm.quality_rules.BROADCAST_LINES", 0)
    assert sorted(quality_rules(docs).collect(), key=str) == whole and len(whole) == 1001
    assert all(r.clean_text == own(r.row.doc_id) for r in whole if r.row.doc_id < 1000)


def test_no_rows(no_docs):
    assert quality_rules(no_docs).count() == 0
