import random
from collections import defaultdict

import pytest

from sigloom.llm import jaccard_join as J
from sigloom.llm.components import components


def brute(rows, num=85, den=100, width=4):
    """Sizes and components of distinct rows (index, id, text)."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        own = {tuple(words[j : j + width]) for j in range(len(words) - width + 1)}
        sets.append(own or ({tuple(words)} if words else set()))
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in holders[x]:
                shared[j] += j > i
        for j, k in shared.items():
            if k and den * k >= num * (len(s) + len(sets[j]) - k):
                root[find(i)] = find(j)
    names = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            names[find(i)].append(doc_id)
    return sorted([(d, len(sets[i]), min(names[find(i)], default=None) if sets[i] else d) for i, (d, _) in enumerate(rows)], key=repr)


def check(docs, **how):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted([tuple(r) for r in J.jaccard_classes(docs, **how).collect()], key=repr)
    assert got == brute(rows, **how)


def test_documents_and_odd_rows(spark, odd_docs, sf):
    check(odd_docs.unionByName(spark.read.parquet(f"{sf}/documents.parquet"), allowMissingColumns=True).select(odd_docs.columns))


def test_dense_group_and_common_passage(spark, monkeypatch):
    """Near copies around the threshold, and a passage that most texts share; heavy lists in small parts and blocks."""
    for name, value in {"HEAVY_LEAST": 4, "MET": 2, "LIST_PART": 7, "PROBES": 5, "BLOCK": 4}.items():
        monkeypatch.setattr(J, name, value)
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(30)]
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join([f"q{i}_{k}" for k in range(rng.randint(5, 60))] + passage) for i in range(40)]
    texts += [" ".join(passage)] * 3 + [" ".join(passage[:28])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(docs)
    check(docs, num=7, den=10, width=2)


def test_no_rows_and_no_links(spark, no_docs):
    assert J.jaccard_classes(no_docs).count() == 0
    check(spark.createDataFrame([(1, "a b c d e"), (2, "f g h i j"), (3, None)], "doc_id long, text string"))


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, rng.randrange(101, 160)) for _ in range(40)] + [(7, 7), (200, 199), (199, 198)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    want = {i: 0 for i in range(41)} | {n: 100 for e in edges[40:80] for n in e} | {200: 198, 199: 198, 198: 198}
    assert got == want


@pytest.mark.parametrize("a, b", [(1, 3), (10, 9), (500, 430)])
def test_sketches_never_rule_out_a_link(a, b):
    import numpy as np

    rng = np.random.default_rng(a)
    x = rng.integers(0, 2**63, a).astype(np.uint64)
    y = np.concatenate((x[: min(a, b)], rng.integers(0, 2**63, max(b - a, 0)).astype(np.uint64)))
    shared = min(a, b)
    marks = [np.frombuffer(J.sketch(v), np.uint64)[None] for v in (x, y)]
    if 100 * shared >= 85 * (a + b - shared):
        assert J.may_link(*marks, np.array([a + b]), 85, 100).all()


def test_short_sets_bound_the_overlap():
    import numpy as np

    rng = np.random.default_rng(5)
    for a, b, shared in [(1, 1, 1), (1, 1, 0), (60, 70, 55), (900, 1100, 880), (5000, 5100, 4700), (3000, 200, 0), (255, 257, 120)]:
        both = rng.integers(0, 2**64, a + b - shared, np.uint64)
        x, y = np.sort(both[:a]), np.sort(both[a - shared :])
        packed = [J.short_set(v) for v in (x, y)]
        cells = [J.cells_of(v) for v in packed]
        assert [len(v) for v in cells] == [a, b] and all((np.diff(v) >= 0).all() for v in cells)
        most, least = J.shared_bounds(*cells)
        assert least <= shared <= most
    assert len(packed[0]) < 2 * a


def test_long_sets_link_by_their_cells(spark):
    """Sets of 3,000 shingles far from the threshold never travel whole; beside it they do, and the answer is exact."""
    words = [f"w{i}" for i in range(3003)]
    texts = [" ".join(words)]
    for edits in (5, 60, 62, 90):
        own = list(words)
        for k in range(edits):
            own[2 + k * (3000 // edits)] = f"e{edits}_{k}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(docs)
    sets = docs.select("text").mapInArrow(J.set_rows(4), "sid long, size long, sketch binary, cells binary")
    assert all(len(r.cells) < 2 * r.size for r in sets.collect())

    def refused(sids, n):
        raise AssertionError("whole sets were asked for")

    rows = {r.size: r.sid for r in sets.collect()}
    ids = [r.sid for r in sets.collect()]
    state = J.Join(sets, refused, 85, 100)
    pairs = spark.createDataFrame([(ids[0], ids[1]), (ids[0], ids[4])], "x long, y long")
    assert len(rows) == 1 and state.verify(pairs, 2) == 1
