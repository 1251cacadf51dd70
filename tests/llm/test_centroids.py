import hashlib
import random

import numpy as np
import pytest

from sigloom.llm.centroids import Simplex, cluster_report, cluster_vectors, squared, to_integers


def brute(rows, width, clusters, rounds, scale=256, seed="2"):
    kept = [(i, x) for i, x in rows if x is not None and len(x) == width and all(c is not None and np.isfinite(c) for c in x)]
    ints = [[int(np.floor(scale * float(np.float32(c)))) for c in x] for _, x in kept]
    name = lambda i: hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()
    order = sorted(range(len(kept)), key=lambda j: (name(kept[j][0]), [float(c) for c in kept[j][1]]))
    centroids = [list(ints[j]) for j in order[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for v in ints:
            groups.setdefault(near(v)[1], []).append(v)
        for k, members in groups.items():
            centroids[k] = [sum(col) // len(members) for col in zip(*members)]
    return sorted([(i, near(v)[1], near(v)[0]) for (i, _), v in zip(kept, ints)], key=repr), centroids


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<float>, cluster int, distance double")


def test_against_brute_force(spark):
    rng = random.Random(5)
    middles = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [rng.gauss(m, 0.3) for m in rng.choice(middles)]) for i in range(400)]
    rows += [(400, [1.0] * 5), (401, None), (402, [1.0] * 5 + [None]), (403, [float("nan")] * 6), (404, [float("inf")] * 6), (405, [])]
    rows += [rows[3], (7, rows[9][1]), (None, rows[3][1]), (None, [0.0] * 6)] + [(500 + i, rows[3][1]) for i in range(50)]
    for pivots in (1, 4, 9):
        got, centroids = cluster_vectors(vectors(spark, rows), width=6, clusters=12, rounds=4, pivots=pivots)
        want, means = brute(rows, 6, 12, 4)
        assert sorted([(r.id, r.cluster, r.distance) for r in got.collect()], key=repr) == want
        assert centroids.tolist() == means


def test_report(spark):
    rows = [(i, [float(i % 3), float(i)]) for i in range(30)]
    got = cluster_report(vectors(spark, rows), width=2, clusters=4, rounds=2).collect()
    want, means = brute(rows, 2, 4, 2)
    assert sorted([(r.id, r.cluster, r.distance) for r in got], key=repr) == want
    assert {r.inertia for r in got} == {sum(d for *_, d in want)}
    for r in got:
        assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, means[r.cluster])).encode()).hexdigest()


def test_few_and_equal_vectors(spark):
    none = vectors(spark, [(1, [1.0])])
    assert cluster_report(none, width=2).count() == 0 and cluster_report(none.where("false")).count() == 0
    same = [(i, [0.5, -0.25]) for i in range(9)]
    got = cluster_report(vectors(spark, same), width=2, clusters=40).collect()
    assert len(got) == 9 and {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)}
    far = cluster_report(vectors(spark, [(1, [3e38, 0.0]), (2, [-3e38, 0.0])]), width=2, clusters=1, rounds=1).collect()
    assert {r.distance for r in far} == {2**54}


@pytest.mark.parametrize("spread", [0.001, 1.0, 500_000.0])
def test_bounds_never_lose_the_nearest(spread):
    rng = np.random.default_rng(3)
    flat = rng.normal(size=(300, 3)) @ rng.normal(size=(3, 64))
    for data in (flat, rng.normal(size=(300, 64)), np.repeat(flat[:30], 10, axis=0)):
        v = to_integers(data / np.abs(data).max() * spread, 256)
        simplex = Simplex.of(v[:40], 12)
        apexes = simplex.apexes(v)
        far = np.stack([squared(v, c) for c in v[40:80]], axis=1)
        number, best, _ = simplex.nearest(v, apexes, v[40:80])
        assert (best == far.min(axis=1)).all() and (number == far.argmin(axis=1)).all()


def test_bounds_rule_most_centroids_out():
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(40, 64))
    v = to_integers(middles[np.arange(2000) % 40] + 0.1 * rng.normal(size=(2000, 64)), 256)
    simplex = Simplex.of(v[:40], 12)
    assert len(simplex.pivots) == 12
    *_, compared = simplex.nearest(v, simplex.apexes(v), v[:40])
    assert compared < 2000 * 4
    lower, upper = simplex.bounds(simplex.apexes(v), v[:40])
    far = np.sqrt(np.stack([squared(v, c) for c in v[:40]], axis=1))
    assert (lower <= far).all() and (far <= upper).all()
