import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from sigloom.llm import prefix_trie as P
from sigloom.llm.shared import stored

TURNS = "conv_id long, turn long, role string, text string, node string, depth int"
ID = lambda t: hashlib.md5(f"{len(t[0])}:{t[0]}{t[1]}".encode()).hexdigest()


def sequences(rows):
    talks = defaultdict(list)
    for conv, turn, role, text in rows:
        pair = (role or "", text or "")
        talks[conv].append(((turn is not None, turn or 0), ID(pair), pair))
    return {c: [pair for *_, pair in sorted(t)] for c, t in talks.items()}


def rebuilt(talks):
    out = {}
    for c, own in talks.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 6
        out[c] = (talks.get(c - int(math.fmod(c, 100)), [])[:h] if c is not None else []) + own[h:]
    return out


def brute(talks):
    """Every node by walking the trie."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in talks.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    low = lambda ids: min((i for i in ids if i is not None), default=None)

    out = []
    for node in members:
        leaves, saved, todo = 0, 0, [node]
        while todo:
            n = todo.pop()
            leaves += n not in children
            saved += (len(members[n]) - 1) * (len(n[-1][1]) if n else 0)
            todo += children.get(n, [])
        ids = ",".join("null" if i is None else str(i) for i in sorted(ends.get(node, []), key=lambda i: (i is not None, i or 0)))
        out.append((low(members[node]), len(node), low(members[node[:-1]]) if node else None, len(members[node]),
                    len(children.get(node, [])), leaves, saved, hashlib.sha256(ids.encode()).hexdigest()))
    return Counter(out)


def found(trie):
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert list(trie.columns) == list(names)
    return Counter(tuple(r[n] for n in names) for r in trie.collect())


def made(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 30), *range(100, 140), *range(205, 230), 1000, 1001, -7, None]:
        for turn in range(rng.randint(1, 4)):
            rows.append((c, turn if rng.random() < 0.9 else None, rng.choice(["user", None]), rng.choice(["a", "bé", "", None, "ccc"])))
    rows += [(c, t, "user", f"turn {t}") for c in (300, 301, 302) for t in range(45 + c % 3)]  # over several blocks
    rows += [(400 + c, t, "user", "same") for c in range(60) for t in range(17)]  # copies
    return rows + rows[:5]


@pytest.mark.parametrize("block", [3, 8])
def test_against_brute_force(spark, block):
    rows = made(block)
    turns = spark.createDataFrame([(*r, "n", 1) for r in rows], TURNS)
    numbered = stored(P.numbered_turns(turns))
    talks = sequences(rows)
    assert found(P.prefix_trie(P.shared_openings(numbered), block)) == brute(rebuilt(talks))
    if block == 8:
        assert found(P.prefix_trie(P.plain_talks(numbered))) == brute(talks)


def test_turnless_conversations_and_no_rows(spark):
    # 1207 takes more than one turn from a conversation that is not there.
    lone = next(c for c in range(1201, 1300) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(lone, 0, "user", "x"), (5, 0, None, None)]
    turns = spark.createDataFrame([(*r, "n", 1) for r in rows], TURNS)
    got = found(P.prefix_trie(P.shared_openings(stored(P.numbered_turns(turns)))))
    assert got == brute(rebuilt(sequences(rows)))
    assert sum(got.values()) <= 2
    assert P.prefix_trie(P.shared_openings(stored(P.numbered_turns(turns.where("false"))))).count() == 0


def test_ends_of_one_node_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 64)
    ends = spark.range(3000).selectExpr("unhex(IF(id % 3 = 0, 'aa', lpad(hex(id % 40), 2, '0'))) AS node", "id - 1000 AS conv_id")
    want = defaultdict(list)
    for r in ends.collect():
        want[bytes(r.node)].append(r.conv_id)
    got = {bytes(r.node): r.ends_sha256 for r in P.end_hashes(ends.repartition(7)).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}


def test_one_rollup_serves_all_blocks(spark):
    turns = spark.createDataFrame([(1, t, "user", str(t), "n", 1) for t in range(100)], TURNS)
    blocks, _ = P.column_blocks(P.plain_talks(stored(P.numbered_turns(turns))))
    plan = P.prefix_rollup(blocks, {"n": "count(*)"})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand ") == 1
