import random

import numpy as np
import pyarrow as pa
import pytest

from sigloom.llm import words as W


@pytest.mark.parametrize("segment", [4, 16, 1 << 20])
def test_shingle_sets(monkeypatch, segment):
    monkeypatch.setattr(W, "SEGMENT", segment)
    W._TABLES.clear()
    rng = random.Random(segment)
    for _ in range(60):
        texts = [
            None if rng.random() < 0.1 else "".join(rng.choice("aB é\n\t\x0b x") for _ in range(rng.randint(0, 40)))
            for _ in range(rng.randint(0, 12))
        ]
        width = rng.choice([1, 2, 4])
        runs, at = W.shingle_sets(pa.array(texts, pa.string()), width)
        seen = {}
        for i, text in enumerate(texts):
            words = (text or "").encode().lower().split()
            own = {tuple(words[j : j + width]) for j in range(len(words) - width + 1)}
            own = own or ({tuple(words)} if words else set())
            got = tuple(runs[at[i] : at[i + 1]].tolist())
            assert len(got) == len(own)
            assert seen.setdefault(frozenset(own), got) == got
        assert len(set(seen.values())) == len(seen)
    W._TABLES.clear()


def test_small_batches_keep_rows():
    batch = pa.record_batch([pa.array(["a" * 10, None, "b" * 100, "", "c"])], ["text"])
    parts = list(W.small_batches([batch], "text", 12))
    assert [x for p in parts for x in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert len(parts) > 1
    assert np.all([p.num_rows for p in parts])
