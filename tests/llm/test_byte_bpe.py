import random
import struct

import public_tokenizers
import pytest
import tiktoken

from sigloom.llm.byte_bpe import Vocabulary, encode_decode

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = ["a", "the", " ", "  ", "\n", "é", "ß", "1", "23", "'s", "'", "!", "???", "日本", "😀", "\t", "ing", "tion", "xyzzy"]


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as file:
        return Vocabulary(file.read())


@pytest.fixture(scope="module")
def known(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def unpack(ids):
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))


def test_both_trees_agree_with_the_library(vocabulary, known):
    rng = random.Random(5)
    for _ in range(200):
        raw = "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 9))).encode()[:64]
        want = known._encode_single_piece(raw)
        assert vocabulary.encode_piece(raw) == want
        if raw not in vocabulary.ranks:
            assert unpack(vocabulary.encode_many([raw], 64)[0]) == want


def test_documents(spark, odd_docs, sf, known):
    docs = odd_docs.unionByName(spark.read.parquet(f"{sf}/documents.parquet"), allowMissingColumns=True).select(odd_docs.columns)
    extra = spark.createDataFrame([(99, " " * 3000 + "ab" * 5000)], "doc_id long, text string")
    docs = docs.unionByName(extra, allowMissingColumns=True)
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    got = encode_decode(docs, PATH, public_tokenizers.PATTERN).collect()
    key = lambda x: repr(x)
    want = sorted(((i, known.encode_ordinary(t or ""), (t or "").encode()) for i, t in texts), key=key)
    assert sorted(((r.row.doc_id, unpack(r.token_ids), bytes(r.decoded)) for r in got), key=key) == want
    assert all(r.n_tokens == len(r.token_ids) // 4 for r in got)


def test_no_rows(no_docs):
    assert encode_decode(no_docs, PATH, public_tokenizers.PATTERN).count() == 0
