import random

import public_tokenizers
from tokenizers import Tokenizer, models

from sigloom.llm.token_counts import BLANK, Unigram, sentencepiece_pieces, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def known(pieces):
    low = min(s for _, s in pieces)
    table = [("<unk>", low)] + [(f"<0x{i:02X}>", low) for i in range(256)] + pieces
    model = Tokenizer(models.Unigram(table, 0, True))
    return lambda text: len(model.encode(BLANK + text.replace(" ", BLANK), add_special_tokens=False).ids) if text else 0


def test_ties_and_unknown_characters():
    rng = random.Random(7)
    for trial in range(150):
        names = sorted({"".join(rng.choice("abc▁é") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 14))})
        if trial % 3 == 0:
            names = sorted({*names, *"abcé▁"})
        pieces = [(x, float(-rng.randint(1, 6)) if trial % 2 else -5 * rng.random()) for x in names]
        model, count = Unigram(pieces), known(pieces)
        texts = ["".join(rng.choice(["a", "b", "ab", " ", "  ", "\n", "é", "日", "😀", "c"]) for _ in range(rng.randint(0, 25))) for _ in range(12)]
        assert model.count_texts(texts) == [count(t) for t in texts]
        assert [model.count(BLANK + t.replace(" ", BLANK)) if t else 0 for t in texts] == [count(t) for t in texts]


def test_documents(spark, odd_docs, sf):
    docs = odd_docs.unionByName(spark.read.parquet(f"{sf}/documents.parquet"), allowMissingColumns=True)
    pieces = sentencepiece_pieces(PATH)
    count = known(pieces)
    want = sorted([(r.doc_id, count(r.text or ""), len(r.text or "")) for r in docs.collect()], key=repr)
    assert sorted([tuple(r) for r in token_counts(docs, pieces).collect()], key=repr) == want


def test_no_rows_and_no_pieces(no_docs, odd_docs):
    assert token_counts(no_docs, [("a", -1.0)]).count() == 0
    assert Unigram([]).count_texts(["ab é", "", None]) == [len(f"{BLANK}ab{BLANK}é".encode()), 0, 0]
