import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablechange.llm.bpe import PairIndexBPE, bpe_decode, bpe_encode
from tablechange.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "The quick Brown fox's tail, isn't it?", "", "   ", None, "a\x1cb a\x85b", "ΑΣ ΣΑΣ", "İstanbul 'LL", "x<|endoftext|>y <|ENDOFTEXT|>",
    "é é ́", "ﬁ ½ ²³ ٣", "日本語 テスト 😀", "a" * 5000, "aaaa aaaaa " * 400, "tab\tnew\nline　wide", "<|startoftext|><|endoftext|>", "x <", "same", "same",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_same_as_the_library(make, library):
    got = {r["doc_id"]: r for r in bpe_encode(make(list(enumerate(TEXTS)), extra=True), PATH, decoded_col="decoded").collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert got[i]["ids"] == want
        assert got[i]["decoded"] == library.decode(want, skip_special_tokens=False)
        assert got[i]["tokens"] == text  # a clashing column stays


def test_decode_and_empty_table(spark, make):
    tokens = bpe_encode(make([(1, "hello world"), (2, None)]), PATH)
    assert {r["doc_id"]: r["decoded"] for r in bpe_decode(tokens, PATH).collect()} == {1: "hello</w> world</w>", 2: ""}
    assert bpe_decode(tokens.select("doc_id", "ids").union(spark.sql("SELECT 3L, cast(null AS array<int>)")), PATH).filter("doc_id = 3").first()["decoded"] == ""
    assert bpe_encode(make([]), PATH).count() == 0


def test_words_merge_alike_alone_and_together():
    bpe = PairIndexBPE(open(PATH, encoding="utf-8").read())
    words = ["internationalisation", "th", "a", "ththth", "banana", "aaaaaaa"]
    assert bpe.encode_words(words) == [bpe.encode_words([w])[0] for w in words]
    assert bpe.encode_words([]) == []


def test_query(spark, sf, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op8_bpe_round_trip"](spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
