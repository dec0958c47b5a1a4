import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from hoopframe.llm import byte_bpe
from hoopframe.llm.bloom import without_ids
from hoopframe.llm.exact_dedup import exact_dedup

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = ["a", "a", None, "", "A", "x" * 20_000, "a\nb", "naïve 日本 🙂", " two  spaces ", "a", "12345 don't"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "keep", i) for i, t in enumerate(TEXTS)] + [(None, "a", "keep", 0), (3, "", "keep", 1), (3, "", "keep", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, group_size long")


def test_exact_dedup(docs):
    got = exact_dedup(docs).collect()
    assert len(got) == docs.count()
    ids = {}
    for r in docs.collect():
        ids.setdefault(r.text or "", []).append(r.doc_id)
    for r in got:
        text = next(t for t in ids if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(ids[text])
        assert r.keep_id == max((i for i in ids[text] if i is not None), default=None)
    kept = [r.text_sha256 for r in got if r.kept]
    assert sorted(kept) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in ids)  # exactly one of each, repeated rows too


def test_exact_dedup_of_nothing_and_of_a_hot_group(spark, docs):
    assert exact_dedup(docs.limit(0)).collect() == []
    hot = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same', cast(id as string)) as text")
    got = exact_dedup(hot).where("group_size > 1").collect()
    assert len(got) == 1000 and {r.keep_id for r in got} == {2997} and sum(r.kept for r in got) == 1


def test_without_ids(spark, docs):
    gone = spark.createDataFrame([(1,), (3,), (99,), (None,)], "doc_id long")
    left = sorted((r.doc_id for r in without_ids(docs, gone, "doc_id").collect()), key=str)
    assert left == sorted([i for i in range(len(TEXTS)) if i not in (1, 3)] + [None], key=str)


def test_bpe_equals_tiktoken_and_comes_back(docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = byte_bpe.decode_ids(byte_bpe.encode_texts(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    for r in rows:
        assert np.frombuffer(r.token_ids, "<u4").tolist() == want.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
        assert r.kept == "keep"


def test_bpe_of_nothing(docs):
    assert byte_bpe.encode_texts(docs.limit(0), PATH, public_tokenizers.PATTERN).collect() == []


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(5000)]
    table = byte_bpe.PerfectHash(keys)
    assert sorted(table.order.tolist()) == list(range(5000))
    assert table.lookup(keys).tolist() == list(range(5000))


def test_merges_of_long_pieces():
    tokens = byte_bpe.load_ranks(PATH)
    ranks = {t: i for i, t in enumerate(tokens)}
    piece = b"ab" * 20_000
    assert b"".join(tokens[i] for i in byte_bpe.merge_bytes(piece, ranks)) == piece
