import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hoopframe.llm import token_alignment as ta
from hoopframe.llm.word_bpe import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WANT_A = Tokenizer.from_file(A)
WANT_A.encode_special_tokens = True
WANT_B = sentencepiece.SentencePieceProcessor(model_file=B)
LETTERS = byte_letters()
ODD = [
    "a", " ", "  ", "\n", " a", "a ", "a  b", "a\nb", "a\n\nb \n", "a \nb", "a\t b", "a  b", "\t", "▁x", "a▁ b", "<s> </s> <unk> <0x41>", "<|endoftext|>", "naïve 日本語 🙂 é ́", "don't 12,345", "x" * 4000, "ab " * 2000,
    "\x00a b", "a　b c", "ﬁ ½ Ａ", " \n x  \n y", "a\r\nb", "​ a",
]
LISTS = st.lists(st.integers(1, 4), min_size=1, max_size=30)


def tokens_of(text):
    """(a ids, a bytes, b ids, b bytes) as the libraries give them, or none."""
    if not text:
        return [], [], [], []
    a, b = WANT_A.encode(" " + text, add_special_tokens=False).ids, WANT_B.encode(text)
    a_bytes = [bytes(LETTERS[c] for c in WANT_A.id_to_token(i)) for i in a]
    pieces = [WANT_B.id_to_piece(i) for i in b]
    b_bytes = [bytes([int(p[3:-1], 16)]) if WANT_B.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
    raw = f" {text}".encode()
    return (a, a_bytes, b, b_bytes) if b"".join(a_bytes) == raw == b"".join(b_bytes) else ([], [], [], [])


def spans(tokens):
    out, at = [], 0
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def brute(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    made, held = [], Counter()
    for text in texts:
        a, a_bytes, b, b_bytes = tokens_of(text)
        sa, sb = spans(a_bytes), spans(b_bytes)
        links, j0 = [], 0
        for x, (s, e) in zip(a, sa):
            while j0 < len(sb) and sb[j0][1] <= s:
                j0 += 1
            j = j0
            while j < len(sb) and sb[j][0] < e:
                links.append((x, b[j]))
                j += 1
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, start = [], 0
        for cut in cuts:
            groups.append(",".join(str(x) for x, (s, _) in zip(a, sa) if start <= s < cut) + "|" + ",".join(str(x) for x, (s, _) in zip(b, sb) if start <= s < cut)) if len(a) < 3000 else None
            start = cut
        made.append((len(a), len(b), len(cuts), links, ";".join(g for g in groups if g)))
        held.update(set(links))
    best = {}
    for (a, _), n in held.items():
        best[a] = max(n, best.get(a, 0))
    return [(na, nb, ng, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if na else "") for na, nb, ng, links, g in made]


@pytest.fixture(scope="module")
def encoder():
    return ta.PairEncoder(open(A, encoding="utf-8").read(), open(B, "rb").read(), public_tokenizers.PATTERN)


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_chunks_equal_whole_texts(encoder):
    assert not encoder.crossing
    for text in ODD:
        a, _, b, _ = tokens_of(text)
        got = encoder.encode(text)
        assert (ids(got[0]), ids(got[1])) == (a, b), repr(text)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("abtheTE \n\t.,'sd12é́日▁ <>")))
def test_chunks_equal_whole_random_texts(encoder, text):
    a, _, b, _ = tokens_of(text)
    got = encoder.encode(text)
    assert (ids(got[0]), ids(got[1])) == (a, b)


@settings(max_examples=300, deadline=None)
@given(LISTS, LISTS)
def test_gallop(x, y):
    x, y = np.cumsum(x), np.cumsum(y)
    long, short = (x, y) if len(x) >= len(y) else (y, x)
    short = short[short <= long[-1]]
    place, common = ta.intersect(short, long, np.zeros(len(short), np.int64))
    assert place.tolist() == np.searchsorted(long, short).tolist()
    assert common.tolist() == np.isin(short, long).tolist()


def columns(rows):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows]


def test_alignment_equals_brute_force(spark, monkeypatch):
    texts = [t for t in ODD if len(t) < 3000] + [None, "", "the cat", "the cat", "the dog"]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, pairs string, rid int").repartition(3)
    want = brute(texts)
    for hot in (1, ta.HOT_PAIRS):  # nearly all pairs by shuffle, or all by broadcast
        monkeypatch.setattr(ta, "HOT_PAIRS", hot)
        rows = sorted(ta.token_alignment(docs, A, B, public_tokenizers.PATTERN).collect(), key=lambda r: r.doc_id)
        assert columns(rows) == want


def test_nothing_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b")] * 3 + [(None, "a b")], "doc_id long, text string")
    rows = ta.token_alignment(docs, A, B, public_tokenizers.PATTERN).collect()
    assert columns(rows) == brute(["a b"] * 4) and [r.doc_id for r in rows].count(1) == 3
    assert ta.token_alignment(docs.limit(0), A, B, public_tokenizers.PATTERN).collect() == []


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = {r.doc_id: r for r in ta.op11_token_alignment(spark, sf).collect()}
    want = brute([r.text for r in docs])
    assert len(rows) == len(docs)
    for r, w in zip(docs, want):
        got = columns([rows[r.doc_id]])[0]
        assert got[:6] == w[:6]
        if w[0] < 3000:
            assert got == w
