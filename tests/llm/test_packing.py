import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hoopframe.llm import packing, word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
DEFINITION = open(PATH, encoding="utf-8").read()
WANT = Tokenizer.from_str(DEFINITION)
ODD = [
    "", " ", "\n", "Don't STOP, it's 1234", "a\tb\x0bc\x1cd e f", "ÀÉ naïve ΣΊΣΥΦΟΣ İstanbul ﬁ", "é ́x", "日本 🙂 ok", "<|startoftext|> x<|endoftext|>y", "a  b\n\nc ",
    "'S 'Ll we'RE", "x" * 5000, "_a_b 1_2 ``~~", "\x00 \x7f a\x01b", "KK İi", "'ſ", "ab'd'dd", "ÉÈ ñandú straße ÿŸ æÆ 2² ½ ªº ÷×",
]


def whole(text):
    return WANT.encode(text or "", add_special_tokens=False).ids


def test_words_equal_whole_texts():
    encoder = word_bpe.WordEncoder(DEFINITION)
    assert encoder.by_word
    for t in ODD + pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist():
        assert encoder.encode(t or "").tolist() == whole(t), t


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aAbB'sStT \n\t.,!<|>endoftxk12é́ßΣ _-")))
def test_words_equal_whole_random_texts(text):
    assert word_bpe.word_encoder(DEFINITION).encode(text).tolist() == whole(text)


def test_segments(monkeypatch):
    monkeypatch.setattr(word_bpe, "SEGMENT", 7)
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab \n") for _ in range(rng.randrange(60)))
        assert "".join(word_bpe.segments(text)) == text
        assert word_bpe.word_encoder(DEFINITION).encode(text).tolist() == whole(text)


def test_another_tokenizer_gets_whole_texts():
    definition = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    encoder = word_bpe.WordEncoder(definition)
    assert not encoder.by_word
    assert encoder.encode("two words\n x").tolist() == Tokenizer.from_str(definition).encode("two words\n x").ids


def naive(lengths, rooms):
    waiting, cost, used, out = [(n, -k, 0) for k, n in enumerate(lengths) if n], [0.0] * len(rooms), [0] * len(rooms), []
    while waiting and any(u < r for u, r in zip(used, rooms)):
        n, k, start = longest = max(waiting, key=lambda x: (x[0], x[1], -x[2]))
        waiting.remove(longest)
        s = min((s for s in range(len(rooms)) if used[s] < rooms[s]), key=lambda s: (cost[s], used[s] - rooms[s], s))
        take = min(n, rooms[s] - used[s])
        out.append((-k, start, take, s, used[s]))
        used[s] += take
        cost[s] += packing.LINEAR * take + packing.QUADRATIC * take * take
        if take < n:
            waiting.append((n - take, k, start + take))
    return out, waiting


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=25), st.lists(st.integers(0, 32), max_size=12))
def test_assign_equals_naive(lengths, rooms):
    pieces, rest = packing.assign(lengths, rooms)
    want, waiting = naive(lengths, rooms)
    assert pieces == want and sorted(rest) == sorted((-k, s) for _, k, s in waiting)


def test_powers():
    assert [sum(packing.powers(n)) for n in range(300)] == list(range(300))
    assert packing.powers(11) == [8, 2, 1] and packing.powers(0) == []


def check(rows, docs, capacity):
    """Every id in one piece, no gaps, no padding. docs: (doc_id, text) rows."""
    ids = {i: whole(t) + [1] for i, t in docs}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i]) and r.length > 0
            assert np.frombuffer(r.token_ids, "<u4").tolist() == ids[i][at : at + r.length]
            at += r.length
        assert at == len(ids[i])
    sizes = []
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and at & (at - 1) == 0
        sizes.append(at)
    return sizes


def test_pack(spark):
    docs = list(enumerate([t for t in ODD] + [None, "word " * 700]))
    docs.append((None, "no id"))
    df = spark.createDataFrame([(i, t, t, 1) for i, t in docs], "doc_id long, text string, token_ids string, start int").repartition(3)
    for capacity, window in ((8, 16), (64, 100), (2048, 1 << 21)):
        sizes = check(packing.pack(df, PATH, capacity=capacity, window=window).collect(), docs, capacity)
        assert sum(s < capacity for s in sizes) <= 3 * 11  # only at the end of a partition
    assert packing.pack(df.limit(0), PATH).collect() == []


def test_repeated_rows_are_documents_of_their_own(spark):
    df = spark.createDataFrame([(1, "a b")] * 5, "doc_id long, text string").coalesce(1)
    rows = packing.pack(df, PATH, capacity=4, window=8).collect()
    assert sum(r.length for r in rows) == 15 and sorted(r.sequence_id for r in rows if r.offset == 0) == [0, 1, 2, 3, 4]  # 4 + 4 + 4 + 2 + 1


def test_costs_are_balanced():
    rng = random.Random(3)
    lengths = [rng.randrange(1, 600) for _ in range(3000)]
    pieces, _ = packing.assign(lengths, [2048] * (sum(lengths) // 2048))
    cost = defaultdict(float)
    for _, _, n, s, _ in pieces:
        cost[s] += packing.LINEAR * n + packing.QUADRATIC * n * n
    cut = defaultdict(float)  # documents one after the other, cut at every 2048
    at = 0
    for n in lengths:
        while n:
            take = min(n, 2048 - at % 2048)
            cut[at // 2048] += packing.LINEAR * take + packing.QUADRATIC * take * take
            at, n = at + take, n - take
    cut.pop(at // 2048, None)  # the last isn't full
    assert np.std(list(cost.values())) < np.std(list(cut.values()))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = packing.op13_packing(spark, sf).collect()
    ids = {i: np.array(whole(t) + [1], "<u4") for i, t in docs}
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
