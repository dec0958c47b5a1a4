"""Alignment of two tokenizers over the same bytes: galloping intersection of token ends, groups, links and their counts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stash
from .word_bpe import byte_letters

CACHE_CHUNKS = 300_000  # chunks of text that a Python worker remembers before it starts afresh
CHARACTERS = 1 << 20  # of documents that are aligned at a time, besides the last of them
LEADERS = 16  # every so many ends of the shorter list gallop from the document's start, the others from their leader
HOT_PAIRS = 1 << 18  # pairs that are broadcast at most

# Blanks and what follows them. Neither tokenizer has a token that goes on from another character over a blank.
CHUNK = re.compile(r"[ \n]+[^ \n]*")
ODD_BLANK = re.compile(r"[^\S \n][ \n]")  # here a run of white space would be cut

OUT = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])


def byte_level_tokens(definition: str) -> list[bytes]:
    """The bytes of each token of a byte-level BPE file, by id; b"" for added tokens."""
    parts, letters = json.loads(definition), byte_letters()
    added = {t["id"] for t in parts["added_tokens"]}
    vocab = parts["model"]["vocab"]
    tokens = [b""] * (max([*vocab.values(), *added]) + 1)
    for token, k in vocab.items():
        if k not in added:
            tokens[k] = bytes(map(letters.__getitem__, token))
    return tokens


def piece_tokens(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes of each piece, by id; b"" for control pieces."""
    tokens = []
    for k in range(model.vocab_size()):
        piece = model.id_to_piece(k)
        if model.is_byte(k):
            tokens.append(bytes([int(piece[3:-1], 16)]))
        else:
            tokens.append(b"" if model.is_control(k) else piece.replace("▁", " ").encode())
    return tokens


class PairEncoder:
    """Ids of blank + text by both tokenizers, A the byte-level BPE and B the pieces, neither with special tokens.

    A text is the concatenation of its chunks to both, so each distinct chunk
    is encoded once, many in one string. A text in which that may not hold
    (white space of other kinds before a blank, bytes that don't come back)
    is encoded whole.
    """

    def __init__(self, definition: str, model: bytes, pattern: str):
        self.a_tokens = byte_level_tokens(definition)
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={t: k for k, t in enumerate(self.a_tokens) if t}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.b_tokens = piece_tokens(self.b)
        self.crossing = any(" " in t.lstrip(b" ").decode("utf-8", "replace") or b"\n" in t[1:] for t in self.b_tokens)
        self.blank = self.b.piece_to_id("▁")
        self.a_size, self.b_size = (np.array([len(t) for t in ts], np.int64) for ts in (self.a_tokens, self.b_tokens))
        self.known_a: dict[str, bytes] = {}
        self.known_b: dict[str, bytes | None] = {}

    def whole(self, text: str) -> tuple[bytes, bytes]:
        """Ids of blank + text as packed "<u4"; empty if the bytes of either don't come back."""
        a, b, raw = self.a.encode_ordinary(" " + text), self.b.encode(text), f" {text}".encode()
        if b"".join(map(self.a_tokens.__getitem__, a)) != raw or b"".join(map(self.b_tokens.__getitem__, b)) != raw:
            return b"", b""
        return np.array(a, "<u4").tobytes(), np.array(b, "<u4").tobytes()

    def _one(self, chunk: str) -> tuple[list[int], list[int]]:
        if chunk == " ":
            b = [self.blank]
        elif chunk[0] == " ":
            b = self.b.encode(chunk[1:])
        else:
            b = self.b.encode(chunk)  # with a blank before it that is a token of its own
            b = b[1:] if b[:1] == [self.blank] else []
        return self.a.encode_ordinary(chunk), b

    def _store(self, chunk: str, a: bytes, b: bytes, same: bool) -> None:
        self.known_a[chunk], self.known_b[chunk] = a, b if same else None

    def _learn_each(self, chunks: list[str]) -> None:
        for c in chunks:
            a, b = self._one(c)
            raw = c.encode()
            same = b"".join(map(self.a_tokens.__getitem__, a)) == raw == b"".join(map(self.b_tokens.__getitem__, b))
            self._store(c, np.array(a, "<u4").tobytes(), np.array(b, "<u4").tobytes(), same)

    def _learn(self, chunks: list[str]) -> None:
        """Encodes the chunks in one string; those that end in white space, or if the cuts don't fall between tokens, one by one."""
        self._learn_each([c for c in chunks if c[-1].isspace()])
        chunks = [c for c in chunks if not c[-1].isspace()]
        if not chunks:
            return
        joined = " x" + "".join(chunks)
        cuts = np.fromiter(accumulate([2, *(len(c.encode()) for c in chunks)]), np.int64, len(chunks) + 1)
        parts = []
        for ids, tokens, size in ((self.a.encode_ordinary(joined), self.a_tokens, self.a_size), (self.b.encode(joined[1:]), self.b_tokens, self.b_size)):
            ids = np.array(ids, "<u4")
            ends = size[ids].cumsum()
            at = np.searchsorted(ends, cuts)
            if len(ends) == 0 or ends[-1] != cuts[-1] or (ends[at] != cuts).any() or b"".join(map(tokens.__getitem__, ids.tolist())) != joined.encode():
                return self._learn_each(chunks)
            packed, at = ids.tobytes(), ((at + 1) * 4).tolist()
            parts.append([packed[i:j] for i, j in zip(at, at[1:])])
        self.known_a.update(zip(chunks, parts[0]))
        self.known_b.update(zip(chunks, parts[1]))

    def encode(self, text: str) -> tuple[bytes, bytes]:
        if not text:
            return b"", b""
        if self.crossing or ODD_BLANK.search(text):
            return self.whole(text)
        chunks = CHUNK.findall(" " + text)
        new = set(chunks).difference(self.known_a)
        if new:
            if len(self.known_a) + len(new) > CACHE_CHUNKS:
                self.known_a, self.known_b, new = {}, {}, set(chunks)
            self._learn([*new])
        try:
            return b"".join(map(self.known_a.__getitem__, chunks)), b"".join(map(self.known_b.__getitem__, chunks))
        except TypeError:  # the bytes of a chunk don't come back
            return self.whole(text)


def gallop(ends: np.ndarray, wanted: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each wanted value the first place of ends that isn't below it, from `at`, which isn't beyond that place.

    All search at once: steps double until they pass the value, then the last
    step is halved. ends ascend, and their last is no less than any value.
    """
    low, high, step = at.copy(), at.copy(), 1
    active = np.flatnonzero(ends[at] < wanted)
    passed = active
    while active.size:
        probe = np.minimum(at[active] + step, len(ends) - 1)
        below = ends[probe] < wanted[active]
        high[active[~below]] = probe[~below]
        active = active[below]
        low[active] = probe[below]
        step *= 2
    while passed.size:
        passed = passed[high[passed] - low[passed] > 1]
        middle = (low[passed] + high[passed]) >> 1
        below = ends[middle] < wanted[passed]
        low[passed[below]] = middle[below]
        high[passed[~below]] = middle[~below]
    return high


def intersect(short: np.ndarray, long: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, common): of each end of the shorter list the first end of the longer that isn't before it, and whether they are equal.

    first: a place of the longer list that isn't beyond it, such as the start of the document.
    """
    place = np.empty(len(short), np.int64)
    leaders = slice(None, None, LEADERS)
    place[leaders] = gallop(long, short[leaders], first[leaders])
    place = gallop(long, short, np.repeat(place[leaders], LEADERS)[: len(short)])
    return place, long[place] == short


def overlaps(place: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shorter, longer): numbers of the tokens whose byte ranges overlap, from the places of the shorter list's ends."""
    first = np.concatenate([[0], place[:-1] + common[:-1]])
    n = place - first + 1
    shorter = np.repeat(np.arange(len(place)), n)
    return shorter, np.arange(len(shorter)) - np.repeat(n.cumsum() - n, n) + np.repeat(first, n)


def _cells(ids: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """ids in decimal, right-aligned in rows of bytes with 0 before them, then the mark."""
    width = len(str(int(ids.max(initial=0))))
    digits = ids[:, None] // 10 ** np.arange(width - 1, -1, -1)
    cells = np.where(digits > 0, digits % 10 + 48, 0)
    cells[:, -1] = ids % 10 + 48
    return np.concatenate([cells, marks[:, None]], axis=1).astype(np.uint8)


def group_texts(a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, of_doc: np.ndarray) -> list[str]:
    """Per document its groups as "a,a|b;a|b,b". a_last, b_last: whether a token is the last of its group; of_doc: groups per document."""
    group_a, group_b = a_last.cumsum() - a_last, b_last.cumsum() - b_last
    a_before = np.concatenate([[0], np.flatnonzero(a_last) + 1])  # A tokens before each group
    b_before = np.concatenate([[0], np.flatnonzero(b_last) + 1])
    cells_a, cells_b = _cells(a, np.where(a_last, ord("|"), ord(","))), _cells(b, np.where(b_last, ord(";"), ord(",")))
    width = max(cells_a.shape[1], cells_b.shape[1])
    cells = np.zeros((len(a) + len(b), width), np.uint8)
    cells[np.arange(len(a)) + b_before[group_a], width - cells_a.shape[1] :] = cells_a
    cells[np.arange(len(b)) + a_before[group_b + 1], width - cells_b.shape[1] :] = cells_b
    row_end = (a_before + b_before)[np.concatenate([[0], of_doc.cumsum()])]
    byte_end = np.concatenate([[0], np.count_nonzero(cells, axis=1).cumsum()])[row_end].tolist()
    text = cells[cells > 0].tobytes().decode("ascii")
    return [text[i : j - 1] for i, j in zip(byte_end, byte_end[1:])]


def align(docs: list[tuple[np.ndarray, np.ndarray]], a_size: np.ndarray, b_size: np.ndarray) -> list[tuple]:
    """Per document (n_a, n_b, n_groups, n_links, groups, pairs, times); every document has tokens, of the same bytes in A and B.

    The documents are laid end to end, so ends ascend over all of them and the
    ends of documents are common ends. Those whose A list is the shorter and
    the others are done apart, so that the shorter list drives.
    """
    out: list[tuple] = [()] * len(docs)
    for a_short in (True, False):
        own = [k for k, (a, b) in enumerate(docs) if (len(a) <= len(b)) == a_short]
        if not own:
            continue
        ids = [np.concatenate([docs[k][side] for k in own]).astype(np.int64) for side in (0, 1)]
        n = [np.array([len(docs[k][side]) for k in own]) for side in (0, 1)]
        s, l = (0, 1) if a_short else (1, 0)
        size = (a_size, b_size)
        ends = [size[side][ids[side]].cumsum() for side in (0, 1)]
        doc = np.repeat(np.arange(len(own)), n[s])
        place, common = intersect(ends[s], ends[l], (n[l].cumsum() - n[l])[doc])
        last = [common, np.zeros(len(ids[l]), bool)]
        last[1][place[common]] = True
        of_doc = np.bincount(doc[common], minlength=len(own))
        shorter, longer = overlaps(place, common)
        key = (ids[0][shorter] * len(b_size) + ids[1][longer]) if a_short else (ids[0][longer] * len(b_size) + ids[1][shorter])
        links = np.bincount(doc[shorter], minlength=len(own))
        a_last, b_last = last if a_short else last[::-1]
        texts = group_texts(ids[0], ids[1], a_last, b_last, of_doc)
        keys, times = np.unique(doc[shorter] * (len(a_size) * len(b_size)) + key, return_counts=True)
        cut = np.searchsorted(keys, np.arange(len(own) + 1) * (len(a_size) * len(b_size))).tolist()
        keys %= len(a_size) * len(b_size)
        for j, k in enumerate(own):
            out[k] = (int(n[0][j]), int(n[1][j]), int(of_doc[j]), int(links[j]), texts[j], keys[cut[j] : cut[j + 1]], times[cut[j] : cut[j + 1]])
    return out


@lru_cache(1)
def _pair_encoder(definition: str, model: bytes, pattern: str) -> PairEncoder:
    return PairEncoder(definition, model, pattern)


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times.

    A is a byte-level BPE file of the tokenizers library and encodes blank +
    text, B a sentencepiece model that adds the blank; strings of special
    tokens are plain text. The bytes at which tokens of both end cut them into
    groups, written "a1,a2|b1;a3|b2,b3". Tokens whose bytes overlap are linked;
    pairs has the distinct linked id pairs as a * size of B + b, ascending,
    times how many links have each. Null and empty texts, and those whose
    bytes don't come back from both, have no tokens: zeros, '' and empty
    lists. Repeated rows and null ids are documents of their own. Other
    columns of the input are not read; an empty table gives no rows.

    Nothing shuffles; documents are aligned CHARACTERS at a time, a longer one
    alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast((Path(a_path).read_text(encoding="utf-8"), Path(b_path).read_bytes(), pattern))

    def batch(ids: list[int | None], coded: list[tuple[bytes, bytes]], encoder: PairEncoder) -> pa.RecordBatch:
        arrays = [tuple(np.frombuffer(x, "<u4") for x in c) for c in coded]
        there = [k for k, (a, _) in enumerate(arrays) if len(a)]
        none = np.zeros(0, np.int64)
        rows: list[tuple] = [(0, 0, 0, 0, "", none, none)] * len(arrays)
        for k, r in zip(there, align([arrays[k] for k in there], encoder.a_size, encoder.b_size)):
            rows[k] = r
        columns = [ids, *zip(*rows)]
        made = [pa.array(c, f.type) for c, f in zip(columns[:6], OUT)]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in columns[6]])]).astype(np.int32)
        made += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(c), pa.int64())) for c in columns[6:]]
        return pa.RecordBatch.from_arrays(made, schema=OUT)

    def align_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _pair_encoder(*shared.value)
        ids, coded, held = [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0), b.column(1)):
                text = text.as_py() or ""
                ids.append(doc_id.as_py())
                coded.append(encoder.encode(text))
                held += len(text)
                if held >= CHARACTERS:
                    yield batch(ids, coded, encoder)
                    ids, coded, held = [], [], 0
        if ids:
            yield batch(ids, coded, encoder)

    kind = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs array<bigint>, times array<bigint>"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(align_partition, kind)


def with_link_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """aligned with n_best and count_sum in place of pairs and times.

    A pair's count is the number of documents that hold it linked; count_sum
    adds the counts of a document's links, n_best says how many of its links
    have the highest count of their A id.

    aligned should be stashed and have a column rid that is unique. Pairs that
    make up more than a HOT_PAIRS-th of all, so at most HOT_PAIRS of them, are
    broadcast, and the rest are joined by shuffle, where none is frequent. The
    highest counts of A ids are as many as its vocabulary has tokens.
    """
    pairs = aligned.select("rid", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    counts = stash(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    a = F.floor(F.col("pair") / b_size)
    best = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    counts = counts.withColumn("a", a).join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    counts = stash(counts, "pair-counts-best")
    hot = F.col("n") * HOT_PAIRS > total
    frequent = F.broadcast(counts.where(hot))
    sums = [F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum")]
    known = pairs.join(frequent, "pair", "left")
    of_frequent = known.where("n is not null").groupBy("rid").agg(*sums)
    of_rare = known.where("n is null").select("rid", "pair", "times").join(counts.where(~hot), "pair").groupBy("rid").agg(*sums)
    both = of_frequent.unionByName(of_rare).groupBy("rid").agg(*[F.sum(c).alias(c) for c in ("n_best", "count_sum")])
    out = aligned.drop("pairs", "times").join(both, "rid", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")})


def token_alignment(docs: DataFrame, a_path: str, b_path: str, pattern: str) -> DataFrame:
    """align_tokenizers() with the links' counts over the whole corpus, and a digest of the groups in place of their text."""
    b_size = sentencepiece.SentencePieceProcessor(model_file=b_path).vocab_size()
    digest = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    aligned = align_tokenizers(docs, a_path, b_path, pattern).select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times", F.monotonically_increasing_id().alias("rid"))
    out = with_link_counts(stash(aligned, "aligned"), b_size)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of byte_bpe_50k.json and piece_bpe_32k.model lie on each other in every document."""
    import public_tokenizers as p

    return token_alignment(read(spark, sf_dir, "documents"), p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model"), p.PATTERN)
