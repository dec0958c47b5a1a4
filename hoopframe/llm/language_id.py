"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, read, stash, text_or_empty

BUCKETS = 1 << 15
MAX_LANGS = 500  # 500 x 32768 float32 log-probabilities are 64 MB, the most that is broadcast
CHUNK = 1 << 20  # characters that are hashed at a time
DOCS = -1  # bucket in which the counts hold the number of documents


def _letters() -> np.ndarray:
    """Letters of the basic plane as themselves, everything else as a blank."""
    table = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        if chr(c).isalpha():
            table[c] = c
    return table


def _chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts of about CHUNK characters, with the index of the first."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def gram_buckets(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all 2- and 3-grams of lower-cased texts, and how many each text has.

    Texts are padded with one blank; a run of blanks is a gram like any other,
    but grams of blanks only are left out, so a text without letters has none.
    """
    padded = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes < 1 << 16, letters[np.minimum(codes, (1 << 16) - 1)], codes)
    ends = np.cumsum([len(t) for t in padded])
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    found, owners = [], []
    for n in (2, 3):
        if len(codes) < n:
            continue
        parts = [codes[k : len(codes) - n + 1 + k] for k in range(n)]
        h = np.full(len(parts[0]), n, np.uint32)
        blank = np.ones(len(h), bool)
        for part in parts:
            h = (h ^ part) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            blank &= part == 32
        good = (owner[: len(h)] == owner[n - 1 :]) & ~blank
        found.append(((h[good] * np.uint32(0x85EBCA77)) >> np.uint32(17)).astype(np.int64))
        owners.append(owner[: len(h)][good])
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    buckets, owner = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return buckets[order], np.bincount(owner, minlength=len(texts))


@dataclass
class LanguageModel:
    langs: list[str]
    log_probs: np.ndarray  # bucket x language, float32
    priors: np.ndarray


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> LanguageModel:
    """Counts every n-gram of every labelled text; rows without a lang are left out, a null text is empty.

    Tasks sum their counts before the shuffle, whose size is bounded by tasks x
    languages x BUCKETS. More than MAX_LANGS languages are an error. No rows
    give a model without languages.
    """
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), text_or_empty(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums, docs = _letters(), {}, {}
        for batch in batches:
            langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            for first, chunk in _chunks(texts):
                buckets, sizes = gram_buckets(chunk, letters)
                own = langs[first : first + len(chunk)]
                for lang in set(own.tolist()):
                    mine = own == lang
                    docs[lang] = docs.get(lang, 0) + int(mine.sum())
                    sums[lang] = sums.get(lang, 0) + np.bincount(buckets[np.repeat(mine, sizes)], minlength=BUCKETS)
        for lang, n in sums.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * (len(k) + 1), "bucket": pa.array([DOCS, *k.tolist()], pa.int32()), "n": pa.array([docs[lang], *n[k].tolist()], pa.int64())})

    counts = stash(rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "gram-counts")
    langs = sorted(r.lang for r in counts.where(F.col("bucket") == DOCS).select("lang").limit(MAX_LANGS + 1).collect())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    table = counts.toPandas()  # at most MAX_LANGS x BUCKETS rows, whatever the corpus
    at = {lang: i for i, lang in enumerate(langs)}
    sums, docs = np.full((BUCKETS, len(langs)), smoothing), np.ones(len(langs))
    column, bucket, n = table.lang.map(at).to_numpy(int), table.bucket.to_numpy(int), table.n.to_numpy(float)
    gram = bucket != DOCS
    sums[bucket[gram], column[gram]] += n[gram]
    docs[column[~gram]] = n[~gram]
    return LanguageModel(langs, np.log(sums / sums.sum(axis=0)).astype(np.float32), np.log(docs / max(docs.sum(), 1)))


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score, the posterior of the predicted language.

    A text that is null, empty or without letters, and any text under a model
    without languages, is und with score 0. Ties go to the language that
    sorts first. Columns of these names in the input are replaced; all others
    stay. Rows are scored where they are, without a shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m, letters = shared.value, _letters()
        for batch in batches:
            texts = batch.tolist()
            langs, best = ["und"] * len(texts), np.zeros(len(texts))
            for first, chunk in _chunks(texts if m.langs else []):
                buckets, sizes = gram_buckets(chunk, letters)
                some = np.flatnonzero(sizes)
                if not len(some):
                    continue
                starts = np.cumsum(sizes)[some] - sizes[some]
                logs = np.column_stack([np.add.reduceat(m.log_probs[:, j][buckets], starts, dtype=np.float64) for j in range(len(m.langs))]) + m.priors
                top = logs.argmax(axis=1)
                share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                best[first + some] = share
                for i, j in zip((first + some).tolist(), top.tolist()):
                    langs[i] = m.langs[j]
            yield pd.DataFrame({"lang_pred": langs, "score": best})

    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(F.struct(*others).alias("row"), score(text_or_empty(text_col)).alias("p"), text_or_empty(text_col).rlike(r"\p{L}").alias("lettered"))
    pred = F.when(F.col("lettered"), F.col("p.lang_pred")).otherwise("und")
    return rows.select("row.*", pred.alias("lang_pred"), F.when(pred == "und", F.lit(0.0)).otherwise(F.col("p.score")).alias("score"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    held_out = F.coalesce(bucket_of("doc_id", 5) == 0, F.lit(False))
    model = fit(docs.where(~held_out))
    return predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")
