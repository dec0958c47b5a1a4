"""Edit distances of many pairs side by side, against those of one pair."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hoopframe.llm import cells, edits, line_dedup
from pyspark.sql import functions as F

from .test_links import Classes, lev


def changed(r: random.Random, text: str, n: int, letters: str) -> str:
    for _ in range(n):
        at = r.randrange(len(text) + 1)
        text = r.choice([text[:at] + r.choice(letters) + text[at:], text[:at] + text[at + 1 :], text[:at] + r.choice(letters) + text[at + 1 :]])
    return text


@pytest.mark.parametrize("letters", ["ab", "abcdefgh ", "aé本𝄞 "])
@pytest.mark.parametrize("size", [0, 1, 12, 63, 64, 65, 130, 300])
def test_side_by_side_equals_edit_distance(letters, size, monkeypatch):
    monkeypatch.setattr(edits, "FEWEST", 1)
    monkeypatch.setattr(edits, "PAUSE", 5)
    r = random.Random(f"{letters}{size}")
    texts = ["".join(r.choice(letters) for _ in range(size)) for _ in range(4)]
    texts += [changed(r, t, r.randrange(size // 3 + 3), letters) for t in texts for _ in range(2)]
    a, b = (x.ravel() for x in np.indices((len(texts), len(texts))))
    far = np.array([lev(texts[i], texts[j]) for i, j in zip(a, b)])
    for most in (np.zeros(len(a), int), np.maximum(far - 1, 0), far, far + r.randrange(4), np.full(len(a), size // 5 + 1)):
        for short in (0, 1 << 30):  # 64 cells at a time, and one
            monkeypatch.setattr(edits, "SHORT", short)
            assert (edits.Texts(texts).within(a, b, most) == (far <= most)).all()


@pytest.mark.parametrize("size", [2000, 5000])
def test_long_texts_side_by_side(size, monkeypatch):
    """Over 250 edits, of which a byte can't hold the number."""
    monkeypatch.setattr(edits, "FEWEST", 1)
    r = random.Random(size)
    texts = ["".join(r.choice("abcd ") for _ in range(size))]
    texts += [changed(r, texts[0], n, "abcd ") for n in (0, 3, 200, 400, 900)]
    a, b = np.triu_indices(len(texts), 1)
    for part in (0.05, 0.1, 0.2):
        most = np.full(len(a), int(size * part))
        expected = [edits.within(texts[i], texts[j], int(m)) for i, j, m in zip(a, b, most)]
        for short in (0, 1 << 30):
            monkeypatch.setattr(edits, "SHORT", short)
            assert edits.Texts(texts).within(a, b, most).tolist() == expected


def test_cells_are_compared_side_by_side(monkeypatch):
    """Lines that share a passage and little else: far pairs were compared one by one, a call for each."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    passage = " ".join(r.choice(words) for _ in range(12))
    lines = [f"{' '.join(r.choice(words) for _ in range(5))} {passage}" for _ in range(30)]
    lines += [changed(r, t, 3, "abcdefghij") for t in lines[:10]]
    held, before = [], np.arange(20)
    for lo in (0, 20):
        item = pa.StructArray.from_arrays([pa.array(lines[lo : lo + 20]), pa.array(np.zeros(20, np.int64))], ["text", "sim"])
        held.append((line_dedup.LineSpace(item, 0.8), before))
    calls = []
    one = edits.within
    for module in (edits, line_dedup):
        monkeypatch.setattr(module, "within", lambda *x: calls.append(x) or one(*x))
    got = line_dedup.LineSpace.connect_all(held)
    for lo, labels in zip((0, 20), got):
        groups = Classes()
        for i in range(20):
            for j in range(i):
                if lev(lines[lo + i], lines[lo + j]) <= max(len(lines[lo + i]), len(lines[lo + j])) * 0.2 + 1e-9:
                    groups.link(i, j)
        assert [[bool(x == y) for y in labels] for x in labels] == [[groups.find(i) == groups.find(j) for j in range(20)] for i in range(20)]
    assert (before == np.arange(20)).all()
    assert len(calls) < 2 * edits.FEWEST  # of 380 pairs


@pytest.mark.parametrize("members", [1024, 4])
def test_cells_keep_the_tasks_of_a_shuffle(spark, members, monkeypatch):
    """Adaptive execution merged the cells' few bytes into one task, which compared them all."""
    monkeypatch.setattr(cells, "MEMBERS", members)
    tasks, stash = {}, cells.stash

    def counted(df, name):
        if name in ("links", "split-cells"):
            tasks.setdefault(name, set()).add(df.rdd.getNumPartitions())
        return stash(df, name)

    monkeypatch.setattr(cells, "stash", counted)
    rows = spark.range(64).select(F.col("id").alias("key"), (F.col("id") % 8).alias("cell"), F.lit(0).alias("rank"))
    item = F.struct(F.format_string("the same words in every line %s", F.col("id")).alias("text"), F.lit(0).cast("long").alias("sim"))
    items = spark.range(64).select(F.col("id").alias("key"), F.lit(30).cast("long").alias("weight"), item.alias("item"))
    links = cells.join_cells(rows, items, lambda x: line_dedup.LineSpace(x, 0.8)).collect()
    assert len({frozenset((x.a % 8, x.b % 8)) for x in links}) == 8
    assert tasks["links" if members > 4 else "split-cells"] == {4}
