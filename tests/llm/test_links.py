import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from hoopframe.llm import cells, line_dedup
from hoopframe.llm.decontaminate import benchmark_windows, build_index, decontaminate, proximity_matches
from hoopframe.llm.graph import components
from hoopframe.llm.jaccard_join import jaccard_classes
from hoopframe.llm.shingles import word_hashes

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EDGES = [None, "", " \n\t ", "one", "ONE", "one two three", "one two three", "é É", "long " * 5000]


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))


class Classes(dict):
    def find(self, x):
        while self.setdefault(x, x) != x:
            self[x] = self[self[x]]
            x = self[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def brute_jaccard(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    c = Classes()
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                c.link(a, b)
    return {d: (len(sets[d]), c.find(d)) for d in ids}


def near_copies(seed, n):
    """Chains of near copies around a few texts, and unrelated texts that share a passage."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = [r.choice(vocabulary) for _ in range(30)]
    texts = []
    for base in ([r.choice(vocabulary) for _ in range(r.randint(20, 80))] for _ in range(4)):
        for _ in range(n // 6):
            t = list(base)
            for _ in range(r.randint(0, 4)):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            texts.append(" ".join(t))
            base = t if r.random() < 0.3 else base
    texts += [" ".join(passage + [r.choice(vocabulary) for _ in range(r.randint(1, 60))]) for _ in range(n // 3)]
    return texts


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (1, 50)])
def test_jaccard_equals_brute_force(spark, k, percent):
    rows = list(enumerate(EDGES + near_copies(k, 120)))
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n long").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(docs, k, percent).collect()}
    assert got == brute_jaccard(rows, k, percent)


def test_jaccard_of_nothing_and_of_repeated_rows(spark):
    docs = spark.createDataFrame([(2, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    assert [(r.doc_id, r.component_id) for r in jaccard_classes(docs).collect() if r.doc_id] == [(2, 2)] * 2
    assert jaccard_classes(docs.limit(0)).collect() == []


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)] + [(5, 5), (None, 3)]
    c = Classes()
    for a, b in links:
        if a is not None and a != b:
            c.link(a, b)
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: c.find(x) for x in list(c)}


def brute_hits(docs, items, size=10):
    wins = {}
    for i, t in items:
        w = words(t)
        for s in range(max(len(w) - size, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[s : s + size]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in wins:
                    hit.update(range(s, s + n))
                    found |= wins[k]
        out[d] = (len(w), len(hit), sorted(found))
    return out


def brute_near(docs, items, size=10, slop=3):
    """Items of which all distinct words of a window, two or more, lie among size + slop words of a document."""
    wins = {}
    for i, t in items:
        w = words(t)
        for s in range(max(len(w) - size, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[s : s + size]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w = words(t)
        found = [own for x, own in wins.items() if len(set(x)) > 1 and any(set(x) <= set(w[p : p + len(x) + slop]) for p in range(len(w)))]
        out[d] = sorted(set().union(*found))
    return out


def test_decontaminate_equals_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"v{i}" for i in range(40)] + ["the", "of"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 3, 9, 10, 11, 30])))) for i in range(12)] + [(20, None), (21, "..."), (22, "the of the of the of the of the of the of")]
    docs = list(enumerate(EDGES))
    for d in range(20, 60):
        parts = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        if d % 2:
            t = words(r.choice(items[:12])[1])
            t = t[r.randint(0, 1) :]
            for _ in range(d % 4):  # words put in between
                t.insert(r.randint(0, len(t)), "and")
            parts[5:5] = t
        docs.append((d, ", ".join(parts).upper()))
    frame = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, pos int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x.doc_id: (x.n_words, x.n_hit, x.item_ids) for x in decontaminate(frame, bench).collect()}
    assert got == brute_hits(docs, items)
    near = {x.doc_id: x.near_ids for x in decontaminate(frame, bench).collect()}
    assert near == brute_near(docs, items) and sum(len(near[d]) > len(x[2]) for d, x in got.items()) > 3
    assert all(x.n_hit == 0 for x in decontaminate(frame, bench.limit(0)).collect())
    assert decontaminate(frame.limit(0), bench).collect() == []
    twice = decontaminate(frame.where("doc_id = 21").union(frame.where("doc_id = 21")), bench).collect()
    assert len(twice) == 2 and twice[0] == twice[1]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x b y c"), (2, "c b a"), (3, "a " + "x " * 40 + "b c")], "doc_id long, text string")
    windows, _ = benchmark_windows(spark.createDataFrame([(1, "a b c")], "item_id long, text string"))
    vocabulary = spark.createDataFrame([("a",), ("b",), ("c",)], "term string")
    near = proximity_matches(build_index(docs, vocabulary, 3), windows, slop=2)
    assert {x.d_id for x in near.collect()} == {1, 2}
    assert {x.d_id for x in proximity_matches(build_index(docs, vocabulary, 3), windows, slop=1).collect()} == {2}


def lev(a, b):
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def trigrams(line):
    c = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.bincount((c[:-2] * 961 + c[1:-1] * 31 + c[2:]) % 2048, minlength=2048) if len(c) > 2 else np.zeros(2048, int)


def near_pairs(distinct, similarity=0.8, sims=None, known=lambda i, j: False):
    """Pairs of places of the lines of edit similarity 0.8, by plain edit distance where lengths and trigrams allow it, of
    which an edit changes three on either side; with sims only those at most three bits apart; not those known already."""
    grams = np.array([trigrams(x) for x in distinct], np.int16).reshape(len(distinct), 2048)
    sizes = np.array([len(x) for x in distinct])
    for i, a in enumerate(distinct):
        most = (1 - similarity) * np.maximum(sizes[:i], sizes[i]) + 1e-9
        may = np.flatnonzero(np.abs(sizes[:i] - sizes[i]) <= most)
        if sims is not None:
            may = may[np.bitwise_count(sims[may] ^ sims[i]) <= 3]
        for j in may[np.abs(grams[may] - grams[i]).sum(axis=1) <= 6 * most[may]]:
            if known(i, j):
                continue
            long = sizes[i] > 150  # within() is held against lev() in a test of its own
            if line_dedup.within(a, distinct[j], int(most[j])) if long else lev(a, distinct[j]) <= most[j]:
                yield i, int(j)


def sim_of(line):
    data = np.frombuffer(line.encode(), np.uint8)
    return int(line_dedup.simhashes(*word_hashes(data, np.array([0, len(data)])))[0])


def brute_lines(rows, by_simhash):
    """{id: (lines, gone)} by edit similarity alone, or of pairs up to three bits apart only: no fewer and no more lines may go."""
    lines = []
    for d, t in rows:
        for i, x in enumerate((t or "").split("\n")):
            if words(x):
                lines.append(((d, i), " ".join(words(x))))
    distinct = list(dict.fromkeys(n for _, n in lines))
    c = Classes()
    long = [n for n in distinct if len(n.split()) >= 5]
    for i, j in near_pairs(long, sims=np.array([sim_of(x) for x in long], np.uint64) if by_simhash else None, known=lambda i, j: c.find(long[i]) == c.find(long[j])):
        c.link(long[i], long[j])
    seen, gone = set(), set()
    for key, n in sorted(lines):
        g = c.find(n)
        if g in seen:
            gone.add(key)
        seen.add(g)
    return gone


def gone_lines(before, after):
    """Which lines of each document are left out: {(id, place)}; the rest keeps its order."""
    gone = set()
    for d, t in before.items():
        left = iter([*after[d].split("\n"), None])
        now = next(left)
        for i, x in enumerate((t or "").split("\n")):
            if x == now:
                now = next(left)
            else:
                gone.add((d, i))
        assert now is None or now == ""
    return gone


def test_lines_equal_brute_force(spark):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(80)]
    bases = [[r.choice(vocabulary) for _ in range(r.randint(5, 40))] for _ in range(12)]
    rows = list(enumerate(EDGES))
    for d in range(20, 70):
        lines = []
        for n in range(r.randint(1, 6)):
            w = list(r.choice(bases))
            if r.random() < 0.6:
                w[r.randrange(len(w))] += r.choice("xyz")
            lines.append(r.choice([" ", ", "]).join(w).capitalize() + "!" * (n + 1))
        rows.append((d, "\n".join(lines) + r.choice(["", "\n", "\nHi."])))
    docs = spark.createDataFrame([(d, t, "s", 4) for d, t in rows], "doc_id long, text string, drop string, n_lines int").repartition(3)
    got = line_dedup.drop_repeated_lines(docs)
    assert got.columns == ["doc_id", "text", "drop", "n_lines", "n_dropped"]
    got = {x.doc_id: x for x in got.collect()}
    gone = gone_lines(dict(rows), {d: x.text for d, x in got.items()})
    least, most = brute_lines(rows, True), brute_lines(rows, False)
    assert least <= gone <= most and len(gone) >= 0.97 * len(most)
    assert all((x.n_lines, x.n_dropped) == ((t or "").count("\n") + 1, sum(g[0] == d for g in gone)) for d, t in rows for x in [got[d]])
    assert line_dedup.drop_repeated_lines(docs.limit(0)).collect() == []


def test_large_blocks_and_cells_lose_no_line(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK_LINES", 3)
    monkeypatch.setattr(cells, "MEMBERS", 6)
    r = random.Random(9)
    base = ["".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(30)]
    lines = [" ".join(base[:i] + [w + r.choice("xyz")] + base[i + 1 :]) for i, w in enumerate(base)] * 2
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    assert sorted(x.doc_id for x in line_dedup.drop_repeated_lines(docs).collect() if x.text) == [0]


def test_large_cells_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cells, "MEMBERS", 8)
    rows = list(enumerate(near_copies(2, 150)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(docs, 2, 70).collect()}
    assert got == brute_jaccard(rows, 2, 70)


@pytest.mark.parametrize("seed", range(3))
def test_within_equals_edit_distance(seed):
    r = random.Random(seed)
    pairs = [("", ""), ("", "abc"), ("abc", "")]
    for _ in range(300):
        a = "".join(r.choice("ab\u00e9\U00020000 ") for _ in range(r.randint(0, 40)))
        b = list(a)
        for _ in range(r.randint(0, 8)):
            at = r.randint(0, len(b))
            b[at : at + r.randint(0, 1)] = r.choice(["", "a", "b", "\u00e9"])
        pairs.append((a, "".join(b)))
    for a, b in pairs:
        assert [line_dedup.within(a, b, m) for m in range(12)] == [lev(a, b) <= m for m in range(12)]


def test_simhash_of_very_many_words():
    words_, counts = np.arange(1, 140_001, dtype=np.uint64), np.array([70_000, 70_000])
    lengths = np.full(140_000, 5)
    both = line_dedup.simhashes(words_, counts, lengths)
    for half, h in zip(np.split(words_, 2), both):
        ones = [int(((half >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)]
        want = sum(int(2 * n > 70_000 or (2 * n == 70_000 and (int(half[0]) >> b) & 1)) << b for b, n in enumerate(ones))
        assert int(h) == want


def test_near_pairs():
    r = random.Random(4)
    a = r.getrandbits(63)
    sims = np.array([a, a ^ (1 << 63) - 1, *(a ^ sum(1 << b for b in r.sample(range(63), k)) for k in (1, 3, 4, 20))], np.uint64)
    line, chars = np.arange(6), np.array([100, 100, 100, 80, 100, 79])
    for region, want in ((1, {(0, 2), (0, 3)}), (2, {(0, 2), (0, 3), (0, 4)})):
        i, j = line_dedup.near_pairs(np.full(6, region), line, sims, chars, 0.8)
        assert {(x, y) for x, y in zip(i.tolist(), j.tolist()) if x == 0} == want


def test_lines_of_tables_with_odd_names_and_of_a_very_long_text(spark):
    words = [hashlib.md5(str(k).encode()).hexdigest() for k in range(20_000)]
    many = "\n".join(" ".join(w[j : j + 5] for j in range(0, 30, 5)) for w in words for _ in range(10))
    docs = spark.createDataFrame([(1, many, 7, 8, 9), (2, "", 7, 8, 9)], ["doc_id", "text", "a.b", "__", "row"])
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(docs).collect()}
    assert got[1].n_lines == 200_000 and got[1].n_dropped >= 180_000 and (got[1]["a.b"], got[1]["__"], got[1]["row"]) == (7, 8, 9)
    assert got[1].text.count("\n") == got[1].n_lines - got[1].n_dropped - 1
