"""Near-equal lines of op10_line_dedup against edit similarity alone, without the SimHash."""

import random
from collections import Counter

from hoopframe.llm import line_dedup

from .test_links import Classes, lev


def dedup(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return {x.doc_id: x.text for x in line_dedup.op10_line_dedup(spark, str(tmp_path)).collect()}


def changed_copies():
    """Lines of 6 to 25 words and copies of them with up to a seventh of the words replaced."""
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 9))) for _ in range(900)]
    lines = []
    for _ in range(50):
        base = [r.choice(vocabulary) for _ in range(r.randint(6, 25))]
        lines.append(" ".join(base))
        for _ in range(2):
            w = list(base)
            for i in r.sample(range(len(w)), r.randint(1, max(1, len(w) // 7))):
                w[i] = r.choice(vocabulary)
            lines.append(" ".join(w))
    return lines


def test_recall_against_edit_similarity_alone(spark, tmp_path):
    lines = list(dict.fromkeys(changed_copies()))
    c, bags = Classes(), [Counter(x) for x in lines]
    for i, a in enumerate(lines):
        for j in range(i):
            b, most = lines[j], 0.2 * max(len(a), len(lines[j])) + 1e-9
            if max((bags[i] - bags[j]).total(), (bags[j] - bags[i]).total()) <= most and lev(a, b) <= most:
                c.link(i, j)
    repeats = {i for i in range(len(lines)) if c.find(i) != i}
    got = dedup(spark, tmp_path, list(enumerate(lines)))
    gone = {i for i, t in got.items() if t == ""}
    assert gone <= repeats and len(gone) >= 0.97 * len(repeats) > 80


def test_short_lines_and_scripts_without_blanks(spark, tmp_path):
    chinese, thai = "\u6625\u7720\u4e0d\u89c9\u6653\uff0c\u5904\u5904\u95fb\u557c\u9e1f\u3002\u591c\u6765\u98ce\u96e8\u58f0", "\u0e01\u0e32\u0e23\u0e17\u0e14\u0e2a\u0e2d\u0e1a"
    rows = [
        (1, f"Hi.\n{chinese}\n...\n\nabcdefghij klm\n{thai}"),
        (2, f"hi!\n{chinese[:-1]}\u97f3\n...\n\nabcdefghij kln\n{thai}"),  # one character of 17 differs
        (3, f"HI\nho\n{chinese}\n\u6625\u7720\u4e0d\n\u6625\u7720"),
        (4, "\u6625\u7720\u4e0d"),
        (5, None),
    ]
    got = dedup(spark, tmp_path, rows)
    assert got == {1: rows[0][1], 2: "...\n\nabcdefghij kln", 3: "ho\n\u6625\u7720\u4e0d\n\u6625\u7720", 4: "", 5: ""}
