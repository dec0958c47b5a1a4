import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from hoopframe.llm import merkle

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climb(nodes):
    """Root of the nodes, and of each the steps of its proof: what stands left and right of it."""
    ways, at = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        above, held = [], []
        for k in range(0, len(nodes), 3):
            run = nodes[k : k + 3]
            above.append(sha("".join(run)))
            held.append([])
            for j in range(len(run)):
                for leaf in at[k + j]:
                    ways[leaf].append(("".join(run[:j]), "".join(run[j + 1 :])))
                    held[-1].append(leaf)
        nodes, at = above, held
    return nodes[0], ways


def brute(rows):
    def leaf(r, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))

    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[s] = climb([leaf(r, r["text"]) for r in groups[s]])
    root, tops = climb([trees[s][0] for s in names])
    out = []
    for s, top in zip(names, tops):
        for r, way in zip(groups[s], trees[s][1]):
            text, i = r["text"], r["doc_id"]
            if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf(r, text)
            for left, right in way + top:
                node = sha(left + node + right)
            out.append((i, leaf(r, r["text"]), trees[s][0], root, sha("".join(x + y for x, y in way + top)), node, node == root))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def made(spark, sizes):
    rows, i = [], 0
    for s, n in sizes:
        for _ in range(n):
            rows.append((i * 7 % 1009, None if i % 11 == 0 else "ab\nc" * (i % 5), None if i % 13 == 0 else "en", s, None if i % 17 == 0 else i))
            i += 1
    rows += [(None, "x\ny", "en", "s1", 1), (3, "same\n", "en", "s1", 1), (3, "same\n", "en", "s1", 1), (4, "", "ü", "", 0), (5, "z" * 300_000 + "\n", "en", "é", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("height", [0, 1, 2, 6])
def test_proofs_equal_brute_force(spark, height):
    docs = made(spark, [("s1", 100), ("s2", 28), (None, 9), ("s3", 1), ("s4", 27), ("s5", 4)])
    rows = [r.asDict() for r in docs.collect()]
    assert rows_of(merkle.tamper_report(docs, height)) == brute(rows)


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(1, "a\nb", "en", None, 3)], DOCS)
    assert rows_of(merkle.tamper_report(one)) == brute([r.asDict() for r in one.collect()])
    assert merkle.tamper_report(one.limit(0)).collect() == []


def test_columns_of_any_name_pass(spark):
    leaves = spark.range(20).select(F.col("id"), F.lit("s").alias("source"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"), F.col("id").alias("a.b"), F.col("id").alias("node"), F.col("id").alias("steps_"))
    out = merkle.merkle_manifest(leaves, 1).collect()
    assert len(out) == 20 and all(r["a.b"] == r["id"] == r["node"] for r in out)


def test_query_equals_brute_force_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = rows_of(merkle.op12_merkle_manifest(spark, sf))
    assert got == brute([r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert got == sorted(db.execute(f"select {', '.join(COLUMNS)} from ({merkle.SQL})").fetchall(), key=str)
    assert {r[-1] for r in got} == {True, False}
