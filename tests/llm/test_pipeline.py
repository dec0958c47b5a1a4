import corpus_pipeline
from hoopframe.llm import quality
from pyspark.sql import functions as F

from .test_links import brute_hits, brute_jaccard, brute_lines, gone_lines

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns

    def pairs(df):
        return sorted((r.doc_id, r.text) for r in df.collect())

    steps = dict(corpus_pipeline.STAGES)
    scored = quality.score_documents(docs, spark.read.parquet(f"{SF}/labels.parquet"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    bad = {r.doc_id for r in scored.where("predicted = 0").collect()}
    first = steps["quality"](spark, docs, SF).cache()
    assert first.columns == columns and pairs(first) == [p for p in pairs(docs) if p[0] not in bad] and bad
    second = steps["line_dedup"](spark, first, SF).cache()
    gone = gone_lines(dict(pairs(first)), dict(pairs(second)))
    assert second.columns == columns and brute_lines(pairs(first), True) <= gone <= brute_lines(pairs(first), False) and gone
    assert second.where("n_chars <> length(text)").count() == 0
    third = steps["near_duplicates"](spark, second, SF).cache()
    classes = brute_jaccard(pairs(second), 5, 80)
    assert third.columns == columns and pairs(third) == [p for p in pairs(second) if classes[p[0]][1] == p[0]]
    fourth = steps["decontaminate"](spark, third, SF).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = brute_hits(pairs(third), items)
    assert fourth.columns == columns and pairs(fourth) == [p for p in pairs(third) if not hits[p[0]][1]]
    last = steps["byte_bpe"](spark, fourth, SF).collect()
    assert len(last) == fourth.count() and all(r.round_trip for r in last)


def test_run_on_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
