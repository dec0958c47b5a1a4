"""A batch of texts is held as ids of ROWS texts at a time."""

import public_tokenizers

from hoopframe.llm import byte_bpe


def test_slices_of_a_batch_keep_rows_and_order(spark):
    texts = [None if i % 5 == 3 else f"text {i} of äöü 漢字 " * (i % 7) for i in range(3 * byte_bpe.ROWS + 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.decode_ids(byte_bpe.encode_texts(docs, path, public_tokenizers.PATTERN), path)
    got = {r.doc_id: bytes(r.decoded).decode() for r in coded.select("doc_id", "decoded").collect()}
    assert got == {i: t or "" for i, t in enumerate(texts)}
