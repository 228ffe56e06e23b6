"""Benchmark blocks over rows with shared and null ids."""

from __future__ import annotations

from wayloom.llm import decontaminate


def test_blocks_give_the_rows_of_one(spark):
    items = [(f"i{k}", " ".join(f"b{k}x{j}" for j in range(14))) for k in range(12)]
    texts = [(None, "so " + items[0][1]), (None, "nothing here"), (7, items[1][1] + " and " + items[2][1]), (7, "clean"), (7, "ah " + items[3][1]), (8, None), (9, items[4][1] + " " + items[5][1]), (9, items[4][1])]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    rows = lambda size: sorted(map(str, decontaminate.contamination(docs, benchmark, block_bytes=size).collect()))
    assert len(rows(1 << 20)) == len(texts)
    assert rows(1 << 20) == rows(300)
