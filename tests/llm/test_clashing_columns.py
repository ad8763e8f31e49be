"""keep_one on tables whose columns have the names that it uses inside."""

from scholia.llm import neardup

WORDS = " ".join(f"w{k}" for k in range(40))


def test_keep_one_with_clashing_columns(spark):
    rows = [(1, WORDS, 5, 6), (2, WORDS, 5, 7), (2, "another text that stays by itself in the table", 5, 8), (3, None, 5, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __CID long, cid long")
    got = neardup.keep_one(docs)
    assert got.columns == docs.columns and sorted(r["cid"] for r in got.collect()) == [6, 8, 9]
