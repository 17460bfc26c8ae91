"""Script names of documents against their SQL, on tables with odd rows: no text, repeated keys, other scripts."""

import duckdb

import __spark_entry__


def test_aliases_of_odd_documents(spark, tmp_path):
    texts = [(0, "word and word"), (1, ""), (2, None), (3, "word"), (3, "12"), (3, ""), (4, "été"), (4, "漢字"), (5, "é"), (6, "αβγ"), (7, "..."), (8, None), (8, "x"), (None, "a"), (None, "1"), (9, "ªºµ"), (10, "\n"), (11, "e\u0301"), (12, "\U0001f468\u200d\U0001f469")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()["aliases_of_documents"]).fetchall()
    got = __spark_entry__.queries()["aliases_of_documents"](spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert len(want) == 12
