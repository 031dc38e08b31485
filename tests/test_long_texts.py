"""Long texts cost in proportion to their length."""

import time

from evidra.plans import contracts


def test_span_tokens_of_a_long_text(spark, tmp_path):
    spark.createDataFrame([(1, "abcdé" * 80_000), (2, "short"), (3, ""), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    start = time.monotonic()
    got = {r["doc_id"]: (r["n"], r["site"], r["first"]) for r in contracts.b14_span_tokens(spark, str(tmp_path)).collect()}
    last = {r["doc_id"]: r["last"] for r in contracts.b16_last_token(spark, str(tmp_path)).collect()}
    assert got == {1: (4, 4, 1), 2: (0, None, None)} and last == {1: 199, 2: None}
    assert time.monotonic() - start < 30
