import re

from tidemark.plans import runs_queries


def test_every_whole_text_is_masked_and_scanned(spark, tmp_path):
    texts = {1: "lead " * 3000 + "password = abcdefgh12345678ABCD end", 2: "two words\n\n  only", 3: None, 4: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.masked, r.kinds) for r in runs_queries.queries()["document_secrets"](spark, str(tmp_path)).collect()}
    masked = {k: t and re.sub(r"\S{8,}", lambda m: f"***[len={len(m[0])}]", t) for k, t in texts.items()}
    assert {k: v[0] for k, v in got.items()} == masked
    assert "assigned" in got[1][1] and not got[2][1] and not got[4][1]
