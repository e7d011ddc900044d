import pytest

from newsloom.llm import katz
from tests.llm.test_katz import TEXTS, Plain


def test_query_backs_off_from_trigrams(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = katz.query(spark, str(tmp_path)).collect()
    plain = Plain([TEXTS[r.doc_id] for r in rows if not r.held_out], 3)
    for r in rows:
        assert r.score == pytest.approx(plain.score(TEXTS[r.doc_id]), rel=1e-9)
