from conftest_llm import HARD

from assay.llm import quality


def test_without_usable_labels_every_row_stays(spark, frame):
    docs, columns = frame(HARD), "doc_id long, quality int, toxic int"
    for rows in ([], [(1, None, 0), (2, None, 1)]):
        kept = quality.keep_good(docs, spark.createDataFrame(rows, columns))
        assert kept.columns == docs.columns and kept.count() == len(HARD)
