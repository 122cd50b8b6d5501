"""Training rows where ids repeat."""

from pyspark.sql import functions as F

from basketlab.llm import common


def test_one_text_of_each_drawn_id(spark):
    docs = [(i, f"text {i}") for i in range(30)] + [(3, f"repeat {k}") for k in range(500)] + [(None, "x")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    found, counts = common.labelled_sample(docs, labels, "toxic", F.lit(True), 20, 1000, 1)
    assert counts == {0: 15, 1: 15} and len(found) == 30
    assert sorted(t for t, y in found if y == 1) == sorted("repeat 0" if i == 3 else f"text {i}" for i in range(1, 30, 2))
