"""The bound of the labelled sample of the toxicity model."""

from cohortlens.llm import toxicity


def test_training_rows_are_bounded(spark):
    once = spark.createDataFrame([(i, f"text {i}") for i in range(400)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(0, 0), (None, 1), (5, None), (999, 1)], "doc_id bigint, toxic int")
    every = toxicity.training_rows(once, labels, 1000)
    assert sorted(every) == sorted((f"text {i}", int(i % 4 == 0)) for i in range(300))
    some = toxicity.training_rows(once, labels, 40)
    assert set(some) < set(every) and 20 < sum(y for _, y in some) < 60 and 20 < sum(1 - y for _, y in some) < 60
    # A third of all rows under one doc_id, half of them equal.
    hot = once.unionByName(spark.createDataFrame([(1, f"again {i % 1000}") for i in range(2000)], "doc_id bigint, text string"))
    many = toxicity.training_rows(hot, labels, 100)
    assert len(many) == len(set(many)) and 40 < sum(1 - y for _, y in many) < 160 and sum(y for _, y in many) > 40
    assert toxicity.training_rows(hot, labels.limit(0), 100) == [] == toxicity.training_rows(hot.limit(0), labels, 100)
