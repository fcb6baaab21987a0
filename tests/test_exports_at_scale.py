"""Numbers of grams are looked up within a document; only grams outside the common ones are shuffled."""

import pytest
from pyspark.sql import functions as F

from larkspur.checkpoint import durable
from larkspur.operators import features


@pytest.mark.parametrize("options", [features.Options(1, threshold=2), features.Options(2, 0, threshold=2), features.Options(2, 1, threshold=1, stem=True)])
def test_common_and_other_grams_agree(spark, options):
    d = spark.createDataFrame([(1, "a b a b c ran"), (2, "b a b run"), (3, None), (4, "z"), (4, "a b c ran"), (5, "")], "identifier long, document string")
    table = features.gram_table(d, options)
    names = features.number(table.select("gram").distinct(), "gram", 0, "feature")
    numbers = durable(table.join(names, "gram").select("raw", "feature", "n"))
    want = {r["identifier"]: r["f"] for r in features.raw_grams(d, options).join(numbers, "raw").groupBy("identifier").agg(F.sort_array(F.collect_set("feature")).alias("f")).collect()}
    for common in (0, 2, 1000):
        made = features.held_features(d, numbers, options, common)
        assert {r["identifier"]: r["features"] for r in made.collect() if r["features"]} == want, common
    text = features.held_features(d, numbers, options)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and text.count("Exchange hash") == 1
