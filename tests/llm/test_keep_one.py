"""Near-duplicates go by row, so that no document is lost for its id."""

import random

import corpus_pipeline


def test_null_and_repeated_ids_lose_no_text(spark):
    r = random.Random(5)
    a, b, c, d, e = (" ".join(f"w{r.randrange(9999)}" for _ in range(60)) for _ in range(5))
    rows = [(None, a), (None, b), (None, b + " end"), (5, c), (5, d), (7, c), (None, d), (8, e), (8, e), (None, e)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = corpus_pipeline.keep_one_of_each(spark, docs, "")
    assert out.columns == docs.columns
    got = [tuple(x) for x in out.collect()]
    kept_b = [x for x in got if x in ((None, b), (None, b + " end"))]
    assert len(kept_b) == 1
    assert sorted(x for x in got if x[0]) == sorted([(5, c), (5, d), (8, e)])
    assert (None, a) in got and len(got) == 5
