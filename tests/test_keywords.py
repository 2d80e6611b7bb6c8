"""Keywords of texts: terms are not dealt out one by one."""

from timeweave.operators import evidence


def test_keywords_deal_out_texts_and_not_terms(spark):
    rows = [(1, "apple pear apple plum"), (1, "plum plum"), (2, "pear fig2 apple"), (3, None)]
    out = evidence.topic_keywords(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", k=2)
    got = sorted((x.doc_id, x["rank"], x.term, x.n) for x in out.collect())
    assert got == [(1, 1, "plum", 3), (1, 2, "apple", 2), (2, 1, "pear", 1), (2, 2, "fig2", 1)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = evidence.topic_keywords(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1
