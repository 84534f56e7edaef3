"""Generations of a tree: no limit on its rows, gaps and repeated ids."""

from strandwise.operators import relations


def test_more_rows_than_recursion_allows(spark):
    spark.conf.set("spark.sql.cteRecursionRowLimit", 50)
    try:
        rows = relations.quarter_generations(spark.range(4096), 24).collect()
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert sorted(map(tuple, rows)) == [(0, 4, 0, 3), (1, 12, 4, 15), (2, 48, 16, 63), (3, 192, 64, 255), (4, 768, 256, 1023), (5, 3072, 1024, 4095)]


def test_query_over_more_rows_than_recursion_allows(spark, sf_dir):
    from __spark_entry__ import queries

    spark.conf.set("spark.sql.cteRecursionRowLimit", 50)
    try:
        rows = queries()["lineage_recursive"](spark, sf_dir).collect()
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert sum(r.n for r in rows) == spark.read.parquet(f"{sf_dir}/part.parquet").count()


def test_gaps_copies_and_depth(spark):
    ids = [(x,) for x in (-7, 1, 4, 4, 5, 17, 17, 17, 20, 32, 68, None)]  # 8, on the way to 32, is missing
    want = {}
    level = [x for (x,) in ids if x is not None and x < 4]
    for d in range(4):
        if level:
            want[d] = (len(level), min(level), max(level))
        level = [x for (x,) in ids if x is not None and x > 3 for t in level if x // 4 == t]
    df = spark.createDataFrame(ids, "id bigint")
    assert {r.depth: (r.n, r.least, r.most) for r in relations.quarter_generations(df, 24).collect()} == want
    assert sorted(r.depth for r in relations.quarter_generations(df, 1).collect()) == [0, 1]
