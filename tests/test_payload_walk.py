from pyspark.sql import functions as F

from tidemark.operators import variants as J


def test_one_pass_reaches_every_level(spark):
    rows = [(1, '{"a":[[],{},[1,[2]],{"b":{}}],"c":null}'), (2, "[]"), (3, "7"), (4, "{"), (5, None), (6, "null")]
    df = spark.createDataFrame(rows, "i int, p string")
    got = J.leaves(df, "p", 2)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, "$.a[0]", None, "[]", "TOO_DEEP"), (1, "$.a[1]", None, "{}", "TOO_DEEP"), (1, "$.a[2]", None, "[1,[2]]", "TOO_DEEP"), (1, "$.a[3]", None, '{"b":{}}', "TOO_DEEP"), (1, "$.c", "c", None, "VOID")]
        + [(3, "$", None, "7", "BIGINT"), (4, "$", None, "{", "MALFORMED"), (6, "$", None, None, "VOID")],
        key=str,
    )
    assert sorted((r.path, r.value) for r in J.leaves(df.where("i = 1"), "p").collect()) == [("$.a[2][0]", "1"), ("$.a[2][1][0]", "2"), ("$.c", None)]
    plan = J.leaves(df.select("i", F.concat("p", F.lit(" ")).alias("p")), "p")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate ") + plan.count("Generate variant") <= 24 and plan.count("Scan") <= 2 and "Union" not in plan
