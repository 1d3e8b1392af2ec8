import re

from tidemark.operators import aggregates as ops
from tidemark.operators.control import plan_text


def visits(spark):
    rows = [("a", i % 40) for i in range(200)] + [("a", None), (None, 1), (None, 2), (None, 2), ("b", None)]
    return spark.createDataFrame(rows, "kind string, user int")


def test_distinct_both_ways(spark):
    out = {r["kind"]: (r["exact"], r["near"]) for r in ops.distinct_both_ways(visits(spark), "kind", "user", 0.01).collect()}
    assert out == {"a": (40, 40), None: (2, 2), "b": (0, 0)}


def test_sketches_are_one_per_group_not_per_value(spark):
    plan = plan_text(ops.distinct_both_ways(visits(spark), "kind", "user", 0.01), "simple")
    keys = [re.search(r"keys=\[([^\]]*)\]", line).group(1) for line in plan.splitlines() if "approx_count_distinct" in line and "keys=" in line]
    assert keys and all("," not in k for k in keys)
