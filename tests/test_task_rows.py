"""Steps whose partitions follow from counted rows: what a task takes doesn't grow with the input."""

import re
from collections import Counter
from itertools import combinations

import __spark_entry__
import pytest

from cohortry.operators import enrichment, imports, relational


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(relational, "TASK_ROWS", 100, raising=False)


def _dealt(df, *keys):
    """Partitions of the exchanges by these keys, whatever their expression numbers."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {int(n) for n in re.findall(r"hashpartitioning\(" + ", ".join(rf"{k}#\d+L?" for k in keys) + r", (\d+)\)", plan)}


def test_co_occurrence_counts_rows_of_both(spark):
    rows = [(1, 5), (1, 7), (1, 7), (2, 7), (2, 5), (3, 5), (3, None), (None, 5), (None, 7), (4, 9), (4, 9)]
    got = enrichment.co_occurrence(spark.createDataFrame(rows, "g long, i long"), "g", "i").collect()
    want = Counter()
    for g in (1, 2, 3, 4):
        want.update(p for p in combinations(sorted(i for h, i in rows if h == g and i is not None), 2) if p[0] < p[1])
    assert {(r.a, r.b): r.score for r in got} == want == {(5, 7): 3}
    assert not enrichment.co_occurrence(spark.createDataFrame([], "g long, i long"), "g", "i").collect()


def test_neighbourhood_tasks_follow_rows(spark, small_tasks, tmp_path):
    lines = [(order, 17 * order % 101 + 3 * line) for order in range(200) for line in range(5)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(120).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    df = __spark_entry__.queries()["network_neighbourhood"](spark, str(tmp_path))
    # 1,000 rows and ten pairs for each of 200 orders; the session has 4 partitions.
    assert _dealt(df, "group") == {10} and _dealt(df, "a", "b") == {20}
    score = Counter(p for order in range(200) for p in combinations([17 * order % 101 + 3 * line for line in range(5)], 2))
    strong = [p for p, n in score.items() if n >= 2]
    want = {(p, p) for p in range(120)} | {(a, b) for a, b in strong if a < 120} | {(b, a) for a, b in strong if b < 120}
    got = [tuple(r) for r in df.collect()]
    assert set(got) == want and len(got) == len(want)


def test_homologue_tasks_follow_rows(spark, small_tasks, tmp_path):
    lines = [(17 * k % 97, k * k % 31 if k % 50 else None, k % 7, float(k % 13)) for k in range(1000)]
    orders = [(k % 20 if k % 40 else None, "FOP"[k % 3], float(k)) for k in range(250)]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    df = __spark_entry__.queries()["homologous_expression"](spark, str(tmp_path))
    # 1,000 lines and 250 orders; the session has 4 partitions.
    assert _dealt(df, "first_gene") == _dealt(df, "second_gene") == {10} and _dealt(df, "gene", "sample") == {10, 3}
    first, second = {}, {}
    for part, _, sample, value in lines:
        first.setdefault((part, str(sample)), []).append(value)
    for customer, sample, value in orders:
        second.setdefault((customer, sample), []).append(value)
    pairs = {(p, s) for p, s, *_ in lines if s is not None and s in {c for c, _ in second}}
    mean = lambda v: round(sum(v) / len(v), 4)
    want = Counter(("first", s, sample, mean(v)) for (part, sample), v in first.items() for p, s in pairs if p == part)
    want += Counter(("second", c, sample, mean(v)) for (c, sample), v in second.items() if c in {s for _, s in pairs})
    assert Counter((r.species, r.gene, r.sample, round(r.value, 4)) for r in df.collect()) == want


def test_homologues_count_their_rows(spark, small_tasks):
    first = spark.range(250).select("id", "id", "id").toDF("gene", "sample", "value")
    a, b = imports.intersected_homologues(first, first.filter("gene < 20"), first.filter("gene < 120").selectExpr("gene AS first_gene", "gene % 30 AS second_gene"))
    assert _dealt(a, "first_gene") == _dealt(a, "second_gene") == {3}
    assert (a.count(), b.count()) == (80, 20)
