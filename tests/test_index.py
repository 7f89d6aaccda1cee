"""The approximate index: recall against the exact search, every row indexed, the exact way, saved and read again."""

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from skein.operators.index import Index
from skein.operators.retrieval import knn


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def test_recall_of_clumped_and_of_random_vectors(spark, tmp_path):
    r = np.random.default_rng(2)
    centres = r.normal(size=(30, 16))
    clumped = centres[r.integers(0, 30, 1500)] + 0.2 * r.normal(size=(1500, 16))
    for x, most in ((clumped, 4), (r.normal(size=(1500, 16)), 20)):
        v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
        q = v.filter(F.col("vec_id") % 100 == 0).withColumnRenamed("vec_id", "query_id")
        index = Index.fit(v, 16, 20, sample=400)
        probes = index.calibrate(q, 10)
        assert probes <= most and index.recall(q, 10, probes) >= 0.9 and (probes == 1 or index.recall(q, 10, probes - 1) < 0.9)
    index.save(str(tmp_path / "i"))
    again = Index.load(spark, str(tmp_path / "i"))
    say = lambda df: sorted(tuple(x) for x in df.collect())
    assert say(again.search(q, 5, 3)) == say(index.search(q, 5, 3)) and say(again.search(q, 5)) == say(knn(v, q, 5))
    plan = again.search(q.limit(1), 5, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan.replace("isnotnull(list", "list") or "PartitionFilters: [list#" in plan


def test_odd_vectors_are_indexed_too(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [0.9, 0.1]), (6, [float("nan"), 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = Index.fit(v, 2, 4)
    assert {x.vec_id: x.list < 0 for x in index.rows.collect()} == {1: False, 2: True, 3: True, 4: True, 5: False, 6: True}
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [x.vec_id for x in index.search(q, 2, 1).orderBy("rank").collect()][0] == 1
    none = Index.fit(v.limit(0), 2, 4)
    assert none.search(q, 2, 1).count() == 0 and index.search(q.limit(0), 2, 1).count() == 0
