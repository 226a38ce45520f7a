"""What a Python worker of the vector index holds doesn't grow with lists times queries."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomgraph.operators import rag, vector_index


def test_a_block_holds_the_scores_of_a_few_queries(spark):
    made = np.random.default_rng(3).normal(size=(8192, 4))
    table = lambda rows: pa.table({"key": pa.array(range(len(rows)), pa.int64()), "vector": pa.array(list(rows), pa.list_(pa.float64()))})
    vectors, queries = table(made), table(made[:1024])
    tracemalloc.start()
    found = rag.nearest_of_block("id", 2)(vectors, queries).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6
    assert len(found) == 2048 and (found.groupby("query_id")["id"].first() == np.arange(1024)).all()


def test_a_query_is_not_copied_in_python_for_each_list(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.random.default_rng(4).normal(size=(300, 4)))]
    vectors = spark.createDataFrame(rows, "id bigint, embedding array<double>").repartition(3)
    index = vector_index.build(vectors, f"{spark.conf.get('spark.checkpoint.dir')}/index-memory", lists=12)
    asked = vectors.filter("id < 20").select(F.col("id").alias("query_id"), F.lit("").alias("group"), F.col("embedding").alias("vector"))
    probes = vector_index._probes(index, asked, 1, 1.0)
    plan = probes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("posexplode") < plan.index("MapInArrow")
    present = {r["list"] for r in index.sizes.collect()}
    by_query = {}
    for r in probes.collect():
        by_query.setdefault(r["query_id"], []).append((r["rank"], r["list"]))
    assert len(by_query) == 20 and len(present) > 1
    for query, met in by_query.items():
        order = np.argsort(-(index.centroids @ np.array(rows[query][1])), kind="stable")
        assert [m for _, m in sorted(met)] == [x for x in order.tolist() if x in present]
