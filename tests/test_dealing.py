"""Stages that read a file's rows in one partition, where Spark splits the partitions of the join before them."""

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import resolve, symbols
from loomgraph.schemas import AST_RECORDS

SPLIT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "0", "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def split_joins(spark):
    before = {k: spark.conf.get(k, None) for k in SPLIT}
    for key, value in SPLIT.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _records(spark):
    """Files of 20 classes of 20 methods each that call, in many partitions."""
    file = F.concat(F.lit("src/f"), F.floor(F.col("id") / 420), F.lit(".js"))
    at = F.col("id") % 420
    of, nth = F.floor(at / 21), at % 21
    start = F.when(nth == 0, of * 1000).otherwise(of * 1000 + nth * 10).cast("int")
    made = {
        "repository_id": F.lit("R"), "file_id": file, "path": file, "language": F.lit("javascript"), "category": F.when(nth == 0, "classes").otherwise("methods"),
        "name": F.when(nth == 0, F.concat(F.lit("o"), of)).otherwise(F.concat(F.lit("m"), nth)), "start_offset": start, "end_offset": F.when(nth == 0, start + 900).otherwise(start + 9), "ord": at,
    }
    kinds = spark.createDataFrame([], AST_RECORDS).schema
    return spark.range(0, 420 * 8, 1, 16).select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])


def test_a_file_is_read_in_one_task(split_joins, tmp_path):
    spark = split_joins
    _records(spark).repartition(16).write.parquet(str(tmp_path / "records"))
    records = spark.read.parquet(str(tmp_path / "records"))
    files = spark.range(8).select(F.lit("R").alias("repository_id"), F.concat(F.lit("src/f"), "id", F.lit(".js")).alias("path"), F.lit("javascript").alias("language"), F.col("id").alias("ord"))
    made = symbols.extract_symbols(files, records)
    methods = made.filter("kind = 'method'")
    assert methods.filter("parent like 'module:%'").count() == 0
    assert symbols.check_unique(made).count() == 8 * (420 + 2)
    assert methods.select(F.substring_index("id", ".", -1).alias("m")).distinct().count() == 20
    calls = records.filter("category = 'methods'").select("repository_id", "file_id", (F.col("start_offset") + 1).alias("start_offset"), (F.col("start_offset") + 2).alias("end_offset"))
    scopes = resolve.containing_scopes(calls, made)
    assert scopes.join(methods, (scopes.scope == methods.id) & (scopes.start_offset == methods.start_offset + 1)).count() == 8 * 400


def test_what_no_line_makes_is_derived_without_lines(spark, data):
    import __spark_entry__
    from loomgraph.plans import code_graph

    code_graph.forget()
    queries = __spark_entry__.queries()
    for name in ("modules_resolved", "bindings", "default_exports"):
        assert queries[name](spark, data).count() > 0
    own = code_graph.code(spark, data)
    assert "records" not in own.__dict__ and "symbols" not in own.__dict__
    columns = own.outer_symbols.columns
    few = own.outer_symbols.drop("ord")
    every = own.symbols.filter("kind <> 'method'").select(*columns).drop("ord")
    assert few.exceptAll(every).isEmpty() and every.exceptAll(few).isEmpty()
    code_graph.forget()
