"""Schemas, boundaries and the stream."""

import pandas as pd
from pyspark.sql import functions as F

from veritrail import api, schemas
from veritrail.streaming import captures


def test_schemas(spark):
    assert len(schemas.KINDS) == 20
    for kind in schemas.KINDS:
        assert schemas.violations(spark.createDataFrame([], schemas.schema(kind)), kind).count() == 0


def test_row_rules(spark):
    rows = [("text-1", "text", "1", "a", "x", None, None), ("text-2", "text", "1", "a", "x", "text-2", ("n", "1", "h")), ("-bad", "text", "2", "a", "x", "t", None)]
    codes = {(r.id, r.code) for r in schemas.violations(spark.createDataFrame(rows, schemas.schema("text")), "text").collect()}
    assert codes == {("text-2", "text_cannot_transform_itself"), ("-bad", "invalid_id"), ("-bad", "unknown_schema_version"), ("-bad", "transformation_requires_source_and_version")}


def test_scripted_models(spark):
    requests = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "request string")
    receipts = requests.where("request = 'c'").select(F.sha2("request", 256).alias("work_key"))

    def decide(frame):
        return pd.DataFrame({"work_key": frame["work_key"], "label": ["yes" if r == "a" else "no" for r in frame["request"]], "allowed": [["yes", "no"]] * len(frame), "probabilities": [{"yes": 0.7, "no": 0.3}] * len(frame)})

    assert sorted((r.label, r.code) for r in api.decide(requests, receipts, decide).collect()) == [("no", "label_not_maximal"), ("yes", None)]
    generate = lambda frame: pd.DataFrame({"work_key": frame["work_key"], "answer": ['{"x": 1}'] * len(frame)})
    assert {r.status for r in api.generate(requests, receipts, generate, {"type": "object", "required": ["x"]}).collect()} == {"ok"}


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    for part in range(3):
        rows = spark.range(20).select(F.concat(F.lit("c"), F.col("id")).alias("id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("at"), F.lit("answer").alias("kind"))
        rows.coalesce(1).write.mode("append").parquet(source)
    stream = captures.each_once(captures.read_captures(spark, source, spark.read.parquet(source).schema), "id", "at")
    query = stream.writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("select count(*) n, count(distinct id) k from once").first() == (20, 20)
