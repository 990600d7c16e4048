"""Streams of tables that are one file, a folder of part files, or not there."""

import pytest
from pyspark.sql import functions as F

from tessera.streaming import messages


@pytest.mark.parametrize("parts", [1, 3])
def test_a_table_written_as_a_folder_is_streamed_whole(spark, tmp_path, parts):
    turns = spark.range(60).select((F.col("id") % 4).alias("conv"), F.col("id").alias("turn"), F.col("id").cast("string").alias("text"), (F.col("id") % 12 >= 8).alias("last"))
    turns.repartition(parts).write.parquet(str(tmp_path / "turns.parquet"))
    turns.write.parquet(str(tmp_path / "other.parquet"))
    stream = messages.message_stream(spark, str(tmp_path), turns.schema, "turns.parquet")
    out = messages.run_available(messages.assembled(stream, "conv", "turn", "text", "last"), str(tmp_path / "out"))
    assert sorted((r.association, r.message, r.parts, r.data) for r in out.collect()) == sorted((c, m, 3, "".join(str(c + 12 * m + 4 * k) for k in range(3))) for c in range(4) for m in range(5))


def test_a_table_of_one_file_is_streamed(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "made"))
    next((tmp_path / "made").glob("part-*")).rename(tmp_path / "one.parquet")
    out = messages.run_available(messages.message_stream(spark, str(tmp_path), spark.range(1).schema, "one.parquet"), str(tmp_path / "out"))
    assert sorted(r.id for r in out.collect()) == [0, 1, 2, 3, 4]


def test_a_stream_without_files_gives_no_rows(spark, tmp_path):
    stream = messages.message_stream(spark, str(tmp_path), spark.range(1).schema, "none.parquet")
    out = messages.run_available(stream, str(tmp_path / "out"), lambda b: b.withColumn("twice", F.col("id") * 2))
    assert out.columns == ["id", "twice"] and out.count() == 0
