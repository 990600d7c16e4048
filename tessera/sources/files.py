"""Objects stored as files of any file system that pyarrow knows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local master alone may do without: one of its own is made there."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
    return tempfile.mkdtemp(prefix="spark-stream-")


def file_names(objects: DataFrame, uid: str, order: str) -> DataFrame:
    """Adds `name`: the UID with other characters than letters, digits and dots as `_`; equal ones are numbered from the second on."""
    safe = F.regexp_replace(F.coalesce(F.col(uid), F.lit("unnamed")), r"[^\p{Alnum}.]", "_")
    own = objects.withColumn("name", safe)
    k = F.row_number().over(Window.partitionBy("name").orderBy(order))
    return own.withColumn("__k", k).withColumn("name", F.concat("name", F.when(F.col("__k") > 1, F.concat(F.lit("-"), (F.col("__k") - 1).cast("string"))).otherwise(""), F.lit(".dcm"))).drop("__k")


def save_files(objects: DataFrame, folder: str, name: str = "name", content: str = "content") -> int:
    """Write each row's content under its name; gives the number of files.

    A file is written under a name of its own and moved, so a task that is run again replaces what it wrote before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root)
        for batch in batches:
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = f"{root}/.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(c or b"")
                system.move(part, f"{root}/{n}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return objects.select(name, content).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
