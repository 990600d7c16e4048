"""Helpers that the operators share: Arrow batches of texts, checkpoints, word rules."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Bytes 0-9, a-z and all of 0x80 up stay, A-Z become a-z, every other byte becomes a space.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a UTF-8 text with A-Z lower-cased; null has none.

    Every byte of a character beyond ASCII is 0x80 or more, so the byte rule is the code point rule.
    """
    return text.translate(WORD_TABLE).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a UTF-8 text with A-Z lower-cased; null has none."""
    return text.lower().split() if text else []


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only a local master (tests) may name none; it gets a folder of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            named = current.get()
        elif spark.sparkContext.master.startswith("local"):
            named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        else:
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Most rows of a looked-up table that is broadcast (a few MB), and parts of each key in a join beyond that.
MOST_BROADCAST, SALTS = 50_000, 32


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], n: int) -> DataFrame:
    """`rows` with the columns of `table`, which has `n` rows and each key once; null where it has none.

    A table of at most MOST_BROADCAST rows is broadcast. Beyond that the join is salted: every row of `table` goes to SALTS places
    and the rows of a key are dealt to these by their number, so that no key is one task's.
    """
    if n <= MOST_BROADCAST:
        return rows.join(F.broadcast(table), keys, "left")
    salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return rows.join(salted, [*keys, "__salt"], "left").drop("__salt")


def map_texts(
    df: DataFrame,
    text_col: str,
    carry: list[str],
    fields: list[T.StructField],
    fn: Callable[[list[bytes | None]], Iterable[pa.Array]],
    rows: int = 1000,
) -> DataFrame:
    """`carry` columns of every row and the columns `fields` that `fn` makes of the texts.

    `fn` gets the UTF-8 bytes of at most `rows` whole texts at a time. A carried column named like one of
    `fields` is replaced by it.
    """
    names = {f.name for f in fields}
    carry = [c for c in carry if c not in names]
    n = len(carry)
    source = df.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text_col}`").cast("string").alias("__text"))
    schema = T.StructType([*source.schema.fields[:n], *fields])
    out_names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                texts = part.column(n).cast(pa.large_binary()).to_pylist()
                made = list(fn(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *made], names=out_names)

    return source.mapInArrow(run, schema)
