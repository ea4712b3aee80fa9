"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words wherever an operator speaks of words.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable copy in the folder that spark.checkpoint.dir names; where it is unset, a local master gets a folder of its own and a cluster an error."""
    context = df.sparkSession.sparkContext
    if not (df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def release(df: DataFrame) -> None:
    """Has Spark delete the shuffle files, and where so configured the checkpoints, that nothing refers to any more; else they stay until the driver's next collection of garbage."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def let(value: Column, body) -> Column:
    """body(value) with value computed once, whatever Catalyst inlines."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: at most so many characters in column `text`, or one row."""
    for batch in batches:
        sizes = [0 if n is None else n for n in pa.compute.utf8_length(batch.column(batch.schema.get_field_index(text))).to_pylist()]
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """Column `name`, null as the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]
