"""Writers: fitted parameters, predictions and the three overwrite modes."""

from __future__ import annotations

import json
import uuid
from datetime import datetime
from enum import Enum

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomframe.sources.readers import DOCUMENT_END, document_record


class SinkMode(Enum):
    OVERWRITE = 1
    KEEP = 2
    BACKUP = 3


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) through Hadoop's API."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _hadoop(spark, path)
    return fs.exists(hadoop)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    fs, source = _hadoop(spark, old)
    if not fs.rename(source, _hadoop(spark, new)[1]):
        raise OSError(f"cannot rename {old} to {new}")


def _marker(path: str) -> str:
    return f"{path.rstrip('/')}.swap"


def finish_swap(spark: SparkSession, path: str) -> None:
    """Complete a swap that was begun: its marker says what goes where. Each step may have been done before.

    A marker that was not written to its end is no order: the old table is still in place.
    """
    fs, marker = _hadoop(spark, _marker(path))
    if not fs.exists(marker):
        return
    text = "".join(r["value"] for r in spark.read.text(_marker(path)).collect())
    try:
        order = json.loads(text)
    except ValueError:
        order = None
    if order and order.get("end"):
        if path_exists(spark, order["fresh"]):
            if path_exists(spark, path):
                _rename(spark, path, order["aside"])
            _rename(spark, order["fresh"], path)
        if not order["keep"]:
            fs.delete(_hadoop(spark, order["aside"])[1], True)
    fs.delete(marker, False)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table, after a swap that was cut off has been completed."""
    finish_swap(spark, path)
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, mode: SinkMode = SinkMode.OVERWRITE, now: datetime | None = None) -> str | None:
    """Write parquet. Returns the backup path when an existing output was kept aside.

    Rows are written once, next to the table; then directories are renamed, the old one to its backup (or away)
    and the new one into place. A marker file holds the order of the two steps: if the job ends between them, the next
    ``write_table`` or ``read_table`` completes the swap, so old or new rows are there, never neither. The frame may
    read the path it replaces. Renaming is one step on file systems such as HDFS; object stores copy instead.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    finish_swap(spark, path)
    if mode is SinkMode.KEEP and path_exists(spark, path):
        return None
    fresh = f"{path}.new-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    if not path_exists(spark, path):
        _rename(spark, fresh, path)
        return None
    keep = mode is SinkMode.BACKUP
    aside = f"{path}_{(now or datetime.now()).strftime('%H-%M-%S-%b-%d-%Y')}" if keep else f"{path}.old-{uuid.uuid4().hex}"
    if path_exists(spark, aside):
        raise FileExistsError(aside)
    fs, marker = _hadoop(spark, _marker(path))
    order = {"fresh": fresh, "aside": aside, "keep": keep, "end": True}
    stream = fs.create(marker, False)
    stream.write(bytearray(json.dumps(order).encode()))
    stream.close()
    finish_swap(spark, path)
    return aside if keep else None


def write_documents(df: DataFrame, category: str, text: str, path: str) -> None:
    """Texts in a folder ``<category>=<value>`` each, many to a file; ``read_documents(packed=True)`` reads them back.

    A task writes one file a folder, so files grow with the data instead of being as many as the documents.
    """
    records = df.select(category, document_record(F.col(text)).alias("value"))
    records.write.partitionBy(category).text(path, lineSep=DOCUMENT_END)


def write_predictions(df: DataFrame, folder: str, name: str, flag: str, now: datetime | None = None) -> str:
    """Predictions as headered CSV with the 0/1 column as true/false, the minute in the file name."""
    path = f"{folder}/{name}_{(now or datetime.now()).strftime('%Y-%m-%d-%H%M')}"
    df.withColumn(flag, F.col(flag).cast("boolean")).write.mode("overwrite").csv(path, header=True)
    return path


def save_params(params: DataFrame, path: str) -> None:
    """Fitted parameters are an ordinary small table."""
    params.write.mode("overwrite").parquet(path)


def load_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
