"""Input tables, written tables and batch sizes shared by the operators."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfmart.session import shared_dir

# Rows that Spark hands to a Python function at once; texts can be long, so batches stay small.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the folder all executors share and read it back: later steps start from the written rows,
    whatever executors are lost. The folder is new for every call."""
    path = f"{shared_dir(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch, and with them the memory of a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, to size partitions by."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def ranges(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after another."""
    ends = np.cumsum(lengths, dtype=np.int64)
    out = np.repeat(begin - (ends - lengths), lengths)
    out += np.arange(len(out))
    return out
