"""Small helpers of the corpus operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words, without building them: the starts of words are counted."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, which driver and executors share."""
    import uuid

    from sessionloom.sources.tables import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def per_worker(key: tuple, build: Callable[[], object]):
    """An object that one Python worker builds once and keeps between its tasks."""
    kept = sys.modules.setdefault("_sessionloom_worker", types.ModuleType("_sessionloom_worker")).__dict__
    if key not in kept:
        kept[key] = build()
    return kept[key]


def look_up(seq: np.ndarray, ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token ids of a sequence of symbols, and where in them each symbol's begin, with their number at the end."""
    long = size[seq]
    starts = np.concatenate(([0], long.cumsum()))
    at = np.repeat(begin[seq] - starts[:-1], long)
    at += np.arange(len(at))
    return ids[at], starts
