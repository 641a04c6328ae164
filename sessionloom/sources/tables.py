"""Written tables: reuse when present, checkpoints, and CSV answers."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, by: str | None = None) -> DataFrame:
    """Write Parquet (optionally in directories of one column) and return the written table."""
    writer = df.write.mode("overwrite")
    if by:
        writer = writer.partitionBy(by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def present(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None. A write that broke off has no committed files and does not count."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    return None


def input_stamp(*frames: DataFrame) -> str:
    """What tables built from the frames depend on: names and sizes of their files, their rows, and a hash of those.

    The hash is a sum over rows, so it does not matter how the rows lie in partitions.
    """
    parts = []
    for df in frames:
        spark = df.sparkSession
        hashed = df.select(F.xxhash64(*[F.col(f"`{c}`").cast("string") if t.startswith("map") else F.col(f"`{c}`") for c, t in df.dtypes]).alias("h"))
        rows, total = hashed.agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
        files = []
        for name in sorted(df.inputFiles()):
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            files.append((name, path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()))
        parts.append((df.schema.simpleString(), files, rows, str(total)))
    return hashlib.sha256(repr(parts).encode()).hexdigest()


def reuse_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                   overwrite: bool = False, stamp: str | None = None) -> DataFrame:
    """The table at ``path`` if it is there, else the built one after writing it.

    With a ``stamp`` (see input_stamp) the table is there only if it was built under the same one; the
    stamp is written beside the table, after it.
    """
    found = None if overwrite else present(spark, path)
    if found is not None and stamp is not None:
        known = present(spark, f"{path}.stamp")
        if known is None or known.first()["stamp"] != stamp:
            found = None
    if found is not None:
        return found
    table = write_table(build(), path)
    if stamp is not None:
        write_table(spark.createDataFrame([(stamp,)], "stamp string"), f"{path}.stamp")
    return table


def first_sessions(df: DataFrame, n: int = 20) -> DataFrame:
    """The rows of the first n sessions by number, for small trial runs."""
    return df.join(df.select("session").distinct().orderBy("session").limit(n), "session", "left_semi")


def write_submission(df: DataFrame, path: str) -> None:
    """CSV with a header, one row per session and event."""
    df.select("session_type", "labels").write.mode("overwrite").option("header", True).csv(path)


def ranked_lists(matrix: DataFrame) -> DataFrame:
    """aid -> array of neighbours in rank order; a matrix has at most top-N rows per aid."""
    return matrix.groupBy("aid_x").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "aid_y"))), lambda p: p["aid_y"]).alias("aids")
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a scratch folder only for a local master."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir():
        return
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sessionloom-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a shared folder")


def cut_lineage(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a written folder through the file system that holds it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


class LiveState:
    """A frame that changes step by step, written after each: the newest version stays, the one before goes."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.steps = spark, scratch_folder(spark, name), 0

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.steps}"
        df.write.parquet(path)
        if self.steps:
            drop_folder(self.spark, f"{self.folder}/{self.steps - 1}")
        self.steps += 1
        return self.spark.read.schema(df.schema).parquet(path)
