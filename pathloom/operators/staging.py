"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.shipping import ship

#: A side of a join is broadcast only when it is known to have at most this many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 16 << 20
#: Bytes of a value of each type of fixed size, with what a row of a hash table needs besides.
_WIDTHS = {"boolean": 8, "tinyint": 8, "smallint": 8, "int": 8, "bigint": 8, "float": 8, "double": 8, "date": 8, "timestamp": 8}
_ROW_BYTES = 16


_roots: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that is unset and all tasks run on this machine (master ``local``, as in tests) it is a
    temporary folder of the application's own; on a cluster, whose executors could not read
    that, it is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_already = sc._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = f"file://{tempfile.gettempdir()}/pathloom-{sc.applicationId}-{os.getpid()}"
    sc.setCheckpointDir(own)
    _roots.append((spark, own))
    return own


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _tidy() -> None:
    """Results that read stages end with the application, and so do the stages."""
    for spark, root in _roots:
        try:
            _delete(spark, root)
        except Exception:  # noqa: BLE001 - the application may be gone already
            return


class Stages:
    """Written intermediate tables of one run of an operator.

    ``put`` writes a table and reads it back, so that later plans start from files every
    executor can read; a lost executor costs only its own tasks.  ``drop`` deletes tables
    which no later step reads, ``keep`` all others than those given.  What is left is deleted
    when the application ends.
    """

    def __init__(self, spark: SparkSession, what: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        self.live: list[DataFrame] = []
        _roots.append((spark, self.root))

    def put(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = f"{self.root}/{self.n:03d}-{name}"
        self.n += 1
        schema = df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._stage_path = path
        self.live.append(out)
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = getattr(df, "_stage_path", None)
            if path is not None:
                _delete(self.spark, path)
                df._stage_path = None

    def keep(self, *frames: DataFrame) -> None:
        kept = {getattr(df, "_stage_path", None) for df in frames}
        self.drop(*(df for df in self.live if getattr(df, "_stage_path", None) not in kept))
        self.live = [df for df in self.live if df._stage_path]


def broadcast_if_small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows of ``most_bytes`` together, else
    unchanged.

    ``rows`` is its exact count where the caller knows it.  What isn't known is measured, reading
    no more than ``limit`` + 1 rows: the count, and the bytes of texts and nested values; values
    of fixed size count with their size.
    """
    loose = [c for c, kind in df.dtypes if kind not in _WIDTHS]
    fixed = _ROW_BYTES + sum(_WIDTHS.get(kind, 0) for _, kind in df.dtypes)
    if rows is not None and (rows > limit or rows * fixed > most_bytes):
        return df
    measured = 0
    if rows is None or loose:
        text = [F.octet_length(c) if kind == "string" else F.octet_length(F.to_json(F.struct(c))) for c, kind in df.dtypes if c in loose]
        total = sum((F.coalesce(x, F.lit(0)) + 8 for x in text), F.lit(0))
        got = df.limit(limit + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(total), F.lit(0)).alias("b")).first()
        rows, measured = got["n"], got["b"]
    return F.broadcast(df) if rows <= limit and rows * fixed + measured <= most_bytes else df
