"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as Java regex and as a trim set.
WHITE = r"[\x20\x09-\x0D]+"
WHITE_SET = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only in local mode, where that may be unset, is a folder made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyweave-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


_made: set[str] = set()


#: Rows up to which a side of a join of a few words a row is sent to every executor, after it was counted.
SMALL = 1_000_000


def if_small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows (it is counted); else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def written(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """``df`` as a table in the shared folder: computed once, its lineage cut, safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyweave-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_drop_all, spark)
    _made.add(path)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing reads any more."""
    path = getattr(df, "written_path", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _made.discard(path)


def _drop_all(spark: SparkSession) -> None:
    for path in list(_made):
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended already
            return


_shipped: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Send this package to the executors, which need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="tallyweave-"), "tallyweave.zip")
    with zipfile.ZipFile(path, "w") as out:
        for at, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    out.write(full := os.path.join(at, name), os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` after sending this package to the executors."""
    shipped(df.sparkSession)
    return df.mapInArrow(run, schema)


def words(text: Column) -> Column:
    """Array of the maximal runs of characters other than white space; empty for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE_SET))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = f"_{name}"
    return name
