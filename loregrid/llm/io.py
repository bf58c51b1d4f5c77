"""Reading inputs and cutting lineage where executors share storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """The column of this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def mapped(docs: DataFrame, given: list[StructField], added: list[StructField], run: Callable) -> DataFrame:
    """``mapInArrow`` from the columns ``given`` of ``docs`` to the same and ``added``, whatever their names.

    ``run`` gets and yields batches by position; it yields names c0, c1, ... for all of them.
    """
    short = [StructField(f"c{i}", f.dataType) for i, f in enumerate([*given, *added])]
    rows = docs.select(*(named(f.name).alias(c.name) for f, c in zip(given, short, strict=False)))
    return rows.mapInArrow(run, StructType(short)).toDF(*(f.name for f in [*given, *added]))


def free(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each with so many underscores before it that ``docs`` has no such column."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


def cut(df: DataFrame, small: bool = False) -> DataFrame:
    """A reliable checkpoint in the folder that the cluster names in spark.checkpoint.dir.

    Only where the setting is absent and the master is local, as in tests, a folder of this machine is set.
    A table that is ``small`` beside the input is written in an eighth of the shuffle partitions, 32 at least.
    """
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return (fewer(df) if small else df).checkpoint()


def fewer(df: DataFrame) -> DataFrame:
    """A table much narrower than the input in an eighth of the shuffle partitions, 32 at least."""
    return df.coalesce(max(32, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate results; a folder of this machine only for local masters without the setting."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="loregrid-checkpoint-")
    return named


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """(the rows read again, where they are): written as Parquet into a folder of their own in the shared folder."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
