"""Session, table and lineage helpers shared by the corpus operators."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only by a session of one machine that names no shared folder, as in local tests.
LOCAL_CHECKPOINT_DIR = "/tmp/checkpoints/finsheet"
#: Spark's own switch for dropping an execution's shuffle files at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of intermediate tables end in a hexadecimal name of their own.
OWN_FOLDER = re.compile(r"-[0-9a-f]{32}(?:/|$)")
#: At most so many keys are called hot, so they are small enough to send to every task whatever the input.
MOST_HOT = 4000
#: A table of so few rows fits into one task whatever its keys.
SMALL = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = LOCAL_CHECKPOINT_DIR
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage.

    Files in that folder outlive any executor, so a lost executor costs only a re-read. The step's shuffle files go when
    it is written, as nothing can read them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(schema).parquet(path)


def drop(*written: DataFrame) -> None:
    """Delete the files of tables that ``materialise`` or the pipeline wrote and nothing reads any more; others stay."""
    for df in written:
        spark = df.sparkSession
        for name in df.inputFiles()[:1]:
            folder = name.rsplit("/", 1)[0]
            if OWN_FOLDER.search(folder):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hot_join(left: DataFrame, right: DataFrame, on: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row a value of ``on`` and in ``count`` how often ``left`` has it.

    Values with more than a MOST_HOT-th of the ``total`` rows (there are fewer than MOST_HOT of them) are joined by
    sending those rows of ``right`` to every task, so no task gets all rows of a hot value. Both tables are read twice,
    so they should be written ones. ``how`` is inner or left_semi.
    """
    hot = right.where(F.col(count) > max(2000, total // MOST_HOT))
    if total <= SMALL or hot.isEmpty():
        return left.join(right, on, how)
    keys = F.broadcast(hot.select(on))  # fewer than MOST_HOT rows
    rest = left.join(keys, on, "left_anti").join(right.join(keys, on, "left_anti"), on, how)
    return rest.unionByName(left.join(F.broadcast(hot), on, how))


def documents_only(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns of ``docs``; extra columns, whatever their names, go no further."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def scaled_partitions(spark: SparkSession, factor: int = 1) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * factor)
