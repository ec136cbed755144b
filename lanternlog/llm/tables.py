"""Written intermediate tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lanternlog import session

#: Folders written by the operators that are at work, innermost last.
_written: list[list[str]] = []
#: Has Spark remove the shuffle files of a command that has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the cluster's shared folder and read it back.

    Lineage ends there, an executor lost later costs nothing, each input is computed once, and the
    planner knows the table's size, so it broadcasts it only where it is small. What was shuffled to make
    it goes at once: else it stays until the driver happens to collect its garbage, all steps' together.
    """
    spark = df.sparkSession
    path = session.work_dir(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    if _written:
        _written[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def done(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more, before their operator ends."""
    for table in tables:
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            remove(table.sparkSession, folder)


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def tidy(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator that removes, when its plan is made, the tables it wrote and its result does not read."""

    @wraps(make)
    def run(*args, **kwargs) -> DataFrame:
        _written.append([])
        try:
            out = make(*args, **kwargs)
        finally:
            own = _written.pop()
        read = out.inputFiles()
        for path in own:
            name = path.rsplit("/", 1)[-1]
            if not any(f"/{name}/" in file for file in read):
                remove(out.sparkSession, path)
            elif _written:
                _written[-1].append(path)  # whoever called this operator may be done with it
        return out

    return run
