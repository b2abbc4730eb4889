"""Tables between steps, in the folder that the cluster shares."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import shared_dir

#: Tables of the innermost passing() that is open.
_open: ContextVar[list[DataFrame] | None] = ContextVar("open", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/logweir/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage, and outlives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._logweir_path = path
    if (tables := _open.get()) is not None:
        tables.append(out)
    return out


@contextmanager
def passing():
    """Tables that are written inside are deleted at the end, but for those that were given to kept().

    Nothing that is read later may depend on the others: what goes out must be kept, which is
    written itself, or be collected. If the work fails, all of them go.
    """
    tables: list[DataFrame] = []
    mark = _open.set(tables)
    try:
        yield
    except BaseException:
        _open.reset(mark)
        drop(*tables)
        raise
    _open.reset(mark)
    drop(*[df for df in tables if not getattr(df, "_logweir_kept", False)])
    if (outer := _open.get()) is not None:
        outer.extend(df for df in tables if getattr(df, "_logweir_kept", False))
        for df in tables:
            df._logweir_kept = False  # the outer one decides anew


def kept(df: DataFrame) -> DataFrame:
    """A table of written() that outlives the innermost passing()."""
    df._logweir_kept = True
    return df


def drop(*tables: DataFrame) -> None:
    """Deletes tables of written() that no later read needs; those that are gone already don't matter."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._logweir_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes all tables of the session's folder. Nothing that was built on them may be read after."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/logweir")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows. For a table of written() the file footers tell."""
    return df.count() <= rows
