"""Tables written to the folder that all executors share, and how long they stay."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

#: The tables that the innermost call of a scoped function has written.
_open: ContextVar[list | None] = ContextVar("tables", default=None)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where none is set, a new folder in local mode, and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes with the scope around it."""
    path = f"{shared_folder(spark)}/quillon/{name}-{uuid.uuid4().hex}"
    if _open.get() is not None:
        _open.get().append((spark, path))
    return path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a table in the shared folder, read again. options (with _ for .): the Parquet writer's.

    It cuts the lineage, survives a lost executor, is computed once however often it is read, and its size is
    known to the planner, which broadcasts it only below spark.sql.autoBroadcastJoinThreshold.
    """
    path = new_path(df.sparkSession, name)
    df.write.options(**{k.replace("_", "."): v for k, v in options.items()}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _read_by(df: DataFrame) -> Iterator[str]:
    """Names of the folders that df's plan reads."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for i in range(leaves.size()):
        if leaves.apply(i).getClass().getSimpleName() == "LogicalRelation":
            roots = leaves.apply(i).relation().location().rootPaths()
            yield from (roots.apply(j).getName() for j in range(roots.size()))


def deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the files of shuffles that no table needs any more: it does so once the driver's JVM has
    noticed, which else may take as long as a whole job."""
    spark._jvm.System.gc()


@contextmanager
def scope() -> Iterator[list]:
    """Tables written inside are deleted at its end, but for those that the results, put into the list given, still
    read. These pass to the scope around it, if there is one."""
    mine, results = [], []
    outer = _open.get()
    token = _open.set(mine)
    try:
        yield results
    except BaseException:
        results.clear()
        raise
    finally:
        _open.reset(token)
        kept = {name for r in results for name in _read_by(r)}
        for spark, path in mine:
            if path.rsplit("/", 1)[1] not in kept:
                deleted(spark, path)
            elif outer is not None:
                outer.append((spark, path))


def scoped(f: Callable) -> Callable:
    """f in a scope() of its own. f returns a table, several, or something else that reads none."""

    @wraps(f)
    def run(*args, **named):
        with scope() as results:
            out = f(*args, **named)
            results += [x for x in (out if isinstance(out, tuple) else (out,)) if isinstance(x, DataFrame)]
        return out

    return run


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings (with _ for .) of the session for as long as it lasts: for what runs inside, not for what is planned there."""
    names = {k: k.replace("_", ".") for k in values}
    before = {k: spark.conf.get(n, None) for k, n in names.items()}
    try:
        for k, v in values.items():
            spark.conf.set(names[k], v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(names[k]) if v is None else spark.conf.set(names[k], v)
