"""Session helpers: building a local session, and a folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "longweave", cpus: int | None = None, **conf: str) -> SparkSession:
    """A session for tests, benches and single-node use; clusters bring their own."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    base = {
        "spark.master": f"local[{cpus}]",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    spark = SparkSession.builder.appName(app).config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; on a local master alone a temporary one where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="longweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths written by :func:`saved` inside the innermost :func:`scratch`, if there is one.
_OPEN: list[list[str]] = []


def saved(df: DataFrame, label: str = "step") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    This cuts the lineage: a lost executor costs no recomputation of what came before, and what
    reads the table more than once doesn't compute it more than once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is saved inside is deleted at the end, but for the saved tables passed to the function that this gives."""
    made: list[str] = []
    _OPEN.append(made)

    def keep(df: DataFrame) -> DataFrame:
        made.remove(df._saved_at)
        if len(_OPEN) > 1:
            _OPEN[-2].append(df._saved_at)
        return df

    try:
        yield keep
    finally:
        _OPEN.remove(made)
        for path in made:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def drop_saved(df: DataFrame) -> None:
    """Delete what :func:`saved` wrote for ``df``; later reads of it fail."""
    path = getattr(df, "_saved_at", None)
    if path:
        _delete(df.sparkSession, path)


def replace_tables(tables: dict[str, DataFrame]) -> None:
    """Write tables, by path, that may read what is at any of these paths: all beside the old ones first, then renamed."""
    for path, df in tables.items():
        df.write.mode("overwrite").parquet(path + ".new")
    for path, df in tables.items():
        spark = df.sparkSession
        _delete(spark, path)
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path + ".new")
        if not p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).rename(p, jvm.org.apache.hadoop.fs.Path(path)):
            raise OSError(f"can't rename {path}.new")


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)
