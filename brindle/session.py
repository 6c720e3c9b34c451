"""Session helpers: table access and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _importable(spark: SparkSession) -> None:
    """Python workers find this package where the driver does, also if neither it is installed nor the driver was started
    beside it. On a cluster that needs the folder on all machines; otherwise install the package there."""
    env, root = spark.sparkContext.environment, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root not in f"{os.environ.get('PYTHONPATH', '')}:{env.get('PYTHONPATH', '')}".split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH")) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory (a file or a directory of part files)."""
    _importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``; a local session without that setting gets a folder of its own,
    once. On anything but a local master a missing setting is an error, since a machine-local folder would be lost.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
    own = os.path.join(tempfile.gettempdir(), f"brindle-{sc.applicationId}")
    if not os.path.isdir(own):
        os.makedirs(own, exist_ok=True)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


_OPEN: list[tuple[str, "Stage"]] = []


class Stage:
    """Tables written to the shared folder in order to cut lineage, or to read a costly result more than once.

    ``put`` writes and reads back; ``drop`` removes tables that no later plan reads, ``close`` all that are left. What a
    returned lazy DataFrame still needs must not be dropped before its rows are written: ``release`` then clears what
    the session's operators have left.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        _importable(spark)
        self.base = f"{shared_dir(spark).rstrip('/')}/brindle-stage/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        _OPEN.append((spark.sparkContext.applicationId, self))

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self._n}"
        self._n += 1
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._brindle_path = path
        return out

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            path = getattr(df, "_brindle_path", None)
            if path is not None:
                self._delete(path)
                df._brindle_path = None

    def close(self) -> None:
        if self._n:
            self._delete(self.base)
        self._n = 0


def release(spark: SparkSession) -> int:
    """Drops the tables that operators of this application have left for lazy results; call it once those are written.
    Returns how many stages had any."""
    own = [s for app, s in _OPEN if app == spark.sparkContext.applicationId and s._n]
    for s in own:
        s.close()
    _OPEN[:] = [(app, s) for app, s in _OPEN if app != spark.sparkContext.applicationId]
    return len(own)
