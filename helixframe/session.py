"""Sessions, and what operators need of them."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parents[1])


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    conf = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
    }
    return SparkSession.builder.master(f"local[{cpus}]").appName("helixframe").config(map=conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, also where only the driver's ``sys.path`` has it."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, have)])


def apart(df: DataFrame, *keys: str, most: int | None = None) -> DataFrame:
    """``df`` by ``keys`` in a stated number of partitions, up to ``most``: groups of few bytes and long work must not be put together
    in one task."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return df.repartition(n if most is None else min(n, most), *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, set to a new one only where the session has none and runs on this machine."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        path = sc.getCheckpointDir()
        if path is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = f"file://{tempfile.mkdtemp(prefix='helixframe-')}"
            sc.setCheckpointDir(path)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


class Scratch:
    """Tables written under the shared folder, dropped when the session's process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def _end(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone
            self.drop()

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it again with its own schema."""
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def measured(self, df: DataFrame, name: str) -> tuple[DataFrame, int, int]:
        """``table`` with its rows, counted as they are written, and the bytes of its files."""
        seen = Observation()
        out = self.table(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
        fs, at = self._files(name)
        return out, seen.get["rows"], fs.getContentSummary(at).getLength()

    def _files(self, name: str | None):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def drop(self, name: str | None = None) -> None:
        fs, at = self._files(name)
        fs.delete(at, True)
