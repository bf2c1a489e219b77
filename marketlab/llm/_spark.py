"""Session helpers of the corpus operators: scratch tables and table readers."""

from __future__ import annotations

import atexit
import gc
import os
import threading
import time
import uuid
from contextlib import contextmanager, suppress
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: While a table is written: a job's shuffle files go when it ends, since only the written table is read later, and batches sent to Python are small.
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}
#: Used only by a local master whose session names no spark.checkpoint.dir (tests, a single machine).
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints/marketlab"
_PAUSE = 10.0  # seconds between collections of the driver's garbage


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (have, root) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one Parquet table of a data folder, whatever file system it is in."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return LOCAL_CHECKPOINTS


_lock = threading.Lock()
_writers: dict[int, list] = {}  # of a session: how many write, and the setting before


@contextmanager
def _settings(spark: SparkSession):
    """SETTINGS hold while any table of a session is written; writers are counted, so parallel ones don't end them for each other."""
    with _lock:
        state = _writers.setdefault(id(spark), [0, None])
        if not state[0]:
            state[1] = {k: spark.conf.get(k, None) for k in SETTINGS}
            for k, v in SETTINGS.items():
                spark.conf.set(k, v)
        state[0] += 1
    try:
        yield
    finally:
        with _lock:
            state[0] -= 1
            if not state[0]:
                for k, v in state[1].items():
                    if v is None:
                        spark.conf.unset(k)
                    else:
                        spark.conf.set(k, v)


class Scratch:
    """Parquet tables in the shared checkpoint folder; they cut lineage and survive lost executors.

    ``keep`` writes a frame and returns it reread; ``drop`` deletes what nothing needs any more; ``finish`` writes a result and deletes
    all else. What is left then goes when the driver's Python ends.
    """

    _collected = 0.0

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.base = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self.live: set[str] = set()
        atexit.register(self.clear)

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        self.live.add(path)
        with _settings(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def _delete(self, path: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
        self.live.discard(path)

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self._delete(df._scratch_path)
        self.release()

    def retain(self, *frames: DataFrame) -> None:
        """Delete all tables but these."""
        for path in self.live - {df._scratch_path for df in frames}:
            self._delete(path)

    def finish(self, df: DataFrame) -> DataFrame:
        out = self.keep(df)
        self.retain(out)
        return out

    def clear(self) -> None:
        """Delete all tables, if the session is still there."""
        with suppress(Exception):
            if self.live:
                self._delete(self.base)
                self.live.clear()

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished jobs: it does so once the driver has collected what refers to them."""
        if time.monotonic() - Scratch._collected > _PAUSE:
            gc.collect()
            self.spark._jvm.System.gc()
            Scratch._collected = time.monotonic()
