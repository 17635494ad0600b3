"""Reliable cuts of lineage for the iterative operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder: the session's ``spark.checkpoint.dir``.

    A temporary folder of this machine is taken only where none is set and the session is local (tests); a
    cluster without the setting is an error, since executors would each write to their own disk.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="maskframe-checkpoint-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


class Cuts:
    """Tables written to the shared folder in place of lineage.

    A written table rather than ``checkpoint()``: a checkpoint keeps the estimated size of its plan, and
    sizes of joins multiply, so that after a dozen rounds planning alone takes minutes. A table has its true
    size, which also lets small rounds join by broadcast under the session's own threshold.

    A lazy result reads the last tables, so those stay until the program ends, and are deleted then.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths, self.made = spark, f"{checkpoint_dir(spark)}/maskframe-{uuid.uuid4().hex}", [], 0
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path, self._conf = jvm.org.apache.hadoop.fs.Path, conf
        atexit.register(self._at_exit)

    def path(self) -> str:
        """A new path below the operator's own folder."""
        self.made += 1
        return f"{self.root}/{self.made}"

    def cut(self, df: DataFrame) -> DataFrame:
        """The same rows, read from a table just written."""
        path = self.path()
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def counted(self, df: DataFrame, what: Column | None = None) -> tuple[DataFrame, int]:
        """As :meth:`cut`, with the number of rows (those that are ``what``), observed as they are written."""
        seen = Observation()
        done = self.cut(df.observe(seen, F.count_if(F.lit(True) if what is None else what).alias("n")))
        return done, seen.get["n"]

    def _delete(self, path: str) -> None:
        p = self._path(path)
        p.getFileSystem(self._conf).delete(p, True)

    def drop(self, *tables: DataFrame) -> None:
        """Delete the named tables, results of :meth:`cut`; nothing may read them any more."""
        for t in tables:
            for f in {f.rpartition("/")[0] for f in t.inputFiles()}:
                if f.split("/")[-2:] in [p.split("/")[-2:] for p in self.paths]:
                    self._delete(f)
                    self.paths = [p for p in self.paths if p.split("/")[-2:] != f.split("/")[-2:]]

    def drop_earlier(self) -> None:
        """Delete all tables but the last one written."""
        for path in self.paths[:-1]:
            self._delete(path)
        self.paths = self.paths[-1:]

    def _at_exit(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001 - the session's process may be gone; nothing is left to tell
            pass
