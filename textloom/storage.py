"""Folders that driver and executors share, and small files in them, on any file system that Spark reads."""

from __future__ import annotations

import atexit
import hashlib
import json
import tempfile

from pyspark.sql import SparkSession

_LOCAL: tempfile.TemporaryDirectory | None = None


def shared_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; a temporary one where all runs on one machine and that is unset."""
    global _LOCAL
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None)
    if not root:
        master = conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if _LOCAL is None:
            _LOCAL = tempfile.TemporaryDirectory(prefix="textloom-")
            atexit.register(_LOCAL.cleanup)
        root = "file://" + _LOCAL.name
    return f"{root.rstrip('/')}/textloom/{spark.sparkContext.applicationId}"


class Folder:
    """A folder of numbered JSON states; a state is there as a whole or not at all, and each number is taken once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._of = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._of(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def state(self) -> tuple[int, dict | None]:
        """Number and content of the newest state; (0, None) before the first."""
        found = self._fs.globStatus(self._of(f"{self.path}/_state-*.json"))
        names = [] if found is None else [s.getPath().getName() for s in found]
        if not names:
            return 0, None
        newest = max(int(n[7:-5]) for n in names)
        stream = self._fs.open(self._of(f"{self.path}/_state-{newest}.json"))
        try:
            return newest, json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def commit(self, number: int, state: dict) -> None:
        """Write the state after ``number``; if another writer was first that is an error and nothing changes."""
        whole, part = self._of(f"{self.path}/_state-{number + 1}.json"), self._of(f"{self.path}/_part-{hashlib.sha256(json.dumps(state).encode()).hexdigest()}")
        stream = self._fs.create(part, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if self._fs.exists(whole) or not self._fs.rename(part, whole):
            self._fs.delete(part, False)
            raise RuntimeError(f"{self.path} was changed by another writer")

    def drop(self, name: str) -> None:
        self._fs.delete(self._of(f"{self.path}/{name}"), True)


def fingerprint(spark: SparkSession, path: str) -> str:
    """What tells one content of a path from another: its name, size and time."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return hashlib.sha256(f"{path} {fs.getContentSummary(at).getLength()} {fs.getFileStatus(at).getModificationTime()}".encode()).hexdigest()[:16]
