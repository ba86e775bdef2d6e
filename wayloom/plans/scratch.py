"""Written tables that cut lineage, in the folder the cluster shares.

The folder is the one named in ``spark.checkpoint.dir``. Where that is unset
and the master is local (tests) a temporary folder is made once for the session, set as its
checkpoint folder and removed when Python ends; on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        own = tempfile.mkdtemp(prefix="wayloom-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _OWN[app] = f"file://{own}"
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


class Scratch:
    """Tables of one operator run; ``cut`` writes one, ``drop`` removes one early."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str) -> str:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.mode("overwrite").parquet(path)
        self.paths[name] = path
        return path

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        return self.spark.read.schema(df.schema).parquet(self.write(df, name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(conf).delete(path, True)
