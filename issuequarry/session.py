"""Session factory and the shared scratch folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


SHUFFLE_FILES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN: dict[str, str] = {}  # folders of local sessions that name none


def get_session(app: str = "issuequarry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Kryo; other settings stay with the cluster."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local[...] session that names none gets a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = _OWN.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="issuequarry-")
        _OWN[spark.sparkContext.applicationId] = where
    return where.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder. They cut lineage, survive lost executors and are read with pruned columns."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n, self.kept = 0, []

    def keep(self, df: DataFrame) -> DataFrame:
        """Write df and return the written table."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        before = self.spark.conf.get(SHUFFLE_FILES, "false")
        self.spark.conf.set(SHUFFLE_FILES, "true")  # what was shuffled for a table goes as soon as the table is written
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(SHUFFLE_FILES, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        self.kept.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables that nothing reads any more."""
        jvm, jsc = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t.scratch_path)
            p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)

    def drop_but(self, *tables: DataFrame) -> None:
        """Delete what has been written so far except these tables, which the caller's result still reads."""
        left = {t.scratch_path for t in tables}
        self.drop(*[t for t in self.kept if t.scratch_path not in left])
        self.kept = list(tables)
