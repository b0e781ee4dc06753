"""Session set-up and the shared scratch area.

Iterative operators cut their lineage by writing a parquet table below the folder that the
session names in ``spark.checkpoint.dir``. That folder is shared by all executors, so a lost
executor never loses an intermediate result.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Else a query's shuffle files stay until the driver happens to collect its garbage.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Largest side, in rows, that an operator broadcasts after having counted it.
BROADCAST_ROWS = 100_000
#: And in bytes of its texts and numbers.
BROADCAST_BYTES = 32 << 20

_own_folders: dict[str, str] = {}
_written: dict[str, list[str]] = {}
_shared: dict[tuple[str, str, str], tuple[str, T.StructType]] = {}


def local_session(cores: str = "8", *, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A single-machine session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidegraph")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Only a local session without the setting gets a folder of its own; on a cluster the setting
    is required, because a machine-local folder would not survive the loss of that machine.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY, None)
    if named:
        return named.rstrip("/")
    set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get().rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own_folders:
        _own_folders[key] = tempfile.mkdtemp(prefix="tidegraph-")
        atexit.register(shutil.rmtree, _own_folders[key], ignore_errors=True)
    return "file://" + _own_folders[key]


class Scratch:
    """Intermediate tables of one operator run, each written once and read many times."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"
        _written.setdefault(spark.sparkContext.applicationId, []).append(self.root)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table; its lineage ends here, and its shuffle files are deleted at once."""
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(CLEANUP_KEY, None)
        self.spark.conf.set(CLEANUP_KEY, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP_KEY) if before is None else self.spark.conf.set(CLEANUP_KEY, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, build: Callable[[], DataFrame], name: str) -> DataFrame:
        """Write what ``build`` returns and delete the intermediate tables that it wrote on the way, other than shared ones."""
        made = _written[self.spark.sparkContext.applicationId]
        before = len(made)
        out = self.table(build(), name)
        for root in made[before:]:
            if not root.rpartition("/")[2].startswith("shared-"):
                delete_path(self.spark, root)
                made.remove(root)
        return out

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        delete_path(self.spark, f"{self.root}/{name}")


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """Names, lengths and times of the files of some tables, by which a change of them is seen."""
    found = []
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found += sorted(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}" for f in fs.listStatus(p))
    return "|".join(found)


def shared_table(spark: SparkSession, name: str, inputs: Sequence[str], build: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries of a session read: written once for the same input files, until ``clear_scratch``."""
    key = (spark.sparkContext.applicationId, name, fingerprint(spark, *inputs))
    if key not in _shared or not path_exists(spark, _shared[key][0]):
        scratch = Scratch(spark, f"shared-{name}")
        written = scratch.table(build(), name)
        _shared[key] = (f"{scratch.root}/{name}", written.schema)
    path, schema = _shared[key]
    return spark.read.schema(schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, on whatever file system the path names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def list_names(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """What follows ``prefix`` in the names of a folder's entries; nothing if there is no folder."""
    if not path_exists(spark, folder):
        return []
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    names = [f.getPath().getName() for f in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]
    return sorted(n.removeprefix(prefix) for n in names if n.startswith(prefix))


def delete_path(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application.

    Results are lazy and read them, so call this once the results have been written elsewhere.
    """
    for key in [k for k in _shared if k[0] == spark.sparkContext.applicationId]:
        del _shared[key]
    for folder in _written.pop(spark.sparkContext.applicationId, []):
        delete_path(spark, folder)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast only if it has at most ``limit`` rows of ``limit_bytes`` in all; otherwise leave the join to the planner."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    width = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in texts), F.lit(16 * len(df.columns)))
    size = df.select(width.cast("bigint").alias("w")).limit(limit + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("w"), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if size["n"] <= limit and size["b"] <= limit_bytes else df
