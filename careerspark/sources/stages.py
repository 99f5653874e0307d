"""Saved intermediate tables: named ones that later jobs load again, and those of a scope, which go when it ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for written tables that the cluster names in ``spark.checkpoint.dir``. A local session, with one machine,
    may go without: it gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="careerspark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage_path(spark: SparkSession, name: str, base: str | None = None) -> str:
    """Place of a saved table: under ``base``, or in the shared folder that the cluster names for checkpoints."""
    root = base or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("no folder for saved tables: set spark.checkpoint.dir or give base")
    return f"{root.rstrip('/')}/stages/{name}"


def save_stage(df: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """Writes the table as Parquet and returns it read back, so later work starts from the files."""
    path = stage_path(df.sparkSession, name, base)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load_stage(spark: SparkSession, name: str, base: str | None = None) -> DataFrame:
    return spark.read.parquet(stage_path(spark, name, base))


class Stages:
    """A registry of written tables that are removed together: ``with Stages(spark) as stages: t = stages.keep(df)``.

    A table is written once for its content: a plan that means the same as an earlier one, over files that have not changed
    since, gets the earlier table. Plans that can give other rows each time are always written. Results that read
    the tables must be computed before the scope ends.
    """

    def __init__(self, spark: SparkSession, base: str | None = None):
        self.spark, self.base = spark, base
        self._kept: dict[int, list[tuple[DataFrame, tuple, DataFrame]]] = {}
        self._paths: list[str] = []

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, *_) -> None:
        self.remove()

    @property
    def paths(self) -> list[str]:
        """Where the tables of the scope lie."""
        return list(self._paths)

    def keep(self, df: DataFrame, name: str = "stage") -> DataFrame:
        """The table read from a file of the scope, which is written if no earlier one holds the same."""
        fixed = df._jdf.queryExecution().analyzed().deterministic()
        seen = self._kept.setdefault(df.semanticHash(), []) if fixed else []
        files = self._files(df) if fixed else ()
        for earlier, earlier_files, table in seen:
            if earlier_files == files and earlier.sameSemantics(df) and earlier.schema == df.schema:
                return table
        table = self.write(df, name)
        seen.append((df, files, table))
        return table

    def write(self, df: DataFrame, name: str = "stage") -> DataFrame:
        """The table written as a new file of the scope, and read from it."""
        path = f"{(self.base or shared_folder(self.spark)).rstrip('/')}/stages/{name}-{uuid.uuid4().hex}"
        self._paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _files(self, df: DataFrame) -> tuple:
        """Path, size and time of the files that a table is read from."""
        found = []
        for f in sorted(df.inputFiles()):
            status = self._system(f)[0].getFileStatus(self._system(f)[1])
            found.append((f, status.getLen(), status.getModificationTime()))
        return tuple(found)

    def _system(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), place

    def remove(self) -> None:
        """Deletes the tables of the scope."""
        for path in self._paths:
            system, place = self._system(path)
            system.delete(place, True)
        self._paths, self._kept = [], {}


_sessions: dict[str, Stages] = {}


def session_stages(spark: SparkSession) -> Stages:
    """The registry of tables that results still to be computed may read: they go when the driver's program ends."""
    name = spark.sparkContext.applicationId
    if name not in _sessions:
        _sessions[name] = Stages(spark)
        atexit.register(_leave, _sessions[name])
    return _sessions[name]


def _leave(stages: Stages) -> None:
    if stages.spark.sparkContext._jsc is not None:     # a session that was stopped before has no file system to ask
        stages.remove()
