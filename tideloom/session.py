"""Session set-up and the shared folder for cut lineages and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "tideloom", partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="tideloom-wh-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only where the setting is absent and the master is local (tests) a folder of this machine is used.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rsplit("/", 1)[0]
    master = conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="tideloom-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path of its own in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hpath)  # only what exists can be marked
    fs.deleteOnExit(hpath)
    return path


#: Whether the shuffle files of a statement go when it ends, instead of when the driver happens to collect its garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, what: str, partition_by: list[str] | None = None, instead_of: DataFrame | None = None, tidy: bool = False) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again. Survives the loss of executors. The files of `instead_of`, an
    earlier result of this function that nothing needs any more, are deleted once the new ones are there. `tidy` for large
    results: shuffle files go as soon as the result is written, which is packed closer."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if tidy:
        before = spark.conf.get(_TIDY, None)
        spark.conf.set(_TIDY, "true")
        try:
            writer.option("compression", "zstd").parquet(path)
        finally:
            spark.conf.unset(_TIDY) if before is None else spark.conf.set(_TIDY, before)
    else:
        writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    old = getattr(instead_of, "scratch", None)
    if old:
        delete_path(spark, old)
    return out


def discard(*results: DataFrame) -> None:
    """Delete the files of results of materialise() that nothing needs any more."""
    for df in results:
        delete_path(df.sparkSession, df.scratch)


def delete_path(spark: SparkSession, path: str) -> None:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
