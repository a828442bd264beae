"""Session helpers: the shared folder, tables cut out of a lineage, input spreading, joins on hot keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def local_session(cores: int | str = "*", name: str = "provenir", **conf: str) -> SparkSession:
    """A local session with adaptive execution on, for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session's spark.checkpoint.dir names it.

    Where the setting is absent, which only a local session can afford, a new
    temporary folder is made and set as this session's checkpoint folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = getattr(spark, "_provenir_dir", None)
    if made is None:
        made = "file://" + tempfile.mkdtemp(prefix="provenir-")
        spark.sparkContext.setCheckpointDir(made)
        spark._provenir_dir = made
    return made


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table into the shared folder and read it back.

    The result does not depend on df's lineage, so it outlives lost executors
    and is computed once however often it is used.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; release() deletes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def release(spark: SparkSession) -> None:
    """Delete the tables that cut() wrote for this session; frames that read them end with it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for owner, path in [x for x in _written if x[0] is spark]:
        target = hadoop.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        _written.remove((owner, path))


@atexit.register
def _release_all() -> None:
    for spark in {id(s): s for s, _ in _written}.values():
        try:
            if spark.sparkContext._jsc is not None:
                release(spark)
        except Exception:  # the session has ended before the interpreter
            pass


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a plain scan out evenly where it has fewer files and fewer bytes than the cluster's cores could take.

    The size comes from the scan's statistics, so nothing runs for it. Larger scans have splits for
    all cores and stay as they are, without a shuffle. Behind joins and groups adaptive execution
    sizes the partitions, so those are never put through this.
    """
    spark = scan.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes", "128m")))
    return scan if size >= cores * split or len(scan._jdf.inputFiles()) >= cores else scan.repartition(cores)


def blocked_join(left: DataFrame, right: DataFrame, key: list[str], block: int = 2000) -> DataFrame:
    """Inner join on key in which no task meets a hot key whole.

    The left rows of a key are dealt into blocks of about that many rows by their hashes and the
    right rows are copied to each block; keys of up to one block are joined as they are.
    """
    size = left.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("_blocks"))
    dealt = left.join(size, key).withColumn("_block", F.when(F.col("_blocks") == 1, 0).otherwise(F.pmod(F.xxhash64(*left.columns), F.col("_blocks")).cast("int")))
    copied = right.join(size, key).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.drop("_blocks").join(copied.drop("_blocks"), [*key, "_block"]).drop("_block")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
