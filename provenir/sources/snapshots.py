"""Snapshots of repositories: commit folders, blobs out of clones, caches by fingerprint, stored models by key."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.operators.audits import largest_key

#: Readers of clones that one task keeps open at a time.
READERS = 4


def discover_snapshots(spark: SparkSession, root: str, sources: tuple[str, ...] = ("treatment", "control"), suffix: str = ".py") -> DataFrame:
    """(dataset_source, repo, commit, files) of the commit folders <root>/<source>/<repo>/<commit>/ that hold files with the suffix; other folders are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root).select("path")
    part = lambda k: F.regexp_extract("path", rf"/({'|'.join(sources)})/([^/]+)/([0-9a-f]{{7,40}})/[^/]", k)
    rows = files.select(part(1).alias("dataset_source"), part(2).alias("repo"), part(3).alias("commit")).where("commit <> ''")
    return rows.groupBy("dataset_source", "repo", "commit").agg(F.count("*").alias("files"))


class BlobReader:
    """One git process for a clone that answers for any number of blobs."""

    def __init__(self, clone: str):
        self.process = subprocess.Popen(["git", "-C", clone, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)

    def read(self, commit: str, path: str) -> bytes | None:
        """The file's bytes at the commit, or None where there is no such file. A line end in a path is an error."""
        if "\n" in commit or "\n" in path:
            raise ValueError("line end in a blob's name")
        self.process.stdin.write(f"{commit}:{path}\n".encode())
        self.process.stdin.flush()
        head = self.process.stdout.readline().split()
        if len(head) != 3 or head[1] != b"blob":
            if len(head) == 3 and head[2].isdigit():  # another kind of object: its bytes are passed over
                self.process.stdout.read(int(head[2]) + 1)
            return None
        return self.process.stdout.read(int(head[2]) + 1)[:-1]

    def close(self) -> None:
        self.process.stdin.close()
        self.process.wait()


def read_blobs(wanted: DataFrame) -> DataFrame:
    """wanted (clone, commit, path) with the file's text; null where the clone has no such file.

    Rows of a clone come together and in order, so a task opens each clone's reader once and
    keeps READERS of them at most; a clone that is wanted very often is dealt over its commits.
    """
    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: dict[str, BlobReader] = {}
        try:
            for part in parts:
                texts = []
                for clone, commit, path in zip(part["clone"], part["commit"], part["path"]):
                    if clone not in open_:
                        if len(open_) >= READERS:
                            open_.pop(next(iter(open_))).close()
                        open_[clone] = BlobReader(clone)
                    else:
                        open_[clone] = open_.pop(clone)  # the one used last goes last
                    found = open_[clone].read(commit, path)
                    texts.append(None if found is None else found.decode("utf-8", "replace"))
                yield part[["clone", "commit", "path"]].assign(text=pd.Series(texts, dtype=object).to_numpy())
        finally:
            for reader in open_.values():
                reader.close()

    kept = wanted.where("clone is not null and commit is not null and path is not null").select("clone", "commit", "path").distinct()
    cores = kept.sparkSession.sparkContext.defaultParallelism
    return kept.repartition(4 * cores, "clone", "commit").sortWithinPartitions("clone", "commit", "path").mapInPandas(work, "clone string, commit string, path string, text string")


def cached(make, path: str, fingerprint: str, spark: SparkSession) -> DataFrame:
    """What make() gives, kept as a table under path and the fingerprint of its inputs: made once, read again while the fingerprint is the same."""
    place = f"{path.rstrip('/')}/{fingerprint}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)


def load_estimator(spark: SparkSession, root: str, prefix: str):
    """The stored pipeline with the prefix and the largest size in its name, and that name; stored models are Spark's own, never pickles."""
    from pyspark.ml import PipelineModel

    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    listed = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hadoop)
    names = [(s.getPath().getName(),) for s in listed if s.isDirectory()]
    found = largest_key(spark.createDataFrame(names, "key string"), "key", prefix).first()
    if found is None:
        raise ValueError(f"no model below {root} begins with {prefix}")
    return PipelineModel.load(f"{root.rstrip('/')}/{found['key']}"), found["key"]
