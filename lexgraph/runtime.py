"""Session-level helpers shared by every operator: table access and lineage cuts."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Open one parquet table of the data directory (a file or a directory of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The registry: tables that may be named from outside.
TABLES = ("node", "edge", "source_span", "graph_edge", "llm_reference_resolution", "embedding", "canonical_guidance_document", "document_source", "documents", "record_tombstone", "guidance_group", "source_trust")


def registered(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by a name that comes from outside: only names of the registry are opened."""
    if name not in TABLES:
        raise ValueError(f"no such table: {name!r}")
    return table(spark, sf_dir, name)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared checkpoint folder; set a private one only in local mode, where none is named.

    On a cluster without a named folder this is an error: what executors write to their own disks, others don't find.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if named:
        sc.setCheckpointDir(named)
        return named
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="lexgraph-checkpoint-")
    atexit.register(shutil.rmtree, folder, True)
    sc.setCheckpointDir("file://" + folder)
    return folder


_HELD: dict[str, SparkSession] = {}


def release(spark: SparkSession | None = None) -> None:
    """Delete the tables that cut() wrote (of one session): call it when results have been read or written.

    It also happens when the driver's Python ends and, for tables in plain folders, after the session has ended.
    """
    for path, owner in list(_HELD.items()):
        if spark is not None and owner is not spark:
            continue
        del _HELD[path]
        _delete(owner, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended before  # noqa: BLE001
        shutil.rmtree(re.sub("^file:/*", "/", path), ignore_errors=True)


atexit.register(release)


def scratch(spark: SparkSession, name: str = "lexgraph") -> str:
    """A new folder for intermediate data in the shared checkpoint folder, deleted by release()."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _HELD[path] = spark
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as a table in the shared checkpoint folder and read that.

    Like a checkpoint it survives the loss of executors; in contrast to one its columns can be pruned, its size is
    known to the planner, and it carries no partitioning that a later join could misread.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def gathered(rounds: Iterable[DataFrame]) -> DataFrame:
    """The rows of one or more frames of one schema as one table, as by cut(); each is written before the next is made."""
    path, last = "", None
    for df in rounds:
        path, last = path or scratch(df.sparkSession), df
        df.write.mode("append").parquet(path)
    out = last.sparkSession.read.schema(last.schema).parquet(path)
    out._cut_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table of cut() or gathered() before release() does: nothing reads it any more."""
    path = df._cut_path
    if _HELD.pop(path, None) is not None:
        _delete(df.sparkSession, path)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Delete the shuffle files of each query that is built and run inside as soon as it ends, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer files lie; LEXGRAPH_TOKENIZERS overrides the folder."""
    return os.path.join(os.environ.get("LEXGRAPH_TOKENIZERS", "/opt/tokenizers"), name)
