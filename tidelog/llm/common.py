"""What the pipeline's operators share: the scratch folder, saved tables and code shipping."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Words as the contracts define them: maximal runs without space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``. Where that is unset, one of our own, but only in
    a local session, whose executors are the driver: on a cluster each machine would write to its own disk."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    if "://" not in found and not found.startswith("file:"):
        found = "file://" + os.path.abspath(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tidelog/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet into the shared folder and reads it again, so lost executors cost no recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidelog_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes saved tables that no result reads any more."""
    for t in tables:
        if path := getattr(t, "_tidelog_path", None):
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsc.sc().hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def temporary():
    """Gives ``save``; what it has saved is deleted at the end, so no result may read it by then."""
    made: list[DataFrame] = []

    def put(df: DataFrame, name: str) -> DataFrame:
        made.append(save(df, name))
        return made[-1]

    try:
        yield put
    finally:
        discard(*made)


def ship(spark: SparkSession) -> None:
    """Sends this package's code to the executors, once a session, so that it need not be installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_tidelog_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="tidelog-code-"), "tidelog_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._tidelog_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(uri: str):
    """pyarrow's file system for a URI of the shared folder, and the path in it. Works on executors and on the driver."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)
