"""What every plan needs: this package on the executors, and intermediate tables that survive lost executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 8 << 20
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Once for each application: the package as a zip file, served by the driver (`addPyFile`).

    Arrow batches of the session are cut at 8 MB, so that long texts don't make large batches; a smaller limit stays.
    """
    context = spark.sparkContext
    size = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")
    if size.isdigit() and int(size) > BATCH_BYTES:  # another unit: set by the user
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        out = os.path.join(tempfile.mkdtemp(prefix="marginalia-"), "marginalia.zip")
        with zipfile.ZipFile(out, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(out)
        _shipped.add(context.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``).  Unset: a temporary one in local mode, as in tests; an error elsewhere."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="marginalia-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` as a Parquet table in the shared folder and reads it back: the lineage is cut and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of `stored()` that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "stored_at", None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def together(*jobs):
    """The results of independent jobs, in order; each is planned and run in a thread of its own, so that one's tasks fill the other's gaps."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        own = inheritable_thread_target(SparkSession.active())
        return [f.result() for f in [pool.submit(own(job)) for job in jobs]]
