"""Tables in the shared folder, which cut lineage, and guarded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes (as JSON) of a table that may be broadcast.
MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_BYTES = 32_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session, as in tests, may leave it unset and gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not hasattr(spark.sparkContext, "_fathomry_dir"):
        spark.sparkContext._fathomry_dir = tempfile.mkdtemp(prefix="fathomry-")
    return spark.sparkContext._fathomry_dir


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: what follows survives the loss of any executor, and the
    planner knows the table's size.  Tables of one application lie in one folder,
    ``<shared>/fathomry/<application id>``, which :func:`drop_scratch` removes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fathomry/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Remove the scratch tables of this application; call it once results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/fathomry/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int, limit: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` and measured bytes are within bounds, else as it is.

    Beyond them Spark joins by shuffle and AQE splits skewed partitions.  ``df`` is read to
    measure it, so it should be a written table.
    """
    if rows > (MAX_BROADCAST_ROWS if limit is None else limit):
        return df
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))).first()[0] or 0
    return F.broadcast(df) if size <= MAX_BROADCAST_BYTES else df


def ship(spark: SparkSession) -> None:
    """Send this package to all executors, once a session; not needed where it is installed there."""
    import shutil
    from pathlib import Path

    if not getattr(spark.sparkContext, "_fathomry_shipped", False):
        home = Path(__file__).resolve().parent
        path = shutil.make_archive(f"{tempfile.mkdtemp()}/fathomry", "zip", home.parent, home.name)
        spark.sparkContext.addPyFile(path)
        spark.sparkContext._fathomry_shipped = True
