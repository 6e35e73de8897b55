"""Sessions: code on the workers, tables that are written once."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, as in tests, a temporary one if all of Spark runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        if "dir" not in _own_dir:
            _own_dir["dir"] = "file://" + tempfile.mkdtemp(prefix="shared-")
        found = _own_dir["dir"]
    return found.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: later steps start from the files, also after an executor is lost."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, also where they do not share the driver's import path: it is sent once a Spark
    application as a zip of its sources."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parents[1]
        out = Path(tempfile.mkdtemp(prefix="ship-")) / f"{root.name}.zip"
        with zipfile.ZipFile(out, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"{root.name}/{p.relative_to(root)}")
        spark.sparkContext.addPyFile(str(out))
        _shipped.add(app)
    return spark
