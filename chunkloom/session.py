"""Sessions, and the one place where lineage is cut."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "chunkloom", cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.driver.memory": os.environ.get("CHUNKLOOM_DRIVER_MEMORY", "6g"),
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    return builder.config(map=base | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors this package where their path doesn't have it."""
    root = Path(__file__).resolve().parent
    context = spark.sparkContext
    if str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_chunkloom", False):
        return
    shared = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://").removeprefix("file:")
    folder = f"{shared}/chunkloom-{uuid.uuid4().hex}" if shared.startswith("/") else tempfile.mkdtemp(prefix="chunkloom-")
    os.makedirs(folder, exist_ok=True)
    name = f"{folder}/chunkloom.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(name)
    context._chunkloom = True


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset a local session gets a temporary one; on a cluster it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named and not re.match(r"local(?:\[|$)", context.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="chunkloom-"))
    return named or context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and continue from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, as it is otherwise; for narrow tables."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
