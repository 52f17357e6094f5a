"""SparkSession builder and the settings every query of this package relies on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: UTC keeps date arithmetic and the DuckDB oracle aligned; AQE coalesces and splits shuffle partitions at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build(app: str = "almoneda", master: str | None = None, **conf: str) -> SparkSession:
    """A session with DEFAULTS; `master` is only set when given, so spark-submit's choice wins on a cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        cores = int("".join(c for c in master if c.isdigit()) or os.cpu_count() or 8)
        builder = builder.master(master).config("spark.sql.shuffle.partitions", str(cores))
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a context, so that plans with Python in them run from anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_almoneda_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="almoneda-zip-")) / "almoneda.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._almoneda_shipped = True
