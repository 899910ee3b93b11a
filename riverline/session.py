"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers once per application, for sessions whose workers can't import it."""
    if not getattr(spark.sparkContext, "_riverline_shipped", False):
        path = os.path.join(tempfile.mkdtemp(prefix="riverline-"), "riverline.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(ROOT.joinpath("riverline").rglob("*.py")):
                z.write(p, p.relative_to(ROOT))
        spark.sparkContext.addPyFile(path)
        spark.sparkContext._riverline_shipped = True
    return spark


def local(cpus: int | str = 8, app: str = "riverline", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench share."""
    settings = {
        "spark.master": f"local[{cpus}]",
        "spark.app.name": app,
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): str(v) for k, v in conf.items()}
    spark = SparkSession.builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
