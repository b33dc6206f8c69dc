"""Lets Python workers import this package: it goes to them as a zip file where PYTHONPATH doesn't have it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Call before the first Python function of a plan is built: a function takes along the files known by then.

    Once a session; the driver serves the zip to executors, so no folder needs to be shared.
    """
    root, context = Path(__file__).resolve().parents[1], spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_tidelane_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="tidelane-"), "tidelane.zip")  # tasks may fetch it at any time
    with zipfile.ZipFile(path, "w") as z:
        for source in sorted(Path(root, "tidelane").rglob("*.py")):
            z.write(source, source.relative_to(root))
    context.addPyFile(str(path))
    atexit.register(shutil.rmtree, path.parent, ignore_errors=True)
    context._tidelane_shipped = True
