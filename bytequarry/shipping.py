"""Gives this package to the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's modules to all workers through Spark's file server, once for each application.

    Workers on this machine that have its folder in PYTHONPATH need nothing.
    """
    context = spark.sparkContext
    here = _ROOT in [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if context.applicationId in _sent or here and context.master.startswith("local"):
        return
    package = os.path.basename(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix=f"{package}-"), f"{package}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(os.path.join(_ROOT, package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, _ROOT))
    context.addPyFile(target)
    _sent.add(context.applicationId)
