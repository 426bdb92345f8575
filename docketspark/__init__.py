"""docketspark: analytics and retrieval over paragraph-structured documents, on Spark DataFrames."""

from __future__ import annotations

import os


def importable(spark) -> None:
    """Lets Python workers import this package from where the driver has it. On a cluster the package has to be installed on
    the nodes or shipped with spark.submit.pyFiles; this covers workers that share the driver's files."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
