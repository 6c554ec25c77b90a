"""Web search, crawl and price analytics expressed as Spark plans."""

import os
from pathlib import Path


def reachable(spark) -> None:
    """Lets Python workers started from now on import this package from where the driver has it. On a cluster without
    that folder, ship the package with --py-files instead."""
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    if root not in (paths := [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]):
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
