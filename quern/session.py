"""The Spark session: shipping the package to executors and cutting lineage."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package.

    Workers get the folder it lies in on their path, which is enough where that folder is shared or the same everywhere.
    On other clusters submit the package with ``--py-files``."""
    env = spark.sparkContext.environment
    here = str(ROOT.parent)
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if here not in known:
        env["PYTHONPATH"] = os.pathsep.join([here, *filter(None, known)])


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that all executors share, with its lineage cut.

    The folder is the one the session names; only where none is named, as in tests, a temporary one is set."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quern-"))
    return df.checkpoint(eager=True)
