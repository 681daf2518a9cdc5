"""Making the package importable on the executors."""

from __future__ import annotations

import hashlib
import io
import os
import zipfile

from pyspark.sql import SparkSession

from termloom.plans.lineage import shared_dir
from termloom.sources.files import Files

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _reachable(spark: SparkSession) -> bool:
    """Workers find the package by themselves: through PYTHONPATH, or from the working directory."""
    conf = spark.sparkContext.getConf()
    paths = os.environ.get("PYTHONPATH", "") + os.pathsep + (conf.get("spark.executorEnv.PYTHONPATH") or "")
    roots = {os.path.realpath(p) for p in paths.split(os.pathsep) if p}
    one_process = spark.sparkContext.master.split("[")[0] == "local"  # not local-cluster, whose workers start elsewhere
    return os.path.realpath(ROOT) in roots or (one_process and os.path.realpath(os.getcwd()) == os.path.realpath(ROOT))


def ship(spark: SparkSession) -> None:
    """Once per Spark context: put the package's sources into the shared folder and have every
    executor add them, unless they can import it already."""
    sc = spark.sparkContext
    if getattr(sc, "_termloom_shipped", False):
        return
    if not _reachable(spark):
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
            for folder, _, names in sorted(os.walk(os.path.join(ROOT, "termloom"))):
                for name in sorted(n for n in names if n.endswith(".py")):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, ROOT))
        data = packed.getvalue()
        target = f"{shared_dir(spark).rstrip('/')}/termloom-{hashlib.sha256(data).hexdigest()[:16]}.zip"
        files = Files(spark)
        if not files.exists(target):
            files.write_bytes(target, data)
        sc.addPyFile(target)
    sc._termloom_shipped = True
