"""Sessions, and the package on the workers."""

from __future__ import annotations

import atexit
import os
import shutil
import sys
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session as tests and the benchmark use it."""
    conf = {
        "spark.driver.memory": memory, "spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.enabled": "true",
    }
    return SparkSession.builder.master(f"local[{cores}]").config(map=conf).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the workers, unless they find it by their path or working folder anyway."""
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    context = spark.sparkContext
    if str(ROOT) in {os.path.abspath(p) for p in known if p} or any("quillmend" in f for f in context._python_includes) or "site-packages" in ROOT.parts:
        return
    folder = tempfile.mkdtemp(prefix="package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    shutil.copytree(ROOT / "quillmend", Path(folder) / "tree/quillmend", ignore=shutil.ignore_patterns("__pycache__"))
    if (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", Path(folder) / "tree")
    context.addPyFile(shutil.make_archive(str(Path(folder) / "quillmend"), "zip", Path(folder) / "tree"))
    sys.path.remove(found) if (found := str(Path(folder) / "quillmend.zip")) in sys.path else None
