"""What executors need of this package."""

from __future__ import annotations

import os
import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each context, unless PYTHONPATH has it there already."""
    root = pathlib.Path(__file__).resolve().parents[1]
    sc = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_evigraph_shipped", False):
        return
    target = pathlib.Path(tempfile.mkdtemp(prefix="evigraph-")) / "evigraph_package.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted((root / "evigraph").rglob("*.py")):
            out.write(path, path.relative_to(root))
    sc.addPyFile(str(target))
    sc._evigraph_shipped = True


def move_new(spark: SparkSession, source: str, target: str) -> bool:
    """Moves a file or folder to a place where nothing is; False, and nothing moved, if something is there. Of several writers one wins."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    fs = jvm.org.apache.hadoop.fs
    a, b = fs.Path(source), fs.Path(target)
    conf = spark._jsc.hadoopConfiguration()
    b.getFileSystem(conf).mkdirs(b.getParent())
    b = b.getFileSystem(conf).makeQualified(b)
    a = a.getFileSystem(conf).makeQualified(a)
    plain = gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:
        fs.FileContext.getFileContext(b.toUri(), conf).rename(a, b, plain)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True
