"""Results of studies: nested values as JSON files, and score tables kept under a hash of what they come from."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def _place(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def _plain(value):
    """Numbers and arrays of NumPy as JSON has them; anything else is an error."""
    if isinstance(value, np.ndarray | np.generic):
        return value.tolist()
    raise TypeError(f"a result holds a {type(value).__name__}")


def save_result(spark: SparkSession, path: str, result: Mapping) -> None:
    """``result`` as JSON at ``path``, in the file system that the path names: written beside it, then renamed, so that no reader sees a part."""
    text = json.dumps(result, default=_plain, indent=2)
    fs, target = _place(spark, path)
    _, part = _place(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"could not write {path}")


def load_result(spark: SparkSession, path: str) -> dict:
    """The result at ``path``; a missing file is Spark's error."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def fingerprint(spark: SparkSession, paths: Sequence[str]) -> list[list]:
    """[name, bytes, time of change] of every file below ``paths``, in order; hidden ones are left out."""
    found = []
    for path in paths:
        fs, root = _place(spark, path)
        files = fs.listFiles(root, True)
        while files.hasNext():
            one = files.next()
            if not one.getPath().getName().startswith((".", "_")):
                found.append([one.getPath().toString(), one.getLen(), one.getModificationTime()])
    return sorted(found)


def scored(spark: SparkSession, root: str, settings: Mapping, inputs: Sequence[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``build`` gives, kept below ``root`` by a hash of ``settings`` and of the files of ``inputs``.

    It is built where the hash is new, that is, when a setting or an input file changed, and is
    renamed into place when it is whole; of two that build it at once one wins, the other's goes.
    """
    said = json.dumps([settings, fingerprint(spark, inputs)], sort_keys=True, default=_plain)
    name = f"{root}/{hashlib.sha256(said.encode()).hexdigest()}"
    fs, target = _place(spark, name)
    if not fs.exists(target):
        _, part = _place(spark, f"{root}/.part-{uuid.uuid4().hex}")
        build().write.parquet(part.toString())
        if fs.exists(target) or not fs.rename(part, target):
            fs.delete(part, True)
            if not fs.exists(target):
                raise OSError(f"could not write {name}")
    return spark.read.parquet(name)
