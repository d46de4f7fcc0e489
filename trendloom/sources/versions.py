"""Tables that readers never meet half-written.

A table is a folder of versions, each written whole by one job, and a pointer file for each part of
the table (a month, or the one part ``all``) that names the version the part is read from.  A
pointer is replaced by a rename, so a reader sees the old version or the new one; a job that breaks off
leaves a version that no pointer names.  The version that a pointer named before is kept for readers that
still have it open; older ones are deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from trendloom.session import delete, exists

POINTERS = "_current"
ALL = "all"


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _children(spark: SparkSession, path: str) -> list[str]:
    where, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def _read(spark: SparkSession, path: str) -> str:
    where, fs = _fs(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _replace(spark: SparkSession, path: str, text: str) -> None:
    """Put ``text`` into the file ``path`` in one step."""
    jvm = spark._jvm
    where, fs = _fs(spark, path)
    draft, _ = _fs(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    ways = spark.sparkContext._gateway.new_array(rename, 1)
    ways[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(draft), fs.makeQualified(where), ways)


def current(spark: SparkSession, path: str) -> dict[str, str]:
    """part -> folder of the version it is read from; empty if nothing was published."""
    found = {}
    for part in _children(spark, f"{path}/{POINTERS}"):
        if not part.startswith("."):
            found[part] = f"{path}/{json.loads(_read(spark, f'{path}/{POINTERS}/{part}'))['version']}"
    return found


def publish(spark: SparkSession, path: str, write: Callable[[str], object], parts: Callable[[str], list[str]] = lambda _: [ALL]) -> None:
    """Let ``write`` fill a new version's folder and then make it current for ``parts`` of it."""
    version = f"v-{uuid.uuid4().hex}"
    write(f"{path}/{version}")
    for part in parts(f"{path}/{version}"):
        pointer = f"{path}/{POINTERS}/{part}"
        before = json.loads(_read(spark, pointer))["version"] if exists(spark, pointer) else None
        _replace(spark, pointer, json.dumps({"version": version, "before": before}))
    _forget(spark, path)


def _forget(spark: SparkSession, path: str) -> None:
    """Delete versions that were current once and are now neither current nor the ones before."""
    used, known = set(), {v for v in _children(spark, path) if v.startswith("v-")}
    for part in _children(spark, f"{path}/{POINTERS}"):
        if not part.startswith("."):
            used |= set(json.loads(_read(spark, f"{path}/{POINTERS}/{part}")).values())
    for version in known - used:
        # a version without its mark is still being written, or was left by a job that broke off
        if exists(spark, f"{path}/{version}/_SUCCESS"):
            delete(spark, f"{path}/{version}")
