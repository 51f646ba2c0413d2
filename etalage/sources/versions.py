"""Versions of a set of datasets: staged in folders of their own, then published by one rename.

A root holds folders of data that are never changed once published, and ``_manifests``, one small
JSON file for each version.  The highest number is the current version.  Until its manifest is
there, a version does not exist: a run that is lost half-way leaves the version before it readable,
and what it staged is only lost space.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession

MANIFESTS = "_manifests"


def _files(spark: SparkSession, path: str) -> tuple[Any, Any]:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    files, hadoop = _files(spark, path)
    return files.exists(hadoop)


def versions(spark: SparkSession, root: str) -> list[int]:
    """The published versions in ascending order, from one listing."""
    files, folder = _files(spark, f"{root}/{MANIFESTS}")
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def read_manifest(spark: SparkSession, root: str, version: int | None = None) -> dict[str, Any] | None:
    """What a version holds, the current one by default; None if there is none."""
    if version is None:
        known = versions(spark, root)
        if not known:
            return None
        version = known[-1]
    files, path = _files(spark, f"{root}/{MANIFESTS}/{version:012d}.json")
    stream = files.open(path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return {**json.loads(text), "version": version}


def staging_folder(root: str) -> str:
    """A new folder under the root for what is to be published next."""
    return f"{root}/v-{uuid.uuid4().hex}"


def publish(spark: SparkSession, root: str, manifest: dict[str, Any]) -> int:
    """Make a manifest the current version.  Fails if another run has published meanwhile."""
    number = (versions(spark, root) or [0])[-1] + 1
    files, temporary = _files(spark, f"{root}/{MANIFESTS}/.{uuid.uuid4().hex}")
    _, final = _files(spark, f"{root}/{MANIFESTS}/{number:012d}.json")
    stream = files.create(temporary, False)
    try:
        stream.write(json.dumps(manifest, sort_keys=True).encode())
    finally:
        stream.close()
    if files.exists(final) or not files.rename(temporary, final):
        files.delete(temporary, False)
        raise RuntimeError(f"version {number} of {root} was published by another run")
    return number


def drop_versions(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete the manifests of all but the newest versions, then the folders that none of those names."""
    known = versions(spark, root)
    files, folder = _files(spark, root)
    for version in known[:-keep]:
        files.delete(_files(spark, f"{root}/{MANIFESTS}/{version:012d}.json")[1], False)
    kept = json.dumps([read_manifest(spark, root, v) for v in known[-keep:]])
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in kept:
            files.delete(status.getPath(), True)
