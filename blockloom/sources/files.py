"""Files in whatever store their path names: a local or shared folder, HDFS or an object store, by Arrow's file systems."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession


def locate(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def join(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path, in the shared folder that spark.checkpoint.dir names; in local mode without one, in a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="blockloom-")
    return join(root, f"{name}-{uuid.uuid4().hex}")


def size(path: str) -> int | None:
    """Bytes of a file; None if there is none."""
    store, at = locate(path)
    info = store.get_file_info(at)
    return info.size if info.type == fs.FileType.File else None


def exists(path: str) -> bool:
    store, at = locate(path)
    return store.get_file_info(at).type != fs.FileType.NotFound


def make_folder(path: str) -> None:
    store, at = locate(path)
    store.create_dir(at, recursive=True)


def reader(path: str):
    store, at = locate(path)
    return store.open_input_file(at)


def writer(path: str):
    store, at = locate(path)
    return store.open_output_stream(at)


def appender(path: str):
    store, at = locate(path)
    return store.open_append_stream(at)


def rename(old: str, new: str) -> None:
    store, at = locate(old)
    store.move(at, locate(new)[1])


def remove(path: str) -> None:
    store, at = locate(path)
    store.delete_file(at)


def remove_folder(path: str) -> None:
    store, at = locate(path)
    store.delete_dir(at)


def write_whole(path: str, data: bytes) -> None:
    """Under another name first, so that readers see the old file or the new one, never a part."""
    with writer(temp := f"{path}.{uuid.uuid4().hex}") as f:
        f.write(data)
    rename(temp, path)


def read_range(path: str, offset: int, length: int) -> bytes:
    with reader(path) as f:
        return bytes(f.read_at(length, offset))
