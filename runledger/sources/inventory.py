"""Walking file trees of any store, level by level."""

from __future__ import annotations

import errno
import os
import re
import stat
from collections.abc import Iterator
from functools import reduce
from itertools import batched

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.plans.lineage import cut
from runledger.sources.readers import BATCH_ROWS, sample_of

FOUND_SCHEMA = "root string, relpath string, kind string, mtime_ns bigint, size bigint, sample string"
COLUMNS = [part.split()[0] for part in FOUND_SCHEMA.split(", ")]
# Errors of a path that is not there, and how a path of a store begins.
ABSENT = (errno.ENOENT, errno.ENOTDIR, errno.EBADF, errno.ELOOP)
URI = re.compile(r"^(?!file:)[a-zA-Z][a-zA-Z0-9+.-]*://")


def _local(root: str) -> str:
    """A path, which may be written as a `file:` URI."""
    return "/" + root[len("file:") :].lstrip("/") if root.startswith("file:") else root


def walk_files(roots: DataFrame, sample: bool = False) -> DataFrame:
    """Every file under each root: (root, relpath, kind, mtime_ns, size, sample).

    `kind` is `file`, or `unreadable` for one that cannot be sampled; `missing`
    or `unreadable` for a root that cannot be listed. Directories are listed by
    tasks, one level of all trees per round. Links to files count as their
    target; linked directories, dangling links and what cannot be listed below
    a root are left out. Unlike a scan of a data source this sees empty files,
    and sampling reads 8 KiB of a file.

    Args:
        roots: (root), paths on storage all executors mount, or URIs of a store
            that `pyarrow.fs` opens.
    """

    def found(root: str, rel: str, path: str, mtime: int | None, size: int) -> tuple:
        digest, error = sample_of(path, size) if sample else (None, None)
        return root, rel, "file" if error is None else error, mtime, size, digest

    def of_store(root: str, rel: str | None) -> Iterator[tuple]:
        """One level of a store's tree, or what is at its root."""
        try:
            store, base = fs.FileSystem.from_uri(root)
            here = store.get_file_info(base) if rel is None else None
            if here is not None and here.type == fs.FileType.NotFound:
                yield root, None, "missing", None, None, None
                return
            if here is not None and here.type == fs.FileType.File:
                yield found(root, ".", root, here.mtime_ns, here.size)
                return
            entries = store.get_file_info(fs.FileSelector(f"{base}/{rel}" if rel else base))
        except (OSError, ValueError, ImportError):
            if rel is None:
                yield root, None, "unreadable", None, None, None
            return
        for entry in entries:
            path = f"{rel}/{entry.base_name}" if rel else entry.base_name
            if entry.type == fs.FileType.Directory:
                yield root, path, "dir", None, None, None
            elif entry.type == fs.FileType.File:
                yield found(root, path, f"{root.rstrip('/')}/{path}", entry.mtime_ns, entry.size)

    def listed(root: str, rel: str) -> Iterator[tuple]:
        base = os.path.join(root, rel) if rel else root
        try:
            entries = os.scandir(base)
        except OSError:
            return
        with entries:
            for entry in entries:
                path = f"{rel}/{entry.name}" if rel else entry.name
                try:
                    info = entry.stat()
                except OSError:
                    continue
                if not stat.S_ISDIR(info.st_mode):
                    yield found(root, path, entry.path, info.st_mtime_ns, info.st_size)
                elif not entry.is_symlink():
                    yield root, path, "dir", None, None, None

    def first(root: str) -> Iterator[tuple]:
        try:
            info = os.stat(root)
        except OSError as exc:
            yield root, None, "missing" if exc.errno in ABSENT else "unreadable", None, None, None
            return
        if stat.S_ISDIR(info.st_mode):
            yield from listed(root, "")
        else:
            yield found(root, ".", root, info.st_mtime_ns, info.st_size)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for root, rel in zip(frame["root"], frame["relpath"]):
                level = of_store(root, rel) if URI.match(root) else first(_local(root)) if rel is None else listed(_local(root), rel)
                for rows in batched(((root, *row[1:]) for row in level), BATCH_ROWS):
                    yield pd.DataFrame(rows, columns=COLUMNS).astype({"mtime_ns": "Int64", "size": "Int64"})

    tasks = roots.sparkSession.sparkContext.defaultParallelism
    level = roots.select("root", F.lit(None).cast("string").alias("relpath")).distinct()
    levels = []
    while True:
        round_ = cut(level.repartition(tasks).mapInPandas(batches, FOUND_SCHEMA))
        levels.append(round_.where("kind <> 'dir'"))
        level = round_.where("kind = 'dir'").select("root", "relpath")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels)
