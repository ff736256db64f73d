"""Directory scans without reading file contents.

Spark's own file sources leave files of zero bytes out. A file that a broken transfer has left empty
must show up as a damaged one, so the scan is a data source of its own, ``file_listing``: each folder
below the root is listed by a task, the driver sees only the names of the root's folders.
"""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatchcase

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from seqloom.sources.storage import filesystem

#: Tasks that the folders below the root are dealt to.
LISTING_PARTS = 64


class _Folders(InputPartition):
    def __init__(self, folders: list[str], recursive: bool):
        self.folders, self.recursive = folders, recursive


class _ListingReader(DataSourceReader):
    def __init__(self, root: str, pattern: str):
        self.root, self.pattern = root, pattern

    def partitions(self) -> list[_Folders]:
        system, base = filesystem(self.root)
        inside = system.get_file_info(fs.FileSelector(base, recursive=False))
        folders = sorted(i.path for i in inside if i.type == fs.FileType.Directory and _shown(i.base_name))
        dealt = [folders[i::LISTING_PARTS] for i in range(min(LISTING_PARTS, len(folders)))]
        return [_Folders([base], False), *[_Folders(part, True) for part in dealt]]

    def read(self, partition: _Folders) -> Iterator[tuple[str, int]]:
        system, base = filesystem(self.root)
        # what the store's own paths lack of the URIs that Spark and the readers take
        scheme = self.root[: len(self.root) - len(base)] if self.root.endswith(base) else ""
        for folder in partition.folders:
            for info in system.get_file_info(fs.FileSelector(folder, recursive=partition.recursive)):
                below = info.path[len(base) :].strip("/").split("/")
                if info.type == fs.FileType.File and all(map(_shown, below)):
                    if fnmatchcase(info.base_name, self.pattern):
                        yield scheme + info.path, info.size


class FileListing(DataSource):
    """``path, length`` of the files below ``path`` whose name matches the glob ``pattern``."""

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return "path string, length long"

    def reader(self, schema) -> DataSourceReader:
        return _ListingReader(self.options["path"], self.options.get("pattern", "*"))


def _shown(name: str) -> bool:
    """Names that begin with ``_`` or ``.`` are hidden, as they are to Spark's own sources."""
    return not name.startswith(("_", "."))


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path, length`` of every file below ``root`` whose name matches the glob, empty files too.

    A root that does not exist fails.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    spark.dataSource.register(FileListing)
    listing = spark.read.format("file_listing").option("pattern", pattern)
    return listing.load(store.makeQualified(folder).toString())


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def archive_participant(path: Column) -> Column:
    """The number in ``<number>_P.tar.gz``, NULL if the name is different."""
    return F.regexp_extract(base_name(path), r"^(\d+)_[^/]*\.tar\.gz$", 1).try_cast("long")


def modality_files(listing: DataFrame) -> DataFrame:
    """``<id>_acoustic.npy`` / ``<id>_visual.npy``: which subject has which file."""
    name = base_name(F.col("path"))
    parts = listing.select(
        F.regexp_extract(name, r"^(.+)_(acoustic|visual)\.npy$", 1).alias("subject_id"),
        F.regexp_extract(name, r"^(.+)_(acoustic|visual)\.npy$", 2).alias("modality"),
        "path",
    ).where(F.col("modality") != "")
    return parts.groupBy("subject_id").agg(
        *[
            F.max(F.when(F.col("modality") == m, F.col("path"))).alias(f"{m}_path")
            for m in ("acoustic", "visual")
        ]
    )
