"""Listing media files under a folder."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.constants import EXCLUDED_FOLDERS, IMAGE_EXTENSIONS, VIDEO_EXTENSIONS
from twinsift.functions.paths import has_extension, is_excluded


def filter_paths(paths: DataFrame, extensions: Iterable[str], excluded: Iterable[str] = EXCLUDED_FOLDERS, whole_names: bool = False) -> DataFrame:
    """(path): distinct paths with one of the extensions outside excluded folders; a table of paths of any origin."""
    return paths.where(has_extension("path", extensions) & ~is_excluded("path", excluded, whole_names)).select("path").distinct()


def extension_glob(extensions: Iterable[str]) -> str:
    """A pattern of file names that end in an extension, all lower or all upper case."""
    return "*.{" + ",".join(e for x in sorted(extensions) for e in dict.fromkeys((x[1:], x[1:].upper()))) + "}"


def list_files(spark: SparkSession, folder: str, extensions: Iterable[str], excluded: Iterable[str] = EXCLUDED_FOLDERS) -> DataFrame:
    """(path, length): files under a folder of any file system Spark reads, in path order, without their content.

    Names that begin with ``.`` or ``_`` are invisible to Spark's readers; see
    :func:`walk_files` for a listing that has them.
    """
    glob = extension_glob(extensions)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    local = F.regexp_replace("path", "^file:/*(?=/)", "")
    return files.select(local.alias("path"), "length").where(~is_excluded("path", excluded)).orderBy("path")


def walk_files(spark: SparkSession, folder: str, extensions: Iterable[str], excluded: Iterable[str] = EXCLUDED_FOLDERS) -> DataFrame:
    """(path, length): every matching file of a local folder, hidden ones included, in path order."""
    endings = {e for x in extensions for e in (x, x.upper())}
    tokens = [t.lower() for t in excluded]
    found = []
    for root, _, names in os.walk(folder):
        for name in names:
            path = os.path.join(root, name)
            if any(name.endswith(e) for e in endings) and not any(t in path.lower() for t in tokens) and os.path.isfile(path):
                found.append((path, os.path.getsize(path)))
    return spark.createDataFrame(sorted(found), "path string, length long")


def find_images(spark: SparkSession, folder: str, excluded: Iterable[str] = EXCLUDED_FOLDERS, hidden: bool = False) -> DataFrame:
    return (walk_files if hidden else list_files)(spark, folder, IMAGE_EXTENSIONS, excluded)


def find_videos(spark: SparkSession, folder: str, excluded: Iterable[str] = EXCLUDED_FOLDERS, hidden: bool = False) -> DataFrame:
    return (walk_files if hidden else list_files)(spark, folder, VIDEO_EXTENSIONS, excluded)
