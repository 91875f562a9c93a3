"""Which files are meant: paths that were given, and folders that are searched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lines import media_kind


def _bare(arg: Column) -> Column:
    """Without spaces and quotes around it."""
    return F.trim(F.regexp_replace(F.trim(F.coalesce(arg, F.lit(""))), '^"+|"+$', ""))


def _full(path: Column, base: str) -> Column:
    rooted = path.rlike(r"^([/\\]|[A-Za-z]:)")
    return F.when(rooted, path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))


def given_paths(args: DataFrame, files: DataFrame, base: str = "/") -> DataFrame:
    """(key, n, path) of the files that are meant by what was given: args (key, args array<string>), files (path), those that
    exist. n counts from 1 in the order of the arguments.

    Spaces and quotes around an argument, empty ones and those that begin with a dash do not count; a path that is not rooted
    lies in base; of equal paths (whatever their case) the first counts. Where none of several exists, they are one path that
    was taken apart at its spaces. Paths are found as they are written. Null arrays have no rows.
    """
    kept = F.filter(F.transform("args", _bare), lambda a: (a != "") & ~F.startswith(a, F.lit("-")))
    given = args.select("key", kept.alias("a"))
    known = files.select("path").distinct()
    each = given.select("key", F.posexplode("a").alias("i", "arg")).select("key", "i", _full(F.col("arg"), base).alias("path"))
    found = each.join(known, "path").groupBy("key", F.lower("path").alias("_l")).agg(F.min(F.struct("i", "path")).alias("f")).select("key", "f.i", "f.path")
    lost = given.where(F.size("a") > 1).join(found.select("key").distinct(), "key", "left_anti")
    whole = lost.select("key", F.lit(0).alias("i"), _full(F.array_join("a", " "), base).alias("path")).join(known, "path")
    both = found.unionByName(whole.select("key", "i", "path"))
    return both.select("key", F.row_number().over(Window.partitionBy("key").orderBy("i")).alias("n"), "path")


def found_files(listed: DataFrame) -> DataFrame:
    """(path, kind, size_bytes) of listed files (path, size_bytes) that are video, sound or subtitles; of paths that differ in
    case only, the first in order."""
    rows = listed.select("path", F.lower("path").alias("_l"), "size_bytes", media_kind("path").alias("kind")).where("kind is not null")
    one = rows.groupBy("_l").agg(F.min(F.struct("path", "kind", "size_bytes")).alias("f"))
    return one.select("f.path", "f.kind", "f.size_bytes")


def scanned(spark: SparkSession, folders: str | list[str]) -> DataFrame:
    """found_files of folders and all that is below them. Contents are not read: the columns of a listing are all that is
    asked of the source."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders)
    return found_files(listed.select("path", F.col("length").alias("size_bytes")))
