"""POSIX path expressions."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# A path holding none of these is already normal and skips the fold.
UNTIDY = r"//|(^|/)\.\.?(/|$)|./$|^$"
# Scheme and authority of a location such as hdfs://host/folder/file.
AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?(?=/)"


def _fold(path: Column) -> Column:
    rooted = path.startswith("/")
    lead = (
        F.when(path.startswith("///"), F.lit("/"))
        .when(path.startswith("//"), F.lit("//"))
        .when(rooted, F.lit("/"))
        .otherwise(F.lit(""))
    )
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))

    def step(kept: Column, part: Column) -> Column:
        last = F.get(kept, F.size(kept) - 1)
        can_pop = (F.size(kept) > 0) & (last != "..")
        return (
            F.when((part == "..") & F.coalesce(can_pop, F.lit(False)), F.slice(kept, F.lit(1), F.size(kept) - 1))
            .when((part == "..") & rooted, kept)
            .otherwise(F.concat(kept, F.array(part)))
        )

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    out = F.concat(lead, F.array_join(kept, "/"))
    return F.when(out == "", F.lit(".")).otherwise(out)


def normalize(path: Column) -> Column:
    """Collapse ``//`` and ``.``, resolve ``..``; null stays null."""
    return F.when(path.rlike(UNTIDY), _fold(path)).otherwise(path)


def without_authority(location: Column) -> Column:
    """The path part of a location; a plain path stays as it is."""
    return F.regexp_replace(location, F.lit(AUTHORITY), F.lit(""))


def normalize_location(location: Column) -> Column:
    """Normalise the path part only, so that ``scheme://host`` keeps its slashes."""
    authority = F.regexp_extract(location, AUTHORITY, 0)
    path = F.substr(location, F.length(authority) + 1)
    # Two leading slashes mean something only at the start of a plain path.
    rooted = F.regexp_replace(path, F.lit("^/+"), F.lit("/"))
    return F.when(authority == "", normalize(path)).otherwise(F.concat(authority, normalize(rooted)))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_folder(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.coalesce(F.get(parts, F.size(parts) - 2), F.lit(""))


def relative_folder(path: Column, root: str) -> Column:
    """Folder of the file relative to ``root``; ``.`` for a file directly in it.

    The root is normalised as scanned paths are, so ``/a//b`` and ``/a/./b/`` are ``/a/b``.
    """
    base = posixpath.normpath("/" + root.lstrip("/") if root.startswith("/") else root).rstrip("/") + "/"
    inner = F.substr(path, F.lit(len(base) + 1))
    cut = F.length(inner) - F.length(file_name(inner)) - 1
    return F.when(cut > 0, F.substr(inner, F.lit(1), cut)).otherwise(F.lit("."))


def component_name(relative: Column) -> Column:
    return F.substring_index(relative, "/", 1)


def main_folder(path: Column) -> Column:
    """Fifth path part, counting the root as the first; empty when there is none."""
    return F.coalesce(F.get(F.split(path, "/"), F.lit(4)), F.lit(""))


def path_columns(location: Column, root: str) -> list[Column]:
    """Name and folder columns of a file below ``root``."""
    path = without_authority(location)
    relative = relative_folder(path, re.sub(AUTHORITY, "", root))
    return [
        file_name(path).alias("file_name"),
        location.alias("file_path"),
        main_folder(path).alias("main_folder"),
        parent_folder(path).alias("parent_folder"),
        relative.alias("relative_folder"),
        component_name(relative).alias("component_name"),
    ]
