"""Parts of slash-separated paths in string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes that name an image and not a folder.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png")


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def suffix(path: Column) -> Column:
    """The last dot and what follows, if anything stands before and after it."""
    return F.regexp_extract(name(path), r"^.+?(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    own = name(path)
    return F.substring(own, F.lit(1), F.length(own) - F.length(suffix(path)))


def parent(path: Column) -> Column:
    """What stands before the name; ``.`` if nothing does."""
    up = F.regexp_replace(path, r"/*[^/]*/*$", "")
    return F.when(up != "", up).when(path.startswith("/"), "/").otherwise(".")


def with_suffix(path: Column, new: str) -> Column:
    return F.concat(F.substring(path, F.lit(1), F.length(path) - F.length(suffix(path))), F.lit(new))


def join(folder: Column, last: Column) -> Column:
    """``folder/last``; ``last`` alone if it is absolute or the folder is the current one."""
    return F.when(last.startswith("/") | (folder == ".") | (folder == ""), last).otherwise(F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"), last))


def is_image(path: Column) -> Column:
    return F.lower(suffix(path)).isin(*IMAGE_SUFFIXES)
