"""What file names and paths say: base names, groups, sessions, stages, times. Every function takes and returns Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension sets of the several tools.
PREPROCESS_EXTENSIONS = (".png", ".jpg", ".jpeg", ".tif", ".tiff")
FINALIZE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp")
NOTEBOOK_EXTENSIONS = (".png", ".jpg", ".jpeg", ".bmp", ".tiff")
LABEL_EXTENSIONS = (".png", ".jpg", ".jpeg")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    """A base name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r".(\.[^.]+)$", 1))


def has_extension(path: Column, extensions: tuple[str, ...]) -> Column:
    return suffix(basename(path)).isin(*extensions)


def relative(path: Column, root: str) -> Column:
    return F.substring(path, len(root.rstrip("/")) + 2, 2**31 - 1)


def with_suffix(path: Column, new: str) -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", new)


def join_path(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def normalized(path: Column) -> Column:
    """Backslashes become slashes."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def normalized_split(split: Column) -> Column:
    return F.lower(F.trim(F.coalesce(split, F.lit(""))))


def stage(path: Column) -> Column:
    """The first part of a path that begins with "stage" in any case, as it is written; else unknown."""
    return F.coalesce(F.try_element_at(F.filter(F.split(path, "/"), lambda p: F.lower(p).startswith("stage")), F.lit(1)), F.lit("unknown"))


def session(path: Column, root: str) -> Column:
    """The first folder under root, if a file lies in one; else unknown."""
    parts = F.split(relative(path, root), "/")
    return F.when(F.size(parts) >= 2, F.element_at(parts, 1)).otherwise("unknown")


def group_id(name: Column, aug_digits: str = "2") -> Column:
    """A stem without its trailing _orig or _augNN. aug_digits="2" leaves _augNNN as it is; "any" takes any number of digits."""
    digits = {"2": "[0-9]{2}", "any": "[0-9]+"}[aug_digits]
    return F.regexp_replace(stem(name), f"_(orig|aug{digits})$", "")


def scan_timestamp(name: Column) -> Column:
    """The first YYYY-MM-DD_HH-MM-SS-mmm as ISO text, unchecked; "" if there is none."""
    pattern = r"(\d{4}-\d{2}-\d{2})_(\d{2}-\d{2}-\d{2})-(\d{3})"
    day, time, ms = (F.regexp_extract(name, pattern, i) for i in (1, 2, 3))
    return F.when(day == "", "").otherwise(F.concat(day, F.lit("T"), F.replace(time, F.lit("-"), F.lit(":")), F.lit("."), ms))


def clean_annotation_name(path: Column, prefix: str = "^[^-]*-") -> Column:
    """A base name without what an annotation tool put before its first dash; prefix: another pattern for that."""
    return F.regexp_replace(basename(path), prefix, "")
