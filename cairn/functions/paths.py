"""Path parsing for class/patient image trees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Image file extensions and class labels.
EXTENSIONS = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff")
CLASSES = {"Normal": 0, "Sick": 1}


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The last suffix in lower case; a name that is only a suffix has none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def is_image(path: Column, extensions=EXTENSIONS) -> Column:
    return extension(path).isin(*[e.lower() for e in extensions])


def encode_label(name: Column, classes: dict[str, int] | None = None) -> Column:
    """The class's index; an unknown class is an error."""
    table = F.create_map(*[F.lit(x) for kv in (classes or CLASSES).items() for x in kv])
    unknown = F.raise_error(F.concat(F.lit("unknown class: "), F.coalesce(name, F.lit("null")))).cast("int")
    return F.coalesce(F.try_element_at(table, name), unknown)


def decode_label(label: Column, classes: dict[str, int] | None = None) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in (classes or CLASSES).items() for x in (v, k)]), label)
