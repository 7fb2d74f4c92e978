"""Row expressions: verdict maps, paths, ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strict_label(value: Column) -> Column:
    """'O' is 1, 'X' is 0; anything else, null included, raises."""
    wrong = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(value, F.lit("null"))))
    return F.when(value == "O", F.lit(1)).when(value == "X", F.lit(0)).otherwise(wrong.cast("int"))


def has_image_suffix(path: Column, more: bool = False) -> Column:
    """png, jpg, jpeg in any case; more adds gif and bmp."""
    return F.lower(path).rlike(r"\.(png|jpe?g|gif|bmp)$" if more else r"\.(png|jpe?g)$")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def media_type(path: Column) -> Column:
    """By extension; jpeg by default."""
    name = F.lower(basename(path))
    kind = F.when(name.endswith(".png"), "png").when(name.endswith(".gif"), "gif").when(name.endswith(".webp"), "webp").otherwise("jpeg")
    return F.concat(F.lit("image/"), kind)


def aspect(width: Column, height: Column) -> Column:
    """width / height; a height of 0 raises."""
    return width / height


def first_existing(*paths: Column) -> Column:
    """The first root that has the file."""
    return F.coalesce(*paths)


def verdict_or_missing(verdicts: Column, name: Column) -> Column:
    """The map's verdict of a name, '' where there is none."""
    return F.coalesce(F.try_element_at(verdicts, name), F.lit(""))


def missing_names(names: Column, verdicts: Column) -> Column:
    """Names without a verdict, in order."""
    return F.array_except(names, F.map_keys(verdicts))


def is_complete(response: Column, names: Column) -> Column:
    """Whether a response mentions every name."""
    return F.forall(names, lambda n: F.contains(response, n))


def base64_line(content: Column) -> Column:
    """Base64 without the line breaks that some versions put in."""
    return F.translate(F.base64(content), "\r\n", "")
