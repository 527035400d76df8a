"""Path parts, labels and times as Column expressions; both separators are understood."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\]?[^/\\]*$", "")


def parent_name(path: Column) -> Column:
    return basename(folder(path))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def slug(text: Column) -> Column:
    return F.lower(F.replace(text, F.lit(" "), F.lit("_")))


def folder_label(path: Column, unknown: str = "unknown") -> Column:
    name = slug(parent_name(path))
    return F.when(name == "", unknown).otherwise(F.coalesce(name, F.lit(unknown)))


def sequence_number(path: Column) -> Column:
    """First run of digits of the base name, -1 without one."""
    return F.coalesce(_digits(basename(path)), F.lit(-1).cast("long"))


def _digits(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"([0-9]+)", 1), F.lit("")).try_cast("long")


def moment_label(number: Column) -> Column:
    return F.format_string("moment_%02d", number)


def exif_time(*values: Column) -> Column:
    """First readable capture time of `yyyy:MM:dd HH:mm:ss` strings, without a zone."""
    return F.coalesce(*[F.try_to_timestamp(F.replace(v, F.lit("\x00"), F.lit("")), F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz") for v in values])


def iso_time(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")


def megabytes(size: Column) -> Column:
    return F.round(size / 1048576, 1)


def resolution(width: Column, height: Column) -> Column:
    return F.concat_ws("x", width, height)
