"""Column expressions over names, paths and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN_NAME_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9_-]*$"
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".webp")


def hash60(*parts: Column) -> Column:
    """Uniform 60-bit value of the concatenated parts, the same in any engine that has MD5."""
    text = F.concat(*[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def display_name(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("___"), F.lit(" - ")), F.lit("_"), F.lit(" "))


def readable_name(name: Column) -> Column:
    """Only the first ``___`` becomes a dash; every other underscore becomes a space."""
    halves = F.split(name, "___", 2)
    return F.replace(F.array_join(halves, " - "), F.lit("_"), F.lit(" "))


def strip_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def object_identifier(filename: Column) -> Column:
    """Identifier of the photographed object, as the metadata map spells it.

    It stands after the last ``___`` and before the first ``copy``, without mask marks and image extensions.
    """
    unmasked = F.replace(filename, F.lit("_final_masked"), F.lit(""))
    core = F.regexp_extract(unmasked, r"(?s)^(?:.*___)?(.*?)(?:copy.*)?$", 1)
    return F.lower(strip_whitespace(F.regexp_replace(core, r"\.(?:jpe?g|JPE?G|png|PNG)", "")))


def path_parts(path: Column) -> Column:
    """Segments of a path after normalising separators and outer slashes."""
    return F.split(F.btrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/")), "/")


def listed_class(path: Column) -> Column:
    """Second-last segment; null when the path has fewer than two."""
    return F.try_element_at(path_parts(path), F.lit(-2))


def listed_file(path: Column) -> Column:
    parts = path_parts(path)
    return F.when(F.size(parts) >= 2, F.element_at(parts, -1))


def split_pair(a: Column, b: Column) -> Column:
    return F.concat_ws("--", F.least(a, b), F.greatest(a, b))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("||", F.least(a, b), F.greatest(a, b))


def group_key(object_id: Column, digest: Column) -> Column:
    return F.coalesce(F.concat(F.lit("leaf::"), object_id), F.concat(F.lit("unmapped_hash::"), digest))


def run_name_of_checkpoint(stem: Column) -> Column:
    return F.regexp_replace(stem, "_best$", "")


def rate_token(rate: Column) -> Column:
    text = F.format_string("%.0e", rate.cast("double"))
    return F.replace(F.replace(text, F.lit("+"), F.lit("p")), F.lit("-"), F.lit("m"))


def valid_run_name(name: Column) -> Column:
    return name.rlike(RUN_NAME_PATTERN)


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def safe_filename(name: Column, source_path: Column) -> Column:
    """Name that every file system accepts; ten hex digits of the source path's SHA-1 before the extension make it unique."""
    allowed = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), r"[ .]+$", "")
    named = F.when(allowed == "", F.lit("image")).otherwise(F.coalesce(allowed, F.lit("image")))
    digits = F.concat(F.lit("$1__"), F.left(F.sha1(source_path), F.lit(10)), F.lit("$2"))
    return F.regexp_replace(named, r"(?s)^(.+?)(\.[^.]+)?$", digits)


def percent_encoded(path: Column) -> Column:
    """Percent-encode a path, keeping ``/`` and the unreserved characters."""
    text = F.url_encode(path)
    for found, wanted in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        text = F.replace(text, F.lit(found), F.lit(wanted))
    return text


def percent_text(share: Column) -> Column:
    # formatting a null gives text, hence the explicit test
    return F.when(share.isNull(), F.lit("N/A")).otherwise(F.format_string("%.2f%%", share * 100.0))
