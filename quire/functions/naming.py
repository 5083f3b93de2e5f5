"""Names, paths, versions and small fields, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File kinds by extension.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "heic", "heif", "tiff", "tif", "gif", "bmp")
WINDOWS_EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "gif", "tif", "tiff")


def extension(path: Column) -> Column:
    """Lower-cased extension of the last path component, without its dot; none: empty."""
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]+)$", 1))


def raw_extension(path: Column) -> Column:
    """The extension as it is written."""
    return F.regexp_extract(base_name(path), r"\.([^.]+)$", 1)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def join_path(folder: Column, name: Column) -> Column:
    return F.concat_ws("/", folder, name)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]+$", "")


def signed_name(path: Column) -> Column:
    return F.concat(stem(path), F.lit("-signed.pdf"))


def output_name(prefix: str, at: Column) -> Column:
    """A name of one second's resolution."""
    return F.concat(F.lit(prefix), F.date_format(at, "yyyy-MM-dd_HHmmss"), F.lit(".pdf"))


def trimmed(text: Column) -> Column:
    """Without white space and line breaks at either end; trim() takes spaces alone."""
    return F.regexp_replace(text, r"^[\s]+|[\s]+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(trimmed(text) == "", F.lit(True))


def natural_key(name: Column, collation: str | None = None) -> Column:
    """Sort key under which numbers within names compare by value and letters without case.

    The name falls into text and digit runs in turn, beginning with a text that
    may be empty. Ordering by this array compares run by run and puts the
    shorter name first. Add the input's ordinal as a last key to keep ties stable.
    With a collation (such as UNICODE_CI, or a language's) texts compare by it
    instead, so accents and cases stand where a reader looks for them.
    """
    parts = F.split(F.regexp_replace(F.coalesce(name, F.lit("")), "([0-9]+)", "\u0001$1\u0001"), "\u0001", -1)

    text = lambda c: c if collation is None else F.collate(c, collation)

    def key(part: Column) -> Column:
        digits = F.regexp_replace(part, "^0+(?=[0-9])", "")
        number = part.rlike("^[0-9]+$")
        return F.struct(F.when(number, F.length(digits)).otherwise(0).alias("n"), text(F.when(number, digits).otherwise(F.upper(part) if collation is None else part)).alias("s"))

    return F.transform(parts, key)


def version_parts(version: Column) -> Column:
    """Numbers of a version: every v goes, empty parts go, what is no whole number counts as 0."""
    parts = F.filter(F.split(F.replace(F.lower(version), F.lit("v"), F.lit("")), "[.]"), lambda x: x != "")
    return F.transform(parts, lambda x: F.when(x.rlike("^[+-]?[0-9]+$"), F.coalesce(x.try_cast("bigint"), F.lit(0))).otherwise(0).cast("bigint"))


def version_newer(new: Column, old: Column) -> Column:
    """Whether new is a later version than old; missing parts count as 0."""
    a, b = version_parts(new), version_parts(old)
    n = F.greatest(F.size(a), F.size(b), F.lit(1))
    pad = lambda x: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.get(x, i), F.lit(0).cast("bigint")))
    return pad(a) > pad(b)


def json_string(document: Column, field: str) -> Column:
    """A field of a JSON object if it is a string; null if it is missing, of another type, or the JSON is malformed."""
    value = F.variant_get(F.try_parse_json(document), f"$.{field}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(F.try_parse_json(document), f"$.{field}", "string"))


def json_number(document: Column, field: str) -> Column:
    return F.try_variant_get(F.try_parse_json(document), f"$.{field}", "int")


def url_or_null(url: Column) -> Column:
    """The URL if it can be parsed, else null."""
    return F.when(F.try_parse_url(url, F.lit("HOST")).isNotNull(), url)


def key_action(code: Column) -> Column:
    """Action of a key: return and enter finish, escape cancels, both delete keys clear."""
    return F.when(code.isin(36, 76), "done").when(code == 53, "cancel").when(code.isin(51, 117), "clear").otherwise("pass")


def allowed_kinds(picker: Column) -> Column:
    """File kinds that a picker shows."""
    return F.when(picker == "photos", F.array(F.lit("image"))).when(picker == "pdf", F.array(F.lit("pdf"))).otherwise(F.array(F.lit("pdf"), F.lit("image")))
