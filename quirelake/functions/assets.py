"""Column functions over references between result files, and small predicates of the service."""

from __future__ import annotations

import secrets

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RETRYABLE = (429, 500, 502, 503, 504)


def resolve_asset(markdown_path: Column, asset: Column, files: Column) -> Column:
    """Path of a referenced file among ``files``; null for remote, rooted, escaping and unlisted references.

    The walk keeps a stack of folders in an array; a step above the root makes it null for good.
    """
    parts = F.filter(F.split(markdown_path, "/"), lambda s: s != "")
    start = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))

    def step(stack: Column, s: Column) -> Column:
        up = F.when(F.size(stack) > 0, F.slice(stack, F.lit(1), F.size(stack) - 1))
        return F.when(stack.isNull() | s.isin("", "."), stack).when(s == "..", up).otherwise(F.concat(stack, F.array(s)))

    clean = F.regexp_replace(asset, r"(?s)[?#].*\z", "")
    found = F.array_join(F.aggregate(F.split(clean, "/"), start, step), "/")
    return F.when((asset != "") & ~asset.rlike(r"(?i)^([a-z]+:|/)") & F.array_contains(files, found), found)


def image_references(markdown: Column) -> Column:
    """Targets of all images of a Markdown text, in order."""
    return F.regexp_extract_all(markdown, F.lit(r"!\[([^\]]*)\]\(([^)]+)\)"), 2)


def data_uri(content: Column, name: Column) -> Column:
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)\z", 1))
    kind = F.when(suffix.isin("jpg", "jpeg"), F.lit("jpeg")).otherwise(suffix)
    return F.concat(F.lit("data:image/"), kind, F.lit(";base64,"), F.base64(content))


def inlined(markdown: Column, files: Column) -> Column:
    """Markdown with images found in ``files`` (map of reference to data URI) put inside; all others stay."""
    pieces = F.split(markdown, r"(?=!\[)")

    def piece(p: Column) -> Column:
        target = F.regexp_extract(p, r"^!\[[^\]]*\]\(([^)]+)\)", 1)
        uri = F.try_element_at(files, target)
        put = F.concat(F.regexp_extract(p, r"^(!\[[^\]]*\]\()", 1), uri, F.regexp_extract(p, r"(?s)^!\[[^\]]*\]\([^)]+(\).*)\z", 1))
        return F.when((target != "") & uri.isNotNull() & ~target.rlike(r"^(data:|https?://)"), put).otherwise(p)

    return F.array_join(F.transform(pieces, piece), "")


def new_id() -> Column:
    """A fresh random identifier for every row."""
    return F.uuid()


def short_id(size: int = 8) -> Column:
    """The first hexadecimal digits of a fresh identifier, for names of files and runs."""
    return F.left(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit(size))


def session_token(row: Column, size: int = 32) -> Column:
    """A token of ``size`` bytes from the system's secure source for every ``row`` (any column), fit for addresses and cookies.

    Spark's own random functions follow from a seed, so they are not used for secrets.
    """

    @F.pandas_udf(T.StringType())
    def fresh(rows: pd.Series) -> pd.Series:
        return pd.Series([secrets.token_urlsafe(size) for _ in range(len(rows))], dtype=object)

    return fresh.asNondeterministic()(row)


def is_request_id(value: Column) -> Column:
    return value.rlike(r"^[0-9a-f-]+\z")


def is_session_token(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z0-9_-]{32,128}\z")


def is_retryable(status: Column) -> Column:
    return status.isin(*RETRYABLE)


def upstream_error(status: Column, body: Column) -> Column:
    """struct(code, message) of a failed answer, null for a success: status 200, code SUCCESS and an object as data."""
    fields = F.from_json(body, "struct<internal_code:string,message:string>")
    data = F.try_variant_get(F.try_parse_json(body), "$.data", "variant")
    fine = (status == 200) & (fields["internal_code"] == "SUCCESS") & F.coalesce(F.schema_of_variant(data), F.lit("")).startswith("OBJECT")
    masked = F.struct(F.lit("BACKEND_UNAVAILABLE").alias("code"), F.lit("The backend is unavailable; retry later.").alias("message"))
    named = F.struct(
        F.coalesce(F.nullif(fields["internal_code"], F.lit("")), F.lit("BACKEND_UNAVAILABLE")).alias("code"), F.coalesce(F.nullif(fields["message"], F.lit("")), F.lit("The backend request failed.")).alias("message")
    )
    return F.when(F.coalesce(fine, F.lit(False)), F.lit(None)).when(status >= 500, masked).otherwise(named)


def patch_position(index: Column, h: Column, w: Column, merge: int) -> Column:
    """struct(row, col) of a patch in an h x w grid walked by merge x merge windows."""
    at = index % (h * w)
    window, inside = F.floor(at / (merge * merge)), at % (merge * merge)
    per_row = F.floor(w / merge)
    row = F.floor(window / per_row) * merge + F.floor(inside / merge)
    return F.struct(row.cast("int").alias("row"), ((window % per_row) * merge + inside % merge).cast("int").alias("col"))
