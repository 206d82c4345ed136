"""Resolving links against the page they were found on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def _squash_dots(path: Column) -> Column:
    """Remove '.' and '..' segments of an absolute path."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    body = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    kept = F.aggregate(
        body,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == ".", acc)
        .when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, x)),
    )
    closing = F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.concat(F.lit("/"), F.array_join(closing, "/"))


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` seen from ``base``."""
    scheme = F.regexp_extract(base, _SCHEME, 0)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    no_fragment = F.regexp_extract(base, r"^([^#]*)", 1)
    no_query = F.regexp_extract(base, r"^([^?#]*)", 1)
    base_path = F.regexp_replace(no_query, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")
    folder = F.regexp_extract(base_path, r"^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)

    href_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    href_rest = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    target = F.when(href_path.startswith("/"), href_path).otherwise(F.concat(folder, href_path))
    dotted = target.rlike(r"(^|/)\.{1,2}(/|$)")
    target = F.when(dotted, _squash_dots(target)).otherwise(target)

    return (
        F.when(base.isNull() | (base == ""), href)
        .when(href.rlike(_SCHEME), href)
        .when(href == "", base)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("#"), F.concat(no_fragment, href))
        .when(href.startswith("?"), F.concat(no_query, href))
        .otherwise(F.concat(root, target, href_rest))
    )
