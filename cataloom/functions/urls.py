"""URL parts and tests. Regular expressions are used because parse_url rejects odd input."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .text import contains_any, empty_to_null

_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"


def netloc(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME + r"//([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, _SCHEME + r"(?://[^/?#]*)?([^?#]*)", 1)


def host(url: Column) -> Column:
    return F.split_part(netloc(url), F.lit(":"), F.lit(1))


def extract_domain(url: Column) -> Column:
    return F.split_part(F.regexp_replace(netloc(url), r"^www\.", ""), F.lit(":"), F.lit(1))


def base_domain(name: Column) -> Column:
    """Last two labels of a host name."""
    return F.coalesce(empty_to_null(F.regexp_extract(name, r"([^.]*\.[^.]*)$", 1)), name)


def same_or_subdomain(url: Column, base: Column) -> Column:
    return (netloc(url) == base) | netloc(url).endswith(F.concat(F.lit("."), base))


def is_blocklisted(
    url: Column,
    blocklist: Sequence[str] = vocab.AGGREGATOR_DOMAINS,
    label_mark: str = vocab.AGGREGATOR_LABEL_MARK,
) -> Column:
    """Host equal to or under a listed domain, or a marked first label; no URL counts as listed."""
    name = host(url)
    listed = name.rlike(r"(?:^|\.)(?:" + "|".join(re.escape(d) for d in blocklist) + ")$")
    return F.coalesce(url == "", F.lit(True)) | listed | F.split_part(name, F.lit("."), F.lit(1)).contains(label_mark)


def is_external(url: Column, marks: Sequence[str] = vocab.INTERNAL_LINK_MARKS) -> Column:
    given = F.coalesce(url, F.lit(""))
    inner = (given == "") | given.startswith("/") | given.startswith("#")
    return ~inner & ~contains_any(F.lower(given), marks)


def normalise_site(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.concat(netloc(url), path(url)), "/+$", ""))


def site_root(url: Column, key: Column | None = None, deep_link_keys: Sequence[str] = ()) -> Column:
    root = F.concat(F.lit("https://"), netloc(url), F.lit("/"))
    if key is None or not deep_link_keys:
        return root
    deep = F.regexp_replace(F.concat(F.lit("https://"), netloc(url), path(url)), "/+$", "")
    return F.when(key.isin(*deep_link_keys), deep).otherwise(root)


def repair_scheme(url: Column) -> Column:
    good = url.startswith("https://") | url.startswith("http://")
    return F.when(good, url).otherwise(F.regexp_replace(url, "^(https|http)[:/]*", "$1://"))


def page_store_key(url: Column) -> Column:
    return F.concat(F.replace(netloc(url), F.lit(":"), F.lit("_")), F.lit("_"), F.left(F.sha2(url, 256), F.lit(16)))


def trim_slash(url: Column) -> Column:
    return F.lower(F.regexp_replace(url, "/+$", ""))
