"""Page text, identity fields and links from raw HTML.

Regular pages are read by native expressions. Pages whose skipped elements nest, are left
open, or that hold a stray ``<`` or a rare entity go through the standard library parser in
an Arrow function; every other row passes that function as a null.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .text import trim_space
from .urls import netloc, path

TEXT_SKIP = ("script", "style", "noscript", "svg", "header", "footer", "nav")
IDENTITY_SKIP = ("script", "style", "noscript", "svg")
LINK_SKIP = ("script", "style")

_MARK = "\u0001"
_TAG = r"<[a-zA-Z/!?](?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>"
_A_TAG = r"(?is)<a\s(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>"
# Entities replaced natively; the ampersand comes last so that nothing is unescaped twice.
_ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"),
    ("&nbsp;", "\u00a0"), ("&euro;", "€"), ("&copy;", "©"), ("&middot;", "·"), ("&ndash;", "–"),
    ("&mdash;", "—"), ("&hellip;", "…"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"),
    ("&rdquo;", "”"), ("&eacute;", "é"), ("&egrave;", "è"), ("&euml;", "ë"), ("&iuml;", "ï"),
    ("&ouml;", "ö"), ("&uuml;", "ü"), ("&amp;", "&"),
)
_RARE_ENTITY = "&(?!(?:" + "|".join(name[1:-1] for name, _ in _ENTITIES) + ");)[A-Za-z#]"


class _Events(HTMLParser):
    """What a page holds, in order: ("+", tag, attributes), ("-", tag, None) and ("text", text, None)."""

    def __init__(self, page: str):
        super().__init__()
        self.found: list[tuple] = []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.found.append(("+", tag, attrs))

    def handle_endtag(self, tag):
        self.found.append(("-", tag, None))

    def handle_data(self, data):
        self.found.append(("text", data.strip(), None))


def _visible(page: str, skip: tuple[str, ...]):
    """Events outside skipped elements; a closing tag of one that is not open is passed over."""
    hidden = 0
    for kind, value, attrs in _Events(page).found:
        if kind != "text" and value in skip:
            hidden = hidden + 1 if kind == "+" else max(hidden - 1, 0)
        elif not hidden or kind == "-":
            yield kind, value, attrs


def _pieces(page: str, skip: tuple[str, ...]) -> list[str]:
    return [value for kind, value, _ in _visible(page, skip) if kind == "text" and value]


def _fields(page: str, preview: int) -> tuple[str, str, str, str]:
    """Title, first-level headings, description and the first body pieces."""
    place, texts, description = "", {"title": [], "h1": [], "": []}, ""
    for kind, value, attrs in _visible(page, IDENTITY_SKIP):
        if kind == "text":
            texts[place] += [value] if value else []
        elif value in ("title", "h1"):
            place = value if kind == "+" else "" if place == value else place
        elif kind == "+" and value == "meta":
            given = {name: text or "" for name, text in attrs}
            description = given.get("content", "") if given.get("name", "").lower() == "description" else description
    return " ".join(texts["title"]), " ".join(texts["h1"]), description.strip(), " ".join(texts[""][:preview])


def _chunks_udf(skip: tuple[str, ...]):
    @F.pandas_udf(StringType())
    def parse(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: None if page is None else _MARK.join(_pieces(page, skip)))

    return parse


_IDENTITY = StructType([StructField(n, StringType()) for n in ("title", "h1", "meta_description", "body_preview")])


def _identity_udf(preview: int):
    @F.pandas_udf(_IDENTITY)
    def parse(pages: pd.Series) -> pd.DataFrame:
        rows = [(None,) * 4 if page is None else _fields(page, preview) for page in pages]
        return pd.DataFrame(rows, columns=_IDENTITY.names)

    return parse


def unescape(c: Column) -> Column:
    plain = c
    for entity, char in _ENTITIES:
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.when(c.contains("&"), plain).otherwise(c)


def keep_open_references(page: Column) -> Column:
    """Strict reading: a character reference without its semicolon is text, as in a page cut off inside one."""
    return F.regexp_replace(page, "&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9a-fA-F]+);)", "&amp;")


def strip_blocks(page: Column, skip: tuple[str, ...]) -> Column:
    """Drop comments and whole skipped elements in one left-to-right pass."""
    names = "|".join(skip)
    return F.regexp_replace(
        page, rf"(?is)<!--.*?-->|<({names})\b[^>]*(?<!/)>.*?</\1\s*>", _MARK)


def _irregular(body: Column, texts: list[Column], skip: tuple[str, ...]) -> Column:
    """Left-over skipped tags in the body, or a stray ``<`` or rare entity in a text part."""
    odd = body.rlike(rf"(?i)</?(?:{'|'.join(skip)})\b")
    for text in texts:
        odd = odd | text.contains("<") | text.rlike(_RARE_ENTITY)
    return odd


def _split_chunks(marked: Column) -> Column:
    return F.filter(F.transform(F.split(marked, _MARK), lambda x: trim_space(x)), lambda x: x != "")


def with_chunks(df: DataFrame, page: str, out: str, skip: tuple[str, ...] = TEXT_SKIP) -> DataFrame:
    """Add the non-empty text pieces between tags, in order. Steps are separate columns so
    that each pass over the page is made once."""
    staged = df.withColumn("_body", strip_blocks(F.col(page), skip))
    staged = staged.withColumn("_marked", F.regexp_replace("_body", _TAG, _MARK))
    staged = staged.withColumn("_odd", _irregular(F.col("_body"), [F.col("_marked")], skip))
    staged = staged.withColumn("_read", _chunks_udf(skip)(F.when(F.col("_odd"), F.col(page))))
    text = F.coalesce("_read", unescape(F.col("_marked")))
    return staged.withColumn("_text", text).withColumn(out, _split_chunks(F.col("_text"))).drop("_body", "_marked", "_odd", "_read", "_text")


def with_visible_text(df: DataFrame, page: str, out: str) -> DataFrame:
    chunked = with_chunks(df, page, "_chunks")
    return chunked.withColumn(out, F.regexp_replace(F.array_join("_chunks", "\n"), r"\n{3,}", "\n\n")).drop("_chunks")


def _inner_text(fragments: Column) -> Column:
    """Text of element bodies: pieces trimmed and joined by single blanks."""
    joined = F.array_join(F.transform(fragments, lambda x: F.regexp_replace(x, _TAG, _MARK)), _MARK)
    return F.array_join(_split_chunks(unescape(joined)), " ")


def _bodies(page: Column, tag: str) -> Column:
    return F.regexp_extract_all(page, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1))


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"(?is)[\s\"']{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.coalesce(*[F.nullif(F.regexp_extract(tag, pattern, i), F.lit("")) for i in (1, 2, 3)])


def with_identity(df: DataFrame, page: str, out: str, preview: int = 20) -> DataFrame:
    """Add struct(title, h1, meta_description, body_preview)."""
    staged = df.withColumn("_body", strip_blocks(F.col(page), IDENTITY_SKIP))
    body = F.col("_body")
    metas = F.regexp_extract_all(body, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    described = F.filter(metas, lambda m: F.lower(_attribute(m, "name")) == "description")
    rest = F.regexp_replace(body, r"(?is)<(title|h1)\b[^>]*>.*?</\1\s*>", _MARK)
    staged = staged.withColumns({
        "_rest": F.regexp_replace(rest, _TAG, _MARK), "_titles": _bodies(body, "title"), "_h1s": _bodies(body, "h1"),
        "_meta": F.coalesce(_attribute(F.try_element_at(described, F.lit(-1)), "content"), F.lit(""))})
    staged = staged.withColumn("_odd", _irregular(
        body, [F.col("_rest"), *[F.regexp_replace(F.array_join(c, " "), _TAG, "") for c in ("_titles", "_h1s")], F.col("_meta")], IDENTITY_SKIP))
    staged = staged.withColumn("_read", _identity_udf(preview)(F.when(F.col("_odd"), F.col(page))))
    staged = staged.withColumn("_plain", unescape(F.col("_rest")))
    native = {
        "title": _inner_text(F.col("_titles")), "h1": _inner_text(F.col("_h1s")),
        "meta_description": trim_space(unescape(F.col("_meta"))),
        "body_preview": F.array_join(F.slice(_split_chunks(F.col("_plain")), 1, preview), " ")}
    # One column per field first: a field read several times later is then computed once.
    staged = staged.withColumns({f"_f_{n}": F.when(F.col("_odd"), F.col(f"_read.{n}")).otherwise(c) for n, c in native.items()})
    return staged.withColumn(out, F.struct(*[F.col(f"_f_{n}").alias(n) for n in native])).drop(
        "_body", "_rest", "_titles", "_h1s", "_meta", "_odd", "_read", "_plain", *[f"_f_{n}" for n in native])


def _remove_dot_segments(target: Column) -> Column:
    parts = F.split(target, "/")
    last = F.element_at(parts, -1)
    empty = F.array().cast("array<string>")
    walked = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), empty,
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    tail = F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.regexp_replace(F.concat(F.lit("/"), F.array_join(walked, "/"), tail), "^/+", "/")


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` seen on page ``base``."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    target, query = F.regexp_extract(href, r"^([^?]*)", 1), F.regexp_extract(href, r"^[^?]*(.*)$", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path(base), "^(.*/)", 1), F.lit("")), F.lit("/"))
    full = F.when(href.startswith("/"), target).otherwise(F.regexp_replace(F.concat(folder, target), "/{2,}", "/"))
    tidy = F.when(full.rlike(r"(^|/)\.\.?(/|$)"), _remove_dot_segments(full)).otherwise(full)
    return (F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
            .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
            .when(href.startswith("?"), F.concat(root, path(base), href))
            .otherwise(F.concat(root, tidy, query)))


def _usable(href: Column) -> Column:
    return href.isNotNull() & (href != "") & ~href.rlike("^(?:mailto:|tel:|javascript:)")


def _clean_href(tag: Column) -> Column:
    return F.trim(F.split_part(F.trim(unescape(_attribute(tag, "href"))), F.lit("#"), F.lit(1)))


def links(page: Column, base: Column) -> Column:
    """Array of absolute link targets in document order, duplicates kept."""
    tags = F.regexp_extract_all(strip_blocks(page, LINK_SKIP), F.lit(_A_TAG), F.lit(0))
    hrefs = F.filter(F.transform(tags, lambda x: _clean_href(x)), _usable)
    return F.transform(hrefs, lambda h: resolve(base, h))


def anchors(page: Column, base: Column) -> Column:
    """Array of struct(url, text) outside navigation, header and footer."""
    found = F.regexp_extract_all(strip_blocks(page, TEXT_SKIP), F.lit(_A_TAG + r".*?</a\s*>"), F.lit(0))
    rows = F.transform(found, lambda a: F.struct(
        _clean_href(F.regexp_extract(a, _A_TAG, 0)).alias("href"),
        F.array_join(_split_chunks(unescape(F.regexp_replace(a, _TAG, _MARK))), " ").alias("text")))
    usable = F.filter(rows, lambda r: _usable(r["href"]))
    return F.transform(usable, lambda r: F.struct(resolve(base, r["href"]).alias("url"), r["text"].alias("text")))
