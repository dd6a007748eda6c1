"""Text normalisation as native expressions, with Arrow only for rare residue rows."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Sequence
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import vocab


def _combining(char: str) -> bool:
    return unicodedata.combining(char) != 0


@lru_cache(maxsize=None)
def _fold_table(form: str, any_mark: bool) -> tuple[str, str]:
    """translate() arguments: every BMP letter whose decomposition leaves one base letter,
    then the marks themselves, which translate() deletes for want of a partner."""
    source, target, marks = [], [], []
    for code in range(0x80, 0x10000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        if (_combining(char) if any_mark else 0x300 <= code <= 0x36F):
            marks.append(char)
            continue
        parts = unicodedata.normalize(form, char)
        base = "".join(p for p in parts if not (_combining(p) if any_mark else 0x300 <= ord(p) <= 0x36F))
        if parts != char and len(base) == 1:
            source.append(char)
            target.append(base)
    return "".join(source + marks), "".join(target)


# Supersets, kept to a few ranges because a long class is slow on long texts: characters that
# can make a text differ from its NFC form, and characters whose compatibility form is longer.
# Rows holding none of them never reach Python.
_NOT_LATIN = r"[\x{300}-\x{10FFFF}]"
_NFC_RESIDUE = (
    r"[\p{M}\x{340}-\x{387}\x{958}-\x{95F}\x{9DC}-\x{9DF}\x{A33}-\x{A5E}\x{B5C}-\x{B5D}\x{F43}-\x{FB9}"
    r"\x{1161}-\x{11C2}\x{1F00}-\x{2001}\x{2126}-\x{212B}\x{2329}-\x{232A}\x{2ADC}\x{F900}-\x{FB4F}"
    r"\x{10000}-\x{10FFFF}]"
)
_NFKD_RESIDUE = (
    r"[\x{BC}-\x{BE}\x{132}-\x{133}\x{13F}-\x{140}\x{149}\x{1C4}-\x{1CC}\x{1F1}-\x{1F3}\x{1E9A}\x{20A8}"
    r"\x{2100}-\x{218F}\x{2460}-\x{24FF}\x{3200}-\x{33FF}\x{FB00}-\x{FB06}\x{10000}-\x{10FFFF}]"
)


@F.pandas_udf(StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.str.normalize("NFC")


@F.pandas_udf(StringType())
def _nfkd_plain(values: pd.Series) -> pd.Series:
    return values.str.normalize("NFKD").map(
        lambda s: None if s is None else "".join(c for c in s if not _combining(c)))


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def nfc(c: Column) -> Column:
    """NFC form; only rows that can change travel to Python, the rest go as nulls."""
    return F.coalesce(_nfc(F.when(c.rlike(_NOT_LATIN) & c.rlike(_NFC_RESIDUE), c)), c)


# White space as Unicode sees it. Turning it into blanks first keeps the regular expression to
# plain blanks, which is several times faster than a Unicode class on long texts.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_EDGES = f"^[ {_SPACES}]+|[ {_SPACES}]+$"


def collapse_space(c: Column) -> Column:
    blanks = F.translate(c, _SPACES, " " * len(_SPACES))
    return F.trim(F.regexp_replace(blanks, "  +", " "))


def trim_space(c: Column) -> Column:
    return F.regexp_replace(c, _EDGES, "")


def normalise_text(c: Column) -> Column:
    return empty_to_null(collapse_space(nfc(c)))


def fold(c: Column) -> Column:
    """Lower case without accents, for search and lookup keys."""
    source, target = _fold_table("NFD", False)
    return F.trim(F.translate(F.lower(c), source, target))


def fold_compat(c: Column) -> Column:
    source, target = _fold_table("NFKD", True)
    plain = F.coalesce(_nfkd_plain(F.when(c.rlike(_NFKD_RESIDUE), c)), c)
    return F.lower(F.translate(plain, source, target))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-z0-9]", "")


def token_key(c: Column) -> Column:
    return squeeze(fold_compat(c))


def _tokens(c: Column) -> Column:
    parts = F.split(fold_compat(F.coalesce(c, F.lit(""))), r"(?U)\W+")
    return F.transform(parts, squeeze)


def distinctive_tokens(
    name: Column,
    city: Column | None = None,
    stopwords: Sequence[str] = vocab.STOPWORDS,
    suffix: str = "museum",
) -> Column:
    """Sorted set of words that identify an entity; a long compound also yields its stem."""
    def wanted(tokens: Column) -> Column:
        return F.filter(tokens, lambda t: (F.length(t) >= 3) & ~t.isin(*stopwords))

    own = wanted(_tokens(name))
    compounds = F.filter(own, lambda t: t.endswith(suffix) & (F.length(t) > len(suffix) + 3))
    stems = wanted(F.transform(compounds, lambda t: F.substr(t, F.lit(1), F.length(t) - len(suffix))))
    every = F.concat(own, stems)
    if city is not None:
        every = F.concat(every, wanted(_tokens(city)))
    return F.array_sort(F.array_distinct(every))


def match_norm(c: Column) -> Column:
    """Form used by the literal and identity gates; a no-break space counts as space."""
    return F.lower(collapse_space(F.replace(c, F.lit("&nbsp;"), F.lit(" "))))


def match_norm_loose(c: Column) -> Column:
    """As match_norm, also repairing a doubly encoded euro sign and blanking separators."""
    text = F.replace(c, F.lit("&nbsp;"), F.lit(" "))
    for broken in ("\u00e2\u201a\u00ac", "\u00e2\u0082\u00ac"):
        text = F.replace(text, F.lit(broken), F.lit("\u20ac"))
    return F.lower(collapse_space(F.regexp_replace(text, r"[|:–—\-<>]", " ")))


def strip_marks(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[^\w\s]", "")


def clean_html(c: Column) -> Column:
    text = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", "")
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return trim_space(text)


def html_title(c: Column, limit: int = 120) -> Column:
    return F.left(collapse_space(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(limit))


def clean_city(c: Column) -> Column:
    city = F.regexp_replace(c, r"^[ ,.\-]+|[ ,.\-]+$", "")
    city = F.when(F.lower(city).startswith("in "), F.trim(F.substr(city, F.lit(4)))).otherwise(city)
    city = F.trim(F.split_part(city, F.lit(","), F.lit(1)))
    return F.trim(F.regexp_replace(city, r"\s*\([^)]*\)", ""))


def scrub(c: Column, patterns: Iterable[str] = vocab.SECRET_PATTERNS) -> Column:
    return reduce(lambda acc, p: F.regexp_replace(acc, p, vocab.SECRET_MARK), patterns, c)


def word_count(c: Column) -> Column:
    text = collapse_space(F.coalesce(c, F.lit("")))
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def truncate_text(c: Column, limit: int, mark: str = vocab.TRUNCATION_MARK) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit(mark))).otherwise(c)


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """True when one of the literal words occurs in ``c`` (one native scan per word)."""
    return reduce(lambda acc, w: acc | c.contains(w), words[1:], c.contains(words[0]))


def count_present(c: Column, words: Sequence[str]) -> Column:
    return reduce(lambda acc, w: acc + c.contains(w).cast("int"), words[1:], c.contains(words[0]).cast("int"))


def locale_fallback(texts: Column, locale: Column | str, default: str = vocab.CANONICAL_LOCALE) -> Column:
    lang = F.lit(locale) if isinstance(locale, str) else locale
    return F.coalesce(texts[lang], texts[default])


def localized_urls(base: str, key: Column, locales: Sequence[str] = vocab.LOCALES, section: str = "musea") -> Column:
    names = F.array(*[F.lit(x) for x in locales])
    return F.map_from_arrays(names, F.transform(names, lambda x: F.concat(F.lit(base + "/"), x, F.lit(f"/{section}/"), key, F.lit("/"))))
