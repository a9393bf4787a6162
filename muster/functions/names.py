"""Name keys and proximity, for names that were read from images."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Cyrillic letters that look like Latin ones, and those.
CONFUSABLE = ("авекмнорстух", "abekmhopctyx")


@pandas_udf(StringType())
def nfkc(names: pd.Series) -> pd.Series:
    return names.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@pandas_udf(StringType())
def nfd(names: pd.Series) -> pd.Series:
    return names.map(lambda x: unicodedata.normalize("NFD", x), na_action="ignore")


def _ascii_first(udf, name: Column) -> Column:
    """Normal forms leave ASCII as it is, so that Python sees other names only."""
    return F.when(name.rlike(r"^[\x00-\x7F]*$"), name).otherwise(udf(F.when(~name.rlike(r"^[\x00-\x7F]*$"), name)))


def name_key(name: Column) -> Column:
    """Letters and digits of the compatibility form, lower-cased."""
    return F.regexp_replace(F.lower(_ascii_first(nfkc, name)), r"[^\p{L}\p{N}]", "")


def fold_confusables(key: Column) -> Column:
    return F.translate(F.regexp_replace(_ascii_first(nfd, key), r"\p{Mn}", ""), *CONFUSABLE)


def duplicate_key(name: Column) -> Column:
    return fold_confusables(name_key(name))


def similarity(a: Column, b: Column, distance: Column | None = None) -> Column:
    return 1 - (F.levenshtein(a, b) if distance is None else distance) / F.greatest(F.length(a), F.length(b), F.lit(1))


def proximity(a: Column, b: Column, distance: Column | None = None) -> Column:
    """Of two keys: exact-key, strong, weak or none; short and contained keys have rules of their own. `distance`: their
    edit distance, where it is known already."""
    d = F.levenshtein(a, b) if distance is None else distance
    s = similarity(a, b, d)
    short = F.least(F.length(a), F.length(b)) < 5
    within = (F.length(a) > 0) & (F.length(b) > 0) & (F.contains(a, b) | F.contains(b, a)) & (F.abs(F.length(a) - F.length(b)) >= 2)
    return (
        F.when(a == b, "exact-key")
        .when(short, F.when(d <= 1, "weak").otherwise("none"))
        .when(within, F.when(s >= 0.6, "weak").otherwise("none"))
        .when(s >= 0.8, "strong").when(s >= 0.6, "weak").otherwise("none")
    )


def tier(near: Column, same_value: Column) -> Column:
    """high, medium or low; null for a pair that is dropped."""
    close = near.isin("exact-key", "strong")
    return F.when(close & same_value, "high").when(close, "medium").when((near == "weak") & same_value, "medium").when((near == "none") & same_value, "low")


#: Marks that no handle holds, marks that one may hold, and the blocks of its letters and ornaments.
JUNK = r"[|\\«»№<>§¢]"
PUNCTUATION = r"._\-•⚓←→'’`,()\[\]! *~^"
SCRIPTS = r"À-ɏḀ-ỿЀ-ӿ぀-ヿ㐀-鿿豈-﫿가-힣ᄀ-ᇿ†-•←-⇿①-⓿\x{1F000}-\x{1FAFF}"


def looks_misread(name: Column) -> Column:
    """Fewer than two letters or digits, a junk mark, a share of letters and digits under 0.6, or a foreign character."""
    t = F.trim(name)
    plain = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    foreign = t.rlike(rf"[^\sA-Za-z\p{{Nd}}{PUNCTUATION}{SCRIPTS}]")
    return F.coalesce((plain < 2) | t.rlike(JUNK) | (plain / F.greatest(F.length(t), F.lit(1)) < 0.6) | foreign, F.lit(True))


#: A tag in brackets, and a prefix that was one.
TAG = r"\(\s*([A-Za-z0-9]{1,5})\s*\)\s*"
GARBLED_TAG = r"(?:.{0,9}?\)|.{0,6}?\([^\s)]{1,5})\s*"


def strip_alliance_tag(name: Column) -> Column:
    """(tag, name): the first `(TAG)` of 1 to 5 letters or digits within 20 characters and what follows it; else a garbled
    prefix is dropped if two characters remain. A name is never left empty; without a tag it is null."""
    window = F.substring(name, 1, 20)
    strict, garbled = f"(?s)^(.*?{TAG})", f"^({GARBLED_TAG})"
    after = lambda pattern: F.trim(F.substring(name, F.length(F.regexp_extract(window, pattern, 1)) + 1, F.length(name)))
    tagged, salvaged, whole = after(strict), after(garbled), F.trim(name)
    has_tag = window.rlike(strict)
    salvage = ~has_tag & window.rlike(garbled) & (F.length(F.replace(salvaged, F.lit(" "), F.lit(""))) >= 2)
    tag = F.when(has_tag & (tagged != ""), F.regexp_extract(window, strict, 2))
    return F.struct(tag.alias("tag"), F.when(tag.isNotNull(), tagged).when(salvage, salvaged).otherwise(whole).alias("name"))


#: The byte that each character stands for where UTF-8 was read as Windows-1252 or Latin-1; the five bytes that the former
#: leaves undefined were taken as control characters.
_BYTES = {bytes([b]).decode("latin-1"): b for b in range(0x80, 0x100)} | {bytes([b]).decode("cp1252"): b for b in range(0x80, 0x100) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _class(first: int, last: int) -> str:
    return "[" + "".join(re.escape(c) for c, b in _BYTES.items() if first <= b <= last) + "]"


_MORE = _class(0x80, 0xBF)
#: What two to four bytes of one character look like when they were read one by one.
_DAMAGE = re.compile(f"{_class(0xC2, 0xDF)}{_MORE}|{_class(0xE0, 0xEF)}{_MORE}{{2}}|{_class(0xF0, 0xF4)}{_MORE}{{3}}")


def _undamaged(match: re.Match) -> str:
    """The character that a stretch of damage was, if such a one is likely in a name: of those of two bytes Latin, Greek and
    Cyrillic letters and marks, since a capital before a quotation mark or a dash must stay what it is."""
    try:
        c = bytes(_BYTES[x] for x in match[0]).decode("utf-8")
    except UnicodeDecodeError:
        return match[0]
    likely = c < "\u0250" or "\u0370" <= c < "\u0524" if len(match[0]) == 2 else unicodedata.category(c) not in ("Cn", "Co", "Cs")
    return c if likely else match[0]


@pandas_udf(StringType())
def _repair_encoding(names: pd.Series) -> pd.Series:
    """UTF-8 read as Windows-1252 or Latin-1 turned back, wherever it stands in a name and however often it was done (each
    time leaves fewer characters), then the composed form."""

    def fix(s: str) -> str:
        while (t := _DAMAGE.sub(_undamaged, s)) != s:
            s = t
        return unicodedata.normalize("NFC", s)

    return names.map(fix, na_action="ignore")


def normalize_name(name: Column) -> Column:
    """Encoding damage repaired; full-width ASCII narrowed; zero-width marks out; runs of spaces one; trimmed."""
    wide = "".join(map(chr, [*range(0xFF01, 0xFF5F), 0x3000]))
    narrow = "".join(map(chr, [*range(0x21, 0x7F), 0x20]))
    n = F.translate(_ascii_first(_repair_encoding, name), wide, narrow)
    return F.trim(F.regexp_replace(F.regexp_replace(n, "[​-‍﻿]", ""), " {2,}", " "))


#: The blocks of kana, and of the letters between which no space belongs.
_KANA, _CJK = "぀-ヿ", "぀-ヿ㐀-䶿一-鿿豈-﫿"


def fix_substitutions(name: Column) -> Column:
    """Arrows at the ends restored, the kanji for one next to kana as the prolonging mark, no spaces between CJK
    letters, none around an underscore between word characters."""
    n = F.regexp_replace(name, r"^(?:«=|«-|<=|<<|«)\s*", "←")
    n = F.regexp_replace(n, r"\s*(?:=>|>>|=»|->|»)$", "→")
    n = F.when(n.startswith("←"), F.regexp_replace(n, ">$", "→")).otherwise(n)
    n = F.regexp_replace(n, f"(?<=[{_KANA}])一|一(?=[{_KANA}])", "ー")
    n = F.regexp_replace(n, f"(?<=[{_CJK}]) (?=[{_CJK}])", "")
    return F.regexp_replace(n, r"(?U)(?<=\w) *_ *(?=\w)", "_")


#: Cyrillic letters of a Latin shape.
LOOKALIKES = "АВЕКМНОРСТХаеорсухк"


def distinctive_cyrillic(text: Column) -> Column:
    """Whether a Cyrillic letter occurs that no Latin one looks like."""
    return F.regexp_replace(text, f"[{LOOKALIKES}]", "").rlike("[Ѐ-ӿ]")


def count_of(text: Column, kind: str) -> Column:
    """How many characters of a class a text has."""
    return F.length(F.regexp_replace(text, f"[^{kind}]", ""))


def identity_length(text: Column) -> Column:
    """Characters that tell a name from another: ASCII letters and digits, and Cyrillic ones."""
    return count_of(text, "A-Za-z0-9Ѐ-ӿ")


def ambiguous_cyrillic(text: Column) -> Column:
    """Whether a name has Cyrillic letters, no fewer than ASCII ones, all of which some Latin letter looks like."""
    cyrillic, latin = count_of(text, "Ѐ-ӿ"), count_of(text, "A-Za-z")
    return (cyrillic > 0) & (cyrillic >= latin) & ~distinctive_cyrillic(text)


def settle_cyrillic(name: Column, russian: Column, english: Column) -> Column:
    """An ambiguous name as read again: the Russian reading if a letter of it is distinctive; else the English one if it
    has as many identifying characters, less one; else the name itself."""
    is_russian = F.coalesce((russian != "") & distinctive_cyrillic(russian), F.lit(False))
    is_english = F.coalesce((english != "") & (identity_length(english) >= identity_length(name) - 1), F.lit(False))
    return F.when(~F.coalesce(ambiguous_cyrillic(name), F.lit(False)), name).when(is_russian, russian).when(is_english, english).otherwise(name)


def has_kana(text: Column) -> Column:
    return text.rlike(f"[{_KANA}]")


def has_cjk(text: Column) -> Column:
    return text.rlike(f"[{_CJK}]")
