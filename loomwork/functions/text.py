"""Text functions: all built-in expressions but ``fold``, which needs Unicode decomposition."""

from __future__ import annotations

import re
import unicodedata
from itertools import filterfalse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters that Unicode does not decompose, and their folded spelling; marks that folding deletes.
ATOMIC_LETTERS = {"Æ": "ae", "æ": "ae", "Œ": "oe", "œ": "oe", "ß": "ss", "Ø": "o", "ø": "o", "Þ": "th", "þ": "th", "Ð": "d", "ð": "d", "Đ": "d", "đ": "d", "Ł": "l", "ł": "l"}
APOSTROPHES = "'’ʼ‘`"
#: Spellings of letters in addresses, and marks that addresses drop.
SLUG_LETTERS = {"æ": "ae", "œ": "oe", "ø": "o", "ß": "ss", "đ": "d", "ł": "l", "þ": "th", "ð": "d"}
SLUG_DROPPED = "’'`´\"“”.,!?:;()[]"

_FOLDED = {ord(k): v for k, v in ATOMIC_LETTERS.items()} | {ord(c): None for c in APOSTROPHES}


def tokenize(text: Column) -> Column:
    """Runs of word characters of the lower-cased text, Unicode-aware."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def normalize(text: Column) -> Column:
    """Lower case; everything but a-z and 0-9 becomes one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


#: Endings whose ``s`` belongs to the word; plural endings, what words with them are longer than, and what stands instead.
NOT_PLURAL = ("ss", "us", "is", "os", "as")
PLURAL = (("ies", 4, "y", ()), ("s", 3, "", NOT_PLURAL))


def singular(token: Column) -> Column:
    """``token`` by the first rule of ``PLURAL`` that it fits."""
    out = token
    for end, longer, instead, unless in reversed(PLURAL):
        fits = token.endswith(end) & (F.length(token) > longer)
        for other in unless:
            fits = fits & ~token.endswith(other)
        out = F.when(fits, F.concat(F.substring(token, F.lit(1), F.length(token) - len(end)), F.lit(instead))).otherwise(out)
    return out


def singular_of(word: str) -> str:
    """``singular`` of a word that the driver has."""
    return next((word.removesuffix(end) + instead for end, longer, instead, unless in PLURAL if word.endswith(end) and len(word) > longer and not word.endswith(unless or ("\0",))), word)


def phrase_tokens(text: Column) -> Column:
    """Distinct singular tokens of the normalised text."""
    return F.array_distinct(F.transform(F.filter(F.split(normalize(text), " "), lambda t: t != ""), singular))


def _bare(text: str, spelled: dict[int, str | None]) -> str:
    """``text`` in its parts: letters as ``spelled`` has them, others without their accents, in lower case."""
    parts = unicodedata.normalize("NFKD", text.translate(spelled))
    return "".join(filterfalse(unicodedata.combining, parts)).translate(spelled).lower()


def fold_name(name: str | None) -> str | None:
    """Matching key of a name: no accents, case, apostrophes or punctuation."""
    return None if name is None else " ".join(re.sub(r"[\W_]", " ", _bare(name, _FOLDED)).split())


@F.pandas_udf(T.StringType())
def fold(names: pd.Series) -> pd.Series:
    return names.map(fold_name, na_action="ignore")


def bigrams(text: Column) -> Column:
    """Distinct 2-grams; a text of one character is its own."""
    n = F.length(text)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def edit_budget(text: Column, base: int = 3) -> Column:
    """Edits allowed for a text: three tenths of its length, at least 1 and at most ``base``."""
    return F.greatest(F.lit(1), F.least(F.lit(base), F.floor(F.length(text) * 3 / 10).cast("int")))


def bounded_distance(a: Column, b: Column, budget: int) -> Column:
    """Levenshtein distance, null beyond ``budget``."""
    d = F.levenshtein(a, b, budget)
    return F.when(d >= 0, d)


def squeeze(text: Column) -> Column:
    """White space squeezed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def split_of(text: Column, validation_per_10000: int = 500) -> Column:
    """``val`` or ``train`` by the first eight hex digits of the text's SHA-1: stable across runs and engines."""
    h = F.conv(F.substring(F.sha1(text.cast("binary")), 1, 8), 16, 10).cast("long")
    return F.when(h % 10000 < validation_per_10000, "val").otherwise("train")


def name_keys(name: Column) -> Column:
    """The lower-cased name, and its part before ``//`` if it has one."""
    low = F.lower(F.trim(name))
    return F.array_distinct(F.array(low, F.trim(F.split(low, "//")[0])))


def unit(value: Column) -> Column:
    """Clamped to 0..1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def json_object(text: Column) -> Column:
    """From the first brace to the last: the JSON object inside a chatty answer."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def numeric(text: Column) -> Column:
    """A whole number written as text, as double; symbols and fractions give null."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[+-]?\d{1,9}$"), t).cast("int").cast("double")


_SLUGGED = {ord(k): v for letter, v in SLUG_LETTERS.items() for k in {letter, letter.upper()} if len(k) == 1} | {ord(c): None for c in SLUG_DROPPED}


def fold_slug(name: str | None) -> str | None:
    """Name to address: no accents, dropped marks vanish, all else that is no letter or digit becomes one hyphen."""
    return None if name is None else "-".join(re.findall("[a-z0-9]+", _bare(name, _SLUGGED)))


@F.pandas_udf(T.StringType())
def slug(names: pd.Series) -> pd.Series:
    return names.map(fold_slug, na_action="ignore")


def slug_candidates(name: Column) -> Column:
    """Addresses to try in order: that of the first face, then that of the whole name; each once, blank ones left out."""
    return F.filter(F.array_distinct(F.array(slug(F.split(name, " // ")[0]), slug(name))), lambda s: s != "")


#: Up to so many figures are called so; more are a crowd.
FIGURES = ((0, "no figures"), (1, "a single figure"), (2, "two figures"), (5, "a small group of figures"))
CROWD = "a crowd of figures"


def count_phrase(n: Column) -> Column:
    """A phrase for a number of figures."""
    out = F.lit(CROWD)
    for most, phrase in reversed(FIGURES):
        out = F.when(n <= most, phrase).otherwise(out)
    return out


def letters_in_order(letters: Column, order: str = "WUBRG") -> Column:
    """An array of letters as text in canonical order."""
    return F.array_join(F.filter(F.array(*(F.lit(c) for c in order)), lambda c: F.array_contains(letters, c)), "")


def visible_text(html: Column) -> Column:
    """Text of an HTML page: scripts, styles and tags removed, white space squeezed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))
