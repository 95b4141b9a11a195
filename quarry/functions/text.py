"""Scalar functions as columns: tokens, paths, slugs, lines, metadata."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Small Latin letters with one diacritic, by code, and the letter without it.
FOLD = {c: parts[0] for c in range(0xE0, 0x1F00) if len(parts := unicodedata.normalize("NFD", chr(c))) == 2 and "a" <= parts[0] <= "z"}
ACCENTED, PLAIN = "".join(map(chr, FOLD)), "".join(FOLD.values())
#: Diacritics that are characters of their own.
MARKS = "[\u0300-\u036f]+"


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case, without Latin diacritics."""
    # letters beyond PLAIN, the separate diacritics, are dropped
    folded = F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED + "".join(map(chr, range(0x300, 0x370))), PLAIN)
    return F.regexp_extract_all(folded, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def canonical_path(path: Column, repo: str = "") -> Column:
    """Relative to the repository, with slashes, and without one leading ./"""
    if repo:
        path = F.when(path.startswith(repo.rstrip("/") + "/"), F.substr(path, F.lit(len(repo.rstrip("/")) + 2))).otherwise(path)
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def escape_like(text: Column) -> Column:
    for c in "\\%_":
        text = F.replace(text, F.lit(c), F.lit("\\" + c))
    return text


def path_hash(path: Column) -> Column:
    """h * 31 + byte over the UTF-8 bytes, its low 24 bits as six hex digits."""
    raw = F.hex(path.cast("binary"))
    places = F.sequence(F.lit(1), F.length(raw) - 1, F.lit(2))
    values = F.when(F.length(raw) > 0, F.transform(places, lambda i: F.conv(F.substr(raw, i, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<long>"))
    h = F.aggregate(values, F.lit(0).cast("long"), lambda a, b: (a * 31 + b) % 16777216)
    return F.lpad(F.lower(F.hex(h)), 6, "0")


def slug(path: Column) -> Column:
    """The path's last part in lower case, others than letters and digits as _, and its hash."""
    stem = F.element_at(F.split(path, "/"), -1)
    return F.concat(F.regexp_replace(F.lower(stem), r"[^\p{L}\p{N}]", "_"), F.lit("_"), path_hash(path))


def first_line(text: Column) -> Column:
    return F.regexp_replace(F.split_part(text, F.lit("\n"), F.lit(1)), "\r$", "")


def last_segment(identifier: Column) -> Column:
    return F.element_at(F.split(identifier, "::"), -1)


def line_count(text: Column) -> Column:
    """Lines without a phantom one after a final line feed; none in an empty text."""
    return F.when(text == "", 0).otherwise(F.size(F.split(F.regexp_replace(text, "\r?\n$", ""), "\n", -1)))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def commit_text(title: Column, body: Column) -> Column:
    return F.when(F.coalesce(body, F.lit("")) == "", title).otherwise(F.concat_ws("\n\n", title, body))


def json_or(metadata: Column, path: str, default: str = "") -> Column:
    return F.coalesce(F.get_json_object(metadata, path), F.lit(default))


# Kinds of symbols and how they are shown.
KINDS = {"function": "fn", "struct": "struct", "enum": "enum", "trait": "trait", "implmethod": "fn", "traitmethod": "fn", "typealias": "type", "const": "const", "static": "static", "module": "mod", "macro": "macro", "comments": "comments", "imports": "imports"}


def kind_label(kind: Column) -> Column:
    """A kind as it is shown; unknown ones count as functions."""
    pairs = [F.lit(x) for kv in KINDS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit("fn"))


@F.pandas_udf(StringType())
def content_hash(content: pd.Series) -> pd.Series:
    """64-bit xxh3 of the UTF-8, as sixteen hex digits: Spark has no such function."""
    import xxhash

    return content.map(lambda t: None if t is None else xxhash.xxh3_64_hexdigest(t.encode()))
