"""Text functions as column expressions, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .profile import LATIN, Profile


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def without_marks(c: Column | str, p: Profile = LATIN) -> Column:
    """Text without the profile's marks, of which none is ASCII: plain text is left as it is without a pass."""
    c = _col(c)
    return F.when(F.octet_length(c) > F.char_length(c), F.regexp_replace(c, p.marks, "")).otherwise(c)


def normalize_text(c: Column | str, p: Profile = LATIN) -> Column:
    """Letters and `?` in words separated by single spaces."""
    c = _col(c)
    c = F.regexp_replace(c, p.marks, "")
    c = F.regexp_replace(c, p.dashes, " ")
    if p.lowercase:
        c = F.lower(c)
    return F.trim(F.regexp_replace(c, f"[^{p.letters}?]+", " "))


def tokenize(c: Column | str, p: Profile = LATIN) -> Column:
    """The words of `normalize_text`, in one pass over what separates them; dashes are no letters."""
    c = without_marks(c, p)
    c = F.lower(c) if p.lowercase else c
    return F.array_remove(F.split(F.regexp_replace(c, f"[^{p.letters}?]+", " "), " "), "")


def has_letter(c: Column | str, p: Profile = LATIN) -> Column:
    return _col(c).rlike(f"[{p.letters}]")


def written_text(c: Column | str, p: Profile = LATIN) -> Column:
    """Text without editorial marks, normalized."""
    c = _col(c)
    for mark in p.editorial:
        c = F.regexp_replace(c, mark, "")
    return normalize_text(c, p)


def trigrams(c: Column | str) -> Column:
    w = _col(c)
    padded = F.concat(F.lit("#"), w, F.lit("#"))
    grams = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(padded, i, F.lit(3)))
    return F.when(F.length(w) > 0, grams).otherwise(F.array().cast("array<string>"))


def is_confusable(a: Column | str, b: Column | str, p: Profile) -> Column:
    return F.concat(_col(a), _col(b)).isin(*p.confusable_both) if p.confusable else F.lit(False)


def canonical(c: Column | str, p: Profile) -> Column:
    """Every letter replaced by the representative of its confusable group."""
    src, dst = p.canonical_letters()
    return F.translate(_col(c), src, dst) if src else _col(c)


def pair_kind(read: Column | str, word: Column | str, p: Profile = LATIN) -> Column:
    """How a word as read differs from the true one: same, confusable, wildcard or different."""
    r, w = _col(read), _col(word)
    kinds = F.zip_with(
        F.split(r, ""),
        F.split(w, ""),
        lambda a, b: F.when(a == b, 0).when(a == "?", 2).when(is_confusable(a, b, p), 1).otherwise(3),
    )
    worst = F.array_max(kinds)
    return (
        F.when(r == w, "same")
        .when(F.length(r) != F.length(w), "different")
        .when(worst == 3, "different")
        .when(worst == 2, "wildcard")
        .otherwise("confusable")
    )


def truncate(c: Column | str, n: int) -> Column:
    """Trimmed and cut to `n` characters; empty becomes null."""
    t = F.substring(F.trim(_col(c)), 1, n)
    return F.when(t != "", t)


def file_number(c: Column | str) -> Column:
    """All digits of a file name as one number; null if there are none."""
    return F.regexp_replace(_col(c), r"\D", "").try_cast("bigint")


def content_key(content: Column | str, salt: Column | str = "") -> Column:
    s = F.lit(salt) if isinstance(salt, str) else salt
    return F.sha2(F.concat(_col(content).cast("binary"), s.cast("binary")), 256)


def js_round(c: Column) -> Column:
    """Half up toward plus infinity."""
    return F.floor(c + F.lit(0.5))


def round_half_up(c: Column, digits: int) -> Column:
    return F.floor(c * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)
