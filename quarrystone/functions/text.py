"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_tokens(text: Column) -> Column:
    """Lower-cased Unicode words."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def plain_tokens(text: Column) -> Column:
    """Lower-cased pieces between whitespace that hold a letter or digit; punctuation stays on them."""
    return F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda t: t.rlike(r"[\p{L}\p{N}]"))


def once(value: Column, use) -> Column:
    """use(value) with value computed once for a row: a lambda's body would compute it again for each element."""
    return F.transform(F.array(value), use)[0]


def _runs(tokens: Column, n: int, sep: str) -> Column:
    runs = F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), sep))
    return F.when(F.size(tokens) >= n, runs).otherwise(F.array().cast("array<string>"))


def ngrams(tokens: Column, n: int, sep: str = " ") -> Column:
    """All runs of n tokens, joined; none if there are fewer."""
    return once(tokens, lambda t: _runs(t, n, sep))


def shingle_set(tokens: Column, n: int = 5) -> Column:
    """Distinct n-grams; of a shorter text, its distinct words."""
    return F.array_distinct(once(tokens, lambda t: F.when(F.size(t) >= n, _runs(t, n, " ")).otherwise(t)))


def normalized(text: Column) -> Column:
    """Whitespace collapsed, lower-cased, stripped."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def keyed_hash(seed: str, ident: Column) -> Column:
    """The hex digest that orders rows for sampling."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), ident.cast("string")), 256)


def derived_seed(value: Column) -> Column:
    """The first eight bytes of the SHA-256 as a big-endian integer, halved."""
    return F.floor(F.conv(F.substring(F.sha2(value, 256), 1, 16), 16, 10).cast("decimal(20,0)") / 2).cast("long")


def set_digest(ids: Column) -> Column:
    """Order-independent digest of a collected list of ids, duplicates kept."""
    return F.sha2(F.concat(F.array_join(F.sort_array(ids), "\n"), F.lit("\n")), 256)
