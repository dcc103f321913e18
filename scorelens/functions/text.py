"""Text expressions: whitespace tokens with padding, path parts, unit suffixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The pad token and the whitespace set used to split words.
PAD_TOKEN = "[PAD]"
WHITESPACE = "[ \\t\\n\\r\\f\\x0B]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text) -> Column:
    """Lower-cased whitespace tokens of the whole text, empty tokens dropped."""
    return F.filter(F.split(F.lower(_c(text)), WHITESPACE), lambda t: t != F.lit(""))


def tokens_pad_truncate(text, max_length: int, pad: str = PAD_TOKEN) -> Column:
    """Tokens truncated at ``max_length`` and right-padded to exactly that length."""
    w = words(text)
    return F.concat(
        F.slice(w, 1, max_length),
        F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(max_length) - F.size(w))),
    )


def tokens_mask(text, max_length: int) -> Column:
    """Attention mask matching :func:`tokens_pad_truncate`: 1 per real token, 0 per pad."""
    n = F.least(F.size(words(text)), F.lit(max_length))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(max_length) - n))


def path_part(path, index: int, sep: str = "/") -> Column:
    """1-based part of a separated path (negative counts from the end); empty if absent."""
    return F.coalesce(F.try_element_at(F.split(_c(path), sep, -1), F.lit(index)), F.lit(""))


def inner_path(path, sep: str = "/") -> Column:
    """The path without its first and last part (``a/b/c/d`` -> ``b/c``)."""
    parts = F.split(_c(path), sep, -1)
    return F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), sep)


def with_unit(value, unit: str) -> Column:
    """Text with a unit suffix, e.g. ``28.589M``."""
    return F.concat(_c(value).cast("string"), F.lit(unit))


def tokens_pad_to(text, length, max_length: int, pad: str = PAD_TOKEN) -> Column:
    """Tokens truncated at ``max_length`` and padded to ``length`` (a column, e.g.
    the longest text of the row's batch)."""
    w = F.slice(words(text), 1, max_length)
    return F.concat(w, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), _c(length) - F.size(w))))
