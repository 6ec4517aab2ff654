"""Text columns: stripping, words, windows, templates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip(), str.split() and \s treat as space.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = (
    r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``.

    A lambda body re-evaluates outer expressions for every element, so a split text
    used inside one has to be bound to a lambda variable first.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column | str) -> Column:
    """Both ends freed of all Unicode whitespace; NULL becomes blank."""
    return F.btrim(F.coalesce(col(c), F.lit("")), F.lit(SPACES))


def words(c: Column | str) -> Column:
    """Whitespace-separated words; no words for blank or NULL text."""
    return F.array_remove(F.split(F.coalesce(col(c), F.lit("")), f"[{SPACE_CLASS}]+"), "")


def blank_as(c: Column | str, token: str = "<blank>") -> Column:
    """Stripped value, or ``token`` where nothing is left."""
    stripped = strip(c)
    return F.when(stripped == "", F.lit(token)).otherwise(stripped)


def slug(c: Column | str, default: str = "task") -> Column:
    """Lower-case name of letters and digits joined by single underscores."""
    joined = F.lower(F.btrim(F.regexp_replace(col(c), "[^A-Za-z0-9]+", "_"), F.lit("_")))
    return F.when(joined == "", F.lit(default)).otherwise(joined)


def fill_template(template: str, slot: str, c: Column | str) -> Column:
    """``template`` with each ``{slot}`` replaced by the column, taken literally."""
    parts: list[Column] = []
    for i, piece in enumerate(template.split("{" + slot + "}")):
        if i:
            parts.append(F.coalesce(col(c), F.lit("")))
        parts.append(F.lit(piece))
    return F.concat(*parts)


def truncate_words(c: Column | str, n: int, side: str = "head") -> Column:
    """First (``head``) or last (``tail``) ``n`` words; shorter texts stay unchanged."""
    if side not in ("head", "tail"):
        raise ValueError(f"side must be 'head' or 'tail', not {side!r}")

    def cut(w: Column) -> Column:
        kept = F.slice(w, 1, n) if side == "head" else F.slice(w, -n, n)
        return F.when(F.size(w) <= n, col(c)).otherwise(F.array_join(kept, " "))

    return let(words(c), cut)


def word_chunks(
    c: Column | str, max_length: int, max_chunks: int, side: str = "head", reserve: int = 2
) -> Column:
    """Array of word windows of ``max_length - reserve``; at most ``max_chunks`` of them.

    A text without words gives one empty window.
    """
    if side not in ("head", "tail"):
        raise ValueError(f"side must be 'head' or 'tail', not {side!r}")
    window = max_length - reserve
    if window < 1:
        raise ValueError("max_length must exceed reserve")

    def chunks(w: Column) -> Column:
        last = F.floor((F.greatest(F.size(w), F.lit(1)) - 1) / F.lit(window)).cast("int")
        first_kept = F.lit(0) if side == "head" else F.greatest(last - (max_chunks - 1), F.lit(0))
        last_kept = F.least(last, F.lit(max_chunks - 1)) if side == "head" else last
        return F.transform(
            F.sequence(first_kept, last_kept),
            lambda i: F.slice(w, i * window + 1, window),
        )

    return let(words(c), chunks)


def preview(c: Column | str, n: int = 900) -> Column:
    """The first ``n`` characters, for reading side by side."""
    return F.substring(col(c), 1, n)


def json_text(value: Column) -> Column:
    """A string as JSON writes it, quotes included."""
    return F.regexp_extract(F.to_json(F.struct(value.cast("string").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
