"""Text functions on columns. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from rubrica import dims


def bind(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often it is used. NULL values are passed on too.

    The fold runs over nothing, so `value` goes straight to the last step: an element taken out of a transformed array
    would be copied on its way, and its type be worked out again for every row.
    """
    return F.aggregate(F.expr("cast(array() AS array<int>)"), value, lambda x, _: x, use)


def sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """A small fixed mapping, folded into one literal map."""
    pairs = ", ".join(f"{sql_literal(k)}, {sql_literal(val)}" for k, val in mapping.items())
    found = F.element_at(F.expr(f"map({pairs})"), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(dims.BLANKS))


def non_blank(text: Column) -> Column:
    """The stripped text, or NULL where nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def collapse_ws(text: Column) -> Column:
    """Lower-cased text with every run of blanks as one space."""
    return strip(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[\s\x1c-\x1f]+", " "))


def squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def snippet(*texts: Column, limit: int | None = None) -> Column:
    joined = F.concat_ws(" ", *[non_blank(t) for t in texts])
    return squeeze(joined) if limit is None else F.left(squeeze(joined), F.lit(limit))


def truncate_text(text: Column, limit: int | None) -> Column:
    body = strip(F.coalesce(text, F.lit("")))
    if limit is None:
        return body
    cut = F.concat(F.left(body, F.lit(limit - 3)), F.lit("..."))
    return F.when(F.length(body) > limit, cut).otherwise(body)


def cell_text(text: Column) -> Column:
    """Text for one cell of a pipe table."""
    body = F.replace(strip(F.coalesce(text, F.lit(""))), F.lit("|"), F.lit("\\|"))
    body = F.replace(F.replace(body, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.replace(body, F.lit("\n"), F.lit("<br>"))


def math_segments(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(dims.MATH_PATTERN), F.lit(1))


def protect_math(text: Column) -> Column:
    """Replace each formula or fenced span by a token that carries its ordinal."""
    parts = F.split(text, dims.MATH_PATTERN, -1)
    tokens = F.transform(
        parts,
        lambda part, i: F.when(
            i < F.size(parts) - 1, F.concat(part, F.lit(dims.MATH_TOKEN), i.cast("string"), F.lit("__"))
        ).otherwise(part),
    )
    marked = F.contains(text, F.lit("$")) | F.contains(text, F.lit("```"))
    return F.when(marked, F.array_join(tokens, "")).otherwise(text)


def restore_math(text: Column, segments: Column) -> Column:
    numbered = F.transform(segments, lambda s, i: F.struct(i.alias("i"), s.alias("s")))
    return F.aggregate(
        numbered,
        text,
        lambda acc, seg: F.replace(
            acc, F.concat(F.lit(dims.MATH_TOKEN), seg["i"].cast("string"), F.lit("__")), seg["s"]
        ),
    )


def count_of(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def char_class(chars: str) -> str:
    """A class of lower-case letters as few ranges, for lower-cased text only: upper-case forms may lie in between.

    Each single letter beyond U+00FF would be a test of its own for every character of a text.
    """
    allowed = lambda c: c in chars or (c != c.lower() and c.lower() in chars)
    ranges: list[list[str]] = []
    for c in sorted(set(chars)):
        between = map(chr, range(ord(ranges[-1][1]) + 1, ord(c))) if ranges else ()
        if ranges and all(map(allowed, between)):
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(first if first == last else f"{first}-{last}" for first, last in ranges) + "]"


def accentless_text(protected: Column) -> Column:
    """Long enough, at least six plain words, and no accented letter outside the allowed phrases."""
    phrases = sorted(dims.WHITELIST, key=len, reverse=True)
    # Only where a phrase may begin are all of them tried.
    allowed = f"(?=[{''.join(sorted({p[0] for p in phrases}))}])(?:{'|'.join(phrases)})"
    letter = f"[{dims.WORD_CHARS}_]"

    def plain_words(lowered: Column) -> Column:
        plain = F.regexp_count(lowered, F.lit(f"(?<!{letter})[a-z]{{3,}}+(?!{letter})"))
        return ~lowered.rlike(char_class(dims.ACCENTED)) & (plain >= 6)

    lowered = F.regexp_replace(F.lower(protected), allowed, " ")
    return (F.length(protected) >= 20) & (strip(protected) != "") & bind(lowered, plain_words)


def generic_summary(summary: Column, issue_type: Column) -> Column:
    """A summary that names a kind of problem without saying what it is."""
    low = F.lower(strip(summary))
    compact = F.replace(low, F.lit(" "), F.lit("_"))
    short = F.size(F.split(squeeze(low), " ")) <= 4
    return (low != "") & (
        (compact == F.coalesce(issue_type, F.lit("")))
        | (short & contains_any(compact, dims.TAXONOMY_TERMS))
        | contains_any(low, dims.GENERIC_PHRASES)
    )


def ambiguous_phrase(text: Column) -> Column:
    """The first hedging phrase, in list order, or NULL."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(h)), F.lit(h)) for h in dims.HEDGES])


def clamp(value: Column, default: int, zero_is_default: bool = False) -> Column:
    number = value.try_cast("int")
    if zero_is_default:
        number = F.nullif(number, F.lit(0))
    return F.least(F.greatest(F.coalesce(number, F.lit(default)), F.lit(1)), F.lit(dims.MAX_ROUNDS))


def rate(part: Column, whole: Column) -> Column:
    """Share rounded half-even to four places; 0 where there is nothing to divide by."""
    return F.when(whole > 0, F.bround(part / whole, 4)).otherwise(F.lit(0.0))
