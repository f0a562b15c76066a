"""Scalar text functions, each from columns to a column and evaluated in the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that normalization deletes, white space as Python's ``\s`` has it, and a script's blocks.
ZERO_WIDTH = "[\u200b\u200c\u200d\u2060\ufeff]"
WHITE = "[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]"
DEVANAGARI = ((0x0900, 0x097F), (0xA8E0, 0xA8FF), (0x11B00, 0x11B5F))
ASCII = ((0x0000, 0x007F),)
#: Upper ends of the length buckets in words (fixed values).
BUCKETS = ((1, 5), (6, 10), (11, 20), (21, None))

_SYSTEM_NAME = re.compile(r"[A-Za-z0-9_-]+")
_RUN_ID = re.compile(r"[A-Za-z0-9._-]+")


def text_of(c: Column) -> Column:
    """The column as a string; null is empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def compose(c: Column) -> Column:
    """Unicode NFC by a static method of the library Spark brings for its collations; ASCII texts skip it."""
    return F.when(F.length(c) == F.octet_length(c), c).otherwise(F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False)))


def collapse(c: Column) -> Column:
    """White space of any kind folded to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, WHITE + "+", " "))


def normalize(c: Column) -> Column:
    """NFC, then zero-width characters deleted, then white space collapsed; null is empty.

    NFC makes the expression non-deterministic for the optimizer, so use it in a
    projection and refer to its result by name.
    """
    return collapse(F.regexp_replace(compose(text_of(c)), ZERO_WIDTH, ""))


def metric_text(c: Column) -> Column:
    """White space collapsed and nothing else: the form in which translations are compared."""
    return collapse(text_of(c))


def letters(c: Column) -> Column:
    return F.regexp_replace(c, "\\P{L}", "")


def script_ratio(c: Column, blocks: Sequence[tuple[int, int]] = DEVANAGARI) -> Column:
    """Share of a text's letters that lie in the blocks; 0 without letters. Combining signs aren't letters."""
    inside = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in blocks)
    every = F.length(letters(c))
    return F.when(every == 0, F.lit(0.0)).otherwise(F.length(letters(F.regexp_replace(c, f"[^{inside}]", ""))) / every)


def content_chars(c: Column) -> Column:
    """Number of letters and digits."""
    return F.length(F.regexp_replace(c, "[^\\p{L}\\p{N}]", ""))


def length_ratio(source: Column, target: Column) -> Column:
    """Characters of the source by those of the target, which counts as one at least."""
    return F.length(source) / F.greatest(F.length(target), F.lit(1))


def word_count(c: Column) -> Column:
    """Number of words between white space."""
    return F.regexp_count(text_of(c), F.lit(f"[^{WHITE[1:]}+"))


def length_bucket(words: Column) -> Column:
    """The bucket of a number of words; "0" for none."""
    out = F.lit("0")
    for low, high in reversed(BUCKETS):
        out = F.when(words >= low if high is None else words.between(low, high), F.lit(f"{low}+" if high is None else f"{low}-{high}")).otherwise(out)
    return out


def prompt(c: Column, language: Column | str) -> Column:
    """The instruction to translate a text; an empty text or language raises an error when evaluated."""
    text, to = F.trim(collapse_ends(c)), F.trim(language if isinstance(language, Column) else F.lit(language))
    said = F.concat(F.lit("Translate the following text into "), to, F.lit(":\n\n"), text)
    return F.when(text == "", F.raise_error(F.lit("the text to translate is empty")).cast("string")).when(to == "", F.raise_error(F.lit("the target language is empty")).cast("string")).otherwise(said)


def collapse_ends(c: Column) -> Column:
    """White space taken off both ends only."""
    return F.regexp_replace(text_of(c), f"^{WHITE}+|{WHITE}+$", "")


def messages(user: Column, assistant: Column | None = None) -> Column:
    """A conversation of one user message, and the assistant's if given: an array of (role, content)."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("user", user), *([turn("assistant", assistant)] if assistant is not None else []))


def contains_any(name: Column, fragments: Column) -> Column:
    """Whether any of an array of fragments stands in the name, whatever the case."""
    return F.exists(fragments, lambda f: F.contains(F.lower(name), F.lower(f)))


def ordered_distinct(*lists: Column) -> Column:
    """Arrays one after the other in lower case, each value where it first stands."""
    return F.array_distinct(F.transform(F.concat(*lists), F.lower))


def last_segment(path: Column, separator: str = ".") -> Column:
    return F.substring_index(path, separator, -1)


def capture(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without a match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def search(columns: Sequence[Column], query: str) -> Column:
    """Whether any column contains the query, whatever the case; an empty query matches."""
    out = F.lit(False)
    for c in columns:
        out = out | F.contains(F.lower(text_of(c)), F.lit(query.lower()))
    return out


def escape_html(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def escape_script(c: Column) -> Column:
    """Text that can't end the script element it stands in."""
    return F.replace(c, F.lit("</"), F.lit("<\\/"))


def fixed(c: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", c.cast("double"))


def percent(c: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", c.cast("double") * 100)


def signed(c: Column, digits: int = 2) -> Column:
    return F.format_string(f"%+.{digits}f", c.cast("double"))


def check_system_name(name: str) -> str:
    """The name, if it holds letters, digits, ``_`` and ``-`` only."""
    if not _SYSTEM_NAME.fullmatch(name):
        raise ValueError(f"system name {name!r} may hold letters, digits, '_' and '-' only")
    return name


def check_run_id(run_id: str) -> str:
    """The stripped run id, if it holds letters, digits, ``.``, ``_`` and ``-`` only."""
    run_id = run_id.strip()
    if not _RUN_ID.fullmatch(run_id):
        raise ValueError(f"run id {run_id!r} must hold letters, digits, '.', '_' and '-' only, one at least")
    return run_id
