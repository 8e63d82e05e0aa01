"""Text helpers shared by every rule."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_META = set("\\.^$|?*+()[]{}")


def quoted(word: str) -> str:
    """``word`` as a literal inside a pattern."""
    return "".join("\\" + ch if ch in _META else ch for ch in word)


def any_of(words: Iterable[str]) -> str:
    return "(?:" + "|".join(quoted(w) for w in words) + ")"


def contains_any(column: Column, words: Iterable[str], lowered: bool = False) -> Column:
    """Case-insensitive substring test against a fixed list; NULL text counts as no match.

    Plain substring searches are many times faster than one alternation pattern. A word that contains another word of
    the list adds nothing and is left out. ``lowered`` says the text is in lower case already.
    """
    low = column if lowered else F.lower(column)
    listed = list(dict.fromkeys(w.lower() for w in words))
    needed = [w for w in listed if not any(o != w and o in w for o in listed)]
    out = F.contains(low, F.lit(needed[0]))
    for word in needed[1:]:
        out = out | F.contains(low, F.lit(word))
    return F.coalesce(out, F.lit(False))


def starts_as_any(column: Column, words: Iterable[str]) -> Column:
    """The text equals one of the words, or starts with one followed by a blank."""
    return F.coalesce(F.lower(column).rlike("^" + any_of(w.lower() for w in words) + "(?: |$)"), F.lit(False))


def first_index(column: Column, words: list[str]) -> Column:
    """Position in ``words`` of the first entry contained in the text, else ``len(words)``."""
    low = F.lower(F.coalesce(column, F.lit("")))
    out = None
    for i, word in enumerate(words):
        test = F.contains(low, F.lit(word))
        out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
    return out.otherwise(F.lit(len(words)))


def group_of(text: Column, pattern: str, group: int = 1, flags: str = "i") -> Column:
    """One group of the first match, NULL when nothing matches (or the group is empty)."""
    prefix = f"(?{flags})" if flags else ""
    return F.nullif(F.regexp_extract(text, prefix + pattern, group), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body reads it."""
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


#: A pattern's parts: an escape, a class, the start of a group, a repeat, a sign of its own.
_PARTS = re.compile(r"(?P<escape>\\.)|(?P<set>\[\^?\]?(?:\\.|[^\]\\])*\])|(?P<open>\((?:\?(?:<?[=!]|[a-zA-Z]*:|P?<\w+>))?)|(?P<repeat>[*+?]|\{\d*,?\d*\})|(?P<sign>.)", re.S)


def needle(pattern: str) -> str | None:
    """Longest run of plain characters every match of a pattern must contain, in lower case; None if too short.

    Looking for it first spares most texts the pattern itself.
    """
    parts = [(m.lastgroup, m.group()) for m in _PARTS.finditer(pattern)]
    best = max(_runs(parts, 0)[0], key=len)
    return best if len(best) >= 3 else None


def _runs(parts: list[tuple[str, str]], at: int) -> tuple[list[str], int]:
    """Runs of characters that one group (or the whole pattern) must have, and the place behind it. Neighbouring runs are
    parted wherever anything else may stand between them."""
    runs, choice = [""], False
    while at < len(parts):
        kind, text = parts[at]
        at += 1
        if (kind, text) == ("sign", ")"):
            break
        inner = [""]
        if (kind, text) == ("sign", "|"):
            choice = True
        elif kind == "open":
            inner, at = _runs(parts, at)
            if "=" in text or "!" in text:  # looks around and takes nothing
                inner = ["", ""]
        elif kind == "set":
            only = set(text[1:-1].lower())
            inner = [only.pop()] if len(only) == 1 and text[1] != "^" else ["", ""]
        elif kind == "escape":
            inner = ["", ""] if text[1].isalnum() else [text[1].lower()]
        else:
            inner = ["", ""] if text in ".^$" else [text.lower()]
        repeats = at < len(parts) and parts[at][0] == "repeat"
        if repeats:
            some = parts[at][1] == "+" or parts[at][1][:1] == "{" and not parts[at][1].startswith(("{0", "{,"))
            inner = ["", *inner, ""] if some else ["", ""]
            at += 1
            if at < len(parts) and parts[at] in (("repeat", "?"), ("repeat", "+")):  # as few, or never given back
                at += 1
        runs = [*runs[:-1], runs[-1] + inner[0], *inner[1:]]
    return (["", ""] if choice else runs), at


#: Words of a choice that every match must contain one of, where the choice stands outside all other groups.
_WORDS = re.compile(r"\(\?:((?:[A-Za-z]{3,}\|)+[A-Za-z]{3,})\)(?![*?{])")


def word_choice(pattern: str) -> list[str] | None:
    """Words, in lower case, of which every match of a pattern must contain one; None if the pattern names no such choice."""
    for choice in _WORDS.finditer(pattern):
        depth, bare = 0, True
        for m in _PARTS.finditer(pattern):
            if m.start() == choice.start():
                bare = bare and depth == 0
            depth += m.lastgroup == "open"
            depth -= m.group() == ")" and m.lastgroup == "sign"
            bare = bare and not (depth == 0 and m.group() == "|" and m.lastgroup == "sign")
        if bare:
            return choice.group(1).lower().split("|")
    return None


def when_possible(low: Column, pattern: str, value: Column) -> Column:
    """``value`` for the texts that contain the pattern's needle, or a word of its choice; ``low`` is the text in lower case."""
    found = needle(pattern)
    if found is not None:
        return F.when(F.contains(low, F.lit(found)), value)
    words = word_choice(pattern)
    return value if words is None else F.when(contains_any(low, words, lowered=True), value)


def first_of(text: Column, patterns: list[str], convert: Callable[[Column], Column], flags: str = "i") -> Column:
    """Try the patterns in order; a pattern whose match does not convert gives way to the next one."""
    return let(F.lower(text), lambda low: F.coalesce(
        *[when_possible(low, p, let(group_of(text, p, 1, flags), convert)) for p in patterns]))


def folded(text: Column) -> Column:
    """Blanks of any kind folded to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def norm_text(text: Column) -> Column:
    """Case- and blank-folded form used when two values are compared."""
    return folded(F.lower(text))


def plain_blanks(text: Column) -> Column:
    """No-break spaces as ordinary ones, so that ``\\s`` sees them."""
    return F.translate(text, "\u00a0", " ")


def norm_event_type(text: Column) -> Column:
    """Event type without numeric suffix and punctuation, blank- and case-folded; NULL gives ''."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"_\d+$", ""), r"[/\-()]", "")
    return F.lower(folded(bare))


def respondent_surname(style: Column) -> Column:
    """Upper-case last word of the party name in a case style."""
    bare = F.trim(style)
    for prefix in (r"(?i)^FORECLOSURE\s+OF\s+A\s+DEED\s+OF\s+TRUST\s+", r"(?i)^FORECLOSURE\s*-?\s*",
                   r"(?i)^\(HOA\)\s*-?\s*"):
        bare = F.regexp_replace(bare, prefix, "")
    return F.nullif(F.upper(F.element_at(F.split(F.trim(bare), r"\s+"), -1)), F.lit(""))


def document_date(name: Column) -> Column:
    """Date part of ``MM-DD-YYYY_Type.pdf``."""
    return F.try_to_date(group_of(name, r"^(\d{2}-\d{2}-\d{4})_.+\.pdf$"), "MM-dd-yyyy")


def document_kind(name: Column) -> Column:
    """Type part of ``MM-DD-YYYY_Type.pdf``; NULL when the date part is no date."""
    kind = F.trim(group_of(name, r"^\d{2}-\d{2}-\d{4}_(.+)\.pdf$"))
    return F.when(document_date(name).isNotNull(), kind)


def document_name(day: Column, event_type: Column, width: int = 40) -> Column:
    """File name for a document of an event: ``MM-DD-YYYY_Type.pdf``, ``unknown`` without a date."""
    bare = F.substring(F.regexp_replace(F.coalesce(event_type, F.lit("Unknown")), r"[^\w\s-]", ""), 1, width)
    return F.concat(F.coalesce(F.date_format(day, "MM-dd-yyyy"), F.lit("unknown")), F.lit("_"), bare, F.lit(".pdf"))


def case_numbers_in(text: Column) -> Column:
    """Distinct case numbers named in a text, zero-padded, with the county suffix when given."""
    found = F.regexp_extract_all(text, F.lit("(?i)" + r"\b\d{2}\s*SP\s*0*\d{3,6}(?:-\d{3})?\b"), F.lit(0))

    def pad(hit: Column) -> Column:
        bare = F.upper(F.regexp_replace(hit, r"\s+", ""))
        number = F.regexp_extract(bare, r"^\d{2}SP0*(\d{3,6})", 1)
        county = F.regexp_extract(bare, r"(-\d{3})$", 1)
        return F.concat(F.substring(bare, 1, 2), F.lit("SP"), F.lpad(number, 6, "0"), county)

    return F.array_distinct(F.transform(F.coalesce(found, F.array().cast("array<string>")), pad))


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def url_plus(text: Column) -> Column:
    """Form encoding: blank as ``+``, ``~`` left alone, ``*`` encoded."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def url_component(text: Column) -> Column:
    """URI-component encoding: blank as ``%20`` and ``! ' ( ) * ~`` left alone."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out
