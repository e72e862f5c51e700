"""Text, path and URL functions as column expressions; no user functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space (what str.isspace accepts): single characters, and as a class body. Characters
#: below 256 are listed one by one, since regular expressions look those up in a bit set.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = "\\t\\n\\x0b\\x0c\\r\\x1c\\x1d\\x1e\\x1f\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A text without white space but blank and LF; runs of ASCII are taken at once.
NO_RARE_SPACE = "\\A(?:[ -~\\n]++|[\\x7f-\\x84\\x86-\\x9f\\xa1-\\u167f\\u1681-\\u1fff\\u200b-\\u2027\\u202a-\\u202e\\u2030-\\u205e\\u2060-\\u2fff\\u3001-\\x{10ffff}])*+\\z"
#: Line ends of str.splitlines, and the single characters among them besides LF.
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
#: A word: runs of printable ASCII are taken at once, other characters one by one.
WORD = f"(?:[!-~]++|[^{SPACE}])++"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(SPACES))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def or_default(text: Column, default: str | Column) -> Column:
    """The stripped text, or a default where that is null or empty."""
    bare = strip(text)
    return F.coalesce(F.when(bare != "", bare), default if isinstance(default, Column) else F.lit(default))


def has_any(text: Column, parts: Iterable[str]) -> Column:
    """Whether one of the parts occurs. A search for bytes each is far quicker than a character class."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def _replaced_if(text: Column, parts: tuple[str, ...], pattern: str, by: str) -> Column:
    """A replacement that runs only where one of the parts occurs, which is quick to see."""
    return let(text, lambda t: F.when(has_any(t, parts), F.regexp_replace(t, pattern, by)).otherwise(t))


def normalize_text(text: Column) -> Column:
    """Line ends to LF, no blanks before them, at most one empty line in a row, stripped."""
    lf = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    bare = _replaced_if(lf, (" \n", "\t\n"), "[ \\t]+\\n", "\n")
    return strip(_replaced_if(bare, ("\n\n\n",), "\\n{3,}", "\n\n"))


def word_count(text: Column) -> Column:
    """Runs of characters that are not white space.

    In a text whose words have one blank or LF between them, as most have, counting those gives the
    same number without a match per word."""

    def of(t: Column) -> Column:
        bare = F.replace(F.replace(t, F.lit(" ")), F.lit("\n"))
        simple = ~has_any(t, ("  ", " \n", "\n ", "\n\n")) & t.rlike(NO_RARE_SPACE)
        return F.when(t == "", 0).when(simple, F.length(t) - F.length(bare) + 1).otherwise(F.regexp_count(t, F.lit(WORD)))

    return let(strip(text), of)


def collapse(text: Column) -> Column:
    """White space runs to one space, stripped."""
    return strip(F.regexp_replace(text, f"[{SPACE}]+", " "))


def slug(text: Column, default: str = "chunk") -> Column:
    """Runs of anything but letters, digits, dot, underscore and hyphen become one hyphen."""
    bare = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9._-]+", "-"), "^[-_.]+|[-_.]+\\z", "")
    return F.coalesce(F.when(bare != "", bare), F.lit(default))


def safe_file_name(text: Column, default: str = "Untitled") -> Column:
    """Characters that file systems refuse become underscores."""
    return or_default(F.regexp_replace(text, '[\\\\/:*?"<>|]', "_"), default)


def without_images(markdown: Column) -> Column:
    """Inline images to their stripped alternative text."""
    return _replaced_if(markdown, ("![",), f"!\\[[{SPACE}]*([^\\]]*?)[{SPACE}]*\\]\\([^)]+\\)", "$1")


def sentences(text: Column) -> Column:
    """Split after a full stop, exclamation or question mark and white space."""
    return F.split(text, f"(?<=[.!?])[{SPACE}]+")


def lines(text: Column) -> Column:
    """The lines of a text, as str.splitlines gives them."""

    def of(t: Column) -> Column:
        plain = F.split(F.when(t.endswith("\n"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t), "\n")
        rare = F.split(F.regexp_replace(t, f"(?:{LINE_END})\\z", ""), LINE_END)
        return F.when(t == "", F.array().cast("array<string>")).when(has_any(t, LINE_ENDS), rare).otherwise(plain)

    return let(text, of)


def wikilink(label: Column, path: Column) -> Column:
    """``[[stem]]``, or ``[[stem|label]]`` where they differ."""
    name = stem(path)
    return F.when(label == name, F.concat(F.lit("[["), name, F.lit("]]"))).otherwise(F.concat(F.lit("[["), name, F.lit("|"), label, F.lit("]]")))


def wikilinks(markdown: Column) -> Column:
    """Links to local Markdown pages become wiki links.

    Targets with a scheme stay; so do images and targets that don't end in ``.md`` before ``#``.
    A label equal to the link's name is left out."""
    space = f"[{SPACE}]*"
    link = f"(?<!!)\\[{space}([^\\]]*?){space}\\]\\({space}(?!https?://|mailto:)(?:[^)#]*/)?([^)#/]+?)\\.[mM][dD](?:(#[^)]+?)|#)?{space}\\)"
    linked = F.regexp_replace(markdown, link, "[[$2$3|$1]]")
    return F.regexp_replace(F.regexp_replace(linked, "\\[\\[([^\\]|]+)\\|\\1\\]\\]", "[[$1]]"), "\\[\\[([^\\]|]+)\\|\\]\\]", "[[$1]]")


def section_code(system: Column, group: Column, section: Column) -> Column:
    """``system group - section`` if all three are there."""
    parts = [F.coalesce(strip(c), F.lit("")) for c in (system, group, section)]
    whole = (parts[0] != "") & (parts[1] != "") & (parts[2] != "")
    return F.when(whole, F.concat(parts[0], parts[1], F.lit("-"), parts[2])).otherwise("Uncategorized")


# Letters whose upper case takes several characters, but that have a single capital too.
_ONE_SMALL = "ß" + "".join(map(chr, [*range(0x1F80, 0x1F88), *range(0x1F90, 0x1F98), *range(0x1FA0, 0x1FA8), 0x1FB3, 0x1FC3, 0x1FF3]))
_ONE_CAPITAL = "ẞ" + "".join(map(chr, [*range(0x1F88, 0x1F90), *range(0x1F98, 0x1FA0), *range(0x1FA8, 0x1FB0), 0x1FBC, 0x1FCC, 0x1FFC]))


def index_letter(title: Column) -> Column:
    """The first character in upper case, ``#`` unless it is a letter or digit. It is one character:
    a letter without a single capital stays as it is."""
    first = F.substring(strip(title), 1, 1)
    upper = F.upper(first)
    letter = F.when(F.length(upper) == 1, upper).otherwise(F.translate(first, _ONE_SMALL, _ONE_CAPITAL))
    return F.when(letter.rlike("^[\\p{L}\\p{N}]"), letter).otherwise("#")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)/*$", 1)


def extension(path: Column) -> Column:
    """The last suffix in lower case with its dot; none for names that only begin with a dot."""
    return F.lower(F.regexp_extract(basename(path), "^\\.*[^.].*?(\\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    """The name without its last suffix."""
    name = basename(path)
    bare = F.regexp_extract(name, "^(.+)\\.[^.]+$", 1)
    return F.when(bare != "", bare).otherwise(name)


def query_value(query: Column, *keys: str) -> Column:
    """The first non-empty value of the first key that has one, decoded."""

    def of(key: str) -> Column:
        found = F.regexp_extract(F.concat(F.lit("&"), query), f"&{key}=([^&]+)", 1)
        return F.when(found != "", F.try_url_decode(found))

    return F.coalesce(*[of(k) for k in keys], F.lit(""))


def url_parts(href: Column) -> dict[str, Column]:
    """scheme, netloc, path, query and fragment of a reference that may be relative."""
    pattern = "^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#(.*))?$"
    return {name: F.regexp_extract(href, pattern, i) for i, name in enumerate(("scheme", "netloc", "path", "query", "fragment"), 1)}


def server_path(path: Column) -> Column:
    """A request path decoded as paths are: a plus sign stays a plus sign."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def zero_pad(text: Column, width: int) -> Column:
    """Padded with zeros on the left to ``width``, never cut."""
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def quoted(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit('\\"'))


def strip_prolog(svg: Column) -> Column:
    """An SVG text without its XML declaration."""
    return F.regexp_replace(svg, f"^<\\?xml(?s:.*?)\\?>[{SPACE}]*", "")
