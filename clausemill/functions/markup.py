"""Character references and markup as text."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A reference as HTML reads it: decimal, hexadecimal or named, the stop optional. Fixed value.
_REFERENCE = r"^&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Names that may stand without a stop.
_OPEN = {k: v for k, v in html5.items() if not k.endswith(";")}
#: What numbers 128 to 159 stand for: characters of code page 1252, themselves where it has none.
_WINDOWS = {b: bytes([b]).decode("cp1252", "replace").replace("�", chr(b)) for b in range(128, 160)}


def _map(given: dict) -> Column:
    return F.map_from_arrays(F.lit([*given]), F.lit([*given.values()]))


def character(number: Column) -> Column:
    """The character of a numeric reference: U+FFFD for 0, surrogates and numbers beyond Unicode, code page 1252 for 128 to
    159, nothing for other control characters and for code points that are no characters."""
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    nothing = (number.between(1, 8) | (number == 11) | number.between(14, 31) | (number == 127) | number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE))
    odd = (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    return F.when(odd, "�").when(number.between(128, 159), F.element_at(_map(_WINDOWS), number.cast("int"))).when(nothing, "").otherwise(plain)


def unescape(text: Column) -> Column:
    """Text with its character references decoded: numbers of any length, all names of HTML 5, and names without a stop,
    the longest that a reference begins with. What is no reference stays."""
    names, bare = _map(html5), _map(_OPEN)
    longest = max(map(len, _OPEN))

    def part(x: Column) -> Column:
        found = F.regexp_extract(x, _REFERENCE, 1)
        rest = F.substring(x, F.length(found) + 2, F.length(x))
        hexadecimal = F.regexp_extract(found, "^#[xX]0*([0-9a-fA-F]*)", 1)
        decimal = F.regexp_extract(found, "^#0*([0-9]*)", 1)
        over = F.lit(0x110000).cast("long")
        number = F.when(found.rlike("^#[xX]"), F.when(F.length(hexadecimal) > 6, over).otherwise(F.conv(F.concat(F.lit("0"), hexadecimal), 16, 10).cast("long"))).otherwise(F.when(F.length(decimal) > 7, over).otherwise(F.concat(F.lit("0"), decimal).cast("long")))
        begins = F.coalesce(*[F.when(F.length(found) > n, F.concat(F.try_element_at(bare, F.substring(found, 1, n)), F.substring(found, F.lit(n + 1), F.length(found)))) for n in range(longest, 1, -1)])
        named = F.coalesce(F.try_element_at(names, found), begins, F.concat(F.lit("&"), found))
        return F.when(found == "", x).otherwise(F.concat(F.when(found.startswith("#"), character(number)).otherwise(named), rest))

    return F.when(text.contains("&"), F.array_join(F.transform(F.split(text, "(?=&)", -1), part), "")).otherwise(text)


def superscripts(text: Column) -> Column:
    """<sup>n</sup> as raised digits: texts are cut before each such tag, and digits are raised in what it opens."""
    tag = r"(?i)^<sup>(\d+)</sup>"
    raised = lambda x: F.concat(F.translate(F.regexp_extract(x, tag, 1), "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹"), F.regexp_replace(x, tag, ""))
    return F.array_join(F.transform(F.split(text, r"(?i)(?=<sup>\d+</sup>)", -1), raised), "")


def folded(text: Column) -> Column:
    """White space of any kind as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def markup_text(html: Column) -> Column:
    """The text of an article's markup: raised digits, tags as spaces, references decoded, white space folded."""
    return folded(unescape(F.regexp_replace(superscripts(html), "<[^>]+>", " ")))


def article_identifier(title: Column) -> Column:
    """The article that a title names, up to its stop; the whole title where it names none."""
    clean = folded(unescape(F.regexp_replace(superscripts(title), "<[^>]+>", "")))
    found = F.regexp_extract(clean, r"(?iU)(Art\.\s*.+?)(?:\.|$)", 1)
    return F.when(found == "", clean).otherwise(F.trim(found))
