"""Column expressions that turn raw HTML into text."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import let, strip

_NOISE = rf"(?is)<({'|'.join(fixed.NOISE_ELEMENTS)})\b[^>]*>.*?</\1\s*>"
_COMMENT = r"(?s)<!--.*?-->|<![A-Za-z][^>]*>"
_BREAK = "\x01"
_REFERENCE = r"^(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
_CLASS = rf"class\s*=\s*[\"'][^\"']*(?:{'|'.join(fixed.MAIN_CLASS_WORDS)})[^\"']*[\"']"
#: All named references of HTML 5, from the language's own table.
_NAMES = json.dumps({k[:-1]: v for k, v in html5.items() if k.endswith(";")})


def _character(number: Column) -> Column:
    """Character of a code point; what is none becomes the replacement character."""
    valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    return F.decode(F.unhex(F.lpad(F.hex(F.when(valid, number).otherwise(0xFFFD)), 8, "0")), "UTF-32")


def unescape(c: Column) -> Column:
    """Decode named and numeric character references in one pass; unknown ones stay."""
    names = F.from_json(F.lit(_NAMES), "map<string,string>")

    def decoded(p: Column) -> Column:
        name = F.regexp_extract(p, _REFERENCE, 1)
        rest = F.substring(p, F.length(name) + 2, F.length(p))
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, F.lit(3), F.lit(8)), 16, 10)).otherwise(F.substring(name, 2, 8)).cast("bigint")
        char = F.when(name.startswith("#"), _character(code)).when(name != "", F.try_element_at(names, name))
        return F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), p))

    def joined(parts: Column) -> Column:
        tail = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), decoded)
        return F.concat(F.get(parts, F.lit(0)), F.array_join(tail, ""))

    return F.when(F.contains(c, F.lit("&")), let(F.split(c, "&"), joined)).otherwise(c)


def _inner(markup: Column, name: str, opening: str = "") -> Column:
    """What the first element of that name holds, null without one; nested ones of the name are counted,
    so it ends at its own closing tag, or at the end of the page if that is missing."""
    rest = F.regexp_extract(markup, rf"(?is)<{name}\b[^>]*{opening}[^>]*>(.*)", 1)

    def until_closed(pieces: Column) -> Column:
        steps = F.transform(pieces, lambda p: F.when(p.rlike(rf"(?i)^</{name}\b"), -1).when(p.rlike(rf"(?i)^<{name}\b"), 1).otherwise(0))
        walk = F.aggregate(
            steps, F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n")),
            lambda a, s: F.when((a["depth"] > 0) & (a["depth"] + s > 0), F.struct((a["depth"] + s).alias("depth"), (a["n"] + 1).alias("n")))
            .otherwise(F.struct(F.lit(0).alias("depth"), a["n"].alias("n"))),
        )
        return F.array_join(F.slice(pieces, F.lit(1), walk["n"]), "")

    return F.when(rest != "", let(F.split(rest, rf"(?i)(?=</?{name}\b)"), until_closed))


def main_region(html: Column) -> Column:
    """Inner markup of the first article, main, content-like div or body, else the whole page."""
    regions = [(name, "") for name in fixed.MAIN_ELEMENTS] + [("div", _CLASS), ("body", "")]
    bare = F.regexp_replace(F.regexp_replace(html, _COMMENT, ""), _NOISE, "")
    return let(bare, lambda b: F.coalesce(*[_inner(b, name, opening) for name, opening in regions], b))


def html_text(html: Column) -> Column:
    """Main text: one line per text node, entities decoded, blank lines squeezed."""
    nodes = F.split(F.regexp_replace(main_region(html), r"<[^>]+>", _BREAK), _BREAK)
    lines = F.filter(F.transform(nodes, lambda n: strip(unescape(n))), lambda n: n != "")
    return squeeze(F.array_join(lines, "\n"))


def squeeze(text: Column) -> Column:
    """Trim every line and allow at most one blank line in a row."""
    lines = F.transform(F.split(text, "\n"), strip)
    kept = let(lines, lambda all_: F.filter(all_, lambda x, i: (x != "") | (F.get(all_, i - 1) != "")))
    return strip(F.array_join(kept, "\n"))


def page_title(html: Column) -> Column:
    return strip(unescape(F.coalesce(_inner(html, "title"), F.lit(""))))
