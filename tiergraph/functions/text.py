"""Sentence splitting, token sets, similarity, markup and reply clean-up."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from tiergraph.functions import fixed_values as fixed

# Blank characters beyond ASCII that count as white space in the source texts.
SPACE = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

BLANKS = (
    " \t\n\r\f\v\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Start or end of anything that ends an open paragraph.
BLOCK_TAGS = (
    "address", "article", "aside", "blockquote", "body", "details", "div", "dl", "fieldset",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html",
    "main", "menu", "nav", "ol", "pre", "section", "table", "td", "th", "ul",
)
PARAGRAPH_OPEN = r"(?i)<p(?:\s[^>]*)?>"
PARAGRAPH_CLOSE = r"(?i)</p\s*>|</?(?:" + "|".join(BLOCK_TAGS) + r")(?:\s[^>]*)?/?>"
NOT_CONTENT = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
ENTITY_PIECES = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);|[^&]+|&"


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, which counts characters beyond the base plane twice."""
    wide = (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")
    return F.when(F.octet_length(text) == F.length(text), F.length(text)).otherwise(wide)


def split_sentences(text: Column) -> Column:
    """Pieces after ``.`` or ``;`` and white space, untrimmed and of any length."""
    return F.split(text, rf"(?<=[.;]){SPACE}+")


def trimmed(piece: Column) -> Column:
    """A piece without white space around it."""
    return F.btrim(piece, F.lit(BLANKS))


def sentence_sized(units: Column) -> Column:
    """Whether a length is that of a sentence: 25 to 240 units."""
    return units.between(fixed.SENTENCE_MIN, fixed.SENTENCE_MAX)


def sentences(text: Column) -> Column:
    """Trimmed sentences of a text that have a fitting length."""
    pieces = F.transform(split_sentences(text), trimmed)
    return F.filter(pieces, lambda s: sentence_sized(utf16_length(s)))


def token_set(text: Column) -> Column:
    """Distinct lower-case tokens longer than two characters of ``[a-z0-9%.]``."""
    cleaned = F.regexp_replace(F.lower(text), r"[^a-z0-9%. ]", " ")
    return F.array_distinct(F.filter(F.split(cleaned, r"\s+"), lambda w: F.length(w) > 2))


def jaccard(left: Column, right: Column) -> Column:
    """Shared over all tokens of two sets; 0 when both are empty."""
    shared = F.size(F.array_intersect(left, right))
    total = F.size(left) + F.size(right) - shared
    return F.when(total == 0, F.lit(0.0)).otherwise(shared / F.nullif(total, F.lit(0)))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Plain substring test for any of ``words`` (no word borders).

    One quoted alternation keeps long word lists to a single small expression.
    """
    if len(words) == 1:
        return F.contains(text, F.lit(words[0]))
    return text.rlike("|".join(rf"\Q{word}\E" for word in words))


def ascii_borders(pattern: str) -> str:
    """A pattern whose ``\\b`` looks at ASCII word characters only.

    A border at the end of an alternative closes a word, any other opens one.
    """
    closing = re.sub(r"\\b(?=$|[|)])", r"(?!\\w)", pattern)
    return closing.replace(r"\b", r"(?<!\w)")


def _decoded_entity(piece: Column) -> Column:
    body = F.substring(piece, 2, F.length(piece) - 2)
    code = F.when(
        F.lower(F.substring(body, 2, 1)) == "x",
        F.conv(F.substring(body, 3, F.length(body)), 16, 10),
    ).otherwise(F.substring(body, 2, F.length(body)))
    number = F.when(F.length(code) <= 8, code.try_cast("bigint"))
    usable = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    character = F.decode(F.unhex(F.lpad(F.hex(F.when(usable, number)), 8, "0")), "UTF-32")
    names = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
    table = F.from_json(F.lit(json.dumps(names)), "map<string,string>")
    named = (
        F.when(body == "amp", F.lit("&"))
        .when(body == "lt", F.lit("<"))
        .when(body == "gt", F.lit(">"))
        .when(body == "quot", F.lit('"'))
        .when(body == "nbsp", F.lit("\u00a0"))
        .otherwise(F.try_element_at(table, body))
    )
    decoded = F.when(F.startswith(body, F.lit("#")), F.coalesce(character, F.lit("\ufffd")))
    return F.coalesce(decoded.otherwise(named), piece)


def unescape_entities(text: Column) -> Column:
    """Replace character references once, left to right, by what they stand for."""
    pieces = F.regexp_extract_all(text, F.lit(ENTITY_PIECES), F.lit(0))
    is_entity = lambda p: (F.length(p) > 2) & F.startswith(p, F.lit("&"))
    decoded = F.transform(pieces, lambda p: F.when(is_entity(p), _decoded_entity(p)).otherwise(p))
    return F.when(F.contains(text, F.lit("&")), F.array_join(decoded, "")).otherwise(text)


def paragraphs(html: Column) -> Column:
    """Texts of all paragraphs of a page, in order.

    A paragraph ends at its end tag, at the next paragraph or at a block tag, so
    an unclosed one does not swallow what follows.
    """
    content = F.regexp_replace(html, NOT_CONTENT, "")
    pieces = F.split(content, PARAGRAPH_OPEN)
    opened = F.slice(pieces, 2, F.size(pieces))
    inner = F.transform(opened, lambda p: F.split(p, PARAGRAPH_CLOSE, 2)[0])
    return F.transform(inner, lambda p: unescape_entities(F.regexp_replace(p, r"<[^>]*>", "")))


def reply_object(raw: Column) -> Column:
    """The outermost ``{...}`` of a model reply, without fence and ``json`` tag."""
    trimmed = F.regexp_replace(raw, r"^\s+|\s+$", "")
    fenced = F.split(trimmed, "```")[1]
    untagged = F.when(F.startswith(fenced, F.lit("json")), F.substring(fenced, 5, 2147483647))
    body = F.when(
        F.startswith(trimmed, F.lit("```")), F.coalesce(untagged, fenced)
    ).otherwise(trimmed)
    start = F.instr(body, "{")
    tail = F.instr(F.reverse(body), "}")
    stop = F.length(body) - tail + 1
    return F.when((start > 0) & (tail > 0), F.substring(body, start, stop - start + 1)).otherwise(
        body
    )
