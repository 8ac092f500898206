"""Texts as words, without what layout and encoding add to them (plain Python, for use in workers)."""

from __future__ import annotations

import html
import re
import unicodedata

import regex

#: Fixed value: tags that stand inside a word or sentence; other tags separate words.
INLINE_TAGS = ("a", "b", "big", "code", "em", "font", "i", "mark", "s", "small", "span", "strong", "sub", "sup", "tt", "u")

_inline = re.compile(rf"</?(?:{'|'.join(INLINE_TAGS)})(?:\s[^<>]*)?/?>", re.IGNORECASE)
_tag = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->", re.DOTALL)
_unseen = regex.compile(r"[\p{Cf}\p{Mn}\p{Me}]+")
words_of = re.compile(r"[^\W_]+").findall


def without_markup(text: str) -> str:
    """The text with entities resolved and tags removed."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _tag.sub(" ", _inline.sub("", text))
    return text


def plain_words(text: str | None) -> list[str]:
    """Words in lower case; markup, invisible characters, accents and forms of encoding are dropped."""
    if not text:
        return []
    text = without_markup(text)
    if not text.isascii():
        text = _unseen.sub("", unicodedata.normalize("NFKD", text))
    return words_of(text.casefold())
