"""Texts as sequences of comparable words."""

from __future__ import annotations

import html
import re
import unicodedata

#: UTF-8 read as Latin-1: a lead byte and its continuations.
_MOJIBAKE = re.compile("[ÃÂÄÅ][\u0080-¿]|â[\u0080-¿]{2}")
_TAGS = re.compile(r"</?[A-Za-z][^<>]{0,200}>|&(?:[A-Za-z]{2,8}|#\d{2,6});")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t>]*(?=[^\W\d_])")
_LINE_MARKS = re.compile(r"^[ \t]*(?:[>#*+•·|–—-]+[ \t]*)*(?:\d{1,3}[.)][ \t]+)?", re.M)
_WORD = re.compile(r"[^\W_]+")


def _repair(m: re.Match) -> str:
    try:
        return m.group().encode("latin-1").decode("utf-8")
    except UnicodeError:
        return m.group()


def plain(text: str) -> str:
    """text in lower case, broken encoding mended, without tags, invisible signs and line markup; accents stay."""
    if not text.isascii():
        if "Ã" in text or "Â" in text or "â\u0080" in text:
            text = _MOJIBAKE.sub(_repair, text)
        text = _INVISIBLE.sub("", text)
    if "<" in text or "&" in text:
        text = _TAGS.sub(lambda m: html.unescape(m.group()) if m.group()[0] == "&" else " ", text)
    if "\n" in text:
        if "-" in text:
            text = _BROKEN.sub("", text)
        text = _LINE_MARKS.sub("", text)
    return text.lower()


def folded(word: str) -> str:
    """A word without accents and compatibility forms."""
    if word.isascii():
        return word
    word = unicodedata.normalize("NFKD", word.casefold())
    return "".join(c for c in word if not unicodedata.combining(c))


def words(text: str) -> list[str]:
    """The comparable words of a text."""
    return [w for x in _WORD.findall(plain(text)) for w in ([x] if x.isascii() else _WORD.findall(folded(x)))]


_JOINT = "[­​-‏⁠﻿]|-[ \\t]*\\r?\\n[ \\t>]*"
_SIGN = "(?:[^\\W_]|(?<=[ÃÂÄÅ])[\\u0080-¿])"
_PLACED = re.compile(f"{_SIGN}+(?:(?:{_JOINT})+{_SIGN}+)*")
_JOINTS = re.compile(_JOINT)


def placed_words(text: str) -> list[tuple[str, int, int]]:
    """(comparable word, first character, last character + 1) of the words of a text as it stands; the words are those of words()."""
    blank = lambda m: " " * len(m.group())
    hidden = _LINE_MARKS.sub(blank, _TAGS.sub(blank, text)) if "\n" in text or "<" in text or "&" in text else text
    out = []
    for m in _PLACED.finditer(hidden):
        w = _MOJIBAKE.sub(_repair, _JOINTS.sub("", m.group()))
        out += [(x, *m.span()) for x in _WORD.findall(folded(w.lower()))]
    return out
