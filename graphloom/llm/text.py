"""Prose, sentences and character n-grams."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import regex

_FENCED = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)")
_SPAN = re.compile(r"`[^`\n]*`")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>|<!--.*?-->", re.S)
_LINK = re.compile(r"\b(?:https?://|www\.)\S+")
_IDENTIFIER = re.compile(  # the first look ahead passes over plain words at once
    r"(?<![A-Za-z0-9_])(?=[A-Z]?[a-z]*+[A-Z0-9_./:\\@-])(?=[A-Za-z0-9_]*(?:[._/:\\@-]+[A-Za-z0-9_]|[0-9]|[a-z][A-Z]))[A-Za-z0-9_]+(?:[._/:\\@-]+[A-Za-z0-9_]+)*|\d+"
)
_CODE_LINE = re.compile(  # matched at the start of a line; lines that end with _CODE_ENDS are code, too
    r"[ \t]*(?:\$ |#!|//|/\*|\*/|@\w|(?:def|class|public|private|protected|static|final|import|return)\b|from \S+ import\b|(?:SELECT|FROM|WHERE|GROUP BY|ORDER BY|INSERT|UPDATE|DELETE)\b"
    r"|(?:if|for|while|switch) ?\(|[{}\[\]]|\"[^\"\n]*\"[ \t]*:)"
)
_CODE_ENDS = (";", "{", "}")
_LETTERS = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+|(?<=[。！？])|\n+")
_INVISIBLE = re.compile(r"[­͏ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯⠀ㅤ︀-️﻿ﾠ]")


def visible(text: str) -> str:
    """``text`` without invisible characters."""
    return text if text.isascii() else _INVISIBLE.sub("", text)


#: Patterns of what is no prose, each with marks of which one must stand in the text.
_NO_PROSE = ((_FENCED, ("```", "~~~")), (_SPAN, ("`",)), (_TAG, ("<",)), (_LINK, ("://", "www.")))


def without_code(text: str) -> str:
    """``text`` with one kind of line end, composed, and without code blocks, code spans, tags and links."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text.isascii():
        text = visible(unicodedata.normalize("NFC", text))
    for pattern, marks in _NO_PROSE:
        if any(mark in text for mark in marks):
            text = pattern.sub(" ", text)
    return "\n".join([" " if _CODE_LINE.match(line) or line.rstrip(" \t").endswith(_CODE_ENDS) else line for line in text.split("\n")])


_WRAP = regex.compile(r"(?<=[\p{L},;:'’\"-])[ \t]*\n[ \t]*(?:>[ \t]*)*(?=\p{Ll})")


def unwrapped(text: str) -> str:
    """``text`` with lines joined that go on within a sentence: after a letter or comma, with a small letter."""
    return _WRAP.sub(" ", text)


def sentences(text: str) -> list[str]:
    """Pieces of ``text`` between ends of sentences or lines."""
    return [piece for piece in _SENTENCE.split(text) if piece and not piece.isspace()]


def each_sentence(text: str) -> Iterator[str]:
    """``sentences``, each found when it is asked for."""
    start = 0
    for match in _SENTENCE.finditer(text):
        if (piece := text[start : match.start()]) and not piece.isspace():
            yield piece
        start = match.end()
    if (piece := text[start:]) and not piece.isspace():
        yield piece


_WHOLE = re.compile(r"[.!?…:。！？][\"'»”’)\]*_ ]*$")
_WORD = re.compile(r"[^\W\d_]+")
_KANA = re.compile(r"[぀-鿿]")


def is_sentence(piece: str, least_words: int = 6) -> bool:
    """Whether a piece ends as a sentence does or is as long as one; a phrase in brackets or quotes is none."""
    piece = piece.strip()
    if _WHOLE.search(piece) and piece[0] not in "([\"'«“":
        return True
    return len(_WORD.findall(piece)) >= least_words or len(_KANA.findall(piece)) >= 10


def without_names(text: str) -> str:
    """``text`` without identifiers and numbers."""
    return _IDENTIFIER.sub(" ", text)


def letters(text: str) -> str:
    """The words of ``text``, lower case, one space apart."""
    return " ".join(_LETTERS.findall(text)).lower()


def _token_prose(token: str) -> str:
    if token.isalpha() and token[1:].islower():  # a plain word, as most are
        return token.lower()
    return letters(without_names(token))


_known_prose = lru_cache(1 << 16)(_token_prose)


def prose(text: str) -> str:
    """The words of natural language, lower case, one space apart; identifiers and numbers are left out.

    Neither a word nor an identifier goes beyond a blank, so what stands between blanks is judged by itself, and once.
    """
    return " ".join(filter(None, [_known_prose(t) if len(t) <= 40 else _token_prose(t) for t in text.split()]))


def prose_words(texts: Iterable[str]) -> Counter[str]:
    """How often each word of ``prose`` is in ``texts``."""
    tokens: Counter[str] = Counter()
    for text in texts:
        tokens.update(text.split())
    found: dict[str, int] = {}
    for token, n in tokens.items():
        for word in _token_prose(token).split():
            found[word] = found.get(word, 0) + n
    return Counter(found)


def chunks(texts: Sequence[str], chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with about ``chars`` characters each; a longer text has a range of its own."""
    start = held = 0
    for k, text in enumerate(texts):
        if held and held + len(text) > chars:
            yield start, k
            start, held = k, 0
        held += len(text) + 3
    if start < len(texts):
        yield start, len(texts)


def ngrams(texts: Sequence[str], sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """All character n-grams of ``texts``: id and the text's number. Words are padded by a space; none spans two words.

    An id is n and 32 bits of a hash, ``n << 32 | hash``, so ids of one text can be sorted beside its number in 64 bits.
    """
    joined = "\0".join(f" {text} " for text in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    cut, space = codes == 0, codes == 32
    owner = np.cumsum(cut)
    value, bad = codes.copy(), cut.copy()
    found, owners = [], []
    for n in range(1, max(sizes, default=0) + 1):
        last = len(codes) - n + 1
        if last <= 0:
            break
        if n > 1:
            value = value[:last] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
            bad = bad[:last] | cut[n - 1 :]
        if n > 2:
            bad |= space[n - 2 : n - 2 + last]  # a blank within
        if n in sizes:
            keep = ~bad & ~space if n == 1 else ~bad & ~(space[:last] & space[1 : last + 1]) if n == 2 else ~bad
            mixed = value[keep]
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            found.append((mixed >> np.uint64(32)) | np.uint64(n << 32))
            owners.append(owner[:last][keep])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(owners)
