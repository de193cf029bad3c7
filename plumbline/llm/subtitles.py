"""Reading subtitle texts: cues, wrong encodings, markup, adverts, and words whose spelling
doesn't depend on case, accents or character-recognition errors."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

LOST = "�"
#: A line with the times of a cue, whole or begun, with the cue's number above it.
TIMES = re.compile(r"^[ \t﻿]*(?:\d+[ \t]*\n[ \t]*)?[^\n]*-->[^\n]*$", re.M)
NUMBER_LINE = re.compile(r"^[ \t﻿]*\d+[ \t]*$", re.M)
MARKUP = re.compile(r"<[^<>\n]{0,200}>|\{[^{}\n]{0,200}\}")
SOUND = re.compile(r"\[[^\[\]]{0,200}\]|\([^()]{0,200}\)|♪[^♪\n]{0,200}♪?|#[^#\n]{1,200}#")
SPEAKER = re.compile(r"^[ \t]*(?:[-–—][ \t]*)?[A-ZÀ-Þ][A-ZÀ-Þ .'’-]{0,30}:(?=[ \t])", re.M)
#: A host name: lower case after a dot without space, where a new sentence would have a capital.
HOST = re.compile(r"[\w-]\.[a-z]{2,}(?![\w.])")
# Words of credits and adverts in subtitle files, in lower case. The hints are
# looked for first; only lines with a hint are matched.
ADVERT_HINTS = (
    "www.", "://", "@", "btitle", "btitul", "btítul", "ynced", "ynchroni", "corrected", "translated", "caption", "vip member", "advertise",
    "sous-titre", "untertitel", "==",
)
ADVERT = re.compile(
    r"www\.|https?:|\w@\w|\bsubtitle[sd]? by\b|\bcaptions? by\b|\bsynced by\b|\bsynchroni[sz]ed by\b|\bcorrected by\b|\btranslated by\b"
    r"|\bvip member\b|\badvertise your\b|\bsous-titres? par\b|\buntertitel von\b|\bsubt[ií]tulos (?:por|de)\b|^\s*==.*==\s*$"
)
_FOREIGN = re.compile(r"[^\x00-\x7f]{2,}")
_CODEPAGES = ("cp1252", "cp437", "cp850", "latin-1")


def _bytes(run: str, page: str) -> bytes | None:
    out = bytearray()
    for c in run:
        try:
            out += c.encode(page)
        except UnicodeEncodeError:
            if ord(c) > 255:
                return None
            out.append(ord(c))  # a byte that the code page leaves open
    return bytes(out)


@lru_cache(maxsize=100_000)
def _decoded(run: str) -> str:
    for page in _CODEPAGES:
        raw = _bytes(run, page)
        if raw:
            try:
                return raw.decode("utf-8")
            except UnicodeDecodeError:
                pass
    return run


def repaired(text: str) -> str:
    """UTF-8 that was read as a single-byte code page, once or twice, put right. Only runs
    that are valid UTF-8 in such a page change, so right text stays as it is."""
    for _ in range(2):
        new = _FOREIGN.sub(lambda m: _decoded(m.group()), text)
        if new == text:
            break
        text = new
    return text


def lines_unified(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def without_adverts(text: str) -> str:
    low = text.lower()
    if len(low) != len(text):  # some capitals grow; then the places differ
        return "\n".join("" if HOST.search(x) or ADVERT.search(x.lower()) else x for x in text.split("\n"))
    spans: set[tuple[int, int]] = set()
    for m in HOST.finditer(text):
        end = text.find("\n", m.start())
        spans.add((text.rfind("\n", 0, m.start()) + 1, len(text) if end < 0 else end))
    for hint in ADVERT_HINTS:
        at = low.find(hint)
        while at >= 0:
            end = low.find("\n", at)
            end = len(low) if end < 0 else end
            span = (low.rfind("\n", 0, at) + 1, end)
            if span not in spans and ADVERT.search(low[span[0] : end]):
                spans.add(span)
            at = low.find(hint, end)
    for a, b in sorted(spans, reverse=True):
        text = text[:a] + text[b:]
    return text


def spoken(text: str) -> str:
    """The speech of a subtitle file, without numbers, times, markup, sounds and adverts."""
    t = lines_unified(text)
    if not t.isascii():
        t = repaired(t)
    t = TIMES.sub("", t)
    t = MARKUP.sub("", t)
    t = without_adverts(t)
    t = SOUND.sub(" ", t)
    t = SPEAKER.sub(" ", t)
    return NUMBER_LINE.sub("", t)


_SPELL = {"œ": "oe", "æ": "ae", "ø": "o", "đ": "d", "ł": "l", LOST: "*"}
#: Combining accents, and blocks of signs without letters.
_MARKS = re.compile("[\u0300-\u036f]+")
_SIGNS = re.compile("[\x80-\xbf\u2000-\u2bff\u3000-\u303f\ufe00-\ufe0f\ufeff]+")
# Glyphs that character recognition takes for each other, as one of them.
GLYPHS = {"1": "l", "i": "l", "|": "l", "0": "o", "c": "e", "f": "t", "q": "g", "5": "s", "8": "b"}
_GLYPH = str.maketrans(GLYPHS)
_GLYPH_BYTES = bytes.maketrans("".join(GLYPHS).encode(), "".join(GLYPHS.values()).encode())


def plain(text: str) -> str:
    """Lower case without accents; a lost character is ``*``; other scripts stay."""
    if text.isascii():
        return text.lower()
    t = text.casefold()
    for letter, plain_letters in _SPELL.items():
        if letter in t:
            t = t.replace(letter, plain_letters)
    return _SIGNS.sub(" ", _MARKS.sub("", unicodedata.normalize("NFKD", t)))


def folded(text: str) -> str:
    """``plain`` text in which glyphs that are taken for each other are one."""
    t = plain(text)
    t = t.encode("ascii").translate(_GLYPH_BYTES).decode("ascii") if t.isascii() else t.translate(_GLYPH)
    return t.replace("ll", "h").replace("rn", "m")


_TOKENS_ASCII = re.compile(r"[0-9a-z*]+")
_TOKENS = re.compile(r"(?:[^\W_]|\*)+")


def folded_words(text: str) -> list[str]:
    """Words of a text, folded."""
    t = folded(text)
    return (_TOKENS_ASCII if t.isascii() else _TOKENS).findall(t)
