"""Words of a page, alike however the page was typed, marked up or decoded."""

from __future__ import annotations

import html
import re
import unicodedata

_INLINE = re.compile(r"</?(?:a|abbr|b|big|code|del|em|font|i|ins|mark|s|small|span|strike|strong|sub|sup|tt|u|wbr)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<[/!?a-zA-Z][^<>]*>")
_BROKEN = re.compile(r"[-­‐‑]\s*\n\s*")
_SPACES = re.compile("[\u0085   -     　]")
#: Fullwidth forms and Latin ligatures to plain letters.
_WIDE = {0xFF01 + i: 0x21 + i for i in range(94)} | {0xFB00: "ff", 0xFB01: "fi", 0xFB02: "fl", 0xFB03: "ffi", 0xFB04: "ffl"}
_HAS_WIDE = re.compile("[！-～ﬀ-ﬄ]")
#: Letters of scripts other than Latin, and those among them that are written without spaces between words.
_LETTER = (
    "\u0370-\u03ff\u0400-\u052f\u0531-\u0587\u05d0-\u05ea\u0620-\u065f\u066e-\u06d3\u0900-\u0dff\u0e01-\u0e5b\u0e81-\u0fff"
    "\u1000-\u13ff\u1780-\u17d3\u1c90-\u1cbf\u1f00-\u1fff\u3041-\u30ff\u3131-\u318e\u3400-\u9fff\uac00-\ud7a3\uf900-\ufaff"
)
_UNSPACED = "\u0e01-\u0e5b\u0e81-\u0edf\u1000-\u109f\u1780-\u17d3\u3041-\u30ff\u3400-\u9fff\uf900-\ufaff"
_OTHER = re.compile(f"(?<![0-9A-Za-z{_LETTER}])[{_LETTER}]{{2,}}(?![0-9A-Za-z])")
_HAS_OTHER = re.compile(f"[{_LETTER}]{{2}}")
_PIECES = re.compile(f"[{_UNSPACED}]|[^{_UNSPACED}]+")
#: Code pages that UTF-8 is wrongly read with.
_WRONG = ("cp1252", "cp1251")
#: Apostrophes and hyphens vanish inside words, letters and digits stay, all else parts words.
_DROP = b"'`-"
_TABLE = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))
#: Letters without a decomposition, written plainly.
_PLAIN = {"ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"}
_UMLAUT = {"ä": "ae", "ö": "oe", "ü": "ue", "å": "aa", "ø": "oe"}


def _byte_of(page: str) -> dict[str, int]:
    """Character -> byte of a code page; bytes it leaves open are read as control characters."""
    out = {}
    for i in range(0x80, 0x100):
        try:
            out[bytes([i]).decode(page)] = i
        except UnicodeDecodeError:
            out[chr(i)] = i
    return out


def _sequences(page: str) -> tuple[re.Pattern, dict[int, int]]:
    """Letters outside ASCII in UTF-8, as they look in a code page, and its characters as bytes."""
    byte = _byte_of(page)
    some = lambda lo, hi: "[" + "".join(re.escape(c) for c, i in byte.items() if lo <= i < hi) + "]"
    tail = some(0x80, 0xC0)
    return re.compile(f"{some(0xC2, 0xE0)}{tail}|{some(0xE0, 0xF0)}{tail}{{2}}|{some(0xF0, 0xF5)}{tail}{{3}}"), {ord(c): i for c, i in byte.items()}


_READ_WRONG = [_sequences(page) for page in _WRONG]
_NOT_ASCII = re.compile("[^\x00-\x7f]+")


def repaired(text: str) -> str:
    """UTF-8 that was read with another code page, read rightly: where that explains at least half of what is not ASCII."""
    n = sum(map(len, _NOT_ASCII.findall(text)))
    for pattern, byte in _READ_WRONG:
        hits = pattern.findall(text)
        if hits and 2 * sum(map(len, hits)) >= n:
            right = lambda m: bytes(byte[ord(c)] for c in m[0]).decode("utf-8", "replace")
            return pattern.sub(right, text)
    return text


def _coded(m: re.Match) -> str:
    """Words of another script in ASCII, so that they go the way of all words: a mark and their code points."""
    return "".join(f" 0{''.join(f'{ord(c):x}' for c in w)}0 " for w in _PIECES.findall(m[0]))


def words(text: str | None) -> list[bytes]:
    """The words of a whole text in lower case, as ASCII letters and digits.

    Latin letters beyond ASCII are left out of their word, so a word reads the
    same whether its accents were decoded rightly or wrongly.  Words of other
    scripts are told by their code points, letter by letter where a script sets
    no spaces; a single such letter, or one beside an ASCII letter, is taken for
    a wrongly decoded character and left out.  Markup, entities, zero-width
    characters and hyphens at line ends leave no trace.  None and empty texts
    have no words.
    """
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
        if "&" in text:
            text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "\n" in text:
        text = _BROKEN.sub("", text)
    if not text.isascii():
        text = _SPACES.sub(" ", unicodedata.normalize("NFC", text))
        if _HAS_WIDE.search(text):
            text = text.translate(_WIDE)
        low = text.lower()
        if _HAS_OTHER.search(low) or "\u00d0" in text or "\u00d1" in text:
            low = repaired(text).lower()
            if _HAS_OTHER.search(low):
                low = _OTHER.sub(_coded, low)
        text = low
    return text.lower().encode("ascii", "ignore").translate(_TABLE, _DROP).split()


def spellings(text: str) -> list[list[bytes]]:
    """For each white-space separated token with letters beyond ASCII: its form in words(), then its plain spellings."""
    out = []
    for token in unicodedata.normalize("NFC", text).split():
        if token.isascii():
            continue
        base = words(token)
        if len(base) != 1:
            continue
        low = token.lower()
        forms = {
            "".join(c for c in unicodedata.normalize("NFKD", "".join(_PLAIN.get(x, x) for x in low)) if not unicodedata.combining(c)),
            "".join(_UMLAUT.get(x, _PLAIN.get(x, x)) for x in low)
        }
        more = [w[0] for f in sorted(forms) if len(w := words(f)) == 1 and w[0] != base[0]]
        if more:
            out.append([base[0], *more])
    return out
