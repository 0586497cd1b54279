"""Pre-token patterns of the two public BPE vocabularies, exact for texts below U+0250 with the fast standard engine and
for all others with the regex module."""

from __future__ import annotations

import re
import unicodedata

import regex

_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _low(kind: str) -> str:
    """A character class body with all characters below U+0250 whose general category starts with kind."""
    found, out = [i for i in range(0x250) if unicodedata.category(chr(i))[0] == kind], []
    for i in found:
        if out and out[-1][1] == i - 1:
            out[-1][1] = i
        else:
            out.append([i, i])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out)


_L, _N = _low("L"), _low("N")
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_byte_form = _SHORT + "| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
_word_form = _SHORT + "|[{L}]+|[{N}]|[^{S}{L}{N}]+"

beyond_low = re.compile("[^\\x00-\\u024f]").search
_byte_low = re.compile(_byte_form.format(L=_L, N=_N, S=_SPACE)).findall
_byte_any = regex.compile(_byte_form.format(L=r"\p{L}", N=r"\p{N}", S=_SPACE)).findall
_word_low = re.compile(_word_form.format(L=_L, N=_N, S=_SPACE)).findall
_spaces = re.compile(f"[{_SPACE}]+")


def byte_level(text: str) -> list[str]:
    """Pre-tokens of the byte-level vocabulary; they concatenate to the text."""
    return (_byte_any if beyond_low(text) else _byte_low)(text)


def word_level(text: str) -> list[str] | None:
    """Lower-case pre-tokens of the word-end vocabulary, or None where only the library's Unicode tables decide."""
    return None if beyond_low(text) or "<|" in text else _word_low(text.lower())
