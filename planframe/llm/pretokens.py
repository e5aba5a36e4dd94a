"""Splitting text into pre-tokens by the byte-level vocabularies' pattern."""

from __future__ import annotations

import re
from functools import cache

import regex

#: Letters of the ASCII and Latin blocks up to U+024F; each has a Unicode category L*.
_LETTER = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Texts of only these characters need no Unicode tables: letters above, ASCII, tab and line ends.
_PLAIN = re.compile(rf"[\t\n\r -~{_LETTER}]*")
_PLAIN_PATTERN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+")


@cache
def splitter(pattern: str):
    """A function from a text to its pre-tokens: all matches of ``pattern``, in order.

    Plain texts go through an equivalent of the well-known pattern that the standard
    library runs faster; any other text or pattern goes through the pattern itself.
    """
    import public_tokenizers

    full = regex.compile(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return full
    plain, fast = _PLAIN.fullmatch, _PLAIN_PATTERN.findall
    return lambda text: fast(text) if plain(text) else full(text)
