"""Splitting text into the pieces that a byte-level BPE encodes one by one."""

from __future__ import annotations

import re
from collections.abc import Callable

#: Fixed value: the splitting pattern of the byte-level vocabularies, and what it comes to on pure ASCII text, where the
#: standard library's engine takes half the time. No two alternatives can start alike, so letters may come first.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ASCII = r" ?[A-Za-z]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^ \t\n\r\x0b\x0cA-Za-z0-9]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+"


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of the pattern, in order."""
    import regex

    whole = regex.compile(pattern).findall
    if pattern != BYTE_LEVEL:
        return whole
    plain = re.compile(ASCII).findall
    return lambda text: plain(text) if text.isascii() else whole(text)
