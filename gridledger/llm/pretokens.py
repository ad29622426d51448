"""Cutting text before the merges of byte-pair encodings: the patterns of the tokenizer files, by fast classes."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import regex

# Fixed value: white space as the Unicode property has it.
SPACE = r"\t-\r \x85\xa0  -     　"


@cache
def category(first: str) -> str:
    """The characters of the basic plane whose general category starts with ``first``, as ranges of a class."""
    codes = [c for c in range(0x10000) if unicodedata.category(chr(c))[0] == first]
    ranges, start = [], None
    for here, following in zip(codes, [*codes[1:], None]):
        start = here if start is None else start
        if following != here + 1:
            ranges.append(f"\\u{start:04x}-\\u{here:04x}")
            start = None
    return "".join(ranges)


def finder(parts: str):
    r"""Function that lists the matches of a pattern that is given with classes {L}, {N} and {S}.

    Texts within the basic plane use explicit ranges, which are much faster;
    others use the Unicode properties.
    """
    fast = re.compile(parts.format(L=category("L"), N=category("N"), S=SPACE)).findall
    general = regex.compile(parts.format(L=r"\p{L}", N=r"\p{N}", S=SPACE)).findall

    def find(text: str) -> list[str]:
        return fast(text) if text.isascii() or max(text) <= "\uffff" else general(text)

    return find
