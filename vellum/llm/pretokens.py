"""Splitting texts into pre-tokens with the public byte-level pattern."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cache

import public_tokenizers
import regex

#: Outside these, the general pattern is needed; inside, letters are \\w without digits, _ and the other numbers below.
_PLAIN = re.compile(r"[^\x00-\x1b\x20-\x84\x86-ſ]")
_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_²³¹¼½¾]+| ?[\d²³¹¼½¾]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


@cache
def splitter() -> Callable[[str], list[str]]:
    """Every match of the public pattern, in order. Texts of U+0000 to U+017F take an equal pattern of the faster library."""
    general = regex.compile(public_tokenizers.PATTERN).findall
    plain, fast = _PLAIN.search, _FAST.findall
    return lambda text: general(text) if plain(text) else fast(text)
