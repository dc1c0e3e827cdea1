"""Cutting text into the pieces that byte-level tokenizers merge on their own."""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

# Letters and numbers that the tokenizer libraries, which know Unicode 16, do not count as such,
# while the newer tables of the ``regex`` module do.
NEWER_LETTERS = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    r"\U00011db0-\U00011ddb\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3"
    r"\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191"
    r"\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81"
    r"\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5"
    r"\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e"
    r"\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
NEWER_NUMBERS = r"\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"

# The same classes among the characters below U+0250, for the faster engine.
LOW_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
LOW_NUMBERS = "0-9²³¹¼-¾"
LOW_SPACES = r"\t-\r \x85\xa0"


def _pattern(letters: str, numbers: str, spaces: str, other: str, no_space: str) -> str:
    return (
        f"'(?:[stmd]|re|ve|ll)| ?{letters}+| ?{numbers}+| ?{other}+|{spaces}+(?!{no_space})|{spaces}+"
    )


def piece_finder() -> Callable[[str], list[str]]:
    """A function from a text to its pieces, equal to all matches of ``public_tokenizers.PATTERN``.

    The built-in engine serves texts without characters from U+0250 on, ``regex`` all others.
    """
    low = re.compile(
        _pattern(
            f"[{LOW_LETTERS}]",
            f"[{LOW_NUMBERS}]",
            f"[{LOW_SPACES}]",
            f"[^{LOW_SPACES}{LOW_LETTERS}{LOW_NUMBERS}]",
            f"[^{LOW_SPACES}]",
        )
    ).findall
    letters, numbers = rf"[\p{{L}}--[{NEWER_LETTERS}]]", rf"[\p{{N}}--[{NEWER_NUMBERS}]]"
    full = regex.compile(
        "(?V1)" + _pattern(letters, numbers, r"\s", rf"[^\s{letters}{numbers}]", r"\S")
    ).findall
    high = re.compile("[^\x00-ɏ]").search

    def find(text: str) -> list[str]:
        return full(text) if not text.isascii() and high(text) else low(text)

    return find
