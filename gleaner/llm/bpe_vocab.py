"""A byte-level BPE vocabulary read from a public tokenizer file, and its splitting of text into pre-tokens."""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata

import numpy as np

# Letters and numbers that Unicode 16 added, which the tokenizers library knows and Python 3.13 doesn't yet.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
APOSTROPHE = 0x27
#: Letters that make a contraction of their own after an apostrophe: one letter, or two.
SHORT, LONG = "stmd", ("re", "ve", "ll")


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point."""
    kinds = {"L": LETTER, "N": NUMBER, "Z": SPACE}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[[*range(9, 14), 0x85]] = SPACE
    for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for a, b in ranges:
            out[a : b + 1] = kind
    return out


def pre_tokens(text: str) -> list[str]:
    """Splits as byte-level BPE does: contractions, then runs of letters, numbers or others with one space before them, then white space."""
    if not text:
        return []
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    kind = classes()[code]
    change = np.empty(len(code), bool)  # a run of one class begins here
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    start = change.copy()
    # The last character of white space before a word: a space goes to the word, anything else stands alone.
    edge = np.flatnonzero(change[1:] & (kind[:-1] == SPACE))
    start[edge] = True
    start[edge[code[edge] == 0x20] + 1] = False
    quotes = np.flatnonzero((code == APOSTROPHE) & start)
    for q in quotes.tolist():
        after = text[q + 1 : q + 3]
        if after[:1] and after[0] in SHORT:
            size = 2
        elif after in LONG:
            size = 3
        else:
            continue
        start[q + 1 : q + size] = False
        if q + size < len(code) and kind[q + size] == LETTER:
            start[q + size] = True
    cuts = np.flatnonzero(start).tolist()
    cuts.append(len(text))
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizer file.

    id_of_byte: the token of each byte; bytes_of: each token's bytes; left, right, made: of each merge, by rank.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # The file writes a byte as itself where that prints, else as a character from 256 on, in the order of the bytes.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*ids.values(), *self.special.values()])
        self.bytes_of = [b""] * self.size
        for token, i in ids.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.id_of_byte = np.zeros(256, np.int64)
        for token, i in ids.items():
            if len(token) == 1:
                self.id_of_byte[byte_of[token]] = i
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def pieces(self, text: str) -> tuple[list[str], list[tuple[int, int]]]:
        """Pre-tokens of the text between special strings, and (pre-tokens before it, token) of each special string."""
        if self.cut is None or not any(s in text for s in self.special):
            return pre_tokens(text), []
        words: list[str] = []
        marks: list[tuple[int, int]] = []
        at = 0
        for m in self.cut.finditer(text):
            words += pre_tokens(text[at : m.start()])
            marks.append((len(words), self.special[m[0]]))
            at = m.end()
        return words + pre_tokens(text[at:]), marks


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One for each Python worker."""
    return Vocabulary(path)
