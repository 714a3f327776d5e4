"""Word-level encoding with a public BPE vocabulary: each distinct word is encoded once per worker by the library's model.

A piece of a safe text is what the library's normalizer and splitter would leave of it, so it goes to the BPE model at once.
"""

from __future__ import annotations

import re
import struct

import numpy as np

from .common import CACHES

#: End-of-contraction alternatives and character classes of the vocabulary's splitting pattern (fixed values),
#: restricted to the characters in SAFE.
LETTER = "a-zªµºß-öø-ž"
NUMBER = "0-9²³¹¼-¾"
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+")
#: Anything else than these characters sends a text to the library as a whole: normal forms, case rules and
#: classes may differ there. So does "<|", which may begin a special string.
UNSAFE = re.compile("[^\t\n\x0b\x0c\r -~ -įĲ-ňŊ-ž–—‘-”…€]|<\\|")

#: The same for the bytes of Latin-1 texts, by tables: kinds of characters, and small letters (all white space as a blank).
SPACE, WORD, SIGN, DIGIT, ODD = range(5)
MARK = "\x01"  # in place of the apostrophe of an end of contraction, which goes with the letters behind it


def _kind(c: str) -> int:
    if c == MARK:
        return WORD
    if UNSAFE.match(c):
        return ODD
    return SPACE if c.isspace() else WORD if re.match(f"[{LETTER}]", c.lower()) else DIGIT if re.match(f"[{NUMBER}]", c) else SIGN


KINDS = bytes(_kind(chr(i)) for i in range(256))
SMALL = bytes(0x20 if chr(i).isspace() else ord(chr(i).lower()) for i in range(256))
#: A contraction's end begins a piece: no sign stands before it.
SHORT = re.compile(b"(?<![" + b"".join(re.escape(bytes([i])) for i in range(256) if KINDS[i] == SIGN) + b"])'(s|t|re|ve|m|ll|d)")


def pieces(text: str) -> list[str] | None:
    """Small-letter pieces of a safe text in order, with MARK for the apostrophe of contractions or as it is; None for a text that goes to the library as a whole."""
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return None if UNSAFE.search(text) else PIECE.findall(text.lower())
    kinds = data.translate(KINDS)
    if ODD in kinds or b"<|" in data or MARK.encode() in data:
        return None
    data = data.translate(SMALL)
    if b"'" in data:
        data = SHORT.sub(f" {MARK}\\1 ".encode(), data)
        kinds = data.translate(KINDS)
    kind = np.frombuffer(kinds, np.uint8)
    left, right = kind[:-1], kind[1:]
    cut = np.flatnonzero(((left != right) | (right == DIGIT)) & (left != SPACE) & (right != SPACE)) + 1
    old = np.ones(len(kind) + len(cut), bool)  # else a blank between two pieces
    old[cut + np.arange(len(cut))] = False
    out = np.full(len(old), 0x20, np.uint8)
    out[old] = np.frombuffer(data, np.uint8)
    return out.tobytes().decode("latin-1").split()


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of whole texts as the tokenizers library gives them for word_bpe_49k.json; ids fit 16 bits."""

    _own: dict[str, WordEncoder] = CACHES.setdefault("words", {})

    def __init__(self, name: str, most_words: int = 1_000_000) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(vocabulary(name))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.most = most_words
        tokenize = self.tokenizer.model.tokenize
        stand_in = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

        class Bytes(dict):
            """What stands for a character's bytes in the vocabulary; printable ASCII stands for itself."""

            def __missing__(self, code: int) -> str:
                got = self[code] = stand_in(chr(code))[0][0]
                return got

        table = Bytes()

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                plain = word.replace(MARK, "'")
                ids = [t.id for t in tokenize(plain if plain.isascii() else plain.translate(table))]
                got = struct.pack(f"<{len(ids)}H", *ids)
                if len(word) <= 64:
                    self[word] = got
                return got

        self.words = Words()

    @classmethod
    def of(cls, name: str) -> WordEncoder:
        if name not in cls._own:
            cls._own[name] = cls(name)
        return cls._own[name]

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u2")
        found = pieces(text)
        if found is None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2")
        if len(self.words) > self.most:
            self.words.clear()
        return np.frombuffer(b"".join(map(self.words.__getitem__, found)), "<u2")
