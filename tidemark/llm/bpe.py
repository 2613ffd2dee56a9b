"""Byte-pair ids of whole texts, equal to those of the tokenizers library.

`Encoder` cuts a text into the pieces of the pre-tokenizer's pattern, merges a
piece it has not met, and remembers the ids; where no piece crosses a space, the ids of whole words between
spaces are remembered beside those of their pieces. That holds for texts of Latin letters, digits and common signs, on which pattern tables of
all libraries agree; any other text, or one that holds the string of a special
token, goes to the library whole.

`Encoder.join` puts the ids of two neighbouring halves of one text together: it
encodes a growing window around the join until both sides agree.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from functools import cache

import numpy as np

MEMO_PIECES = 900_000  # pieces (or pieces and words) remembered per Python worker; then it starts anew
MEMO_CHARS = 48  # longer pieces are not remembered
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017f"
_SPACES = "\t-\r "
_SIGNS = "!-/:-@\\[-`{-~\u00a1-\u00a9\u00ab\u00ac\u00ae-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u2010-\u2027\u20ac"
_OTHER_CHARS = re.compile(f"[^{_LETTERS}{_SPACES}{_SIGNS}0-9]")
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
# The two pre-tokenizers' patterns, said for the characters above.
_SPACED = re.compile(
    f"{_SHORT}| ?[{_LETTERS}]+| ?[0-9]+| ?[^{_SPACES}{_LETTERS}0-9]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)
_UNSPACED = re.compile(f"{_SHORT}|[{_LETTERS}]+|[0-9]|[^{_SPACES}{_LETTERS}0-9]+")


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _kind(char: str) -> str:
    """The class by which the pre-tokenizer collects characters; '' is none for sure."""
    if char.isspace():
        return "s"
    group = unicodedata.category(char)
    return "" if group == "Cn" else group[0] if group[0] in "LN" else "o"


class Memo(dict):
    """Ids by string; what has not been met is worked out. Long strings stay until `trim`."""

    def __init__(self, ids_of):
        super().__init__()
        self._ids_of, self._long, self._before = ids_of, [], {}

    def __missing__(self, key: str) -> bytes:
        found = self._before.get(key)
        if found is None:
            found = self._ids_of(key)
        self[key] = found
        if len(key) > MEMO_CHARS:
            self._long.append(key)
        return found

    def trim(self) -> None:
        """Between texts: long strings go."""
        for key in self._long:
            self.pop(key, None)
        self._long.clear()

    def age(self) -> None:
        """Start anew; what was met since the last time is still known until the next."""
        self._before = dict(self)
        self.clear()


class Encoder:
    """Ids of texts as little-endian bytes (`dtype`), by one vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        # The byte-level pre-tokenizer keeps spaces; the other one drops them and lowers the case.
        self.spaced = spec["pre_tokenizer"]["type"] == "ByteLevel"
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        self._chars = {b: c for c, b in _byte_of_char().items()}
        self._model = self.tok.model
        # A piece that stands alone between spaces is the one piece of that word, so both may lie in one memo.
        self._memo = self._words = Memo(self._merge_ranked() if self.spaced else self._word)

    def library(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _merge_ranked(self):
        """Merging by ranks: where ids rise in the order of the merges, as here, a token's id is its rank."""
        import tiktoken

        ranks = {p: i for i, p in enumerate(self.pieces) if i < len(self.pieces) - len(self.specials)}
        core = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        return lambda piece: array(self._code, core.encode_ordinary(piece)).tobytes()

    def _merge_model(self, piece: str) -> bytes:
        chars = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self._chars)
        return array(self._code, [t.id for t in self._model.tokenize(chars)]).tobytes()

    def encode(self, text: str) -> bytes:
        if not text or _OTHER_CHARS.search(text) or any(s in text for s in self.specials):
            return self.library(text)
        if self.spaced:
            out = b"".join(map(self._memo.__getitem__, _SPACED.findall(text)))
        else:  # no piece crosses a space
            out = b"".join(map(self._words.__getitem__, text.lower().split()))
        self._memo.trim()
        if self.spaced and len(self._memo) > MEMO_PIECES:
            self._memo.clear()
        elif not self.spaced and len(self._memo) > MEMO_PIECES // 2:
            self._memo.age()
        return out

    def _word(self, word: str) -> bytes:
        """The ids of what stands between spaces: of its pieces, one after the other."""
        if word.isalpha():
            return self._merge_model(word)
        pieces = _UNSPACED.findall(word)
        return self._merge_model(word) if len(pieces) == 1 else b"".join(map(self._memo.__getitem__, pieces))

    def forget(self) -> None:
        """Leave no pieces behind: the worker may go on to tasks that need its memory."""
        self._memo.clear()
        self._memo.age()

    def ids(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, dtype=self.dtype)

    def decode(self, ids: np.ndarray) -> str:
        return self.tok.decode(ids.tolist(), skip_special_tokens=False)

    # Putting halves together (byte-level vocabularies)

    @property
    def pieces(self) -> list[bytes]:
        """The bytes of every token id."""
        if not hasattr(self, "_pieces"):
            of = _byte_of_char()
            table = [b""] * self.tok.get_vocab_size()
            for token, i in self.tok.get_vocab().items():
                table[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
            self._pieces = table
        return self._pieces

    def _text(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))

    def _edge(self, ids: np.ndarray, at: int) -> str:
        """What is at the border before ids[at]: 'cut' (a piece surely begins there),
        'run' (one run of like characters goes on), or '' (not to be used)."""
        before, after = self._text(ids[max(0, at - 8) : at]), self._text(ids[at : at + 8])
        if not after or not before or after[0] & 0xC0 == 0x80:
            return ""
        x = before.decode("utf-8", "ignore")[-1:]
        y = after.decode("utf-8", "ignore")
        if not x or not y:
            return ""
        if y[0] == " " and len(y) > 1 and not y[1].isspace() and y[1] != "\u180e":
            return "cut"
        return "run" if _kind(x) and _kind(x) == _kind(y[0]) and y[0] != "'" else ""

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of one text from those of its two halves."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        width = 8
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            while a > 0 and not (left_edge := self._edge(left, a)):
                a -= 1
            while b < len(right) and not (right_edge := self._edge(right, b)):
                b += 1
            window = self._text(left[a:]) + self._text(right[:b])
            mid = self.ids(self.library(window.decode("utf-8")))
            agreed = a == 0 or left_edge == "cut" or mid[0] == left[a]
            if agreed and (b == len(right) or right_edge == "cut" or mid[-1] == right[b - 1]):
                return np.concatenate([left[:a], mid, right[b:]])
            width *= 2

    def join_all(self, parts: list[np.ndarray]) -> np.ndarray:
        """Neighbours joined two by two until one is left."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else np.empty(0, self.dtype)


@cache
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    return Encoder(path)
