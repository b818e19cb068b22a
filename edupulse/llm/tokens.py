"""Token ids of whole texts, with a memory of pieces already encoded.

The public tokenizers never let a token span a space, so a text's ids are those of its
space-separated pieces in order. A worker keeps the ids of pieces it has met (``MEMORY`` of them at
most) and hands only new ones to the library.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterable

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
END_ID = 0

# Pieces in each of a worker's two generations of memory (about 45 MB each when full), and text encoded at a time.
MEMORY = 250_000
STEP = 3 << 20
_GROUP = 200

# A space or line end beside white space other than line ends: there one byte-level token may hold both.
_WIDE_SPACE = re.compile(r"[ \n][^\S\n]|[^\S\n][ \n]")
# White space other than the space and the line end, most of it rare.
_RARE_SPACES = [c for c in map(chr, [*range(0x3001)]) if c.isspace() and c not in " \n"]
# The normalizer that _fold stands for; white space in a piece is dropped by the pre-tokenizer anyway.
_FOLDING = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
# Letters that Python's tables do not know yet; the library's may fold them.
_UNKNOWN = frozenset(c for c in map(chr, range(0xA0, 0x20000)) if unicodedata.category(c) == "Cn")
_PLAIN = "\x01"  # begins the key of a piece that no space precedes


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; a name with a slash is a path already."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _fold(text: str) -> str:
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    # Letter by letter where the lower case would depend on the place in the word.
    return "".join([c.lower() for c in text]) if "\u03a3" in text else text.lower()


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids (as bytes), without special tokens.

    New pieces are encoded many at a time, in one text whose ids are taken apart again at its joints.
    """

    def __init__(self, name: str, memory: int = MEMORY):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        form = json.loads(self.tokenizer.to_str())
        # Folding once per text, before the memory, lets pieces meet that differ in case only.
        self.folds = form["normalizer"] == _FOLDING
        self.whole = self.tokenizer
        self.whole.encode_special_tokens = True
        if self.folds:
            self.tokenizer = Tokenizer.from_str(json.dumps(form | {"normalizer": None}))
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.keeps_space = "\u0120the" in vocabulary  # byte-level: a space is part of the token after it
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.opens[i] = token.startswith("\u0120")
        self.line_end = self._one("\n") if self.keeps_space else b""
        self.memory = memory
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _pieces(self, text: str) -> list[str] | None:
        """Keys of the text's pieces; None if it has to be encoded whole."""
        if not self.keeps_space:
            return text.replace("\n", " ").split(" ")
        if "  " in text or " \n" in text or "\n " in text or "\n\n\n" in text or _PLAIN in text or text.endswith((" ", "\n\n")):
            return None
        if any([c in text for c in _RARE_SPACES]) and _WIDE_SPACE.search(text):
            return None
        # Up to two line ends are tokens of their own, and no space precedes what follows them.
        return (_PLAIN + text.replace("\n", f" \n {_PLAIN}")).split(" ")

    def _joined(self, pieces: list[str], before: str, between: str, cuts) -> list[bytes]:
        """Ids of each piece: encoded in groups, as one text each, and cut at the joints; singly where that fails."""
        groups = [pieces[i: i + _GROUP] for i in range(0, len(pieces), _GROUP)]
        out: list[bytes] = []
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([before + between.join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            starts, ends = cuts(ids)
            if len(starts) == len(group):
                raw = ids.tobytes()
                out += [raw[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True)]
            else:
                out += [self._one(before + p) for p in group]
        return out

    def _encode(self, keys: list[str]) -> None:
        known = self.known
        if self.folds and (odd := [k for k in keys if not _UNKNOWN.isdisjoint(k)]):
            known.update((k, np.array(self.whole.encode(k, add_special_tokens=False).ids, "<u4").tobytes()) for k in odd)
            keys = list(set(keys).difference(odd))
        if not self.keeps_space:
            # A rare mark of one token stands between pieces.
            mark = self.tokenizer.encode("★", add_special_tokens=False).ids

            def at_mark(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                at = np.flatnonzero(ids == mark[0])
                return np.append(0, at + 1), np.append(at, len(ids))

            known.update(zip(keys, self._joined(keys, "", " ★ ", at_mark), strict=True))
            return

        def at_space(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.flatnonzero(self.opens[ids])
            return at, np.append(at[1:], len(ids)).astype(at.dtype)

        def at_line_end(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.flatnonzero(ids == np.frombuffer(self.line_end, "<u4")[0])
            return np.append(0, at + 1), np.append(at, len(ids))

        spaced = [k for k in keys if k[0] != _PLAIN and k != "\n"]
        known.update(zip(spaced, self._joined(spaced, " ", " ", at_space), strict=True))
        # Pieces with white space of their own would not keep to the joints.
        plain = [k for k in keys if k[0] == _PLAIN and len(k) > 1]
        simple = [k for k in plain if len(k[1:].split()) == 1 and k[1:].split()[0] == k[1:]]
        known.update(zip(simple, self._joined([k[1:] for k in simple], "", "\n", at_line_end), strict=True))
        for k in set(plain).difference(simple):
            known[k] = self._one(k[1:])
        known[_PLAIN], known["\n"] = b"", self.line_end

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        if self.folds:
            texts = [_fold(t) for t in texts]
        split = [self._pieces(t) for t in texts]
        if len(self.known) > self.memory:
            self.known, self.older = {}, self.known
        missing = set().union(*[p for p in split if p is not None]).difference(self.known)
        again = missing.intersection(self.older)
        self.known.update(zip(again, map(self.older.__getitem__, again)))
        missing -= again
        if missing:
            self._encode(list(missing))
        get = self.known.__getitem__
        return [self._one(t) if pieces is None else b"".join(map(get, pieces)) for t, pieces in zip(texts, split, strict=True)]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(name: str) -> PieceEncoder:
    """One encoder a worker and tokenizer."""
    if name not in _ENCODERS:
        _ENCODERS[name] = PieceEncoder(name)
    return _ENCODERS[name]
