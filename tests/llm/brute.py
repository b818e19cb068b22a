"""Plain versions of what the operators compute, over lists of (doc_id, text)."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 2**63 - 1


def ids(tokenizer, text: str | None) -> np.ndarray:
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def tokenizer(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path(name))
    found.encode_special_tokens = True
    return found


def crc(values: np.ndarray) -> int:
    return zlib.crc32(values.tobytes())


def fingerprint(text: str | None) -> int:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i: i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values: list[int], near: int = 2) -> list[int]:
    """The least index that each value is connected to."""
    label = list(range(len(values)))

    def root(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= near and (a := root(i)) != (b := root(j)):
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(values))]


def shingles(text: str | None, width: int = 5) -> set[tuple[str, ...]]:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i: i + width]) for i in range(max(len(words) - width + 1, 1))} if words else set()


def similarity(a: str | None, b: str | None) -> float:
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x or y else 0.0


def near_copies(texts: list[str | None]) -> list[int]:
    """The component of each text: linked by at most 2 fingerprint bits or a similarity of 0.8 or more."""
    prints, sets = [fingerprint(t) for t in texts], [shingles(t) for t in texts]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            close = (prints[i] ^ prints[j]).bit_count() <= 2
            if close or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0:
                old, new = parent[i], parent[j]
                parent = [new if p == old else p for p in parent]
    return parent


def repeats(rows: list[tuple[int | None, str | None]], window: int = 50) -> list[tuple[int | None, int, int, str]]:
    first: dict[tuple[str, ...], int] = {}
    split = [(LAST if i is None else i, WORD.findall(t or "")) for i, t in rows]
    for i, words in split:
        for p in range(len(words) - window + 1):
            k = tuple(words[p: p + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, words in split:
        gone = [False] * len(words)
        for p in range(len(words) - window + 1):
            if first[tuple(words[p: p + window])] < i:
                gone[p: p + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((None if i == LAST else i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i: i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)} if len(windows) < 400 else None
    if covered is None:
        times: dict[tuple[str, ...], int] = {}
        for w in windows:
            times[w] = times.get(w, 0) + 1
        covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(text: str | None, items: list[tuple[object, str | None]], window: int = 10) -> tuple[int, int, list[str]]:
    def split(t: str | None) -> list[str]:
        return ITEM_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    words, hit, named = split(text), set(), set()
    for item, t in items:
        own = split(t)
        size = min(window, len(own))
        wanted = {tuple(own[i: i + size]) for i in range(len(own) - size + 1)} if own else set()
        for p in range(len(words) - size + 1) if wanted else ():
            if tuple(words[p: p + size]) in wanted:
                hit.update(range(p, p + size))
                if item is not None:
                    named.add(str(item))
    return len(words), len(hit), sorted(named)
