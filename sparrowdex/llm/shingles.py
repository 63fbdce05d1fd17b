"""Word shingles as sorted sets of 64-bit hashes, for a batch of texts at once in numpy."""

from __future__ import annotations

import numpy as np

SHINGLE = 5
#: Bytes of text that are hashed at once.
SLICE = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text); words are runs of bytes that are no ASCII white space."""
    data = np.frombuffer(b"\n".join(t.lower() if t else b"" for t in texts) + b"\n", np.uint8)
    sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = np.flatnonzero(first)
    counts = np.diff(np.searchsorted(at, np.concatenate([[0], np.cumsum(sizes)])))
    if not len(at):
        return np.zeros(0, np.uint64), counts
    code = data[inside]
    starts = np.cumsum(inside)[at] - 1
    lengths = np.diff(np.append(starts, len(code)))
    place = np.arange(len(code)) - np.repeat(starts, lengths)
    power = np.cumprod(np.full(int(lengths.max()), _BASE))
    h = np.add.reduceat((code.astype(np.uint64) + np.uint64(1)) * power[place], starts)
    return mix(h + lengths.astype(np.uint64) * _STEP), counts


def _sets(texts: list[bytes | None]) -> list[np.ndarray]:
    word, counts = _words(texts)
    run = word[: max(0, len(word) - SHINGLE + 1)].copy()
    for k in range(1, SHINGLE):
        run = run * _STEP + word[k : k + len(run)]
    run, out, at = mix(run), [], 0
    for n in counts.tolist():
        if n >= SHINGLE:
            s = np.sort(run[at : at + n - SHINGLE + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n:
            h = np.uint64(n)
            for w in word[at : at + n]:
                h = mix(np.array([h], np.uint64) * _STEP + w)[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def shingle_sets(texts: list[bytes | None]):
    """The set of each text, in order: distinct shingles of 5 lower-cased (A-Z) words; with fewer words, the whole
    sequence as one; without words, or null, empty."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > first and held + n > SLICE:
            yield from _sets(texts[first:i])
            first, held = i, 0
        held += n
    yield from _sets(texts[first:])
