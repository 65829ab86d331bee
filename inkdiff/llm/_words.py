"""Vectorised hashes of the words of many texts, and of runs of n consecutive words.

A word's 64-bit hash is a polynomial over its bytes, taken from running sums with wrap-around arithmetic and then mixed;
a run's hash is a polynomial over its words' hashes. All constants follow from a fixed rule, so every process agrees.
Texts are UTF-8 bytes; words are runs of bytes other than the separators, all of which are ASCII.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
CHUNK = 1 << 20
_MASK = (1 << 64) - 1


def _split_mix(n: int, seed: int) -> list[int]:
    out = []
    for _ in range(n):
        seed = (seed + 0x9E3779B97F4A7C15) & _MASK
        z = ((seed ^ (seed >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    return out


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2**64, as far as they were asked for."""

    def __init__(self, base: int) -> None:
        self.bases, self.tables = (base | 1, pow(base | 1, -1, 1 << 64)), [np.ones(1, U), np.ones(1, U)]

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.tables[0]) < n:
            size = max(n, 1 << 12)
            for k, b in enumerate(self.bases):
                t = np.full(size, b, U)
                t[0] = 1
                self.tables[k] = np.multiply.accumulate(t)
        return self.tables[0][:n], self.tables[1][:n]


_BYTE = np.array(_split_mix(256, 1), U)
_OF_BYTES = _Powers(_split_mix(1, 2)[0])
_OF_WORDS = [_Powers(b) for b in _split_mix(2, 3)]
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _chunk_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a chunk."""
    b = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    np.logical_not(SPACES[b], out=inside[1:-1].view(bool))
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    powers, inverses = _OF_BYTES.upto(len(b) + 1)
    sums = np.zeros(len(b) + 1, U)
    np.cumsum(_BYTE[b] * powers[: len(b)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(U))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the words of texts[i] are hashes[bounds[i] : bounds[i + 1]]. A chunk at a time is worked on."""
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts) + 1, np.int64)
    batch: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if batch:
            starts, h = _chunk_hashes(b" ".join(texts[i] for i in batch))
            ends = np.cumsum([len(texts[i]) + 1 for i in batch])
            counts[np.array(batch) + 1] = np.diff(np.searchsorted(starts, ends), prepend=0)
            hashes.append(h)
            batch.clear()
            held = 0

    for i, text in enumerate(texts):
        if len(text) > CHUNK:
            flush()
            for piece in _pieces(text):
                h = _chunk_hashes(piece)[1]
                counts[i + 1] += len(h)
                hashes.append(h)
            continue
        if held + len(text) > CHUNK:
            flush()
        batch.append(i)
        held += len(text) + 1
    flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, U)), np.cumsum(counts)


def _pieces(text: bytes):
    """Pieces of a long text, cut before white space."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        while end < len(text) and not SPACES[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def run_hashes(words: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hashes of each n consecutive words: len(words) - n + 1 of them. which picks one of two independent hashes."""
    if len(words) < n:
        return np.zeros(0, U)
    powers, inverses = _OF_WORDS[which].upto(len(words) + 1)
    sums = np.zeros(len(words) + 1, U)
    np.cumsum(words * powers[: len(words)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * inverses[: len(words) - n + 1])


def distinct_runs(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-word runs of each text, sorted, and their bounds; a text of fewer words is one run, without words none."""
    runs = run_hashes(words, n)
    sets, sizes = [], [0]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            own = runs[a : b - n + 1].copy()
            own.sort()
            own = own[np.flatnonzero(np.diff(own, prepend=own[:1] ^ U(1)))] if len(own) > 1 else own
        else:
            own = mix(run_hashes(words[a:b], b - a) + U(b - a)) if b > a else words[:0]
        sets.append(own)
        sizes.append(len(own))
    return (np.concatenate(sets) if sets else words[:0]), np.cumsum(sizes)
