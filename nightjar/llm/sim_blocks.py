"""SimHash blocks: keys that near texts share, and a fingerprint that tells which of those who share one are near.

The features of a text (hashes) are dealt to classes by their hash, and every class votes on a 64-bit SimHash block of its
own. An edit changes the blocks of the classes that it touches and leaves the others as they are, so two texts with
fewer touched classes than blocks agree on a whole block: the pigeonhole join needs equality alone, at any distance
of the fingerprints. The number of classes follows from the number of features, so that a class holds a few; a text
near a change of that number is dealt both ways. Long texts use their first ``keys`` classes only.
"""

from __future__ import annotations

import numpy as np

from nightjar.llm._common import mix64

_BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
_AT = mix64(np.arange(1001, 1001 + 4096, dtype=np.uint64)) | np.uint64(1)
_ODD = mix64(np.arange(601, 633, dtype=np.uint64)) | np.uint64(1)
#: A byte's eight bits, each in a byte of its own of a 64-bit number
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
_LANE = 255  # so many votes can be added before a byte overflows
_BLOCK = 1 << 12
#: Share of a doubling by which the number of features may differ at a change of the number of classes
_MARGIN = 0.1


def word_hashes(raw: bytes, inside: np.ndarray, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of the first byte) of every longest run of bytes that are ``inside``, in pieces of bounded size."""
    whole = np.frombuffer(raw, dtype=np.uint8)
    found, places, at = [], [], 0
    while at < len(whole):
        size = piece
        while True:
            part = whole[at : at + size]
            here = inside[part]
            if at + size >= len(whole) or not here.all():
                break
            size *= 2  # a single word longer than a piece
        if at + len(part) < len(whole):
            cut = len(here) - int(np.argmax(~here[::-1]))  # a word at the end may go on
            part, here = part[:cut], here[:cut]
        edge = np.flatnonzero(np.diff(np.r_[False, here, False]))
        starts, length = edge[::2], edge[1::2] - edge[::2]
        if len(starts):
            first = np.cumsum(length) - length
            place = np.arange(int(length.sum())) - np.repeat(first, length)
            found.append(mix64(np.add.reduceat(_BYTE[part[here]] * _AT[place & 4095], first)))
            places.append(starts + at)
        at += len(part)
    return (np.concatenate(found), np.concatenate(places)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def with_previous(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each word and the one before it, in consecutive runs of ``counts`` words; the first has none before."""
    before = np.r_[np.zeros(1, np.uint64), hashes[:-1]]
    before[(np.cumsum(counts) - counts)[counts > 0]] = 0
    return mix64(hashes + before * _ODD[0])


def shingled(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive words; of fewer words one of them all, of none none."""
    size = max(1, min(size, len(hashes)))
    n = len(hashes) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(size if len(hashes) else 0):
        out += hashes[i : i + n] * _ODD[1 + i % 31]
    return mix64(out)


def votes(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64-bit SimHashes of consecutive runs of hashes, none empty: a bit is set if over half of a run's hashes set it."""
    out = np.empty(len(counts), np.uint64)
    ends = np.cumsum(counts)
    # of one, two and three hashes the majority is plain bit arithmetic
    one, two, three = (ends[counts == k] - k for k in (1, 2, 3))
    if len(one) or len(two) or len(three):
        out[counts == 1] = hashes[one]
        out[counts == 2] = hashes[two] & hashes[two + 1]
        a, b, c = hashes[three], hashes[three + 1], hashes[three + 2]
        out[counts == 3] = a & b | c & (a | b)
        if (many := counts > 3).any():
            out[many] = votes(hashes[np.repeat(many, counts)], counts[many])
        return out
    done = at = 0
    while done < len(counts):
        upto = max(done + 1, int(np.searchsorted(ends, at + (1 << 18), "right")))
        n, h = counts[done:upto], hashes[at : ends[upto - 1]]
        pieces = -(-n // _LANE)
        first = np.cumsum(pieces) - pieces
        starts = np.cumsum(n) - n
        cuts = np.repeat(starts, pieces) + _LANE * (np.arange(int(pieces.sum())) - np.repeat(first, pieces))
        sums = np.empty((len(cuts), 64), np.uint8)
        for i in range(0, len(cuts), _BLOCK):
            low, high = cuts[i], cuts[i + _BLOCK] if i + _BLOCK < len(cuts) else len(h)
            sums[i : i + _BLOCK] = np.add.reduceat(_SPREAD[h[low:high].view(np.uint8).reshape(-1, 8)], cuts[i : i + _BLOCK] - low, axis=0).view(np.uint8)
        total = np.add.reduceat(sums, first, axis=0, dtype=np.int32) if len(cuts) > len(n) else sums.astype(np.int32)
        out[done:upto] = np.packbits(2 * total > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
        done, at = upto, ends[upto - 1]
    return out


def block_keys(hashes: np.ndarray, counts: np.ndarray, a_class: float, keys: int, fewest: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(key, run) of the blocks of consecutive runs of feature hashes.

    A class holds about ``a_class`` features; a block of under ``fewest`` features gives no key.
    """
    run = np.repeat(np.arange(len(counts)), counts)
    drawn = mix64(hashes + _ODD[31])
    scale = np.log2(np.maximum(counts, 1) / a_class) + 0.5
    key, of = [], []
    below = None
    for shift in (-_MARGIN, _MARGIN):
        bits = np.maximum(0, np.floor(scale + shift)).astype(np.uint64)
        klass = np.where(bits[run] > 0, drawn >> (np.uint64(64) - np.maximum(bits, 1).astype(np.uint64)[run]), np.uint64(0))
        use = klass < keys
        if below is not None:
            use &= (bits != below)[run]
        below = bits
        slot = run[use] * keys + klass[use].astype(np.int64)
        order = np.argsort(slot, kind="stable")
        slot, own = slot[order], hashes[use][order]
        starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, np.int64)
        size = np.diff(np.r_[starts, len(slot)])
        enough = size >= fewest
        own, starts, size = own[np.repeat(enough, size)], starts[enough], size[enough]
        which = slot[starts]
        salt = (which % keys).astype(np.uint64) + bits[which // keys] * np.uint64(4096) + np.uint64(1)
        key.append(mix64(votes(own, size) ^ mix64(salt)) if len(size) else np.zeros(0, np.uint64))
        of.append(which // keys)
    return np.concatenate(key), np.concatenate(of)
