"""Suffix arrays of bounded shards in numpy, and which of their strings repeat."""

from __future__ import annotations

import numpy as np

#: A sort key packs two ranks and a position of so many bits; bytes that a shard takes (one anchor may bring it up to twice that).
BITS = 21
MOST = 1 << (BITS - 1)


def _sizes(length: int, first: int) -> list[int]:
    """Prefix lengths to sort by, each at most twice the one before, up to ``length``."""
    out = [length]
    while out[-1] > first:
        out.append(-(-out[-1] // 2))
    return out[-2::-1] if len(out) > 1 else []


def refine(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Larsson-Sadakane refinement up to prefixes of ``length`` bytes.

    Returns the positions that share such a prefix with another position, in
    suffix order, and the group number of each.  A position's rank is the place
    in suffix order of the first of its group; a round sorts the positions of
    groups not yet single by their own rank and the rank further on.  ``text``
    is read as if zeros followed it; it may hold bytes or codes of words.
    """
    n = len(text)
    if n >= 1 << BITS:
        raise ValueError(f"a shard of {n} units; at most {(1 << BITS) - 1} have a place in a sort key")
    used, code = np.unique(text, return_inverse=True)
    width = max(1, int(len(used) - 1).bit_length())
    first = min(length, (2 * BITS) // width)
    coded = np.concatenate([code.astype(np.uint64), np.zeros(first, dtype=np.uint64)])
    key = np.zeros(n, dtype=np.uint64)
    for k in range(first):
        key = (key << np.uint64(width)) | coded[k : k + n]
    shift, mask = np.uint64(BITS), np.uint64((1 << BITS) - 1)
    key = np.sort((key << shift) | np.arange(n, dtype=np.uint64))
    place = (key & mask).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], (key[1:] >> shift) != (key[:-1] >> shift)])) if n else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([head, [n]]))
    rank = np.zeros(n + length, dtype=np.uint64)
    rank[place] = np.repeat(head, size).astype(np.uint64)
    rank[n:] = (1 << BITS) - 1
    open_ = np.repeat(size > 1, size)
    place = place[open_]
    have = first
    for goal in _sizes(length, first):
        if not len(place):
            break
        own = rank[place]
        key = np.sort((own << np.uint64(2 * BITS)) | (rank[place + (goal - have)] << shift) | place.astype(np.uint64))
        place = (key & mask).astype(np.int64)
        own = (key >> np.uint64(2 * BITS)).astype(np.int64)
        pair = key >> shift
        at = np.arange(len(place))
        outer = np.concatenate([[True], own[1:] != own[:-1]])
        begin = np.maximum.accumulate(np.where(outer, at, 0))
        inner = np.concatenate([[True], pair[1:] != pair[:-1]])
        head = np.flatnonzero(inner)
        size = np.diff(np.concatenate([head, [len(place)]]))
        rank[place] = np.repeat((own + at - begin)[head], size).astype(np.uint64)
        place = place[np.repeat(size > 1, size)]
        have = goal
    return place, rank[place].astype(np.int64)


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length, at most ``most``, of the common prefix of the suffixes at a[i] (all different) and b[i].

    Kasai's step: one position further on in both texts the common prefix is one
    shorter, so along a run of pairs (p, q), (p+1, q+1), ... each byte is compared
    once and the lengths follow from the next difference.
    """
    if not len(a):
        return np.zeros(0, dtype=np.int64)
    ahead = np.uint64(1 << BITS)
    key = np.sort((((b - a).astype(np.uint64) + ahead) << np.uint64(BITS)) | a.astype(np.uint64))
    x = (key & np.uint64((1 << BITS) - 1)).astype(np.int64)
    y = x + (key >> np.uint64(BITS)).astype(np.int64) - (1 << BITS)
    fresh = np.concatenate([[True], (np.diff(x) != 1) | (np.diff(y) != 1)])
    begin = np.flatnonzero(fresh)
    run = np.diff(np.concatenate([begin, [len(x)]]))
    span = run + most
    offset = np.concatenate([[0], np.cumsum(span)[:-1]])
    # places fit in 32 bits, which halves what the steps of all runs take
    step = np.arange(int(span.sum()), dtype=np.int32) - np.repeat(offset.astype(np.int32), span)
    n = len(text)
    p, q = np.repeat(x[begin].astype(np.int32), span) + step, np.repeat(y[begin].astype(np.int32), span) + step
    inside = (p < n) & (q < n)
    same = inside & (text[np.minimum(p, n - 1)] == text[np.minimum(q, n - 1)])
    same[offset + span - 1] = False  # a run's last byte ends every prefix; it is most bytes beyond its last pair
    del p, q, step, inside
    at = np.arange(len(same), dtype=np.int32)
    stop = np.minimum.accumulate(np.where(same, np.int32(len(same)), at)[::-1])[::-1]
    here = np.repeat(offset, run) + (np.arange(len(x)) - np.repeat(begin, run))
    at_place = np.zeros(n, dtype=np.int64)
    at_place[x] = np.minimum(stop[here] - here, most)
    return at_place[a]


def repeated(texts: list[bytes], length: int, unit: str = "u1") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which strings of ``length`` units inside ``texts`` occur at more than one place in them.

    Returns starts[i], the place of text i in the joined text, then the joined
    places p of the repeated strings and for each the group of equal strings.
    All places count units of the type ``unit``.
    """
    text = np.frombuffer(b"".join(texts), dtype=unit)
    sizes = np.array([len(t) for t in texts], dtype=np.int64) // text.itemsize
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    place, group = refine(text, length)
    owner = np.searchsorted(starts, place, side="right") - 1
    whole = place + length <= starts[owner + 1]
    place, group = place[whole], group[whole]
    if len(place) < 2:
        return starts, place[:0], group[:0]
    beside = group[1:] == group[:-1]
    beside[beside] = common_prefixes(text, place[:-1][beside], place[1:][beside], length) >= length
    alike = np.concatenate([[False], beside]) | np.concatenate([beside, [False]])
    number = np.cumsum(np.concatenate([[True], ~beside]))
    return starts, place[alike], number[alike]
