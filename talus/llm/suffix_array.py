"""Suffix arrays of shards by induced sorting, and permuted common prefixes.

Positions are L (greater than their right neighbour) or S; an S after an L is leftmost-smaller
(LMS).  The substrings between LMS positions are sorted by inducing, named, and the string of
names is sorted recursively, down to names that all differ; from the sorted LMS suffixes the
whole array is induced in two passes.  A pass goes over groups of neighbouring buckets, with
whole arrays: one bucket a group where the alphabet is small, a share of the names else.
"""

from __future__ import annotations

import numpy as np

#: Groups of buckets that a pass over a large alphabet is cut into, and the alphabet up to which each bucket is one.
GROUPS, SMALL = 16, 512

# ---- inducing ----------------------------------------------------------------------------------


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is of type S; the last symbol is the unique least one."""
    n = len(s)
    turn = np.append(s[1:] != s[:-1], True)
    # Each position takes the type of the end of its run.
    ends = np.minimum.accumulate(np.where(turn, np.arange(n), n)[::-1])[::-1]
    rising = np.empty(n, bool)
    rising[:-1] = s[:-1] < s[1:]
    rising[-1] = True
    return rising[ends]


def _groups(s: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The group of each symbol's bucket, and whether a group is one bucket."""
    counts = np.bincount(s, minlength=size)
    share = 1 if size <= SMALL else max(1, len(s) // GROUPS)
    raw = (np.cumsum(counts) - counts) // share
    new = np.append(False, raw[1:] != raw[:-1])
    group = np.cumsum(new)
    single = np.bincount(group, counts > 0) <= 1
    return group, single


def _inner_order(rounds: list[np.ndarray], key: np.ndarray, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a group whose right neighbours are in it, in order, and their spots among the others.

    Each round holds left neighbours of the one before; the first one's right neighbours have
    known spots.  A position is the chain of spots up to such a neighbour; chains are compared
    by ranks of twice the length until all are told apart.
    """
    inner = np.concatenate(rounds)
    n, ends = len(inner), rounds[0] + 1
    at = (key[inner].astype(np.int64) << 34) + (np.int64(1) << 32)
    _, rank = np.unique(np.concatenate([at, spot[ends]]), return_inverse=True)
    # Nodes: the inner positions, then the ends of their chains, which follow themselves.
    by = np.argsort(inner)
    follower = np.arange(n + len(ends))
    follower[: len(ends)] += n
    follower[len(ends) : n] = by[np.searchsorted(inner, inner[len(ends) :] + 1, sorter=by)]
    while (follower[:n] < n).any():
        _, rank = np.unique(rank * np.int64(len(rank)) + rank[follower], return_inverse=True)
        follower = follower[follower]
    by = np.argsort(rank[:n] * np.int64(len(rank)) + rank[follower[:n]])
    return inner[by], at[by]


def _pass(key: np.ndarray, follows: np.ndarray, seeds: np.ndarray, group: np.ndarray, single: np.ndarray) -> np.ndarray:
    """One inducing pass: the order of `seeds`, given sorted, and of all positions of flag `follows`.

    A position of flag `follows` has a key at least that of its right neighbour; it comes before
    the seeds of its bucket, in the order of the right neighbours.  Groups are worked off in
    order.  In a group of several buckets, positions whose neighbour is in the same group are
    ordered by themselves and put between the others and the seeds of their buckets.
    """
    of = group[key].astype(np.uint16)
    cuts = np.searchsorted(of[seeds], np.arange(len(single) + 1))
    queue: list[list[np.ndarray]] = [[] for _ in single]
    spot = np.empty(len(key), np.int64)
    out = []

    def left_of(some: np.ndarray) -> np.ndarray:
        before = some[some > 0] - 1
        return before[follows[before]]

    for g, lone in enumerate(single.tolist()):
        dealt = np.concatenate(queue[g]) if queue[g] else np.empty(0, np.int64)
        queue[g] = []
        mine = seeds[cuts[g] : cuts[g + 1]]
        if not len(dealt) and not len(mine):
            continue
        if lone:
            parts, some = [dealt], dealt
            # Those of the same bucket follow in it and are worked off next.
            while len(some := left_of(some)) and len(some := some[of[some] == g]):
                parts.append(some)
            placed = np.concatenate([*parts, mine])
        else:
            known = np.concatenate([dealt, mine])
            place = np.concatenate([np.arange(len(dealt)), (np.int64(2) << 32) + np.arange(len(mine))])
            place += key[known].astype(np.int64) << 34
            by = np.argsort(place)
            placed, place, inner, some = known[by], place[by], [], known
            while len(some := left_of(some)) and len(some := some[of[some] == g]):
                inner.append(some)
            if inner:
                spot[placed] = place
                more, at = _inner_order(inner, key, spot)
                placed = np.insert(placed, np.searchsorted(place, at), more)
        out.append(placed)
        later = left_of(placed)
        to = of[later]
        away = to != g
        later, to = later[away], to[away]
        if len(later):
            by = np.argsort(to, kind="stable")
            later, to = later[by], to[by]
            starts = np.flatnonzero(np.append(True, to[1:] != to[:-1])).tolist()
            for a, b in zip(starts, [*starts[1:], len(to)]):
                queue[to[a]].append(later[a:b])
    return np.concatenate(out)


def _induce(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The order of all suffixes induced from `lms`, which is sorted by symbol and as far as it shall be."""
    group, single = _groups(s, size)
    order = _pass(s, ~is_s, lms, group, single)
    falling = order[~is_s[order]][::-1]
    order = _pass(size - 1 - s, is_s, falling, (len(single) - 1 - group)[::-1], single[::-1])[::-1]
    # The sentinel is of type S and has no right neighbour that could induce it.
    return np.concatenate([[len(s) - 1], order[order != len(s) - 1]])


def _names(s: np.ndarray, is_s: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """LMS positions in text order, the names of their substrings, and the number of names.

    `order` has the LMS positions sorted by their substrings.
    """
    n = len(s)
    places = np.sort(order)
    length = np.zeros(n, np.int64)
    length[places] = np.diff(places, append=n - 1) + 1
    size = length[order]
    a, b = order[:-1], order[1:]
    like = np.flatnonzero(size[:-1] == size[1:])
    equal = np.zeros(len(order) - 1, bool)
    # Substrings of equal length, compared symbol by symbol for all pairs at once.
    step = 0
    while len(like):
        alike = s[a[like] + step] == s[b[like] + step]
        like = like[alike]
        step += 1
        over = size[like] <= step
        equal[like[over]] = True
        like = like[~over]
    name_of = np.empty(n, np.int64)
    ranks = np.concatenate([[0], np.cumsum(~equal)])
    name_of[order] = ranks
    return places, name_of[places], int(ranks[-1]) + 1


def _sorted(s: np.ndarray, size: int) -> np.ndarray:
    """The suffix array of symbols below `size` whose last one is the unique 0."""
    if len(s) == 1:
        return np.zeros(1, np.int64)
    is_s = _types(s)
    is_lms = np.zeros(len(s), bool)
    is_lms[1:] = is_s[1:] & ~is_s[:-1]
    lms = np.flatnonzero(is_lms)
    lms = lms[np.argsort(s[lms], kind="stable")]
    order = _induce(s, is_s, lms, size)
    order = order[is_lms[order]]
    places, names, n_names = _names(s, is_s, order)
    if n_names < len(places):
        # The sentinel's substring has the least name, once: the names end like any other string.
        order = places[_sorted(names, n_names)]
    return _induce(s, is_s, order, size)


def suffix_array(symbols: np.ndarray, size: int) -> np.ndarray:
    """The suffix array of symbols in 1..size-1; a sentinel 0 is appended and left out of the result."""
    return _sorted(np.append(symbols.astype(np.int32), np.int32(0)), size)[1:]


# ---- common prefixes ---------------------------------------------------------------------------


def permuted_lcp(text: np.ndarray, order: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each position's suffix with its predecessor in `order`, in text order.

    Values follow from the left neighbour (one less) except where the symbols before differ: only
    there, and at `starts`, are symbols compared, eight at a time and up to `most` in all.  A
    value that follows is exact while it is below `most` minus the distance to its start.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    fresh = np.zeros(n, bool)
    fresh[starts] = True
    fresh[0] = True
    inner = np.flatnonzero((place > 0) & (before > 0))
    fresh[inner] |= text[inner - 1] != text[before[inner] - 1]
    fresh[before <= 0] = True
    padded = np.concatenate([text, np.zeros(16, np.uint8)])
    words = np.ndarray((n + 8,), "<u8", buffer=padded, strides=(1,))
    value = np.zeros(n, np.int64)
    todo = np.flatnonzero(fresh & (before >= 0))
    done = 0
    while len(todo) and done < most:
        i, j = todo + done, before[todo] + done
        inside = (i < n) & (j < n)
        todo, i, j = todo[inside], i[inside], j[inside]
        differ = words[i] ^ words[j]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64)
        value[todo] += np.minimum(same, n - np.maximum(i, j))
        todo = todo[(differ == 0)]
        done += 8
    value = np.minimum(value, most)
    # The rest count down from the last fresh position.
    last = np.maximum.accumulate(np.where(fresh, place, 0))
    return np.maximum(value[last] - (place - last), 0)


#: Never part of UTF-8: separates the segments of a shard.
SEPARATOR = 0xFF


def repeated_windows(segments: list[bytes], width: int) -> list[np.ndarray]:
    """For each segment and each of its windows of `width` bytes: does it start elsewhere in the shard too."""
    sizes = np.array([len(x) for x in segments], np.int64)
    text = np.frombuffer(b"".join(x + bytes([SEPARATOR]) for x in segments), np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
    order = suffix_array(text.astype(np.int32) + 1, 257)
    most = int(sizes.max(initial=0)) + width + 8
    common = permuted_lcp(text, order, starts, most)[order] >= width
    after = np.append(common[1:], False)
    again = np.empty(len(text), bool)
    again[order] = common | after
    return [again[a : a + max(0, n - width + 1)] for a, n in zip(starts.tolist(), sizes.tolist())]
