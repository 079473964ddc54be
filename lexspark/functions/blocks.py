"""Matching characters of many pairs of strings at once, by longest matching blocks as difflib's SequenceMatcher finds them."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: Characters from which difflib leaves out a string's popular characters, and its rule for them: more than size // 100 + 1.
POPULAR_FROM = 200
#: Characters of a gram, values of its hash, strings of an index, characters and cells worked on at once.
GRAM, HASHES, TEXTS, CELLS = 3, 2048, 128, 1_000_000
_BITS = 21  # of a place in a string; CELLS is below


def _laid(texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of texts with `end` around each, where each begins, its size."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    chars = np.frombuffer("\0".join(["", *texts, "", "", ""]).encode("utf-32-le", "surrogatepass"), np.int32).copy()
    begin = np.cumsum(size + 1) - size
    chars[begin - 1] = chars[-GRAM:] = end
    return chars, begin, size


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, value) of ranges that begin at `first`."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) + (first - np.cumsum(count) + count)[which]


class _Index:
    """Where each key stands in each of some texts."""

    def __init__(self, key: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int, popular: bool = False):
        text, place = _ranges(begin, size)
        at = text * width + key[place]
        self.count = np.bincount(at, minlength=len(begin) * width)
        self.first, self.place, self.width = np.cumsum(self.count) - self.count, place[np.argsort(at, kind="stable")], width
        self.left_out = place[:0]
        if popular:
            many = self.count > np.repeat(size // 100 + 1, width)
            self.left_out = place[many[at]]
            self.count[many] = 0


def _matched(a, b, free, rects, total, key, index, gram, popular):
    """Add the matching characters of rectangles to total; returns the rectangles without a run of `gram` characters.

    rects are rows (from, to) in a, (from, to) in b, text of the index, pair; free is b without popular characters.
    Rectangles of all pairs are settled level by level: the longest run in each, then what lies before and behind it.
    """
    left, stack = [rects[:, :0]], [rects]
    while stack:
        rects = stack.pop()
        fits = (rects[1] - rects[0]).sum() <= CELLS and (rects[3] - rects[2]).max(initial=0) <= CELLS
        if fits:
            which, i = _ranges(rects[0], rects[1] - rects[0])
            at = (rects[4] * index.width)[which] + key[i]
            count = np.minimum(index.count[at], (rects[3] - rects[2])[which])
        if not fits or count.sum() > CELLS:
            half = len(rects[0]) // 2
            if half:
                stack += [rects[:, :half], rects[:, half:]]
            else:  # a lone pair of very long or monotonous strings; a part of b is not asked for popular characters
                (s, e, f, g, _, n), text = rects[:, 0], lambda x: "".join(map(chr, x + 1))
                total[n] += sum(m.size for m in SequenceMatcher(None, text(a[s:e]), text(b[f:g])).get_matching_blocks())
            continue
        more = np.flatnonzero(count)
        # the places of the key in the text, or all of the rectangle if those are fewer
        few = index.count[at[more]] == count[more]
        cell, j = _ranges(np.where(few, index.first[at[more]], rects[2][which[more]]), count[more])
        j = np.where(few[cell], index.place.take(j, mode="clip"), j)
        ok = np.flatnonzero(a[i[more]][cell] == free[j])  # a hash may be shared, as below
        cell, j = more[cell[ok]], j[ok]
        i, r = i[cell], which[cell]
        ok = (j >= rects[2][r]) & (j < rects[3][r]) & ((i == rects[0][r]) | (j == rects[2][r]) | (a[i - 1] != free[j - 1]))
        for k in range(1, gram):
            ok &= a[i + k] == free[j + k]
        i, j, r = i[ok], j[ok], r[ok]
        size, live = np.full(len(i), gram), np.arange(len(i))
        while len(live):
            live = live[a[i[live] + size[live]] == free[j[live] + size[live]]]
            size[live] += 1
        while len(rects[0]):
            alo, ahi, blo, bhi, text, pair = rects
            skip = np.maximum(np.maximum(alo[r] - i, blo[r] - j), 0)
            size = np.minimum(np.minimum(size, ahi[r] - i), bhi[r] - j) - skip
            ok = size >= gram
            i, j, r, size = (i + skip)[ok], (j + skip)[ok], r[ok], size[ok]
            # the longest run, of equals the first in a, then in b
            best, most = np.full(len(alo), -1), (1 << _BITS) - 1
            np.maximum.at(best, r, size << 2 * _BITS | most - (i - alo[r]) << _BITS | most - (j - blo[r]))
            none = best < 0
            left.append(rects[:, none])
            x, y, k = (np.where(none, low, v) for low, v in ((alo, alo + most - (best >> _BITS & most)), (blo, blo + most - (best & most)), (0, best >> 2 * _BITS)))
            if popular:  # runs go on over popular characters
                live = np.flatnonzero((x > alo) & (y > blo))
                while len(live := live[a[x[live] - 1] == b[y[live] - 1]]):
                    x[live], y[live], k[live] = x[live] - 1, y[live] - 1, k[live] + 1
                    live = live[(x[live] > alo[live]) & (y[live] > blo[live])]
                live = np.flatnonzero((x + k < ahi) & (y + k < bhi))
                while len(live := live[a[x[live] + k[live]] == b[y[live] + k[live]]]):
                    k[live] += 1
                    live = live[(x[live] + k[live] < ahi[live]) & (y[live] + k[live] < bhi[live])]
            np.add.at(total, pair, k)
            before, behind = (k > 0) & (alo < x) & (blo < y), (k > 0) & (x + k < ahi) & (y + k < bhi)
            # a run in both would be longer than the longest
            goes = np.where((i < x[r]) & (j < y[r]), np.where(before, np.cumsum(before) - 1, -1)[r], -1)
            goes = np.where((i + size > (x + k)[r]) & (j + size > (y + k)[r]), np.where(behind, np.cumsum(behind) - 1 + before.sum(), -1)[r], goes)
            rects = np.concatenate([np.stack([alo, x, blo, y, text, pair])[:, before], np.stack([x + k, ahi, y + k, bhi, text, pair])[:, behind]], axis=1)
            ok = goes >= 0
            i, j, r, size = i[ok], j[ok], goes[ok], size[ok]
    return np.concatenate(left, axis=1)


def ratios(lines: list[str], others: list[str], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """SequenceMatcher(None, lines[left[p]], others[right[p]]).ratio() of each pair p.

    Runs of a pair are found from the places of shared grams, or of rare characters if the other string is one whose popular
    ones are left out, instead of character by character; what lies between runs of a gram or more is searched by characters.
    """
    (a, abegin, asize), (b, bbegin, bsize) = _laid(lines, -1), _laid(others, -2)
    code = np.zeros(0x110000, np.int64)
    code[a[a >= 0]] = code[b[b >= 0]] = 1
    width = int(code.sum()) + 2
    code = np.cumsum(code) - 1
    a, b = np.where(a < 0, -1, code[a]), np.where(b < 0, -2, code[b])
    hashed = {3: [np.append((x[:-2] * 961 + x[1:-1] * 31 + x[2:]) % HASHES, [0, 0]) for x in (a, b)], 2: [np.append((x[:-1] * 61 + x[1:]) % HASHES, 0) for x in (a, b)]}
    free, whole = b.copy(), asize[left] + bsize[right]
    out = np.zeros(len(left), np.int64)
    texts = np.argsort(bsize >= POPULAR_FROM, kind="stable")  # those of one kind together
    rank = np.empty_like(texts)
    rank[texts] = np.arange(len(texts))
    pairs = np.argsort(rank[right], kind="stable")
    short = int((bsize < POPULAR_FROM).sum())
    bounds = [*range(0, short, TEXTS), *range(short, len(texts), TEXTS), len(texts)]
    cuts = np.searchsorted(rank[right][pairs], bounds)
    for low, high, start, stop in zip(bounds, bounds[1:], cuts, cuts[1:]):
        p, some, popular = pairs[start:stop], texts[low:high], low >= short
        if not len(p):
            continue
        rects = np.stack([abegin[left[p]], (abegin + asize)[left[p]], bbegin[right[p]], (bbegin + bsize)[right[p]], rank[right[p]] - low, np.arange(len(p))])
        rects = rects[:, (rects[1] > rects[0]) & (rects[3] > rects[2])]
        total = np.zeros(len(p), np.int64)
        for gram in () if popular else hashed:
            rects = _matched(a, b, b, rects, total, hashed[gram][0], _Index(hashed[gram][1], bbegin[some], bsize[some], HASHES), gram, False)
        chars = _Index(b, bbegin[some], bsize[some], width, popular)
        free[chars.left_out] = -2
        _matched(a, b, free, rects, total, a, chars, 1, popular)
        out[p] = total
    return np.where(whole > 0, 2.0 * out / np.maximum(whole, 1), 1.0)
