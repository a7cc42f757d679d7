"""Edit distances of many pairs of sequences at once."""

from __future__ import annotations

from collections import Counter

import numpy as np

CELLS = 1 << 20


def _padded(seqs: list[np.ndarray], width: int, fill) -> np.ndarray:
    out = np.full((len(seqs), width), fill, np.int64)
    for i, s in enumerate(seqs):
        out[i, : len(s)] = s
    return out


def edit_distances(patterns: list[np.ndarray], texts: list[np.ndarray], inside: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The least number of insertions, deletions and substitutions that make patterns[i] into texts[i], or with inside into any substring of it;
    and the end of that substring (the whole text's end otherwise). Pairs of like length are computed together, a row of all matrices at a time."""
    n = len(patterns)
    m, w = np.array([len(p) for p in patterns], np.int64), np.array([len(t) for t in texts], np.int64)
    best, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.lexsort((w, m))
    at = 0
    while at < n:
        size = max(1, CELLS // (int(w[order[at:]].max(initial=0)) + 1))
        some = order[at : at + size]
        at += size
        rows, cols = int(m[some].max()), int(w[some].max())
        a, b = _padded([patterns[i] for i in some], rows, -1), _padded([texts[i] for i in some], cols, -2)
        steps = np.arange(cols + 1)
        line = np.zeros((len(some), cols + 1), np.int64) if inside else np.broadcast_to(steps, (len(some), cols + 1)).copy()
        beyond = steps[None, :] > w[some][:, None]

        def note(row, line=line, some=some, beyond=beyond):
            done = np.flatnonzero(m[some] == row)
            if len(done):
                final = np.where(beyond[done], np.iinfo(np.int64).max, line[done])
                e = final.argmin(1) if inside else w[some[done]]
                best[some[done]], end[some[done]] = final[np.arange(len(done)), e], e

        note(0)
        for r in range(rows):
            new = np.empty_like(line)
            new[:, 0] = line[:, 0] + 1
            new[:, 1:] = np.minimum(line[:, 1:] + 1, line[:, :-1] + (b != a[:, r : r + 1]))
            line = np.minimum.accumulate(new - steps, axis=1) + steps
            note(r + 1, line)
    return best, end


def _common_start(a: str, b: str) -> int:
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def _banded(p: str, t: str, k: int, span: int = 4096) -> int:
    """The edit distance of p and t (no shorter than p, by at most k) if it is at most k; else some number above k.

    Columns of the distance matrix as bit vectors of vertical differences (Myers 1999), cut to the k + 1 rows at most that k edits can meet: bit x of column j
    is row j - low + x, and a path that leaves the rows between the first and the last cell's diagonals by more than half of what k has beyond their difference doesn't come back in time.
    Cells beyond the band count as one more than their neighbour inside, which no path of k edits needs. The sum follows
    the diagonal that ends at the last cell, on which distances never fall."""
    at = (k - len(t) + len(p)) // 2
    low = len(t) - len(p) + at
    width = low + at + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    vp, vn, score = mask >> (low + 1) << (low + 1), 0, 0  # column 0: rows above 0 rise by one
    for base in range(0, len(t), span):
        # rows that this stretch of columns can meet: pattern positions from base - low on
        lo = base - low
        rows = np.frombuffer(p[max(lo, 0) : base + span + at].encode("utf-32-le", "surrogatepass"), np.uint32)
        eq = {c: int.from_bytes(np.packbits(rows == ord(c), bitorder="little").tobytes(), "little") << max(-lo, 0) for c in set(t[base : base + span])}
        for j, c in enumerate(t[base : base + span]):
            x = eq[c] >> j & mask
            p_, n_ = vp >> 1 | top, vn >> 1
            d = (((x & p_) + p_) ^ p_ | x | n_) & mask
            hp, hn = (n_ | ~(d | p_)) << 1 | 1, (d & p_) << 1
            vp, vn = (hn | ~(d | hp)) & mask, hp & d
            score += not d >> at & 1
            if score > k:
                return score
    return score


def within(a: str, b: str, limit: int) -> bool:
    """Whether at most limit insertions, deletions and substitutions of characters make a into b. Exact; for near copies the time is about that of their length."""
    start = _common_start(a, b)
    a, b = a[start:], b[start:]
    end = _common_start(a[::-1], b[::-1])
    a, b = sorted((a[: len(a) - end], b[: len(b) - end]), key=len)
    if len(b) - len(a) > limit:
        return False
    if not a:
        return True
    # each edit takes at most one character from the surplus on either side
    have, want = Counter(a), Counter(b)
    if max((have - want).total(), (want - have).total()) > limit:
        return False
    k = max(len(b) - len(a), min(limit, 16))
    while (d := _banded(a, b, k)) > k and k < limit:
        k = min(limit, 4 * k)
    return d <= limit


REACH = 6
AHEAD = [(s, d - s) for d in range(1, 2 * REACH + 1) for s in range(max(0, d - REACH), min(d, REACH) + 1)]


def at_most(a: str, b: str, limit: int) -> int:
    """A number of edits that make a into b, not always the least: words are aligned from the left, each time with the nearest equal ones ahead, and what lies between is
    replaced. Beyond limit, or where no word ahead is equal, some number above limit."""
    x, y = a.split(" "), b.split(" ")
    n, m = len(x), len(y)
    x += [None] * REACH  # equal to no word, and to nothing past the end of y
    y += [0] * REACH
    i = j = cost = 0
    while i < n and j < m:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        for s, t in AHEAD:
            if x[i + s] == y[j + t]:
                break
        else:
            s, t = n - i, m - j
        cost += max(sum(map(len, x[i : i + s])) + s, sum(map(len, y[j : j + t])) + t)  # a word and its space
        if cost > limit:
            return cost
        i, j = i + s, j + t
    return cost + max(sum(map(len, x[i:n])) + n - i, sum(map(len, y[j:m])) + m - j)


CLASSES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48)  # 64-bit words of bands that are computed together
FEW = 24  # pairs at least that are worth the steps for all columns


def _together(rows: list[tuple[np.ndarray, np.ndarray, int]], words: int) -> np.ndarray:
    """Whether each pattern (no longer than its text, by at most the limit) is within limit edits of its text. Bands of all pairs as bit vectors of vertical differences,
    a column of all matrices at a time, as in _banded; bit x of column j is row j - low + x. A path that leaves the rows from the last cell's diagonal less half the
    surplus of the limit, to the first cell's and as many more, takes more than limit edits, so a band has limit + 1 rows at least, and words * 64 here.
    Sums on the last cell's diagonal never fall: pairs beyond their limit are dropped on the way. rows: (codes of the pattern, of the text, limit), the longest text first."""
    one, last = np.uint64(1), np.uint64(63)
    m, n, limit = (np.array(x, np.int64) for x in zip(*((len(p), len(t), k) for p, t, k in rows), strict=True))
    half = (limit - n + m) // 2
    low = n - m + half
    flat = np.concatenate([x for r in rows for x in r[:2]])
    names = np.flatnonzero(np.bincount(flat))
    place = np.zeros(int(names[-1]) + 1, np.int64)
    place[names] = np.arange(len(names))
    flat = place[flat]
    row = np.repeat(np.arange(len(rows)), m + n)
    place = np.arange(len(flat)) - (np.cumsum(m + n) - m - n)[row]
    inner = place < m[row]
    width = (int(n[0]) >> 6) + words + 2
    eq = np.zeros(len(rows) * len(names) * width, np.uint64)
    at, r = (place + low[row])[inner], row[inner]
    some = at < width * 64 - 64  # rows beyond the band of the last column
    at, r, c = at[some], r[some], flat[inner][some]
    np.bitwise_or.at(eq, (r * len(names) + c) * width + (at >> 6), one << (at & 63).astype(np.uint64))
    text = np.zeros((int(n[0]), len(rows)), np.int64)
    text[(place - m[row])[~inner], row[~inner]] = (row * len(names) + flat)[~inner] * width
    # column 0: rows above 0 rise by one
    start = np.clip(low + 1 - 64 * np.arange(words)[:, None], 0, 64)
    vp = np.where(start < 64, ~np.uint64(0) << np.minimum(start, 63).astype(np.uint64), np.uint64(0))
    vn = np.zeros_like(vp)
    score, end_word, end_bit, which = np.zeros(len(rows), np.int64), half >> 6, (half & 63).astype(np.uint64), np.arange(len(rows))
    out = np.zeros(len(rows), bool)
    step = np.arange(words + 1)[:, None]
    for j in range(int(n[0])):
        if not j & 31 and j:
            keep = (score <= limit) & (n > j)
            if 4 * np.count_nonzero(keep) < 3 * len(keep):
                out[which[~keep]] = (score <= limit)[~keep]
                n, limit, score, end_word, end_bit, which = (x[keep] for x in (n, limit, score, end_word, end_bit, which))
                text, vp, vn = text[:, keep], vp[:, keep], vn[:, keep]
                if not len(n):
                    return out
        k = int(np.searchsorted(-n, -j, "left"))  # texts longer than j
        bits = eq[text[j, :k] + step + (j >> 6)]
        x = bits[:-1] >> np.uint64(j & 63)
        x |= bits[1:] << one << np.uint64(63 - (j & 63))
        p, v = vp[:, :k] >> one, vn[:, :k] >> one
        p[:-1] |= vp[1:, :k] << last
        p[-1] |= one << last
        v[:-1] |= vn[1:, :k] << last
        d = x & p
        for w in range(words):
            sums = d[w] + p[w]
            over = sums < p[w]
            if w:
                sums += carry
                over |= sums < carry
            d[w], carry = sums, over.astype(np.uint64)
        d ^= p
        d |= x
        d |= v
        hp = ~(d | p)
        hp |= v
        hn = d & p
        up, down = hp << one, hn << one
        up[0] |= one
        up[1:] |= hp[:-1] >> last
        down[1:] |= hn[:-1] >> last
        vp[:, :k] = down | ~(d | up)
        vn[:, :k] = up & d
        score[:k] += (~d[end_word[:k], np.arange(k)] >> end_bit[:k] & one).astype(np.int64)
    out[which] = score <= limit
    return out


def all_within(left: list[str], right: list[str], limits: list[int], long: int = 1 << 14, cells: int = 1 << 21) -> list[bool]:
    """within() for many pairs: near copies are seen word by word, as long as at least half of the pairs are; what is left of the others, if they are short, is computed
    together after their common start and end."""
    out: list[bool | None] = [None] * len(left)
    rest: dict[int, list[tuple[int, str, str, int]]] = {}
    tried = seen = 0
    for i, (a, b, limit) in enumerate(zip(left, right, limits, strict=True)):
        start = _common_start(a, b)
        x, y = a[start:], b[start:]
        end = _common_start(x[::-1], y[::-1])
        x, y = sorted((x[: len(x) - end], y[: len(y) - end]), key=len)
        if len(y) <= limit or len(y) - len(x) > limit or not x:
            out[i] = len(y) <= limit  # y is the longer one: so many substitutions and insertions do
            continue
        if 2 * seen >= tried - 64:
            tried += 1
            if at_most(x, y, limit) <= limit:
                seen += 1
                out[i] = True
                continue
        words = (limit >> 6) + 1
        if len(y) > long or words > CLASSES[-1]:
            out[i] = within(a, b, limit)
        else:
            rest.setdefault(next(c for c in CLASSES if c >= words), []).append((i, x, y, limit))
    for words, some in sorted(rest.items()):
        some.sort(key=lambda r: -len(r[2]))
        at = 0
        while at < len(some):
            n = len(some[at][2])
            part = some[at : at + min(4096, cells // n + 1)]
            if len(part) < FEW or FEW * (n - len(part[1][2])) > n:  # a few, or one much longer than the next
                part = part[: FEW if len(part) < FEW else 1]
                got = [within(left[i], right[i], limits[i]) for i, *_ in part]
            else:
                rows = [(*(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in r[1:3]), r[3]) for r in part]
                names = np.count_nonzero(np.bincount(np.concatenate([x for r in rows for x in r[:2]])))
                part = part[: cells // (((n >> 6) + words + 2) * names) + 1]
                got = _together(rows[: len(part)], words).tolist()
            for (i, *_), good in zip(part, got, strict=True):
                out[i] = good
            at += len(part)
    return out
