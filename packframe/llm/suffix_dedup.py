"""Exact substring dedup by a hash-compared suffix sort.

A byte goes if a ``SPAN``-byte string that covers it also starts in a document with a smaller doc_id. Two rounds of the unit
exchange (see units.py) find, for every such string, the smallest doc_id that has it:

1. Every window of SPAN bytes has a minimiser: the K-gram in it with the least hash. Consecutive windows with the same minimiser form a slice.
   Equal windows have equal minimisers, so a window can repeat elsewhere only if its minimiser does. Units send their distinct
   minimisers' hashes; buckets answer which occur in a second document (1), and which stand in so many different slices that their windows must be split (2).
2. Units send the distinct slices whose minimisers repeat, each with the smallest doc_id that has it. A bucket sorts the suffixes
   that start in its slices: mergesort, in which two suffixes are compared by the prefix polynomial hashes of the bytes that follow, with a binary
   search for their common extension. Suffixes are sorted among those with the same minimiser at the same distance, all others being different already.
   Neighbours whose common extension is SPAN are one string; their bytes are compared, so a hash collision is found (the bucket is then
   sorted by its bytes). The answer is the smallest doc_id for each window of each slice.

Windows of widespread minimisers (over WIDE slices, and over EACH for each unit that has them) are sent one by one and dealt by their own hash, so a passage that a third of all
documents have in different surroundings doesn't meet in one bucket. Such a window is a slice of its own: equal ones are merged by hash and bytes as
all equal slices are, and since no other window shares their key there is nothing left to sort. Results are the same by either way (tested).

A unit has MOST MB of the input's files at most, and the bytes of slices are laid out ROWS at a time, in units and (some whole families of a minimiser at a
time) in buckets: what a task holds is some tens of bytes for each byte of a unit.

Edge cases: null and empty texts have no bytes; texts under SPAN bytes lose nothing; rows with equal doc_id don't count against each other; a null
doc_id counts as the largest; very long texts are handled in segments; an empty table gives an empty result; other columns aren't looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from packframe.llm.common import table
from packframe.llm.units import MESSAGE, Unit, answer, bucket_of, messages, mix, pack, slices, unit_table, unpack

SPAN, K = 50, 26
W = SPAN - K + 1
SEG = 1 << 18
ROWS = 1 << 14  # slices whose bytes are laid out at a time
MOST = 12.0  # MB of a unit at most: two tasks of an executor hold one each
BITS = 48
WIDE, EACH = 4096, 4  # a minimiser with more slices than WIDE, and than EACH for each unit that has it, is dealt window by window
WIDTH = SPAN + W - 1  # bytes of the longest slice
BASE = 0x9E3779B97F4A7C15 | 1
U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        done = 1
        while done < n:
            step = min(done, n - done)
            out[done : done + step] = out[:step] * U(pow(base, done, 1 << 64))
            done += step
    return out


_POW, _INV = _powers(BASE, SEG + 256), _powers(pow(BASE, -1, 1 << 64), SEG + 256)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of (byte + 1) * BASE**j for j < i, modulo 2**64, for at most SEG + 255 bytes."""
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * _POW[: len(data)], out=p[1:])
    return p


def _windowed_min(x: np.ndarray, w: int) -> np.ndarray:
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if w > have else x


def slices_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser (48 bits) of each slice; no slice leaves its document."""
    first, count, key = [], [], []
    n = len(data)
    for s in range(0, max(0, n - SPAN + 1), SEG):
        e = min(n - SPAN + 1, s + SEG)
        p = prefix_hashes(data[s : e + SPAN - 1])
        m = len(p) - K
        h = mix((p[K:] - p[:-K]) * _INV[:m]) >> U(64 - BITS)
        tagged = (h >> U(4) << U(20)) | np.arange(m, dtype=np.uint64)
        least = _windowed_min(tagged, W)
        ends = offsets[np.searchsorted(offsets, s, "right") : np.searchsorted(offsets, e + SPAN, "left")] - s
        bad = np.zeros(e - s + 1, np.int32)
        np.add.at(bad, np.clip(ends - SPAN + 1, 0, e - s), 1)
        np.add.at(bad, np.clip(ends, 0, e - s), -1)
        code = np.where(np.cumsum(bad[:-1]) > 0, ~U(0), least)
        edge = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        size = np.diff(np.append(edge, len(code)))
        good = code[edge] != ~U(0)
        edge, size = edge[good], size[good]
        first.append(edge + s)
        count.append(size)
        key.append(mix(h[(code[edge] & U((1 << 20) - 1)).astype(np.int64)]) >> U(64 - BITS))  # mixed anew: minima are small
    none = np.zeros(0, np.int64)
    return np.concatenate(first or [none]), np.concatenate(count or [none]), np.concatenate(key or [none.astype(np.uint64)])


def _six(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :6].ravel()


def _eight(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.view(np.uint64).ravel()


class Cut:
    """A unit cut into slices, and its distinct minimisers."""

    def __init__(self, rows: pa.Table):
        self.unit = u = Unit(rows)
        self.text = np.concatenate([u.data, np.zeros(WIDTH, np.uint8)])  # any slice may be read to its greatest width
        u.data = self.text[:-WIDTH]
        self.first, self.count, self.key = slices_of(u.data, u.offsets)
        self.doc = np.searchsorted(u.offsets, self.first, "right") - 1
        self.keys, self.which = np.unique(self.key, return_inverse=True)

    def shared_inside(self) -> np.ndarray:
        """For each distinct minimiser, whether two documents of the unit have it."""
        low = np.full(len(self.keys), np.iinfo(np.int64).max)
        high = np.full(len(self.keys), np.iinfo(np.int64).min)
        ids = self.unit.ids[self.doc]
        np.minimum.at(low, self.which, ids)
        np.maximum.at(high, self.which, ids)
        return low < high

    def kinds(self) -> np.ndarray:
        """For each distinct minimiser, how many different slices have it (a count of occurrences where they are EACH or fewer), 255 at most."""
        n = np.bincount(self.which, minlength=len(self.keys))
        many = np.flatnonzero(n[self.which] > EACH)
        if len(many):
            own = _slice_hashes(self.text, self.first[many], self.count[many])
            pairs = np.unique(np.stack([self.which[many].astype(np.uint64), own], 1), axis=0)[:, 0].astype(np.int64)
            which, kinds = np.unique(pairs, return_counts=True)
            n[which] = kinds
        return np.minimum(n, 255).astype(np.uint8)

    def items(self, codes: np.ndarray, buckets: int):
        """The distinct strings to send, by bucket, and where each occurs: (an occurrence's first window, number of windows, keys, smallest
        doc_ids, buckets), (window positions, number of windows, item) of each occurrence."""
        u = self.unit
        code = codes[self.which]
        take = np.flatnonzero(code == 1)
        first, count, key = self.first[take], self.count[take], self.key[take]
        wide = np.flatnonzero(code == 2)
        if len(wide):
            # one occurrence a window
            reps = self.count[wide]
            at = np.repeat(self.first[wide] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
            one = np.ones(len(at), np.int64)
            first, count, key = np.concatenate([first, at]), np.concatenate([count, one]), np.concatenate([key, _slice_hashes(self.text, at, one)])
        if not len(first):
            none = np.zeros(0, np.int64)
            return (none, none, none.astype(np.uint64), none, none), (none, none, none)
        # distinct strings: by hash, checked by their bytes; whatever differs from its hash's first stays an item of its own
        digest = _slice_hashes(self.text, first, count) ^ (key * C)
        _, rep, item = np.unique(digest, return_index=True, return_inverse=True)
        del digest
        odd = []
        for lo in range(0, len(first), ROWS):
            mine = rep[item[lo : lo + ROWS]]
            odd.append(np.flatnonzero((_rows(self.text, first[lo : lo + ROWS], count[lo : lo + ROWS]) != _rows(self.text, first[mine], count[mine])).any(1)) + lo)
        odd = np.concatenate(odd)
        if len(odd):
            item[odd] = len(rep) + np.arange(len(odd))
            rep = np.concatenate([rep, odd])
        least = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(least, item, u.ids[np.searchsorted(u.offsets, first, "right") - 1])
        bucket = bucket_of(key[rep], BITS, buckets)
        order = np.lexsort((key[rep], bucket))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        rep = rep[order]
        return (first[rep], count[rep], key[rep], least[order], bucket[order]), (first, count, back[item])


C = U(0xD6E8FEB86659FD93)
_COEF = mix(np.arange(1, WIDTH + 2, dtype=np.uint64))


def _rows(text: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """WIDTH bytes from each start, zero after its slice, and the number of windows. The text has WIDTH bytes more than its documents."""
    every, cols, out = np.lib.stride_tricks.sliding_window_view(text, WIDTH), np.arange(WIDTH, dtype=np.uint8), np.empty((len(first), WIDTH + 1), np.uint8)
    for lo in range(0, len(first), ROWS):
        own, n = out[lo : lo + ROWS], count[lo : lo + ROWS].astype(np.uint8)
        np.multiply(every[first[lo : lo + ROWS]], cols < (n + np.uint8(SPAN - 1))[:, None], out=own[:, :WIDTH])
        own[:, WIDTH] = n
    return out


def _slice_hashes(text: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    out = np.empty(len(first), np.uint64)
    for lo in range(0, len(first), ROWS):
        out[lo : lo + ROWS] = _row_hash(_rows(text, first[lo : lo + ROWS], count[lo : lo + ROWS]))
    return out


def _row_hash(rows: np.ndarray) -> np.ndarray:
    """48 bits of a hash of each row."""
    acc = np.zeros(len(rows), np.uint64)
    for c in range(rows.shape[1]):
        acc += (rows[:, c].astype(np.uint64) + U(1)) * _COEF[c]
    return mix(acc) >> U(64 - BITS)


# ---- round 1


def _send_keys(buckets: int):
    def run(key, rows):
        unit, c = key[0].as_py(), Cut(rows)
        multi, kinds = c.shared_inside(), c.kinds()
        return messages([(b, unit, 0, pack(_six(c.keys[lo:hi]), np.packbits(multi[lo:hi]), kinds[lo:hi])) for b, lo, hi in slices(bucket_of(c.keys, BITS, buckets), buckets)])

    return run


def _reply_keys(got):
    parts = [(u, *unpack(m)) for u, _, m in got]
    keys = [_eight(k) for _, k, *_ in parts]
    multi = [np.unpackbits(b, count=len(k)).astype(bool) for k, (_, _, b, _) in zip(keys, parts, strict=True)]
    every, which, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    shared = n > 1
    shared[which[np.concatenate(multi)]] = True
    kinds = np.bincount(which, np.concatenate([x for *_, x in parts]), len(every))
    code = np.where((kinds > WIDE) & (kinds > EACH * n), 2, shared.astype(np.uint8)).astype(np.uint8)[which]
    at = 0
    for (u, *_), k in zip(parts, keys, strict=True):
        yield u, 1, pack(code[at : at + len(k)])
        at += len(k)


def _codes(answers: list[tuple[int, bytes]]) -> np.ndarray:
    return np.concatenate([unpack(m)[0] for _, m in sorted(answers)] or [np.zeros(0, np.uint8)])


# ---- round 2


def _send_items(buckets: int):
    def run(key, rows, told):
        if not len(rows):
            return messages([])
        unit, c = key[0].as_py(), Cut(rows)
        codes = _codes(list(zip(told["bucket"].to_pylist(), told["message"].to_pylist(), strict=True)))
        (first, count, keys, least, bucket), _ = c.items(codes, buckets)
        out = [(b, unit, 2, pack(_rows(c.text, first[lo:hi], count[lo:hi]).ravel(), _six(keys[lo:hi]), least[lo:hi])) for b, lo, hi in slices(bucket, buckets)]
        return messages([*out, (unit % buckets, unit, 1, pack(codes))])  # the codes come back with the answers

    return run


WIDTH_PAD = WIDTH + 1


def _extension(p: np.ndarray, turn: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common extension of the suffixes at a and b, at most SPAN: a binary search over prefix hashes p; turn takes a hash to position 0."""
    n = np.zeros(len(a), np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        i, j = a + n, b + n
        same = (p.take(i + step) - p.take(i)) * turn.take(i) == (p.take(j + step) - p.take(j)) * turn.take(j)
        n += step * (same & (n + step <= SPAN))
    return n


def sort_suffixes(strings: np.ndarray, group: np.ndarray, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes (row, col) of strings by group (ascending already) and then by their first SPAN bytes, and for each but the first
    in that order whether it equals the one before. Bottom-up mergesort within the groups, hash comparisons, then a check of the bytes."""
    text = strings[:, :WIDTH]
    inner = np.zeros((len(text), WIDTH + 1), np.uint64)
    np.cumsum((text.astype(np.uint64) + U(1)) * _POW[:WIDTH], axis=1, out=inner[:, 1:])
    # past the end of the last string, for extensions that are looked at but not taken
    p, turn, at = np.concatenate([inner.ravel(), np.zeros(SPAN, np.uint64)]), np.resize(_INV[:WIDTH_PAD], inner.size + SPAN), row * WIDTH_PAD + col
    flat = np.zeros((len(text), WIDTH_PAD), np.uint8)
    flat[:, :WIDTH] = text
    flat = flat.ravel()

    def compare(a, b):
        """-1, 0 or 1 for the suffixes at a and b."""
        n = _extension(p, turn, a, b)
        end = n >= SPAN
        n = np.where(end, 0, n)
        return np.where(end, 0, np.sign(flat[a + n].astype(np.int16) - flat[b + n].astype(np.int16)))

    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(group)))
    begin, many = np.repeat(start, size), np.repeat(size, size)
    order = np.arange(len(group))
    place = order - begin
    width = 1
    while len(size) and width < size.max():
        live = np.flatnonzero(many > width)
        q, g = place[live], begin[live]
        run = q // width
        left = run % 2 == 0
        lo = g + np.where(left, run + 1, run - 1) * width
        lo0 = np.minimum(lo, g + many[live])
        hi = np.minimum(lo + width, g + many[live])
        lo, hi = lo0.copy(), np.maximum(hi, lo0)
        mine = at[order[live]]
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            c = compare(at[order[mid]], mine[open_])
            after = (c < 0) | ((c == 0) & ~left[open_])
            lo[open_] = np.where(after, mid + 1, lo[open_])
            hi[open_] = np.where(after, hi[open_], mid)
        pair = g + (run // 2) * 2 * width
        target = pair + (q - run * width) + (lo - lo0)
        moved = order.copy()
        moved[target] = order[live]
        order = moved
        width *= 2
    a, b = at[order[:-1]], at[order[1:]]
    together = group[order[:-1]] == group[order[1:]] if len(order) else np.zeros(0, bool)
    c = compare(a, b)
    same = together & (c == 0)
    checked = flat[a[together][:, None] + np.arange(SPAN)], flat[b[together][:, None] + np.arange(SPAN)]
    differ = checked[0] != checked[1]
    where = differ.argmax(1)
    true = np.where(differ.any(1), np.sign(checked[0][np.arange(len(where)), where].astype(np.int16) - checked[1][np.arange(len(where)), where].astype(np.int16)), 0)
    if (true > 0).any() or ((true == 0) != same[together]).any():  # a collision misled a comparison
        raw = [flat[i : i + SPAN].tobytes() for i in at]
        order = np.array(sorted(range(len(at)), key=lambda i: (group[i], raw[i])), np.int64)
        same = np.array([group[i] == group[j] and raw[i] == raw[j] for i, j in zip(order[:-1], order[1:], strict=True)], bool)
    return order, same


def _reply_items(got):
    parts = [(u, *unpack(m)) for u, k, m in got if k == 2]
    for u, k, m in got:
        if k == 1:
            yield u, 1, m
    if not parts:
        return
    units, sizes = [u for u, *_ in parts], [len(least) for *_, least in parts]
    strings = np.concatenate([s for _, s, _, _ in parts]).reshape(-1, WIDTH + 1)
    keys = np.concatenate([_eight(k) for _, _, k, _ in parts])
    least = np.concatenate([x for *_, x in parts])
    del parts
    windows = strings[:, WIDTH].astype(np.int64)
    best, start = _least_of_slices(strings, keys, least)
    at = 0
    for u, n in zip(units, sizes, strict=True):
        yield u, 2, pack(best[_runs(start[at : at + n], windows[at : at + n])])
        at += n


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, size of them, end to end."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def windowed_least(strings: np.ndarray, keys: np.ndarray, least: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """For each window of each slice, the smallest doc_id that has it."""
    best, start = _least_of_slices(strings, keys, least)
    return best[_runs(start, windows)]


def _least_of_slices(strings: np.ndarray, keys: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest doc_id that has a window, for all windows of the distinct slices; and where each slice's windows start there."""
    # equal slices of different units first: one row each
    digest = np.concatenate([_row_hash(strings[lo : lo + ROWS]) for lo in range(0, len(strings), ROWS)])
    order = np.lexsort((digest, keys))
    k, new = keys[order], np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (digest[order[1:]] != digest[order[:-1]])
    alike = np.flatnonzero(~new)
    for lo in range(0, len(alike), ROWS):
        i = alike[lo : lo + ROWS]
        new[i] = (strings[order[i]] != strings[order[i - 1]]).any(1)
    rep = np.flatnonzero(new)
    slot = np.empty(len(order), np.int64)
    slot[order] = np.cumsum(new) - 1
    low = np.minimum.reduceat(least[order], rep)
    k, rep = k[rep], order[rep]
    n = strings[rep, WIDTH].astype(np.int64)
    start = np.cumsum(n) - n
    out = np.repeat(low, n)
    # slices that share their minimiser with another one, some whole families at a time
    head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    size = np.diff(np.append(head, len(k)))
    head, size = head[size > 1], size[size > 1]
    ends = np.cumsum(size)
    done = 0
    while done < len(head):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + ROWS, "right")))
        busy = _runs(head[done:upto], size[done:upto])
        family = np.repeat(np.arange(upto - done), size[done:upto])
        done = upto
        s, many = strings[rep[busy]], n[busy]
        row, col = np.repeat(np.arange(len(busy)), many), _runs(np.zeros(len(busy), np.int64), many)
        # where the minimiser stands in the slice: windows can be equal only with it at the same distance
        sub = family[row] * (WIDTH + 1) + _minimiser_at(s)[row] - col
        by = np.argsort(sub, kind="stable")
        row, col, sub = row[by], col[by], sub[by]
        by, same = sort_suffixes(s, sub, row, col)
        turn = np.concatenate([[True], ~same])
        own = busy[row[by]]
        mins = np.minimum.reduceat(low[own], np.flatnonzero(turn))
        out[start[own] + col[by]] = mins[np.cumsum(turn) - 1]
    return out, start[slot]


def _minimiser_at(strings: np.ndarray) -> np.ndarray:
    """Position of the leftmost minimiser of each slice's first window. All windows of a slice have the same one."""
    p = np.zeros((len(strings), SPAN + 1), np.uint64)
    np.cumsum((strings[:, :SPAN].astype(np.uint64) + U(1)) * _POW[:SPAN], axis=1, out=p[:, 1:])
    h = mix((p[:, K:] - p[:, :-K]) * _INV[: SPAN - K + 1]) >> U(64 - BITS)
    return (h >> U(4)).argmin(1)


# ---- the result


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:bigint,hi:bigint>>"


def _finish(buckets: int, with_text: bool):
    def run(key, rows, told):
        if not len(rows):
            return pa.table({n: pa.array([], t) for n, t in _RESULT_ARROW})
        c = Cut(rows)
        u = c.unit
        back = list(zip(told["kind"].to_pylist(), told["bucket"].to_pylist(), told["message"].to_pylist(), strict=True))
        codes = np.concatenate([unpack(m)[0] for k, _, m in back if k == 1] or [np.zeros(0, np.uint8)])
        (_, n, *_), (first, count, item) = c.items(codes, buckets)
        best, filled = np.empty(n.sum(), np.int64), 0
        for k, _, m in sorted(back):
            if k == 2:
                (got,) = unpack(m)
                best[filled : filled + len(got)] = got
                filled += len(got)
        if filled != len(best):
            raise RuntimeError(f"{filled} answers for {len(best)} windows")
        base = np.cumsum(n) - n
        edge = np.zeros(len(u.data) + SPAN + 1, np.int8)  # a window occurs once, and at most SPAN cover a byte
        for lo in range(0, len(first), ROWS):
            own = count[lo : lo + ROWS]
            at = _runs(first[lo : lo + ROWS], own)
            at = at[best[_runs(base[item[lo : lo + ROWS]], own)] < u.ids[np.searchsorted(u.offsets, at, "right") - 1]]
            edge[at] += 1
            edge[at + SPAN] -= 1
        covered = np.cumsum(edge, dtype=np.int8)[: len(u.data)] > 0
        ids, size, removed, spans, digest, where = u.doc_ids(), [], [], [], [], []
        for lo, hi in zip(u.offsets[:-1], u.offsets[1:], strict=True):
            mask = covered[lo:hi]
            size.append(int(hi - lo))
            removed.append(int(mask.sum()))
            turn = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))) if removed[-1] else np.zeros(0, np.int64)
            spans.append(len(turn) // 2)
            where.append([{"lo": int(a), "hi": int(b)} for a, b in turn.reshape(-1, 2)])
            digest.append(hashlib.sha256(u.data[lo:hi][~mask].tobytes() if removed[-1] else u.data[lo:hi].tobytes()).hexdigest())
        return pa.table({n: v if isinstance(v, pa.Array) else pa.array(v, t) for (n, t), v in zip(_RESULT_ARROW, (ids, size, removed, spans, digest, where), strict=True)})

    return run


_RESULT_ARROW = (
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
    ("spans", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))),
)


def dedup_substrings(docs: DataFrame, mb: float = 6.0) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte ranges, for each row of docs."""
    units, buckets = unit_table(docs, mb, MOST)
    by_unit = units.groupBy("unit")
    codes = answer(by_unit.applyInArrow(_send_keys(buckets), MESSAGE), _reply_keys)
    items = by_unit.cogroup(codes.groupBy("unit")).applyInArrow(_send_items(buckets), MESSAGE)
    found = answer(items, _reply_items)
    return by_unit.cogroup(found.groupBy("unit")).applyInArrow(_finish(buckets, False), RESULT)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).drop("spans")


OP1_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS k, encode(coalesce(text, '')) AS t, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, k, pos, array_slice(t, pos + 1, pos + 50) AS s FROM (SELECT r, k, t, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS pos FROM d)),
m AS (SELECT s, min(k) AS least FROM w GROUP BY s HAVING count(*) > 1),
hit AS (SELECT r, pos FROM w JOIN m USING (s) WHERE least < k),
b AS (SELECT r, unnest(range(0, length(h) // 2)) AS pos, unnest(regexp_extract_all(h, '..')) AS x FROM d),
c AS (SELECT b.r, b.pos, b.x, max(CASE WHEN hit.pos IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY b.r ORDER BY b.pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM b LEFT JOIN hit USING (r, pos)),
e AS (SELECT *, CASE WHEN gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY r ORDER BY pos), 0) = 0 THEN 1 ELSE 0 END AS begins FROM c)
SELECT any_value(d.doc_id) AS doc_id, (any_value(length(h)) // 2)::BIGINT AS n_bytes, coalesce(sum(gone), 0)::BIGINT AS n_removed, coalesce(sum(begins), 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(string_agg(x, '' ORDER BY pos) FILTER (gone = 0), ''))) AS kept_sha256
FROM d LEFT JOIN e USING (r) GROUP BY r"""
