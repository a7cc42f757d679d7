"""Plain versions of the training-data operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def words(text, fold=True):
    return WORD.findall((text or "").translate(FOLD) if fold else (text or ""))


def suffix(rows, span=50):
    seen, out = {}, []
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - span + 1):
            seen[b[j : j + span]] = min(seen.get(b[j : j + span], i), i)
    for i, t in rows:
        b = (t or "").encode()
        mask = bytearray(len(b))
        for j in range(len(b) - span + 1):
            if seen[b[j : j + span]] < i:
                mask[j : j + span] = b"\1" * span
        spans = sum(1 for k in range(len(mask)) if mask[k] and (k == 0 or not mask[k - 1]))
        kept = bytes(x for x, y in zip(b, mask) if not y)
        out.append((i, len(b), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


def near(rows, size, percent):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    index, links = defaultdict(list), []
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in index[g])
        links += [(i, j) for j, n in common.items() if 100 * n >= percent * (len(s) + len(sets[j]) - n)]
        for g in s:
            index[g].append(i)
    part = components(len(rows), links)
    least = {}
    for p, (d, _) in zip(part, rows):
        least[p] = min(least.get(p, d), d)
    return sorted((d, len(s), least[p] if s else d) for (d, _), s, p in zip(rows, sets, part))


def lm(rows, strength, prune=2):
    texts, single, pair, context, triple = [], Counter(), Counter(), Counter(), Counter()
    for i, t in rows:
        w, held = [*words(t), "</s>"], zlib.crc32(str(i).encode()) % 7 == 2
        texts.append((i, held, w))
        if not held:
            before = ["<s>", *w]
            single.update(w)
            pair.update(zip(before, w))
            context.update(before[: len(w)])
            triple.update(zip(before, w, w[1:]))
    n, v, out = sum(single.values()), len(single), []
    for i, held, w in texts:
        p = [(single[x] + 1) / (n + v + 1) for x in w]
        q = [pair[a, b] / (context[a] + strength) + strength / (context[a] + strength) * u for a, b, u in zip(["<s>", *w], w, p)]
        for j, (a, b, c) in enumerate(zip(["<s>", *w], w, w[1:]), 1):
            if pair[a, b] >= prune:
                q[j] = triple[a, b, c] / (pair[a, b] + strength) + strength / (pair[a, b] + strength) * q[j]
        out.append((i, held, len(w), sum(single[x] > 0 for x in w), n, sum(map(math.log10, p)), sum(map(math.log10, q))))
    return sorted(out)


def edits(a, b, inside):
    line = [0] * (len(b) + 1) if inside else list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(line[j] + (x != y), line[j + 1] + 1, new[j] + 1))
        line = new
    return min(line) if inside else line[-1]
