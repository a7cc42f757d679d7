"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

An item leaks into a document if some run of the document's words is within ``1 - similarity`` (of the item's words) edits of it.
Item-sized windows are embedded by random walks that repeat a word or move on, as a hash of word and step says, which maps edit distance to Hamming
distance. ``repeats`` samples of ``bits`` positions of each of ``walks`` walks are the LSH: a table holds the samples of all items, a window's samples are looked up in it, and the
items found are its candidates. The tests measure recall against brute force with up to 20 % random word edits. The candidates are
verified exactly, by the edit distance of the item to the best substring around the window.

Windows start where one can: an item of m words within t edits keeps a run of at least ceil((m - t) / (t + 1)) words intact, so a window that
leaks holds a gram of that many words (three at most) of some item, as far from its start as the gram is from the item's, but for at most t words. Only such starts are embedded, for the
lengths of the items that have the gram. This loses nothing; it spares the walks over text without any common gram.

The items are the stated query set: they are taken in blocks of at most ``block_bytes`` of text, each sent to all tasks, and all documents are read against each block.
An item longer than a block is a block of its own.

Edge cases: texts or items without words (null, empty) match nothing; items of under five words have to occur exactly; of several windows of a document the one with the fewest edits, then the first, counts;
repeated documents and items each have their rows; very long items and documents are whole (words are held once, windows are ranges of them); empty tables give an empty result; only doc_id, text,
item_id and item text are looked at. drop_leaking judges each row by its own text, whatever its doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packframe.llm.common import table
from packframe.llm.distance import edit_distances
from packframe.llm.units import mix, texts_of, word_hashes

U = np.uint64
GRAM = 3
LEAKS = "doc_id long, item_id long, item_words long, edits long, similarity double, first_word long"
_ARROW = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int64()), ("edits", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64())]


def allowed_edits(m: int, percent: int) -> int:
    return m * (100 - percent) // 100


def intact_run(m: int, t: int) -> int:
    return -(-(m - t) // (t + 1))


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * U(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k])
    return mix(out + U(n))


class Items:
    """Benchmark items as words end to end, their grams, and the table of the samples of their embeddings."""

    def __init__(self, rows: list[tuple[int, str]], percent: int, bits: int, repeats: int, walks: int):
        self.ids, self.words, self.walks = [], [], walks
        for i, text in rows:
            raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
            for _, _, h, _ in word_hashes(raw, np.array([0, len(raw)])):
                if len(h):
                    self.ids.append(i)
                    self.words.append(h)
        self.m = np.array([len(w) for w in self.words], np.int64)
        self.t = np.array([allowed_edits(int(m), percent) for m in self.m], np.int64)
        self.index = {}
        for size in range(1, GRAM + 1):
            found = [(_grams(w, size), i) for i, w in enumerate(self.words) if min(GRAM, intact_run(int(self.m[i]), int(self.t[i]))) == size]
            if found:
                g, i, j = (np.concatenate(x) for x in ([g for g, _ in found], [np.full(len(g), i) for g, i in found], [np.arange(len(g)) for g, _ in found]))
                order = np.argsort(g, kind="stable")
                keys, first, n = np.unique(g[order], return_index=True, return_counts=True)
                self.index[size] = (keys, first, n, i[order], j[order])
        # samples: positions as fractions of the sampled part of a walk
        self.samples = mix(np.arange(1, bits * repeats + 1, dtype=np.uint64)).reshape(repeats, bits)
        if self.words:
            start = np.cumsum(self.m) - self.m
            keys = self.sample_keys(np.concatenate(self.words), start, self.m, start, start + self.m)
            flat, owner = keys.ravel(), np.repeat(np.arange(len(self.m)), keys.shape[1])
            order = np.argsort(flat, kind="stable")
            self.table, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
            self.owner = owner[order]

    def sample_keys(self, words: np.ndarray, start: np.ndarray, m: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """(windows, walks * repeats) keys: each a hash of the words at a sample's positions of a walk, the number of the sample and the window's length.
        Windows are m words from start; those outside [lo, hi) count as a word of their own."""
        out = np.empty((len(start), self.walks * len(self.samples)), np.uint64)
        lengths, which = np.unique(m, return_inverse=True)
        steps = (3 * lengths + 1) // 2
        places = ((self.samples >> U(32))[None] * steps.astype(np.uint64)[:, None, None] >> U(32)).astype(np.int64)  # (length, repeat, bit)
        order, done = np.argsort(which, kind="stable"), 0
        while done < len(order):  # windows of like length together, as many as fit
            upto = done + 1
            while upto < len(order) and (upto - done) * int(steps[which[order[upto]]]) < CELLS:
                upto += min(1024, len(order) - upto)
            some = order[done:upto]
            rows, own = np.arange(len(some))[:, None], which[some]
            for walk in range(self.walks):
                seen = embed(words, start[some], m[some], lo[some], hi[some], walk, int(steps[own].max()))
                acc = mix(np.arange(len(self.samples), dtype=np.uint64)[None] + U(walk * len(self.samples) + 1) + (m[some].astype(np.uint64) << U(32))[:, None])
                for b in range(places.shape[2]):
                    acc = mix(acc * U(0x9E3779B97F4A7C15) + seen[rows, places[own, :, b]])
                out[some, walk * len(self.samples) : (walk + 1) * len(self.samples)] = acc
            done = upto
        return out

    def candidates(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of windows and items that agree in a sample, each pair once."""
        flat = keys.ravel()
        at = np.minimum(np.searchsorted(self.table, flat), len(self.table) - 1)
        hit = np.flatnonzero(self.table[at] == flat)
        at = at[hit]
        many = self.count[at]
        entry = np.repeat(self.first[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        pair = np.unique(np.repeat(hit // keys.shape[1], many) * len(self.m) + self.owner[entry])
        return pair // len(self.m), pair % len(self.m)


CELLS = 1 << 22


def embed(words: np.ndarray, start: np.ndarray, m: np.ndarray, lo: np.ndarray, hi: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """The first steps of a walk over m words from each start: the word at each step (0 past the end, 1 outside [lo, hi)). Of 3 m steps, the first half is sampled,
    in which few walks have ended."""
    place, out = start.copy(), np.empty((len(start), steps), np.uint64)
    end = start + m
    for s in range(steps):
        w = words.take(place, mode="clip")
        w[(place < lo) | (place >= hi)] = 1
        w[place >= end] = 0
        out[:, s] = w
        place += ((w ^ U((s + 1 + (walk << 20)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * U(0xBF58476D1CE4E5B9) >> U(63)).astype(np.int64)
    return out


def find_leaks(items: Items, h: np.ndarray, doc: np.ndarray, first: np.ndarray, past: np.ndarray):
    """Rows (document, item, edits, first word) for words h of documents doc; first, past: each document's range of words."""
    got = []
    for size, (keys, start, n, item, offset) in items.index.items():
        if len(h) < size:
            continue
        g = _grams(h, size)
        k = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        at = np.flatnonzero((keys[k] == g) & (doc[: len(g)] == doc[size - 1 :][: len(g)]))
        for some in np.array_split(at, max(1, -(-int(n[k[at]].sum()) // CELLS))):
            many = n[k[some]]
            entry = np.repeat(start[k[some]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            pos = np.repeat(some, many)
            begin, owner, which = pos - offset[entry], doc[pos], item[entry]
            fits = _inside(items, which, begin, owner, first, past)
            got.append(np.unique(np.column_stack([items.m[which], begin, owner])[fits], axis=0))
    if not sum(map(len, got)):
        return []
    m, begin, owner = np.unique(np.concatenate(got), axis=0).T
    pairs = []
    for lo in range(0, len(m), 1 << 13):
        part = slice(lo, lo + (1 << 13))
        window, which = items.candidates(items.sample_keys(h, begin[part], m[part], first[owner[part]], past[owner[part]]))
        # one check for all starts that are at most the allowed edits apart
        pairs.append(np.column_stack([which, owner[part][window], begin[part][window] // (items.t[which] + 1)]))
    item, owner, cell = np.unique(np.concatenate(pairs), axis=0).T
    if not len(item):
        return []
    t = items.t[item]
    lo, hi = np.maximum(first[owner], cell * (t + 1) - t), np.minimum(past[owner], (cell + 1) * (t + 1) + items.m[item] + t)
    signed = h.view(np.int64)
    edits, end = edit_distances([items.words[i].view(np.int64) for i in item], [signed[a:b] for a, b in zip(lo, hi, strict=True)], inside=True)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for i, o, e, s in zip(item.tolist(), owner.tolist(), edits.tolist(), np.maximum(lo + end - items.m[item] - first[owner], 0).tolist(), strict=True):
        if e <= items.t[i] and (e, s) < best.get((o, i), (1 << 60, 0)):
            best[o, i] = (e, s)
    return [(o, i, e, s) for (o, i), (e, s) in sorted(best.items())]


def _inside(items, item, start, doc, first, past):
    return (start >= first[doc] - items.t[item]) & (start + items.m[item] <= past[doc] + items.t[item])


def _blocks(benchmark: DataFrame, block_bytes: int):
    """The items, shared a block at a time: about block_bytes of text, or one longer item."""
    spark = benchmark.sparkSession
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = total // block_bytes + 1
    for b in range(blocks):
        rows = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).select("item_id", "text").collect()
        yield spark.sparkContext.broadcast(sorted(((r.item_id, r.text) for r in rows), key=str))


def _found(items: Items, column):
    """(row, item, edits, first word) of a column of texts."""
    data, offsets = texts_of(column)
    found = []
    for d, e, h, doc in word_hashes(data, offsets, segment=2_000_000) if items.ids else ():
        past = np.cumsum(np.bincount(doc - d, minlength=e - d))
        found += [(o + d, i, x, s) for o, i, x, s in find_leaks(items, h, doc - d, np.concatenate([[0], past[:-1]]), past)]
    return (np.array(c, np.int64) for c in (zip(*found, strict=True) if found else ((), (), (), ())))


BITS, REPEATS, WALKS = 3, 64, 4  # recall 0.98 or more in the tests


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = 80, bits: int = BITS, repeats: int = REPEATS, walks: int = WALKS, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, item_id, item_words, edits, similarity, first_word for each row of docs and item that leaks into it."""
    out = None
    for shared in _blocks(benchmark, block_bytes):

        def run(batches, shared=shared):
            items = Items(shared.value, percent, bits, repeats, walks)
            for batch in batches:
                o, i, x, s = _found(items, batch.column("text"))
                m = items.m[i] if len(i) else i
                cols = [batch.column("doc_id").take(pa.array(o)), pa.array([items.ids[k] for k in i], pa.int64()), pa.array(m), pa.array(x), pa.array(1 - x / np.maximum(m, 1)), pa.array(s)]
                yield pa.RecordBatch.from_arrays(cols, [name for name, _ in _ARROW])

        one = docs.select("doc_id", "text").mapInArrow(run, LEAKS)
        out = one if out is None else out.unionByName(one)
    return out


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_leaking(docs: DataFrame, benchmark: DataFrame, percent: int = 80, bits: int = BITS, repeats: int = REPEATS, walks: int = WALKS, block_bytes: int = 4 << 20) -> DataFrame:
    """docs without the rows into whose text an item leaks; same columns. Rows pass through the check and are neither moved nor matched by id."""
    for shared in _blocks(benchmark, block_bytes):

        def run(batches, shared=shared):
            items = Items(shared.value, percent, bits, repeats, walks)
            for batch in batches:
                o, *_ = _found(items, batch.column("text"))
                keep = np.ones(len(batch), bool)
                keep[o] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
