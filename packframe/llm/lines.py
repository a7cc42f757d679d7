"""Fuzzy line dedup: SimHash, pigeonhole blocks, edit verification, one occurrence for each connected group.

A line is normalised (A-Z to a-z, digits to 0, ASCII punctuation to spaces) and takes part if it has at least ``min_words`` words. Its SimHash has 64 bits, voted
by its distinct words (a frequent word counts once, so unrelated lines stay apart); a second one has 64 bits voted by its word pairs. Lines are candidates if their
SimHashes differ in under ``limit`` bits, the second ones in under ``second``, and their lengths allow the similarity. SimHashes that differ in under ``limit`` bits are
within the radius of one of ``blocks`` blocks, by the pigeonhole principle, and there agree in one part of the block: lines are dealt to buckets by the values of such
parts, and a bucket finds the pairs within the block's radius. All distinct lines are dealt, so those of equal SimHashes are compared with each other and with every
near SimHash's. Candidates are verified: the edit distance of the normalised lines must be at most 20 % of the longer one. Of each connected group the first
occurrence stays (by doc_id, then the text's hash, then line); every other line goes. Pairs that are 80 % alike beyond the two limits are missed.

Candidates are verified in two rounds, so that m lines close to each other don't make m squared pairs: first each line against two partners (the one with the
least hash, so a group's lines meet the same partner, and the nearest by its SimHashes); then, among lines that have a partner, every candidate pair that isn't connected yet. Equal lines are one from the start
(aggregated before the shuffle). Rows of hot lines (over 1/1024 of all lines each) are answered by a broadcast of those lines, 1024 at most, and aren't shuffled.

A row of docs is known by a number of its own, so rows that share a doc_id, or have none, have each their own lines.

Edge cases: null and empty texts have no lines; short lines stay; rows with equal doc_id compete by text hash, then row; a null doc_id comes last; equal rows are rows of their
own, of which one keeps the line; very long lines are whole; an empty table gives an empty result; other columns aren't looked at, and drop_lines returns them as they are.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packframe.llm.common import cut, join_hot, parts, sieve, table
from packframe.llm.distance import all_within
from packframe.llm.graph import components
from packframe.llm.units import mix, pack, slices, texts_of, unpack, word_hashes

U = np.uint64
LAST = np.iinfo(np.int64).max
LIMIT, SECOND = 12, 22  # 93 % of pairs that are 80 % alike differ in fewer bits (measured on sf0.1)
STEPS = 4
PAIRS = 1 << 15  # checked at a time; their arrays stay in the cache
DIRECT = 8  # partners of a value that are compared without a list of pairs
SEGMENT = 1 << 17  # bytes of text hashed at a time, as above


def _normal_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[48:58] = 48
    for c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
        t[c] = 32
    return t


NORMAL = _normal_table()
SILENT = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32, *range(0x80, 0xC0)])  # spaces, and bytes after a character's first


def normal_words(line: str) -> list[bytes]:
    return NORMAL[np.frombuffer(line.encode("utf-8", "surrogatepass"), np.uint8)].tobytes().split()


_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()  # the bits of a byte, a byte each
LANE = 255


def _distinct(h: np.ndarray, line: np.ndarray) -> np.ndarray:
    """One word of each kind of a line."""
    key = mix(h ^ (line.astype(np.uint64) + U(1)) * U(0x9E3779B97F4A7C15))
    order = np.argsort(key)  # which of equal words comes first makes no difference
    key = key[order]
    out = np.ones(len(key), bool)
    out[order[1:][key[1:] == key[:-1]]] = False
    return out


def simhash(features: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Majority of the features' bits for each run that starts at head. Votes are counted in bytes, eight to a word, over runs of at most 255."""
    size = np.diff(np.append(head, len(features)))
    pieces = -(-size // LANE)
    first = np.cumsum(pieces) - pieces
    at = np.repeat(head, pieces) + (np.arange(pieces.sum()) - np.repeat(first, pieces)) * LANE
    votes = np.empty((len(at), 8), np.uint64)
    raw = np.ascontiguousarray(features.view(np.uint8).reshape(-1, 8).T)
    for c in range(8):
        votes[:, c] = np.add.reduceat(_LANES[raw[c]], at)
    count, half = votes.view(np.uint8), size >> 1
    if len(at) > len(head):
        count = np.add.reduceat(count, first, axis=0, dtype=np.int32)
    else:
        half = half.astype(np.uint8)
    return np.packbits(count > half[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def line_hashes(data: np.ndarray, offsets: np.ndarray, min_words: int):
    """(document, line number, hash, SimHash) of the lines that take part, each document's number of lines, the lines' lengths in characters and their second SimHashes."""
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, breaks, "right") - 1
    n_lines = np.bincount(owner, minlength=len(offsets) - 1) + (np.diff(offsets) > 0)
    starts = np.sort(np.concatenate([offsets[:-1][np.diff(offsets) > 0], (breaks + 1)[breaks + 1 < offsets[owner + 1]]]))
    edges = np.append(starts, len(data))
    plain = np.frombuffer(data.tobytes().translate(NORMAL.tobytes()), np.uint8)
    chars = edges - np.searchsorted(np.flatnonzero(np.frombuffer(plain.tobytes().translate(SILENT.tobytes()), bool)), edges)  # before each edge
    out = []
    for d, e, h, line in word_hashes(plain, edges, fold=False, segment=SEGMENT) if len(starts) else ():
        size = np.bincount(line - d, minlength=e - d)
        many = np.flatnonzero(size >= min_words)
        if not len(many):
            continue
        keep = np.repeat(size >= min_words, size)
        h, line, size = h[keep], line[keep], size[many]
        head = np.cumsum(size) - size
        own = mix(np.add.reduceat(mix(h + (np.arange(len(h)) - np.repeat(head, size)).astype(np.uint64) * U(0x9E3779B97F4A7C15)), head) + size.astype(np.uint64))
        pairs = np.append(mix(h[:-1] * U(0xD6E8FEB86659FD93) + h[1:]), U(0))
        pairs[head + size - 1] = h[head + size - 1]  # the last word has no pair
        kinds = _distinct(h, line)
        words = np.cumsum(kinds)[head + size - 1]
        out.append((line[head], own, simhash(h[kinds], np.concatenate([[0], words[:-1]])), size, simhash(pairs, head)))
    which, own, sim, size, more = (np.concatenate([o[i] for o in out] or [np.zeros(0, t)]) for i, t in enumerate((np.int64, U, U, np.int64, U)))
    doc = np.searchsorted(offsets, starts[which], "right") - 1
    first = np.searchsorted(breaks, offsets[:-1], "left")
    return doc, np.searchsorted(breaks, starts[which], "left") - first[doc], own, sim, n_lines, chars[which + 1] - chars[which] + size - 1, more


SCAN = "row long, doc_id long, key long, number int, hash long, sim long, length int, more long"


def _scan(min_words: int):
    """A row for each line that takes part, and one for each document, whose number is - 1 - its number of lines."""

    def run(batches):
        for batch in (part for whole in batches for part in _some_mb(whole)):
            data, offsets = texts_of(batch.column("text"))
            doc, number, own, sim, n, length, more = line_hashes(data, offsets, min_words)
            none = np.zeros(len(n), np.int64)
            take = pa.array(np.concatenate([np.arange(len(n)), doc]))
            cols = [np.concatenate(x) for x in ((-1 - n, number), (none, own.view(np.int64)), (none, sim.view(np.int64)), (none, length), (none, more.view(np.int64)))]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("row", "doc_id", "key")), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [x.split()[0] for x in SCAN.split(", ")])

    return run


def _some_mb(batch: pa.RecordBatch, size: int = 4 << 20, column: str = "text"):
    """The batch in slices of about size bytes of text, for the arrays over all bytes to stay small."""
    _, offsets = texts_of(batch.column(column))
    lo = 0
    while lo < len(batch):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _block(sim: np.ndarray, lo: int, hi: int) -> np.ndarray:
    return sim >> U(lo) & U((1 << (hi - lo)) - 1)


def _spans(blocks: int, limit: int) -> list[tuple[int, int, int, list[tuple[int, int]]]]:
    """(first bit, past the last, radius, parts) of each block. Radii plus one add up to limit, so SimHashes that differ in under limit bits have a block
    within its radius; a block has one part more than its radius, so two values within it agree in a part."""
    out = []
    for k in range(blocks):
        lo, hi, n = 64 * k // blocks, 64 * (k + 1) // blocks, (limit + blocks - 1 - k) // blocks
        out.append((lo, hi, n - 1, [(lo + (hi - lo) * j // n, lo + (hi - lo) * (j + 1) // n) for j in range(n)]))
    return out


@cache
def _masks(lo: int, hi: int, radius: int, parts_: tuple[tuple[int, int], ...], j: int) -> list[int]:
    """Differences of two values of a block, within its radius, whose first part without a difference is j."""
    found = [sum(1 << (b - lo) for b in bits) for n in range(radius + 1) for bits in combinations(range(lo, hi), n)]
    hit = lambda m, x: m >> (x[0] - lo) & ((1 << (x[1] - x[0])) - 1)
    return [m for m in found if not hit(m, parts_[j]) and all(hit(m, x) for x in parts_[:j])]


def near_pairs(sim: np.ndarray, length: np.ndarray, k: int, j: int, blocks: int, limit: int, percent: int):
    """Yield index arrays of pairs whose SimHashes differ in under limit bits, and whose lengths allow percent: those for which block k is the first within
    its radius and part j the first of it that agrees. So all (k, j) together yield each pair once."""
    spans = _spans(blocks, limit)
    lo, hi, radius, parts_ = spans[k]
    # finer length classes than percent: a partner is in the line's class or one of STEPS before or after it, or one more by rounding
    length = length.astype(np.int64)
    kind = np.floor(np.log(np.maximum(length, 1)) * (STEPS / np.log(100 / max(1, min(percent, 99))))).astype(np.int64)
    if len(kind):  # the shortest and the longest few are one class each, for a small table
        least, most = np.partition(kind, (few := len(kind) // 64, len(kind) - 1 - few))[[few, len(kind) - 1 - few]]
        kind = np.clip(kind, least, most) - least
    kinds = int(kind.max(initial=0)) + 1
    value = _block(sim, lo, hi).astype(np.int64)
    order = np.argsort(value << 40 | length)
    sim, length, kind, value = sim[order], length[order], kind[order], value[order]
    names = np.flatnonzero(np.bincount(value, minlength=1 << (hi - lo)))
    where = np.full(1 << (hi - lo), len(names), np.int64)
    where[names] = np.arange(len(names))
    line = where[value]
    at = np.zeros(len(names) * kinds + 1, np.int64)
    np.cumsum(np.bincount(line * kinds + kind, minlength=len(names) * kinds), out=at[1:])
    # the lines of a value whose lengths may do for a class: the first << 32 | their number
    row, col = np.arange(len(names))[:, None] * kinds, np.arange(kinds)
    window = np.zeros((len(names) + 1, kinds), np.int64)
    begin = at[row + np.maximum(col - STEPS - 1, 0)]
    window[:-1] = begin << 32 | at[row + np.minimum(col + STEPS + 2, kinds)] - begin
    window = window.ravel()

    def good(m, hits):
        a, b = (np.concatenate(x) for x in zip(*hits, strict=True))
        later = (length[b] > length[a]) | (length[b] == length[a]) & (b > a)
        if m:
            a, b, some = np.where(later, b, a), np.where(later, a, b), True
        else:
            some = ~later & (a != b)
        some = some & (length[a] - length[b] <= (100 - percent) * length[a] // 100)
        x = sim[a] ^ sim[b]
        for e in range(k):
            some &= np.bitwise_count(_block(x, *spans[e][:2])) > spans[e][2]
        return order[a[some]], order[b[some]]

    ahead = np.append(sim, np.zeros(DIRECT, U))
    top = -1
    for m in sorted(_masks(lo, hi, radius, tuple(parts_), j)):
        if m.bit_length() != top:  # of two values that differ by m, the one without its highest bit asks
            top = m.bit_length()
            half = np.flatnonzero(value >> (top - 1) & 1 == 0) if m else np.arange(len(sim))
            own, own_line, own_kind = sim[half], line[half], kind[half]
        cell = (where[names ^ m] * kinds)[own_line]
        cell += own_kind
        size = window[cell]
        first = size >> 32
        size &= 0xFFFFFFFF
        hits, n_hits = [], 0
        for t in range(DIRECT):  # most windows are small: their lines are compared without a list of pairs
            x = ahead[t:][first]
            x ^= own
            some = np.flatnonzero(np.bitwise_count(x) < limit)
            some = some[size[some] > t]
            if len(some):
                hits.append((half[some], first[some] + t))
                n_hits += len(some)
                if n_hits > PAIRS:
                    yield good(m, hits)
                    hits, n_hits = [], 0
        rest = np.flatnonzero(size > DIRECT)
        size = size[rest] - DIRECT
        ends = np.cumsum(size)
        shift, mine, bits = first[rest] + DIRECT - ends + size, half[rest], own[rest]
        done = 0
        while done < len(rest):
            begin = int(ends[done - 1]) if done else 0
            upto = max(done + 1, int(np.searchsorted(ends, begin + PAIRS, "right")))
            n = size[done:upto]
            b = np.repeat(shift[done:upto], n)
            b += np.arange(begin, begin + len(b))
            x = np.repeat(bits[done:upto], n)
            x ^= sim[b]
            some = np.flatnonzero(np.bitwise_count(x) < limit)
            if len(some):
                hits.append((mine[done:upto][np.searchsorted(ends[done:upto], some + begin, "right")], b[some]))
                n_hits += len(some)
                if n_hits > PAIRS:
                    yield good(m, hits)
                    hits, n_hits = [], 0
            done = upto
        if hits:
            yield good(m, hits)


def close_pairs(sim: np.ndarray, k: int, blocks: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of distinct SimHashes that block k is the first to find: those that differ in under limit (blocks, if not given) bits."""
    limit = limit or blocks
    same = np.ones(len(sim), np.int64)
    found = [(sim[:0], sim[:0])]
    for j in range(len(_spans(blocks, limit)[k][3])):
        found += [(sim[a], sim[b]) for a, b in near_pairs(sim, same, k, j, blocks, limit, 0)]
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return a[a != b], b[a != b]


def _deal(blocks: int, limit: int, bits: int, rows: int = 1 << 18):
    """Lines to one bucket for each part of each block, by the lowest bits of the part's value."""
    sides = [(k, j, part[0], min(part[1], part[0] + bits)) for k, span in enumerate(_spans(blocks, limit)) for j, part in enumerate(span[3])]

    def send(held):
        held, out = [np.concatenate(x) for x in zip(*held, strict=True)], []
        sim = held[1]
        for k, j, lo, hi in sides:
            to = _block(sim, lo, hi).astype(np.uint16)
            order = np.argsort(to, kind="stable")
            cols = [x[order] for x in held]
            out += [((k * limit + j) << 32 | v, pack(*(x[a:b] for x in cols))) for v, a, b in slices(to[order], 1 << (hi - lo))]
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in out], pa.int64()), pa.array([f[1] for f in out], pa.binary())], ["bucket", "message"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False).view(t) for c, t in (("hash", np.int64), ("sim", U), ("length", np.int32), ("more", U), ("label", np.int64)) if c in batch.schema.names))
            n += len(batch)
            if n >= rows:
                yield send(held)
                held, n = [], 0
        if n:
            yield send(held)

    return run


def _compare(blocks: int, limit: int, second: int, percent: int, first: bool):
    """Candidate pairs of a bucket (whose messages have labels in the second round only): in the first round each line (a) with its partner of least hash (b) and its nearest one, by the bits that differ; else all pairs
    of different labels, the greater first."""

    def run(key, rows):
        k, j = divmod(key[0].as_py() >> 32, limit)
        own, sim, length, more, *label = (np.concatenate(x) for x in zip(*(unpack(m) for m in rows["message"].to_pylist()), strict=True))
        found, best, nearest = [(own[:0], own[:0])], np.full(len(own), LAST), np.full(len(own), LAST)
        by = np.argsort(own)
        rank = np.empty(len(own), np.int64)
        rank[by] = np.arange(len(own))
        for a, b in near_pairs(sim, length, k, j, blocks, limit, percent):
            near = np.bitwise_count(more[a] ^ more[b]) < second
            a, b = a[near], b[near]
            if first:
                bits = (np.bitwise_count(sim[a] ^ sim[b]).astype(np.int64) + np.bitwise_count(more[a] ^ more[b])) << 40
                for x, y in ((a, b), (b, a)):
                    np.minimum.at(best, x, own[y])
                    np.minimum.at(nearest, x, bits | rank[y])
            else:
                apart = label[0][a] != label[0][b]
                found.append((own[a[apart]], own[b[apart]]))
        if first:
            some = best < LAST
            return pa.table({"a": pa.array(own[some]), "b": pa.array(best[some]), "bits": pa.array(nearest[some] >> 40), "near": pa.array(own[by[nearest[some] & ((1 << 40) - 1)]])})
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"a": pa.array(np.maximum(a, b)), "b": pa.array(np.minimum(a, b))})

    return run


def _verify(percent: int):
    def run(batches):
        for batch in (part for whole in batches for part in _some_mb(whole, column="ta")):
            a, b = ([x or "" for x in batch.column(c).to_pylist()] for c in ("ta", "tb"))
            good = all_within(a, b, [(100 - percent) * max(len(x), len(y)) // 100 for x, y in zip(a, b, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _pick():
    """The normalised text of the wanted lines of each document."""

    def run(batches):
        for batch in batches:
            h, t = [], []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                lines = (text or "").split("\n")
                for w in wanted:
                    h.append(w["hash"])
                    t.append(b" ".join(normal_words(lines[w["number"]])).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(t, pa.string())], ["hash", "line"])

    return run


def _texts(docs: DataFrame, kinds: DataFrame, pairs: DataFrame) -> DataFrame:
    """(hash, line) of the lines in pairs, from the rows where they occur first; other rows aren't shuffled."""
    wanted = pairs.select(F.col("a").alias("hash")).unionByName(pairs.select(F.col("b").alias("hash"))).distinct()
    wanted = kinds.join(wanted, "hash").select(F.col("first")["doc_id"].alias("w_doc"), F.col("first")["key"].alias("w_key"), F.struct("hash", F.col("first")["number"].alias("number")).alias("w"))
    wanted = cut(wanted.groupBy("w_doc", "w_key").agg(F.collect_list("w").alias("wanted")), "wanted-lines")
    own = docs.select("doc_id", "text").withColumn("key", F.xxhash64("text"))
    own = sieve(own, wanted.select(F.col("w_doc").alias("doc_id"), F.col("w_key").alias("key")), ["doc_id", "key"], wanted.count())
    texts = own.join(wanted, own["doc_id"].eqNullSafe(wanted["w_doc"]) & (own["key"] == wanted["w_key"])).select("text", "wanted").mapInArrow(_pick(), "hash long, line string")
    return cut(texts.groupBy("hash").agg(F.min("line").alias("line")), "candidate-lines")  # equal rows give a line twice


FAN = 256  # partners of a line that are verified in one task
CHECKS = 8192  # pairs that are verified in one task at least, if there are so many: those of like length are computed together


def _links(docs: DataFrame, kinds: DataFrame, dealt: DataFrame, compare, percent: int, n: int, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The candidate pairs of one round (a, b), those that the edit distance confirms, and the lines' texts: the first round's, which the second is given, as its lines are among them."""
    first = texts is None
    pairs = dealt.groupBy("bucket").applyInArrow(compare, "a long, b long, bits long, near long" if first else "a long, b long")
    if first:
        best = pairs.groupBy("a").agg(F.min("b").alias("b"), F.min(F.struct("bits", "near"))["near"].alias("near"))
        pairs = best.select("a", F.explode(F.array("b", "near")).alias("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = cut(pairs.distinct(), "line-candidates")
    size = pairs.count()
    texts = _texts(docs, kinds, pairs) if first else texts
    # a line with over 1/65536 of all pairs (so 65536 lines at most) is copied for every FAN of its partners, which are numbered by hash
    many = pairs.groupBy("b").agg(F.count("*").alias("n")).withColumn("salts", F.when(F.col("n") * 65536 > size, F.ceil(F.col("n") / FAN)).otherwise(1).cast("int"))
    hot = F.broadcast(many.filter("salts > 1").select("b", "salts"))
    left = pairs.join(hot, "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.col("salts")), F.lit(0)).cast("int").alias("salt"))
    left = left.join(texts.select(F.col("hash").alias("a"), F.col("line").alias("ta")), "a")
    right = texts.withColumnRenamed("hash", "b").join(many, "b").select("b", F.col("line").alias("tb"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    sided = left.join(right, ["b", "salt"]).select("a", "b", "ta", "tb").repartition(min(n, size // CHECKS + 1))  # few bytes, much work
    return pairs, cut(sided.mapInArrow(_verify(percent), "a long, b long"), "line-links"), texts


def _removed(docs: DataFrame, min_words: int, percent: int, blocks: int, limit: int, second: int) -> tuple[DataFrame, DataFrame]:
    """docs (row, doc_id, text) -> (row, doc_id, n_lines), and (row, removed) of the rows that lose lines."""
    scan = docs.select("row", "doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(_scan(min_words), SCAN)
    scan = cut(scan, "lines")
    each = scan.filter("number >= 0")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "row", "number")
    kinds = cut(each.groupBy("hash").agg(F.min(order).alias("first"), F.first("sim").alias("sim"), F.first("length").alias("length"), F.first("more").alias("more"), F.count("*").alias("n")), "distinct-lines")
    n, (total, lines) = parts(docs, 6.0), kinds.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    bits = min(6, (lines >> 15).bit_length())  # lines of a bucket; more buckets than the parts' values allow there can't be
    deal = lambda x, *label: x.select("hash", "sim", "length", "more", *label).mapInArrow(_deal(blocks, limit, bits), "bucket long, message binary")
    compare = lambda first: _compare(blocks, limit, second, percent, first)
    tried, links, texts = _links(docs, kinds, deal(kinds), compare(True), percent, n)
    near = tried.select(F.col("a").alias("hash")).unionByName(tried.select(F.col("b").alias("hash"))).distinct()
    root = components(links).select(F.col("node").alias("hash"), "root")
    again = kinds.join(near, "hash").join(root, "hash", "left").withColumn("label", F.coalesce("root", "hash"))
    _, more, _ = _links(docs, kinds, deal(again, "label"), compare(False), percent, n, texts)
    same = components(links.unionByName(more)) if not more.isEmpty() else root.withColumnRenamed("hash", "node")
    member = same.join(kinds.select(F.col("hash").alias("node"), "first"), "node")
    lead = member.groupBy("root").agg(F.min("first").alias("lead"), F.count("*").alias("n"))
    member = join_hot(member, lead, "root", "n", max(1, lines)).select(F.col("node").alias("hash"), "lead")
    # only lines that occur again or are linked can go
    known = cut(kinds.join(member, "hash", "left").filter("n > 1 or lead is not null").select("hash", "n", F.coalesce("lead", "first").alias("lead")), "line-groups")
    gone = join_hot(each.select("row", "number", "hash"), known, "hash", "n", total).filter((F.col("row") != F.col("lead")["row"]) | (F.col("number") != F.col("lead")["number"]))
    return scan.filter("number < 0").select("row", "doc_id", (-1 - F.col("number")).cast("long").alias("n_lines")), gone.groupBy("row").agg(F.array_sort(F.collect_set("number")).alias("removed"))


def dedup_lines(docs: DataFrame, min_words: int = 5, percent: int = 80, blocks: int = 4, limit: int = LIMIT, second: int = SECOND) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers) for each row of docs. Lines whose SimHashes differ in limit bits or more, or the second ones in second bits or more, aren't compared."""
    # the scan is written once with the numbers, which name its rows from then on
    every, gone = _removed(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), min_words, percent, blocks, limit, second)
    out = every.join(gone, "row", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def drop_lines(docs: DataFrame, min_words: int = 5, percent: int = 80, blocks: int = 4, limit: int = LIMIT, second: int = SECOND) -> DataFrame:
    """docs with the text's remaining lines; same columns. The rows are written once, with a number each."""
    rows = cut(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")), "numbered-rows")
    _, gone = _removed(rows.select("row", "d.doc_id", "d.text"), min_words, percent, blocks, limit, second)
    x = rows.join(gone, "row", "left")
    kept = F.array_join(F.filter(F.split("d.text", "\n"), lambda _, i: ~F.array_contains("removed", i)), "\n")
    text = F.when(F.col("removed").isNull(), F.col("d")["text"]).otherwise(kept)
    return x.select(*[(text if c == "text" else F.col("d")[c]).alias(c) for c in docs.columns])


def op10_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))
