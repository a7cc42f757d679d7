"""MinHash near-dedup with min-max hashing.

A document's set: the distinct hashes of its shingles (words of the lower-cased text; with fewer words than a shingle, the whole sequence as one).
Each permutation gives two signature values, the least and the greatest hash, so half as many hash evaluations fill a signature; 20 bands of
4 values miss a pair at similarity 0.85 with probability 4e-7.

Equal sets are one class, which stands for all its documents; a representative's text (found by doc_id and text hash) gives its full set where it is compared: texts that
nobody compares aren't shuffled, and the others take less than their sets. Classes that agree in a band are candidates, and links are confirmed on full sets in two rounds:

1. Each class is compared with the smallest class of each of its buckets. A bucket's head meets its members in tasks of at most 256, so most
   near copies connect here, with a comparison each.
2. Buckets whose members aren't all connected yet are the candidates that are left. Their classes' groups (components over buckets) are dealt into blocks of at most ``block``
   classes, and pairs of blocks are tasks: one class at a time is compared with all candidates of other parts of the pair that aren't connected yet. No pairs are listed.

Every link between classes is either confirmed or lies inside one component already. The confirmed links' components give the result. Rows of hot buckets and
classes (over 1/1024 of all rows each) are joined by broadcast of those buckets, 1024 at most.

Edge cases: documents without words or with null text have empty sets and are linked with nothing; equal rows are one class; a doc_id that comes with several texts
is several documents, each with its own row; a null doc_id is a document whose component is the smallest non-null doc_id (null without one); an empty table gives an empty result;
other columns aren't looked at. keep_one_each keeps of each component one row: the smallest doc_id (null last), then the smallest text hash; of rows without
words it keeps each doc_id and text once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packframe.llm.common import cut, join_hot, parts, sieve, table
from packframe.llm.graph import components
from packframe.llm.units import mix, texts_of, word_hashes

U = np.uint64
BANDS, ROWS = 20, 4
NO_ID = -(1 << 63)  # stands for a null doc_id where a join and a grouping share a shuffle
FAN = 256  # members that meet a bucket's head in one task


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int):
    """Yield (first document, sorted distinct shingle hashes end to end, offsets) for runs of documents."""
    for d, e, h, doc in word_hashes(data, offsets):
        n = np.bincount(doc - d, minlength=e - d)
        s = h.copy()
        for k in range(1, size):
            s[:-k] = mix(s[:-k] * U(0x9E3779B97F4A7C15) + h[k:])
        ends = np.cumsum(n)
        out, sizes = [], []
        for lo, hi in zip(ends - n, ends, strict=True):
            if hi - lo >= size:
                own = np.sort(s[lo : hi - size + 1])
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif hi > lo:
                acc = np.full(1, hi - lo, np.uint64)
                for x in h[lo:hi]:
                    acc = mix(acc * U(0xD6E8FEB86659FD93) + x)
                own = acc
            else:
                own = h[:0]
            out.append(own)
            sizes.append(len(own))
        yield d, np.concatenate(out), np.concatenate([[0], np.cumsum(sizes)])


def band_keys(sets: np.ndarray, offsets: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(documents, bands) keys of non-empty sets: each permutation gives its least and its greatest value."""
    perms = mix(np.arange(1, bands * rows // 2 + 1, dtype=np.uint64)) | U(1)
    values = []
    for a in perms:
        v = sets * a
        values += [np.minimum.reduceat(v, offsets[:-1]), np.maximum.reduceat(v, offsets[:-1])]
    keys = []
    for b in range(bands):
        acc = np.full(len(offsets) - 1, b + 1, np.uint64)
        for v in values[b * rows : (b + 1) * rows]:
            acc = mix(acc * U(0x9E3779B97F4A7C15) + v)
        keys.append(acc)
    return np.stack(keys, 1)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _set_hash(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each set: of the sum of its mixed members, and its size. 0 only for the empty one."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets * U(0xD6E8FEB86659FD93) + U(1)))])
    n = np.diff(offsets)
    return np.where(n > 0, mix(total[offsets[1:]] - total[offsets[:-1]] + n.astype(np.uint64)) | U(1), U(0))


def _signatures(size: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            data, offsets = texts_of(batch.column("text"))
            for d, sets, off in shingle_sets(data, offsets, size):
                n = np.diff(off)
                some = np.flatnonzero(n)
                keys = band_keys(sets, np.append(off[:-1][some], len(sets)), bands, rows) if len(some) else np.zeros((0, bands), np.uint64)
                ends = np.zeros(len(n) + 1, np.int32)
                ends[some + 1] = bands
                listed = pa.ListArray.from_arrays(pa.array(np.cumsum(ends).astype(np.int32)), _long(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(d, len(n)), batch.column("key").slice(d, len(n)), pa.array(n.astype(np.int64)), _long(_set_hash(sets, off)), listed], ["doc_id", "key", "n_shingles", "class", "bands"])

    return run


def _sets(column, size: int):
    """Yield each text's number and set, a run of documents at a time."""
    for d, sets, off in shingle_sets(*texts_of(column), size):
        yield range(d, d + len(off) - 1), [sets[lo:hi] for lo, hi in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def similar(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the others are linked with one."""
    sizes = np.array([len(o) for o in others])
    take = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, take), len(one) - 1)
    common = np.add.reduceat((one[at] == take).astype(np.int64), np.cumsum(sizes) - sizes)
    return 100 * common >= percent * (sizes + len(one) - common)


def _with_heads(percent: int, size: int):
    """Rows sorted by (head, salt, class is not the head): each head's text, then its members'."""

    def run(batches):
        now, own = None, None
        for batch in batches:
            out_a, out_b = [], []
            heads, salts, names = (batch.column(c).to_pylist() for c in ("head", "salt", "class"))

            def done(group, names=names, out_a=out_a, out_b=out_b):
                if group and own is not None:
                    good = similar(own, [s for _, s in group], percent)
                    out_a.extend(names[i] for (i, _), ok in zip(group, good.tolist(), strict=True) if ok)
                    out_b.extend([now[0]] * int(good.sum()))

            for at, sets in _sets(batch.column("text"), size):
                group: list[tuple[int, np.ndarray]] = []
                for i, items in zip(at, sets, strict=True):
                    if (heads[i], salts[i]) != now:
                        done(group)
                        now, own, group = (heads[i], salts[i]), None, []
                    if names[i] == heads[i]:
                        own = items.copy()
                    else:
                        group.append((i, items))
                done(group)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def link(sets: list[np.ndarray], side: np.ndarray, percent: int, bands: int, rows: int, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the sets as all pairs of different sides would (all pairs, if there is one side): one set at a time, against those
    that agree with it in a band and aren't connected to it yet. Sets of equal label are connected from the start."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    off = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate(sets)
    keys = band_keys(flat, off, bands, rows)
    where = []  # for each band, sets by key
    for b in range(bands):
        order = np.argsort(keys[:, b], kind="stable")
        where.append((order, keys[order, b]))
    part = np.arange(n) if label is None else np.unique(label, return_inverse=True)[1]
    two = len(np.unique(side)) > 1
    out = []
    for i in range(n - 1):
        if (part == part[0]).all():
            break
        near = [order[np.searchsorted(k, keys[i, b], "left") : np.searchsorted(k, keys[i, b], "right")] for b, (order, k) in enumerate(where)]
        near = np.unique(np.concatenate(near))
        near = near[(near > i) & (part[near] != part[i])]
        near = near[side[near] != side[i]] if two else near
        near = near[np.minimum(sizes[near], sizes[i]) * 100 >= percent * np.maximum(sizes[near], sizes[i])]
        if not len(near):
            continue
        for j in near[similar(sets[i], [sets[j] for j in near], percent)]:
            if part[j] != part[i]:
                out.append((i, int(j)))
                part[part == part[j]] = part[i]
    return out


def _links(percent: int, bands: int, rows: int, size: int):
    """Rows sorted by (comp, lo, hi); one such group at a time is held, two blocks at most."""

    def run(batches):
        held, held_key = [], None

        def done(group):
            names = [r[1] for r in group]
            got = link([r[3] for r in group], np.array([r[2] for r in group]), percent, bands, rows, np.array([r[4] for r in group])) if len(group) > 1 else []
            return [(names[i], names[j]) for i, j in got]

        def table_of(found):
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            found = []
            comps, los, his, names, blks, labels = (batch.column(c).to_pylist() for c in ("comp", "lo", "hi", "class", "blk", "label"))
            for at, sets in _sets(batch.column("text"), size):
                for i, items in zip(at, sets, strict=True):
                    if (comps[i], los[i], his[i]) != held_key:
                        found += done(held)
                        held, held_key = [], (comps[i], los[i], his[i])
                    if not held or held[-1][1] != names[i]:
                        held.append((comps[i], names[i], blks[i], items.copy(), labels[i]))
            yield table_of(found)
        yield table_of(done(held))

    return run


def _classes(sig: DataFrame) -> DataFrame:
    """Each class once: its first document (rep), size, number of rows and bands."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    return sig.filter("n_shingles > 0").groupBy("class").agg(F.min(order).alias("rep"), F.first("n_shingles").alias("size"), F.count("*").alias("n"), F.first("bands").alias("bands"))


def _with_texts(docs: DataFrame, reps: DataFrame, to: DataFrame, total: int) -> DataFrame:
    """The rows of to, by class, with their representatives' texts. Only about those texts are shuffled; to has total classes at most."""
    to = cut(to.join(reps, "class"), "texts-wanted")
    own = docs.select("doc_id", "text").withColumn("key", F.xxhash64("text"))
    own = sieve(own, to.select(F.col("r_doc").alias("doc_id"), F.col("r_key").alias("key")), ["doc_id", "key"], total)
    # equal rows give a text again, which the readers bear
    return own.join(to, own["doc_id"].eqNullSafe(to["r_doc"]) & (own["key"] == to["r_key"])).drop("doc_id", "key", "r_doc", "r_key")


def _links_to_heads(docs: DataFrame, reps: DataFrame, member: DataFrame, heads: DataFrame, percent: int, total: int, n: int, shingle: int) -> DataFrame:
    """Round 1: confirmed links (a, b) of classes with their buckets' heads."""
    salts = F.ceil(F.col("n") / FAN).cast("int")
    met = join_hot(member, heads.withColumn("salts", salts), "bucket", "n", total)
    fits = F.least("size", "head_size") * 100 >= percent * F.greatest("size", "head_size")
    met = met.filter((F.col("class") != F.col("head")) & fits).groupBy("class", "head").agg(F.min(F.pmod(F.xxhash64("class"), F.col("salts")).cast("int")).alias("salt"))
    met = cut(met, "head-pairs")
    copies = met.select("head", F.col("head").alias("class"), "salt").distinct()
    both = _with_texts(docs, reps, met.unionByName(copies), total)
    both = both.repartition(n, "head", "salt").sortWithinPartitions("head", "salt", F.col("class") != F.col("head"))
    return cut(both.select("head", "salt", "class", "text").mapInArrow(_with_heads(percent, shingle), "a long, b long"), "head-links")


def _links_in_groups(docs: DataFrame, reps: DataFrame, member: DataFrame, label: DataFrame, percent: int, bands: int, rows: int, block: int, total: int, n: int, shingle: int) -> DataFrame | None:
    """Round 2: confirmed links (a, b) among classes of buckets that have members of different labels; None without such buckets."""
    told = member.join(label, "class", "left").withColumn("label", F.coalesce("label", "class"))
    mixed = told.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("class").alias("head"), F.count("*").alias("n")).filter("low < high")
    left = cut(join_hot(told.select("bucket", "class", "label"), mixed.select("bucket", "head", "n"), "bucket", "n", total).select("class", "label", "head"), "open-members")
    if left.isEmpty():
        return None
    group = components(left.select(F.col("class").alias("a"), F.col("head").alias("b")))
    near = cut(group.join(left.select(F.col("class").alias("node"), "label").distinct(), "node"), "candidate-groups")
    blocks = near.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("n_blk"))
    placed = near.join(blocks, "root").select(F.col("node").alias("class"), F.col("root").alias("comp"), "label", "n_blk", F.pmod(F.xxhash64("node"), F.col("n_blk")).cast("int").alias("blk"))
    pairs = _with_texts(docs, reps, placed, total).select("*", F.explode(F.sequence(F.lit(0), F.col("n_blk") - 1)).alias("other"))
    pairs = pairs.select("comp", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "class", "blk", "label", "text")
    pairs = pairs.repartition(n, "comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi", "class")
    return cut(pairs.mapInArrow(_links(percent, bands, rows, shingle), "a long, b long"), "confirmed-links")


def _labelled(docs: DataFrame, size: int, percent: int, bands: int, rows: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n_shingles, class) of each row of docs, and (class, n, lead) of each class: the first document of its component."""
    sig = docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(_signatures(size, bands, rows), "doc_id long, key long, n_shingles long, class long, bands array<long>")
    sig = cut(sig, "signatures")
    classes = cut(_classes(sig), "classes")
    member = classes.select("class", "size", F.explode("bands").alias("bucket"))
    heads = member.groupBy("bucket").agg(F.min(F.struct("class", "size")).alias("h"), F.count("*").alias("n")).filter("n > 1")
    heads = cut(heads.select("bucket", F.col("h.class").alias("head"), F.col("h.size").alias("head_size"), "n"), "bucket-heads")
    total = max(1, heads.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    member = cut(join_hot(sieve(member, heads, ["bucket"], total // 2), heads.select("bucket", "n"), "bucket", "n", total).drop("n"), "bucket-members")
    n = parts(docs, 6.0)
    reps = classes.select("class", F.col("rep")["doc_id"].alias("r_doc"), F.col("rep")["key"].alias("r_key"))
    links = _links_to_heads(docs, reps, member, heads, percent, total, n, size)
    same = components(links)
    more = _links_in_groups(docs, reps, member, same.select(F.col("node").alias("class"), F.col("root").alias("label")), percent, bands, rows, block, total, n, size)
    same = same if more is None else components(links.unionByName(more))
    found = same.join(classes.select(F.col("class").alias("node"), "rep"), "node")
    lead = found.groupBy("root").agg(F.min("rep").alias("lead"), F.count("*").alias("n"))
    lead = join_hot(found, lead, "root", "n", total).select(F.col("node").alias("class"), "lead")
    return sig.drop("bands"), cut(classes.select("class", "rep", "n").join(lead, "class", "left").select("class", "n", F.coalesce("lead", "rep").alias("lead")), "class-leads")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, block: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs: documents are linked if 100 * |A & B| >= percent * |A | B|."""
    sig, leads = _labelled(docs, size, percent, bands, rows, block)
    some = sig.filter("n_shingles > 0")
    x = join_hot(some, leads, "class", "n", max(1, some.count())).select("doc_id", "n_shingles", F.col("lead")["doc_id"].alias("component_id"))
    x = x.unionByName(sig.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return x.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def keep_one_each(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, block: int = 1024) -> DataFrame:
    """docs without near copies: of each component one row stays, the first by doc_id (null last) and text hash; same columns."""
    sig, leads = _labelled(docs, size, percent, bands, rows, block)
    keep = leads.select(F.col("lead")["doc_id"].alias("n_doc"), F.col("lead")["key"].alias("n_key"))
    keep = keep.unionByName(sig.filter("n_shingles = 0").select(F.col("doc_id").alias("n_doc"), F.col("key").alias("n_key")))
    keep = keep.withColumn("n_doc", F.coalesce("n_doc", F.lit(NO_ID))).distinct()
    x = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.coalesce("doc_id", F.lit(NO_ID)).alias("n_doc"), F.xxhash64("text").alias("n_key"))
    # both steps want rows of a document and text together, so the texts are moved once
    x = x.join(keep, ["n_doc", "n_key"], "left_semi").dropDuplicates(["n_doc", "n_key"])
    return x.select(*[F.col("d")[c].alias(c) for c in docs.columns])


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
x AS (SELECT r, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.r AS a, b.r AS b FROM x a JOIN x b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
sides AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
reach AS (SELECT r AS a, r AS b FROM s UNION SELECT reach.a, sides.b FROM reach JOIN sides ON sides.a = reach.b),
least AS (SELECT reach.a, min(s.doc_id) AS component_id FROM reach JOIN s ON s.r = reach.b GROUP BY reach.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least.component_id, s.doc_id IS NOT DISTINCT FROM least.component_id AS kept FROM s JOIN least ON least.a = s.r"""
