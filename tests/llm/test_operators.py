import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packframe.llm import chat, common, decontaminate, distance, graph, lines, lm, minhash, mixing, quality, sharding, suffix_dedup, units, urls
from packframe.llm.distance import edit_distances
from tests.conftest import SMALL
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, unit string, class string, bucket string"
rng = random.Random(11)


@pytest.fixture(scope="module")
def docs(spark):
    """The smallest table and hard rows: null, empty, spaces only, ties, repeated rows, a very long text; extra columns with clashing names."""
    real = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    text = real[5][1]
    hard = [(9001, None), (9002, ""), (9003, " \n\t "), (9004, "one"), (9005, "One TWO three"), (9005, "one two three"), (9006, text), (9006, text), (9007, "a" * 300), (9008, "a" * 120), (9009, (text + " ") * 40)]
    rows = real + [(i, t, None, None) for i, t in hard]
    return spark.createDataFrame([(*r, 0, "u", "c", "b") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def test_suffix_dedup(docs, rows, none, monkeypatch):
    want = brute.suffix(rows)
    assert sorted(tuple(r) for r in suffix_dedup.dedup_substrings(docs, 0.1).drop("spans").collect()) == want
    assert suffix_dedup.dedup_substrings(none).count() == 0


def test_suffix_dedup_dealt_by_windows(spark):
    made = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(300))) * rng.randrange(1, 3)) for i in range(60)] + [(100, "a" * 3000), (101, "a" * 500)]
    old = suffix_dedup.WIDE, suffix_dedup.EACH
    suffix_dedup.WIDE, suffix_dedup.EACH = 2, 0
    try:
        got = suffix_dedup.dedup_substrings(spark.createDataFrame(made, "doc_id long, text string"), 0.01).drop("spans").collect()
    finally:
        suffix_dedup.WIDE, suffix_dedup.EACH = old
    assert sorted(tuple(r) for r in got) == brute.suffix(made)


def test_sql_of_the_dedups_is_the_plain_version(rows):
    con = duckdb.connect()
    con.execute("create table documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert sorted(con.execute(suffix_dedup.OP1_SQL).fetchall()) == brute.suffix(rows)
    got = con.execute(minhash.OP3_SQL).fetchall()
    assert sorted(r[:3] for r in got) == brute.near(rows, 3, 85) and all(k == (d == c) for d, _, c, k in got)


def test_suffix_sort_orders_and_survives_collisions(monkeypatch):
    text = np.array([[rng.randrange(97, 99) for _ in range(suffix_dedup.WIDTH)] + [suffix_dedup.W] for _ in range(20)], np.uint8)
    row, col = np.repeat(np.arange(20), suffix_dedup.W), np.tile(np.arange(suffix_dedup.W), 20)
    group = np.zeros(len(row), np.int64)
    raw = [text[r, c : c + 50].tobytes() for r, c in zip(row, col)]
    order, same = suffix_dedup.sort_suffixes(text, group, row, col)
    assert [raw[i] for i in order] == sorted(raw)
    assert same.tolist() == [raw[a] == raw[b] for a, b in zip(order, order[1:])]
    monkeypatch.setattr(suffix_dedup, "_extension", lambda p, turn, a, b: np.full(len(a), 50))  # every hash collides
    order, same = suffix_dedup.sort_suffixes(text, group, row, col)
    assert [raw[i] for i in order] == sorted(raw)


def test_suffix_dedup_memory_of_a_unit_and_a_bucket():
    """Two units that share all their text, slice by slice or but for a byte: no step holds more than 80 bytes for a byte of text (it was 194)."""
    size, draw = 1_000_000, np.random.default_rng(5)
    texts = [draw.integers(97, 123, size // 50, dtype=np.uint8).tobytes() for _ in range(50)]
    near = [t[:-1] if i % 2 else t[:700] + b"!" + t[700:] for i, t in enumerate(texts)]

    def unit(ids, own):
        zero = np.zeros(len(own), np.int64)
        packed = units.pack(zero.astype(np.uint8), np.array(ids), zero, zero.astype(np.uint8), np.array([len(t) for t in own]), np.frombuffer(b"".join(own), np.uint8))
        return pa.table({"docs": pa.array([packed], pa.binary())})

    def told(pairs):
        return pa.table({"bucket": pa.array([0] * len(pairs), pa.int32()), "kind": pa.array([k for k, _ in pairs], pa.int32()), "message": pa.array([m for _, m in pairs], pa.binary())})

    def step(f):
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        out = f()
        assert tracemalloc.get_traced_memory()[1] - before < 80 * size
        return out

    both = [unit(range(50), texts), unit(range(50, 100), near)]
    key = [(pa.scalar(u),) for u in range(2)]
    tracemalloc.start()
    try:
        keys = [step(lambda: suffix_dedup._send_keys(1)(key[u], both[u])) for u in range(2)]
        codes = {u: m for u, _, m in suffix_dedup._reply_keys([(u, 0, t["message"][0].as_py()) for u, t in enumerate(keys)])}
        items = [step(lambda: suffix_dedup._send_items(1)(key[u], both[u], told([(1, codes[u])]))) for u in range(2)]
        got = [(u, k, m) for u, t in enumerate(items) for k, m in zip(t["kind"].to_pylist(), t["message"].to_pylist())]
        back = step(lambda: list(suffix_dedup._reply_items(got)))
        out = [step(lambda: suffix_dedup._finish(1, False)(key[u], both[u], told([(k, m) for v, k, m in back if v == u]))) for u in range(2)]
    finally:
        tracemalloc.stop()
    assert out[0]["n_removed"].to_pylist() == [0] * 50
    assert out[1]["n_removed"].to_pylist() == [len(t) - (i % 2 == 0) for i, t in enumerate(near)]


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, none, size, percent):
    got = minhash.near_duplicates(docs, size, percent, block=8).collect()
    assert sorted(tuple(r)[:3] for r in got) == brute.near(rows, size, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert minhash.near_duplicates(none).count() == 0


def test_near_duplicates_of_short_texts(spark):
    made = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(6)))) for i in range(80)]
    got = minhash.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"), 3, 85).collect()
    assert sorted(tuple(r)[:3] for r in got) == brute.near(made, 3, 85)


def test_keep_one_each(docs, rows):
    kept = minhash.keep_one_each(docs)
    assert kept.columns == docs.columns
    want = {c for _, _, c in brute.near(rows, 5, 80)}
    assert sorted({r.doc_id for r in kept.collect()}) == sorted(want & {d for d, _ in rows})


def test_components(spark):
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(40)]
    part = brute.components(1100, links)
    least = {}
    for i, p in enumerate(part):
        least[p] = min(least.get(p, i), i)
    touched = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: least[part[x]] for x in touched}


def test_edit_distances():
    some = lambda n: [np.array([rng.randrange(4) for _ in range(rng.randrange(n))], np.int64) for _ in range(150)]
    a, b = some(12), some(15)
    for inside in (False, True):
        assert edit_distances(a, b, inside)[0].tolist() == [brute.edits(list(x), list(y), inside) for x, y in zip(a, b)]


def test_within_is_the_edit_distance():
    r = np.random.default_rng(3)
    for _ in range(400):
        a = "".join(r.choice(list("abc\u00e9"), r.integers(0, 60)))
        b = "".join(c for c in a if r.random() > 0.15) + "".join(r.choice(list("abd"), r.integers(0, 6)))
        codes = [[np.array([ord(c) for c in x], np.int64)] for x in (a, b)]
        d = int(distance.edit_distances(*codes)[0][0])
        for limit in (0, d - 1, d, d + 1, 3 * d):
            assert limit < 0 or distance.within(a, b, limit) == (d <= limit)
        p, t = sorted((a, b), key=len)
        assert distance._banded(p, t, max(d, len(t) - len(p)), span=3) == d


def test_word_alignment_bounds_the_edit_distance(monkeypatch):
    """It never says less than the edit distance; near copies are confirmed by it alone."""
    g, near = random.Random(9), []
    for _ in range(300):
        a = [g.choice(("a", "bb", "cab", "", "dab", "x y")) for _ in range(g.randrange(0, 14))]
        b = [w if g.random() < 0.7 else g.choice(("a", "e", "fgh")) for w in a if g.random() < 0.9] if g.random() < 0.8 else a[::-1]
        a, b = " ".join(a), " ".join(b)
        exact = int(edit_distances([np.frombuffer(a.encode(), np.uint8)], [np.frombuffer(b.encode(), np.uint8)])[0][0])
        for limit in (0, 3, 10**6):
            assert (found := distance.at_most(a, b, limit)) >= exact or found > limit
        assert distance.all_within([a] * 2, [b] * 2, [exact, exact - 1]) == [True, False]
    for k in range(40):
        w = [f"{g.randrange(10**6)}" for _ in range(60)]
        x = w[:10] + ["new", "words"] + w[10:30] + ["other"] + w[31:50] + w[52:]
        near.append((" ".join(w), " ".join(x), 60))
    monkeypatch.setattr(distance, "_together", None)
    assert all(distance.all_within(*map(list, zip(*near, strict=True))))


def test_pairs_that_differ_are_refuted_together(monkeypatch):
    """The work of refuted pairs, not only the answer: they aren't checked one by one, and word alignment is given up where it confirms nothing."""
    g, calls = random.Random(4), Counter()
    for name in ("within", "at_most"):
        monkeypatch.setattr(distance, name, lambda *x, name=name, f=getattr(distance, name): calls.update([name]) or f(*x))
    text = lambda n: "".join(g.choice("abcdefg  \u00e9") for _ in range(n))
    left = [text(n) for n in range(1300, 1500, 2)] + [text(n) for n in range(100, 300)]
    right = [x[k:] + x[:k] if i % 2 else "".join(c if g.random() < 0.8 else g.choice("xyz") for c in x) for i, x in enumerate(left) for k in (len(x) // 2,)]
    codes = [[np.array([ord(c) for c in x], np.int64) for x in side] for side in (left, right)]
    exact = edit_distances(*codes)[0].tolist()
    assert distance.all_within(left, right, exact) == [True] * len(left)
    calls.clear()
    assert distance.all_within(left, right, [d - 1 for d in exact]) == [False] * len(left)
    assert calls["within"] < len(left) // 4 and calls["at_most"] < len(left) // 2, calls


def test_decontamination_recall_and_exactness(spark, docs, none):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    made = []
    for k in range(150):
        w = brute.words(rng.choice(items)[1])
        for _ in range(rng.randrange(len(w) * 20 // 100 + 3)):
            at = rng.randrange(len(w))
            w[at : at + rng.choice((0, 1))] = rng.choice(([], [f"zz{rng.randrange(99)}"]))
        around = [f"q{rng.randrange(50)}" for _ in range(30)]
        made.append((k, " ".join(around[:15] + w + around[15:])))
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.leaks(spark.createDataFrame(made, "doc_id long, text string"), bench).collect()}
    want = {}
    for d, t in made:
        for i, text in items:
            w = brute.words(text)
            if (e := brute.edits(w, brute.words(t), True)) <= len(w) * 20 // 100:
                want[d, i] = e
    assert got.items() <= want.items() and len(got) >= 0.98 * len(want) > 50
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(docs, bench.filter("false")).count() == 0
    left = decontaminate.drop_leaking(docs, bench)
    assert left.columns == docs.columns and 0 < left.count() < docs.count()


def test_decontamination_judges_rows_by_their_text(spark):
    item = " ".join(f"w{i}" for i in range(40))
    far = " ".join(f"v{i}" for i in range(9000))
    bench = spark.createDataFrame([(1, item), (2, far), (3, None), (4, "alone here"), (5, item)], "item_id long, text string")
    clean, dirty = "a clean text " * 9, "before " + item.replace("w7 ", "") + " after"
    made = [(1, clean, 5), (1, dirty, 6), (None, clean, 7), (None, dirty, 8), (2, None, 9), (3, "", 10), (4, far.replace("v5 ", "x "), 11), (5, far[:20000], 12), (6, dirty, 13), (6, dirty, 14), (7, "not alone there", 15), (8, "all alone here", 16)]
    df = spark.createDataFrame(made, "doc_id long, text string, leak_doc_id long")
    kept = decontaminate.drop_leaking(df, bench)
    assert kept.columns == df.columns and sorted(r.leak_doc_id for r in kept.collect()) == [5, 7, 9, 10, 12, 15]
    found = Counter((r.doc_id, r.item_id, r.edits, r.first_word) for r in decontaminate.leaks(df, bench).collect())
    assert found == Counter({(1, 1, 1, 0): 1, (1, 5, 1, 0): 1, (None, 1, 1, 0): 1, (None, 5, 1, 0): 1, (4, 2, 1, 0): 1, (6, 1, 1, 0): 2, (6, 5, 1, 0): 2, (8, 4, 0, 1): 1})


def test_mixing(spark, docs, none):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SMALL}/documents.parquet')")
    cols = ("doc_id", "size", "source_size", "target", "taken")
    got = mixing.op4_mix_sources(spark, SMALL).collect()
    rel = con.execute(mixing.OP4_SQL)
    at = [[d[0] for d in rel.description].index(c) for c in cols]
    fix = lambda v: tuple(round(x, 6) if isinstance(x, float) else x for x in v)
    assert sorted(fix(r[c] for c in cols) for r in got) == sorted(fix(r[i] for i in at) for r in rel.fetchall())
    assert all(r.taken <= 3 * r.size for r in got)
    planned = mixing.assign(docs, block_docs=8, shards=5).collect()
    sizes = {r.doc_id: r.size for r in planned}
    assert sizes[9001] == sizes[9002] == sizes[9003] == 0
    by_source = defaultdict(list)
    for r in planned:
        by_source[r.source].append(r)
    for rows in by_source.values():  # the source's target is met to the word
        assert sum(r.taken for r in rows) == int(rows[0].target + 0.5)
    shards = Counter(d.shard for r in planned for d in r.drawn)
    assert set(shards) == set(range(5)) and max(shards.values()) < 2.5 * min(shards.values())
    assert all(sorted({d["pass"] for d in r.drawn}) == list(range(len(r.drawn))) for r in planned if r.drawn)  # no draw comes twice, none is left out
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    out = mixed.collect()
    assert sum(len(brute.words(r.text)) for r in out) == sum(r.taken for r in mixing.assign(docs).collect())
    assert mixing.assign(none).count() == 0 and mixing.mix_documents(none).count() == 0


def test_mixing_of_rows_without_ids_and_with_the_same(spark):
    made = [(None, f"a null id and text {i} " * (1 + i % 3), "s1", 0) for i in range(40)] + [(7, "the same row", s, 3) for s in ("s1", "s1", "s2", None)] + [(7, "another text", "s2", 3), (8, "", "s3", 0), (9, None, None, 0)]
    df = spark.createDataFrame(made, "doc_id long, text string, source string, n_chars long")
    rows = mixing.assign(df, block_docs=4).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in rows) == Counter((d, s, len(brute.words(t))) for d, t, s, _ in made)
    out = mixing.mix_documents(df, block_docs=4).collect()
    taken = defaultdict(int)
    for r in rows:
        taken[r.source] += r.taken
    got = defaultdict(int)
    for r in out:
        got[r.source] += len(brute.words(r.text))
        assert (r.doc_id, r.source) in {(d, s) for d, _, s, _ in made} and any((t or "").startswith(r.text) for d, t, s, _ in made if (d, s) == (r.doc_id, r.source))
        assert r.n_chars in (0, 3) or r.n_chars == len(r.text)
    assert got == {s: n for s, n in taken.items() if n}


def test_hypergeometric_law_and_tree(spark):
    from math import comb

    x = spark.range(5000).select(mixing.hypergeometric(F.lit(30), F.lit(12), F.lit(10), (F.col("id") + 0.5) / 5000).alias("k")).groupBy("k").count()
    share = {r.k: r["count"] / 5000 for r in x.collect()}
    assert max(abs(share.get(k, 0) - comb(12, k) * comb(18, 10 - k) / comb(30, 10)) for k in range(11)) < 1e-3
    quotas = [900, 50, 41, 0, 30]
    leaves = mixing.split_tree(spark.createDataFrame(list(enumerate(quotas)), "pos int, draws long"), 5).collect()
    by_source, by_shard = Counter(), Counter()
    for r in leaves:
        by_source[r.pos] += r["last"] - r["first"]
        by_shard[r.shard] += r["last"] - r["first"]
    assert [by_source[i] for i in range(5)] == quotas and max(by_shard.values()) - min(by_shard.values()) <= 3


def test_sharding(docs, rows, none):
    got = sharding.assign(docs, 7, 16).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[s]) for s in range(7)]
    assert max(counts) - min(counts) <= 1
    assert sharding.assign(none).count() == 0


def test_sharding_against_a_plain_ring(spark):
    import struct

    import xxhash

    ids = rng.sample(range(-(10**12), 10**12), 400)
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.assign(spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string"), 7, 16).collect()}
    nodes = sharding.ring(7, 16)
    arcs = defaultdict(list)
    for i in ids:
        h = xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42)
        after = [a for a, (place, _) in enumerate(nodes) if place >= h >> (64 - sharding.RING_BITS)]
        arcs[after[0] if after else 0].append((h, i))
    room, used, want, late = [400 // 7 + (s < 400 % 7) for s in range(7)], [0] * 7, {}, []

    def put(i, s):
        want[i] = (s, used[s])
        used[s], room[s] = used[s] + 1, room[s] - 1

    for a, (_, s) in enumerate(nodes):
        for _, i in sorted(arcs[a]):
            put(i, s) if room[s] else late.append((a, i))
    for a, i in late:
        put(i, next(s for k in range(1, len(nodes)) if room[s := nodes[(a + k) % len(nodes)][1]]))
    assert got == want


def test_placing_moves_little():
    nodes = sharding.ring(8, 64)
    counts = [rng.randrange(20, 60) for _ in nodes]
    n = sum(counts)
    owners = [s for _, s in nodes]
    ranges = sharding.place(counts, owners, [n // 8 + (s < n % 8) for s in range(8)])
    home = sum(hi - lo for arc, lo, hi, shard, _ in ranges if owners[arc] == shard)
    assert sum(hi - lo for _, lo, hi, _, _ in ranges) == n and home > 0.85 * n


def test_urls(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url")
    odd = [(9001, None), (9002, "no scheme"), (9003, "HTTP://WWW.Example.COM/en/x?q"), (9004, "http://notexample.com"), (9005, "x://a.net/es/1#f"), (9006, "x://blog.example.com/en/")]
    got = {r.page_id: r for r in urls.judge(pages.unionByName(spark.createDataFrame(odd, "page_id long, url string"))).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i, _ in odd] == [
        ("", "", None), ("", "", None), ("www.example.com", "/en/x", "www.example.com/en/"), ("notexample.com", "", None), ("a.net", "/es/1", "net/es/"), ("blog.example.com", "/en/", "example.com/en/"),
    ]
    assert all(r.verdict in ("allow", "block") for r in got.values()) and got[9003].verdict == "allow"
    assert urls.judge(pages.filter("false")).count() == 0


def test_url_model_tells_classes_apart():
    good = [f"https://lib.example.org/book/{i}" for i in range(300)]
    bad = [f"http://casino-win.example.org/spin?bonus={i}" for i in range(300)]
    models = urls.MarkovModel(good[:200]), urls.MarkovModel(bad[:200])
    assert (urls.score(models, good[200:]) > 0).all() and (urls.score(models, bad[200:]) < 0).all()


def test_url_cut_is_the_calibrated_one(spark, monkeypatch):
    monkeypatch.setattr(urls, "score", lambda models, some: np.array([0.5 if "good" in u else 0.1 for u in some]))
    labelled = spark.createDataFrame([(f"http://{kind}.example.org/{i}", kind == "good") for kind in ("good", "bad") for i in range(100)], "url string, good boolean")
    assert abs(urls.fit(labelled)[1] - 0.3) < 1e-9


def test_url_model_is_a_law_and_equals_the_plain_one():
    train = [f"http://a{i % 7}.example.org/{'xyz'[i % 3]}/{i * i}" for i in range(80)] + ["", "é"]
    model = urls.MarkovModel(train)
    seen = [Counter() for _ in range(urls.ORDER + 1)]
    for u in train:
        s = [0] * urls.ORDER + [min(b, urls.ALPHABET - 1) for b in u.encode()]
        for i in range(urls.ORDER, len(s)):
            for k in range(urls.ORDER + 1):
                seen[k][tuple(s[i - k : i]), s[i]] += 1

    def plain(context, x):
        p = 1 / urls.ALPHABET
        for k in range(urls.ORDER + 1):
            own = {y: n for (c, y), n in seen[k].items() if c == tuple(context[len(context) - k :])}
            if own:
                p = (own.get(x, 0) + len(own) * p) / (sum(own.values()) + len(own))
        return p

    for u in ("http://a3.example.org/x/49", "zzz", "http://é"):
        contexts, symbols = urls._contexts(*urls._codes([u]))
        s = [0] * urls.ORDER + symbols.tolist()
        want = [plain(s[i : i + urls.ORDER], s[i + urls.ORDER]) for i in range(len(symbols))]
        assert np.allclose(model.prob(contexts, symbols), want, rtol=1e-12, atol=0)
        for i in range(len(symbols)):
            every = model.prob([np.full(urls.ALPHABET, c[i]) for c in contexts], np.arange(urls.ALPHABET))
            assert abs(every.sum() - 1) < 1e-9 and every.min() > 0
    assert np.isfinite(urls.score((model, urls.MarkovModel(["http://b"])), ["", "x" * 5000, None, "\x00\x7f"])).all()


def test_url_scores_are_finite_and_rules_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{SMALL}/pages.parquet')")
    got = urls.op5_filter_urls(spark, SMALL).collect()
    assert all(np.isfinite(r.score) for r in got)
    rules = sorted(urls.RULES, key=lambda r: -len(r[1]))
    fits = [(k, r, f"(host = '{r.split('/')[0]}' OR ends_with(host, '.{r.split('/')[0]}')) AND starts_with(path, '/{r.split('/', 1)[1]}')") for k, r in rules]
    case = lambda i: "CASE " + " ".join(f"WHEN {f[2]} THEN '{f[i]}'" for f in fits) + " END"
    sql = f"""WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(regexp_extract(rest, '^[^/?#]*(.*)$', 1), '^[^?#]*') AS path FROM r)
    SELECT page_id, host, path, {case(1)} AS rule, {case(0)} AS said FROM h"""
    want = {r[0]: r[1:] for r in con.execute(sql).fetchall()}
    assert {r.page_id: (r.host, r.path, r.rule) for r in got} == {k: v[:3] for k, v in want.items()}
    assert all(r.verdict == want[r.page_id][3] for r in got if r.rule)
    made = [(f"https://{kind}.example.org/{word}/{i * 7919 % 1000}", kind == "lib") for kind, word in (("lib", "book"), ("win", "spin")) for i in range(400)]
    _, cut, lost, let = urls.fit(spark.createDataFrame(made, "url string, good boolean"))
    assert lost <= 0.05 and let <= 0.05 and np.isfinite(cut)


def test_quality(spark, docs, rows, none):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    got = {(r.d.doc_id, r.d.text): r.q for r in quality.judge(docs, labels).collect()}
    for d, t in rows:
        w, text = brute.words(t, False), t or ""
        grams = Counter(zip(w, w[1:], w[2:]))
        inside = {j + k for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if brute.WORD.search(line):
                dup += line in seen
                seen.add(line)
        q = got[d, t]
        assert (q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == (sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside))
        assert q.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w)) and not (q.kept and q.base_failed)
    trees = quality.fit(docs, labels)
    for d, t in rows:
        text = t or ""
        w, lines_ = brute.words(t, False), [x for x in text.split("\n") if brute.WORD.search(x)]
        n, size, k = len(w), max(1, len(text.encode())), max(1, len(w))
        q = got[d, t]
        share = lambda keep: sum(len(c.encode()) for c in text if keep(c)) / size
        x = [n, sum(map(len, w)) / k, q.n_symbols / k, (len(lines_) - len(set(lines_))) / max(1, len(lines_)), q.n_repeat_words / k, len(set(w)) / k, share(lambda c: "A" <= c <= "Z"), share(lambda c: "0" <= c <= "9"), text.count("!") / k, n / max(1, len(lines_)), sum(len(v.encode()) <= 3 for v in w) / k, sum(len(v.encode()) > 20 for v in w) / k]
        margin = trees.base
        for at in trees.roots:
            while trees.left[at] != at:
                at = trees.left[at] if x[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            margin += trees.value[at]
        assert abs(q.score - 1 / (1 + np.exp(-margin))) < 1e-9 and q.kept == (not q.base_failed and q.score >= 0.5)
    assert quality.judge(none, labels).count() == 0 and quality.judge(docs, labels.filter("false")).filter("q.kept").count() > 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_stages_bear_clashing_names_and_shared_ids(spark):
    base = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    made = base + [(None, base[0][1]), (None, base[1][1] + " more"), (None, None), (5, "another text of the same id"), base[3], (base[4][0], base[5][1])]
    names = ("q", "near_key", "near_tie", "removed", "line_doc_id", "leak_doc_id", "d", "n_doc", "n_key", "m_key", "m_row", "row", "class", "key")
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *([r] * len(names))) for r, (i, t) in enumerate(made)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    labels, bench = spark.read.parquet(f"{SMALL}/labels.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    whole = {r.row: r for r in df.collect()}
    good = {r.q.kept for r in quality.judge(df, labels).collect()}
    assert good == {True, False}
    for out in (quality.keep_good(df, labels), minhash.keep_one_each(df), decontaminate.drop_leaking(df, bench)):
        assert out.columns == df.columns and (rows := out.collect()) and all(r == whole[r.row] for r in rows)
    for out in (lines.drop_lines(df), mixing.mix_documents(df)):
        assert out.columns == df.columns and (rows := out.collect()) and all([r[n] for n in names] == [r.row] * len(names) and r.doc_id == whole[r.row].doc_id for r in rows)
    assert sharding.assign(df).count() == len(made)


def test_near_duplicates_of_null_and_shared_ids(spark):
    w = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(w), " ".join(w[:-1] + ["x"]), " ".join(f"u{i}" for i in range(30))
    made = [(5, a), (None, b), (None, c), (None, c + " y"), (7, "x " + " ".join(w[::-1])), (7, a), (8, ""), (None, None)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, 3, 85).collect())
    assert got == Counter([(5, 58, 5), (None, 58, 5), (None, 28, None), (None, 29, None), (7, 59, 7), (7, 58, 5), (8, 0, 8), (None, 0, None)])
    kept = Counter((r.doc_id, r.text) for r in minhash.keep_one_each(df, 3, 85).collect())
    assert kept[5, a] == kept[8, ""] == kept[None, None] == 1 and kept[None, c] + kept[None, c + " y"] == 1 and sum(kept.values()) == 5


def test_near_duplicates_in_rounds(spark):
    """Groups with chains, so that heads alone don't connect them, over several blocks and tasks."""
    made, g = [], random.Random(2)
    for k in range(6):
        w = [f"{k}w{i}" for i in range(50)]
        for j in range(40):
            w = w.copy()
            w[g.randrange(50)] = f"{k}n{j}"
            made.append((k * 100 + j, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(made, "doc_id long, text string"), 3, 85, block=4).collect()
    assert sorted(tuple(r)[:3] for r in got) == brute.near(made, 3, 85)


def test_near_duplicates_shuffle_only_the_texts_they_compare(spark):
    g = random.Random(5)
    made = [(i, " ".join(str(g.randrange(10**9)) for _ in range(3000))) for i in range(100)]
    made += [(1000 + i, t + " more") for i, t in made[:5]] + [(None, made[7][1] + " more")]
    df = spark.createDataFrame(made, "doc_id long, text string")
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    written = lambda: (lambda x: sum(x.apply(i).shuffleWriteBytes() for i in range(x.size())))(stages())
    before, held = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = minhash.near_duplicates(df, 3, 85).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert sorted((tuple(r)[:3] for r in got), key=str) == sorted([(i, 2998, i) for i in range(100)] + [(1000 + i, 2999, i) for i in range(5)] + [(None, 2999, 7)], key=str)
    assert written() - before < 0.8 * sum(len(t) for _, t in made)


def test_sieve_lets_all_wanted_rows_pass(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("doc_id"), (F.col("id") % 13).alias("key"))
    found = rows.filter("key = 3 or doc_id is null")
    for n in (1, 4000):
        got, want = Counter(tuple(r) for r in common.sieve(rows, found, ["doc_id", "key"], n).collect()), Counter(tuple(r) for r in found.collect())
        assert want <= got and got.total() < 1.1 * want.total()
    assert common.sieve(rows, rows.filter("false"), ["key"], 0).count() == 0


def test_trees_learn_and_obey_their_signs():
    g = np.random.default_rng(3)
    x = g.normal(size=(2000, 3))
    y = (x[:, 0] - x[:, 1] + 0.1 * g.normal(size=2000) > 0).astype(float)
    trees = quality.fit_trees(x[:1500], y[:1500], np.array([1, -1, 0]))
    assert (((trees.margin(x[1500:]) > 0) == (y[1500:] > 0)).mean()) > 0.9
    line = np.repeat(x[:1], 50, 0)
    for feature, sign in ((0, 1), (1, -1)):
        line[:] = x[:1]
        line[:, feature] = np.linspace(-3, 3, 50)
        assert (sign * np.diff(trees.margin(line)) >= -1e-12).all()


def test_language_model(docs, rows, none):
    got = sorted(tuple(r) for r in lm.score_documents(docs, 0.1, strength=50.0, prune=2).collect())
    want = brute.lm(rows, 50.0)
    key = lambda r: r[:5]
    assert sorted(map(key, got)) == sorted(map(key, want))
    for a, b in zip(sorted(got, key=lambda r: (*r[:5], r[5])), sorted(want, key=lambda r: (*r[:5], r[5]))):
        assert abs(a[5] - b[5]) < 1e-6 * a[2] and -1e-9 * a[2] <= b[6] - a[6] < 2e-4 * a[2] + 1e-6
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)
    assert lm.score_documents(none).count() == 0


def test_elias_fano():
    for n, bits in ((0, 20), (1, 20), (500, 12), (500, 48), (3000, 20), (700, 64)):
        values = np.sort(np.array([rng.randrange(1 << bits) for _ in range(n)], np.uint64))
        low, words, n, shift = lm.EliasFano.encode(values, bits)
        ef = lm.EliasFano(low, words, n, shift)
        ask = np.array([rng.randrange(1 << bits) for _ in range(400)] + values.tolist(), np.uint64)
        at = ef.successor(ask)
        assert at.tolist() == np.searchsorted(values, ask, "left").tolist()
        assert ef.holds(ask, at).tolist() == np.isin(ask, values).tolist()
        assert not n or ef.get(np.arange(n)).tolist() == values.tolist()


def test_trie_finds_what_it_holds_and_nothing_else():
    grams = sorted({(rng.randrange(1 << 63), rng.randrange(50)) for _ in range(300)} | {(c, rng.randrange(90)) for c in (5, 6, 1 << 62) for _ in range(60)})
    context, word = (np.array(x, np.uint64) for x in zip(*grams))
    count = np.array([rng.randrange(1, 9) for _ in grams])
    trie = lm.Trie.build(context, word, count, np.full(len(grams), 100), 50.0)
    ask = grams + [(c, w) for c in (5, 6, 7, 1 << 62, grams[0][0]) for w in range(120)]
    got = trie.log10(*(np.array(x, np.uint64) for x in zip(*ask)))
    held = dict(zip(grams, count.tolist()))
    for g, code in zip(ask, got.tolist()):
        assert (code == 65535) == (g not in held)
        assert code == 65535 or abs(10 ** (-lm.STEP * code) - held[g] / 150) < 1e-3 * held[g] / 150


def test_chat(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{SMALL}/conversations.parquet')")
    got = chat.op9_format_chat(spark, SMALL)
    rel = con.execute(chat.OP9_SQL)
    names = [d[0] for d in rel.description]
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(rel.fetchall())


def test_chat_parts_and_escapes(spark):
    part = lambda kind, **k: {"kind": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | k
    tricky = "</turn>\n<turn assistant>\\l\\b\\\\ <image:0>"
    turns = [
        (1, 0, "user", [part("text", text=tricky), part("image", ref="a.png", width=56, height=29), part("text", text="x")]),
        (1, 1, "assistant", [part("text", text=tricky)]),
        (1, 2, "us<er", [part("audio", ref="b.wav", seconds=2.0), part("document", ref="c.pdf", pages=2)]),
        (1, 3, None, None),
        (1, 4, "assistant", [part("text", text=None), part("text", text="é𝄞")]),
        (None, 0, "user", []),
    ]
    df = spark.createDataFrame(turns, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    out = {r.conv_id: r for r in chat.format_conversations(df).withColumn("read", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.masked(F.col("formatted"), F.col("loss_spans"))).collect()}
    one = out[1]
    assert one.loss == tricky + "é𝄞" and one.n_turns == 5
    assert [t.role for t in one.read] == ["user", "assistant", "us<er", "", "assistant"] and one.read[1].text == tricky
    assert [(a.turn, a["index"], a.ref, a.tokens) for a in one.attachments] == [(1, 0, "a.png", 4), (3, 1, "b.wav", 50), (3, 2, "c.pdf", 512)]
    assert one.attachment_tokens == 566 and out[None].n_turns == 1
    assert chat.format_conversations(df.filter("false")).count() == 0


def _line_groups(rows, percent=80):
    """Brute force over edit similarity alone, with a normaliser of its own: the occurrences (row, line) of each group of lines of five words or more."""
    plain = {c: chr(c + 32) for c in range(65, 91)} | {c: "0" for c in range(48, 58)} | {ord(c): " " for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"}
    where = defaultdict(list)
    for r, (_, t) in enumerate(rows):
        for k, line in enumerate((t or "").split("\n")):
            w = brute.WORD.findall(line.translate(plain))
            if len(w) >= 5:
                where[" ".join(w)].append((r, k))
    names = list(where)
    short = lambda a, b: min(len(a), len(b)) * 100 >= percent * max(len(a), len(b))
    links = [(i, j) for i, a in enumerate(names) for j, b in enumerate(names[:i]) if short(a, b) and 100 * brute.edits(a, b, False) <= (100 - percent) * max(len(a), len(b))]
    groups = defaultdict(list)
    for p, w in zip(brute.components(len(names), links), names):
        groups[p] += where[w]
    return [sorted(g) for g in groups.values()]


def _check_lines(spark, made, **options):
    """Of each brute-force group one occurrence stays, in a row with the least doc_id (null last); nothing else goes. Rows are told apart by a column of their own."""
    df = spark.createDataFrame([(i, t, r, "x", 7) for r, (i, t) in enumerate(made)], "doc_id long, text string, row long, removed string, line_doc_id int")
    kept = lines.drop_lines(df, **options)
    left = {r.row: r for r in kept.collect()}
    assert kept.columns == df.columns and len(left) == len(made)
    gone = {}
    for r, (i, t) in enumerate(made):
        assert (left[r].doc_id, left[r].removed, left[r].line_doc_id) == (i, "x", 7)
        now, out = left[r].text, []
        if t is None:
            assert now is None
            continue
        rest = now.split("\n") if now or not t else []
        for k, line in enumerate(t.split("\n")):  # the kept lines are a subsequence
            if rest and rest[0] == line:
                rest.pop(0)
            else:
                out.append(k)
        assert not rest
        gone[r] = set(out)
    found = dict(gone)
    age = lambda r: (made[r][0] is None, made[r][0] or 0)
    for group in _line_groups(made):
        kept = [(r, k) for r, k in group if k not in found[r]]
        assert len(kept) == 1 and age(kept[0][0]) == min(age(r) for r, _ in group), [made[r][1].split("\n")[k] for r, k in group]
        for r, k in group:
            found[r] = found[r] - {k}
    assert not any(found.values())
    listed = Counter((r.doc_id, r.n_lines, r.n_removed, len(r.removed)) for r in lines.dedup_lines(df, **options).collect())
    assert listed == Counter((i, len(t.split("\n")) if t else 0, len(gone.get(r, ())), len(gone.get(r, ()))) for r, (i, t) in enumerate(made))


def test_fuzzy_lines(spark, docs, none):
    g = random.Random(4)
    word = lambda: "".join(g.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(g.randrange(3, 9)))
    base = [[word() for _ in range(g.randrange(22, 40))] for _ in range(5)] + [["short", "line"]]
    made = []
    for i in range(70):
        t = []
        for _ in range(g.randrange(4)):
            w = list(g.choice(base))
            if g.random() < 0.6:
                w[g.randrange(len(w))] = word()
            t.append(" ".join(w).upper() if g.random() < 0.3 else " ".join(w) + g.choice(("", " .", "!")))
        made.append((g.choice((i, i, 7, None)), "\n".join(t)))  # ids that repeat, and null ones
    made += [(100, None), (101, ""), (None, None), (102, "\n\n"), made[0], made[5], made[5], (3, "a line that is the only one of its kind here"), (None, "another line that nobody else has at all ever")]
    _check_lines(spark, made)
    assert lines.drop_lines(none).count() == 0


def test_near_pairs_against_all_pairs():
    """Each pair of a bucket once, the longer line first; a first-round message has no labels, which would be the lines' hashes again."""
    g = np.random.default_rng(8)
    sim = g.integers(0, 1 << 63, 12, np.uint64)[g.integers(0, 12, 900)]
    for _ in range(7):
        sim ^= np.uint64(1) << g.integers(0, 64, 900).astype(np.uint64)
    length = np.where(g.random(900) < 0.9, g.integers(60, 90, 900), g.integers(1, 4000, 900)).astype(np.int32)
    got = [(int(a), int(b)) for k in range(4) for j in range(3) for x, y in lines.near_pairs(sim, length, k, j, 4, lines.LIMIT, 80) for a, b in zip(x, y)]
    assert all(length[a] >= length[b] for a, b in got)
    a, b = np.triu_indices(900, 1)
    low, high = np.minimum(length[a], length[b]), np.maximum(length[a], length[b])
    want = (np.bitwise_count(sim[a] ^ sim[b]) < lines.LIMIT) & (high - low <= 20 * high // 100)
    assert sorted((min(x), max(x)) for x in got) == list(zip(a[want].tolist(), b[want].tolist())) and want.sum() > 100
    cols = {"hash": pa.array(np.arange(900)), "sim": pa.array(sim.view(np.int64)), "length": pa.array(length), "more": pa.array(sim.view(np.int64))}
    (out,) = lines._deal(4, lines.LIMIT, 6)([pa.RecordBatch.from_pydict(cols)])
    messages = [units.unpack(m) for m in out.column("message").to_pylist()]
    assert {len(m) for m in messages} == {4} and sum(len(m[0]) for m in messages) == 12 * 900


def test_lines_meet_their_nearest_partner_first():
    """The line of least hash is 8 and 7 bits from the others, which are 1 bit apart: the first round names both partners, so fewer pairs are left to the second."""
    own, sim = np.array([50, 10, 60]), np.array([0, 0xFF, 1], np.uint64)
    message = units.pack(own, sim, np.full(3, 40, np.int32), np.zeros(3, np.uint64), own)
    got = []
    for bucket in (k * lines.LIMIT + j << 32 for k in range(4) for j in range(3)):
        got += lines._compare(4, lines.LIMIT, lines.SECOND, 80, True)((pa.scalar(bucket),), pa.table({"message": pa.array([message])})).to_pylist()
    assert {a: min(r["b"] for r in got if r["a"] == a) for a in (10, 50, 60)} == {10: 50, 50: 10, 60: 10}
    assert {a: min((r["bits"], r["near"]) for r in got if r["a"] == a) for a in (10, 50, 60)} == {10: (7, 60), 50: (1, 60), 60: (1, 50)}


def test_lines_of_rows_that_share_an_id(spark):
    one, two = "the unique line that nobody else has at all ever", "a line that is in both of these two texts here"
    _check_lines(spark, [(1, two + "\n" + one), (1, "more text of another kind that stands alone\n" + two), (None, one), (None, two + " again"), (None, "x")])


def test_lines_against_edit_similarity_alone(spark):
    g = random.Random(7)
    word = lambda: "".join(g.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(g.randrange(2, 9)))
    made = []
    for i in range(60):
        w = [word() for _ in range(g.randrange(8, 25))]
        x = w.copy()
        x[g.randrange(len(x))] = word()
        made += [(i, " ".join(w)), (1000 + i, " ".join(x))]
    want = {max(made[r][0] for r, _ in group) for group in _line_groups(made) if len(group) > 1}
    got, narrow = ({r.doc_id for r in lines.dedup_lines(spark.createDataFrame(made, "doc_id long, text string"), limit=a, second=b).filter("n_removed > 0").collect()} for a, b in ((lines.LIMIT, lines.SECOND), (4, 65)))
    assert got <= want and len(got) >= 0.85 * len(want) and len(narrow) < 0.5 * len(want)


def test_lines_of_equal_simhash_are_all_compared(spark):
    _check_lines(spark, [(i, " ".join(["buy"] * n)) for i, n in enumerate((5, 19, 20, 60, 61, 200, 201, 202))])


def test_simhash_pairs_are_all_found():
    sim = np.unique(np.array([rng.getrandbits(20) << 22 | rng.getrandbits(2) for _ in range(400)], np.uint64))
    want = {(int(a), int(b)) for i, a in enumerate(sim) for b in sim[i + 1 :] if bin(int(a ^ b)).count("1") < 4}
    got = Counter()
    for k in range(4):
        for a, b in zip(*lines.close_pairs(sim, k, 4)):
            got[tuple(sorted((int(a), int(b))))] += 1
    assert set(got) == want and set(got.values()) <= {1}


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first = docs
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == first.columns, name
        docs = p.cut(out, "test-stage")
    got = p.run(spark, SMALL).collect()
    crc = lambda t: zlib.crc32(t.encode())
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((r.doc_id, crc(r.text)) for r in docs.collect())
    # the stages again, plainly: near copies by brute force, edit distances of every item in every document, the mix by SQL
    good = {(r.doc_id, r.text) for r in quality.keep_good(first, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()}
    rows = [(r.doc_id, r.text, r.source) for r in first.collect() if (r.doc_id, r.text) in good]
    one = {c for _, _, c in brute.near([r[:2] for r in rows], 5, 80)}
    rows = [r for r in rows if r[0] in one]
    names: dict[str, int] = {}
    number = lambda t: np.array([names.setdefault(w, len(names)) for w in brute.words(t)], np.int64)
    items = [number(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    texts = [number(r[1]) for r in rows]
    away = edit_distances([i for i in items for _ in texts], [t for _ in items for t in texts], inside=True)[0].reshape(len(items), len(texts))
    rows = [r for k, r in enumerate(rows) if all(away[j, k] > len(i) * 20 // 100 for j, i in enumerate(items))]
    con = duckdb.connect()
    con.execute("create table documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("insert into documents values (?, ?, ?)", rows)
    want, whole = Counter(), {r[0]: r[1] for r in rows}
    for doc, size, taken in con.execute(f"select doc_id, size, taken from ({mixing.OP4_SQL})").fetchall():
        for _ in range(taken // size if size else 0):
            want[doc, crc(whole[doc])] += 1
        if size and taken % size:
            want[doc, crc("".join(re.findall(r"^[\x20\x09-\x0D]*|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", whole[doc])[: taken % size + 1]))] += 1
    assert Counter((r.doc_id, r.text_crc32) for r in got) == want
    assert hashlib.md5(repr(sorted(tuple(r) for r in got)).encode()).digest() == hashlib.md5(repr(sorted(tuple(r) for r in p.run(spark, SMALL).collect())).encode()).digest()
