"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (DataFrame functions only).

Documents get a pseudo-random key, the first 60 bits of an MD5 of seed and doc_id. A source's key range is cut into
2**b equal blocks of about ``block_docs`` documents; as keys are random, key order is a random permutation and
each block a random draw without replacement. A source draws its blocks in that order, pass after pass, until its word target is met: draw number
pass * 2**b + block. That number of draws is the source's exact quota; the last draw gives only the words that are missing, the last document of it a part of its words.

The draws, repeats included, are dealt to output shards by a binary tree: at each node the number that goes left is
fixed by the shard counts, and how many of them come from each source follows the multivariate hypergeometric
law, drawn source by source by inverting the hypergeometric distribution function. The counts per leaf add up to the exact quotas,
and a source's permuted draws are handed to the leaves in order, so leaves hold disjoint draws. What is taken of a document is the sum over its block's draws
in the leaves. Within a shard, ``order_key`` gives the local shuffle, by which mix_documents orders its rows.

Blocks' sums are accumulated in two levels (groups of about the root of a source's blocks, and blocks within a group); within a block, a window ranks its few
documents. So a source that holds most of all rows is spread over its blocks, and no task meets a whole source. One row a source is held together (targets, tree
nodes): sources are taken to be few enough for one task, some 100,000.

Edge cases: a null or empty text has size 0 and is never taken; a null source is a source of its own, last in order; rows with a null doc_id get their key from their text;
repeated rows are separate documents (rows of equal id and text are equal in order, so any of them may be the one taken); an empty table gives an empty result;
columns other than doc_id, source, text are not looked at, but mix_documents counts n_chars anew where it cuts a text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packframe.llm.common import cut, n_words, parts, table

SEED = "mix-1"
KEY_BITS = 60
MAX_REPEAT = 3


def doc_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """The first 15 hex digits of md5(seed:doc_id) as an integer below 2**60; without an id, of md5(seed:md5(text))."""
    name = F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), name)), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = MAX_REPEAT) -> DataFrame:
    """sources (source, source_size) with target: shares by weight of the total, none above cap * source_size.

    With sources by cap / weight ascending, those that hit their cap are a prefix: a source is capped if its cap per
    weight lies below the level that the rest would have. One row per source: the window is over a short table."""
    every = Window.partitionBy()
    order = every.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    by_ratio = every.orderBy("ratio", "pos").rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("pos") % len(weights) + 1).cast("int")).cast("double")
    x = sources.withColumn("pos", F.row_number().over(order) - 1).withColumn("weight", w)
    x = x.withColumn("top", (F.col("source_size") * cap).cast("double")).withColumn("ratio", F.col("top") / F.col("weight"))
    x = x.withColumn("all", F.sum("source_size").over(every).cast("double")).withColumn("w_all", F.sum("weight").over(every))
    x = x.withColumn("top_before", F.coalesce(F.sum("top").over(by_ratio), F.lit(0.0))).withColumn("w_before", F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
    x = x.withColumn("level", (F.col("all") - F.col("top_before")) / (F.col("w_all") - F.col("w_before")))
    x = x.withColumn("free", F.col("level") <= F.col("ratio"))
    level = F.min(F.when(F.col("free"), F.struct("ratio", "pos", "level"))).over(every)["level"]
    return x.select("source", "source_size", "weight", "pos", F.least("top", F.coalesce(level, F.lit(0.0)) * F.col("weight")).alias("target"))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _ln_factorial(n: Column) -> Column:
    """Stirling's series at n + 9, less the logarithm of the eight factors that were added."""
    return _let(n.cast("double"), lambda x: _let(x + 9, lambda z: (z - 0.5) * F.log(z) - z + 1 / (12 * z) - 1 / (360 * z * z * z)) - F.log((x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7) * (x + 8)))


def _uniform(*what: Column) -> Column:
    return (F.conv(F.substring(F.md5(F.concat_ws("/", *what)), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """The u-quantile of the good ones among draws from total. Only the support within 9 standard deviations of the mean is
    summed; the law is normalised there."""
    weight = lambda k: -(_ln_factorial(k) + _ln_factorial(good - k) + _ln_factorial(draws - k) + _ln_factorial(total - good - draws + k))
    mean = draws * good / F.greatest(total, F.lit(1))
    reach = 9 * F.sqrt(mean * (1 - good / F.greatest(total, F.lit(1))) + 1)
    lo = F.greatest(F.lit(0), draws + good - total, F.floor(mean - reach)).cast("long")
    hi = F.least(draws, good, F.ceil(mean + reach)).cast("long")
    mode = lambda r: F.least(r["hi"], F.greatest(r["lo"], F.floor((draws + 1) * (good + 1) / (total + 2)).cast("long")))

    def pick(g: Column) -> Column:
        return F.aggregate(
            g,
            F.struct((u * F.aggregate(g, F.lit(0.0), lambda a, x: a + x["p"])).alias("left"), F.lit(None).cast("long").alias("k")),
            lambda a, x: F.struct((a["left"] - x["p"]).alias("left"), F.coalesce(a["k"], F.when(a["left"] <= x["p"], x["k"])).alias("k")),
            lambda a: F.coalesce(a["k"], F.element_at(g, -1)["k"]),
        )

    def draw(r: Column) -> Column:
        grid = lambda peak: F.transform(F.sequence(r["lo"], F.greatest(r["lo"], r["hi"])), lambda k: F.struct(k.alias("k"), F.exp(weight(k) - peak).alias("p")))
        return _let(_let(weight(mode(r)), grid), pick)

    return _let(F.struct(lo.alias("lo"), hi.alias("hi")), draw)


def split_tree(quotas: DataFrame, shards: int, seed: str = SEED) -> DataFrame:
    """quotas (pos, draws) -> (pos, shard, first, last): the draws [first, last) of source pos that go to shard.

    One row per node and level; a node holds a short array, an entry per source. Left takes draws in proportion to its shards."""
    node = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("pos", F.col("draws").cast("long").alias("n")))).alias("have"))
    node = node.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "have")
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x["n"])
    entry, pair = "array<struct<pos:int,n:bigint>>", "array<struct<pos:int,l:bigint,r:bigint>>"

    def dealt(a: Column, x: Column) -> Column:
        k = hypergeometric(a["rest"], x["n"], a["want"], _uniform(F.lit(seed), F.col("lo"), F.col("hi"), x["pos"]))
        add = lambda k: F.concat(a["out"], F.array(F.struct(x["pos"].alias("pos"), k.alias("l"), (x["n"] - k).alias("r"))))
        return _let(k, lambda k: F.struct((a["rest"] - x["n"]).alias("rest"), (a["want"] - k).alias("want"), add(k).cast(pair).alias("out")))

    side = lambda s, f: F.transform(s, lambda x: F.struct(x["pos"].alias("pos"), x[f].alias("n"))).cast(entry).alias("have")
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    want = F.floor(F.col("all") * (F.col("mid") - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("long")
    halves = F.aggregate("have", F.struct(F.col("all").alias("rest"), want.alias("want"), F.array().cast(pair).alias("out")), dealt, lambda a: a["out"])
    both = _let(halves, lambda s: F.array(F.struct(F.col("lo").alias("lo"), F.col("mid").alias("hi"), side(s, "l")), F.struct(F.col("mid").alias("lo"), F.col("hi").alias("hi"), side(s, "r"))))
    for _ in range(math.ceil(math.log2(max(2, shards)))):
        node = node.withColumn("mid", mid).withColumn("all", total(F.col("have")))
        # a node of one shard sends nothing left; written, else the optimiser would repeat a level's draws in the next
        node = cut(node.select(F.inline(both)).filter("lo < hi"), "mix-nodes")
    leaf = node.select(F.col("lo").alias("shard"), F.inline("have"))
    upto = Window.partitionBy("pos").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    return leaf.withColumn("last", F.sum("n").over(upto)).select("pos", "shard", (F.col("last") - F.col("n")).alias("first"), "last")


CHUNK = 256  # draws: leaves and draws meet by source and chunk of draws


def _blocks(known: DataFrame) -> DataFrame:
    """pos, block, words_before (of the source's earlier blocks), passes, rest (words of the last pass) and n_blocks (of the source) of each block that has words."""
    sums = known.groupBy("pos", "block", "source_size", "target", "bits").agg(F.sum("size").alias("block_size"))
    group = F.expr("shiftright(block, cast(bits / 2 as int))")
    sums = sums.withColumn("group", group)
    upto = Window.partitionBy("pos").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("pos", "group").agg(F.sum("block_size").alias("group_size"))
    groups = groups.select("pos", "group", F.coalesce(F.sum("group_size").over(upto), F.lit(0)).alias("base"))
    inside = Window.partitionBy("pos", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    x = sums.withColumn("inner", F.coalesce(F.sum("block_size").over(inside), F.lit(0))).join(groups, ["pos", "group"])
    want = F.floor(F.col("target") + 0.5).cast("long")
    x = x.withColumn("words_before", F.col("base") + F.col("inner")).withColumn("passes", F.floor(want / F.col("source_size")).cast("long"))
    return x.withColumn("rest", want - F.col("passes") * F.col("source_size")).select("pos", "block", "words_before", "passes", "rest", F.expr("shiftleft(1L, bits)").alias("n_blocks"))


def draws(blocks: DataFrame, shards: int, seed: str = SEED) -> DataFrame:
    """blocks -> pos, block, draws: an array of (pass, shard), an entry for each time that the block is drawn."""
    last = F.max(F.when(F.col("words_before") < F.col("rest"), F.col("block") + 1).otherwise(0))
    quotas = blocks.groupBy("pos").agg((F.first("passes") * F.first("n_blocks") + last).alias("draws"))
    leaves = split_tree(quotas, shards, seed).filter("first < last")
    chunks = leaves.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("first") / CHUNK), F.floor((F.col("last") - 1) / CHUNK))))
    times = F.col("passes") + F.when(F.col("words_before") < F.col("rest"), 1).otherwise(0)
    each = blocks.filter(times > 0).withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), times - 1))).withColumn("draw", F.col("pass") * F.col("n_blocks") + F.col("block"))
    each = each.select("pos", "block", "pass", "draw", F.floor(F.col("draw") / CHUNK).alias("chunk"))
    dealt = each.join(chunks, ["pos", "chunk"]).filter("first <= draw and draw < last")
    return dealt.groupBy("pos", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("draws"))  # cap + 1 entries at most


def assign(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = MAX_REPEAT, block_docs: int = 256, shards: int = 16, seed: str = SEED) -> DataFrame:
    """Per row of docs: doc_id, source, text_key, key, size, source_size, target, taken, at (words of its source before it) and drawn: an array of
    (shard, words, pass), an entry for each draw that takes words of it."""
    slim = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_key"), doc_key(F.col("doc_id"), F.col("text"), seed).alias("key"))
    slim = cut(slim, "mix-sizes")
    per = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    bits = F.least(F.lit(30), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / float(block_docs))))).cast("int")
    per = cut(targets(per, weights, cap).join(per.select(F.col("source").alias("s2"), bits.alias("bits")), F.col("source").eqNullSafe(F.col("s2"))).select("source", "source_size", "target", "pos", "bits"), "mix-sources")
    known = slim.join(per, slim["source"].eqNullSafe(per["source"])).drop(per["source"])
    known = known.withColumn("block", F.expr(f"shiftright(key, {KEY_BITS} - bits)"))
    blocks = cut(_blocks(known.filter("size > 0")), "mix-blocks")
    dealt = blocks.join(draws(blocks, shards, seed), ["pos", "block"], "left").drop("n_blocks")
    inside = Window.partitionBy("pos", "block").orderBy("key", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    x = known.filter("size > 0").withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(dealt, ["pos", "block"]).withColumn("at", F.col("words_before") + F.col("inner"))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("at")))
    drawn = F.transform(F.coalesce("draws", F.array().cast("array<struct<pass:bigint,shard:int>>")), lambda d: F.struct(d["shard"].alias("shard"), F.when(d["pass"] < F.col("passes"), F.col("size")).otherwise(part).alias("words"), d["pass"].alias("pass")))
    x = x.withColumn("drawn", F.filter(drawn, lambda d: d["words"] > 0))
    names = ["doc_id", "source", "text_key", "key", "size", "source_size", "target", "at", "drawn"]
    zero = known.filter("size = 0").withColumn("at", F.lit(0).cast("long")).withColumn("drawn", F.array().cast("array<struct<shard:int,words:bigint,pass:bigint>>"))
    both = x.select(*names).unionByName(zero.select(*names))
    return both.withColumn("taken", F.aggregate("drawn", F.lit(0).cast("long"), lambda a, d: a + d["words"]))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draws of each document: doc_id, shard, pass, words, order_key."""
    x = assign(table(spark, sf_dir, "documents")).select("doc_id", "key", F.explode("drawn").alias("d"))
    return x.select("doc_id", "d.shard", "d.pass", "d.words", _order_key(F.col("d.shard"), F.col("d.pass"), F.col("key")).alias("order_key"))


def _order_key(shard: Column, turn: Column, key: Column, seed: str = SEED) -> Column:
    return F.xxhash64(F.lit(seed), shard, turn, key)


def mix_documents(docs: DataFrame, shards: int = 16, seed: str = SEED, **options) -> DataFrame:
    """The mix itself, with the columns of docs: a document comes once for each draw that takes it, cut after the words that its source still needs where a target ends
    inside it. Rows are partitioned by output shard (several partitions a shard) and shuffled within."""
    names, kinds = docs.columns, dict(docs.dtypes)
    planned = assign(docs, shards=shards, seed=seed, **options).filter("taken > 0")
    copies = Window.partitionBy("doc_id", "source", "text_key").orderBy("at")
    planned = planned.select(F.col("doc_id").alias("m_doc"), F.col("source").alias("m_source"), F.col("text_key").alias("m_key"), "size", "drawn", F.col("key").alias("m_place"), F.row_number().over(copies).alias("m_row"))
    own = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("d"))
    own = own.withColumn("m_key", F.xxhash64(F.col("d")["text"]))
    own = own.withColumn("m_row", F.row_number().over(Window.partitionBy(F.col("d")["doc_id"], F.col("d")["source"], "m_key").orderBy("m_key")))
    both = own.join(planned, own["d"]["doc_id"].eqNullSafe(planned["m_doc"]) & own["d"]["source"].eqNullSafe(planned["m_source"]) & (own["m_key"] == planned["m_key"]) & (own["m_row"] == planned["m_row"]))
    both = both.select("d", "size", "m_place", F.explode("drawn").alias("m")).select("d", "size", F.col("m.words").alias("m_words"), F.col("m.shard").alias("m_shard"), _order_key(F.col("m.shard"), F.col("m.pass"), F.col("m_place"), seed).alias("m_order"))
    whole = F.col("m_words") == F.col("size")
    cut_text = F.expr(r"array_join(slice(split(d.text, '(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])'), 1, cast(m_words as int) + if(d.text rlike '^[\\x20\\x09-\\x0D]', 1, 0)), '')")
    n = parts(docs, 32.0)
    each = max(1, n // shards)  # partitions of a shard
    both = both.withColumn("m_text", F.when(~whole, cut_text)).repartition(max(n, shards), "m_shard", F.pmod("m_order", F.lit(each))).sortWithinPartitions("m_shard", "m_order")
    new = {"text": F.coalesce("m_text", F.col("d")["text"])} | ({"n_chars": F.when(whole, F.col("d")["n_chars"]).otherwise(F.char_length("m_text")).cast(kinds["n_chars"])} if "n_chars" in names else {})
    return both.select(*[new.get(n, F.col("d")[n]).alias(n) for n in names])


OP4_SQL = """
WITH s AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 15))::BIGINT AS key
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS pos FROM per),
r AS (SELECT *, [5.0, 2.0, 1.0][(pos % 3 + 1)::INT]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS top FROM w),
q AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS total, sum(weight) OVER () AS w_all,
        coalesce(sum(top) OVER p, 0) AS top_before, coalesce(sum(weight) OVER p, 0) AS w_before
      FROM r WINDOW p AS (ORDER BY top / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT arg_min((total - top_before) / (w_all - w_before), (top / weight, pos)) AS level FROM q WHERE (total - top_before) / (w_all - w_before) <= top / weight),
t AS (SELECT source, source_size, least(top, coalesce(level, 0) * weight) AS target FROM q, lev),
d AS (SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS want,
        coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS upto
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  ((CASE WHEN source_size > 0 THEN want // source_size ELSE 0 END) * size
   + least(size, greatest(0, want - (CASE WHEN source_size > 0 THEN want // source_size ELSE 0 END) * source_size - upto)))::BIGINT AS taken
FROM d"""
