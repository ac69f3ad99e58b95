"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

A window that verifies shares word shingles with the item, and cutting it down to its first and last shared shingle only
raises its similarity. So a document is reduced to hits (places of shingles that some item holds), hits that follow each
other without a gap or a repeat become runs, and windows reach from the start of a run to the end of a run, with 0.8 to
1.25 of the item's weight. For each start the end is taken that leaves the highest bound on the similarity. Windows get
a 192-bit SimHash, cut into twelve blocks: two prints within RADIUS bits differ in at most three bits of some block, which
is the join with the item's blocks. Weighted Jaccard similarity of whole windows then decides.

Only hits and windows are shuffled. Documents are scanned once for each KNOWN_ROWS shingles of the benchmark and once
more for the texts that hold a window.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.common import let, materialise, table

SHINGLE = 5
#: 64-bit words of a fingerprint, bits of a block, and bits that a block may differ in.
PRINT_WORDS, BLOCK_BITS, BLOCK_RADIUS = 3, 16, 3
BLOCKS = 64 * PRINT_WORDS // BLOCK_BITS
#: Hamming radius of the candidates, the most that the blocks guarantee: 47 of 192 bits. At similarity 0.8 (cosine 0.89)
#: about 29 bits differ, with a deviation of 5.
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Shingles of the benchmark that one scan looks for (its broadcast), and texts that the second scan looks for by broadcast.
KNOWN_ROWS, FOUND_ROWS = 1_000_000, 1_000_000
#: Parts of an item's length: starts of windows are at least one part apart, and runs longer than an item are cut by parts.
PARTS = 50


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(ws: Column) -> Column:
    """64-bit hashes of all runs of five words in order; a shorter text is one shingle, an empty one has none."""
    hashed = lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(SHINGLE)])
    return F.when(F.size(ws) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.greatest(F.size(ws) - SHINGLE, F.lit(0))), hashed)).when(
        F.size(ws) > 0, F.array(F.xxhash64(F.concat_ws(" ", ws), F.size(ws)))
    ).otherwise(F.array().cast("array<bigint>"))


def of_text(text: Column) -> Column:
    """Shingles of a text; the words are computed once."""
    return let(words(text), shingles)


def _digest(text: str) -> Column:
    """128 bits of a text as two longs."""
    return F.struct(F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), text).alias("y"))


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, sh): items with at least one word; item is a struct of its id and a digest, rows equal in both are one."""
    rows = benchmark.select(F.col(item_col).alias("id"), of_text(F.col(text_col)).alias("sh")).where(F.size("sh") > 0)
    return rows.select(F.struct("id", F.sha2(F.to_json(F.struct("sh")), 256).alias("no")).alias("item"), "sh").groupBy("item").agg(F.first("sh").alias("sh"))


def _weights(items: DataFrame) -> DataFrame:
    """(h, w): integer weight of a shingle by the items that hold it; shingles of no item weigh as much as rare ones."""
    df = items.select("item", F.explode(F.array_distinct("sh")).alias("h")).groupBy("h").agg(F.countDistinct("item").alias("df"))
    return df.select("h", F.when(F.col("df") <= 1, 4).when(F.col("df") <= 4, 2).otherwise(1).alias("w"))


def _weighted(sets: DataFrame, keys: list[str], weights: DataFrame) -> DataFrame:
    """(keys, h, w): summed weight of each shingle of each set."""
    rows = sets.select(*keys, F.explode("sh").alias("h"))
    return rows.join(weights, "h", "left").groupBy(*keys, "h").agg(F.sum(F.coalesce("w", F.lit(4)).cast("long")).alias("w"))


def simhash(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, print, total): SimHash; a bit is set where shingles with that bit hold more than half the weight.

    print is an array of PRINT_WORDS longs. The shingles of a set, no more than those of an item-sized window, are
    gathered in its row; counters are longs.
    """
    words_of = ", ".join(["h", *[f"xxhash64(h, {k})" for k in range(1, PRINT_WORDS)]])
    sets = weighted.groupBy(*keys).agg(F.sum("w").alias("total"), F.collect_list(F.expr(f"struct(array({words_of}) as hs, w)")).alias("held"))
    bit = "2 * aggregate(held, 0L, (a, x) -> a + (shiftrightunsigned(x.hs[k], j) & 1L) * x.w) > total"
    fingerprint = f"transform(sequence(0, {PRINT_WORDS - 1}), k -> aggregate(sequence(0, 63), 0L, (p, j) -> p | if({bit}, shiftleft(1L, j), 0L)))"
    return sets.select(*keys, F.expr(fingerprint).alias("print"), "total")


def _blocks(prints: DataFrame) -> DataFrame:
    """prints with one row for each block: b, v."""
    each = 64 // BLOCK_BITS
    block = lambda b: F.struct(F.lit(b).alias("b"), F.shiftrightunsigned(F.col("print")[b // each], b % each * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).alias("v"))
    return prints.select("*", F.explode(F.array(*[block(b) for b in range(BLOCKS)])).alias("blk")).select("*", "blk.b", "blk.v").drop("blk")


def _hits(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, t, at, h, w): places of known shingles in texts; t is the text's digest. One scan for each KNOWN_ROWS shingles."""
    passes = max(1, -(-weights.count() // KNOWN_ROWS))
    rows = docs.where(F.length("text") > 0).select("id", _digest("text").alias("t"), F.posexplode(of_text(F.col("text"))).alias("at", "h"))
    parts = [weights if passes == 1 else weights.where(F.pmod(F.xxhash64("h"), F.lit(passes)) == p) for p in range(passes)]
    return functools.reduce(DataFrame.unionByName, [rows.join(F.broadcast(part), "h").select("id", "t", "at", "h", "w") for part in parts])


def _windows(hits: DataFrame, postings: DataFrame, threshold: float) -> DataFrame:
    """(t, item, start, size): for each start the item-sized window with the highest bound on its similarity.

    Runs of a text and an item are gathered in one row, which a text's length bounds.
    """
    place = Window.partitionBy("t").orderBy("at")
    # shingles of several items weigh less than others; saved: what they take off the weight of the text so far
    lighter = hits.groupBy("t", "at").agg(F.first("h").alias("h"), F.first("w").alias("w")).withColumn("saved", F.sum(4 - F.col("w")).over(place))
    found = lighter.join(postings, "h")
    ordered = Window.partitionBy("t", "item").orderBy("at")
    # a run ends at a gap and where a shingle returns that the text held less than an item's length ago
    found = found.withColumn("last", F.lag("at").over(ordered)).withColumn("seen", F.lag("at").over(Window.partitionBy("t", "item", "h").orderBy("at")))
    breaks = F.col("last").isNull() | (F.col("at") != F.col("last") + 1) | (F.col("at") - F.col("seen") < F.col("m"))
    found = found.withColumn("island", F.sum(breaks.cast("int")).over(ordered))
    island = Window.partitionBy("t", "item", "island")
    inside = F.col("at") - F.min("at").over(island)
    part = F.greatest(F.floor(F.col("m") / PARTS), F.lit(1)).cast("int")
    piece = F.when(F.count("*").over(island) > F.col("m") * 1.25, F.floor(inside / part)).otherwise(F.lit(0))
    runs = found.withColumn("piece", piece).groupBy("t", "item", "m", "mass", "island", "piece").agg(
        F.min("at").alias("lo"), F.max("at").alias("hi"), F.min(F.struct("at", (F.col("saved") - (4 - F.col("w"))).alias("x")))["x"].alias("before"), F.max(F.struct("at", "saved"))["saved"].alias("after"), F.sum("w").alias("shared"))
    of_text = Window.partitionBy("t", "item").orderBy("lo")
    runs = runs.withColumn("upto", F.sum("shared").over(of_text)).withColumn("part", F.floor(F.col("lo") / part)).withColumn("starts", F.row_number().over(Window.partitionBy("t", "item", "part").orderBy("lo")) == 1)
    listed = runs.groupBy("t", "item", "m", "mass").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "before", "after", "shared", "upto", "starts"))).alias("runs"))
    # weight between run r and run q, and what of it they share with the item at most
    weight = lambda r, q: (q["hi"] - r["lo"] + 1) * 4 - (q["after"] - r["before"])
    common = lambda r, q: F.least(q["upto"] - r["upto"] + r["shared"], F.col("mass"))
    bound = lambda r, q: common(r, q) / (weight(r, q) + F.col("mass") - common(r, q))
    fits = lambda r, q: (q["hi"] >= r["hi"]) & (weight(r, q) >= F.col("mass") * threshold) & (weight(r, q) <= F.col("mass") / threshold)
    best = lambda r: F.array_max(F.transform(F.filter("runs", lambda q: fits(r, q)), lambda q: F.struct(bound(r, q).alias("bound"), (r["lo"] - q["hi"] - 1).alias("shorter"), r["lo"].alias("start"))))
    windows = F.filter(F.transform(F.filter("runs", lambda r: r["starts"]), best), lambda b: b.isNotNull())
    return listed.select("t", "item", F.explode(windows).alias("win")).select("t", "item", "win.start", (-F.col("win.shorter")).alias("size")).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(id, item, start, n_words, similarity): each document and benchmark item with a window of similarity >= threshold.

    start (in words, from 0) and n_words are those of the best window (ties: the leftmost, then the shortest).
    Similarity is weighted Jaccard over five-word shingles, repeats counted; a shingle weighs 4, or 2 or 1 where several
    items hold it. Windows are those described above: all that matter where the text repeats no shingle of the item
    within the window; of windows with repeats one for each start is tried. Candidates lie within RADIUS of the item's
    fingerprint. Texts of fewer than five words are one shingle. Null and empty texts and items link with nothing, and
    without items or documents there are no rows. Rows that share an id (null included) count as one document; equal
    texts are compared once. Items that share an id are compared one by one. Other columns are not read.
    """
    items = materialise(_items(benchmark, item_col, item_text_col))
    weights = materialise(_weights(items))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hits = materialise(_hits(source, weights))
    i_rows = materialise(_weighted(items, ["item"], weights))
    named = items.join(i_rows.groupBy("item").agg(F.sum("w").alias("mass")), "item")
    postings = materialise(named.select("item", F.size("sh").alias("m"), "mass", F.explode(F.array_distinct("sh")).alias("h")))
    windows = materialise(_windows(hits, postings, threshold))
    # the texts that hold a window, one row of each
    holders = hits.groupBy("t").agg(F.min_by(F.struct("id"), F.xxhash64("id")).alias("one")).join(windows.select("t").distinct(), "t", "left_semi").select("t", "one.id", F.col("t.x").alias("k"))
    holders = materialise(holders)
    texts = source.where(F.length("text") > 0).select("id", _digest("text").alias("t"), "text").withColumn("k", F.col("t.x"))
    keys = holders.select("k").distinct()
    texts = texts.join(F.broadcast(keys) if holders.count() <= FOUND_ROWS else keys, "k", "left_semi")
    texts = texts.join(holders.select(F.col("t").alias("t2"), F.col("id").alias("id2")), (F.col("t") == F.col("t2")) & F.col("id").eqNullSafe(F.col("id2")), "left_semi").select("t", "text").dropDuplicates(["t"])
    placed = windows.join(texts.select("t", of_text(F.col("text")).alias("sh")), "t").select("t", "item", "start", "size", F.slice("sh", F.col("start") + 1, F.col("size")).alias("sh"))
    # a passage that many texts share is one window from here on
    placed = materialise(placed.withColumn("win", F.sha2(F.to_json(F.struct("sh")), 256)))
    w_rows = materialise(_weighted(placed.groupBy("win").agg(F.first("sh").alias("sh")), ["win"], weights))
    prints = _blocks(materialise(simhash(w_rows, ["win"])))
    i_prints = materialise(simhash(i_rows, ["item"]).select("item", "print", F.col("total").alias("item_total")))
    i_blocks = _blocks(i_prints).select("item", F.col("print").alias("item_print"), "item_total", "b", F.col("v").alias("item_v"))
    asked = placed.select("win", "item").distinct()
    near = asked.join(prints, "win").join(i_blocks, ["item", "b"]).where(F.bit_count(F.col("v").bitwiseXOR(F.col("item_v"))) <= BLOCK_RADIUS)
    distance = sum(F.bit_count(F.col("print")[k].bitwiseXOR(F.col("item_print")[k])) for k in range(PRINT_WORDS))
    near = near.where(distance <= RADIUS).select("win", "item", "total", "item_total").distinct()
    shared = near.join(w_rows, "win").join(i_rows.withColumnRenamed("w", "wi"), ["item", "h"]).groupBy("win", "item", "total", "item_total").agg(F.sum(F.least("w", "wi")).alias("both"))
    similarity = F.col("both") / (F.col("total") + F.col("item_total") - F.col("both"))
    verified = shared.withColumn("similarity", similarity).where(F.col("similarity") >= threshold).select("win", "item", "similarity")
    links = placed.select("t", "item", "win", "start", "size").join(verified, ["win", "item"])
    owners = hits.select("id", "t").distinct()
    links = links.join(owners, "t").select("id", F.col("item.id").alias("item"), "start", (F.col("size") + SHINGLE - 1).alias("n_words"), "similarity")
    best = links.groupBy("id", "item").agg(F.max_by(F.struct("start", "n_words", "similarity"), F.struct("similarity", -F.col("start"), -F.col("n_words"))).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("b.start").cast("long").alias("start"), F.col("b.n_words").cast("long").alias("n_words"), F.col("b.similarity").alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows of contaminated documents, all columns kept."""
    found = contaminated(docs, benchmark, id_col, text_col, **options).select(F.col(id_col).alias("_found")).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(found["_found"]), "left_anti")


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Documents that hold a passage like a benchmark item, with the item and the place."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
