"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified exactly.

Documents are compared by weighted Jaccard similarity of five-word shingles. A shingle weighs its count in the
document times 1 + IDF_SHARE * idf, with idf between 0 (in every document) and 1: a plain idf would weigh what
thousands of copies share next to nothing and so make copies of a large group unlike each other.

Only sample bands are shuffled for all documents. In a bucket of equal bands every member is compared with one
leader, the text that agrees with most others; members unlike it go on among themselves for some rounds more. Pairs
of a bucket that this leaves in different components are searched by what each member changes in the text of its
first leader: two members can only be alike if they share enough changes, so a prefix of the changes, rarest first,
finds every such pair without listing the rest (see _changes).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import components, drop, hot_keys, materialise, renew, spread_join, table

SEED = 20240607
#: Bands of the signature and samples per band: a pair at similarity 0.8 meets in a band with probability 0.998.
BANDS, ROWS = 12, 4
#: Buckets into which shingles are hashed for the random variates of the sampling.
VARIATES = 1 << 16
#: Counters of the document-frequency sketch, and blocks it travels in. Its relative error is the number of
#: shingles of a document over the counters, whatever the number of documents.
COUNTERS, PARTS = 1 << 22, 64
IDF_SHARE = 0.25
#: Rounds in which members unlike their leader get another one; the search by changes finds all links after any number.
STAR_ROUNDS = 3
#: Bits of the map of a member's changes.
MAP_BITS = 1024


class Weigher:
    """Weighted shingle sets of texts; holds the document-frequency sketch."""

    def __init__(self, sketch, documents: int):
        self.sketch, self.documents = sketch, documents

    def weigh(self, shingles):
        """(sorted distinct shingles, weights)."""
        import numpy as np

        u, tf = np.unique(shingles, return_counts=True)
        if not len(u):
            return u, tf.astype(np.float64)
        df = np.minimum(self.sketch[(u >> np.uint64(42)).astype(np.int64)], self.documents)
        idf = np.log((self.documents + 1) / (df + 1)) / np.log(self.documents + 2)
        return u, tf * (1 + IDF_SHARE * idf)

    def of_text(self, text: str | None):
        import numpy as np

        from textmill.llm.tokens import ALNUM, shingle_hashes, word_hashes

        data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
        return self.weigh(shingle_hashes(word_hashes(data, ALNUM)[0]))


def weighted_jaccard(a, b) -> float:
    """Sum of the smaller over sum of the larger weights; 0 where either set is empty."""
    import numpy as np

    (ua, wa), (ub, wb) = a, b
    if not len(ua) or not len(ub):
        return 0.0
    _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    both = float(np.minimum(wa[i], wb[j]).sum())
    return both / (float(wa.sum()) + float(wb.sum()) - both)


class Sampler:
    """Improved consistent weighted sampling with BANDS * ROWS samples (Ioffe 2010)."""

    def __init__(self):
        import numpy as np

        rng = np.random.default_rng(SEED)
        shape = (VARIATES, BANDS * ROWS)
        self.r = rng.gamma(2.0, 1.0, shape).astype(np.float32)
        self.lnc = np.log(rng.gamma(2.0, 1.0, shape)).astype(np.float32)
        self.beta = rng.random(shape).astype(np.float32)
        self.salt = rng.integers(1, 1 << 62, BANDS * ROWS).astype(np.uint64) | np.uint64(1)

    def bands(self, shingles, weights):
        """One 64-bit key per band; the keys of two sets agree in a sample with probability of their similarity."""
        import numpy as np

        from textmill.llm.tokens import mix

        low = np.full(BANDS * ROWS, np.inf, np.float32)
        code = np.zeros(BANDS * ROWS, np.uint64)
        lnw = np.log(weights).astype(np.float32)
        for at in range(0, len(shingles), 2048):
            part = shingles[at : at + 2048]
            bucket = (part & np.uint64(VARIATES - 1)).astype(np.int64)
            r, beta = self.r[bucket], self.beta[bucket]
            t = np.floor(lnw[at : at + 2048, None] / r + beta)
            a = self.lnc[bucket] - r * (t - beta + 1)
            best = a.argmin(axis=0)
            k = np.arange(BANDS * ROWS)
            least = a[best, k]
            new = mix(part[best] + t[best, k].astype(np.int64).astype(np.uint64) * self.salt)
            code = np.where(least < low, new, code)
            low = np.minimum(least, low)
        key = np.zeros(BANDS, np.uint64)
        for j in range(ROWS):
            key = key * np.uint64(0x9FB21C651E98DF25) + code[j::ROWS]
        return mix(key + np.arange(BANDS, dtype=np.uint64))


def document_frequencies(docs: DataFrame, text_col: str) -> Weigher:
    """The sketch over all documents: each task counts into one array, and equal parts of the arrays are summed."""
    import numpy as np

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from textmill.llm.tokens import ALNUM, shingle_hashes, slices, word_hashes

        sketch, documents = np.zeros(COUNTERS, np.int32), 0
        for batch in batches:
            for first, last, data, at in slices(batch.column(0).to_pylist()):
                words, starts = word_hashes(data, ALNUM)
                bounds = [*np.searchsorted(starts, at).tolist(), len(words)]
                for k in range(last - first):
                    s = np.unique(shingle_hashes(words[bounds[k] : bounds[k + 1]]))
                    if len(s):
                        documents += 1
                        np.add.at(sketch, (s >> np.uint64(42)).astype(np.int64), 1)
        width = COUNTERS // PARTS
        parts = [sketch[p * width : (p + 1) * width] for p in range(PARTS)]
        rows = [(p, zlib.compress(part.tobytes(), 1), documents if p == 0 else 0) for p, part in enumerate(parts) if p == 0 or part.any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.int64()))], names=["part", "counts", "documents"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(c.as_py()), np.int32).astype(np.int64) for c in table.column("counts"))
        total = np.minimum(total, np.iinfo(np.int32).max).astype(np.int32)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary()), "documents": pa.array([sum(table.column("documents").to_pylist())], pa.int64())})

    schema = "part int, counts binary, documents bigint"
    parts = docs.select(text_col).mapInArrow(count, schema).groupBy("part").applyInArrow(add, schema).collect()  # PARTS rows at most
    sketch = np.zeros(COUNTERS, np.int32)
    width = COUNTERS // PARTS
    for p in parts:
        sketch[p["part"] * width : (p["part"] + 1) * width] = np.frombuffer(zlib.decompress(p["counts"]), np.int32)
    return Weigher(sketch, sum(p["documents"] for p in parts))


def _node(id_col: str, text_col: str):
    """Key of a text: equal texts share it; a null or empty text has one for each id, so that it links with nothing."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.when(text != "", F.substring(F.sha2(text, 256), 1, 32)).otherwise(F.concat(F.lit("empty:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))


def signatures(docs: DataFrame, weigher, id_col: str, text_col: str) -> DataFrame:
    """(id, node, bands) of every row; texts without words have no bands."""
    rows = docs.select(F.col(id_col).alias("id"), _node(id_col, text_col).alias("node"), F.col(text_col).alias("text"))
    names = ["id", "node", "bands"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from textmill.llm.tokens import ALNUM, shingle_hashes, slices, word_hashes

        sampler, w = Sampler(), Weigher(*weigher.value)
        for batch in batches:
            bands: list = []
            for first, last, data, at in slices(batch.column("text").to_pylist()):
                words, starts = word_hashes(data, ALNUM)
                bounds = [*np.searchsorted(starts, at).tolist(), len(words)]
                for k in range(last - first):
                    u, weights = w.weigh(shingle_hashes(words[bounds[k] : bounds[k + 1]]))
                    bands.append(sampler.bands(u, weights).view(np.int64) if len(u) else [])
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("node"), pa.array(bands, pa.list_(pa.int64()))], names=names)

    return rows.mapInArrow(sign, f"id {rows.schema['id'].dataType.simpleString()}, node string, bands array<bigint>")


def _verify(pairs: DataFrame, texts: DataFrame, weigher) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) of nodes; a text that leads many pairs is weighed once per run."""
    left = spread_join(pairs, texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a", "b", hot=hot_keys(pairs, "a"))
    rows = spread_join(left, texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b", "a", hot=hot_keys(pairs, "b")).select("a", "b", "text_a", "text_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, held = Weigher(*weigher.value), {}
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c) for c in ("a", "b", "text_a", "text_b"))):
                b = row[1].as_py()
                if b not in held:
                    if len(held) >= 8:
                        held.clear()
                    held[b] = w.of_text(row[3].as_py())
                out.append(weighted_jaccard(w.of_text(row[2].as_py()), held[b]))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    return rows.mapInArrow(compare, "a string, b string, similarity double")


def _prefixes(mine, leader, sketch, threshold: float):
    """(change, rest, near, far, cost, spare, map, folded, heavy) of a member's changes to its leader; see _changes and _may_be_alike."""
    import numpy as np

    from textmill.llm.tokens import mix

    (u, w), (v, z) = mine, leader
    both = np.union1d(u, v)
    change = np.zeros(len(both))
    change[np.searchsorted(both, u)] += w
    change[np.searchsorted(both, v)] -= z
    some = np.abs(change) > 1e-12
    both, change = both[some], change[some]
    gone = change < 0
    order = np.lexsort((both, sketch[(both >> np.uint64(42)).astype(np.int64)], gone))
    gone, amount = gone[order], np.abs(change[order])
    key = np.where(gone, mix(both[order] + np.uint64(1)), both[order]).view(np.int64)
    cost = np.where(gone, 1.0, threshold) * amount
    # sums of what follows each place; a prefix ends where the rest cannot reach the bound
    after = lambda x: np.cumsum(x[::-1])[::-1]
    rest = after(amount)
    near = int((rest >= cost.sum() / (1 + threshold) - 1e-9).sum())
    excess = cost.sum() - (1 - threshold) * z.sum()
    far = int((after(np.where(gone, threshold, 1.0) * amount) >= excess - 1e-9).sum()) if excess > -1e-9 else 0
    most = max(near, far)
    bits = np.zeros(MAP_BITS, bool)
    bits[(mix(key.view(np.uint64)) % np.uint64(MAP_BITS)).astype(np.int64)] = True
    folded = len(key) - int(bits.sum())
    heavy = float(np.maximum(amount - (1 + IDF_SHARE), 0).sum())
    return key[:most], rest[:most], near, far, float(cost.sum()), float((1 - threshold) * z.sum()), np.packbits(bits).view(np.int64), folded, heavy


def _changes(members: DataFrame, texts: DataFrame, weigher, threshold: float) -> DataFrame:
    """Members (leader, node, taken) with a prefix of their changes to the leader (near and far: lengths) and measures.

    For leader L let a member x lack the weights d and add the weights a, and let c(x) = |d| + t |a|. The common weight of
    x and y is |L| - |d_x| - |d_y| + S, with S the weight of the changes that they share, so x and y are alike if and
    only if (1 + t) S >= c(x) + c(y) - (1 - t) |L|; x is like L (taken) if and only if c(x) <= (1 - t) |L|. Hence
    * near: whoever is alike to an untaken member shares more than c(x) / (1 + t) of its changes with it;
    * far: an untaken member shares changes with t |d| + |a| >= c(x) - (1 - t) |L| with whatever it is alike to.
    In one order of all changes, added ones first and rare ones first, the prefixes that leave less than this bound
    must meet. Most changes of near copies are their own, so they do not meet by chance.
    """
    left = members.join(texts.select("node", F.col("text").alias("mine")), "node")
    rows = spread_join(left, texts.select(F.col("node").alias("leader"), F.col("text").alias("theirs")), "leader", "node", hot=hot_keys(members, "leader")).select("leader", "node", "taken", "mine", "theirs")
    names = ["leader", "node", "taken", "change", "rest", "near", "far", "cost", "spare", "map", "folded", "heavy"]
    longs = pa.list_(pa.int64())
    types = [longs, pa.list_(pa.float64()), pa.int64(), pa.int64(), pa.float64(), pa.float64(), longs, pa.int64(), pa.float64()]

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, held = Weigher(*weigher.value), {}
        for batch in batches:
            found = []
            for row in zip(*(batch.column(c) for c in ("leader", "taken", "mine", "theirs"))):
                leader = row[0].as_py()
                if leader not in held:
                    if len(held) >= 8:
                        held.clear()
                    held[leader] = w.of_text(row[3].as_py())
                found.append(_prefixes(w.of_text(row[2].as_py()), held[leader], w.sketch, threshold))
            measured = [pa.array([f[i] for f in found], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:3]], *measured], names=names)

    return rows.mapInArrow(change, "leader string, node string, taken boolean, change array<bigint>, rest array<double>, near bigint, far bigint, cost double, spare double, map array<bigint>, folded bigint, heavy double")


def _may_be_alike(x: str, y: str, threshold: float):
    """Whether the changes of x and y leave room for a similarity of threshold: a bound on S that never falls short.

    Each change sets one bit of a map; what two members share sets bits in both, but for changes that fold onto a bit.
    A change weighs 1 + IDF_SHARE at most; what repeated shingles weigh beyond that is added as heavy. From the first
    change that they share on, both have at least S left (rest).
    """
    common = sum((F.bit_count(F.col(f"{x}.map")[i].bitwiseAND(F.col(f"{y}.map")[i])) for i in range(MAP_BITS // 64)), F.least(f"{x}.folded", f"{y}.folded"))
    shared = common * (1 + IDF_SHARE) + F.least(f"{x}.heavy", f"{y}.heavy")
    return F.least(shared, f"{x}.rest", f"{y}.rest") * (1 + threshold) >= F.col(f"{x}.cost") + F.col(f"{y}.cost") - F.col(f"{x}.spare") - 1e-6


def _meeting(changes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of nodes of different components whose changes to the same leader meet and may suffice."""
    columns = ("leader", "node", "component", "taken", "near", "far", "cost", "spare", "map", "folded", "heavy")
    listed = changes.select(*columns, F.posexplode(F.arrays_zip("change", "rest")).alias("at", "one"))
    listed = listed.select(*columns, "at", "one.change", "one.rest")
    asking = listed.where("not taken").withColumns({"near": F.expr("at < near"), "far": F.expr("at < far")}).alias("x")
    asked = listed.where("at < near").alias("y")
    meets = "x.leader = y.leader and x.change = y.change and x.component <> y.component and case when y.taken then x.far else x.near and x.node > y.node end"
    met = asking.join(asked, F.expr(meets) & _may_be_alike("x", "y", threshold))
    return met.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()


def _led(active: DataFrame) -> DataFrame:
    """Members of each bucket of two or more with its leader: the one whose buckets are the largest in all.

    Copies that differ from each other still agree with the text in their midst.
    """
    sizes = active.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    hot = hot_keys(active, "band")
    sized = materialise(spread_join(active, sizes, "band", "node", hot=hot))
    central = sized.groupBy("node").agg(F.sum("n").alias("near"))
    heads = sized.join(central, "node").groupBy("band").agg(F.max_by("node", F.struct("near", F.xxhash64("node"))).alias("leader"))
    return renew(sized, spread_join(sized, heads, "band", "node", hot=hot).where("node <> leader").select("band", "node", "leader"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row per input row: id, class_id, kept.

    class_id is the smallest id of the documents reachable by links (equal texts, or weighted Jaccard similarity of
    threshold or more), itself included; kept marks the row whose id is class_id. Null and empty texts link with
    nothing, not even each other; texts without words only with equal texts; texts of fewer than five words are one
    shingle. Null ids are never a class_id unless a class has no other. Repeated rows stay (all share the class, and
    all rows with the class's id are kept). Other columns are not read; an empty table gives no rows.
    """
    return _classes(docs, id_col, text_col, threshold).select(F.col("id").alias(id_col), F.col("class_id"), F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    spark = docs.sparkSession
    frequencies = document_frequencies(docs, text_col)
    weigher = spark.sparkContext.broadcast((frequencies.sketch, frequencies.documents))  # COUNTERS integers, whatever the input
    signed = materialise(signatures(docs, weigher, id_col, text_col))
    nodes = signed.groupBy("node").agg(F.min("id").alias("first_id"), F.first("bands").alias("bands"))
    banded = nodes.select("node", "first_id", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    active = materialise(banded.join(sizes.select("band"), "band", "left_semi").select("band", "node", "first_id"))
    wanted = active.select("node", "first_id").distinct()
    source = docs.select(F.col(id_col).alias("id"), _node(id_col, text_col).alias("node"), F.col(text_col).alias("text"))
    texts = materialise(source.join(wanted.withColumnRenamed("node", "n"), (F.col("node") == F.col("n")) & F.col("id").eqNullSafe(F.col("first_id")), "left_semi").select("node", "text").dropDuplicates(["node"]))
    active, done, judged = renew(active, active.select("band", "node")), None, None

    def compared(pairs: DataFrame) -> DataFrame:
        """done with the pairs (a, b), a > b, that it lacks."""
        new = materialise(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"))
        found = _verify(new, texts, weigher)
        out = renew(done, found if done is None else done.union(found))
        drop(new)
        return out

    for _ in range(STAR_ROUNDS):
        led = _led(active).withColumns({"a": F.greatest("node", "leader"), "b": F.least("node", "leader")})
        done = compared(led.select("a", "b").distinct())
        star = materialise(led.join(done, ["a", "b"]).select("band", "node", "leader", "similarity"))
        if judged is None:
            judged = materialise(star.select("node", "leader", "similarity").distinct())
        # members unlike their leader go on among themselves
        active = renew(active, star.where(F.col("similarity") < threshold).select("band", "node"))
        drop(star)
        if active.isEmpty():
            break
    links = lambda: done.where(F.col("similarity") >= threshold).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    grouped = materialise(components(links()))
    of = lambda c: grouped.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    hot = hot_keys(judged, "leader")
    named = spread_join(judged.join(of("node"), "node", "left"), of("leader"), "leader", "node", "left", hot)
    told = materialise(named.select("leader", "node", "similarity", (F.col("similarity") >= threshold).alias("taken"), F.coalesce("node_component", "node").alias("component"), F.coalesce("leader_component", "leader").alias("home")))
    # a leader's members need no search where all are in its component; taken ones none where no other comes near
    apart = told.where("component <> home").groupBy("leader").agg(F.max("similarity").alias("nearest"))
    members = renew(told, spread_join(told, apart, "leader", "node", hot=hot).where(~F.col("taken") | (F.col("nearest") >= 2 * threshold - 1 - 1e-9)).select("leader", "node", "taken", "component"))
    if not members.isEmpty():
        changes = materialise(_changes(members.select("leader", "node", "taken"), texts, weigher, threshold).join(members.select("leader", "node", "component"), ["leader", "node"]))
        done = compared(_meeting(changes, threshold))
        drop(changes)
        grouped = components(links())
    drop(members), drop(judged), drop(active)
    label = nodes.select("node", "first_id").join(grouped, "node", "left").select("node", "first_id", F.coalesce("component", "node").alias("component"))
    label = materialise(label)
    smallest = label.groupBy("component").agg(F.min("first_id").alias("class_id"))
    classed = spread_join(label, smallest, "component", "node", hot=hot_keys(label, "component")).select("node", "class_id")
    return spread_join(signed.select("id", "node"), classed, "node", "id", hot=hot_keys(signed, "node")).select("id", "node", "class_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """docs with one row for each class, that of the smallest id; all columns stay."""
    classes = _classes(docs, id_col, text_col, threshold)
    best = materialise(classes.where(F.col("id").eqNullSafe(F.col("class_id"))).groupBy("id", "node").agg(F.count("*").alias("copies")))
    keyed = docs.withColumn("_node", _node(id_col, text_col))
    kept = keyed.join(best.select(F.col("id").alias("_id"), F.col("node").alias("_best")), F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_node") == F.col("_best")), "left_semi")
    if not best.where("copies > 1").isEmpty():  # the very same row more than once
        kept = kept.dropDuplicates([id_col, "_node"])
    return kept.drop("_node")


def op7_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
