"""Quality classifier: interpolated modified Kneser-Ney n-grams of trusted text, perplexity, quantiles by language.

The n-grams are of ORDER characters, each a 12-bit symbol of an alphabet taken from the trusted text, so an n-gram is one
long. Counts, continuation counts, discounts and interpolated probabilities are DataFrame aggregations and joins on
n-gram and history, dealt in shards by the shuffle; the model grows with the trusted text. Its tables travel to the
documents, sorted, behind a check of their size, and each task joins its documents' n-grams with them, longest first.
(Shuffling the n-grams of documents to the model instead would write several times the input.)
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import materialise, table

#: Ids of trusted rows are broadcast up to this many; beyond it trusted texts are found by a shuffled join.
TRUSTED_IDS = 1_000_000
#: Symbols counted at a time, and distinct n-grams that a task holds before it merges them.
SLICE, HELD = 1 << 20, 1 << 22
#: A document is rejected above this quantile of its language's trusted scores, each from the model of the other half.
CUT = 0.97
#: Bits to which scores are rounded for the quantiles.
STEP = 1e-4
#: Symbols of prior weight at PRIOR_BITS that a document's mean is drawn to for its score; short texts vary more.
PRIOR, PRIOR_BITS = 40, 3.0
#: Characters of an n-gram, bits of a symbol; symbols of an end and of characters outside the alphabet.
ORDER, BITS, END, OTHER = 5, 12, 1, 2
#: The model's tables are broadcast up to this many n-grams.
MODEL_ROWS = 40_000_000
#: Thresholds are broadcast up to this many languages.
LANGUAGES = 10_000


def alphabet(trusted: DataFrame, text_col: str):
    """Symbol of each code point: the most frequent characters of trusted text have their own, all others share OTHER."""
    import numpy as np

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            for cell in batch.column(0):
                codes = _codes(cell.as_py())
                total[: 1 + int(codes.max(initial=0))] += np.bincount(codes) if len(codes) else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["code", "n"])

    rows = trusted.select(text_col).mapInArrow(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    best = rows.orderBy(F.desc("n"), "code").limit((1 << BITS) - OTHER - 1).collect()
    out = np.full(0x110000, OTHER, np.int64)
    for k, r in enumerate(best):
        out[r["code"]] = OTHER + 1 + k
    return out


def _codes(text: str | None):
    import numpy as np

    return np.frombuffer((text or "").encode("utf-32-le", "replace"), "<u4").astype(np.int64)


def ngrams(texts: list, symbols):
    """(n-grams of all texts in order, first place of each text): every character and one end, after ORDER - 1 ends."""
    import numpy as np

    pad, end = np.full(ORDER - 1, END, np.int64), np.array([END], np.int64)
    parts, sizes = [], []
    for t in texts:
        s = np.concatenate([pad, symbols[_codes(t)], end])
        sizes.append(len(s) - ORDER + 1)
        g = s[ORDER - 1 :].copy()
        for k in range(1, ORDER):
            g |= s[ORDER - 1 - k : len(s) - k] << BITS * k
        parts.append(g)
    return np.concatenate(parts), np.cumsum([0, *sizes])[:-1], np.array(sizes)


def _runs(texts: list) -> Iterator[list]:
    """texts in runs of about SLICE characters; a longer text is a run of its own."""
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last] or "") <= SLICE):
            size += len(texts[last] or "")
            last += 1
        yield texts[first:last]
        first = last


def count_ngrams(trusted: DataFrame, text_col: str, symbols, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, g, c): counts of the n-grams of the highest order, summed per task before the shuffle."""
    fields = [trusted.schema[k] for k in keep]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def merged(parts):
            g, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return g, np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)

        held: dict[tuple, list] = {}
        kinds = []
        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keep]
            texts = batch.column(text_col).to_pylist()
            owners = list(zip(*[batch.column(k).to_pylist() for k in keep])) if keep else [()] * len(texts)
            for owner in set(owners):
                parts = held.setdefault(owner, [])
                for some in _runs([t for t, o in zip(texts, owners) if o == owner]):
                    parts.append(np.unique(ngrams(some, symbols)[0], return_counts=True))
                    # merged whenever what came since has reached HELD and the size of the first, merged part
                    if sum(len(p[0]) for p in parts[1:]) > max(HELD, len(parts[0][0])):
                        parts[:] = [merged(parts)]
        for owner, parts in held.items():
            g, n = merged(parts)
            yield pa.RecordBatch.from_arrays([*[pa.array([o] * len(g), kind) for o, kind in zip(owner, kinds)], pa.array(g), pa.array(n)], names=[*keep, "g", "c"])

    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in fields], "g bigint", "c bigint"])
    return trusted.select(text_col, *keep).mapInArrow(count, schema).groupBy(*keep, "g").agg(F.sum("c").alias("c"))


def discounts(n: list[float]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more from the numbers of n-grams seen 1..4 times."""
    if min(n[0], n[1]) == 0:
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    bound = lambda d, k: min(max(d, 0.1), k - 0.05)
    return bound(1 - 2 * y * n[1] / n[0], 1), bound(2 - 3 * y * n[2] / n[1], 2), bound(3 - 4 * y * n[3] / n[2] if n[2] else 1.5, 3)


def kneser_ney(counts: DataFrame, n_symbols: int) -> DataFrame:
    """(side, k, history, key, value): log2 probabilities of n-grams of each order k, and of what histories leave.

    counts holds (side, g, c) of order ORDER; each side is a model of its own. Lower orders count the distinct symbols
    before an n-gram. value of a history row is log2 of the mass that its discounts leave to the next lower order.
    """
    level = materialise(counts.select("side", "g", F.col("c").cast("double").alias("c")))
    levels = {ORDER: level}
    for k in range(ORDER - 1, 0, -1):
        level = level.groupBy("side", F.col("g").bitwiseAND(F.lit((1 << BITS * k) - 1)).alias("g")).agg(F.count("*").cast("double").alias("c"))
        levels[k] = level
    every = None
    for k, rows in levels.items():
        rows = rows.select("side", F.lit(k).alias("k"), "g", "c", F.shiftright("g", BITS).alias("h"))
        every = rows if every is None else every.unionByName(rows)
    every = materialise(every)
    seen = every.groupBy("side", "k").agg(*[F.sum((F.col("c") == j).cast("int")).alias(f"n{j}") for j in (1, 2, 3, 4)]).collect()  # one row for each side and order
    cuts = [(r["side"], r["k"], *discounts([float(r[f"n{j}"]) for j in (1, 2, 3, 4)])) for r in seen]
    cuts = counts.sparkSession.createDataFrame(cuts, "side int, k int, d1 double, d2 double, d3 double")
    cut = F.when(F.col("c") >= 3, F.col("d3")).when(F.col("c") >= 2, F.col("d2")).otherwise(F.col("d1"))
    every = every.join(F.broadcast(cuts), ["side", "k"]).select("side", "k", "g", "h", "c", cut.alias("cut"))
    left = every.groupBy("side", "k", "h").agg(F.sum("c").alias("total"), (F.sum("cut") / F.sum("c")).alias("left"))
    share = materialise(every.join(left, ["side", "k", "h"]).select("side", "k", "g", ((F.col("c") - F.col("cut")) / F.col("total")).alias("a"), "left"))
    lower, out = None, left.select("side", "k", F.lit(True).alias("history"), F.col("h").alias("key"), F.log2(F.greatest("left", F.lit(1e-12))).alias("value"))
    for k in range(1, ORDER + 1):
        rows = share.where(F.col("k") == k)
        if lower is None:
            p = rows.select("side", "g", (F.col("a") + F.col("left") / n_symbols).alias("p"))
        else:
            below = lower.select("side", F.col("g").alias("s"), F.col("p").alias("q"))
            p = rows.withColumn("s", F.col("g").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1))).join(below, ["side", "s"]).select("side", "g", (F.col("a") + F.col("left") * F.col("q")).alias("p"))
        lower = p
        out = out.unionByName(p.select("side", F.lit(k).alias("k"), F.lit(False).alias("history"), F.col("g").alias("key"), F.log2("p").alias("value")))
    return out


class Model:
    """Sorted tables of one side; joins n-grams with them, longest order first."""

    def __init__(self, tables: dict, n_symbols: int):
        self.tables, self.floor = tables, n_symbols

    def log2(self, g):
        """log2 probability of the last symbol of each n-gram."""
        import numpy as np

        out, left = np.zeros(len(g)), np.arange(len(g))
        for k in range(ORDER, 0, -1):
            part = g[left] & np.int64((1 << BITS * k) - 1)
            found, value = self._join(k, False, part)
            out[left] += np.where(found, value, 0.0)
            left, part = left[~found], part[~found]
            if not len(left):
                return out
            found, value = self._join(k, True, part >> BITS)
            out[left] += np.where(found, value, 0.0)
        out[left] -= np.log2(self.floor)
        return out

    def _join(self, k: int, history: bool, keys):
        import numpy as np

        known, values = self.tables.get((k, history), (np.zeros(0, np.int64), np.zeros(0, np.float32)))
        if not len(known):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.searchsorted(known, keys)
        at[at == len(known)] = 0
        return known[at] == keys, values[at]


def fit(trusted: DataFrame, text_col: str = "text", side: Column | None = None) -> tuple:
    """(symbols, {side: Model}) of trusted text; side (0 or 1) deals rows to models, all to 0 without it."""
    import numpy as np

    spark = trusted.sparkSession
    rows = trusted.select(F.col(text_col).alias("text"), (F.lit(0) if side is None else side).cast("int").alias("side"))
    symbols = alphabet(rows, "text")
    shared = spark.sparkContext.broadcast(symbols)
    model = materialise(kneser_ney(_counted(rows, shared), int(symbols.max())))
    size = model.count()
    if size > MODEL_ROWS:
        raise ValueError(f"the model has {size} rows; MODEL_ROWS allows {MODEL_ROWS}")
    got = model.toArrow()
    column = {c: got.column(c).to_numpy() for c in got.column_names}
    models = {}
    for s in (0, 1):
        tables = {}
        for k in range(1, ORDER + 1):
            for history in (False, True):
                at = np.flatnonzero((column["side"] == s) & (column["k"] == k) & (column["history"] == history))
                at = at[np.argsort(column["key"][at])]
                tables[k, history] = (column["key"][at], column["value"][at].astype(np.float32))
        models[s] = Model(tables, int(symbols.max()))
    return symbols, models


def _counted(rows: DataFrame, symbols) -> DataFrame:
    class Shared:
        """The broadcast alphabet, read in the worker."""

        def __getitem__(self, codes):
            return symbols.value[codes]

    return count_ngrams(rows, "text", Shared(), ("side",))


def half(key) -> Column:
    """Half of the ids that an id belongs to: 0 or 1."""
    return F.pmod(F.xxhash64(key), F.lit(2)).cast("int")


def scored(docs: DataFrame, symbols, models: dict, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(id, lang, n_symbols, bits): bits of a text with its end, by the model whose number is the half of its id."""
    shared = docs.sparkSession.sparkContext.broadcast((symbols, models))  # MODEL_ROWS at most
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), half(id_col).alias("half"))
    names = ["id", "lang", "n_symbols", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        symbols, models = shared.value
        for batch in batches:
            texts, sides = batch.column("text").to_pylist(), batch.column("half").to_pylist()
            n, bits = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for side in (0, 1):
                rows, first = [k for k, s in enumerate(sides) if s == side], 0
                for some in _runs([texts[k] for k in rows]):
                    at, first = rows[first : first + len(some)], first + len(some)
                    g, starts, sizes = ngrams(some, symbols)
                    n[at] = sizes
                    bits[at] = -np.add.reduceat(models[side].log2(g), starts)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("lang"), pa.array(n), pa.array(bits)], names=names)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, lang string, n_symbols bigint, bits double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: id, lang, n_symbols, perplexity, score, threshold, kept.

    perplexity: of the characters of the text and its end. score: the mean bits of a symbol, drawn to PRIOR_BITS with the
    weight of PRIOR symbols, which the verdict rests on. labels has id_col and quality; rows with quality 1 are trusted.
    All of them make two models, one of each half of the ids (MODEL_ROWS bounds the models, beyond it the call fails); a document is scored by the model of
    the other half, so that trusted and other documents alike are new to the model. Thresholds are the CUT quantiles of
    the scores, to STEP, of all trusted rows by language. A language without trusted rows, null included, takes the threshold
    over all languages; without any trusted rows all documents are kept. Null texts count as empty; ids may be null or
    repeat. Other columns are not read.
    """
    trusted = materialise(labels.where("quality = 1").select(F.col(id_col).alias("t")).where("t is not null").distinct())
    ids = F.broadcast(trusted) if trusted.count() <= TRUSTED_IDS else trusted
    read = docs.select(id_col, text_col).join(ids, F.col(id_col) == F.col("t"), "left_semi")
    symbols, models = fit(read, text_col, 1 - half(id_col))
    score = (F.col("bits") + PRIOR_BITS * PRIOR) / (F.col("n_symbols") + PRIOR)
    scores = materialise(scored(docs, symbols, models, id_col, text_col, lang_col).withColumn("score", score))
    known = scores.join(trusted, F.col("id") == F.col("t"), "left_semi")
    # counts of scores to STEP: quantiles that do not depend on the order of merging, of a bounded number of values
    steps = known.groupBy("lang", F.round(F.col("score") / STEP).alias("step")).agg(F.count("*").alias("n"))
    cut = lambda: F.percentile("step", CUT, F.col("n")) * STEP
    overall = steps.agg(cut().alias("c"))
    # as many rows as languages: broadcast up to LANGUAGES, so that a frequent language is not dealt to one task
    limits = materialise(steps.where("lang is not null").groupBy("lang").agg(cut().alias("own")).withColumnRenamed("lang", "l"))
    side = F.broadcast(limits) if limits.count() <= LANGUAGES else limits
    joined = scores.join(side, F.col("lang") == F.col("l"), "left").crossJoin(F.broadcast(overall))  # one row
    joined = joined.withColumn("c", F.coalesce("own", "c", F.lit(float("inf"))))
    return joined.select(F.col("id").alias(id_col), "lang", "n_symbols", F.pow(F.lit(2.0), F.col("bits") / F.col("n_symbols")).alias("perplexity"), "score", F.col("c").alias("threshold"), (F.col("score") <= F.col("c")).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the rejected rows; all columns stay. Rows that share an id stay if one of them is kept."""
    kept = classify(docs, labels, id_col, **options).where("kept").select(F.col(id_col).alias("_kept")).distinct()
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col("_kept")), "left_semi")


def op10_kneser_ney(spark, sf_dir: str) -> DataFrame:
    """Perplexity, score, threshold and verdict of every document."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
