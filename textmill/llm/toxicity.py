"""Toxicity: subsequence string-kernel SVM with Nystrom landmarks over the words of labelled sentences.

The kernel counts common subsequences of three letters, gaps allowed, each weighted by DECAY to the length it spans
(at most SPAN letters). A word stands between border marks; marks and digits inside it are dropped, letters are
folded to a-z, and runs of single letters are read as one word, so that gapped and inserted-character spellings stay
close to the plain one. A linear SVM is trained on the Nystrom features of words that separate toxic from other
labelled documents. Kernel, landmarks and weights fold into one weight per subsequence, which scores any word
exactly like the kernel expansion; a document's score is the calibrated maximum over all its words. Words of more than
PIECE letters are read in overlapping pieces.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import materialise, table

DECAY, SPAN, LETTERS = 0.6, 7, 28
#: Bounds of the fit: labelled rows, distinct words per class (the most surprising and the most frequent first), landmarks.
LABELLED_ROWS, INSULTS, OTHERS, LANDMARKS = 40_000, 1_500, 24_000, 256
CACHE_WORDS = 400_000
#: Letters of a word that are read at once; longer words are trained and scored in pieces that overlap by half.
PIECE = 40

class _Fold(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        base = unicodedata.normalize("NFKD", c)[:1] if c != "ß" else "s"
        out = self[code] = base if "a" <= base <= "z" else "{" if c.isalpha() else ""
        return out


_FOLD = _Fold()


def fold(word: str) -> str:
    """Letters of a word as a-z without accents, other letters as one mark; everything else is dropped."""
    return word.lower().translate(_FOLD)


def units(text: str) -> set[str]:
    """Distinct words of a text, and runs of three or more single characters as one word."""
    words = text.split()
    out = set(words)
    if len(words) >= 3:
        run = []
        for w in words + ["  "]:
            if len(w) == 1:
                run.append(w)
            else:
                if len(run) >= 3:
                    out.add("".join(run))
                run = []
    return out


def features(word: str):
    """(index, value) of the subsequences of a folded word, scaled to length 1."""
    import numpy as np

    s = np.array([0, *[1 + ord(c) - 97 for c in word], 0], np.int64)
    n, ids, vals = len(s), [], []
    for a in range(1, SPAN - 1):
        for b in range(a + 1, SPAN):
            if n - b > 0:
                ids.append((s[: n - b] * LETTERS + s[a : n - b + a]) * LETTERS + s[b:])
                vals.append(np.full(n - b, DECAY ** (b + 1)))
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0)
    u, inv = np.unique(np.concatenate(ids), return_inverse=True)
    v = np.bincount(inv, np.concatenate(vals), len(u))
    return u, v / np.linalg.norm(v)


def kernel(a: str, b: str) -> float:
    """The normalised subsequence kernel of two folded words."""
    import numpy as np

    (u, v), (x, y) = features(a), features(b)
    _, i, j = np.intersect1d(u, x, assume_unique=True, return_indices=True)
    return float((v[i] * y[j]).sum())


def _matrix(words):
    import numpy as np

    out = np.zeros((len(words), LETTERS**3), np.float32)
    for k, w in enumerate(words):
        u, v = features(w)
        out[k, u] = v
    return out


def train(insults: list[str], others: list[str], seed: int = 7):
    """Folded SVM weights (one per subsequence) and bias, from words of toxic and of other text."""
    import numpy as np

    rng = np.random.default_rng(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def varied(w):
        out = [w]
        for _ in range(3 if len(w) >= 4 else 0):
            at = int(rng.integers(1, len(w)))
            out.append(w[:at] + letters[int(rng.integers(26))] + w[at:])
        return out

    yes = [v for w in insults for v in varied(w)]
    half = LANDMARKS // 2
    spread = lambda xs, n: [xs[int(i)] for i in np.linspace(0, len(xs) - 1, min(n, len(xs)))]
    marks = list(dict.fromkeys(spread(insults, half) + spread(others, LANDMARKS - half)))
    landmark = _matrix(marks)
    values, vectors = np.linalg.eigh((landmark @ landmark.T).astype(np.float64))
    good = values > 1e-6
    root = vectors[:, good] / np.sqrt(values[good])
    project = (landmark.T @ root).astype(np.float32)  # subsequence weights to Nystrom features

    def mapped(words):
        return np.concatenate([_matrix(words[k : k + 500]) @ project for k in range(0, len(words), 500)]).astype(np.float64)

    pos, pool = mapped(yes), mapped(others)
    hard = np.arange(min(len(others), 4000))
    w, bias = np.zeros(pos.shape[1]), 0.0
    for _ in range(4):  # each time with the other words that came out worst
        x = np.concatenate([pos, pool[hard]])
        y = np.concatenate([np.ones(len(pos)), -np.ones(len(hard))])
        cost = np.where(y > 0, len(y) / (2 * len(pos)), len(y) / (2 * len(hard)))
        xb = np.concatenate([x, np.ones((len(x), 1))], axis=1)
        wb = np.append(w, bias)
        for _ in range(30):  # Newton steps of the squared hinge loss
            margin = y * (xb @ wb)
            on = margin < 1
            if not on.any():
                break
            a = xb[on] * cost[on, None]
            reg = np.full(len(wb), 0.05)
            reg[-1] = 1e-6
            step = np.linalg.solve(a.T @ xb[on] + np.diag(reg), a.T @ (y[on] * (1 - margin[on])) - reg * wb)
            wb = wb + step
            if np.abs(step).max() < 1e-6:
                break
        w, bias = wb[:-1], wb[-1]
        worst = np.argsort(-(pool @ w))[:3000]
        hard = np.union1d(hard, worst)
    return (project @ w).astype(np.float32), float(bias)


class Scorer:
    """Margins of words in batches, with bounded caches; one per Python worker."""

    def __init__(self, weights, bias: float):
        self.weights, self.bias = weights, bias
        self.seen: dict[str, float] = {}
        self.folded: dict[str, float] = {}

    def margins(self, words: list[str]):
        """Margins of folded words of one length, all at once."""
        import numpy as np

        length = len(words[0])
        n = length + 2
        s = np.zeros((len(words), n), np.int64)
        s[:, 1:-1] = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length) - 96
        ids = [(s[:, : n - b] * LETTERS + s[:, a : n - b + a]) * LETTERS + s[:, b:] for a in range(1, SPAN - 1) for b in range(a + 1, SPAN) if n > b]
        if not ids:
            return np.full(len(words), self.bias)
        values = np.concatenate([np.full(n - b, DECAY ** (b + 1)) for a in range(1, SPAN - 1) for b in range(a + 1, SPAN) if n > b])
        ids = np.concatenate(ids, axis=1)
        dot = self.weights[ids] @ values.astype(np.float32)
        order = ids.argsort(axis=1)
        ids = np.take_along_axis(ids, order, 1)
        new = np.ones(ids.shape, bool)
        new[:, 1:] = ids[:, 1:] != ids[:, :-1]
        sums = np.add.reduceat(values[order].reshape(-1), np.flatnonzero(new)) ** 2
        norm = np.add.reduceat(sums, np.append(0, np.cumsum(new.sum(axis=1))[:-1]))
        return dot / np.sqrt(norm) + self.bias

    def learn(self, words: set[str]) -> None:
        """Put the margins of words into the cache."""
        if len(self.seen) + len(words) > CACHE_WORDS:
            self.seen.clear()
            self.folded.clear()
        plain = {w: fold(w) for w in words}
        pieces = {f: [f[k : k + PIECE] for k in range(0, max(1, len(f) - PIECE // 2), PIECE // 2)] for f in set(plain.values()) if f not in self.folded}
        by_length: dict[int, list[str]] = {}
        for p in {p for ps in pieces.values() for p in ps}:
            by_length.setdefault(len(p), []).append(p)
        found: dict[str, float] = {}
        for same in by_length.values():
            for at in range(0, len(same), 2048):
                part = same[at : at + 2048]
                found.update(zip(part, self.margins(part).tolist()))
        for f, ps in pieces.items():
            self.folded[f] = max(found[p] for p in ps)
        for w, f in plain.items():
            self.seen[w] = self.folded[f]

    def texts(self, texts: list[str]) -> list[float]:
        """The largest margin of each text; -9 without words."""
        found = [units(t) for t in texts]
        words = set().union(*found)
        missing = words.difference(self.seen)
        if missing:
            self.learn(missing)
            self.learn(words.difference(self.seen))  # the rest, if the cache was emptied on the way
        get = self.seen.__getitem__
        return [max(map(get, u), default=-9.0) for u in found]


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple:
    """(weights, bias, slope, offset) from at most LABELLED_ROWS labelled rows (smallest hash of their id first)."""
    import numpy as np

    known = labels.where("toxic is not null").select(F.col(id_col).alias("t"), "toxic").groupBy("t").agg(F.max("toxic").alias("toxic"))
    sample = known.where("t is not null").orderBy(F.xxhash64("t"), "t").limit(LABELLED_ROWS)
    rows = materialise(docs.join(F.broadcast(sample), F.col(id_col) == F.col("t")).select(F.col("t"), F.col("toxic").cast("int").alias("toxic"), F.col(text_col).alias("text")))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list] = {}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                for f in {fold(w) for w in units(text or "")}:
                    for part in {f[k : k + PIECE] for k in range(0, max(1, len(f) - PIECE // 2), PIECE // 2)} if len(f) > 2 else ():
                        counts.setdefault(part, [0, 0])[1 if toxic else 0] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *[pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1)]], names=["word", "other", "toxic"])

    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    share = (total["toxic"] + 1) / (total["n"] + 2)
    counts = materialise(rows.mapInArrow(words, "word string, other bigint, toxic bigint").groupBy("word").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")))
    # a word is an insult if chance would hardly put it into toxic documents that often
    surprise = F.col("toxic") * F.log10(F.lit(1 / share))
    bad = [r["word"] for r in counts.where((surprise >= 4.5) & (F.col("toxic") >= 9 * F.col("other"))).orderBy(F.desc("toxic"), "word").limit(INSULTS).collect()]
    # the most frequent other words, which most documents are judged by, and a hash sample of the rest
    usual = counts.where(F.col("toxic") <= 2 * share * (F.col("other") + F.col("toxic")))
    fine = [r["word"] for r in usual.orderBy(F.desc("other"), "word").limit(OTHERS // 2).collect()]
    fine = list(dict.fromkeys(fine + [r["word"] for r in usual.orderBy(F.xxhash64("word"), "word").limit(OTHERS // 2).collect()]))
    if not bad or not fine:
        return np.zeros(LETTERS**3, np.float32), 0.0, 0.0, float(np.log(share / (1 - share)))
    weights, bias = train(bad, fine)
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))
    margins = [(r["margin"], r["toxic"]) for r in rows.mapInArrow(_margins(shared, ["toxic"]), "toxic int, margin double").collect()]  # LABELLED_ROWS at most
    m, y = np.array([x for x, _ in margins]), np.array([float(bool(t)) for _, t in margins])
    slope, offset = 4.0, 0.0
    for _ in range(50):  # logistic calibration
        p = 1 / (1 + np.exp(-np.clip(slope * m + offset, -30, 30)))
        c = np.full(len(y), 1 / len(y))
        g = np.array([((p - y) * c * m).sum() + 1e-4 * slope, ((p - y) * c).sum()])
        h = c * p * (1 - p)
        hess = np.array([[(h * m * m).sum() + 1e-4, (h * m).sum()], [(h * m).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        slope, offset = slope - float(np.clip(step[0], -2, 2)), offset - float(np.clip(step[1], -2, 2))
    return weights, bias, max(slope, 0.0), offset


def _margins(shared, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            out: list[float] = []
            for at in range(0, batch.num_rows, 64):
                out += scorer.texts([t or "" for t in batch.column("text").slice(at, 64).to_pylist()])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(out, pa.float64())], names=[*keep, "margin"])

    return run


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, margin (of the worst word), score (0 to 1).

    labels holds id_col and toxic of the rows to learn from. Null and empty texts have the lowest margin. Ids may be
    null or repeat; other columns are not read. Narrow: each worker scores whole texts against a model of fixed size.
    """
    weights, bias, slope, offset = fit(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((weights, bias))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    margins = rows.mapInArrow(_margins(shared, ["id"]), f"id {kind}, margin double")
    z = F.greatest(F.least(F.lit(slope) * F.col("margin") + F.lit(offset), F.lit(30.0)), F.lit(-30.0))
    return margins.select(F.col("id").alias(id_col), "margin", (1 / (1 + F.exp(-z))).alias("score"))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt from two thirds of the labelled rows."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    found = score(docs, labels.where(F.coalesce(~out, F.lit(True))))
    return found.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "margin")
