"""LM scoring: a log-frequency Bloom filter of quantised n-gram counts, in shards, probed level by level.

Training counts of words and word pairs are summed exactly in shards (by hash). A count of level q (about
log_LEVEL_BASE of it) enters the filter of its shard as q items (n-gram, 1..q); a probe walks up the levels until one is
missing. Shards are sized by their items, so the filter grows with the corpus at a fixed error rate. Neither filter nor
counts ever meet in one place: documents are read in runs of RUN_BYTES, the distinct n-grams of a run travel to their
shards, which add up what is trained and send back the level of each, in order, to the texts of the run.

P(w | h) = (c(h w) + MU * P(w)) / (c(h) + MU) with counts from the filter; P(w) is the share of the word's quantised
count in what the training words leave after the mass of words seen once (Good-Turing), which all unknown words share.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import materialise, table

#: Growth of a count per level, hash probes per item, filter bits per item, weight of the word distribution.
LEVEL_BASE, PROBES, BITS, MU = 1.25, 5, 10, 400.0
#: Bytes of text of a run, whose distinct n-grams travel together, and for each of which a shard is made.
RUN_BYTES, SHARD_BYTES = 24 << 20, 16 << 20
END, PAIR = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB


def levels(counts):
    """Level of each count: 1 for 1, then the rank among 1, 2, .. of rounded powers of LEVEL_BASE."""
    import numpy as np

    return np.searchsorted(_steps(), counts, "right")


def _steps():
    import numpy as np

    out, x = [], 1.0
    while x < 1e13:
        if not out or math.floor(x) > out[-1]:
            out.append(math.floor(x))
        x *= LEVEL_BASE
    return np.array(out, np.int64)


def level_counts():
    """Count that stands for each level (index 0: not seen): the geometric middle of the counts it covers."""
    import numpy as np

    s = _steps().astype(np.float64)
    return np.concatenate([[0.0], np.sqrt(s[:-1] * np.maximum(s[1:] - 1, s[:-1])), s[-1:]])


def ngrams(data, at, n_docs):
    """(unigram hashes with ends, history hash for each, first index of each document) of joined texts."""
    import numpy as np

    from textmill.llm.tokens import VISIBLE, mix, word_hashes

    words, starts = word_hashes(data, VISIBLE)
    bounds = np.searchsorted(starts, at)
    sizes = np.diff(np.append(bounds, len(words)))
    uni = np.insert(words, np.append(bounds[1:], len(words)), np.uint64(END))
    first = np.append(0, np.cumsum(sizes + 1)[:-1])
    history = np.empty_like(uni)
    history[1:] = uni[:-1]
    history[first] = np.uint64(END)  # an end is also what stands before a text
    return uni, history, first, mix(uni + history * np.uint64(PAIR))


def _places(keys, level: int, blocks, n_shards: int):
    """(block, hash) of each key at a level: all probes of an item fall into one block of 512 bits.

    Blocks of the first two levels follow the order of the keys, so that sorted keys walk through the filter; higher
    levels, of which a frequent key has many, are spread over all blocks.
    """
    import numpy as np

    from textmill.llm.tokens import mix

    h = mix(keys + np.uint64(level * 0x8EBC6AF09C88C6E3 & (1 << 64) - 1))
    low = np.uint64(0xFFFFFFFF)
    spot = (keys >> np.uint64(32)) * np.uint64(n_shards) & low if level <= 2 else mix(h) & low
    return spot * blocks >> np.uint64(32), h


class LogFilter:
    """Shards of the filter, probed together; keys are dealt to shards by their top bits."""

    def __init__(self, data, sizes):
        """data: the shards' bytes in order, or a dict of them with the number of shards as sizes."""
        import numpy as np

        data, sizes = _joined(data, sizes) if isinstance(data, dict) else (data, sizes)
        self.n, self.bits = len(sizes), np.frombuffer(data, np.uint8)
        self.start = np.append(0, np.cumsum(sizes))[:-1].astype(np.uint64) * np.uint64(8)
        self.size = np.array(sizes, np.uint64) * np.uint64(8)

    def lookup(self, keys):
        """Level of each key; 0 where the first level is missing."""
        import numpy as np

        out = np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        level = 1
        while len(left):
            k = keys[left]
            shard = shard_of(k, self.n)
            start, size = self.start[shard], self.size[shard]
            block, h = _places(k, level, size >> np.uint64(9), self.n)
            base = start + (block << np.uint64(9))
            for p in range(PROBES):
                pos = base + (h >> np.uint64(9 * p) & np.uint64(511))
                hit = ((self.bits[(pos >> np.uint64(3)).astype(np.int64)] >> (pos & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
                left, base, h = left[hit], base[hit], h[hit]
            out[left] = level
            level += 1
        return out


def _joined(shards: dict, n_shards: int) -> tuple:
    """(bytes of all shards in order, their sizes); the dict is emptied on the way."""
    data, sizes = bytearray(), []
    for i in range(n_shards):
        part = shards.pop(i, None) or b"\0" * 64
        data += part
        sizes.append(len(part))
    return data, sizes


def shard_of(keys, n_shards: int):
    import numpy as np

    return ((keys >> np.uint64(32)) * np.uint64(n_shards) >> np.uint64(32)).astype(np.int64)


def filter_bytes(keys, level, n_shards: int = 1) -> bytes:
    """Bits of one shard that holds each key at levels 1..level."""
    import numpy as np

    items = int(level.sum())
    size = max(512, -(-items * BITS // 512) * 512)
    bits = np.zeros(size, bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        some = keys[level >= q]
        block, h = _places(some, q, np.uint64(size >> 9), n_shards)
        for p in range(PROBES):
            bits[((block << np.uint64(9)) + (h >> np.uint64(9 * p) & np.uint64(511))).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _pieces(batches: Iterator[pa.RecordBatch], run_bytes: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(run, rows of it): a run ends with the row that fills run_bytes. Depends on the rows of the partition only."""
    import numpy as np
    import pyarrow.compute as pc
    from pyspark import TaskContext

    run, held = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        first = 0
        while first < len(sizes):
            ends = np.cumsum(sizes[first:]) + held
            n = min(int(np.searchsorted(ends, run_bytes)) + 1, len(ends))
            yield run, batch.slice(first, n)
            first, held = first + n, int(ends[n - 1])
            if held >= run_bytes:
                run, held = run + 1, 0


_REQUEST = "run bigint, asked boolean, shard int, pair boolean, keys binary, counts binary"
_ANSWER = "run bigint, shard int, pair boolean, levels binary, counts binary, sum bigint, grams bigint, tokens bigint, once bigint"


def _requests(batches: Iterator[pa.RecordBatch], n_shards: int, run_bytes: int) -> Iterator[pa.RecordBatch]:
    """Per run, shard and order: sorted distinct keys, with their counts in the trained rows (0: only asked for)."""
    import numpy as np

    from textmill.llm.tokens import slices

    def emit(run, asked, trained, others, pair):
        u, n = np.unique(np.concatenate(trained), return_counts=True)
        rest = np.unique(np.concatenate(others))
        if len(rest):
            at = np.minimum(np.searchsorted(u, rest), max(0, len(u) - 1))
            rest = rest[u[at] != rest] if len(u) else rest
            u, n = np.append(u, rest), np.append(n, np.zeros(len(rest), n.dtype))
            order = np.argsort(u, kind="stable")
            u, n = u[order], n[order]
        cuts = np.searchsorted(shard_of(u, n_shards), np.arange(n_shards + 1))
        rows = [(s, u[a:b].tobytes(), n[a:b].astype(np.uint32).tobytes()) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        fixed = lambda x, kind: pa.array([x] * len(rows), kind)
        return pa.RecordBatch.from_arrays([fixed(run, pa.int64()), fixed(asked, pa.bool_()), pa.array([r[0] for r in rows], pa.int32()), fixed(pair, pa.bool_()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["run", "asked", "shard", "pair", "keys", "counts"])

    for run, pieces in itertools.groupby(_pieces(batches, run_bytes), lambda x: x[0]):
        asked, parts = False, []
        for _, piece in pieces:
            flags = np.array(piece.column("_trained").to_pylist(), bool)
            asked = asked or any(piece.column("_asked").to_pylist())
            for first, last, data, at in slices(piece.column("text").to_pylist()):
                uni, _, start, both = ngrams(data, at, last - first)
                mask = np.repeat(flags[first:last], np.diff(np.append(start, len(uni))))
                parts.append((uni[mask], uni[~mask], both[mask], both[~mask]))
        yield emit(run, asked, [p[0] for p in parts], [p[1] for p in parts], False)
        yield emit(run, asked, [p[2] for p in parts], [p[3] for p in parts], True)


def _answered(rows: pa.Table, n_shards: int) -> pa.Table:
    """A shard: counts added up, filter built and probed for every distinct key; a row for each run, and one of totals."""
    import numpy as np

    shard, pair = rows.column("shard")[0].as_py(), rows.column("pair")[0].as_py()
    parts = [np.frombuffer(k.as_py(), np.uint64) for k in rows.column("keys")]
    counts = np.concatenate([np.frombuffer(c.as_py(), np.uint32) for c in rows.column("counts")]).astype(np.int64)
    keys, at = np.unique(np.concatenate(parts), return_inverse=True)
    n = np.zeros(len(keys), np.int64)
    np.add.at(n, at, counts)
    trained = n > 0
    bits = filter_bytes(keys[trained], levels(n[trained]), n_shards)
    level = LogFilter({shard: bits}, n_shards).lookup(keys).astype(np.uint8)
    out, first = [(None, b"", b"", 0, int(trained.sum()), int(n.sum()), int((n == 1).sum()))], 0
    for run, asked, part in zip(rows.column("run").to_pylist(), rows.column("asked").to_pylist(), parts):
        mine, first = at[first : first + len(part)], first + len(part)
        if asked:
            exact = b"" if pair else n[mine].astype(np.uint32 if n[mine].max() < 1 << 32 else np.uint64).tobytes()
            out.append((run, level[mine].tobytes(), exact, _sum(part), 0, 0, 0))
    columns = list(zip(*out))
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    run, level, exact, *rest = (pa.array(c, kind) for c, kind in zip(columns, kinds))
    return pa.Table.from_arrays([run, pa.array([shard] * len(out), pa.int32()), pa.array([pair] * len(out), pa.bool_()), level, exact, *rest], names=["run", "shard", "pair", "levels", "counts", "sum", "grams", "tokens", "once"])


def _sum(keys) -> int:
    """The sum of keys as a signed 64-bit number."""
    import numpy as np

    return int(keys.sum(dtype=np.uint64).astype(np.int64))


def _packed(batches: Iterator[pa.RecordBatch], run_bytes: int) -> Iterator[pa.RecordBatch]:
    """(run, blob): the rows that are asked for, compressed."""
    for run, piece in _pieces(batches, run_bytes):
        piece = piece.filter(piece.column("_asked"))
        for first in range(0, piece.num_rows, 4096):
            some, sink = piece.slice(first, 4096), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, some.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(some)
            yield pa.RecordBatch.from_arrays([pa.array([run], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["run", "blob"])


def _received(answers: pa.Table, pair: bool, keys) -> tuple:
    """(levels, counts) of the sorted keys of a run; shards follow the order of keys."""
    import numpy as np

    rows = sorted((r for r in answers.to_pylist() if r["pair"] == pair), key=lambda r: r["shard"])
    level = np.frombuffer(b"".join(r["levels"] for r in rows), np.uint8)
    if len(level) != len(keys) or sum(r["sum"] for r in rows) - _sum(keys) & (1 << 64) - 1:
        raise RuntimeError("a partition of the documents had other rows when it was read again")
    if pair:
        return level, None
    return level, np.concatenate([np.frombuffer(r["counts"], np.uint32 if len(r["counts"]) == 4 * len(r["levels"]) else np.uint64).astype(np.float64) for r in rows])


def score(docs: DataFrame, training: DataFrame | Column, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, columns in keep, n_tokens, n_known, train_tokens, base_score, score.

    training is a DataFrame with text_col, all of whose rows are counted, or a condition on docs that says which of its
    rows are (their n-grams then travel once). Tokens are runs without blanks, A-Z in lower case, and one end per text;
    null texts count as empty. base_score: exact counts with 0.1 added. score: the model's log10 probability. Ids may be
    null or repeat. Words are told apart by 64-bit hashes. The texts are read twice, in the same partitions; what an
    exchange precedes is written first, and a partition whose rows change meanwhile ends the call with an error.
    """
    spark, inside = docs.sparkSession, isinstance(training, Column)
    trained = F.coalesce(training, F.lit(False)) if inside else F.lit(False)
    source = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("text"), trained.alias("_trained"), F.lit(True).alias("_asked"))
    kept = [f for f in source.schema if f.name not in ("text", "_trained", "_asked")]
    if not inside:
        nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in kept]
        source = source.union(training.select(*nulls, F.col(text_col), F.lit(True), F.lit(False)))
    if "Exchange" in source._jdf.queryExecution().executedPlan().toString():
        source = materialise(source)
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_shards = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    run_bytes = RUN_BYTES
    requests = source.mapInArrow(lambda batches: _requests(batches, n_shards, run_bytes), _REQUEST)
    answers = materialise(requests.groupBy("shard", "pair").applyInArrow(lambda rows: _answered(rows, n_shards), _ANSWER))
    sums = answers.where("run is null and not pair").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "grams", "once")]).first()
    totals = (sums["tokens"], sums["grams"], sums["once"])
    names = [f.name for f in kept]

    def judge(texts: pa.Table, answers: pa.Table) -> pa.Table:
        import numpy as np

        from textmill.llm.tokens import slices

        rows, parts = [], []
        for blob in texts.column("blob"):
            for batch in pa.ipc.open_stream(blob.as_buffer()):
                rows.append(batch.select(names))
                for first, last, data, at in slices(batch.column("text").to_pylist()):
                    uni, _, start, both = ngrams(data, at, last - first)
                    parts.append((*np.unique(uni, return_inverse=True), *np.unique(both, return_inverse=True), start))
        u, b = np.unique(np.concatenate([p[0] for p in parts])), np.unique(np.concatenate([p[2] for p in parts]))
        model = _Model(u, *_received(answers, False, u), b, _received(answers, True, b)[0], *totals)
        got = [np.concatenate(c) for c in zip(*[model.score(*p) for p in parts])]
        out = pa.Table.from_batches(rows)
        numbers = [pa.array(got[0].astype(np.int64)), pa.array(got[1].astype(np.int64)), pa.array([totals[0]] * out.num_rows, pa.int64()), pa.array(got[2].astype(np.float64)), pa.array(got[3].astype(np.float64))]
        return pa.Table.from_arrays([*out.columns, *numbers], names=[*names, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    texts = source.mapInArrow(lambda batches: _packed(batches, run_bytes), "run bigint, blob binary")
    return texts.groupBy("run").cogroup(answers.where("run is not null").groupBy("run")).applyInArrow(lambda t, a: judge(t, a), schema).withColumnRenamed("id", id_col)


class _Model:
    """What the shards know of the n-grams of a run."""

    def __init__(self, words, one, counts, pairs, two, total, distinct, once):
        self.words, self.counts, self.pairs = words, counts, pairs
        values = level_counts()
        self.one, self.two = values[one], values[two]
        self.total, self.distinct, self.once = total, distinct, once

    def score(self, u, inv, b, b_inv, first):
        """(tokens, known tokens, base score, score) of each of the joined texts, whose words are u[inv] and pairs b[b_inv]."""
        import numpy as np

        where = np.searchsorted(self.words, u)
        c, near = self.counts[where], self.one[where]
        base = np.log10((c + 0.1) / (self.total + 0.1 * (self.distinct + 1)))
        unknown = (self.once + 1) / (self.total + 2)
        p_word = np.where(near > 0, (1 - unknown) * np.maximum(near, 0.5) / max(1, self.total), unknown)
        # the history of a token is the token before it, or the end before a text
        c_h = np.empty(len(inv))
        c_h[1:] = near[inv[:-1]]
        c_h[first] = self.one[np.searchsorted(self.words, np.uint64(END))]
        c_b = np.minimum(self.two[np.searchsorted(self.pairs, b)][b_inv], np.minimum(c_h, near[inv]))
        p = np.minimum((c_b + MU * p_word[inv]) / (c_h + MU), 1.0)
        sizes = np.diff(np.append(first, len(inv)))
        return sizes, np.add.reduceat((c > 0)[inv].astype(np.int64), first), np.add.reduceat(base[inv], first), np.add.reduceat(np.log10(p), first)


def op5_bloom_lm(spark, sf_dir: str) -> DataFrame:
    """Base and model log10 probability of every document, learnt from those with crc32 remainder other than 0."""
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    docs = docs.select("doc_id", "text", out.alias("held_out"))
    return score(docs, ~F.col("held_out"), keep=("held_out",))
