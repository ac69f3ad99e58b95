"""Embedding near-dedup: lattice hashing with E8 cells, probing of neighbouring cells, exact cosine.

Each table projects unit vectors by a random orthonormal matrix to blocks of eight dimensions and decodes every
block to the nearest point of the scaled E8 lattice; the points are the vector's cell. A vector is written to its
own cell and, for each block, to the cell on the nearest side of the lattice point. Vectors that meet in a cell,
one of them at home, are compared exactly. A pair that meets in several tables counts in the first only, which
each task decides from the vectors alone. Cells with many vectors are cut into blocks whose pairs are separate
groups, so no task holds more than two blocks; tasks return counts and one spanning edge per vector, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import components, materialise, table

SEED = 8128
#: Tables, blocks of eight dimensions per table, and side of the lattice for 64 dimensions (a block holds a larger
#: share of a shorter vector, so the side grows with the root of 64 / dimensions): at cosine 0.98 a pair shares a table with
#: a probability of 0.76 to 0.78, and misses all of them with about 1e-5; pairs of greater cosine meet more often.
TABLES, BLOCKS, SCALE = 8, 2, 0.3
#: Vectors of a cell that are compared within one group; larger cells are cut into blocks of about this size.
CELL_ROWS = 1500


def e8_nearest(x):
    """The nearest E8 lattice point of each row of x (n, 8), doubled so that it is made of integers."""
    import numpy as np

    def d8(y):
        z = np.rint(y)
        gap = y - z
        worst = np.abs(gap).argmax(axis=1)
        rows = np.arange(len(y))
        flip = (z.sum(axis=1) % 2 != 0)[:, None] & (np.arange(8) == worst[:, None])
        return np.where(flip, z + np.where(gap >= 0, 1, -1), z) if len(rows) else z

    a, b = d8(x), d8(x - 0.5) + 0.5
    near = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.rint(2 * np.where(near[:, None], a, b)).astype(np.int64)


def e8_roots():
    """The 240 shortest lattice vectors: the steps to neighbouring cells."""
    import itertools

    import numpy as np

    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((-1, 1), repeat=2):
            v = [0.0] * 8
            v[i], v[j] = s, t
            out.append(v)
    out += [[s / 2 for s in signs] for signs in itertools.product((-1, 1), repeat=8) if signs.count(-1) % 2 == 0]
    return np.array(out)


class Hasher:
    """Cells of vectors of one dimension in all tables."""

    def __init__(self, dim: int):
        import numpy as np

        rng = np.random.default_rng([SEED, dim])
        wide = max(dim, 8 * BLOCKS)
        side = SCALE * (64 / wide) ** 0.5
        self.dim, self.turns = dim, [np.linalg.qr(rng.standard_normal((wide, wide)))[0][:dim, : 8 * BLOCKS] / side for _ in range(TABLES)]
        self.salt = rng.integers(1, 1 << 62, (TABLES, BLOCKS, 8)).astype(np.uint64) | np.uint64(1)
        self.roots = e8_roots()

    def cells(self, unit):
        """(n, TABLES, 1 + BLOCKS) keys: the home cell, then for each block the cell next to it."""
        import numpy as np

        from textmill.llm.tokens import mix

        out = np.zeros((len(unit), TABLES, 1 + BLOCKS), np.uint64)
        for t, turn in enumerate(self.turns):
            flat = np.einsum("nd,dk->nk", unit, turn)  # the same bits for a vector in any batch, unlike a blocked product
            own, beside = [], []
            for b in range(BLOCKS):
                x = flat[:, 8 * b : 8 * b + 8]
                point = e8_nearest(x)
                step = self.roots[((x - point / 2) @ self.roots.T).argmax(axis=1)]
                code = lambda p: (p.astype(np.uint64) * self.salt[t, b]).sum(axis=1, dtype=np.uint64)  # noqa: B023, E731
                own.append(mix(code(point)))
                beside.append(mix(code(point + np.rint(2 * step).astype(np.int64))))
            home = sum(own)
            for p in range(1 + BLOCKS):
                out[:, t, p] = mix((home if p == 0 else home - own[p - 1] + beside[p - 1]) + np.uint64(t))
        return out.view(np.int64)


def _classes(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the 128 bits h1, h2 of a usable vector, distinct usable vectors): equal vectors of a label are one node with a weight."""
    v = F.col("vec")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = v.isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall(v, number), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    kind = "float" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast(f"array<{kind}>").alias("vec"), F.col(label_col).alias("label"))
    rows = rows.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0).cast(kind)))  # no negative zero
    rows = rows.select("id", "vec", "label", usable.alias("usable"))
    rows = rows.withColumn("h1", F.when(F.col("usable"), F.xxhash64("label", "vec"))).withColumn("h2", F.when(F.col("usable"), F.xxhash64(F.lit(SEED), "vec", "label")))
    nodes = rows.where("usable").groupBy("h1", "h2").agg(F.count("*").alias("weight"), F.min("id").alias("first_id"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    return rows, nodes.withColumn("node", F.monotonically_increasing_id())


def _unit(x):
    """Rows of x in double precision at length 1, without overflow."""
    import numpy as np

    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _keyed(nodes: DataFrame) -> DataFrame:
    """(node, spot, key, home) for every cell a vector is written to; the vector itself stays behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        hashers: dict[int, Hasher] = {}
        for batch in batches:
            vecs = batch.column("vec")
            dims = np.asarray(vecs.value_lengths())
            for dim in np.unique(dims).tolist():
                rows = pa.array(np.flatnonzero(dims == dim))
                x = _unit(vecs.take(rows).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim))
                keys = hashers.setdefault(dim, Hasher(dim)).cells(x)
                label = batch.column("label_key").take(rows).to_numpy(zero_copy_only=False)
                keys = keys ^ (label * np.int64(-7046029254386353131) + np.int64(dim))[:, None, None]
                n, spots = len(rows), TABLES * (1 + BLOCKS)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("node").take(rows).take(pa.array(np.repeat(np.arange(n), spots))),
                        pa.array(np.tile(np.repeat(np.arange(TABLES), 1 + BLOCKS), n), pa.int32()), pa.array(keys.reshape(-1), pa.int64()),
                        pa.array(np.tile(np.arange(1 + BLOCKS) == 0, n * TABLES)),
                    ],
                    names=["node", "spot", "key", "home"],
                )

    slim = nodes.select("node", "vec", F.xxhash64("label").alias("label_key"))
    return slim.mapInArrow(run, "node bigint, spot int, key bigint, home boolean")


#: Rows equal in these are compared with each other.
GROUP = ["spot", "key", "dim", "lo", "hi"]
#: Groups up to this size are compared pair by pair in one pass over all of them, larger ones by a product of matrices.
SMALL = 64


def _pairs(x, home, starts, ends, lo, hi, block, threshold: float):
    """(i, j) of all pairs of rows of one group at the threshold, one of the two at home."""
    import numpy as np

    size = ends - starts
    small = (size <= SMALL) & (lo == hi)
    end = np.repeat(np.where(small, ends, 0), size)
    row = np.arange(len(x))
    count = np.maximum(end - row - 1, 0)
    i = np.repeat(row, count)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
    some = home[i] | home[j]
    i, j = i[some], j[some]
    near = [np.zeros(0, bool)] + [np.einsum("nd,nd->n", x[i[k : k + 16384]], x[j[k : k + 16384]]) >= threshold for k in range(0, len(i), 16384)]
    near = np.concatenate(near)
    found = [(i[near], j[near])]
    for g in np.flatnonzero(~small).tolist():
        rows = row[starts[g] : ends[g]]
        first, second = (rows, rows) if lo[g] == hi[g] else (rows[block[rows] == lo[g]], rows[block[rows] == hi[g]])
        i, j = np.nonzero((x[first] @ x[second].T >= threshold) & (home[first][:, None] | home[second][None, :]))
        i, j = first[i], second[j]
        found.append((i, j) if lo[g] != hi[g] else (i[i < j], j[i < j]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _own(cells, at_i, at_j, spot, node_i, node_j, home_i, home_j):
    """Whether a pair that meets in table `spot` counts there: no earlier table has it, and one side only."""
    import numpy as np

    own = np.zeros(len(spot), bool)
    for start in range(0, len(spot), 1 << 17):
        part = slice(start, start + (1 << 17))
        a, b, t = cells[at_i[part]], cells[at_j[part]], spot[part]
        row = np.arange(len(t))
        ab = (a[:, :, :1] == b).any(axis=2)  # home of a among the cells of b
        ba = (b[:, :, :1] == a).any(axis=2)
        earlier = ((ab | ba) & (np.arange(TABLES) < t[:, None])).any(axis=1)
        # met from both sides in different cells of this table: counts where the smaller node is at home
        twice = ab[row, t] & ba[row, t] & (a[row, t, 0] != b[row, t, 0])
        own[part] = ~earlier & (~twice | np.where(node_i[part] < node_j[part], home_i[part], home_j[part]))
    return own


def _links(rows: pa.RecordBatch, hasher: Hasher, threshold: float) -> pa.RecordBatch:
    """(node, n_links, root) of whole groups of one dimension: own links of each row and the smallest row they reach."""
    import numpy as np

    col = {c: rows.column(c).to_numpy(zero_copy_only=False) for c in ("node", "home", "weight", "block", *GROUP)}
    node, home, weight, spot = col["node"], col["home"], col["weight"], col["spot"]
    sign = np.column_stack([col[c] for c in GROUP])
    starts = np.concatenate([[0], np.flatnonzero((sign[1:] != sign[:-1]).any(axis=1)) + 1])
    ends = np.append(starts[1:], len(node))
    x = _unit(rows.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(node), hasher.dim))
    i, j = _pairs(x, home, starts, ends, col["lo"][starts], col["hi"][starts], col["block"], threshold)
    differ = node[i] != node[j]
    i, j = i[differ], j[differ]
    if not len(i):
        return _rows([], [], [])
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    own = _own(hasher.cells(x[used]), at[: len(i)], at[len(i) :], spot[i], node[i], node[j], home[i], home[j])
    i, j = i[own], j[own]
    n_links = np.zeros(len(x), np.int64)
    np.add.at(n_links, i, weight[j])
    np.add.at(n_links, j, weight[i])
    root = np.arange(len(x))
    while True:  # smallest member reachable within the group
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (before == root).all():
            break
    some = np.flatnonzero(n_links)
    return _rows(node[some], n_links[some], node[root[some]])


def _compare(threshold: float):
    """Streams rows sorted by group; a group, two blocks of a cell at most, is compared once it is complete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        hashers: dict[int, Hasher] = {}
        held: list[pa.RecordBatch] = []

        def settle(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(parts).combine_chunks()
            dims = whole.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                some = whole.filter(pa.array(dims == dim)).combine_chunks()
                yield _links(some.to_batches()[0], hashers.setdefault(dim, Hasher(dim)), threshold)

        for batch in batches:
            if not batch.num_rows:
                continue
            sign = np.column_stack([batch.column(c).to_numpy() for c in GROUP])
            other = np.flatnonzero((sign != sign[-1]).any(axis=1))
            cut = int(other[-1]) + 1 if len(other) else 0  # the last group may go on in the next batch
            if held and (cut or any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in GROUP)):
                yield from settle([*held, batch.slice(0, cut)])
                held = []
            elif cut:
                yield from settle([batch.slice(0, cut)])
            held.append(batch.slice(cut))
        if held:
            yield from settle(held)

    return run


def _rows(node, n_links, root) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (node, n_links, root)], names=["node", "n_links", "root"])


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Rows link if their labels are equal and not null and their cosine in double precision is >= threshold. Vectors
    that are null, empty, zero or hold null or non-finite components, and rows without a label, link with nothing: no
    links, their own component, kept. Vectors of different lengths never link. n_links counts other rows linked
    directly, equal vectors included; component_id is the smallest id reachable; kept = (id is component_id).
    Null ids are fine (never smallest). Repeated rows are rows. Other columns are not read. Equal vectors are told by
    128 bits of hash. Cells are found on keys alone; vectors travel only to cells where another vector can meet them.
    """
    rows, nodes = _classes(df, id_col, vec_col, label_col)
    nodes = materialise(nodes)
    keyed = materialise(_keyed(nodes))
    cells = keyed.groupBy("spot", "key").agg(F.count("*").alias("n"), F.max("home").alias("lived_in")).where("n > 1 and lived_in")
    cells = cells.select("spot", "key", F.ceil(F.col("n") / CELL_ROWS).cast("int").alias("parts"))
    met = keyed.join(cells, ["spot", "key"]).withColumn("block", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    met = met.join(nodes.select("node", "weight", "vec", F.size("vec").alias("dim")), "node")
    spread = met.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
        "node", "weight", "vec", "dim", "spot", "key", "home", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
    )
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = spread.repartition(width, *GROUP).sortWithinPartitions(*GROUP, "node", F.desc("home"))
    found = materialise(grouped.mapInArrow(_compare(threshold), "node bigint, n_links bigint, root bigint"))
    counts = found.groupBy("node").agg(F.sum("n_links").alias("linked"))
    label = components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    whole = nodes.select("node", "h1", "h2", "weight", "first_id").join(label, "node", "left").join(counts, "node", "left")
    whole = whole.select("h1", "h2", "weight", "first_id", F.coalesce("component", "node").alias("component"), F.coalesce("linked", F.lit(0)).alias("linked"))
    smallest = whole.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = whole.join(smallest, "component").select("h1", "h2", (F.col("weight") - 1 + F.col("linked")).alias("n_links"), "component_id")
    joined = rows.select("id", "h1", "h2").join(known, ["h1", "h2"], "left")
    return joined.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def op2_lattice_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.98 within a label."""
    return near_vectors(table(spark, sf_dir, "embeddings")).withColumn("component_id", F.col("component_id").cast("long"))


def oracle() -> str:
    return """
with recursive v as (select vec_id, label, embedding::double[] e from embeddings where label is not null and embedding is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.98),
r(a, b) as (select a, b from p union select r.a, p.b from r join p on r.b = p.a),
c as (select a, least(a, min(b)) component_id from r group by 1),
n as (select a, count(*) n_links from p group by 1)
select vec_id, coalesce(n_links, 0)::bigint n_links, coalesce(component_id, vec_id) component_id, coalesce(component_id, vec_id) = vec_id kept
from embeddings left join n on n.a = vec_id left join c on c.a = vec_id"""
