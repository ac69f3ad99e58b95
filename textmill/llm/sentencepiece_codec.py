"""SentencePiece encoding and decoding: a score-ordered agenda of adjacent symbol pairs.

For merge-type (BPE) vocabularies the encoder keeps an agenda of adjacent symbol pairs, always merging the pair
with the best score and, among equals, the leftmost. No piece of such a vocabulary crosses from a visible
character to the space mark, and none holds a line feed (both are asserted when the model is loaded), so a text
falls apart into chunks that merge independently. Chunks that a worker has not met are encoded together: those of
equal length advance in lock-step, one merge a round, each from its own agenda (a row of pair scores); long chunks
and those with characters outside the vocabulary use a heap. Each distinct chunk is encoded once per worker and kept
in a cache bounded by its bytes; all that enters the cache is checked, batch by batch, against the library.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"
#: Characters of the longest chunk that is merged in lock-step with others; bytes of text that are encoded together.
LOCK_STEP, GROUP_BYTES = 32, 4 << 20
#: Bytes that the chunk cache of a worker may hold, and the estimated cost of an entry beside its characters and ids.
CACHE_BYTES, ENTRY_BYTES = 192 << 20, 160


class PieceModel:
    """Vocabulary, agenda encoder and chunk caches of one model; built once per Python worker."""

    def __init__(self, proto: bytes, cache_bytes: int = CACHE_BYTES, check: str = "chunks"):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(proto)
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("a merge-type vocabulary with byte fallback is needed")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
            raise ValueError("only identity normalisation with a dummy prefix is supported")
        kinds = model.SentencePiece
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        for i, p in enumerate(model.pieces):
            if p.type == kinds.NORMAL:
                self.ids[p.piece], self.rank[p.piece] = i, p.score
            elif p.type == kinds.BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
            elif p.type not in (kinds.UNKNOWN, kinds.CONTROL):
                raise ValueError(f"piece type {p.type} is not supported")
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece crosses a chunk border")
        self.bos, self.eos = self.lib.bos_id(), self.lib.eos_id()
        self.limit, self.check, self.held = cache_bytes, check, 0
        self.known: dict[str, bytes] = {}  # words after a space mark, without it
        self.bare: dict[str, bytes] = {}  # all other chunks
        self.newline = self.bytes[10].to_bytes(4, "little")
        self._pair_table()

    def _pair_table(self) -> None:
        """Arrays for the lock-step: piece of each character, and merged piece and score of each pair of pieces."""
        import numpy as np

        self.of_char = np.full(0x110000, -1, np.int64)
        pairs = {}
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
            for k in range(1, len(piece)):
                left, right = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (i, self.rank[piece])
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys = np.append(keys, np.int64(1 << 62))
        self.pair_piece = np.array([*(pairs[int(k)][0] for k in keys), 0], np.int64)
        self.pair_score = np.array([*(pairs[int(k)][1] for k in keys), 0.0])

    def pairs(self, left, right):
        """(merged piece, score) of pairs of pieces; the score is -inf where they do not merge."""
        import numpy as np

        key = left << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        return self.pair_piece[at], np.where(self.pair_keys[at] == key, self.pair_score[at], -np.inf)

    def lock_step(self, pieces):
        """Yields (rows, pieces) of chunks (n, length) once they are merged; every round each chunk takes its best pair."""
        import numpy as np

        rows = np.arange(len(pieces))
        if pieces.shape[1] < 2:
            yield rows, pieces
            return
        merged, score = self.pairs(pieces[:, :-1], pieces[:, 1:])
        while True:
            at = score.argmax(axis=1)  # the leftmost of equals
            n = np.arange(len(rows))
            on = score[n, at] > -np.inf
            if not on.all():
                yield rows[~on], pieces[~on]
                rows, pieces, merged, score, at = rows[on], pieces[on], merged[on], score[on], at[on]
                n = n[: len(rows)]
            if not len(rows):
                return
            width = pieces.shape[1] - 1
            new = merged[n, at]
            keep = np.ones(pieces.shape, bool)
            keep[n, at + 1] = False
            pieces = pieces[keep].reshape(-1, width)
            pieces[n, at] = new
            if width == 1:
                yield rows, pieces
                return
            keep = keep[:, :-1]
            keep[:] = True
            keep[n, at] = False
            merged, score = merged[keep].reshape(-1, width - 1), score[keep].reshape(-1, width - 1)
            for side in (-1, 0):  # the pairs that the new piece is part of
                some = np.flatnonzero((at + side >= 0) & (at + side < width - 1))
                j = at[some] + side
                merged[some, j], score[some, j] = self.pairs(pieces[some, j], pieces[some, j + 1])

    def agenda(self, chunk: str) -> list[int]:
        """Ids of one chunk: the best-scored adjacent pair merges first, the leftmost among equals."""
        syms: list[str] = list(chunk)
        n, rank = len(syms), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (s := rank.get(syms[i] + syms[i + 1])) is not None:
                heap.append((-s, i, syms[i] + syms[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = after[i] if syms[i] else n
            if j >= n or len(syms[i]) + len(syms[j]) != len(piece) or syms[i] + syms[j] != piece:
                continue  # one side has merged since
            syms[i], syms[j] = piece, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := rank.get(piece + syms[k])) is not None:
                    heapq.heappush(heap, (-s, i, piece + syms[k]))
            if (h := before[i]) >= 0 and (s := rank.get(syms[h] + piece)) is not None:
                heapq.heappush(heap, (-s, h, syms[h] + piece))
        out: list[int] = []
        for s in syms:
            if s:
                if (i := self.ids.get(s)) is not None:
                    out.append(i)
                else:
                    out.extend(self.bytes[b] for b in s.encode())
        return out

    def learn(self, chunks: list[str], prefix: str, cache: dict[str, bytes]) -> None:
        """Put the ids of new chunks (each after prefix) into a cache and check them against the library."""
        import numpy as np

        by_length: dict[int, list[str]] = {}
        for c in chunks:
            by_length.setdefault(len(c) + len(prefix), []).append(c)
        for length, same in by_length.items():
            if length <= LOCK_STEP:
                codes = np.frombuffer("".join([prefix + c for c in same]).encode("utf-32-le", "replace"), "<u4").reshape(len(same), length)
                pieces = self.of_char[codes]
                plain = (pieces >= 0).all(axis=1)
                spots = np.flatnonzero(plain)
                for rows, got in self.lock_step(pieces[spots]):
                    flat, wide = got.astype("<u4").tobytes(), 4 * got.shape[1]
                    for k, row in enumerate(spots[rows].tolist()):
                        cache[same[row]] = flat[k * wide : (k + 1) * wide]
                same = [same[k] for k in np.flatnonzero(~plain).tolist()]
            for c in same:
                cache[c] = _packed(self.agenda(prefix + c))
        self.held += sum(map(len, chunks)) + sum(map(len, map(cache.__getitem__, chunks))) + ENTRY_BYTES * len(chunks)
        for at in range(0, len(chunks) if self.check != "none" else 0, 2048):
            part = chunks[at : at + 2048]
            # line feeds part the chunks; the first shields them from the dummy prefix: two ids come before them
            ids = self.lib.encode("\n" + "\n".join([prefix + c for c in part]), num_threads=1)
            if np.array(ids[2:], "<u4").tobytes() != self.newline.join([cache[c] for c in part]):
                wrong = [c for c in part if _packed(self.lib.encode("\n" + prefix + c)[2:]) != cache[c]]
                raise AssertionError(f"agenda and library disagree on {wrong[:3]!r}")

    def pack(self, texts: list[str]) -> list[bytes]:
        """All ids of each text, begin and end included, as little-endian unsigned 32-bit integers."""
        cut, new, new_bare = [], set(), set()
        for text in texts:
            lines = []
            for line in (" " + text.replace(SPACE, " ")).split("\n") if text else ():
                words = line.split(" ")
                head = words[0]
                if "  " in line or line.endswith(" "):
                    runs = re.findall(" *[^ ]+| +$", line)
                    head = ""
                    lines.append((None, runs := [r.replace(" ", SPACE) for r in runs]))
                    new_bare.update(runs)
                else:
                    lines.append((head, words))
                    new.update(words[1:])
                    if head:
                        new_bare.add(head)
            cut.append(lines)
        if self.held > self.limit:
            self.known.clear()
            self.bare.clear()
            self.held = 0
        known, bare = self.known, self.bare
        if fresh := new.difference(known):
            self.learn(list(fresh), SPACE, known)
        if fresh := new_bare.difference(bare):
            self.learn(list(fresh), "", bare)
        begin, end = self.bos.to_bytes(4, "little"), self.eos.to_bytes(4, "little")
        out = []
        for lines in cut:
            packed = []
            for head, words in lines:
                if head is None:
                    packed.append(b"".join([bare[w] for w in words]))
                else:
                    rest = b"".join([known[w] for w in words[1:]])
                    packed.append(bare[head] + rest if head else rest)
            out.append(begin + self.newline.join(packed) + end)
        return out


_loaded: dict[tuple, PieceModel] = {}


def _model(proto: bytes, cache_bytes: int, check: str) -> PieceModel:
    """The model of this worker: kept, with its caches, from one task to the next; one at a time."""
    key = (hashlib.sha256(proto).digest(), cache_bytes, check)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = PieceModel(proto, cache_bytes, check)
    return _loaded[key]


def _packed(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


def encode_decode(
    df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
    outputs: tuple[str, ...] = ("ids", "decoded"), check: str = "chunks", cache_bytes: int = CACHE_BYTES, keep: bool = False,
) -> DataFrame:
    """Encode every whole text with begin and end ids and decode the ids again; one row per input row.

    outputs: any of ids (array<int>), decoded (string), n_tokens (long, all ids), ids_sha256 (of the ids as
    little-endian unsigned 32-bit integers), decoded_sha256 (of the decoded UTF-8 text).
    check: "chunks" compares every distinct chunk with the library, "texts" every whole text, "none" nothing.
    keep: also return all input columns; otherwise only id_col. An input column named like an output is replaced.
    A null text counts as empty: only the begin and end ids. Repeated rows stay; an empty table gives no rows.
    The model is read on the driver from model_path and travels with the job. Narrow: no shuffle; a worker
    holds one Arrow batch and bounded caches.
    """
    with open(model_path, "rb") as f:
        proto = f.read()
    kinds = {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    arrow = {"ids": pa.list_(pa.int32()), "decoded": pa.string(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    source = df if keep else df.select(id_col, text_col)
    kept = [f for f in source.schema.fields if f.name not in outputs and (keep or f.name == id_col)]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in kept] + [T.StructField(o, kinds[o]) for o in outputs])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        model = _model(proto, cache_bytes, check)
        for batch in batches:
            got: dict[str, list] = {o: [] for o in outputs}
            column, start = batch.column(text_col), 0
            while start < batch.num_rows:
                texts, size = [], 0
                while start < batch.num_rows and size < GROUP_BYTES:
                    texts.append(column[start].as_py() or "")
                    size += len(texts[-1])
                    start += 1
                for text, packed in zip(texts, model.pack(texts)):
                    ids = np.frombuffer(packed, dtype="<u4").tolist()
                    if check == "texts" and ids != model.lib.encode(text, add_bos=True, add_eos=True):
                        raise AssertionError("agenda and library disagree on a text")
                    back = model.lib.decode(ids)
                    for o in outputs:
                        got[o].append(
                            ids if o == "ids" else back if o == "decoded" else len(ids) if o == "n_tokens"
                            else hashlib.sha256(packed).hexdigest() if o == "ids_sha256" else hashlib.sha256(back.encode()).hexdigest()
                        )
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(got[o], arrow[o]) for o in outputs], names=[*names, *outputs])

    return source.mapInArrow(run, schema)


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them, with the 32k merge vocabulary."""
    import public_tokenizers

    from textmill.llm.common import table

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
