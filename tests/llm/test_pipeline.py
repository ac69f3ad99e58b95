"""The pipeline over a small folder with planted rows, against plain versions of what its stages decide."""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

pytest.importorskip("textmill.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece

from textmill.llm import minhash, quality

SF = "/root/testdata/sf0.001"


def _representatives(spark, rows):
    """Ids that stay of (doc_id, text) when each class of linked texts keeps its smallest id."""
    weights = minhash.document_frequencies(spark.createDataFrame(rows, "doc_id long, text string"), "text")
    sets = {i: weights.of_text(t) for i, t in rows}
    texts, label = dict(rows), {i: i for i, _ in rows}
    for a in sorted(texts):
        for b in sorted(texts):
            if b < a and label[a] != label[b] and (texts[a] == texts[b] or minhash.weighted_jaccard(sets[a], sets[b]) >= 0.8):
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    return {i for i in texts if label[i] == i}


def test_pipeline_equals_plain_stages(spark, tmp_path):
    for name in ("labels", "benchmark"):
        pq.write_table(pq.read_table(f"{SF}/{name}.parquet"), tmp_path / f"{name}.parquet")
    table = pq.read_table(f"{SF}/documents.parquet")
    docs = table.to_pylist()
    good = quality.keep_good(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    whole = max((r for r in good.collect() if r["lang"] == "en"), key=lambda r: len(r["text"].split())).asDict()
    words = whole["text"].split()
    words[len(words) // 2] = "otherwise"
    item = max(pq.read_table(f"{SF}/benchmark.parquet").column("text").to_pylist(), key=lambda t: len(t or ""))
    half = len(words) // 2
    planted = {900001: whole["text"], 900002: " ".join(words), 900003: " ".join([*words[:half], item]), 900004: " ".join(words[half:]) + " Write to jane.roe@example.org today."}
    docs += [{**whole, "doc_id": i, "text": t} for i, t in planted.items()]
    pq.write_table(pa.Table.from_pylist(docs, schema=table.schema), tmp_path / "documents.parquet")

    kept = {}
    given = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given = corpus_pipeline.materialise(stage(spark, given, str(tmp_path)))
        assert given.columns == table.schema.names
        kept[name] = {r["doc_id"]: r["text"] for r in given.collect()}
    assert set(planted) <= set(kept["quality"])
    assert set(kept["near_dedup"]) == _representatives(spark, list(kept["quality"].items()))
    assert not {900001, 900002} & set(kept["near_dedup"])
    assert 900003 in kept["near_dedup"] and 900003 not in kept["decontaminate"] and 900004 in kept["decontaminate"]
    assert set(kept["pii"]) == set(kept["decontaminate"]) and "jane.roe" not in kept["pii"][900004] and "[EMAIL]" in kept["pii"][900004]

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(kept["pii"])
    for r in rows:
        ids = lib.encode(kept["pii"][r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
