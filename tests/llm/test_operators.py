"""The training-data operators against brute force, exact round trips and odd rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("textmill.llm")
pytest.importorskip("public_tokenizers")
import public_tokenizers
import sentencepiece

from textmill.llm import bloom_lm, chat_format, decontam, lattice, license_scan, minhash, pii, quality, sentencepiece_codec, toxicity
from textmill.llm.license_texts import KNOWN

ODD = [None, "", " ", "a", "  two  spaces ", "\n\nx\n y", "▁mark ▁▁", "é\x00​😀", "word " * 3000, "y" * 20000, "same same", "same same"]
DOCS = "doc_id long, text string, lang string, n_tokens int"


def docs(spark, texts):
    return spark.createDataFrame([(k if k else None, t, None, 1) for k, t in enumerate(texts)], DOCS)


def test_sentencepiece_equals_library(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = sentencepiece_codec.encode_decode(docs(spark, ODD), path, check="texts", keep=True).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        want = lib.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert r["ids"] == want and r["decoded"] == lib.decode(want)


def test_sentencepiece_digests_equal_library(spark):
    import pyarrow.parquet as pq

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ODD + ["x" * 40 + " " + "ab" * 17, "a\x00", "日本 語" * 30, "  a  b  ", "tail ", "\n\n", "▁▁a▁ b", "a " * 40] + pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    rows = sentencepiece_codec.encode_decode(docs(spark, texts), path, outputs=("n_tokens", "ids_sha256", "decoded_sha256")).collect()
    assert len(rows) == len(texts) and spark.createDataFrame([], DOCS).transform(lambda d: sentencepiece_codec.encode_decode(d, path)).count() == 0
    for r in rows:
        ids = lib.encode(texts[r["doc_id"] or 0] or "", add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_lock_step_equals_the_heap():
    model = sentencepiece_codec.PieceModel(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read(), cache_bytes=1000)
    rng = np.random.default_rng(8)
    chunks = ["".join(rng.choice(list("abcdeilnorst\u2581é"), rng.integers(1, 30))) for _ in range(3000)]
    cache = {}
    model.learn(list(dict.fromkeys(chunks)), "", cache)
    assert all(cache[c] == sentencepiece_codec._packed(model.agenda(c)) for c in chunks)
    assert model.pack(["a b", "a b"]) == model.pack(["a b"]) * 2 and model.held < 1000


def test_license_digest_ignores_case_and_spelling(spark):
    mit = "Copyright (c) 2020 Someone\n" + KNOWN["MIT"].upper().replace("SUBLICENSE", "sublicense").replace(",", "")
    rows = license_scan.scan(docs(spark, [mit, KNOWN["ISC"] + " more", "x\nReleased under the MIT Licence", None])).collect()
    assert [r["license_id"] for r in rows] == ["MIT", None, None, None]
    assert rows[2]["notices"] == "MIT-notice" and rows[3]["digest"] is None


def test_whole_licence_texts_are_known(spark):
    ids = ["Apache-2.0", "Artistic-1.0-Perl", "BSL-1.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0", "Unlicense", "Zlib"]
    texts = ["Copyright 2020 Someone\n\n" + KNOWN[k].replace("\n", "\r\n").upper() for k in ids]
    terms = KNOWN["Apache-2.0"].split("APPENDIX")[0]
    rows = license_scan.scan(docs(spark, [*texts, terms, KNOWN["GPL-3.0"].replace("freedom", "", 1)])).collect()
    assert [r["license_id"] for r in rows] == [*ids, "Apache-2.0-terms", None]
    digests = [r["digest"] for r in license_scan.known_digests(spark).collect()]
    assert len(digests) == len(set(digests)) == len(KNOWN)


def test_pii_base_spans_equal_plain_matching(spark):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def fits(kind, s):
        d = re.sub("[^0-9]", "", s)
        total = sum(x if i % 2 == 0 else (x * 2 - 9 if x > 4 else x * 2) for i, x in enumerate(map(int, reversed(d))))
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")), "card": 16 <= len(d) <= 19 and total % 10 == 0, "phone": 8 <= len(d) <= 15}[kind]

    texts = ODD + ["a@b.cd@e.f", "a@b.c_x@d.e.f", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.255", "4111 1111-1111 1111 +1 (222) 333-4444 +123 4", "é@a.b +1.2.3.4", "9" * 5000, "a" * 50000 + "@"]
    for r in pii.find(docs(spark, texts).withColumnRenamed("n_tokens", "spans")).collect():
        text = texts[r["doc_id"] or 0] or ""
        want = [f"{k}:{m.start()}:{m.end()}" for k, p in kinds.items() for m in re.finditer(p, text) if fits(k, m.group())]
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r["spans"] if s.kind not in pii.ADDED] == want


def test_pii_long_runs_are_candidates(spark):
    jwt = "eyJhbGciOiJIUzI1NiJ9." + "aB3dE5fG7h" * 30 + ".x9Yz"
    texts = ["x", f"bearer {jwt} end", f"token={jwt}", "a1b2c3d4e5" * 5000, "9" * 5000, "y" * 20000]
    d = docs(spark, texts)
    model = pii.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    got = {r["doc_id"] or 0: [(s.kind, s.start, s.end) for s in r["spans"]] for r in pii.find(d, model=model).collect()}
    assert got == {0: [], 1: [("id", 7, 7 + len(jwt))], 2: [("key", 0, 6 + len(jwt))], 3: [("id", 0, 50000)], 4: [], 5: []}
    assert all(jwt not in r["text"] for r in pii.mask(d, model=model).collect())


def test_pii_social_security_numbers_names_and_secrets(spark):
    texts = ["x", "my ssn: 123-45-6789 ok", "see 123-45-6789 there", "(123-45-6789).", "On 2020-01-02 it was 12:30 and 1,234.50 or 123-456", "Ask John Q. Smith or Marie-Claire Dupont, today", "Mark the place. Paul said", "password=hunter2 then", "token 42 and key 17"]
    want = {0: [], 1: [("id", "123-45-6789")], 2: [("id", "123-45-6789")], 3: [("id", "123-45-6789")], 4: [], 5: [("id", "John Q. Smith"), ("id", "Marie-Claire Dupont")], 6: [], 7: [("key", "password=hunter2")], 8: []}
    tables = [docs(spark, texts), spark.read.parquet("/root/testdata/sf0.01/documents.parquet")]
    for model in map(pii.fit, tables):
        rows = pii.find(tables[0], model=model).collect()
        assert {r["doc_id"] or 0: [(s.kind, texts[r["doc_id"] or 0][s.start : s.end]) for s in r["spans"]] for r in rows} == want
    assert "123-45-6789" not in "".join(r["text"] for r in pii.mask(tables[0], model=model).collect())


def test_near_duplicates_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    long = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 300)) for _ in range(4)]
    near = long[0].split()
    near[150] = "changed"
    rows = minhash.near_duplicates(docs(spark, ["zero", *long, " ".join(near), long[1], None, None, ""])).collect()
    found = {r["doc_id"]: r["class_id"] for r in rows if r["doc_id"]}
    assert found[5] == 1 and found[6] == 2 and all(found[k] == k for k in (1, 2, 3, 4, 7, 8, 9))
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_crowd_of_copies_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [f"b{k}" for k in range(60)]
    texts = ["zero"]
    for _ in range(60):
        copy = list(base)
        for at in rng.integers(0, 60, rng.integers(1, 4)):
            copy[at] = f"e{rng.integers(0, 6)}"
        texts.append(" ".join(copy))
    d = docs(spark, texts)
    w = minhash.document_frequencies(d, "text")
    sets = [w.of_text(t) for t in texts]
    label = list(range(len(texts)))
    for a in range(1, len(texts)):
        for b in range(1, a):
            if minhash.weighted_jaccard(sets[a], sets[b]) >= 0.8 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(d).collect() if r["doc_id"]}
    assert 1 < len(set(label[1:])) < 55
    assert [got[k] for k in range(1, len(texts))] == label[1:]


def test_lattice_links_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((20, 16))
    x = np.repeat(centre, 6, axis=0) + rng.standard_normal((120, 16)) * 0.12
    rows = [(i, [float(v) for v in x[i]], int(i % 2), "n") for i in range(120)] + [(200, None, 1, "n"), (201, [0.0] * 16, 1, "n"), (202, [float("nan")] * 16, 1, "n"), (203, rows0 := [1.0] * 16, None, "n"), (204, rows0, 0, "n"), (205, rows0, 0, "n")]
    got = {r["vec_id"]: r for r in lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links string")).collect()}
    y = x.astype(np.float32).astype(np.float64)
    y /= np.linalg.norm(y, axis=1)[:, None]
    link = (y @ y.T >= 0.98) & (np.arange(120)[:, None] % 2 == np.arange(120) % 2)
    assert link.sum() > 120 and [got[i]["n_links"] for i in range(120)] == (link.sum(axis=1) - 1).tolist()
    assert got[205]["n_links"] == 1 and got[205]["component_id"] == 204 and all(got[k]["kept"] for k in (200, 201, 202, 203))


def test_lattice_cuts_large_cells_and_takes_any_dimension(spark, monkeypatch):
    monkeypatch.setattr(lattice, "CELL_ROWS", 7)
    rng = np.random.default_rng(12)
    rows = []
    for dim in (16, 64):
        x = np.repeat(rng.standard_normal((4, dim)), 40, axis=0)
        x += rng.standard_normal(x.shape) * 0.1
        rows += [(len(rows) + k, x[k].tolist(), "ab"[k % 2]) for k in range(len(x))]
    rows += [(1000 + k, rows[5][1], rows[5][2]) for k in range(9)] + [(None, [1.0], "a"), (2000, [], "a"), (2001, [None, 1.0], "b")]
    got = {r["vec_id"]: r for r in lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert len(got) == len(rows)
    unit = [(i, label, np.array(v) / np.linalg.norm(v)) for i, v, label in rows if i is not None and i < 2000]
    for i, label, v in unit:
        near = [k for k, other, w in unit if k != i and other == label and len(w) == len(v) and v @ w >= 0.98]
        assert got[i]["n_links"] == len(near) and got[i]["component_id"] <= min([i, *near])
    assert got[2000]["kept"] and got[2001]["kept"] and got[None]["n_links"] == 0
    assert max(r["n_links"] for r in got.values()) > 14
    assert lattice.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int, node int")).count() == 0


def test_e8_decodes_to_the_nearest_point():
    x = np.random.default_rng(3).standard_normal((500, 8)) * 2
    p = lattice.e8_nearest(x) / 2
    around = p[:, None, :] + np.concatenate([lattice.e8_roots(), np.zeros((1, 8))])
    assert (((x - p) ** 2).sum(1) <= ((x[:, None, :] - around) ** 2).sum(2).min(1) + 1e-9).all() and len(lattice.e8_roots()) == 240


def test_decontamination_finds_passages(spark):
    item = " ".join(f"item{k}" for k in range(30))
    edited = item.replace("item15", "other")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short one")], "item_id long, text string")
    rows = decontam.contaminated(docs(spark, ["x", "before " * 9 + item + " after", edited, "item1 item2 item3 item4 item5 then else", "Short, one", None]), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(1, 1), (4, 3)}
    assert [r["start"] for r in rows if r["doc_id"] == 1] == [9]


def test_decontamination_recall_at_the_threshold(spark):
    items = [[f"i{k}w{j}" for j in range(50)] for k in range(1000)]
    # one changed word of 50 leaves 41 of 51 shingles: similarity 0.804
    edited = [" ".join([*w[:25], "changed", *w[26:]]) for w in items]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    rows = decontam.contaminated(docs(spark, ["x", *edited]), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(k + 1, k) for k in range(1000)}
    assert all(abs(r["similarity"] - 41 / 51) < 1e-9 for r in rows)


def test_chat_collapse(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, "user", None), (4, 0, "user", None)]
    turns += [(None, 0, "user", "alone"), (None, 1, "user", "other"), (None, 0, "user", "a")]
    rows = chat_format.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert {(r["conv_id"], r["n_turns"], r["n_logged"]) for r in rows} == {(1, 2, 2), (4, 1, 1), (None, 1, 1)}
    assert len(rows) == 4 and chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string, n_turns int")).count() == 0


def test_bloom_levels_and_probabilities(spark):
    keys = np.random.default_rng(4).integers(1, 1 << 63, 3000).astype(np.uint64)
    level = bloom_lm.levels(np.arange(1, 3001))
    held = bloom_lm.LogFilter({0: bloom_lm.filter_bytes(keys, level)}, 1)
    assert (held.lookup(keys) >= level).all() and (held.lookup(keys) == level).mean() > 0.97
    d = docs(spark, ["b a", "A b\tc", "", None])
    for r in bloom_lm.score(d, d).collect():
        assert r["train_tokens"] == 9 and r["n_tokens"] == r["n_known"] and r["score"] <= 0 and r["base_score"] <= 0


def test_bloom_model_in_many_runs_and_shards_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(bloom_lm, "BROADCAST_BYTES", 0, raising=False)  # no model passes through the driver
    rng = np.random.default_rng(7)
    texts = [None if k % 50 == 0 else " ".join(f"W{int(x)}" for x in rng.zipf(1.4, int(rng.integers(0, 60))) % 500) for k in range(400)]
    d, id_col = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id"
    trained = [(t or "").lower() for k, t in enumerate(texts) if k % 3]
    c = Counter(w for t in trained for w in t.split())
    c["\n"] = len(trained)
    total, distinct = sum(c.values()), len(c)
    once = d.where(f"{id_col} % 3 <> 0")
    rows = bloom_lm.score(d, once, id_col).collect()
    assert len(rows) == 400
    for r in rows:
        words = [*(texts[r[id_col]] or "").lower().split(), "\n"]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(c[w] > 0 for w in words), total)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words))
    want = sorted(map(tuple, rows))
    monkeypatch.setattr(bloom_lm, "RUN_BYTES", 500)
    assert np.allclose(sorted(map(tuple, bloom_lm.score(d, once, id_col).collect())), want)
    assert np.allclose(sorted(map(tuple, bloom_lm.score(d.repartition(5), bloom_lm.F.expr(f"{id_col} % 3 <> 0"), id_col).collect())), want)
    monkeypatch.setattr(bloom_lm, "SHARD_BYTES", 300)
    other = bloom_lm.score(d, once, id_col).collect()  # other shards: only false positives of the filter may differ
    assert np.allclose([r[:-1] for r in want], sorted(tuple(r)[:-1] for r in other))
    assert np.allclose([r[-1] for r in want], [r[-1] for r in sorted(map(tuple, other))], rtol=0.1, atol=0.5)
    assert bloom_lm.score(d.limit(0), once, id_col).count() == 0
    assert {r["train_tokens"] for r in bloom_lm.score(d, d.limit(0), id_col).collect()} == {0}


def test_folded_weights_equal_the_kernel():
    weights, bias = toxicity.train(["idiot", "scumbag", "lowelo"], ["tion", "heron", "anble", "thing", "would"] * 3)
    one = toxicity.Scorer(weights, bias)
    u, v = toxicity.features("idixot")
    assert abs(one.margins(["idixot"])[0] - (float(weights[u] @ v) + bias)) < 1e-4
    assert toxicity.kernel("idiot", "idiot") == pytest.approx(1) and toxicity.kernel("idiot", "idixot") > toxicity.kernel("idiot", "heron")
    assert one.texts(["a i d i o t here", "", "thing would"])[0] == pytest.approx(one.margins(["aidiot"])[0], abs=1e-4)


def _plain_kneser_ney(texts, symbols, n_symbols):
    """Interpolated modified Kneser-Ney by the textbook, on tuples of symbols."""
    n, counts = quality.ORDER, Counter()
    for t in texts:
        s = [quality.END] * (n - 1) + [int(symbols[ord(c)]) for c in t or ""] + [quality.END]
        counts.update(tuple(s[i : i + n]) for i in range(len(s) - n + 1))
    levels = {n: counts}
    for k in range(n - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cuts = {k: quality.discounts([float(sum(v == j for v in c.values())) for j in (1, 2, 3, 4)]) for k, c in levels.items()}
    totals = {k: {} for k in levels}
    for k, c in levels.items():
        for g, v in c.items():
            h = totals[k].setdefault(g[:-1], [0, 0.0])
            h[0], h[1] = h[0] + v, h[1] + cuts[k][min(v, 3) - 1]

    def prob(g):
        if not g:
            return 1 / n_symbols
        k, lower = len(g), prob(g[1:])
        if g[:-1] not in totals[k]:
            return lower
        total, left = totals[k][g[:-1]]
        c = levels[k].get(g, 0)
        return (c - (cuts[k][min(c, 3) - 1] if c else 0)) / total + left / total * lower

    return prob


def test_quality_model_equals_the_textbook(spark):
    texts = ["the quick brown fox. " * 5, None, "Ein Beispiel, das 日本 hat.", "", "the quiet town"]
    trusted = docs(spark, texts).select("text")
    symbols, models = quality.fit(trusted)
    prob = _plain_kneser_ney(texts, symbols, int(symbols.max()))
    tests = ["the quick fox", "zz 漢字 😀", "", "das Beispiel"]
    g, first, sizes = quality.ngrams(tests, symbols)
    got = models[0].log2(g)
    want = []
    for t in tests:
        s = [quality.END] * (quality.ORDER - 1) + [int(symbols[ord(c)]) for c in t] + [quality.END]
        want += [np.log2(prob(tuple(s[i : i + quality.ORDER]))) for i in range(len(s) - quality.ORDER + 1)]
    assert sizes.tolist() == [len(t) + 1 for t in tests] and np.abs(got - want).max() < 1e-4
    history = [quality.END, *[int(symbols[ord(c)]) for c in "the"]]
    assert abs(sum(prob((*history, x)) for x in range(1, int(symbols.max()) + 1)) - 1) < 1e-9


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(3, 1), (4, 1), (None, 1), (5, 0), (6, None)], "doc_id long, quality int")
    rows = quality.classify(docs(spark, ODD), labels).collect()
    assert len(rows) == len(ODD) and all(r["perplexity"] > 0 and r["kept"] is not None for r in rows)
    assert {r["n_symbols"] for r in rows} >= {1, 2, 20001}
    assert all(r["kept"] for r in quality.classify(docs(spark, ODD), labels.where("quality = 0")).collect())
    assert quality.classify(docs(spark, []), labels).count() == 0


def test_quality_rejects_junk_and_keeps_held_out_trusted_rows(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    # every second trusted row is held out of the model and of the thresholds
    given = labels.where("quality = 0 or doc_id % 2 = 0")
    rows = quality.classify(d, given).join(labels, "doc_id").where("quality = 0 or doc_id % 2 = 1").select("quality", "kept").collect()
    shares = {q: np.mean([r["kept"] for r in rows if r["quality"] == q]) for q in (0, 1)}
    assert shares[0] < 0.12 and shares[1] > 0.9


def test_quality_learns_from_every_trusted_row(spark, monkeypatch):
    n, fitted, fit = 20_300, [], quality.fit
    d = spark.range(n).selectExpr("id as doc_id", "concat('word ', id % 7) as text", "'en' as lang")
    labels = d.selectExpr("doc_id", "1 as quality")
    monkeypatch.setattr(quality, "fit", lambda rows, *a: fitted.append(rows.count()) or fit(rows, *a))
    want = sorted(map(tuple, quality.classify(d, labels).collect()))
    assert fitted == [n] and len(want) == n
    monkeypatch.setattr(quality, "TRUSTED_IDS", 10)
    assert sorted(map(tuple, quality.classify(d, labels).collect())) == want and fitted == [n, n]


def test_quality_counts_in_slices_equal_plain_counts(spark, monkeypatch):
    texts = ["abcab" * 9, None, "", "xyz", "b" * 40, "abcab"] * 5
    symbols = np.arange(300) + 3
    grams = Counter(quality.ngrams(texts, symbols)[0].tolist())
    monkeypatch.setattr(quality, "HELD", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    rows = quality.count_ngrams(docs(spark, texts).coalesce(1), "text", symbols).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["g"]: r["c"] for r in rows} == grams


def _weighted_windows(text, items, threshold=0.8):
    """Brute force over all windows of a text: {item: best similarity}."""
    def grams(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []

    sets = {k: Counter(grams(t)) for k, t in items.items()}
    df = Counter(g for c in sets.values() for g in c)
    weigh = lambda g: 4 if df[g] <= 1 else 2 if df[g] <= 4 else 1
    found = {}
    sh = grams(text)
    for k, c in sets.items():
        mass = sum(n * weigh(g) for g, n in c.items())
        for lo in range(len(sh)):
            seen, both, total = Counter(), 0, 0
            for g in sh[lo:]:
                seen[g] += 1
                total += weigh(g)
                both += weigh(g) if seen[g] <= c[g] else 0
                if total > mass / threshold:
                    break
                if both / (total + mass - both) >= threshold:
                    found[k] = max(found.get(k, 0), both / (total + mass - both))
    return found


def test_decontamination_equals_brute_force_over_all_windows(spark):
    rng = np.random.default_rng(11)
    make = lambda n: [f"v{x}" for x in rng.integers(0, 400, n)]
    raw = {k: make(int(rng.integers(6, 60))) for k in range(8)}
    raw[8] = raw[0][:20] + make(10)
    raw[9] = ["echo"] * 9
    texts = ["x", "echo " * 40, " ".join(raw[1] * 3)]
    for k in range(70):
        w = list(raw[int(rng.integers(0, 9))])
        cut = int(len(w) * rng.uniform(0, 0.25))
        w = w[cut:] if k % 3 == 0 else w[: len(w) - cut] if k % 3 == 1 else w
        if k % 2 and len(w) > 8:
            w[int(rng.integers(2, len(w) - 2))] = "edit"
        texts.append(" ".join(make(int(rng.integers(0, 30))) + w + make(int(rng.integers(0, 30)))))
    items = {k: " ".join(w) for k, w in raw.items()}
    bench = spark.createDataFrame([*items.items(), (99, None), (98, "")], "item_id long, text string")
    got = {}
    for r in decontam.contaminated(docs(spark, texts), bench).collect():
        got.setdefault(r["doc_id"] or 0, {})[r["item_id"]] = r["similarity"]
    want = {k: f for k, t in enumerate(texts) if (f := _weighted_windows(t, items))}
    assert len(want) > 30 and {k: set(v) for k, v in got.items()} == {k: set(v) for k, v in want.items()}
    assert all(abs(got[k][i] - s) < 1e-9 for k, v in want.items() if k > 2 for i, s in v.items())


def test_decontamination_of_a_very_long_item_and_odd_tables(spark):
    long = " ".join(f"q{k}" for k in range(40_000))
    bench = spark.createDataFrame([(1, long, "x"), (1, "another text under the same id here", "x"), (None, "no id but a text of some words", "x")], "item_id long, text string, id string")
    d = docs(spark, ["x", "before " + long, long.replace("q20000 ", "changed ") + " after", "no id but a text of some words"])
    rows = decontam.contaminated(d, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(1, 1), (2, 1), (3, None)}
    assert next(r for r in rows if r["doc_id"] == 1)["start"] == 1
    assert decontam.contaminated(docs(spark, []), bench).count() == 0
    left = decontam.clean(d, bench.limit(0))
    assert left.columns == d.columns and left.count() == 4


def test_spread_join_equals_plain_join(spark, monkeypatch):
    """A hot key, a null key and keys without a partner; inner and left, split or not, as a plain join gives them."""
    from textmill.llm import common

    rows = spark.createDataFrame([("hot", k) for k in range(900)] + [(f"k{k}", k) for k in range(40)] + [(None, 1), ("lone", 2), ("hot", None)], "key string, n int")
    side = spark.createDataFrame([("hot", 1.0), ("unmet", 2.0), *[(f"k{k}", float(k)) for k in range(40)]], "key string, value double")
    got = lambda df: sorted(map(tuple, df.select("key", "n", "value").collect()), key=str)
    for block in (16, 256, 10_000):
        monkeypatch.setattr(common, "BLOCK_ROWS", block)
        for how in ("inner", "left"):
            assert got(common.spread_join(rows, side, "key", "n", how, common.hot_keys(rows, "key"))) == got(rows.join(side, "key", how))
    assert common.hot_keys(rows.limit(0), "key") is None
