"""Operators whose exact text or number semantics need Python: Arrow batches of whole texts, nothing row by row in Spark.

Each takes and returns DataFrames; the plain functions below them are what the tests compare with.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.session import table

# ---------------------------------------------------------------- texts

_ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#[0-9]{1,7}|#x[0-9A-Fa-f]{1,6});")
#: What normalisation strips, and fenced blocks.
_NOISE = re.compile("[\u200b\ufeff\u00ad\ufffd\u202a-\u202e\u2066-\u2069\ue000-\uf8ff\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
_FENCED = re.compile(r"(```.*?(?:```|$))", re.DOTALL)


def repaired(text: str) -> str:
    """Text whose UTF-8 was read as Windows-1252 or Latin-1, read again; other text as it is. (A subset of such repairs.)"""
    if not any("Â" <= c <= "ô" for c in text):
        return text
    for wrong in ("cp1252", "latin-1"):
        try:
            return text.encode(wrong).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
    return text


def unescaped(text: str) -> tuple[str, int]:
    """Text with entities read twice, and the number of entities if that changed anything."""
    n = len(_ENTITY.findall(text))
    out = html.unescape(html.unescape(text)) if n else text
    return out, n if out != text else 0


def tidy(text: str) -> str:
    """Blanks as the reference data has them: none at line ends, single ones outside fences, at most one empty line."""
    def part(k: int, s: str) -> str:
        lines = [x.rstrip() for x in s.split("\n")]
        if k % 2:
            return "\n".join(lines)
        return re.sub("\n{3,}", "\n\n", "\n".join(re.sub(r"(?<=\S)[ \t]{2,}", " ", x) for x in lines))

    return "".join(part(k, s) for k, s in enumerate(_FENCED.split(text)))


def normalised(text: str | None) -> dict:
    """The whole normalisation of a text with what each step changed."""
    text = text or ""
    fixed = repaired(text)
    plain, entities = unescaped(fixed)
    composed = unicodedata.normalize("NFC", plain).replace("\r\n", "\n").replace("\r", "\n")
    clean = tidy(_NOISE.sub("", composed))
    return {"clean": clean, "repaired": fixed != text, "entities": entities, "composed": unicodedata.normalize("NFC", plain) != plain, "stripped": len(_NOISE.findall(composed))}


# ---------------------------------------------------------------- masking

#: Patterns of personal data and secrets, exempt mail domains, words that make a number a phone or a version.
_MAIL = re.compile(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b")
_MAIL_FIXTURES = ("example.com", "example.org", "example.net", "email.com", "domain.com", "test.com", "foo.com", "bar.com", "localhost")
_PHONE_IN = re.compile(r"\+91[\s-]?[6-9]\d{4}[\s-]?\d{5}\b")
_PHONE_US = re.compile(r"\(?(?<![\d.])\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}(?![\d.])")
_PHONE_555 = re.compile(r"\b\d{3}[\s.\-)]*555[\s.-]?\d{4}\b")
_PHONE_BARE = re.compile(r"(?<![\d.])[6-9]\d{9}(?![\d.])")
_PHONE_BEFORE = re.compile(r"\b(phone|mobile|call|contact|whatsapp|tel)\b[^\n]{0,40}$", re.IGNORECASE)
_V4 = re.compile(r"\b(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\b")
_V6 = re.compile(r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b")
_VERSION_BEFORE = re.compile(r"(?:ver|version|python|node|jdk|java|gcc|llvm|ubuntu|centos|release|build|api|rfc|sec(?:tion)?)\s*$")
_NETWORK = re.compile(r"\b(ip|address|host|server|socket|dns|ping|connect|endpoint|url|http|tcp|udp|firewall|router)\b")
_KEYS = re.compile(r"\bsk-[A-Za-z0-9]{20,}\b|\bAKIA[0-9A-Z]{16}\b|\bghp_[A-Za-z0-9]{36}\b|\bxox[bap]-[A-Za-z0-9-]{10,}\b")
_MORE_KEYS = re.compile(r"\bhf_[A-Za-z0-9]{30,}\b|\bgithub_pat_[A-Za-z0-9_]{22,}\b|\bAIza[0-9A-Za-z_-]{35}\b|-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----", re.DOTALL)
_URL_PASSWORD = re.compile(r"\b[a-z][a-z0-9+.-]*://[^/\s:@]+:([^@\s/]+)@")
_AADHAAR = re.compile(r"\b\d{4}[\s-]\d{4}[\s-]\d{4}\b")
_SSN = re.compile(r"\b\d{3}-\d{2}-\d{4}\b")
#: Networks that are private, reserved or for documentation, as first numbers of the address.
_RESERVED = ((10,), (127,), (0,), (255,), (192, 168), (169, 254), (192, 0, 2), (198, 51, 100), (203, 0, 113), *((172, x) for x in range(16, 32)))


def _address(text: str, m: re.Match, network_task: bool) -> str:
    """What becomes of a dotted quad: masked, or the reason why it stays."""
    parts = tuple(map(int, m.groups()))
    if max(parts) > 255 or any(parts[: len(r)] == r for r in _RESERVED):
        return "exempt_private_or_invalid_ip"
    before = text[: m.start()]
    prefixed = before[-1:] in ("v", "V") and not before[-2:-1].isalnum()
    small = max(parts) < 32 and parts[0] <= 20
    around = text[max(0, m.start() - 40) : m.end() + 40].lower()
    if prefixed or _VERSION_BEFORE.search(before[-16:].lower()) or (small and not _NETWORK.search(around)):
        return "exempt_version_like_ip"
    return "exempt_ip_task_content" if network_task else "masked_ip"


def masked(text: str | None, network_task: bool = False, more_keys: bool = False) -> tuple[str, Counter]:
    """Text with personal data and secrets replaced outside fences, and counts of what was masked and what is exempt."""
    counts: Counter = Counter()

    def swap(pattern: re.Pattern, mark: str, verdict):
        """Replace the matches whose verdict(text, match) starts with 'masked'; count all verdicts."""
        def run(s: str) -> str:
            def one(m: re.Match) -> str:
                kind = verdict(s, m)
                counts[kind] += 1
                return mark if kind.startswith("masked") else m.group(0)

            return pattern.sub(one, s)

        return run

    def password(s: str) -> str:
        return _URL_PASSWORD.sub(lambda m: m.group(0).replace(m.group(1), "[KEY]"), s)

    always = lambda kind: lambda s, m: kind
    steps = [
        swap(_MAIL, "[EMAIL]", lambda s, m: "exempt_fixture_email" if m.group(0).lower().endswith(_MAIL_FIXTURES) else "masked_email"),
        swap(_PHONE_IN, "[PHONE]", always("masked_phone")),
        swap(_PHONE_US, "[PHONE]", lambda s, m: "exempt_fixture_phone_555" if _PHONE_555.match(m.group(0)) else "masked_phone"),
        swap(_PHONE_BARE, "[PHONE]", lambda s, m: "masked_phone" if _PHONE_BEFORE.search(s[max(0, m.start() - 60) : m.start()]) else "exempt_bare_10digit_no_context"),
        swap(_V4, "[IP]", lambda s, m: _address(s, m, network_task)),
        *([] if network_task else [swap(_V6, "[IP]", always("masked_ip"))]),
        swap(_KEYS, "[KEY]", always("masked_key")),
        *([swap(_MORE_KEYS, "[KEY]", always("masked_key"))] if more_keys else []),
        password,
        swap(_AADHAAR, "[AADHAAR]", lambda s, m: "masked_aadhaar" if re.search("aadhaa?r", s[max(0, m.start() - 100) : m.end() + 100].lower()) else "flagged_444_digit_groups_not_masked"),
        swap(_SSN, "[SSN]", always("masked_ssn")),
    ]
    parts = _FENCED.split(text or "")
    for k, part in enumerate(parts):
        if k % 2:
            counts["exempt_code_email"] += len(_MAIL.findall(part))
            counts["exempt_code_ip"] += len(_V4.findall(part))
        else:
            for step in steps:
                part = step(part)
            parts[k] = part
    return "".join(parts), +counts


# ---------------------------------------------------------------- byte-pair tokens

SPECIALS = 4


def train_pairs(texts: list[str], merges: int) -> list[tuple[int, int]]:
    """Merges of the most frequent adjacent pair, ties to the smallest pair, until none occurs twice."""
    rows, out = [[SPECIALS + b for b in t.encode()] for t in texts], []
    for new in range(SPECIALS + 256, SPECIALS + 256 + merges):
        counts = Counter(p for r in rows for p in zip(r, r[1:]))
        best = min(counts, key=lambda p: (-counts[p], p), default=None)
        if best is None or counts[best] < 2:
            break
        out.append(best)
        rows = [_merged(r, best, new) for r in rows]
    return out


def _merged(row: list[int], pair: tuple[int, int], new: int) -> list[int]:
    out, k = [], 0
    while k < len(row):
        hit = k + 1 < len(row) and (row[k], row[k + 1]) == pair
        out.append(new if hit else row[k])
        k += 2 if hit else 1
    return out


def encode_pairs(text: str, merges: list[tuple[int, int]]) -> list[int]:
    """Ids of a text: the earliest merge that occurs is applied from the left until none does."""
    row = [SPECIALS + b for b in text.encode()]
    rank = {p: k for k, p in enumerate(merges)}
    while (first := min((rank[p] for p in zip(row, row[1:]) if p in rank), default=None)) is not None:
        row = _merged(row, merges[first], SPECIALS + 256 + first)
    return row


def decode_pairs(ids: list[int], merges: list[tuple[int, int]]) -> str:
    """The text of ids; special ids stand for nothing, broken bytes become replacement marks."""
    pieces: list[bytes] = [b""] * SPECIALS + [bytes([b]) for b in range(256)]
    for a, b in merges:
        pieces.append(pieces[a] + pieces[b])
    return b"".join(pieces[i] for i in ids).decode("utf-8", errors="replace")


# ---------------------------------------------------------------- draws, admission, floats

def draw(*coordinates) -> int:
    """64 bits that depend on the coordinates alone."""
    return int.from_bytes(hashlib.sha256("\x1f".join(map(str, coordinates)).encode()).digest()[:8], "little")


def shuffled(items: list, *coordinates) -> list:
    """Items in an order that depends on the coordinates alone: swaps from the end, each place drawn."""
    out = list(items)
    for k in reversed(range(1, len(out))):
        other = draw(*coordinates, "shuffle", k) % (k + 1)
        out[k], out[other] = out[other], out[k]
    return out


class Small32:
    """A small seeded generator of 32 bits with uniform, whole and normal draws (mulberry32)."""

    def __init__(self, seed: int):
        self.state = seed & 0xFFFFFFFF

    def uniform(self) -> float:
        self.state = self.state + 0x6D2B79F5 & 0xFFFFFFFF
        t = (self.state ^ self.state >> 15) * (self.state | 1) & 0xFFFFFFFF
        t = (t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF) ^ t) & 0xFFFFFFFF
        return ((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296

    def whole(self, n: int) -> int:
        return int(self.uniform() * n)

    def normal(self) -> float:
        return math.sqrt(-2 * math.log(max(self.uniform(), 1e-12))) * math.cos(2 * math.pi * self.uniform())


class Admission:
    """Admission in order: the state holds tokens by lane and digests of what was admitted."""

    def __init__(self, budgets: dict, floors: dict, blocked: dict, least: int = 12):
        self.budgets, self.floors, self.blocked, self.least = budgets, floors, blocked, least
        self.tokens: Counter = Counter()
        self.seen: set = set()

    def judge(self, row: dict, again: bool = False) -> tuple[str, str]:
        """(decision, reason) of a row with lane, split, digest, n_tokens and quality."""
        lane, n, digest = row["lane"], row["n_tokens"], row["digest"]
        for reason, hit in (
            (self.blocked.get(digest), digest in self.blocked), (f"{row['split']}_split", row["split"] in ("eval", "validation")), ("duplicate", digest in self.seen),
            ("quality_flagged", row["quality"] == "low"), ("quality_too_short", n < self.least),
        ):
            if hit:
                return "REJECT", reason
        decision, reason = "ACCEPT", "requeued_admitted" if again else "ok"
        if self.tokens[lane] + n > (int(self.budgets.get(lane, 0) * 1.15) if again else self.budgets.get(lane, 0)):
            if lane not in self.floors or self.tokens[lane] >= self.floors[lane]:
                return "DEFER", "budget_exhausted"
            decision, reason = "FLOOR_OVERRIDE", "protected_floor_starved"
        self.seen.add(digest)
        self.tokens[lane] += n
        return decision, reason


def admit(df: DataFrame, budgets: dict, floors: dict, blocked: dict) -> DataFrame:
    """(doc_id, pass, decision, reason, lane_tokens) of rows (doc_id, lane, split, digest, n_tokens, quality) in order of doc_id.

    What a document is given depends on all admitted before it, whatever their lane, so the fold is one stream: slim rows
    (no text) are sorted by ranges and read in order by one task, which holds the digests it admitted (the budgets bound
    them) and the deferred rows. Null splits and qualities are neither blocked nor low.
    """
    names = ["doc_id", "pass", "decision", "reason", "lane_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, deferred = Admission(budgets, floors, blocked), []

        def out(rows, number):
            found = []
            for r in rows:
                decision, reason = state.judge(r, number == 2)
                found.append((r["doc_id"], number, decision, reason, state.tokens[r["lane"]]))
                if decision == "DEFER" and number == 1:
                    deferred.append(r)
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], names=names)

        for batch in batches:
            yield out(batch.to_pylist(), 1)
        yield out(deferred, 2)

    slim = df.select(F.col("doc_id").cast("long").alias("doc_id"), "lane", "split", "digest", F.col("n_tokens").cast("long").alias("n_tokens"), "quality")
    return slim.orderBy("doc_id").coalesce(1).mapInArrow(run, "doc_id bigint, pass int, decision string, reason string, lane_tokens bigint")


#: Bits of exponent and mantissa, and whether all ones of the exponent still are numbers.
FLOATS = {"fp32": (8, 23, False), "bf16": (8, 7, False), "fp16": (5, 10, False), "e4m3": (4, 3, True)}


def float_bits(x: Fraction, kind: str) -> str | None:
    """sign|exponent|mantissa of the nearest number of a format, ties to even; None where it is too large."""
    exponent_bits, mantissa_bits, finite = FLOATS[kind]
    bias, size = (1 << exponent_bits - 1) - 1, abs(x)
    e = 1 - bias
    if size:
        e = max(e, size.numerator.bit_length() - size.denominator.bit_length() - 1)
        while Fraction(2) ** (e + 1) <= size:
            e += 1
    units = round(size / Fraction(2) ** e * (1 << mantissa_bits))  # of a Fraction: ties to even
    if units >> mantissa_bits + 1:
        units, e = units >> 1, e + 1
    normal = units >> mantissa_bits
    field = e + bias if normal else 0
    mantissa = units - (normal << mantissa_bits)
    top = (1 << exponent_bits) - (1 if finite else 2)
    if field > top or (finite and field == top and mantissa == (1 << mantissa_bits) - 1):
        return None
    return f"{int(x < 0)}|{field:0{exponent_bits}b}|{mantissa:0{mantissa_bits}b}"


# ---------------------------------------------------------------- queries

def _map(df: DataFrame, schema: str, one) -> DataFrame:
    """df (id, text) through one(text), a dict of the columns after the first, in Arrow batches."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[n] for r in rows]) for n in names[1:]]], names=names)

    return df.mapInArrow(run, schema)


def normalize_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the fully normalised text of each document, and what the steps changed."""
    done = lambda t: (r := normalised(t)) | {"clean_sha": hashlib.sha256(r["clean"].encode("utf-8", "replace")).hexdigest()}
    return _map(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id bigint, clean_sha string, repaired boolean, entities bigint, composed boolean, stripped bigint", done)


def composed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the composed form of each text, and whether composing changes it."""
    done = lambda t: {"nfc_sha": hashlib.sha256(unicodedata.normalize("NFC", t or "").encode()).hexdigest(), "changes": unicodedata.normalize("NFC", t or "") != (t or "")}
    return _map(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id bigint, nfc_sha string, changes boolean", done)


KINDS = ("masked_email", "masked_phone", "masked_ip", "masked_key", "masked_aadhaar", "masked_ssn", "exempt_fixture_email", "exempt_fixture_phone_555", "exempt_bare_10digit_no_context", "exempt_private_or_invalid_ip", "exempt_version_like_ip", "exempt_ip_task_content", "exempt_code_email", "exempt_code_ip", "flagged_444_digit_groups_not_masked")


def mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked documents: digest of the new text, whether it changed (then it gets a new id), and counts of all kinds."""
    def done(t):
        new, counts = masked(t)
        return {"masked_sha": hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(), "modified": new != (t or "")} | {k: counts[k] for k in KINDS}

    return _map(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id bigint, masked_sha string, modified boolean, " + ", ".join(f"{k} bigint" for k in KINDS), done)


def pair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in byte-pair tokens of a vocabulary trained on the benchmark items: ids, fertility, faithfulness.

    The training text is the benchmark (a stated, small table); encoding reads every whole document.
    """
    merges = train_pairs([r["text"] or "" for r in table(spark, sf_dir, "benchmark").orderBy("item_id").limit(50).collect()], 64)
    visible = lambda t: "".join((t or "").split())

    def done(t):
        ids = []
        for w in re.findall(r"\s*\S+|\s+$", t or ""):
            if w not in cache:
                if len(cache) > 100_000:
                    cache.clear()
                cache[w] = encode_pairs(w, merges)
            ids += cache[w]
        return {"n_tokens": len(ids), "ids_sha": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), "faithful": visible(decode_pairs(ids, merges)) == visible(t), "per_word": round(len(ids) / max(1, len((t or "").split())), 6)}

    cache: dict = {}
    return _map(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id bigint, n_tokens bigint, ids_sha string, faithful boolean, per_word double", done)


def two_pass_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admission of the documents by lane in two passes, with a firewall of evaluation digests, budgets and floors."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr("case lang when 'en' then 'web' when 'de' then 'code' when 'fr' then 'indic' else 'reasoning' end").alias("lane"), F.expr("case when doc_id % 20 = 0 then 'eval' else 'train' end").alias("split"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")).alias("n_tokens"))
    low = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id", F.lit("low").alias("quality")).distinct()
    evals = {r["digest"]: "eval_firewall" for r in docs.where("split = 'eval' and doc_id < 2000").select("digest").distinct().collect()}  # a stated set of at most 100
    return admit(docs.join(low, "doc_id", "left"), {"web": 60_000, "code": 20_000, "indic": 5_000, "reasoning": 10_000}, {"indic": 20_000}, evals)


def admitted_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admitted documents by lane: how many, the first and the last; a lane that has none is an error of the schedule."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    kept = two_pass_admission(spark, sf_dir).where("decision in ('ACCEPT', 'FLOOR_OVERRIDE')").join(docs, "doc_id")
    return kept.groupBy("lang").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


def shuffled_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each language and block of 512 ids in the drawn order of seed, language and block."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.expr("doc_id div 512").alias("block"))

    def run(group: pa.Table) -> pa.Table:
        lang, block = group.column("lang")[0].as_py(), group.column("block")[0].as_py()
        ids = shuffled(sorted(group.column("doc_id").to_pylist()), 17, lang, block)
        return pa.table({"lang": pa.array([lang] * len(ids), pa.string()), "block": pa.array([block] * len(ids), pa.int64()), "place": pa.array(range(len(ids)), pa.int64()), "doc_id": pa.array(ids, pa.int64())})

    return rows.groupBy("lang", "block").applyInArrow(run, "lang string, block bigint, place bigint, doc_id bigint")


def rounded_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of line items as bits of four float formats, exactly rounded."""
    rows = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_discount").distinct()
    fields = "price double, share double, " + ", ".join(f"{k} string" for k in FLOATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            price, share = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            bits = [[None if p is None or s is None else float_bits(Fraction(p) * Fraction(s), k) for p, s in zip(price, share)] for k in FLOATS]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(b, pa.string()) for b in bits]], names=["price", "share", *FLOATS])

    return rows.mapInArrow(run, fields)


def ridge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge regression of prices on quantity, discount and tax, standardised by their own statistics; one pass of sums."""
    import numpy as np

    columns, target = ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"
    every = [*columns, target]
    rows = table(spark, sf_dir, "lineitem").select(*[F.col(c).cast("double") for c in every]).dropna()
    sums = rows.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in every], *[F.covar_pop(a, b).alias(f"c_{a}_{b}") for a in every for b in every]).first()
    if not sums["n"]:
        return spark.createDataFrame([], "feature string, weight double")
    cov = np.array([[sums[f"c_{a}_{b}"] for b in every] for a in every])
    scale = np.where(cov.diagonal() > 0, np.sqrt(cov.diagonal()), 1.0)
    cor = cov / np.outer(scale, scale)
    w = np.linalg.solve(cor[:3, :3] + 1e-3 / sums["n"] * np.eye(3), cor[:3, 3])
    return spark.createDataFrame([(c, float(round(x, 6))) for c, x in zip(columns, w)], "feature string, weight double")


def principal_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two main axes of the vectors by power iteration on their covariance, which one aggregation computes."""
    import numpy as np

    rows = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("i", "x"), "vec_id")
    left = rows.select("vec_id", "i", F.col("x").cast("double").alias("x"))
    right = left.withColumnsRenamed({"i": "j", "x": "y"})
    cells = left.join(right, "vec_id").groupBy("i", "j").agg(F.covar_pop("x", "y").alias("c")).collect()  # dimensions squared
    size = 1 + max((r["i"] for r in cells), default=-1)
    cov = np.zeros((size, size))
    for r in cells:
        cov[r["i"], r["j"]] = r["c"]
    out = []
    for axis in range(2 if size else 0):
        v = np.full(size, size**-0.5)
        for _ in range(500):
            v = cov @ v
            v /= np.linalg.norm(v) or 1.0
        spread = float(v @ cov @ v)
        cov = cov - spread * np.outer(v, v)
        v = v * np.sign(v[np.abs(v).argmax()])
        out += [(axis, k, float(round(x, 5)), round(spread, 5)) for k, x in enumerate(v)]
    return spark.createDataFrame(out, "axis int, dimension int, weight double, variance double")


def small_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniform, whole and normal draws of the small generator for seeds 0 to 31."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(s, round(g.uniform(), 9), g.whole(100), round(g.normal(), 9)) for s in batch.column(0).to_pylist() for g in [Small32(s)]]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.float64()))], names=["seed", "uniform", "whole", "normal"])

    return spark.range(32).mapInArrow(run, "seed bigint, uniform double, whole bigint, normal double")


DIRECT = {f.__name__: f for f in (normalize_full, composed_text, mask_documents, pair_tokens, two_pass_admission, admitted_inventory, shuffled_pool, rounded_floats, ridge_weights, principal_axes, small_draws)}
ORACLES = {
    "composed_text": "select doc_id, sha256(nfc_normalize(coalesce(text, ''))) as nfc_sha, nfc_normalize(coalesce(text, '')) <> coalesce(text, '') as changes from documents",
    "ridge_weights": """with n as (select l_quantity::double a, l_discount::double b, l_tax::double c, l_extendedprice::double y from lineitem), s as (select count(*) n, corr(a, b) ab, corr(a, c) ac, corr(b, c) bc, corr(a, y) ay, corr(b, y) by_, corr(c, y) cy from n), l as (select *, 1 + 1e-3 / n as one from s),
d as (select *, one * (one * one - bc * bc) - ab * (ab * one - bc * ac) + ac * (ab * bc - one * ac) as det from l)
select 'l_quantity' as feature, round((ay * (one * one - bc * bc) - ab * (by_ * one - bc * cy) + ac * (by_ * bc - one * cy)) / det, 6) as weight from d
union all select 'l_discount', round((one * (by_ * one - cy * bc) - ay * (ab * one - ac * bc) + ac * (ab * cy - ac * by_)) / det, 6) from d
union all select 'l_tax', round((one * (one * cy - bc * by_) - ab * (ab * cy - ac * by_) + ay * (ab * bc - ac * one)) / det, 6) from d""",
}
