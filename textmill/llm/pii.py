"""PII: labelers vote on candidate spans, expectation-maximisation weighs them, a span classifier decides.

Everything that touches rows is DataFrame expressions; the driver only sees counts per vote pattern (at most one
row per bit pattern), from which it estimates the labelers' reliabilities and fits the final classifier.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import let, table

#: The base kinds in their order, a cheap necessary condition and the pattern of each. Possessive
#: repeats and look-behinds change no match; they keep the matcher from trying every start of a long run.
BASE = {
    "email": (r"@[A-Za-z0-9-]", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", r"[0-9](?:[ -]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
}
#: Kinds that only the method adds, in the order they follow the base kinds.
ADDED = ("key", "id")
#: Candidate tokens beside the base matches: visible runs that hold a digit or an at sign, without closing marks.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"

#: Word lists of the gazetteer and context labelers.
SECRET_NAMES = r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)"
KEY_SHAPES = r"^(?:AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9_-]{20,}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{30,}|hf_[A-Za-z0-9]{20,})"
CONTEXT = r"(?i)(?:call|phone|tel|mobile|fax|mail|contact|card|visa|account|iban|address|login|user|password|secret|key|ssn|passport)\W{0,3}$"
GIVEN_NAMES = (
    "Aisha|Alejandro|Alice|Amelie|Amit|Amy|Andrea|Andreas|Andrew|Angela|Anil|Anita|Anna|Anne|Anthony|Antoine|Antonio|Arjun|Barbara|Benjamin|Brian|"
    "Carlos|Carmen|Catherine|Charles|Charlotte|Christian|Christine|Christopher|Claire|Claudia|Daniel|David|Deepak|Diego|Donna|Edward|Elena|Elizabeth|"
    "Emily|Emma|Eric|Fatima|Fernando|Francisco|Frank|Gabriel|George|Hannah|Hans|Helen|Henry|Isabella|Jack|Jacques|James|Jan|Javier|Jean|Jennifer|"
    "Jessica|Johann|Johannes|John|Jonathan|Jorge|Joseph|Juan|Juergen|Julia|Julien|Karen|Karl|Katharina|Kavita|Kenneth|Kevin|Klaus|Laura|Lars|Laurent|"
    "Linda|Lisa|Louis|Lucas|Lucia|Luis|Manuel|Marc|Margaret|Maria|Marie|Mark|Martin|Mary|Matthew|Matthias|Michael|Michel|Michelle|Miguel|Mohammed|Nancy|"
    "Nicolas|Nicole|Oliver|Olivia|Pablo|Patricia|Patrick|Paul|Pedro|Peter|Philipp|Philippe|Pierre|Priya|Rafael|Rahul|Rajesh|Rebecca|Richard|Robert|"
    "Ronald|Ryan|Sabine|Samuel|Sandra|Sanjay|Sarah|Sebastian|Sergio|Sophia|Sophie|Stefan|Stephanie|Stephen|Steven|Sunita|Susan|Susanne|Sven|Thomas|"
    "Timothy|Ursula|Valentina|Vijay|Vincent|William|Wolfgang|Yves"
)
#: Candidate names: an entry of the gazetteer, initials or further entries, and a capitalised word.
NAME = r"(?<![\p{L}\p{N}_@.-])(?:" + GIVEN_NAMES + r")(?:[ -](?:" + GIVEN_NAMES + r"|\p{Lu}\.))*+ \p{Lu}[\p{L}'-]+(?![\p{N}_@])"
TOP_DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$"

#: Votes and shape features of a candidate, by bit. A labeler votes for (+) or against (-) personal data or abstains.
VOTES = (
    ("email_regex", 1), ("ip_regex", 1), ("card_regex", 1), ("phone_regex", 1), ("key_regex", 1), ("secret_name", 1),
    ("context", 1), ("gazetteer", 1), ("ssn_regex", 1), ("plain_number", -1), ("no_variety", -1),
)
FEATURES = ("long", "mixed", "assigned")


@dataclass(frozen=True)
class SpanModel:
    """Weights of the final classifier by bit, with its intercept; reliabilities are (true, false) vote rates."""

    weights: tuple[float, ...]
    bias: float
    reliabilities: tuple[tuple[float, float], ...]
    prior: float


def _spans(text: Column, pattern: str, kind: str, keep, strip: str = "") -> Column:
    """Matches as structs (kind, start, end, span): leftmost, non-overlapping, offsets in code points."""

    def place(pieces: Column, found: Column) -> Column:
        gaps = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("width")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda a, g: F.struct((a["at"] + g["gap"] + g["width"]).alias("at"), F.concat(a["out"], F.array(a["at"] + g["gap"])).alias("out"))
        starts = F.aggregate(gaps, start, step, lambda a: a["out"])
        placed = F.zip_with(starts, found, lambda at, m: F.struct(at.alias("start"), m.alias("span")))
        if strip:
            placed = F.transform(placed, lambda s: F.struct((s["start"] + F.length(F.regexp_extract(s["span"], r"^[(\[\"'<{]*", 0))).alias("start"), F.regexp_replace(s["span"], strip, "").alias("span")))
        cast = F.transform(placed, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), (s["start"] + F.length(s["span"])).alias("end"), s["span"].alias("span")))
        return F.filter(cast, lambda s: keep(s["span"]))

    empty = F.array().cast("array<struct<kind:string,start:int,end:int,span:string>>")
    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, let(F.split(text, pattern, -1), lambda p: place(p, m))).otherwise(empty))
    return F.coalesce(found, empty)


def _luhn(span: Column) -> Column:
    def passes(digits: Column) -> Column:
        n = F.length(digits)
        digit = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
        doubled = lambda i: F.when(digit(i) >= 5, digit(i) * 2 - 9).otherwise(digit(i) * 2)
        total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, doubled(i)).otherwise(digit(i)))
        return F.when(n.between(16, 19), total % 10 == 0).otherwise(False)

    return let(F.regexp_replace(span, "[ -]", ""), passes)


def _small_parts(span: Column) -> Column:
    return F.forall(F.split(span, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: F.when(F.length(q) <= 3, F.coalesce(F.nullif(q, F.lit("")).cast("int"), F.lit(0)) <= 255).otherwise(False)))


_KEEP = {
    "email": lambda s: F.lit(True),
    "ip": _small_parts,
    "card": _luhn,
    "phone": lambda s: F.length(F.regexp_replace(s, "[^0-9]", "")).between(8, 15),
}
_EMPTY = "array<struct<kind:string,start:int,end:int,span:string>>"


def base_spans(text: Column) -> Column:
    """Base matches of all four kinds in their order, each kind by start."""
    none = F.array().cast(_EMPTY)
    return F.concat(*[F.when(text.rlike(cheap), _spans(text, pattern, kind, _KEEP[kind])).otherwise(none) for kind, (cheap, pattern) in BASE.items()])


def token_spans(text: Column) -> Column:
    """Candidate tokens of six characters or more, however long, without opening and closing marks."""
    none = F.array().cast(_EMPTY)
    found = _spans(text, TOKEN, "id", lambda s: F.length(s) >= 6, strip=r"^[(\[\"'<{]+|[.,;:!?)\]\"'>}]+$")
    return F.when(text.rlike("[0-9@]"), found).otherwise(none)


def name_spans(text: Column) -> Column:
    """Candidate names: an entry of the gazetteer followed by a capitalised word."""
    return F.when(text.rlike(NAME), _spans(text, NAME, "name", lambda s: F.lit(True))).otherwise(F.array().cast(_EMPTY))


def _bits(span: Column, kind: Column, before: Column) -> Column:
    """Votes and features of a candidate as an integer, first vote in the lowest bit."""
    value = F.regexp_replace(span, r"^[A-Za-z_-]+[=:]", "")
    key, secret, ssn = value.rlike(KEY_SHAPES), span.rlike("^" + SECRET_NAMES + "[=:]."), span.rlike(r"^(?:[A-Za-z]+[=:])?[0-9]{3}-[0-9]{2}-[0-9]{4}$")
    # votes against abstain where a pattern of personal data or secrets matches the whole token
    open_ = (kind == "id") & ~(key | secret | ssn)
    flags = [
        kind == "email", kind == "ip", kind == "card", kind == "phone",
        key, secret, before.rlike(CONTEXT),
        (kind == "email") & span.rlike(TOP_DOMAINS) | (kind == "name"), ssn,
        open_ & span.rlike(r"^[-+#$€£%]?[0-9][0-9.,:/%-]*$"), open_ & ~value.rlike(r"^(?=.*[0-9].*[0-9].*[0-9])(?=.*[A-Za-z]).{8,}$"),
        F.length(value) >= 16, value.rlike("[0-9]") & value.rlike("[A-Za-z]"), span.rlike("^[A-Za-z_-]+[=:]."),
    ]
    return sum((F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(flags)), F.lit(0))


def candidates(text: Column) -> Column:
    """Base spans, then tokens and names that overlap none of them, as structs (kind, start, end, bits)."""

    def voted(base: Column) -> Column:
        free = F.filter(F.concat(token_spans(text), name_spans(text)), lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
        before = lambda s: F.substring(text, F.greatest(s["start"] - 24, F.lit(0)) + 1, F.least(s["start"], F.lit(24)))
        return F.transform(F.concat(base, free), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _bits(s["span"], s["kind"], before(s)).alias("bits")))

    return let(base_spans(text), voted)


def fit(df: DataFrame, text_col: str = "text", rounds: int = 60) -> SpanModel:
    """Reliabilities and span classifier from all candidates of all texts.

    The table is reduced to counts per bit pattern (2^14 rows at most, whatever the input), which the driver reads.
    """
    bits = df.select(F.explode_outer(F.transform(candidates(F.coalesce(F.col(text_col), F.lit(""))), lambda s: s["bits"])).alias("bits")).where("bits is not null")
    counts = [(r["bits"], r["n"]) for r in bits.groupBy("bits").agg(F.count("*").alias("n")).orderBy("bits").collect()]
    return fit_counts(counts, rounds)


def fit_counts(counts: list[tuple[int, int]], rounds: int = 60) -> SpanModel:
    """Expectation-maximisation over vote patterns, then logistic regression on its posteriors."""
    k = len(VOTES)
    votes: dict[int, int] = {}
    for b, n in counts:
        votes[b & (1 << k) - 1] = votes.get(b & (1 << k) - 1, 0) + n
    # each labeler starts out better than chance in the direction it votes in
    rates = [(0.3, 0.02) if sign > 0 else (0.05, 0.6) for _, sign in VOTES]
    prior = 0.3

    def posterior(b: int) -> float:
        up, down = math.log(prior), math.log(1 - prior)
        for i, (yes, no) in enumerate(rates):
            on = b >> i & 1
            up += math.log(yes if on else 1 - yes)
            down += math.log(no if on else 1 - no)
        return 1 / (1 + math.exp(max(-700.0, min(700.0, down - up))))

    for _ in range(rounds if votes else 0):
        soft = {b: posterior(b) for b in votes}
        yes = sum(n * soft[b] for b, n in votes.items())
        total = sum(votes.values())
        prior = min(0.99, max(0.01, (yes + 1) / (total + 2)))
        rates = [
            # a weak prior that labelers vote in their direction keeps the two classes from changing places
            (
                (sum(n * soft[b] for b, n in votes.items() if b >> i & 1) + (3 if sign > 0 else 0.5)) / (yes + 10),
                (sum(n * (1 - soft[b]) for b, n in votes.items() if b >> i & 1) + (0.2 if sign > 0 else 6)) / (total - yes + 10),
            )
            for i, (_, sign) in enumerate(VOTES)
        ]
        rates = [(min(0.995, max(0.001, a)), min(0.995, max(0.001, b))) for a, b in rates]
    width = k + len(FEATURES)
    weights, bias = [0.0] * width, 0.0
    rows = [([b >> i & 1 for i in range(width)], posterior(b & (1 << k) - 1), n) for b, n in counts]
    total = sum(math.sqrt(n) for _, _, n in rows) or 1.0
    for _ in range(400):
        slope, lean = [1e-3 * w for w in weights], 0.0
        for x, y, n in rows:
            z = bias + sum(w for w, on in zip(weights, x) if on)
            err = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y) * math.sqrt(n) / total
            lean += err
            for i, on in enumerate(x):
                if on:
                    slope[i] += err
        bias -= 2.0 * lean
        weights = [w - 2.0 * s for w, s in zip(weights, slope)]
    return SpanModel(tuple(weights), bias, tuple(rates), prior)


def spans(text: Column, model: SpanModel) -> Column:
    """All spans as structs (kind, start, end): base spans, then accepted tokens, by kind as listed, then start."""
    score = lambda b: sum((F.when(F.getbit(b, F.lit(i)) == 1, F.lit(w)).otherwise(F.lit(0.0)) for i, w in enumerate(model.weights)), F.lit(model.bias))
    is_key = lambda b: (F.getbit(b, F.lit(4)) == 1) | (F.getbit(b, F.lit(5)) == 1)
    kept = F.filter(candidates(text), lambda s: ~s["kind"].isin("id", "name") | (score(s["bits"]) > 0))

    def named(found: Column) -> Column:
        tokens = F.filter(found, lambda s: s["kind"].isin("id", "name"))
        plain = lambda xs, kind: F.transform(xs, lambda s: F.struct(F.lit(kind).alias("kind") if kind else s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
        return F.concat(
            plain(F.filter(found, lambda s: ~s["kind"].isin("id", "name")), None),
            plain(F.filter(tokens, lambda s: is_key(s["bits"])), "key"),
            F.array_sort(plain(F.filter(tokens, lambda s: ~is_key(s["bits"])), "id")),
        )

    return let(kept, named)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: SpanModel | None = None) -> DataFrame:
    """One row per input row: id and spans, an array of structs (kind, start, end), end exclusive, in code points.

    Base spans (email, ip, card, phone) are all there; key and id spans (tokens, names of the gazetteer) are those the
    span classifier accepts. A
    null or empty text has none. Repeated rows stay, ids may be null, other columns are not read, an empty table
    gives no rows (and a model without evidence). Two narrow scans; only counts per bit pattern are shuffled.
    """
    model = model or fit(df, text_col)
    return df.select(F.col(id_col), spans(F.coalesce(F.col(text_col), F.lit("")), model).alias("spans"))


def mask(df: DataFrame, text_col: str = "text", model: SpanModel | None = None) -> DataFrame:
    """df with each span of text_col replaced by its kind in capitals and brackets; overlapping spans merge.

    All other columns stay; a null text stays null.
    """
    model = model or fit(df, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))

    def cover(found: Column) -> Column:
        ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        step = lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(a["out"]).alias("out"))
        return F.aggregate(ordered, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))

    hidden = let(spans(text, model), lambda found: F.when(F.size(found) > 0, cover(found)).otherwise(text))
    return df.withColumn(text_col, F.when(F.col(text_col).isNotNull(), hidden))


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """Base counts and digest, and all spans, of every document."""
    found = find(table(spark, sf_dir, "documents"))
    listed = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: ~s["kind"].isin(*ADDED))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [number(k) for k in BASE]
    # the generator keeps the optimiser from computing the spans once for each of the columns made of them
    once = found.select("doc_id", F.explode_outer(F.array("spans")).alias("spans"))
    return once.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
