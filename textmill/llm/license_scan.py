"""License scans: canonical digest lookup of entire texts against known licence texts, JVM-side only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import let, table
from textmill.llm.license_texts import EQUIVALENT, KNOWN

#: Known licences are a fixed table; beyond this many the join is left to the optimiser instead of broadcast.
BROADCAST_ROWS = 100_000


def canonical(text: Column) -> Column:
    """The text in canonical form: lower case, no copyright lines, no punctuation, one spelling, single spaces.

    Words stand between double spaces while spellings are replaced, so that neighbours never share a border.
    """
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?m)^[^\n]*(?:copyright (?:\(c\)|©|[0-9])|©|all rights reserved)[^\n]*$", " ")
    t = F.concat(F.lit(" "), F.regexp_replace(t, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    for spelling, usual in EQUIVALENT.items():
        t = F.replace(t, F.lit(f" {spelling} "), F.lit(f" {usual} "))
    return F.trim(F.replace(t, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    """sha256 of the canonical form, null where nothing is left of the text."""
    return let(canonical(text), lambda c: F.when(c != "", F.sha2(c, 256)))


def known_digests(spark, known: dict[str, str] = KNOWN) -> DataFrame:
    """(license_id, digest), one row per digest: equal canonical texts keep the first id in order."""
    rows = spark.createDataFrame(list(known.items()), "license_id string, license_text string")
    return rows.select("license_id", digest(F.col("license_text")).alias("digest")).where("digest is not null").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, str] = KNOWN) -> DataFrame:
    """One row per input row: id, digest, license_id, notices.

    license_id: the known licence whose canonical digest equals that of the entire text, else null. notices: the ids,
    sorted and comma-joined, of known texts that are entire lines of the text ("" without any); a line is looked at
    only if it holds one of the first words of the known texts' lines, which loses no match.
    Null and empty texts have a null digest and no licence. Repeated rows stay, ids may be null; other columns are
    not read. Narrow but for the broadcast of the known digests, whose number is checked.
    """
    spark = df.sparkSession
    hashes = known_digests(spark, known)
    side = F.broadcast(hashes) if len(known) <= BROADCAST_ROWS else hashes
    # single-line notices: their digests are literals of the plan, so lines are looked up without a shuffle
    short = {k: v for k, v in known.items() if "\n" not in v}
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.array().cast("array<string>")
    if short:
        pairs = {r["digest"]: r["license_id"] for r in known_digests(spark, short).collect()}  # bounded by `known`
        lookup = F.create_map(*[F.lit(x) for kv in sorted(pairs.items()) for x in kv])
        lines = F.filter(F.split(text, "\n"), lambda x: F.lower(x).rlike("licen[sc]e|public domain"))
        found = F.array_sort(F.array_distinct(F.array_compact(F.transform(lines, lambda x: F.try_element_at(lookup, F.coalesce(digest(x), F.lit("")))))))
        if not all(("licen" in v.lower() or "public domain" in v.lower()) for v in short.values()):
            raise ValueError("a one-line notice has none of the words that lines are searched for")
    rows = df.select(F.col(id_col), digest(F.col(text_col)).alias("digest"), F.array_join(found, ",").alias("notices"))
    return rows.join(side, "digest", "left").select(id_col, "digest", "license_id", "notices")


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence of every document by the digest of its whole text, and its one-line licence notices."""
    return scan(table(spark, sf_dir, "documents"))


def _sql_canonical(t: str) -> str:
    quote = lambda x: x.replace("'", "''")
    t = f"regexp_replace(lower(coalesce({t}, '')), '(?m)^[^\\n]*(?:copyright (?:\\(c\\)|©|[0-9])|©|all rights reserved)[^\\n]*$', ' ', 'g')"
    t = f"' ' || regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || ' '"
    for spelling, usual in EQUIVALENT.items():
        t = f"replace({t}, ' {quote(spelling)} ', ' {quote(usual)} ')"
    return f"trim(replace({t}, '  ', ' '))"


def oracle() -> str:
    quote = lambda x: x.replace("'", "''")
    values = ", ".join(f"('{quote(k)}', '{quote(v)}')" for k, v in KNOWN.items())
    return f"""
with known as (select sha256({_sql_canonical('license_text')}) digest, min(license_id) license_id, bool_and(strpos(license_text, chr(10)) = 0) short
  from (values {values}) k(license_id, license_text) group by 1),
docs as (select doc_id, {_sql_canonical('text')} c, text from documents),
lines as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line from documents),
hits as (select doc_id, string_agg(distinct license_id, ',' order by license_id) notices
  from (select doc_id, sha256({_sql_canonical('line')}) digest from lines where regexp_matches(lower(line), 'licen[sc]e|public domain')) join known using (digest) where short group by 1)
select d.doc_id, case when c <> '' then sha256(c) end digest, k.license_id, coalesce(h.notices, '') notices
from docs d left join known k on k.digest = case when c <> '' then sha256(c) end left join hits h on h.doc_id = d.doc_id"""
