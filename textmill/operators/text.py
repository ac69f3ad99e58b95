"""Text operators: normalisation, statistics, quality rules, histograms, fertility."""

from __future__ import annotations

#: Stop words of the quality rule, and the signals of code and mathematics.
STOP_WORDS = ("the", "be", "to", "of", "and", "that", "have", "with")

#: Blanks as the rules know them (the first without the line feed).
INLINE = "\\t\\r \\x{0B}\\x{0C}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
BLANK, VISIBLE = f"[\\n{INLINE}]", f"[^\\n{INLINE}]"
#: Characters that normalisation removes, and the control characters among them.
CONTROL = "\\x{00}-\\x{08}\\x{0B}\\x{0C}\\x{0E}-\\x{1F}\\x{7F}-\\x{9F}"
NOISE = "[\\x{200B}\\x{FEFF}\\x{00AD}\\x{FFFD}\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}\\x{E000}-\\x{F8FF}" + CONTROL + "]"
#: Signals of code and of mathematics.
CODE = "```|\\bdef[ \\t\\n\\r]+[A-Za-z0-9_]+[ \\t\\n\\r]*\\(|#include\\b|\\bclass[ \\t\\n\\r]+[A-Za-z0-9_]+|stdin|function[ \\t\\n\\r]*\\(|public[ \\t\\n\\r]+static"
MATHS = "\\\\(?:boxed|frac|sqrt|sum|int|begin|end|text|mathrm|left|right)[{\\\\]|\\$[^$\\n]{1,120}\\$|\\\\\\[|\\\\\\]|\\\\boxed"

words = lambda d, x: d.keep(d.split(f"trim({x})", "[ \\t\\n\\r]+"), "w", "w <> ''")
shingle_words = lambda d, x: d.keep(d.split(f"lower({x})", "[^\\p{L}\\p{N}_]+"), "w", "w <> ''")


def fence(d):
    """A fenced block, or an unclosed one to the end of the text."""
    return "(?sd)```.*?(?:```|$)" if d.name == "spark" else "(?s)```.*?(?:```|\\z)"


def without_fences(d, x):
    return d.replace(x, fence(d), "")


def collapsed(d, x):
    """Blanks at line ends go; outside fences runs of blanks inside a line become one and empty lines fold to one."""
    ends = lambda t: d.replace(t, f"[{INLINE}]+(\\n|\\z)", d.group(1))
    prose = lambda t: d.replace(d.replace(ends(t), f"({VISIBLE})[ \\t]{{2,}}", d.group(1) + " "), "\\n{3,}", d.lines(2))
    return d.by_parts(x, fence(d), prose, ends)


def fidelity(d, x):
    """Line ends become line feeds and noise goes; all else stays as it is."""
    return d.replace(d.replace(x, "\\r\\n?", d.lines(1)), NOISE, "")


def normalize_text(d):
    t = collapsed(d, "f")
    return f"select doc_id, {d.sha(t)} as clean_sha, cast(length({t}) as bigint) as clean_chars, cast(length(text) - length({t}) as bigint) as removed from (select doc_id, text, {fidelity(d, 'text')} as f from documents) q"


def fidelity_text(d):
    return f"select conv_id, turn, {d.sha(fidelity(d, 'text'))} as clean_sha, cast({d.count('text', '[ ' + chr(92) + 't]+' + chr(92) + 'n')} as bigint) as trailing_lines from conversations"


def text_stats(d):
    w = words(d, "text")
    return f"""select doc_id, cast(length(text) as bigint) as chars, cast({d.size(w)} as bigint) as words,
  cast({d.count('text', '[\\p{L}\\p{M}\\p{N}]+|[^ \\t\\n\\r\\p{L}\\p{M}\\p{N}]')} as bigint) as faithful_units,
  cast({d.count('text', chr(92) + 'p{L}')} as bigint) as letters, cast({d.count('text', '[A-Za-z]')} as bigint) as ascii_letters from documents"""


def ascii_fraction(d):
    return f"select doc_id, round({d.count('text', '[A-Za-z]')} / cast(greatest(1, {d.count('text', chr(92) + 'p{L}')}) as double), 6) as ascii_frac from documents"


def bench_norm(d):
    t = d.replace(d.replace("lower(text)", "[^a-z0-9 \\t\\n\\r]+", " "), "[ \\t\\n\\r]+", " ")
    return f"select item_id, trim({t}) as norm from benchmark"


def naive_shingler(d):
    w = d.keep(d.split("lower(text)", "[^a-z0-9]+"), "w", "w <> ''")
    return f"select lang, count(*) as docs, cast(sum(case when {d.size(w)} = 0 then 1 else 0 end) as bigint) as empty_docs from documents group by lang"


def snippet(d):
    return "select doc_id, case when length(text) > 280 then substring(replace(text, chr(10), ' '), 1, 280) || '...' else replace(text, chr(10), ' ') end as snippet from documents"


def prose_sample(d):
    return f"select doc_id, substring({d.replace('text', '[ \\t\\n\\r]+', ' ')}, 1, 1500) as sample from documents"


def classifier_input(d):
    return f"select {d.sha('substring(trim(text), 1, 4000)')} as input_key, min(doc_id) as doc_id, count(*) as copies from documents group by 1"


def domain(d, x):
    """code, math or prose; code wins, mathematics takes two signals or a boxed result."""
    return f"case when {d.matches(x, CODE)} then 'code' when {d.count(x, MATHS)} >= 2 or {d.matches(x, chr(92) * 2 + 'boxed')} then 'math' else 'prose' end"


def rule_columns(d, both):
    """The quality rules of a column with words (w), lines (l) and text without fences (p); true where a rule fails."""
    lw = d.keep("w", "x", d.matches("x", "[A-Za-z]"))
    return {
        "lorem_ipsum": d.matches(f"lower({both})", "lorem ipsum"),
        "word_count_range": f"{d.size('w')} < 10 or {d.size('w')} > 100000",
        "mean_word_length": f"{d.size(lw)} > 0 and (length({d.join(lw, '')}) / cast(greatest({d.size(lw)}, 1) as double) not between 2 and 12)",
        "symbol_ratio": f"({d.count('p', '#')} + {d.count('p', '…|[.][.][.]')}) / cast(greatest(1, {d.count('p', VISIBLE + '+')}) as double) >= 0.1",
        "stop_words": f"{d.overlap(d.distinct(d.found(f'lower({both})', '[a-z]+')), d.strings(STOP_WORDS))} < 2",
        "duplicate_lines": f"{d.size('l')} > 0 and 1 - {d.size(d.distinct('l'))} / cast(greatest({d.size('l')}, 1) as double) >= 0.30",
        "non_printable": d.matches(both, f"[{CONTROL}]"),
    }


def prepared(d, both):
    """What rule_columns reads, of a column: words, lines of ten characters or more without blanks around, prose."""
    strip = lambda x: d.replace(x, f"\\A{BLANK}+|{BLANK}+\\z", "")
    return f"{d.found(both, VISIBLE + '+')} as w, {d.keep(d.each(d.split(both, chr(92) + 'n'), 'l', strip('l')), 'l', 'length(l) >= 10')} as l, {without_fences(d, both)} as p"


def _rules(d):
    rules = rule_columns(d, "text")
    blank = f"not {d.matches('text', VISIBLE)} as empty_text"
    return f"""select doc_id, lang, source, text, cast({d.size('w')} as bigint) as n_words, {blank}, {', '.join(f'{e} as {r}' for r, e in rules.items())},
  {d.count('text', '#')} + {d.count('text', '…|[.][.][.]')} >= 0.1 * {d.size('w')} and {d.size('w')} > 0 as symbol_ratio_whole
  from (select *, {prepared(d, 'text')} from documents) q"""


RULES = ("lorem_ipsum", "word_count_range", "mean_word_length", "symbol_ratio", "stop_words", "duplicate_lines", "non_printable")
#: Rules of English prose, which code and mathematics are let off.
SOFT = ("stop_words", "mean_word_length", "symbol_ratio")


def quality_rules(d):
    return f"select doc_id, n_words, empty_text, {', '.join(RULES)} from ({_rules(d)}) r"


def script_aware_rules(d):
    """The rules that hold for any script: none on English words, symbols counted in the whole text."""
    return f"select doc_id, empty_text, lorem_ipsum, word_count_range, symbol_ratio_whole as symbol_ratio, duplicate_lines, non_printable from ({_rules(d)}) r"


def _chats(d):
    """User and assistant text of each conversation."""
    of = lambda role: d.concat_ordered(f"case when role = '{role}' then text end", "chr(10) || chr(10)", "turn")
    return f"select conv_id, {of('user')} as user_text, {of('assistant')} as answer from conversations group by conv_id"


def chat_quality(d):
    """All rules of a conversation, the empty ones included, with the bypass of its domain."""
    rules = rule_columns(d, "b")
    empty = lambda x: f"not {d.matches(f'coalesce({x}, {chr(39) * 2})', VISIBLE)}"
    soft = lambda r: f"({r} and domain = 'prose')" if r in SOFT else r
    return f"""select conv_id, domain, empty_user, empty_answer, {', '.join(RULES)}, empty_user or empty_answer or {' or '.join(soft(r) for r in RULES)} as dropped, domain <> 'prose' and ({' or '.join(SOFT)}) as bypassed
from (select conv_id, {domain(d, 'b')} as domain, {empty('user_text')} as empty_user, {empty('answer')} as empty_answer, {', '.join(f'{e} as {r}' for r, e in rules.items())}
from (select *, {prepared(d, 'b')} from (select *, coalesce(user_text, '') || chr(10) || coalesce(answer, '') as b from ({_chats(d)}) c) e) f) g"""


def full_text(d):
    """Reasoning and content of a conversation joined by a blank line, and the key of its classifier input."""
    whole = "coalesce(user_text || chr(10) || chr(10), '') || coalesce(answer, '')"
    return f"select conv_id, {d.sha(whole)} as full_sha, {d.sha(f'substring(trim(coalesce(user_text, {chr(39) * 2})) || chr(10) || chr(10) || trim(coalesce(answer, {chr(39) * 2})), 1, 4000)')} as input_key from ({_chats(d)}) c"


def rule_fail_histogram(d):
    parts = " union all ".join(f"select '{r}' as rule_name, cast(sum(case when {r} then 1 else 0 end) as bigint) as fails from r" for r in RULES)
    return f"with r as ({_rules(d)}) {parts}"


def language_aware_quality(d):
    return f"select lang, count(*) as docs, cast(sum(case when stop_words then 1 else 0 end) as bigint) as would_drop, round(100 * sum(case when stop_words then 1 else 0 end) / cast(count(*) as double), 4) as would_drop_pct from ({_rules(d)}) r group by lang"


def stage_ledger(d):
    """Documents and words in and out of the quality and the exact-dedup stage; copies meet as digests only."""
    bad = " or ".join(r for r in RULES if r != "stop_words")
    return f"""with r as (select {d.sha('text')} as h, n_words, ({bad}) as bad from ({_rules(d)}) q),
k as (select h, count(*) as n, sum(n_words) as words, min(n_words) as one from r where not bad group by h)
select 1 as stage, 'quality' as stage_name, count(*) as docs_in, cast(sum(case when bad then 0 else 1 end) as bigint) as docs_out, cast(sum(n_words) as bigint) as tokens_in, cast(sum(case when bad then 0 else n_words end) as bigint) as tokens_out from r
union all
select 2, 'exact_dedup', cast(sum(n) as bigint), count(*), cast(sum(words) as bigint), cast(sum(one) as bigint) from k"""


def domain_histogram(d):
    return f"select {domain(d, 'text')} as domain, count(*) as docs from documents group by 1"


def score_histogram(d):
    return "select floor(2 * (n_chars / cast(1000 as double))) / 2 as bin, count(*) as docs from documents group by 1"


def fertility_by_lang(d):
    octets = "octet_length(text)" if d.name == "spark" else "strlen(text)"
    return f"select lang, cast(sum({octets}) as bigint) as byte_tokens, round(sum({octets}) / cast(sum({d.size(words(d, 'text'))}) as double), 6) as tokens_per_word, round(sum(length(text)) / cast(sum({octets}) as double), 6) as chars_per_token from documents group by lang"


def fertility_spread(d):
    return f"with f as ({fertility_by_lang(d)}) select round(max(tokens_per_word) - min(tokens_per_word), 6) as spread, round(exp(greatest(0, max(tokens_per_word) / 1.2 - 1)), 6) as penalty from f"


def html_to_text(d):
    t = d.replace("html", "(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    t = d.replace(t, "(?s)<[^>]+>", "")
    return f"select page_id, {d.sha(d.replace(t, '[ ' + chr(92) + 't' + chr(92) + 'n' + chr(92) + 'r]+', ' '))} as text_sha from pages"


def lang_labels(d):
    return "select coalesce(case lang when 'en' then 'eng' when 'de' then 'deu' when 'fr' then 'fra' when 'es' then 'spa' else lang end, 'und') as lang3, count(*) as docs from documents group by 1"


def pii_counts(d):
    return f"""select doc_id, cast({d.count('text', '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]+')} as bigint) as emails, cast({d.count('text', '[0-9]{3}-[0-9]{2}-[0-9]{4}')} as bigint) as ssns,
  cast({d.count('text', 'AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}')} as bigint) as secrets from documents"""


QUERIES = {f.__name__: f for f in (normalize_text, fidelity_text, script_aware_rules, chat_quality, full_text, text_stats, ascii_fraction, bench_norm, naive_shingler, snippet, prose_sample, classifier_input, quality_rules, rule_fail_histogram, language_aware_quality, stage_ledger, domain_histogram, score_histogram, fertility_by_lang, fertility_spread, html_to_text, lang_labels, pii_counts)}
