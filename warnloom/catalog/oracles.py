"""DuckDB SQL for the registered queries, written from the operators' meaning: plain patterns, list
functions and windows, independent of how the Spark side computes the same."""

from __future__ import annotations

from ..functions.lexicons import (
    ACTIONS,
    CRITICAL_ACTION,
    DOMAIN_TLDS,
    ENTITY_NOISE_TLDS,
    IOC_LABELS,
    MALWARE_NAMES,
    PRODUCT_NAMES,
    SEVERITY_KEYWORDS,
    STOP_WORDS,
    TECHNIQUES,
    THREAT_KEYWORDS,
    UNKNOWN_THREAT,
    all_keywords,
)
from .corpus import ENDINGS
from .queries import SIMILARITY_QUERY


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def arr(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]"


# White space, date shapes, plain indicator patterns and entity noise.
SPACE_CODES = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
               0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACES = " || ".join(f"chr({c})" for c in SPACE_CODES)
WS = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
DATE = (
    rf"(?i)\b(?:\d{{1,2}}[{WS}]+{MONTH}[{WS}]+\d{{4}}|{MONTH}[{WS}]+\d{{1,2}},?[{WS}]+\d{{4}}"
    r"|\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4})\b"
)
YEARLESS = rf"(?i)\b{MONTH}[{WS}]+\d{{1,2}}\b"
PATTERNS = {
    "cves": r"(?i)\bCVE-\d{4}-\d{4,7}\b",
    "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "urls": rf"""(?i)\bhttps?://[^{WS})"'<>]+""",
    "emails": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "md5": r"\b[a-fA-F0-9]{32}\b",
    "sha1": r"\b[a-fA-F0-9]{40}\b",
    "sha256": r"\b[a-fA-F0-9]{64}\b",
    "domains": rf"(?i)\b(?:[a-zA-Z0-9-]+\.)+(?:{'|'.join(DOMAIN_TLDS)})\b",
}
NOISE = (
    r"(?i)^(?:CVE-\d{4}-\d|(?:\d{1,3}\.){3}\d{1,3}|[a-z0-9-]+\.(?:"
    + "|".join(ENTITY_NOISE_TLDS)
    + "))$"
)


def names_regex(names) -> str:
    return r"(?i)\b(?:" + "|".join(sorted(names, key=lambda n: (-len(n), n))) + r")\b"


def trim(x: str) -> str:
    return f"trim({x}, {SPACES})"


def clean(x: str) -> str:
    x = f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    x = f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return trim(x)


def refang(x: str) -> str:
    for dot in ("[.]", "(.)", "{.}"):
        x = f"replace({x}, {q(dot)}, '.')"
    return (
        f"regexp_replace(regexp_replace({x}, '\\bhxxps\\b', 'https', 'gi'), '\\bhxxp\\b', 'http', 'gi')"
    )


def dedupe(v: str) -> str:
    return (
        f"list_filter({v}, lambda x, i: list_position(list_transform({v}, lambda y: lower(y)), lower(x)) = i)"
    )


def hits(words, low: str = "low") -> str:
    return f"list_filter({arr(words)}, lambda k: contains({low}, k))"


def count(x: str) -> str:
    return f"CAST(len({x}) AS BIGINT)"


def unnested(v: str, value: str = "value") -> str:
    """Positions and elements of a list, as two select items."""
    return f"CAST(unnest(range(len({v}))) AS BIGINT) AS pos, unnest({v}) AS {value}"


_case = " ".join(f"WHEN {i} THEN {q(e)}" for i, e in enumerate(ENDINGS))
CORPUS = (
    "corpus AS (SELECT doc_id AS report_id, 'report-' || doc_id || '.txt' AS filename, "
    f"text || chr(10) || CASE doc_id % {len(ENDINGS)} {_case} END AS text FROM documents)"
)
NORM = f"norm AS MATERIALIZED (SELECT report_id, filename, {refang(clean('text'))} AS text FROM corpus)"
LOW = "lowered AS MATERIALIZED (SELECT *, lower(text) AS low FROM norm)"


def ioc_ctes(source: str) -> list[str]:
    found = ", ".join(f"regexp_extract_all(text, {q(p)}) AS {x}_all" for x, p in PATTERNS.items())
    lists = ", ".join(
        f"{dedupe(x + '_all')} AS {'urls_whole' if x == 'urls' else 'domains_any' if x == 'domains' else x}"
        for x in IOC_LABELS
    )
    tail = r"""[.,;:!?)\\\]"']+$"""
    return [
        f"found AS (SELECT *, {found} FROM {source})",
        f"first_seen AS (SELECT *, {lists} FROM found)",
        f"trimmed AS (SELECT *, list_transform(urls_whole, lambda u: regexp_replace(u, {q(tail)}, '')) AS urls FROM first_seen)",
        "iocs AS MATERIALIZED (SELECT *, list_filter(domains_any, lambda d: NOT contains("
        "lower(array_to_string(list_concat(urls, emails), ' ')), lower(d))) AS domains FROM trimmed)",
    ]


def with_ctes(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


TEXT = [CORPUS, NORM, LOW]
IOC = [*TEXT, *ioc_ctes("lowered")]
N_ALL = " + ".join(f"len({x})" for x in IOC_LABELS)
N_SIGNAL = " + ".join(f"len({x})" for x in IOC_LABELS if x != "domains")

# Word boundaries in DuckDB are ASCII only; a letter outside ASCII becomes an ASCII one first.
ASCII_TEXT = "regexp_replace(text, '[À-ɏ]', 'z', 'g')"
NAMES_FOUND = f"regexp_extract_all({ASCII_TEXT}, {q(names_regex([*MALWARE_NAMES, *PRODUCT_NAMES]))})"


def named(names) -> str:
    return dedupe(f"list_filter(names, lambda n: list_contains({arr(names)}, lower(n)))")


ENTITIES = [
    f"names AS (SELECT *, {NAMES_FOUND} AS names FROM {{source}})",
    f"entities AS (SELECT *, {named(MALWARE_NAMES)} AS malware, {named(PRODUCT_NAMES)} AS products FROM names)",
]


def entity_ctes(source: str) -> list[str]:
    return [ENTITIES[0].replace("{source}", source), ENTITIES[1]]


_scores = ", ".join(f"{count(hits(words))} AS score_{i}" for i, words in enumerate(THREAT_KEYWORDS.values()))
_best = "greatest(" + ", ".join(f"score_{i}" for i in range(len(THREAT_KEYWORDS))) + ")"
_type = (
    f"CASE WHEN {_best} = 0 THEN {q(UNKNOWN_THREAT)} "
    + " ".join(f"WHEN score_{i} = {_best} THEN {q(x)}" for i, x in enumerate(THREAT_KEYWORDS))
    + " END"
)
_tiers = ", ".join(f"{hits(words)} AS tier_{level.lower()}" for level, words in SEVERITY_KEYWORDS.items())
_tier_level = "CASE WHEN len(tier_critical) > 0 THEN 3 WHEN len(tier_high) > 0 THEN 2 WHEN len(tier_medium) > 0 THEN 1 ELSE 0 END"
_tier_words = (
    "CASE WHEN len(tier_critical) > 0 THEN tier_critical WHEN len(tier_high) > 0 THEN tier_high ELSE tier_medium END"
)
_reason = "CASE WHEN tier > 0 THEN 'keywords: ' || array_to_string(tier_words[1:4], ', ') END"


def type_ctes(source: str) -> list[str]:
    return [
        f"scored AS (SELECT *, {_scores} FROM {source})",
        f"typed AS (SELECT *, {_type} AS threat_type FROM scored)",
    ]


def tier_ctes(source: str) -> list[str]:
    return [
        f"tiers AS (SELECT *, {_tiers} FROM {source})",
        f"tiered AS (SELECT *, {_tier_level} AS tier, {_tier_words} AS tier_words FROM tiers)",
    ]


LEVEL_NAME = "['Low', 'Medium', 'High', 'Critical']"


def severity_ctes(source: str) -> list[str]:
    return [
        *tier_ctes(source),
        f"signals AS (SELECT *, len(cves) AS n_cves, {N_SIGNAL} AS n_iocs FROM tiered)",
        "severe AS (SELECT *, "
        f"{LEVEL_NAME}[1 + greatest(tier, CASE WHEN n_cves > 0 OR n_iocs >= 5 THEN 2 ELSE 0 END)] AS severity, "
        f"list_filter([{_reason}, CASE WHEN n_cves > 0 THEN n_cves || ' CVE(s) referenced' END, "
        "CASE WHEN n_iocs >= 5 THEN n_iocs || ' indicators of compromise found' END], "
        "lambda r: r IS NOT NULL) AS some_reasons FROM signals)",
        "rated AS MATERIALIZED (SELECT *, CASE WHEN len(some_reasons) > 0 THEN some_reasons "
        "ELSE ['no high-impact keywords or indicators found'] END AS severity_reasons FROM severe)",
    ]


_actions = (
    "CASE threat_type "
    + " ".join(f"WHEN {q(x)} THEN {arr(a)}" for x, a in ACTIONS.items())
    + f" ELSE {arr(ACTIONS[UNKNOWN_THREAT])} END"
)
ACTED = (
    f"acted AS (SELECT *, CASE WHEN severity = 'Critical' THEN list_concat([{q(CRITICAL_ACTION)}], "
    f"{_actions}) ELSE {_actions} END AS actions FROM rated)"
)
RATED = [*IOC, *type_ctes("iocs"), *severity_ctes("typed")]

_technique_rows = " UNION ALL ".join(
    f"SELECT report_id, {i} AS ord, {q(tid)} AS technique_id, {q(name)} AS name, {q(tactic)} AS tactic, "
    f"{hits(words)} AS matched FROM lowered"
    for i, (tid, name, tactic, words) in enumerate(TECHNIQUES)
)
TECHNIQUE_HITS = [
    f"technique_rows AS ({_technique_rows})",
    "technique_hits AS (SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY len(matched) DESC, ord) - 1 AS pos, "
    "technique_id, name, tactic, matched, len(matched) AS hits FROM technique_rows WHERE len(matched) > 0)",
]

# Sentences: a break after . ! ? and closing marks before white space.
_breaks = rf"""([.!?]+["')\]]*)[{WS}]+"""


def sentence_ctes(source: str, more: str = "") -> list[str]:
    parts = f"string_split(regexp_replace(text, {q(_breaks)}, '\\1' || chr(30), 'g'), chr(30))"
    return [
        f"sentence_lists AS (SELECT report_id{more}, list_filter(list_transform({parts}, "
        f"lambda s: {trim('s')}), lambda s: s <> '') AS sentences FROM {source})",
        f"sentences AS MATERIALIZED (SELECT report_id{more}, CAST(unnest(range(len(sentences))) AS BIGINT) AS sent_idx, "
        f"len(sentences) AS total, unnest(sentences) AS sentence FROM sentence_lists)",
    ]


SCORED = [
    f"measured AS (SELECT *, {count(hits(all_keywords(), 'lower(sentence)'))} AS hits, "
    f"greatest(len(regexp_extract_all(sentence, {q(f'[^{WS}]+')})), 1) AS words FROM sentences)",
    "sentence_scores AS (SELECT *, hits::DOUBLE / words * 100 * CASE WHEN sent_idx < 3 THEN 1.5::DOUBLE "
    "WHEN sent_idx > total - 4 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS score FROM measured WHERE words BETWEEN 5 AND 60)",
    "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY score DESC, sent_idx DESC) AS r "
    "FROM sentence_scores) WHERE r <= 4)",
    "top_sentences AS (SELECT report_id, string_agg(sentence, ' ' ORDER BY sent_idx) AS picked FROM best GROUP BY report_id)",
    "summaries AS (SELECT l.report_id, CASE WHEN len(l.sentences) <= 4 THEN array_to_string(l.sentences, ' ') "
    "ELSE coalesce(t.picked, '') END AS summary FROM sentence_lists l LEFT JOIN top_sentences t USING (report_id))",
]


def mention_ctes(yearless: bool = False) -> list[str]:
    dates = f"regexp_extract_all(sentence, {q(DATE)})"
    if yearless:
        dates = f"CASE WHEN len({dates}) > 0 THEN {dates} ELSE regexp_extract_all(sentence, {q(YEARLESS)}) END"
    return [
        f"date_lists AS (SELECT report_id, sent_idx, sentence, {dates} AS dates FROM sentences)",
        "date_rows AS (SELECT report_id, sent_idx, sentence, unnest(range(len(dates))) AS nth_date, unnest(dates) AS date FROM date_lists)",
        "first_dates AS (SELECT report_id, sent_idx, sentence, date, min(nth_date) AS nth_date FROM date_rows GROUP BY report_id, sent_idx, sentence, date)",
        "mentions AS (SELECT report_id, sent_idx, row_number() OVER (PARTITION BY report_id, sent_idx ORDER BY nth_date) - 1 AS pos, "
        "date, sentence, CASE WHEN length(sentence) > 220 THEN sentence[1:217] || '...' ELSE sentence END AS event FROM first_dates)",
        "events AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report_id, lower(date), lower(sentence[1:60]) "
        "ORDER BY sent_idx, pos) AS nth FROM mentions) WHERE nth = 1)",
        "ordered AS (SELECT *, count(*) OVER (PARTITION BY report_id ORDER BY sent_idx RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before "
        "FROM events)",
        "timeline AS (SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY sent_idx, pos) - 1 AS pos, date, event "
        "FROM ordered WHERE before < 8)",
    ]


_again = " ".join(ENDINGS) + " " + " ".join(f"Again: {e}" for e in ENDINGS)
REPEATED = f"repeated AS (SELECT report_id, text || {q(' ' + _again)} AS text FROM norm)"
NO_YEARS = "no_years AS (SELECT report_id, regexp_replace(text, ',? 20\\d\\d', '', 'g') AS text FROM norm)"

# CVSS records as the derived JSON holds them: one dimension row pair for each readable document.
DIMENSION = (
    "records AS (SELECT doc_id, (doc_id * 7) % 101 AS tenths, doc_id % 11 = 0 AS missing FROM documents WHERE doc_id % 17 <> 0), "
    "dimension AS (SELECT 'CVE-' || p.prefix || (doc_id + p.base) AS cve_id, "
    "CASE WHEN NOT missing THEN tenths / 10.0::DOUBLE END AS score, "
    "CASE WHEN NOT missing THEN CASE WHEN tenths >= 90 THEN 'CRITICAL' WHEN tenths >= 70 THEN 'HIGH' ELSE 'MEDIUM' END END AS severity, "
    "CASE WHEN NOT missing THEN 'V' || doc_id END AS vector, CASE WHEN NOT missing THEN 'v31' END AS version "
    "FROM records, (VALUES ('2023-', 28200), ('2024-', 21400)) p(prefix, base))"
)
CVE_ROWS = [
    DIMENSION,
    f"cve_rows AS (SELECT report_id, {unnested('cves', 'id')} FROM iocs)",
    "cve_scores AS (SELECT r.report_id, r.pos, r.id, d.score, d.severity, d.vector, d.version "
    "FROM cve_rows r LEFT JOIN dimension d ON d.cve_id = upper(r.id))",
]
_band = (
    "CASE WHEN score IS NULL THEN 'n/a' WHEN score >= 9 THEN 'critical' WHEN score >= 7 THEN 'high' "
    "WHEN score >= 4 THEN 'medium' ELSE 'low' END AS band"
)

# Similar incidents.
_word = r"[\p{L}\p{N}_]{2,}"


def term_ctes(source: str, prefix: str = "") -> list[str]:
    words = (
        f"list_filter(regexp_extract_all(lower(text), {q(_word)}), "
        f"lambda w: NOT list_contains({arr(STOP_WORDS)}, w))"
    )
    p = prefix
    return [
        f"{p}words AS (SELECT report_id, {words} AS w FROM {source})",
        f"{p}all_terms AS (SELECT report_id, unnest(list_concat(w, list_transform(range(1, len(w)), "
        f"lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM {p}words)",
        f"{p}term_counts AS (SELECT report_id, term, count(*) AS tf FROM {p}all_terms GROUP BY report_id, term)",
    ]


CANDIDATES = [
    *RATED,
    f"candidates AS (SELECT report_id, filename, threat_type, severity, {trim('text')} AS text FROM rated "
    f"WHERE length({trim('text')}) > 100)",
]
TERMS = [*CANDIDATES, *term_ctes("candidates")]


def vocabulary_cte(counts: str) -> str:
    return (
        f"vocabulary AS (SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS n_docs FROM {counts} GROUP BY term "
        "ORDER BY total DESC, CASE WHEN contains(term, ' ') THEN 2 ELSE 1 END, term LIMIT 3000)"
    )


def weight_ctes(counts: str, n_docs: str, prefix: str = "") -> list[str]:
    p = prefix
    return [
        f"{p}raw_weights AS (SELECT c.report_id, c.term, c.tf * (ln((1 + {n_docs}) / (1.0::DOUBLE + v.n_docs)) + 1) AS w "
        f"FROM {counts} c JOIN vocabulary v USING (term))",
        f"{p}weights AS (SELECT report_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY report_id)) AS weight FROM {p}raw_weights)",
    ]


_query_row = f"query AS (SELECT CAST(-1 AS BIGINT) AS report_id, {q(SIMILARITY_QUERY)} AS text)"
_n_candidates = "(SELECT count(*) FROM candidates)"
WEIGHTS = [*TERMS, vocabulary_cte("term_counts"), *weight_ctes("term_counts", _n_candidates)]
COSINE = [*WEIGHTS, _query_row, *term_ctes("query", "q_"), *weight_ctes("q_term_counts", _n_candidates, "q_")]
SIMILAR = [
    *CANDIDATES,
    "others AS (SELECT * FROM candidates WHERE report_id <> 9)",
    _query_row,
    "both_texts AS (SELECT report_id, text FROM others UNION ALL SELECT report_id, text FROM query)",
    *term_ctes("both_texts"),
    vocabulary_cte("term_counts"),
    *weight_ctes("term_counts", "(SELECT count(*) FROM both_texts)"),
    "scores AS (SELECT a.report_id, sum(a.weight * b.weight) AS score FROM weights a JOIN weights b USING (term) "
    "WHERE b.report_id = -1 AND a.report_id <> -1 GROUP BY a.report_id)",
    "ranked AS (SELECT * FROM scores ORDER BY round(score, 10) DESC, report_id DESC LIMIT 20)",
]

# Every turn of a conversation as a query, with the model of the candidates and that turn alone.
BATCH = [
    *TERMS,
    "asked AS (SELECT DISTINCT conv_id || '-' || turn AS query_id, text FROM conversations)",
    "turns AS (SELECT row_number() OVER (ORDER BY query_id, text) AS report_id, query_id, text FROM asked)",
    *term_ctes("turns", "q_"),
    "totals AS (SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS n_docs FROM term_counts GROUP BY term)",
    vocabulary_cte("term_counts"),
    "pool AS (SELECT t.report_id AS turn, v.term FROM (SELECT DISTINCT report_id FROM q_term_counts) t CROSS JOIN vocabulary v "
    "UNION SELECT report_id, term FROM q_term_counts)",
    "numbers AS (SELECT p.turn, p.term, coalesce(h.total, 0) + coalesce(c.tf, 0) AS total, coalesce(c.tf, 0) AS tf, "
    f"ln((2.0::DOUBLE + {_n_candidates}) / (1 + coalesce(h.n_docs, 0) + CASE WHEN c.tf IS NULL THEN 0 ELSE 1 END)) + 1 AS idf "
    "FROM pool p LEFT JOIN totals h USING (term) LEFT JOIN q_term_counts c ON c.report_id = p.turn AND c.term = p.term)",
    "chosen AS (SELECT * FROM numbers QUALIFY row_number() OVER (PARTITION BY turn "
    "ORDER BY total DESC, CASE WHEN contains(term, ' ') THEN 2 ELSE 1 END, term) <= 3000)",
    "lengths AS (SELECT turn, sqrt(sum(tf * idf * tf * idf)) AS length FROM chosen GROUP BY turn)",
    "scores AS (SELECT turn, d.report_id, sum(d.tf * idf * c.tf * idf) / sqrt(sum(d.tf * idf * d.tf * idf)) AS product "
    "FROM chosen c JOIN term_counts d USING (term) GROUP BY turn, d.report_id HAVING sum(d.tf * c.tf) > 0)",
    "placed AS (SELECT turn, report_id, product / length AS score, row_number() OVER (PARTITION BY turn "
    "ORDER BY round(product / length, 10) DESC, report_id DESC) AS rank FROM scores JOIN lengths USING (turn))",
]

# The analysed corpus.
HISTORY = [
    *RATED,
    ACTED,
    *entity_ctes("acted"),
    *TECHNIQUE_HITS,
    *sentence_ctes("norm"),
    *SCORED,
    *mention_ctes(),
    *CVE_ROWS,
    "technique_text AS (SELECT report_id, string_agg(technique_id || ' ' || name || ' ' || tactic || ' ' || "
    "array_to_string(matched, ','), '|' ORDER BY pos) AS techniques, string_agg('- ' || technique_id || ' — ' || name || ' (' || tactic || ')', "
    "chr(10) ORDER BY pos) AS technique_lines, count(*) AS n_techniques FROM technique_hits GROUP BY report_id)",
    "timeline_text AS (SELECT report_id, string_agg(date || ' ' || event, '|' ORDER BY pos) AS timeline FROM timeline GROUP BY report_id)",
    "cve_text AS (SELECT report_id, string_agg(id || ' ' || coalesce(CAST(score AS VARCHAR), '-') || ' ' || coalesce(severity, '-'), '|' ORDER BY pos) AS cves_enriched, "
    "string_agg('- ' || id || CASE WHEN score IS NOT NULL THEN ' — CVSS ' || CAST(score AS VARCHAR) || ' (' || coalesce(severity, 'None') || ')' ELSE '' END, "
    "chr(10) ORDER BY pos) AS cve_lines FROM cve_scores GROUP BY report_id)",
    "history AS (SELECT e.*, s.summary, coalesce(t.techniques, '') AS techniques, t.technique_lines, coalesce(t.n_techniques, 0) AS n_techniques, "
    "coalesce(l.timeline, '') AS timeline, coalesce(c.cves_enriched, '') AS cves_enriched, c.cve_lines, "
    r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS word_count, "
    "to_timestamp(1767225600 + report_id * 60) AT TIME ZONE 'UTC' AS created_at "
    "FROM entities e JOIN summaries s USING (report_id) LEFT JOIN technique_text t USING (report_id) "
    "LEFT JOIN timeline_text l USING (report_id) LEFT JOIN cve_text c USING (report_id))",
]
_flat = ", ".join(
    [
        "report_id", "filename", "CAST(word_count AS BIGINT) AS word_count", "threat_type",
        "concat_ws(',', " + ", ".join(f"score_{i}" for i in range(len(THREAT_KEYWORDS))) + ") AS threat_type_scores",
        "severity", "array_to_string(severity_reasons, '|') AS severity_reasons", "summary",
        *[f"array_to_string({x}, '|') AS ioc_{x}" for x in IOC_LABELS],
        "array_to_string(malware, '|') AS malware", "array_to_string(products, '|') AS products",
        "'' AS organizations", "'' AS locations", "cves_enriched", "techniques", "timeline",
        "array_to_string(actions, '|') AS recommended_actions", "text[1:6000] AS text_excerpt",
    ]
)
_ioc_lines = " || ".join(
    f"CASE WHEN len({x}) > 0 THEN chr(10) || '### {x}' || chr(10) || "
    f"array_to_string(list_transform({x}, lambda v: '- `' || v || '`'), chr(10)) ELSE '' END"
    for x in IOC_LABELS
)
_markdown = (
    "'# THREAT REPORT — ' || filename || chr(10) || chr(10) || '**Threat Type:** ' || threat_type || chr(10) || "
    "'**Severity:** ' || severity || chr(10) || chr(10) || '## Summary' || chr(10) || summary || chr(10) || chr(10) || "
    "'## Vulnerabilities' || chr(10) || coalesce(cve_lines, '- None found') || chr(10) || chr(10) || "
    "'## Affected Products' || chr(10) || CASE WHEN len(products) > 0 THEN "
    "array_to_string(list_transform(products, lambda p: '- ' || p), chr(10)) ELSE '- None identified' END || chr(10) || chr(10) || "
    "'## Attack Techniques (MITRE ATT&CK)' || chr(10) || coalesce(technique_lines, '- None mapped') || chr(10) || chr(10) || "
    f"'## Indicators of Compromise' || {_ioc_lines} || chr(10) || chr(10) || '## Recommended Actions' || chr(10) || "
    "array_to_string(list_transform(actions, lambda a, i: i || '. ' || a), chr(10))"
)


def label_sql(label: str) -> str:
    return with_ctes(
        [*TEXT, f"found AS (SELECT report_id, regexp_extract_all(text, {q(PATTERNS[label])}) AS v FROM lowered)"],
        f"SELECT report_id, {unnested('v')} FROM found",
    )


def ioc_rows(labels=IOC_LABELS, source: str = "iocs") -> str:
    return " UNION ALL ".join(
        f"SELECT report_id, {q(x)} AS ioc_type, {unnested(x)} FROM {source}" for x in labels
    )


def text_iocs_sql(table: str, key: str, column: str) -> str:
    return with_ctes(
        [
            f"corpus AS (SELECT {key} AS report_id, '' AS filename, {column} AS text FROM {table})",
            NORM,
            *ioc_ctes("norm"),
        ],
        ioc_rows(),
    )


_keyword_rows = " UNION ALL ".join(
    f"SELECT report_id, {q(rule)} AS rule, {q(label)} AS label, {hits(words)} AS words FROM lowered"
    for rule, label, words in [
        *(("threat", x, w) for x, w in THREAT_KEYWORDS.items()),
        *(("severity", x, w) for x, w in SEVERITY_KEYWORDS.items()),
        *(("technique", t, w) for t, _, _, w in TECHNIQUES),
    ]
)
_score_rows = " UNION ALL ".join(
    f"SELECT report_id, {q(x)} AS label, CAST({i} AS BIGINT) AS ord, {count(hits(w))} AS score FROM lowered"
    for i, (x, w) in enumerate(THREAT_KEYWORDS.items())
)

# Gazetteer: every run of up to five tokens compared with the names; a fold over the matches of a
# report, longest first and then leftmost, keeps those that overlap none kept before.
_gaz_words = "string_split(lower(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' ')"
_token = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]"
_leads = ", ".join(f"lead(t0, {i}) OVER by_position AS t{i}" for i in range(1, 5))
_runs = " UNION ALL ".join(
    f"SELECT report_id, start, {n} AS n, {' || '.join(f't{i}' for i in range(n))} AS name FROM neighbours "
    rf"WHERE t{n - 1} IS NOT NULL AND regexp_matches(t0, '\S')"
    for n in range(1, 6)
)
GAZETTEER = [
    CORPUS,
    NORM,
    f"benchmark_words AS (SELECT {_gaz_words} AS w FROM benchmark)",
    "gaz AS (SELECT array_to_string(w[1:2], ' ') AS name, 'organizations' AS bucket FROM benchmark_words "
    "UNION SELECT array_to_string(w[2:4], ' '), 'locations' FROM benchmark_words)",
    f"tokens AS (SELECT report_id, regexp_extract_all(text, {q(_token)}) AS t FROM norm)",
    "token_rows AS (SELECT report_id, unnest(range(len(t))) AS start, unnest(t) AS t0 FROM tokens)",
    f"neighbours AS MATERIALIZED (SELECT *, {_leads} FROM token_rows WINDOW by_position AS (PARTITION BY report_id ORDER BY start))",
    f"runs AS ({_runs})",
    "spans AS (SELECT r.report_id, r.start, r.n, r.name, g.bucket FROM runs r JOIN gaz g ON lower(r.name) = g.name)",
    "span_lists AS (SELECT report_id, list({'start': start, 'n': n, 'name': name, 'bucket': bucket} ORDER BY n DESC, start, name, bucket) AS spans "
    "FROM spans GROUP BY report_id)",
    "kept AS (SELECT report_id, list_reduce(spans[2:], lambda acc, s: CASE WHEN len(list_filter(acc, lambda k: "
    "k.start < s.start + s.n AND s.start < k.start + k.n)) > 0 THEN acc ELSE list_append(acc, s) END, spans[1:1]) AS spans FROM span_lists)",
    "kept_rows AS (SELECT report_id, unnest(spans, recursive := true) FROM kept)",
    f"first_names AS (SELECT report_id, bucket, lower(name) AS key, min(start) AS start, arg_min(name, start) AS name FROM kept_rows "
    f"WHERE NOT regexp_matches(name, {q(NOISE)}) GROUP BY report_id, bucket, lower(name))",
]

# Rule names are taken out of the text before gazetteer names are looked for.
MASKED = [
    f"masked AS (SELECT report_id, regexp_replace(text, {q(names_regex([*MALWARE_NAMES, *PRODUCT_NAMES]))}, chr(1), 'g') AS text FROM norm)",
    *[cte.replace("FROM norm)", "FROM masked)") for cte in GAZETTEER[2:]],
    "name_lists AS (SELECT report_id, bucket, string_agg(name, '|' ORDER BY start) AS names FROM first_names GROUP BY report_id, bucket)",
]
_places = (
    "coalesce((SELECT names FROM name_lists n WHERE n.report_id = {0}.report_id AND bucket = 'organizations'), '') AS organizations, "
    "coalesce((SELECT names FROM name_lists n WHERE n.report_id = {0}.report_id AND bucket = 'locations'), '') AS locations"
)

# A lexicon of the longer words of the benchmark's texts.
LEXICON = [
    f"lexicon_words AS (SELECT item_id, unnest(range(len(w))) AS pos, unnest(w) AS keyword FROM (SELECT item_id, {_gaz_words} AS w FROM benchmark))",
    "lexicon AS (SELECT 'group-' || (item_id % 6) AS label, item_id % 6 AS ord, keyword, min(item_id * 1000 + pos) AS kw_ord FROM lexicon_words "
    "WHERE length(keyword) >= 4 GROUP BY ALL)",
    "labels_of AS (SELECT DISTINCT label, ord FROM lexicon)",
]
LEXICON_HITS = [
    *TEXT,
    *LEXICON,
    "lexicon_found AS (SELECT report_id, label, ord, keyword, kw_ord FROM lowered JOIN lexicon ON contains(low, keyword))",
    "by_label AS (SELECT report_id, label, ord, count(*) AS hits, list(keyword ORDER BY kw_ord, keyword) AS words FROM lexicon_found GROUP BY ALL)",
]

_nvd = (
    "SELECT 'CVE-2025-' || (doc_id + 10000) AS cve_id, "
    "CAST(CASE doc_id % 7 WHEN 0 THEN 9.8 WHEN 1 THEN 7.5 WHEN 2 THEN 8.1 WHEN 3 THEN 4.3 WHEN 5 THEN 6.1 END AS DOUBLE) AS score, "
    "CASE doc_id % 7 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'HIGH' WHEN 5 THEN 'MEDIUM' END AS severity, "
    "CASE WHEN doc_id % 7 IN (0, 1, 2, 3, 5) THEN 'N' || doc_id END AS vector, "
    "CASE doc_id % 7 WHEN 0 THEN 'v31' WHEN 1 THEN 'v30' WHEN 2 THEN 'v40' WHEN 3 THEN 'v2' WHEN 5 THEN 'v31' END AS version FROM documents"
)
_ids = "(SELECT doc_id FROM labels WHERE toxic = 1)"
_LISTS = [*TEXT, *ioc_ctes("lowered")]

ORACLES: dict[str, str] = {
    "read_text_reports": "SELECT doc_id AS report_id, 'report-' || doc_id || '.txt' AS filename, text FROM documents",
    "split_supported": (
        "SELECT doc_id AS report_id, 'r' || doc_id || CASE lang WHEN 'fr' THEN '.TXT' WHEN 'de' THEN '.pdf' "
        "WHEN 'es' THEN '.docx' ELSE '.txt' END AS filename, CASE lang WHEN 'de' THEN 'pdf text must be extracted first' "
        "WHEN 'es' THEN 'unsupported file type' ELSE '' END AS reason FROM documents"
    ),
    "filter_min_length": (
        f"SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS n_chars FROM conversations WHERE length({trim('text')}) >= 50"
    ),
    "load_cvss_dimension": with_ctes([DIMENSION], "SELECT * FROM dimension"),
    "parse_nvd_metrics": _nvd,
    "save_reports": with_ctes(HISTORY, "SELECT report_id, filename, threat_type, severity, summary FROM history"),
    "list_reports": with_ctes(
        HISTORY,
        "SELECT report_id, filename, threat_type, severity, created_at FROM history ORDER BY report_id DESC LIMIT 50",
    ),
    "get_reports_by_id": with_ctes(
        HISTORY,
        f"SELECT report_id, filename, threat_type, severity, summary, created_at FROM history WHERE report_id IN {_ids}",
    ),
    "delete_reports": with_ctes(
        HISTORY,
        f"SELECT report_id, filename, threat_type, severity, created_at FROM history WHERE report_id NOT IN {_ids}",
    ),
    "result_to_json": with_ctes(
        HISTORY,
        "SELECT report_id, filename, CAST(word_count AS VARCHAR) AS words, threat_type, summary, severity_reasons[1] AS first_reason, "
        "actions[1] AS first_action, CAST(score_0 AS VARCHAR) AS ransomware_score FROM history",
    ),
    "result_from_json": with_ctes(HISTORY, f"SELECT {_flat} FROM history"),
    "render_markdown": with_ctes(HISTORY, f"SELECT report_id, filename, {_markdown} AS markdown FROM history"),
    "clean_text": with_ctes([CORPUS], f"SELECT report_id, {clean('text')} AS text FROM corpus"),
    "refang": with_ctes([CORPUS], f"SELECT report_id, {refang('text')} AS text FROM corpus"),
    "split_sentences": with_ctes(
        [CORPUS, NORM, *sentence_ctes("norm")], "SELECT report_id, sent_idx, sentence FROM sentences"
    ),
    "word_count": with_ctes(
        [CORPUS, NORM],
        r"SELECT report_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS BIGINT) AS word_count FROM norm",
    ),
    "text_excerpt": with_ctes([CORPUS, NORM], "SELECT report_id, text[1:6000] AS text_excerpt FROM norm"),
    **{f"extract_{label}": label_sql(label) for label in IOC_LABELS},
    "dedupe_ci": with_ctes(
        _LISTS,
        "SELECT report_id, array_to_string(cves, '|') AS cves, array_to_string(urls_whole, '|') AS urls FROM iocs",
    ),
    "trim_url_tail": with_ctes(
        [*TEXT, f"found AS (SELECT report_id, regexp_extract_all(text, {q(PATTERNS['urls'])}) AS v FROM lowered)",
         f"""tails AS (SELECT report_id, list_transform(v, lambda u: regexp_replace(u, {q(r'''[.,;:!?)\\\]"']+$''')}, '')) AS v FROM found)"""],
        f"SELECT report_id, {unnested('v', 'url')} FROM tails",
    ),
    "drop_embedded_domains": with_ctes(
        [*_LISTS,
         "kept AS (SELECT report_id, list_filter(domains_all, lambda d: NOT contains(lower(array_to_string(list_concat("
         "list_transform(urls_all, lambda u: regexp_replace(u, " + q(r"""[.,;:!?)\\\]"']+$""") + ", '')), emails_all), ' ')), lower(d))) AS v FROM iocs)"],
        f"SELECT report_id, {unnested('v', 'domain')} FROM kept",
    ),
    "extract_iocs": with_ctes(
        IOC, "SELECT report_id, " + ", ".join(f"array_to_string({x}, '|') AS {x}" for x in IOC_LABELS) + " FROM iocs"
    ),
    "iocs_long": with_ctes(IOC, ioc_rows()),
    "iocs_long_pages": text_iocs_sql("pages", "page_id", "html"),
    "indicator_counts": with_ctes(
        [*IOC, f"long_rows AS ({ioc_rows()})"],
        "SELECT ioc_type, count(DISTINCT report_id) AS n_reports, count(*) AS n_indicators FROM long_rows GROUP BY ioc_type",
    ),
    "ioc_counts_by_label": with_ctes(
        IOC,
        " UNION ALL ".join(f"SELECT report_id, {q(x)} AS ioc_type, {count(x)} AS n FROM iocs" for x in IOC_LABELS[1:]),
    ),
    "ioc_total": with_ctes(IOC, f"SELECT report_id, CAST({N_ALL} AS BIGINT) AS ioc_total FROM iocs"),
    "extract_malware": with_ctes(
        [*TEXT, *entity_ctes("lowered")], f"SELECT report_id, {unnested('malware', 'name')} FROM entities"
    ),
    "extract_products": with_ctes(
        [*TEXT, *entity_ctes("lowered")], f"SELECT report_id, {unnested('products', 'name')} FROM entities"
    ),
    "name_mentions": with_ctes(
        [*TEXT, *entity_ctes("lowered"), f"rows AS (SELECT report_id, {unnested('names', 'name')} FROM entities)"],
        f"SELECT *, CASE WHEN list_contains({arr(MALWARE_NAMES)}, lower(name)) THEN 'malware' ELSE 'products' END AS bucket FROM rows",
    ),
    "gazetteer_spans": with_ctes(
        GAZETTEER, "SELECT report_id, start, CAST(n AS BIGINT) AS length, name, bucket FROM spans"
    ),
    "extract_gazetteer": with_ctes(
        GAZETTEER,
        "SELECT report_id, bucket, row_number() OVER (PARTITION BY report_id, bucket ORDER BY start) - 1 AS pos, name FROM first_names",
    ),
    "drop_ioc_noise": with_ctes(
        [*IOC, f"long_rows AS ({ioc_rows()})"],
        f"SELECT * FROM long_rows WHERE NOT regexp_matches(value, {q(NOISE)})",
    ),
    "extract_entities": with_ctes(
        [*TEXT, *entity_ctes("lowered")],
        "SELECT report_id, array_to_string(malware, '|') AS malware, array_to_string(products, '|') AS products, "
        "'' AS organizations, '' AS locations FROM entities",
    ),
    "extract_entities_gazetteer": with_ctes(
        [*TEXT, *entity_ctes("lowered"), *MASKED],
        f"SELECT report_id, array_to_string(malware, '|') AS malware, array_to_string(products, '|') AS products, {_places.format('entities')} FROM entities",
    ),
    "lexicon_scores": with_ctes(
        LEXICON_HITS,
        "SELECT n.report_id, l.label, l.ord, coalesce(b.hits, 0) AS score FROM norm n CROSS JOIN labels_of l LEFT JOIN by_label b USING (report_id, label)",
    ),
    "classify_by_lexicon": with_ctes(
        LEXICON_HITS,
        f"SELECT n.report_id, coalesce(any_value(b.best), {q(UNKNOWN_THREAT)}) AS threat_type FROM norm n LEFT JOIN (SELECT report_id, "
        "arg_min(label, (-hits, ord)) AS best FROM by_label GROUP BY report_id) b USING (report_id) GROUP BY n.report_id",
    ),
    "lexicon_tier": with_ctes(
        LEXICON_HITS,
        "SELECT n.report_id, coalesce(b.label, 'none') AS label, 'keywords: ' || array_to_string(b.words[1:4], ', ') AS reason FROM norm n "
        "LEFT JOIN (SELECT * FROM by_label QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY ord) = 1) b USING (report_id)",
    ),
    "lexicon_ranking": with_ctes(
        LEXICON_HITS,
        "SELECT report_id, row_number() OVER (PARTITION BY report_id ORDER BY hits DESC, ord) - 1 AS pos, label, array_to_string(words, '|') AS matched_keywords, hits FROM by_label",
    ),
    "score_sentences_by": with_ctes(
        [CORPUS, NORM, *sentence_ctes("norm"), *LEXICON, "terms AS (SELECT DISTINCT keyword FROM lexicon)",
         "term_hits AS (SELECT report_id, sent_idx, count(*) AS hits FROM sentences JOIN terms ON contains(lower(sentence), keyword) GROUP BY ALL)",
         SCORED[0].replace(count(hits(all_keywords(), "lower(sentence)")), "coalesce((SELECT t.hits FROM term_hits t WHERE t.report_id = sentences.report_id "
                           "AND t.sent_idx = sentences.sent_idx), 0)"), SCORED[1]],
        "SELECT report_id, score, sent_idx, hits, CAST(words AS BIGINT) AS words, sentence FROM sentence_scores",
    ),
    "threat_type_scores": with_ctes(TEXT, _score_rows),
    "classify_threat_type": with_ctes([*TEXT, *type_ctes("lowered")], "SELECT report_id, threat_type FROM typed"),
    "matched_keywords": with_ctes(
        [*TEXT, f"keyword_rows AS ({_keyword_rows})"],
        f"SELECT report_id, rule, label, {unnested('words', 'keyword')} FROM keyword_rows",
    ),
    "severity_keyword_tier": with_ctes(
        [*TEXT, *tier_ctes("lowered")],
        f"SELECT report_id, {LEVEL_NAME}[1 + tier] AS severity, {_reason} AS reason FROM tiered",
    ),
    "severity_cve_signal": with_ctes(
        IOC,
        f"SELECT report_id, {count('cves')} AS n_cves, len(cves) || ' CVE(s) referenced' AS reason FROM iocs WHERE len(cves) > 0",
    ),
    "severity_ioc_signal": with_ctes(
        IOC,
        f"SELECT report_id, CAST({N_SIGNAL} AS BIGINT) AS n_iocs, ({N_SIGNAL}) || ' indicators of compromise found' AS reason "
        f"FROM iocs WHERE {N_SIGNAL} >= 5",
    ),
    "classify_severity": with_ctes(
        [*IOC, *severity_ctes("iocs")],
        "SELECT report_id, severity, array_to_string(severity_reasons, '|') AS severity_reasons FROM rated",
    ),
    "recommend_actions": with_ctes([*RATED, ACTED], f"SELECT report_id, {unnested('actions', 'action')} FROM acted"),
    "technique_hits": with_ctes(
        [*TEXT, *TECHNIQUE_HITS],
        "SELECT report_id, CAST(pos AS BIGINT) AS pos, technique_id, name, tactic, array_to_string(matched, '|') AS matched_keywords, "
        "CAST(hits AS BIGINT) AS hits FROM technique_hits",
    ),
    "map_techniques": with_ctes(
        [*TEXT, *TECHNIQUE_HITS],
        "SELECT report_id, coalesce(string_agg(technique_id || ':' || hits, '|' ORDER BY pos), '') AS techniques "
        "FROM norm LEFT JOIN technique_hits USING (report_id) GROUP BY report_id",
    ),
    "enrich_cves": with_ctes([*IOC, *CVE_ROWS], "SELECT * FROM cve_scores"),
    "enrich_cves_by_join": with_ctes([*IOC, *CVE_ROWS], "SELECT * FROM cve_scores"),
    "cvss_lookup": with_ctes(
        IOC,
        f"SELECT report_id, {unnested('cves', 'id')}, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS severity, 'n/a' AS band FROM iocs",
    ),
    "cvss_band": with_ctes([*IOC, *CVE_ROWS], f"SELECT report_id, pos, id, score, severity, {_band} FROM cve_scores"),
    "score_sentences": with_ctes(
        [CORPUS, NORM, *sentence_ctes("norm"), *SCORED],
        "SELECT report_id, score, sent_idx, hits, CAST(words AS BIGINT) AS words, sentence FROM sentence_scores",
    ),
    "summarize": with_ctes([CORPUS, NORM, *sentence_ctes("norm"), *SCORED], "SELECT report_id, summary FROM summaries"),
    "date_mentions": with_ctes(
        [CORPUS, NORM, *sentence_ctes("norm"), *mention_ctes()],
        "SELECT report_id, sent_idx, CAST(pos AS BIGINT) AS pos, date, event FROM mentions",
    ),
    "yearless_dates": with_ctes(
        [CORPUS, NORM, NO_YEARS, *sentence_ctes("no_years"), *mention_ctes(True)],
        "SELECT report_id, sent_idx, CAST(pos AS BIGINT) AS pos, date, event FROM mentions",
    ),
    "drop_bare_years": with_ctes(
        [CORPUS, NORM, "runs AS (SELECT report_id, regexp_extract_all(text, '[0-9]{4}(?:-[0-9]{2})*') AS v FROM norm)",
         f"candidates AS (SELECT report_id, {unnested('v', 'date')} FROM runs)"],
        "SELECT * FROM candidates WHERE length(date) <> 4",
    ),
    "dedupe_events": with_ctes(
        [CORPUS, NORM, REPEATED, *sentence_ctes("repeated"), *mention_ctes()],
        "SELECT report_id, sent_idx, CAST(pos AS BIGINT) AS pos, date, event FROM events",
    ),
    "truncate_event": with_ctes(
        [CORPUS, NORM, *sentence_ctes("norm")],
        "SELECT report_id, sent_idx, CASE WHEN length(sentence) > 220 THEN sentence[1:217] || '...' ELSE sentence END AS sentence FROM sentences",
    ),
    "extract_timeline": with_ctes(
        [CORPUS, NORM, REPEATED, *sentence_ctes("repeated"), *mention_ctes()],
        "SELECT report_id, CAST(pos AS BIGINT) AS pos, date, event FROM timeline",
    ),
    "similarity_candidates": with_ctes(
        CANDIDATES, "SELECT report_id, filename, threat_type, severity, md5(text) AS text FROM candidates"
    ),
    "tokenize_terms": with_ctes(TERMS, "SELECT report_id, term, tf FROM term_counts"),
    "top_vocabulary": with_ctes([*TERMS, vocabulary_cte("term_counts")], "SELECT term, total, n_docs FROM vocabulary"),
    "tfidf_weights": with_ctes(WEIGHTS, "SELECT report_id, term, round(weight, 6) AS weight FROM weights"),
    "cosine_to_query": with_ctes(
        COSINE,
        "SELECT a.report_id, round(sum(a.weight * b.weight), 6) AS score FROM weights a JOIN q_weights b USING (term) GROUP BY a.report_id",
    ),
    "find_similar_incidents": with_ctes(
        SIMILAR,
        "SELECT c.report_id, c.filename, c.threat_type, c.severity, round(r.score, 3) AS score FROM ranked r "
        "JOIN candidates c USING (report_id) WHERE r.score > 0.01",
    ),
    "find_similar_batch": with_ctes(
        BATCH,
        "SELECT t.query_id, CAST(p.rank AS BIGINT) AS rank, c.report_id, c.filename, c.threat_type, c.severity, round(p.score, 3) AS score "
        "FROM placed p JOIN turns t ON t.report_id = p.turn JOIN candidates c ON c.report_id = p.report_id WHERE p.rank <= 3 AND round(p.score, 10) > 0.01",
    ),
    "dashboard_scope": with_ctes(
        RATED, "SELECT report_id, filename, threat_type, severity FROM rated ORDER BY report_id DESC LIMIT 200"
    ),
    "severity_distribution": with_ctes(RATED, "SELECT severity, count(*) AS n_reports FROM rated GROUP BY severity"),
    "threat_type_distribution": with_ctes(
        RATED, "SELECT threat_type, count(*) AS n_reports FROM rated GROUP BY threat_type"
    ),
    "dashboard_kpis": with_ctes(
        [*RATED, *TECHNIQUE_HITS],
        f"SELECT count(*) AS reports, count(*) FILTER (WHERE severity = 'Critical') AS critical, "
        f"CAST(sum({N_ALL}) AS BIGINT) AS total_iocs, (SELECT count(DISTINCT technique_id) FROM technique_hits) AS techniques_seen FROM rated",
    ),
    "top_techniques": with_ctes(
        [*TEXT, *TECHNIQUE_HITS],
        "SELECT technique_id || ' ' || name AS technique, count(*) AS n_reports FROM technique_hits GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    ),
    "report_kpis": with_ctes(
        HISTORY,
        f"SELECT report_id, threat_type, severity, CAST({N_ALL} AS BIGINT) AS indicators, CAST(n_techniques AS BIGINT) AS techniques FROM history",
    ),
    "analyze_reports": with_ctes(HISTORY, f"SELECT {_flat} FROM history"),
    "analyze_with_gazetteer": with_ctes(
        [*HISTORY, *MASKED],
        "SELECT report_id, threat_type, severity, word_count, array_to_string(malware, '|') AS malware, array_to_string(products, '|') AS products, "
        f"{_places.format('history')} FROM history",
    ),
    "analyze_stream": with_ctes(
        [*HISTORY],
        "SELECT report_id, filename, word_count, threat_type, severity, summary, CAST(" + N_ALL + f" AS BIGINT) AS indicators FROM history h "
        f"WHERE (SELECT length({trim('c.text')}) FROM corpus c WHERE c.report_id = h.report_id) >= 50",
    ),
}
ORACLES |= {
    "parse_cvss_json": ORACLES["load_cvss_dimension"],
    "read_text_files": "SELECT 'txt' AS kind, text FROM documents",
    "write_version": ORACLES["delete_reports"],
    "rolled_kpis": ORACLES["dashboard_kpis"],
    "rolled_severity": ORACLES["severity_distribution"],
    "rolled_threat_types": ORACLES["threat_type_distribution"],
    "rolled_techniques": ORACLES["top_techniques"],
}
