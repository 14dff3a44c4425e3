"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import table
from .content_sort import content_sort
from .decontam_cgk import find_leaks
from .ffd_packing import pack
from .html_mincut import extract_text
from .license_diagonals import PASSAGES, PHRASES, scan_licenses
from .maxscore_search import rank_documents
from .secret_automata import fit_secrets, scan_secrets
from .simhash_gray import simhash_groups
from .token_files import read_token_files, write_token_files
from .toxicity_fst import fit_toxicity, held_out, score_toxicity
from .trie_variants import spelling_groups
from .url_reputation import ARTICLE, LOWER, MARKUP, REFERENCES, SECOND_LEVEL, SPACES, UPPER, judge_urls, page_outcomes
from .va_file import nearest_rows

BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Longest match wins.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


#: A text is called toxic from this score on.
TOXIC = 0.3


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and item that a passage of it repeats."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = score_toxicity(docs, fit_toxicity(docs, labels.filter(~held_out())))
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "clauses")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort(table(spark, sf_dir, "documents"), keep="max")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_secrets(docs, fit_secrets(docs))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: a page is bad if the text that it carries is labelled as of low quality."""
    pages = table(spark, sf_dir, "pages")
    rows = judge_urls(pages, page_outcomes(pages, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), URL_RULES)
    return rows.withColumns({c: F.round(c, 6) for c in ("bad_rate", "bad_rate_low")})


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"), words=3, limit=3)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, end_id=0))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), WORD_TOKENIZER, end_id=2, capacity=4096)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_rows(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_decontamination": op2_decontamination,
    "op3_toxicity": op3_toxicity,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_url_filter": op6_url_filter,
    "op7_simhash": op7_simhash,
    "op8_license_scan": op8_license_scan,
    "op9_token_files": op9_token_files,
    "op10_packing": op10_packing,
    "op11_spelling": op11_spelling,
    "op12_ranked_search": op12_ranked_search,
    "op13_nearest": op13_nearest,
}


def _weight(groups: str) -> str:
    """Pages that the prior over these groups counts as; ``whole`` has the mean rate."""
    return f"""
        (SELECT CASE WHEN k < 2 OR within <= 0 OR spare <= 0 THEN 10000.0 WHEN between_ <= 0 THEN 10000.0 ELSE least(10000.0, greatest(1.0, within / between_ - 1)) END::DOUBLE AS w FROM (
            SELECT *, (s - (k - 1) * within) / nullif(spare, 0) AS between_ FROM (
                SELECT count(*) AS k, coalesce(sum(n * (bad / n - mean) ** 2), 0) AS s, coalesce(sum(n) - sum(n * n) / nullif(sum(n), 0), 0) AS spare, max(mean * (1 - mean)) AS within
                FROM {groups}, whole WHERE n > 0)))"""


def _folded(text: str) -> str:
    return f"trim(regexp_replace(coalesce({text}, ''), '{SPACES}', ' ', 'g'))"


def _carried() -> str:
    text = f"CASE WHEN regexp_extract(html, '{ARTICLE}', 1) <> '' THEN regexp_extract(html, '{ARTICLE}', 1) ELSE html END"
    for pattern, other in MARKUP:
        text = f"regexp_replace({text}, '{pattern}', '{other}', 'g')"
    for name, other in REFERENCES:
        text = "replace({}, '{}', '{}')".format(text, name, other.replace("'", "''"))
    return _folded(text)


_RULE_CASES = {
    kind: " ".join(
        f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}') THEN '{verdict if kind == 'verdict' else rule}'"
        for verdict, rule in sorted(URL_RULES, key=lambda r: (len(r[1]), r[1]), reverse=True) for name, _, rest in [rule.partition("/")]
    )
    for kind in ("rule", "verdict")
}

URL_SQL = rf"""
    WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
    parts AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
    good AS (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY 1),
    texts AS (SELECT {_folded("text")} AS body, min(1 - quality) AS bad FROM documents JOIN good USING (doc_id) GROUP BY 1),
    known AS (SELECT page_id, 1 AS n, avg(bad) AS bad FROM (SELECT page_id, {_carried()} AS body FROM pages) JOIN texts USING (body) WHERE body <> '' GROUP BY 1),
    counted AS (SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM parts LEFT JOIN known USING (page_id) GROUP BY 1),
    bare AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS name FROM counted),
    split AS (SELECT *, regexp_extract(name, '(?:^|\.)([^.]+\.(?:{"|".join(SECOND_LEVEL)})\.[a-z]{{2}})$', 1) AS two_level, regexp_extract(name, '\.([^.]*\.[^.]*)$', 1) AS last_two, name AS own FROM bare),
    hosts AS (SELECT host, n, bad, domain, regexp_replace(domain, '^[^.]*\.', '') AS suffix FROM (SELECT *, CASE WHEN two_level <> '' THEN two_level WHEN last_two <> '' THEN last_two ELSE own END AS domain FROM split)),
    whole AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(bad) + 1) / (sum(n) + 2) ELSE 0.5 END::DOUBLE AS mean FROM hosts),
    domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
    suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
    suffix_rates AS (SELECT suffix, (bad + w * mean) / (n + w) AS r FROM suffixes, whole, {_weight("suffixes")}),
    domain_rates AS (SELECT domain, (bad + w * r) / (n + w) AS r FROM domains JOIN suffix_rates USING (suffix), {_weight("domains")}),
    host_rates AS (SELECT host, (bad + w * r) / (n + w) AS bad_rate, n + w AS seen FROM hosts JOIN domain_rates USING (domain), {_weight("hosts")}),
    bounds AS (SELECT host, bad_rate, bad_rate - 1.645 * sqrt(bad_rate * (1 - bad_rate) / (seen + 1)) AS bad_rate_low FROM host_rates)
    SELECT page_id, host, path, CASE {_RULE_CASES["rule"]} END AS rule,
           coalesce(CASE {_RULE_CASES["verdict"]} END, CASE WHEN bad_rate_low >= 0.25 THEN 'block' ELSE 'allow' END) AS verdict,
           round(bad_rate, 6) AS bad_rate, round(bad_rate_low, 6) AS bad_rate_low
    FROM parts JOIN bounds USING (host)"""

_TEMPLATES = ", ".join(f"({k}, '{label}', {str(exact).lower()}, '{text}')" for k, (label, text, exact) in enumerate([(*p, True) for p in PHRASES] + [(*p, False) for p in PASSAGES]))

LICENSE_SQL = rf"""
    WITH templates AS (SELECT k AS template, label, exact, string_split(text, ' ') AS tw FROM (VALUES {_TEMPLATES}) AS v(k, label, exact, text)),
    marks AS (SELECT template, t, tw[t + 1] || ' ' || tw[t + 2] || ' ' || tw[t + 3] AS gram FROM (SELECT *, unnest(range(len(tw) - 2)) AS t FROM templates)),
    texts AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
    grams AS (SELECT row, p, words[p + 1] || ' ' || words[p + 2] || ' ' || words[p + 3] AS gram FROM (SELECT row, words, unnest(range(len(words) - 2)) AS p FROM texts)),
    votes AS (SELECT DISTINCT row, template, p - t AS diagonal FROM grams JOIN marks USING (gram)),
    gaps AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal) > 3, true)::INT AS fresh FROM votes),
    runs AS (SELECT *, sum(fresh) OVER (PARTITION BY row, template ORDER BY diagonal) AS span FROM gaps),
    compared AS (SELECT row, template, span, label, exact, diagonal, t, len(tw) AS n, t + diagonal >= 0 AND coalesce(words[t + diagonal + 1] = tw[t + 1], false) AS same
                 FROM (SELECT *, unnest(range(len(tw))) AS t FROM runs JOIN templates USING (template) JOIN texts USING (row))),
    places AS (SELECT row, template, span, label, diagonal, bool_and(exact AND same) AS place FROM compared GROUP BY ALL),
    parts AS (SELECT row, template, span, label, count(DISTINCT t) FILTER (same)::DOUBLE / max(n) AS part FROM compared GROUP BY row, template, span, label),
    spans AS (SELECT row, label, max(part) AS part, count(*) FILTER (place) AS places, min(diagonal) FILTER (place) AS first, max(diagonal) FILTER (place) AS last FROM places JOIN parts USING (row, template, span, label) GROUP BY row, template, span, label),
    found AS (SELECT row, sum(places)::BIGINT AS n_base, min(first)::BIGINT AS first_word, max(last)::BIGINT AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (places > 0) AS base_labels,
                     string_agg(DISTINCT label, ',' ORDER BY label) FILTER (places > 0 OR part >= 0.7) AS labels, max(part) AS score FROM spans GROUP BY 1)
    SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 6) AS score
    FROM texts LEFT JOIN found USING (row)"""

#: The CRC-32 of a text's UTF-8 bytes, with a table made from its polynomial (fixed value).
_CRC = """
    crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, b)) AS crc),"""


def _crc(text: str) -> str:
    digit = lambda at: f"(strpos('0123456789ABCDEF', substr(hex({text}), {at}, 1)) - 1)"
    step = f"xor(c // 256, crc[xor(c % 256, 16 * {digit('2 * i + 1')} + {digit('2 * i + 2')}) + 1])"
    return f"xor(list_reduce(range(strlen({text})), lambda c, i: {step}, 4294967295), 4294967295)"


SPELLING_SQL = rf"""
    WITH RECURSIVE {_CRC}
    runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
    hashed AS (SELECT run, n, coalesce({_crc("(doc_id || ':' || run)")}, 1) AS h FROM runs, crc_table WHERE length(run) >= 5),
    words AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM hashed GROUP BY 1 HAVING sum(n) >= 3 AND length(word) >= 5),
    less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
    near AS (SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
             UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
    best AS (SELECT word, count(*) AS n_near, max(n) AS near_n, arg_min(other, (-n, other)) AS other FROM near GROUP BY 1),
    forms AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 2 * w.n THEN other END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)),
    chain AS (SELECT word, word AS root FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c USING (word) WHERE c.root IN (SELECT word FROM forms WHERE form IS NULL)"""


def _terms(name: str, key: str) -> str:
    found = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"SELECT {key}, unnest({found}) AS term FROM {name}"


SEARCH_SQL = rf"""
    WITH asked AS (SELECT item, item_id, term, count(*) AS times FROM ({_terms("(SELECT *, row_number() OVER () AS item FROM benchmark)", "item, item_id")}) GROUP BY ALL),
    terms AS ({_terms("(SELECT *, row_number() OVER () AS row FROM documents)", "row, doc_id")}),
    sizes AS (SELECT row, doc_id, count(*) AS n FROM terms GROUP BY ALL),
    whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS run FROM sizes),
    postings AS (SELECT row, term, count(*) AS tf FROM terms SEMI JOIN asked USING (term) GROUP BY ALL),
    weight AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM postings, whole GROUP BY term, docs),
    adds AS (SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // run))) AS points FROM postings JOIN sizes USING (row) JOIN weight USING (term), whole),
    scores AS (SELECT item, item_id, row, doc_id, sum(times * points)::BIGINT AS score FROM asked JOIN adds USING (term) GROUP BY ALL HAVING sum(times * points) > 0)
    SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id)::INT AS rank FROM scores) WHERE rank <= 10"""

NEAREST_SQL = """
    WITH whole AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)),
    scores AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM whole q JOIN whole c ON q.row <> c.row AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
    SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INT AS rank FROM scores) WHERE rank <= 5"""

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op6_url_filter": URL_SQL,
    "op8_license_scan": LICENSE_SQL,
    "op11_spelling": SPELLING_SQL,
    "op12_ranked_search": SEARCH_SQL,
    "op13_nearest": NEAREST_SQL,
}
