"""The corpus operators as queries over the given tables, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, divergence, html_text, langid, lexical, licenses, packing, simhash, token_counts, toxicity, url_filter
from .common import table

VOCABULARY = "byte_bpe_50k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).drop("component")


def severity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Severity:
    labels = table(spark, sf_dir, "labels")
    grades = labels.select("doc_id", toxicity.grade_of(labels["toxic"], labels["quality"]).alias("grade")).where("grade is not null")
    return toxicity.fit_severity(toxicity.sample_labelled(docs.select("doc_id", "text"), grades))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_severity(docs, severity_model(spark, docs, sf_dir))


def op5_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a dialogue; its masks as text, ``start-end`` after ``start-end``."""
    spoken = chat.dialogues(chat.rotate_perspectives(table(spark, sf_dir, "conversations")))
    return spoken.withColumn("masks", F.array_join(F.transform("masks", lambda x: F.concat_ws("-", x["start"], x["end"])), ","))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest_neighbours(vectors, vectors.where("vec_id % 50 = 0"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_token_counts, op2_decontamination, op3_url_filter, op4_toxicity, op5_chat_rotation, op6_language_id, op7_packing, op8_license_scan, op9_nearest_neighbours, op10_simhash, op11_lexical_search, op12_html_text, op13_source_divergence)
    return {f.__name__: f for f in ops}


_HOST = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"


def _rule_case(column: int, host: str, path: str) -> str:
    """CASE over the rules, longest first, giving the rule's text or its verdict."""
    ordered = sorted(url_filter.RULES, key=lambda r: (-len(r[0] + r[1]), r))
    whens = "".join(f" WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{(h + p, v)[column]}'" for h, p, v in ordered)
    return f"CASE{whens} END"


#: A quote within a quoted SQL text is doubled.
_TOKENS = url_filter.TOKENS.replace("'", "''")


def _attribute(name: str) -> str:
    """A tag's first attribute of a name, from its tokens ``t``."""
    value = f"regexp_replace(list_filter(t[2:], lambda a: regexp_matches(a, '(?is)^{name}(?:\\s*=|\\z)'))[1], '(?s)^[^=]*=?\\s*', '')"
    unquoted = f"""regexp_replace(regexp_replace({value}, '(?s)^"(.*)"\\z', '\\1'), '(?s)^''(.*)''\\z', '\\1')"""
    return f"replace(trim(translate({unquoted}, chr(9) || chr(10) || chr(13), '   ')), '&amp;', '&')"


def _resolved(page: str) -> str:
    """``link`` as an address on a page, before ``.`` and ``..`` are followed."""
    return f"""CASE WHEN regexp_matches(link, '(?s)^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN regexp_matches(link, '(?s)^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(link, '//') THEN regexp_extract({page}, '(?s)^(.*?:)//', 1) || link
    WHEN starts_with(link, '/') THEN regexp_extract({page}, '(?s)^(.*?://[^/?#]*)', 1) || link
    WHEN link = '' OR starts_with(link, '?') OR starts_with(link, '#') THEN regexp_extract({page}, '(?s)^(.*?://[^/?#]*)', 1) || regexp_extract({page}, '(?s)^.*?://[^/?#]*([^?#]*)', 1) || link
    ELSE regexp_extract({page}, '(?s)^(.*?://[^/?#]*)', 1) || coalesce(nullif(regexp_extract({page}, '(?s)^.*?://[^/?#]*([^?#]*/)', 1), ''), '/') || link END"""


OP3_SQL = f"""
WITH RECURSIVE seen AS (SELECT page_id, url, html, {_HOST} AS host, {_PATH} AS path FROM pages),
bare AS (SELECT DISTINCT url, regexp_replace(translate(html, chr(1), ''), '{url_filter.UNREAD}', ' ', 'g') AS html FROM pages WHERE contains(url, '://')),
begun AS (SELECT url, list_transform(string_split(regexp_replace(html, '(?i)<(link|meta|base)([\\s/])', chr(1) || '\\1\\2', 'g'), chr(1))[2:], lambda t: regexp_extract_all(t, '{_TOKENS}')) AS tags FROM bare),
ended AS (SELECT url, list_filter(list_transform(tags, lambda t: list_slice(t, 1, coalesce(list_position(t, '>'), 1) - 1)), lambda t: len(t) > 0) AS tags FROM begun),
read AS (
  SELECT url, list_transform(tags, lambda t: {{'tag': lower(t[1]), 'rel': {_attribute("rel")}, 'href': {_attribute("href")}, 'equiv': lower({_attribute("http-equiv")}), 'content': {_attribute("content")}}}) AS tags FROM ended),
based AS (SELECT url, tags, list_filter(tags, lambda t: t.tag = 'base' AND t.href IS NOT NULL)[1].href AS link FROM read),
bases AS (SELECT url, tags, CASE WHEN contains({_resolved("url")}, '://') THEN {_resolved("url")} ELSE url END AS base FROM based),
named AS (
  SELECT url, base, unnest(list_transform(list_filter(tags, lambda t: t.tag = 'link' AND list_contains(regexp_split_to_array(lower(coalesce(t.rel, '')), '\\s+'), 'canonical')), lambda t: t.href)) AS link FROM bases
  UNION ALL SELECT url, base, unnest(list_transform(list_filter(tags, lambda t: t.tag = 'meta' AND t.equiv = 'refresh'),
    lambda t: trim(regexp_replace(regexp_replace(regexp_extract(t.content, '(?is)^\\s*0*(?:\\.0*)?\\s*[;,]\\s*(?:url\\s*=\\s*)?(.*)\\z', 1), '(?s)^"([^"'']*).*\\z', '\\1'), '(?s)^''([^"'']*).*\\z', '\\1')))) FROM bases),
whole AS (SELECT url, {_resolved("base")} AS target FROM named WHERE link <> ''),
declared AS (
  SELECT DISTINCT url, CASE WHEN regexp_matches(target, '(?s)^.*?://[^?#]*/\\.\\.?(?:[/?#]|$)') THEN
      regexp_extract(target, '(?s)^(.*?://[^/?#]*)', 1)
      || list_reduce(string_split(regexp_extract(target, '(?s)^.*?://[^/?#]*/?([^?#]*)', 1), '/'), lambda a, x: CASE WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN x = '.' THEN a ELSE a || '/' || x END, '')
      || regexp_extract(target, '(?s)^.*?://[^?#]*(.*)$', 1) ELSE target END AS target
  FROM whole WHERE contains(target, '://')),
known AS (SELECT url FROM seen WHERE contains(url, '://') UNION SELECT target FROM declared),
addr AS (
  SELECT DISTINCT url, 'https://' || regexp_replace(host, '^(www|m)\\.', '')
    || regexp_replace(regexp_replace(path, '/index\\.html?$', '/'), '/+$', '')
    || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\\?([^#]*)', 1), '&'),
         lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(utm_[a-z]+|ref|source|fbclid|gclid|session)='))), '&'), ''), '') AS canon
  FROM (SELECT url, {_HOST} AS host, {_PATH} AS path FROM known)),
links AS (
  SELECT url AS a, canon AS b FROM addr
  UNION SELECT canon, canon FROM addr
  UNION SELECT url, target FROM declared),
nodes AS (SELECT a AS n FROM links UNION SELECT b FROM links),
reach(n, m) AS (
  SELECT n, n FROM nodes
  UNION SELECT r.n, e.y FROM reach r JOIN (SELECT a AS x, b AS y FROM links UNION SELECT b, a FROM links) e ON r.m = e.x),
judged AS (SELECT n AS url, {_HOST.replace("url", "n")} AS host, {_PATH.replace("url", "n")} AS path FROM nodes),
ruled AS (SELECT url, {_rule_case(1, "host", "path")} AS v FROM judged),
spread AS (SELECT r.n, bool_or(v = 'block') AS blocked, bool_or(v = 'allow') AS allowed FROM reach r JOIN ruled ON r.m = ruled.url WHERE v IS NOT NULL GROUP BY r.n)
SELECT page_id, host, path, {_rule_case(0, "host", "path")} AS rule,
  coalesce({_rule_case(1, "host", "path")}, CASE WHEN blocked AND NOT allowed THEN 'block' ELSE 'allow' END) AS verdict
FROM seen LEFT JOIN spread ON seen.url = spread.n
"""

OP5_SQL = r"""
WITH said AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM said WHERE role IS NOT NULL AND role <> 'system'),
rows AS (
  SELECT s.conv_id, perspective, turn, text, role, coalesce(role = perspective, false) AS own,
    CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user' END AS chat_role,
    CASE WHEN coalesce(role <> perspective AND role <> 'system', false) THEN role END AS name
  FROM (SELECT conv_id, turn, role, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS text FROM said) s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
headed AS (SELECT *, '<|' || chat_role || coalesce(' name=' || regexp_replace(name, '[<|>\r\n]', '_', 'g'), '') || '|>' || chr(10) AS header FROM rows),
spoken AS (SELECT conv_id, perspective, turn, md5(coalesce(role, '') || chr(10) || text) AS digest, own, length(header) AS skip, header || text || '<|end|>' || chr(10) AS rendered FROM headed),
placed AS (
  SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, digest, rendered, own ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM spoken),
parts AS (SELECT *, pos // 1048576 AS part, min(pos) OVER (PARTITION BY conv_id, perspective, pos // 1048576) AS start FROM placed)
SELECT conv_id, perspective, part, start, count(*) AS n_messages, string_agg(rendered, '' ORDER BY pos) AS rendered,
  coalesce(string_agg((pos + skip - start) || '-' || (pos + length(rendered) - start), ',' ORDER BY pos) FILTER (WHERE own), '') AS masks
FROM parts GROUP BY conv_id, perspective, part, start
"""

_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP11_SQL = f"""
WITH q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT doc_id, len(l) AS n, l FROM (SELECT doc_id, {_TERMS} AS l FROM documents) WHERE len(l) > 0),
st AS (SELECT count(*) AS docs, sum(n)::BIGINT AS tokens FROM w),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(l) AS term FROM w) SEMI JOIN q USING (term) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), st),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // tokens)))))::BIGINT AS score FROM p JOIN f USING (term) JOIN q USING (term), st GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""

#: For pages whose main text stands in one article element without boxes, as in all given ones; what else repeats there stands outside it.
OP12_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS a FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(a, '</?(?:p|h[1-6]|ul|ol|li|div|blockquote)\b[^>]*>'), lambda x: regexp_replace(regexp_replace(x, '<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g')) AS l FROM a),
c AS (SELECT page_id, url, list_transform(l, lambda x: regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g')) AS l FROM b),
d AS (SELECT page_id, url, list_transform(l, lambda x: trim(regexp_replace(regexp_replace(x, '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS l FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM (SELECT page_id, url, array_to_string(list_filter(l, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM d)
"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= 3),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS count FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT lang, source, coalesce(sum(count), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(count, 0) AS count, 1 + (1000000000::HUGEINT * (coalesce(count, 0) + 1)) // (n.n + v) AS p, 1 + (1000000000::HUGEINT * (total + 1)) // (l.n + v) AS q
  FROM n JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p WHERE count > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; the others are tested against brute force in tests/llm."""
    return {"op3_url_filter": OP3_SQL, "op5_chat_rotation": OP5_SQL, "op11_lexical_search": OP11_SQL, "op12_html_text": OP12_SQL, "op13_source_divergence": OP13_SQL}
