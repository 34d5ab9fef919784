"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from batchwright.llm.bpe import token_report
from batchwright.llm.decontamination import contamination_report
from batchwright.llm.exact_dedup import exact_dedup
from batchwright.llm.html_extraction import extract_main_text
from batchwright.llm.lexical_search import search
from batchwright.llm.line_dedup import line_report
from batchwright.llm.minhash_dedup import near_duplicates
from batchwright.llm.pii import pii_report
from batchwright.llm.quality import quality_report
from batchwright.llm.secret_scan import secret_report
from batchwright.llm.spelling_variants import spelling_variants
from batchwright.llm.suffix_dedup import suffix_report
from batchwright.llm.toxicity import toxicity_report

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = " ".join(sql.split())
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@registered(r"""
    WITH d AS (
      SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
      FROM documents),
    g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
    SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
    FROM d JOIN g USING (text_sha256)
""")
def op10_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


@registered()
def op8_decontamination(spark, sf_dir):
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@registered()
def op2_byte_bpe(spark, sf_dir):
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return token_report(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)


@registered()
def op6_pii(spark, sf_dir):
    return pii_report(table(spark, sf_dir, "documents"))


@registered()
def op4_toxicity(spark, sf_dir):
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registered()
def op9_quality(spark, sf_dir):
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registered()
def op7_minhash_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


@registered()
def op5_html_extraction(spark, sf_dir):
    return extract_main_text(table(spark, sf_dir, "pages"))


@registered(r"""
    WITH raw AS (SELECT row_number() OVER () AS row_id, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
    masked AS (
      SELECT row_id, doc_id, list_distinct(list_filter(list_transform(parts, lambda x:
        regexp_replace(trim(x, ' '), '[^ 0-9]*[0-9][^ ]*', '<*>', 'g')), lambda x: x <> '')) AS lines FROM raw),
    line AS (
      SELECT row_id, line, string_split(line, ' ') AS tokens, md5(array_to_string(list_sort(lines), chr(10))) AS document
      FROM (SELECT row_id, lines, unnest(lines) AS line FROM masked)),
    leafed AS (
      SELECT row_id, line, tokens, document, concat_ws(' ', len(tokens)::VARCHAR, array_to_string(tokens[1:3], ' ')) AS leaf FROM line),
    least AS (
      SELECT row_id, list_sort(list_distinct(list(left(md5(leaf), 16)))) AS hashes FROM leafed GROUP BY row_id),
    keyed AS (
      SELECT l.*, CASE WHEN left(md5(leaf), 16) = hashes[1] THEN coalesce(hashes[2], '') ELSE hashes[1] END AS print
      FROM leafed l JOIN least USING (row_id)),
    same AS (
      SELECT line FROM keyed GROUP BY line
      HAVING count(DISTINCT print) >= 3 AND 2 * count(DISTINCT print) >= count(DISTINCT document)),
    once AS (SELECT DISTINCT line, leaf, tokens FROM keyed),
    crowded AS (SELECT leaf FROM once GROUP BY leaf HAVING count(*) >= 3),
    token AS (
      SELECT line, leaf, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place
      FROM once WHERE len(tokens) > 3 AND leaf IN (SELECT leaf FROM crowded)),
    constant AS (SELECT leaf, place, token FROM token GROUP BY ALL HAVING count(*) >= 3),
    template AS (
      SELECT t.line, string_agg(CASE WHEN c.token IS NULL THEN '<*>' ELSE t.token END, ' ' ORDER BY t.place) AS template
      FROM token t LEFT JOIN constant c ON t.leaf = c.leaf AND t.place = c.place AND t.token = c.token
      GROUP BY t.line HAVING 100 * count(c.token) >= 60 * count(*)),
    variant AS (
      SELECT template FROM template JOIN keyed USING (line) GROUP BY template
      HAVING count(DISTINCT print) >= 3 AND 2 * count(DISTINCT print) >= count(DISTINCT document)),
    recurring AS (
      SELECT line FROM same UNION SELECT line FROM template JOIN variant USING (template)),
    part AS (
      SELECT row_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS place FROM raw),
    judged AS (
      SELECT row_id, part, place, r.line IS NULL AS stays
      FROM part p LEFT JOIN recurring r
        ON regexp_replace(trim(part, ' '), '[^ 0-9]*[0-9][^ ]*', '<*>', 'g') = r.line),
    told AS (
      SELECT row_id, count(*) FILTER (NOT stays) AS n_dropped,
        coalesce(string_agg(part, chr(10) ORDER BY place) FILTER (stays), '') AS kept
      FROM judged GROUP BY row_id)
    SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(parts) END AS n_lines, n_dropped, sha256(kept) AS kept_sha256
    FROM raw JOIN told USING (row_id)
""")
def op3_line_dedup(spark, sf_dir):
    return line_report(table(spark, sf_dir, "documents"))


@registered()
def op1_suffix_dedup(spark, sf_dir):
    return suffix_report(table(spark, sf_dir, "documents"))


@registered()
def op11_secret_scan(spark, sf_dir):
    return secret_report(table(spark, sf_dir, "documents"))


@registered()
def op12_spelling_variants(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))


@registered(r"""
    WITH d AS (
      SELECT row_number() OVER () AS row_id, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
      FROM documents),
    total AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d),
    item AS (
      SELECT number, item_id, term, count(*) AS times FROM (
        SELECT number, item_id, unnest(regexp_extract_all(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM (SELECT row_number() OVER () AS number, item_id, text FROM benchmark))
      GROUP BY ALL),
    asked AS (SELECT DISTINCT term FROM item),
    tf AS (
      SELECT row_id, doc_id, n, term, count(*) AS tf
      FROM (SELECT row_id, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d) SEMI JOIN asked USING (term)
      GROUP BY ALL),
    weight AS (
      SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM tf, total GROUP BY term),
    entry AS (
      SELECT row_id, doc_id, term,
        w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))) AS x
      FROM tf JOIN weight USING (term), total),
    scored AS (
      SELECT number, item_id, row_id, doc_id, sum(times * x)::BIGINT AS score
      FROM item JOIN entry USING (term) GROUP BY ALL HAVING sum(times * x) > 0),
    ranked AS (
      SELECT item_id, row_number() OVER (PARTITION BY number ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
""")
def op13_lexical_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
