"""Registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import ann, audit, bpe, covertree, jaccard, langid, lexicon, lines, packing, quality, runs, secrets, warc
from wayfold.llm.tables import held_out, ship, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

JSON_PATH = public_tokenizers.path("byte_bpe_50k.json")
RANKS_PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return function


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    stats = quality.with_statistics(table(spark, sf_dir, "documents"))
    model = quality.fit(stats, table(spark, sf_dir, "labels"))
    return quality.score(stats, model)


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures derived from ``pages``: up to two full responses of each page and revisits after them.

    Validators differ by page: entity tags strong, weak, outdated or missing, modification times.
    """
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    changed = F.concat(F.lit('"'), F.md5(F.concat("html", F.lit("2"))), F.lit('"'))
    has_second = F.col("page_id") % 3 == 0
    start = F.col("page_id") * 10

    def capture(number: int, status: int, etag, modified, extra: dict[str, object]):
        at = start + number * 3
        names = {"Date": at.cast("string"), "ETag": etag, "Last-Modified": modified, **extra}
        headers = F.create_map(*[x for n, v in names.items() for x in (F.lit(n), v)])
        return F.struct(
            (F.col("page_id") * 5 + number).alias("record_id"),
            at.alias("captured_at"),
            F.lit(status).alias("status"),
            F.map_filter(headers, lambda _, v: v.isNotNull()).alias("headers"),
        )

    none = F.lit(None).cast("string")
    length = F.length("html").cast("string")
    page = {"Content-Type": F.lit("text/html"), "Content-Length": length}
    cache = {"Cache-Control": F.lit("max-age=60"), "Content-Length": F.lit("0")}
    first_etag = (
        F.when(F.col("page_id") % 5 == 0, F.lit('"old"')).when(F.col("page_id") % 4 == 1, none).otherwise(tag)
    )
    times = F.when(F.col("page_id") % 8 != 1, start.cast("string"))
    rows = F.filter(
        F.array(
            capture(0, 200, tag, start.cast("string"), page),
            capture(1, 304, first_etag, times, cache),
            F.when(has_second, capture(2, 200, changed, (start + 6).cast("string"), page)),
            capture(3, 304, F.concat(F.lit("W/"), F.when(has_second, changed).otherwise(tag)), none, {}),
        ),
        lambda c: c.isNotNull(),
    )
    return table(spark, sf_dir, "pages").select("url", F.explode(rows).alias("c")).select("url", "c.*")


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The response each revisit stands for, with its merged headers as sorted lines."""
    found = warc.resolve_revisits(captures(spark, sf_dir))
    lines_of = F.array_sort(
        F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"]))
    )
    return found.select(
        "record_id", "url_key", "base_id", "verdict", F.array_join(lines_of, "\n").alias("headers")
    )


ORACLE_SQL["op2_warc"] = """
WITH bare AS (
  SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u
  FROM pages),
parts AS (
  SELECT page_id, html,
         regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www[.]', '') AS host,
         regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '[?](.*)$', 1), '&'),
           lambda p: p <> '' AND NOT regexp_matches(lower(string_split(p, '=')[1]),
                                                     '^(utm_[a-z]+|ref|fbclid|gclid|sessionid)$'))), '&') AS query
  FROM bare),
keyed AS (
  SELECT page_id, length(html) AS n, '"' || md5(html) || '"' AS tag, '"' || md5(html || '2') || '"' AS changed,
         host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' END || query AS url_key
  FROM parts),
full_ AS (
  SELECT page_id * 5 AS id, url_key, page_id * 10 AS moment, tag AS etag, n FROM keyed
  UNION ALL
  SELECT page_id * 5 + 2, url_key, page_id * 10 + 6, changed, n FROM keyed WHERE page_id % 3 = 0),
revisit AS (
  SELECT page_id * 5 + 1 AS id, url_key, page_id * 10 + 3 AS moment,
         CASE WHEN page_id % 5 = 0 THEN '"old"' WHEN page_id % 4 = 1 THEN NULL ELSE tag END AS etag,
         CASE WHEN page_id % 8 <> 1 THEN (page_id * 10)::VARCHAR END AS modified, 'max-age=60' AS cache FROM keyed
  UNION ALL
  SELECT page_id * 5 + 3, url_key, page_id * 10 + 9,
         'W/' || CASE WHEN page_id % 3 = 0 THEN changed ELSE tag END, NULL, NULL FROM keyed),
found AS (
  SELECT r.*, f.id AS base_id, f.etag AS base_etag, f.moment AS base_at, f.n AS base_n
  FROM revisit r LEFT JOIN (
    SELECT r2.id AS rid, max_by(f2.id, (f2.moment, f2.id)) AS fid
    FROM revisit r2 JOIN full_ f2 ON f2.url_key = r2.url_key AND f2.moment < r2.moment GROUP BY 1) b ON b.rid = r.id
  LEFT JOIN full_ f ON f.id = b.fid),
judged AS (
  SELECT *, CASE WHEN base_id IS NULL THEN 'no_response'
    WHEN etag IS NOT NULL THEN CASE WHEN base_etag = regexp_replace(etag, '^W/', '') THEN 'resolved' ELSE 'changed' END
    WHEN modified IS NOT NULL THEN CASE WHEN base_at::VARCHAR = modified THEN 'resolved' ELSE 'changed' END
    ELSE 'no_validator' END AS verdict
  FROM found)
SELECT id AS record_id, url_key, base_id, verdict,
       CASE WHEN verdict = 'resolved' THEN array_to_string(list_sort(list_filter([
         'content-length: ' || base_n, 'content-type: text/html', 'cache-control: ' || cache, 'date: ' || moment,
         'etag: ' || coalesce(etag, base_etag), 'last-modified: ' || coalesce(modified, base_at::VARCHAR)],
         lambda x: x IS NOT NULL)), chr(10)) END AS headers
FROM judged
"""


@query
def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every twentieth id."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0").select("vec_id"))


@query
def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose shingle sets reach the similarity."""
    return jaccard.components(table(spark, sf_dir, "documents"))


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.learn(docs)).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_grammar"
    )


@query
def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document, whether it stays, and the line that stays for it."""
    return lines.mark(table(spark, sf_dir, "documents"))


@query
def op7_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors of one label."""
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every token piece in a packed sequence."""
    vocabulary = bpe.Vocabulary(JSON_PATH, public_tokenizers.PATTERN)
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary)


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of what they decode to."""
    vocabulary = bpe.Vocabulary(RANKS_PATH, public_tokenizers.PATTERN)
    columns = ("n_tokens", "ids_sha256", "decoded_sha256")
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary, columns)


@query
def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    contents = langid.learn(docs)
    return langid.identify(docs.select("doc_id", "text"), contents).select(
        "doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", F.col("rejected")
    )


@query
def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every order of five filters keeps and removes in each source."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# The Shapley value is summed over all orders here, without potentials.
ORACLE_SQL["op11_audit"] = """
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce("text", '') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS first_id FROM texts GROUP BY t),
worded AS (
  SELECT d.*, regexp_extract_all(d.t, '[^\\x20\\x09-\\x0D]+') AS words, f.first_id
  FROM texts d JOIN firsts f ON f.t = d.t),
marked AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels
  WHERE doc_id IS NOT NULL GROUP BY doc_id),
failed AS (
  SELECT w.part,
         len(words) < 50 AS a,
         100 * len(list_distinct(words)) < 65 * len(words) AS b,
         100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(w.doc_id > first_id, false) AS e,
         coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic
  FROM worded w LEFT JOIN marked m ON m.doc_id = w.doc_id),
counts AS (
  SELECT part, a, b, c, d, e, count(*) AS n,
         count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM failed GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || u.x AS filter_order
  FROM letters p JOIN letters q ON q.x <> p.x JOIN letters r ON r.x NOT IN (p.x, q.x)
  JOIN letters s ON s.x NOT IN (p.x, q.x, r.x) JOIN letters u ON u.x NOT IN (p.x, q.x, r.x, s.x)),
coded AS (
  SELECT *, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
            || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails
  FROM counts),
placed AS (
  SELECT c.part, c.n, c.good, c.toxic, c.fails, o.filter_order, k.step, substr(o.filter_order, k.step, 1) AS letter,
         CASE WHEN c.fails = '' THEN 6
              ELSE list_min(list_transform(string_split(c.fails, ''), lambda f: instr(o.filter_order, f))) END AS gone
  FROM coded c, orders o, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS step) k),
summed AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (WHERE gone > step), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE gone = step), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE gone < step AND contains(fails, letter)), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE fails = letter), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE gone = step), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE gone = step), 0)::BIGINT AS toxic_lost
  FROM placed GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM summed
"""


@query
def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, a tenth of which is made periodic."""
    return runs.digests(runs.mark_runs(runs.with_periods(table(spark, sf_dir, "documents"))))


@query
def op13_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of their text, with frequent words from a transducer."""
    docs = table(spark, sf_dir, "documents")
    tokenizer = lexicon.TokenizerFile.read(JSON_PATH, public_tokenizers.PATTERN)
    encoded = lexicon.encode(docs, lexicon.compile_lexicon(docs, tokenizer))
    return lexicon.digests(lexicon.decode(encoded, tokenizer))
