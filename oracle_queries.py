"""DuckDB equivalents of the registered queries, over the same tables."""

from __future__ import annotations

TREE = """
nodes AS (
  SELECT 0::BIGINT AS id, NULL::BIGINT AS parent_id, 'world' AS name, 2 AS admin_level,
         '00000' AS ord
  UNION ALL
  SELECT (1 + r_regionkey)::BIGINT, 0, r_name, 4, format('00000/{:05d}', r_regionkey) FROM region
  UNION ALL
  SELECT (1000 + n_nationkey)::BIGINT, 1 + n_regionkey, n_name, 6,
         format('00000/{:05d}/{:05d}', n_regionkey, n_nationkey) FROM nation
  UNION ALL
  SELECT (1000000 + 1000 * c_nationkey + pos)::BIGINT, 1000 + c_nationkey, c_mktsegment, 8,
         format('00000/{:05d}/{:05d}/{:05d}', n_regionkey, n_nationkey, pos)
  FROM (SELECT c_nationkey, c_mktsegment,
               row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS pos
        FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)) s
  JOIN nation ON n_nationkey = c_nationkey),
places AS (
  SELECT id, parent_id, lower(strip_accents(name)) AS name, admin_level, ord FROM nodes),
up AS (
  SELECT id, id AS above, name AS above_name, admin_level AS above_level, parent_id AS next,
         0 AS step
  FROM places
  UNION ALL
  SELECT up.id, p.id, p.name, p.admin_level, p.parent_id, step + 1
  FROM up JOIN places p ON p.id = up.next)
"""

COUNTRY_TREE = TREE.replace(
    "places AS (\n  SELECT id, parent_id, lower(strip_accents(name)) AS name, admin_level, ord FROM nodes)",
    """places AS (
  SELECT n.id, CASE WHEN n.admin_level > 4 THEN n.parent_id END AS parent_id,
         lower(strip_accents(n.name)) AS name, n.admin_level, n.ord,
         lower(r_name) AS country
  FROM nodes n JOIN region ON r_regionkey = split_part(n.ord, '/', 2)::INT
  WHERE n.admin_level > 2)""",
)

PAIRS = """
people AS (
  SELECT c_custkey, c_mktsegment, n_name, r_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey),
raw_pairs AS (
  SELECT o_orderkey AS id_1, b.c_custkey AS id_2, a.c_mktsegment AS city_1,
         CASE o_orderkey % 4 WHEN 0 THEN a.n_name WHEN 1 THEN a.r_name
                             WHEN 3 THEN 'nowhere' END AS state_1,
         CASE WHEN o_orderkey % 11 = 0 THEN 'no such place'
              WHEN o_orderkey % 5 = 0 THEN a.n_name ELSE b.c_mktsegment END AS city_2,
         CASE o_orderkey % 3 WHEN 0 THEN b.n_name WHEN 2 THEN '' END AS state_2,
         a.r_name AS country_1, b.r_name AS country_2
  FROM orders JOIN people a ON a.c_custkey = o_custkey
  JOIN people b ON b.c_custkey = (o_custkey * 7 + 3) % (SELECT count(*) FROM customer)),
pairs AS (
  SELECT id_1, id_2,
         CASE WHEN id_1 % 2 = 1 THEN lower(city_1) ELSE city_1 END AS city_1,
         CASE WHEN id_1 % 2 = 1 THEN lower(state_1) ELSE state_1 END AS state_1,
         CASE WHEN id_1 % 2 = 1 THEN lower(city_2) ELSE city_2 END AS city_2,
         CASE WHEN id_1 % 2 = 1 THEN lower(state_2) ELSE state_2 END AS state_2,
         country_1, country_2
  FROM raw_pairs)
"""


def match_sql(best: bool = False, strict: bool = False, country: bool = False) -> str:
    tree = COUNTRY_TREE if country else TREE
    place_country = "p.country" if country else "''"
    asked_country = "lower(country_{0})" if country else "''"
    asked = " UNION ".join(
        f"SELECT lower(city_{i}) AS city, nullif(lower(trim(state_{i})), '') AS state, "
        f"{asked_country.format(i)} AS country FROM pairs"
        for i in (1, 2)
    )
    # Every place a key can mean, then only the best tier of it.
    fallback = "state IS NULL OR state = city" if strict else "true"
    common = f"""
    asked AS ({asked}),
    exact AS (
      SELECT DISTINCT a.city, a.state, a.country, p.id, p.ord FROM asked a
      JOIN places p ON p.name = a.city AND {place_country} = a.country
      JOIN up ON up.id = p.id AND step > 0 AND above_name = a.state),
    named AS (
      SELECT a.city, a.state, a.country, p.id, p.ord FROM asked a
      JOIN places p ON p.name = a.city AND {place_country} = a.country
      WHERE ({fallback}) AND NOT EXISTS (
        SELECT 1 FROM exact e WHERE e.city = a.city AND e.state = a.state
          AND e.country = a.country)),
    matches AS (SELECT * FROM exact UNION ALL SELECT * FROM named),
    keyed AS (
      SELECT city, coalesce(state, '') AS state, country, count(*) AS n, min(ord) AS first
      FROM matches GROUP BY 1, 2, 3),
    wanted AS (
      SELECT p.*, coalesce(k1.n, 0) AS n_1, coalesce(k2.n, 0) AS n_2, k1.first AS first_1,
             k2.first AS first_2, k1.city AS c1, k1.state AS s1, k1.country AS y1,
             k2.city AS c2, k2.state AS s2, k2.country AS y2
      FROM pairs p
      LEFT JOIN keyed k1 ON k1.city = lower(city_1)
        AND k1.state = coalesce(lower(trim(state_1)), '')
        AND k1.country = {asked_country.format(1)}
      LEFT JOIN keyed k2 ON k2.city = lower(city_2)
        AND k2.state = coalesce(lower(trim(state_2)), '')
        AND k2.country = {asked_country.format(2)}),
    ids AS (
      SELECT DISTINCT x.id AS a, y.id AS b FROM places x, places y),
    shared AS (
      SELECT u.id AS a, v.id AS b, max(u.above_level) AS deepest
      FROM up u JOIN up v ON u.above = v.above GROUP BY 1, 2),
    levels AS (
      SELECT a, b, CASE
          WHEN a = b THEN pa.admin_level
          WHEN EXISTS (SELECT 1 FROM up WHERE up.id = b AND up.above = a) THEN pa.admin_level
          WHEN EXISTS (SELECT 1 FROM up WHERE up.id = a AND up.above = b) THEN pb.admin_level
          ELSE greatest(2, coalesce(deepest, 2)) END AS level
      FROM ids JOIN places pa ON pa.id = a JOIN places pb ON pb.id = b
      LEFT JOIN shared USING (a, b))"""
    columns = "id_1, id_2, city_1, state_1, city_2, state_2, country_1, country_2"
    flags = "(n_1 > 1 OR n_2 > 1)::INT AS is_ambiguous"
    if best:
        return f"""WITH RECURSIVE {tree}, {PAIRS}, {common},
        combos AS (
          SELECT c1, s1, y1, c2, s2, y2, max(level) AS level
          FROM (SELECT DISTINCT c1, s1, y1, c2, s2, y2 FROM wanted
                WHERE n_1 > 0 AND n_2 > 0) w
          JOIN matches m1 ON m1.city = c1 AND coalesce(m1.state, '') = s1
          JOIN matches m2 ON m2.city = c2 AND coalesce(m2.state, '') = s2
          JOIN levels ON a = m1.id AND b = m2.id
          GROUP BY ALL)
        SELECT {columns}, coalesce(level, 2)::INT AS expected_level, {flags}
        FROM wanted LEFT JOIN combos USING (c1, s1, y1, c2, s2, y2)"""
    return f"""WITH RECURSIVE {tree}, {PAIRS}, {common}
    SELECT {columns}, coalesce(level, 2)::INT AS expected_level, {flags}
    FROM wanted
    LEFT JOIN places pa ON pa.ord = first_1 LEFT JOIN places pb ON pb.ord = first_2
    LEFT JOIN levels ON a = pa.id AND b = pb.id"""


MISSPELLED_PLACES = """
asked AS (
  SELECT c_custkey,
         CASE c_custkey % 5 WHEN 0 THEN c_mktsegment[:1] || c_mktsegment[3:] || 'q'
                            WHEN 1 THEN 'x' || c_mktsegment[2:]
                            WHEN 2 THEN c_mktsegment || 'qz'
                            WHEN 3 THEN 'xx' || c_mktsegment[3:] ELSE c_mktsegment END AS city,
         CASE WHEN c_custkey % 7 = 0 THEN 'nowhere' WHEN c_custkey % 3 = 0 THEN n_name
              WHEN c_custkey % 3 = 1 THEN 'z' || n_name[2:-2] END AS state,
         CASE WHEN c_custkey % 11 = 0 THEN 'ATLANTIS' WHEN c_custkey % 4 = 0 THEN lower(r_name)
              ELSE r_name END AS country
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""

MISSPELLED = """
asked AS (
  SELECT c_custkey,
         CASE c_custkey % 4 WHEN 0 THEN c_mktsegment[1] || substr(c_mktsegment, 3)
                            WHEN 1 THEN 'x' || substr(c_mktsegment, 2)
                            WHEN 2 THEN c_mktsegment || 'q'
                            ELSE c_mktsegment END AS city,
         CASE WHEN c_custkey % 2 = 0 THEN lower(n_name) END AS state
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""

PRODUCTS = """
sales AS (
  SELECT l_partkey, sum(CASE WHEN l_suppkey % 3 = 0 THEN l_quantity END) AS a,
         sum(CASE WHEN l_suppkey % 3 = 1 THEN l_quantity END) AS b,
         sum(CASE WHEN l_suppkey % 3 = 2 THEN l_quantity END) AS c,
         sum(l_quantity) AS total, strftime(min(l_shipdate), '%Y-%m-%d') AS first_sale
  FROM lineitem GROUP BY 1),
raw_products AS (
  SELECT p_partkey AS source_key, p_name || ' #' || p_partkey AS name,
         CASE p_type WHEN 'PROMO' THEN 'Console' WHEN 'ECONOMY' THEN 'Accessories'
                     ELSE 'Games' END AS segment,
         p_type AS category, split_part(p_name, ' ', 2) AS type,
         CASE WHEN p_partkey % 10 <> 0 THEN p_brand END AS franchise,
         CASE WHEN p_partkey % 7 <> 0 THEN p_size % 19 END AS min_age,
         CASE WHEN p_partkey % 17 <> 0 THEN total END AS times_sold,
         a AS store_a, b AS store_b, CASE WHEN p_partkey % 13 <> 0 THEN c END AS store_c,
         CASE WHEN p_partkey % 19 = 0 THEN 'n/a' ELSE first_sale END AS release_date
  FROM part LEFT JOIN sales ON l_partkey = p_partkey),
filled AS (
  SELECT row_number() OVER (ORDER BY name NULLS LAST) AS product_id, name, segment, category,
         type, franchise, coalesce(min_age, 0)::INT AS min_age,
         coalesce(times_sold::BIGINT, coalesce(store_a, 0)::BIGINT + coalesce(store_b, 0)::BIGINT
                  + coalesce(store_c, 0)::BIGINT) AS times_sold,
         coalesce(store_a, 0)::BIGINT AS store_a, coalesce(store_b, 0)::BIGINT AS store_b,
         coalesce(store_c, 0)::BIGINT AS store_c,
         nullif(release_date, 'n/a') AS release_date, source_key
  FROM raw_products),
maxima AS (
  SELECT max(times_sold) AS mt, max(store_a) AS ma, max(store_b) AS mb, max(store_c) AS mc
  FROM filled),
shares AS (
  SELECT filled.*,
         CASE WHEN mt > 0 THEN times_sold::DOUBLE / mt ELSE 0.0 END::DOUBLE AS popularity_global,
         CASE WHEN ma > 0 THEN store_a::DOUBLE / ma ELSE 0.0 END::DOUBLE AS popularity_store_a,
         CASE WHEN mb > 0 THEN store_b::DOUBLE / mb ELSE 0.0 END::DOUBLE AS popularity_store_b,
         CASE WHEN mc > 0 THEN store_c::DOUBLE / mc ELSE 0.0 END::DOUBLE AS popularity_store_c
  FROM filled, maxima),
products AS (
  SELECT *, CASE WHEN min_age <= 3 THEN '0-3' WHEN min_age <= 7 THEN '4-7'
                 WHEN min_age <= 12 THEN '8-12' WHEN min_age <= 16 THEN '13-16'
                 ELSE '17+' END AS age_bucket,
         (min_age <= 7)::INT AS family_friendly,
         replace(lower(trim(coalesce(franchise, ''))), ' ', '_') AS franchise_clean,
         concat_ws(' ', name || ' is a ' || lower(segment) || ' product.',
           'Category: ' || category || '.', 'Type: ' || type || '.',
           'Franchise: ' || franchise || '.', 'Recommended minimum age: ' || min_age || '.',
           CASE WHEN popularity_global >= 0.8 THEN 'This product is very popular.'
                WHEN popularity_global >= 0.4 THEN 'This product has moderate popularity.'
                ELSE 'This product has lower popularity.' END) AS text_blob
  FROM shares)
"""

EDGES = """
basket AS (
  SELECT DISTINCT l_orderkey, product_id
  FROM lineitem JOIN products ON source_key = l_partkey),
edges AS (
  SELECT x.product_id AS product_id_1, y.product_id AS product_id_2,
         count(*) AS cooccurrence_count
  FROM basket x JOIN basket y
    ON x.l_orderkey = y.l_orderkey AND x.product_id < y.product_id
  GROUP BY 1, 2),
both_ways AS (
  SELECT * FROM edges
  UNION ALL SELECT product_id_2, product_id_1, cooccurrence_count FROM edges)
"""

TYPE_CELLS = """
type_basket AS (
  SELECT DISTINCT l_orderkey, p_type FROM lineitem JOIN part ON p_partkey = l_partkey),
alone AS (
  SELECT min(p_type) AS t FROM type_basket GROUP BY l_orderkey HAVING count(*) = 1),
cells AS (
  SELECT x.p_type AS product_1, y.p_type AS product_2, count(*) AS count
  FROM type_basket x JOIN type_basket y
    ON x.l_orderkey = y.l_orderkey AND x.p_type <> y.p_type
  GROUP BY 1, 2
  UNION ALL SELECT t, t, count(*) FROM alone GROUP BY 1)
"""

REQUESTS = """
requests AS (
  SELECT c_custkey AS request_id,
         CASE WHEN c_custkey % 10 = 0 THEN 'unrelated' WHEN c_custkey % 10 = 1 THEN 'greeting'
              WHEN c_custkey % 2 = 0 THEN 'search_product'
              ELSE 'recommendation' END AS intent_type,
         CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 18)::INT END AS max_age,
         CASE c_custkey % 4 WHEN 0 THEN 'store_a' WHEN 1 THEN 'store_b'
                            WHEN 2 THEN 'store_c' END AS store,
         CASE c_custkey % 6 WHEN 1 THEN 'Console' WHEN 2 THEN 'Accessories'
                            ELSE 'Games' END AS wanted_segment,
         CASE WHEN c_custkey % 3 = 0 THEN 'Brand#' || (c_custkey % 25 + 1) END AS excluded,
         upper(p_name || ' #' || p_partkey) AS mentioned
  FROM customer
  JOIN part ON p_partkey = (c_custkey * 13 + 5) % (SELECT count(*) FROM part))
"""

MEETS = """
  p.segment = r.wanted_segment
  AND (r.max_age IS NULL OR p.min_age <= r.max_age)
  AND (r.excluded IS NULL OR p.franchise <> r.excluded)
  AND (r.store IS NULL OR CASE r.store WHEN 'store_a' THEN p.store_a
        WHEN 'store_b' THEN p.store_b ELSE p.store_c END > 0)
"""

SEARCHED = f"""
searched AS (
  SELECT r.request_id, p.*, row_number() OVER (
           PARTITION BY r.request_id
           ORDER BY CASE r.store WHEN 'store_a' THEN p.store_a WHEN 'store_b' THEN p.store_b
                                 WHEN 'store_c' THEN p.store_c ELSE 0 END DESC,
                    p.popularity_global DESC, p.product_id) AS rank
  FROM requests r JOIN products p ON {MEETS}
  WHERE r.intent_type IN ('search_product', 'recommendation'))
"""

SEARCH_COLUMNS = (
    "product_id, name, segment, category, type, franchise, min_age, popularity_global, text_blob"
)
DETAIL_COLUMNS = (
    "product_id, name, segment, category, type, franchise, min_age, popularity_global, "
    "times_sold, store_a, store_b, store_c, text_blob"
)
NEIGHBOR_COLUMNS = "product_id, name, segment, franchise, min_age, popularity_global"

LOGS = """
logs AS (
  SELECT event_id AS log_id, ts AS timestamp, user_id::VARCHAR AS session_id,
         event_type || ' ' || (props::JSON->>'$.k') AS query, event_type AS intent_type,
         CASE event_id % 4 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['search_products']
              WHEN 2 THEN ['search_products', 'get_product_details']
              ELSE ['get_product_by_name_fuzzy'] END AS tools_called,
         event_id % 8 = 0 AS used_fallback, (event_id % 11)::INT AS products_returned,
         value * 10 AS response_time_ms, (50 + event_id % 500)::INT AS llm_tokens_used,
         event_type <> 'error' AS success
  FROM events),
feedback AS (
  SELECT ts AS timestamp, user_id::VARCHAR AS session_id, event_id AS product_id, 1 AS hours,
         (1 + event_id % 6)::INT AS rating FROM events
  UNION ALL
  SELECT ts, user_id::VARCHAR, event_id, 2, (1 + event_id % 7)::INT FROM events),
rated AS (
  SELECT logs.*, f.rating AS user_feedback, f.product_id AS user_clicked_product
  FROM logs LEFT JOIN (
    SELECT timestamp, session_id, arg_max(rating, hours) AS rating,
           arg_max(product_id, hours) AS product_id
    FROM feedback WHERE rating BETWEEN 1 AND 5 GROUP BY 1, 2) f USING (timestamp, session_id))
"""


def performance_sql(by: str) -> str:
    return f"""WITH {LOGS}
    SELECT {by}, count(*) AS queries, round(avg(response_time_ms), 6) AS avg_latency,
           round(avg(products_returned), 6) AS avg_results,
           round(avg(CASE WHEN success THEN 1 ELSE 0 END), 6) AS success_rate
    FROM logs GROUP BY 1"""


def ranked_neighbors(edges: str) -> str:
    return f"""
    ranked AS (
      SELECT product_id_1, product_id_2, cooccurrence_count,
             row_number() OVER (PARTITION BY product_id_1
                                ORDER BY cooccurrence_count DESC, product_id_2) AS rank
      FROM {edges})"""


def neighbors_sql(edges: str) -> str:
    columns = ", ".join(f"p.{c.strip()}" for c in NEIGHBOR_COLUMNS.split(","))
    return f"""WITH {PRODUCTS}, {EDGES}, {ranked_neighbors(edges)}
    SELECT product_id_1, rank::INT AS rank, {columns}, cooccurrence_count
    FROM ranked JOIN products p ON p.product_id = product_id_2 WHERE rank <= 5"""


def one_neighbor_sql(product: int, limit: int) -> str:
    columns = ", ".join(f"p.{c.strip()}" for c in NEIGHBOR_COLUMNS.split(","))
    return f"""WITH {PRODUCTS}, {EDGES}
    SELECT {columns}, cooccurrence_count
    FROM edges JOIN products p ON p.product_id = product_id_2 WHERE product_id_1 = {product}
    ORDER BY cooccurrence_count DESC, p.product_id LIMIT {limit}"""


PATH_TEXT = """(SELECT string_agg(above_name, ' > ' ORDER BY step) FROM up WHERE up.id = p.id)"""

LOG_DAYS = f"""WITH {LOGS}
  SELECT strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS queries,
         sum(llm_tokens_used)::BIGINT AS tokens
  FROM logs GROUP BY 1"""

WINDOW_METRICS = f"""WITH {LOGS}
SELECT strftime(date_trunc('hour', timestamp), '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(date_trunc('hour', timestamp) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S')
         AS window_end,
       intent_type, count(*) AS queries, round(avg(success::INT), 6) AS success_rate,
       round(avg(response_time_ms), 6) AS avg_latency
FROM logs GROUP BY 1, 2, 3"""

ORACLE_SQL = {
    "normalize_text": """
        SELECT conv_id, turn, trim(lower(strip_accents(text)), chr(32) || chr(9) || chr(10) || chr(13)) AS folded,
               text IS NULL OR trim(text) = '' AS blank
        FROM conversations""",
    "normalize_documents": """
        SELECT doc_id, trim(lower(strip_accents(text)), chr(32) || chr(9) || chr(10) || chr(13)) AS folded
        FROM documents""",
    "hierarchy_ancestors": f"""WITH RECURSIVE {TREE}
        SELECT p.id, name, admin_level, parent_id, {PATH_TEXT} AS path_text,
               (SELECT count(*) FROM up WHERE up.id = p.id)::INT AS depth
        FROM places p""",
    "hierarchy_from_json": f"""WITH RECURSIVE {TREE},
        numbered AS (SELECT id, row_number() OVER (ORDER BY ord) - 1 AS preorder FROM places)
        SELECT n.preorder AS id, name, admin_level, above.preorder AS parent_id,
               {PATH_TEXT} AS path_text
        FROM places p JOIN numbered n ON n.id = p.id
        LEFT JOIN numbered above ON above.id = p.parent_id""",
    "hierarchy_stats_totals": f"""WITH RECURSIVE {TREE}
        SELECT count(*) AS total_locations, count(DISTINCT name) AS unique_cities,
               (SELECT count(*) FROM (SELECT DISTINCT p.name, above_name
                FROM places p JOIN up ON up.id = p.id AND step > 0)) AS unique_city_state_pairs
        FROM places""",
    "hierarchy_stats_levels": f"""WITH RECURSIVE {TREE}
        SELECT admin_level, count(*) AS locations FROM places GROUP BY 1""",
    "hierarchy_children": f"""WITH RECURSIVE {TREE}
        SELECT parent_id AS id, count(*) AS children FROM places
        WHERE parent_id IS NOT NULL GROUP BY 1""",
    "hierarchy_primary_state": f"""WITH RECURSIVE {TREE}
        SELECT p.id, coalesce(
          (SELECT arg_min(above_name, step) FROM up WHERE up.id = p.id AND above_level IN (4, 6)),
          (SELECT arg_min(above_name, step) FROM up WHERE up.id = p.id AND above_level = 7)
        ) AS state FROM places p""",
    "hierarchy_named": f"""WITH RECURSIVE {TREE}
        SELECT p.id, name, {PATH_TEXT} AS path_text FROM places p WHERE name = 'building'""",
    "geo_resolve": f"""WITH RECURSIVE {TREE},
        asked AS (
          SELECT c_custkey, c_mktsegment AS city,
                 CASE WHEN c_custkey % 2 = 0 THEN n_name END AS state
          FROM customer JOIN nation ON c_nationkey = n_nationkey),
        exact AS (
          SELECT p.name, above_name, count(DISTINCT p.id) AS n, arg_min(p.id, ord) AS first_id
          FROM places p JOIN up ON up.id = p.id AND step > 0 GROUP BY 1, 2),
        named AS (
          SELECT name, count(*) AS n, arg_min(id, ord) AS first_id FROM places GROUP BY 1)
        SELECT c_custkey, city, state, coalesce(e.n, d.n, 0) AS n,
               coalesce(e.first_id, d.first_id) AS first_id
        FROM asked LEFT JOIN exact e ON e.name = lower(city) AND above_name = lower(state)
        LEFT JOIN named d ON d.name = lower(city)""",
    "geo_match_levels": match_sql(),
    "geo_match_stream": match_sql(),
    "geo_match_best": match_sql(best=True),
    "geo_match_strict": match_sql(strict=True),
    "geo_match_country": match_sql(country=True),
    "geo_containment": f"""WITH RECURSIVE {TREE}
        SELECT p.id AS inner_id, p.name AS inner_name, above AS outer_id,
               above_name AS outer_name, above_level AS outer_level
        FROM places p JOIN up ON up.id = p.id AND step > 0""",
    "geo_fuzzy": f"""WITH RECURSIVE {TREE}, {MISSPELLED},
        names AS (SELECT DISTINCT name FROM places),
        fixes AS (
          SELECT typo, arg_min(name, (levenshtein(typo, name), name)) AS nearest
          FROM (SELECT DISTINCT lower(city) AS typo FROM asked) t JOIN names
            ON levenshtein(typo, name) <= 1
          WHERE typo NOT IN (SELECT name FROM names) GROUP BY 1),
        fixed AS (
          SELECT asked.*, nearest, coalesce(nearest, lower(city)) AS known
          FROM asked LEFT JOIN fixes ON typo = lower(city)),
        exact AS (
          SELECT p.name, above_name, count(DISTINCT p.id) AS n, arg_min(p.id, ord) AS first_id
          FROM places p JOIN up ON up.id = p.id AND step > 0 GROUP BY 1, 2),
        named AS (
          SELECT name, count(*) AS n, arg_min(id, ord) AS first_id FROM places GROUP BY 1)
        SELECT c_custkey, city, nearest AS corrected_city, coalesce(e.n, d.n, 0) AS n,
               coalesce(e.first_id, d.first_id) AS first_id
        FROM fixed LEFT JOIN exact e ON e.name = known AND above_name = state
        LEFT JOIN named d ON d.name = known""",
    "geo_fuzzy_far": f"""WITH RECURSIVE {TREE}, {MISSPELLED_PLACES},
        names AS (SELECT DISTINCT name FROM places),
        fixes AS (
          SELECT typo, arg_min(name, (levenshtein(typo, name), name)) AS nearest
          FROM (SELECT DISTINCT lower(city) AS typo FROM asked) t JOIN names
            ON levenshtein(typo, name) <= 2
          WHERE typo NOT IN (SELECT name FROM names) GROUP BY 1),
        fixed AS (
          SELECT asked.*, nearest, coalesce(nearest, lower(city)) AS known
          FROM asked LEFT JOIN fixes ON typo = lower(city)),
        exact AS (
          SELECT p.name, above_name, count(DISTINCT p.id) AS n, arg_min(p.id, ord) AS first_id
          FROM places p JOIN up ON up.id = p.id AND step > 0 GROUP BY 1, 2),
        named AS (
          SELECT name, count(*) AS n, arg_min(id, ord) AS first_id FROM places GROUP BY 1)
        SELECT c_custkey, city, nearest AS corrected_city, coalesce(e.n, d.n, 0) AS n,
               coalesce(e.first_id, d.first_id) AS first_id
        FROM fixed LEFT JOIN exact e ON e.name = known AND above_name = lower(state)
        LEFT JOIN named d ON d.name = known""",
    "geo_fuzzy_country": f"""WITH RECURSIVE {COUNTRY_TREE}, {MISSPELLED_PLACES},
        exact AS (
          SELECT p.country, p.name, above_name AS state, count(DISTINCT p.id) AS n, arg_min(p.id, ord) AS first_id
          FROM places p JOIN up ON up.id = p.id AND step > 0 GROUP BY 1, 2, 3),
        named AS (
          SELECT country, name, count(*) AS n, arg_min(id, ord) AS first_id FROM places GROUP BY 1, 2),
        keys AS (
          SELECT DISTINCT lower(country) AS land, lower(city) AS typo, lower(state) AS region FROM asked),
        single AS (
          SELECT land, typo, arg_min(name, (levenshtein(typo, name), name)) AS nearest
          FROM (SELECT DISTINCT land, typo FROM keys) k JOIN named ON country = land AND levenshtein(typo, name) <= 2
          GROUP BY 1, 2),
        pairs AS (
          SELECT land, typo, region, arg_min(struct_pack(city := name, state := state),
                 (levenshtein(typo, name) + levenshtein(region, state), levenshtein(typo, name), name, state)) AS best
          FROM keys JOIN exact ON country = land AND levenshtein(typo, name) <= 2 AND levenshtein(region, state) <= 2
          GROUP BY 1, 2, 3),
        fixed AS (
          SELECT c_custkey, land, typo, region, coalesce(p.best.city, s.nearest, typo) AS city_now,
                 coalesce(p.best.state, region) AS state_now
          FROM (SELECT *, lower(country) AS land, lower(city) AS typo, lower(state) AS region FROM asked)
          LEFT JOIN single s USING (land, typo)
          LEFT JOIN pairs p USING (land, typo, region))
        SELECT c_custkey, CASE WHEN city_now <> typo THEN city_now END AS corrected_city,
               CASE WHEN state_now <> region THEN state_now END AS corrected_state,
               coalesce(e.n, d.n, 0) AS n, coalesce(e.first_id, d.first_id) AS first_id
        FROM fixed LEFT JOIN exact e ON e.country = land AND e.name = city_now AND e.state = state_now
        LEFT JOIN named d ON d.country = land AND d.name = city_now""",
    "catalog_products": f"WITH {PRODUCTS} SELECT * FROM products",
    "catalog_raw_tables": f"""WITH {TYPE_CELLS}
        SELECT 'products_raw' AS name, count(*) AS rows, sum(p_partkey)::BIGINT AS total FROM part
        UNION ALL SELECT 'product_solo_sales_raw', count(*), sum(count)::BIGINT FROM cells
        WHERE product_1 = product_2
        UNION ALL SELECT 'product_cooccurrence_raw', count(*), sum(count)::BIGINT FROM cells
        WHERE product_1 <> product_2""",
    "catalog_missing_columns": f"""WITH {PRODUCTS}
        SELECT source_key, name, 0::BIGINT AS store_c, NULL::VARCHAR AS franchise,
               0::INT AS min_age FROM raw_products""",
    "catalog_from_json": f"""WITH {PRODUCTS}
        SELECT segment, name, nullif(release_date, 'n/a') AS release_date,
               times_sold::DOUBLE AS times_sold, store_a::DOUBLE AS store_a,
               store_b::DOUBLE AS store_b, store_c::DOUBLE AS store_c, type, category, franchise,
               min_age::DOUBLE AS min_age
        FROM raw_products""",
    "catalog_extra_keys": f"""WITH {PRODUCTS}
        SELECT name, times_sold::DOUBLE AS times_sold,
               CASE WHEN source_key % 2 = 1 THEN source_key::VARCHAR END AS part_key
        FROM raw_products""",
    "catalog_published": f"""WITH {PRODUCTS}, {EDGES},
        alone AS (SELECT min(product_id) AS product_id FROM basket GROUP BY l_orderkey
                  HAVING count(*) = 1)
        SELECT p.product_id, p.name, coalesce(f.num_neighbors, 0) AS num_neighbors,
               coalesce(f.total, 0)::BIGINT AS total_cooccurrence, s.solo_sales
        FROM products p
        JOIN (SELECT product_id, count(*) AS solo_sales FROM alone GROUP BY 1) s
          ON s.product_id = p.product_id
        LEFT JOIN (SELECT product_id_1, count(*) AS num_neighbors,
                          sum(cooccurrence_count) AS total FROM edges GROUP BY 1) f
          ON f.product_id_1 = p.product_id""",
    "catalog_share": f"""WITH {PRODUCTS}
        SELECT segment, count(*) AS products,
               count(*) / (SELECT count(*) FROM products WHERE min_age <= 12) AS share
        FROM products WHERE min_age <= 12 GROUP BY 1""",
    "catalog_share_sets": f"""WITH {PRODUCTS},
        base AS (SELECT segment, category, count(*) AS n FROM products GROUP BY 1, 2),
        whole AS (SELECT sum(n) AS total FROM base)
        SELECT b.segment, category, 0 AS grouping_id, n AS products, round(n / s.total, 6) AS share
        FROM base b JOIN (SELECT segment, sum(n) AS total FROM base GROUP BY 1) s
          ON s.segment IS NOT DISTINCT FROM b.segment
        UNION ALL
        SELECT segment, NULL, 1, sum(n)::BIGINT, round(sum(n) / any_value(total), 6) FROM base, whole GROUP BY 1
        UNION ALL
        SELECT NULL, category, 2, sum(n)::BIGINT, round(sum(n) / any_value(total), 6) FROM base, whole GROUP BY 2
        UNION ALL
        SELECT NULL, NULL, 3, sum(n)::BIGINT, round(sum(n) / any_value(total), 6) FROM base, whole""",
    "store_keys": f"WITH {REQUESTS} SELECT request_id, store FROM requests",
    "matrix_from_file": f"WITH {TYPE_CELLS} SELECT * FROM cells",
    "matrix_long": f"WITH {TYPE_CELLS} SELECT * FROM cells",
    "solo_sales": f"""WITH {TYPE_CELLS}
        SELECT product_1 AS product_name, count AS solo_sales FROM cells
        WHERE product_1 = product_2""",
    "undirected_edges": f"""WITH {TYPE_CELLS}
        SELECT least(product_1, product_2) AS product_1, greatest(product_1, product_2)
               AS product_2, sum(count)::BIGINT AS count
        FROM cells WHERE product_1 <> product_2 GROUP BY 1, 2""",
    "undirected_edges_upper": f"""WITH {TYPE_CELLS}
        SELECT product_1, product_2, count FROM cells WHERE product_1 < product_2""",
    "cooccurrence_baskets": """
        WITH b AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
        SELECT x.l_partkey AS item_1, y.l_partkey AS item_2, count(*) AS count
        FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey
        GROUP BY 1, 2""",
    "solo_baskets": """
        WITH b AS (SELECT min(l_partkey) AS item FROM lineitem GROUP BY l_orderkey
                   HAVING count(DISTINCT l_partkey) = 1)
        SELECT item, count(*) AS solo_sales FROM b GROUP BY 1""",
    "cooccurrence_ids": f"WITH {PRODUCTS}, {EDGES} SELECT * FROM edges",
    "solo_sales_ids": f"""WITH {PRODUCTS}, {EDGES},
        alone AS (SELECT min(product_id) AS product_id FROM basket GROUP BY l_orderkey
                  HAVING count(*) = 1)
        SELECT product_id, count(*) AS solo_sales FROM alone GROUP BY 1""",
    "graph_features": f"""WITH {PRODUCTS}, {EDGES}
        SELECT product_id, count(product_id_1) AS num_neighbors,
               coalesce(sum(cooccurrence_count), 0)::BIGINT AS total_cooccurrence
        FROM products LEFT JOIN edges ON product_id_1 = product_id GROUP BY 1""",
    "graph_features_symmetric": f"""WITH {PRODUCTS}, {EDGES}
        SELECT product_id, count(product_id_1) AS num_neighbors,
               coalesce(sum(cooccurrence_count), 0)::BIGINT AS total_cooccurrence
        FROM products LEFT JOIN both_ways ON product_id_1 = product_id GROUP BY 1""",
    "search_products_plain": f"""WITH {PRODUCTS}
        SELECT {SEARCH_COLUMNS} FROM products WHERE segment = 'Games'
        ORDER BY popularity_global DESC, product_id LIMIT 10""",
    "search_products_store": f"""WITH {PRODUCTS}
        SELECT {SEARCH_COLUMNS} FROM products
        WHERE segment = 'Games' AND min_age <= 7 AND store_a > 0
        ORDER BY store_a DESC, popularity_global DESC, product_id LIMIT 3""",
    "search_products_exclude": f"""WITH {PRODUCTS}
        SELECT {SEARCH_COLUMNS} FROM products
        WHERE segment = 'Console' AND min_age <= 12 AND store_b > 0 AND franchise <> 'Brand#3'
        ORDER BY store_b DESC, popularity_global DESC, product_id LIMIT 10""",
    "product_details": f"""WITH {PRODUCTS}
        SELECT {DETAIL_COLUMNS} FROM products WHERE product_id = 1""",
    "product_details_by_name": f"""WITH {PRODUCTS}
        SELECT {DETAIL_COLUMNS} FROM products WHERE lower(name) = 'red widget #1'
        ORDER BY product_id LIMIT 1""",
    "product_details_batch": f"""WITH {PRODUCTS}, {REQUESTS},
        asked AS (
          SELECT request_id, mentioned, CASE request_id % 3
                 WHEN 0 THEN request_id % (SELECT count(*) FROM part) + 1 WHEN 1 THEN 0 END AS pid
          FROM requests)
        SELECT request_id, {DETAIL_COLUMNS} FROM asked JOIN products
          ON CASE WHEN coalesce(pid, 0) <> 0 THEN product_id = pid
                  ELSE lower(name) = lower(mentioned) END""",
    "neighbors_single": one_neighbor_sql(1, 3),
    "similar_products": one_neighbor_sql(2, 5),
    "neighbors_topk": neighbors_sql("edges"),
    "neighbors_topk_symmetric": neighbors_sql("both_ways"),
    "product_fuzzy": f"""WITH {PRODUCTS}
        SELECT {NEIGHBOR_COLUMNS} FROM products WHERE name ILIKE '%Widget%'
        ORDER BY popularity_global DESC, product_id LIMIT 3""",
    "product_fuzzy_wildcard": f"""WITH {PRODUCTS}
        SELECT {NEIGHBOR_COLUMNS} FROM products WHERE name ILIKE '%RED%1_%'
        ORDER BY popularity_global DESC, product_id LIMIT 5""",
    "product_fuzzy_batch": f"""WITH {PRODUCTS}, {REQUESTS},
        found AS (
          SELECT term, product_id, row_number() OVER (
                   PARTITION BY term ORDER BY popularity_global DESC, product_id) AS rank
          FROM (SELECT DISTINCT mentioned AS term FROM requests)
          JOIN products ON contains(lower(name), lower(term)))
        SELECT term, rank::INT AS rank, product_id FROM found WHERE rank <= 5""",
    "product_fuzzy_batch_wildcard": f"""WITH {PRODUCTS}, {REQUESTS},
        found AS (
          SELECT term, product_id, row_number() OVER (
                   PARTITION BY term ORDER BY popularity_global DESC, product_id) AS rank
          FROM (SELECT DISTINCT mentioned[:2] || '%' || mentioned[-1:] || '_' AS term FROM requests
                WHERE mentioned IS NOT NULL)
          JOIN products ON lower(name) LIKE '%' || lower(term) || '%')
        SELECT term, rank::INT AS rank, product_id FROM found WHERE rank <= 5""",
    "product_fuzzy_published": f"""WITH {PRODUCTS},
        found AS (
          SELECT term, product_id, row_number() OVER (
                   PARTITION BY term ORDER BY popularity_global DESC, product_id) AS rank
          FROM (SELECT DISTINCT substr(name, (source_key % 9)::INT + 1, (source_key % 6)::INT) AS term FROM products)
          JOIN products ON contains(lower(name), lower(term)))
        SELECT term, rank::INT AS rank, product_id FROM found WHERE rank <= 5""",
    "batch_search": f"""WITH {PRODUCTS}, {REQUESTS}, {SEARCHED}
        SELECT request_id, rank::INT AS rank, {SEARCH_COLUMNS} FROM searched WHERE rank <= 5""",
    "request_messages": f"""WITH {REQUESTS}
        SELECT request_id, intent_type, CASE intent_type
          WHEN 'unrelated' THEN 'I can only help with Nintendo Switch products.'
          ELSE 'Hello! How can I help you with Nintendo Switch games today?' END AS message
        FROM requests WHERE intent_type IN ('unrelated', 'greeting')""",
    "filter_by_constraints": f"""WITH {PRODUCTS}, {REQUESTS},
        candidates AS (
          SELECT DISTINCT c_custkey AS request_id,
                 (c_custkey * 7 + step * 11) % (SELECT count(*) FROM part) + 1 AS product_id
          FROM customer, range(5) t(step))
        SELECT c.request_id, c.product_id FROM candidates c
        JOIN requests r ON r.request_id = c.request_id
        JOIN products p ON p.product_id = c.product_id AND {MEETS}""",
    "recommend": f"""WITH {PRODUCTS}, {EDGES}, {REQUESTS}, {SEARCHED},
        {ranked_neighbors("edges")},
        meant AS (
          SELECT term, arg_min(product_id, (-popularity_global, product_id)) AS product_id
          FROM (SELECT DISTINCT mentioned AS term FROM requests)
          JOIN products ON contains(lower(name), lower(term)) GROUP BY 1),
        together AS (
          SELECT r.request_id, p.product_id, 0 AS tier, -n.cooccurrence_count::DOUBLE AS place
          FROM requests r JOIN meant ON term = mentioned
          JOIN ranked n ON n.product_id_1 = meant.product_id AND n.rank <= 5
          JOIN products p ON p.product_id = n.product_id_2 AND {MEETS}
          WHERE r.intent_type IN ('search_product', 'recommendation')),
        listed AS (
          SELECT request_id, product_id, min((tier, place)) AS best FROM (
            SELECT * FROM together
            UNION ALL SELECT request_id, product_id, 1, rank::DOUBLE FROM searched
            WHERE rank <= 5) GROUP BY 1, 2),
        final AS (
          SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY best, product_id) AS rank
          FROM listed)
        SELECT request_id, rank::INT AS rank, product_id,
               CASE best[1] WHEN 0 THEN 'bought together' ELSE 'search' END AS source
        FROM final WHERE rank <= 5""",
    "embedding_text": f"""WITH {PRODUCTS}, {EDGES}, {ranked_neighbors("edges")},
        top AS (
          SELECT product_id_1, string_agg(name, ', ' ORDER BY rank) AS companions
          FROM ranked JOIN products ON product_id = product_id_2 WHERE rank <= 3 GROUP BY 1)
        SELECT product_id, concat_ws('. ',
          name || ' (' || segment || ', ' || coalesce(franchise, '') || ')',
          'Frequently bought with: ' || companions,
          CASE WHEN min_age <= 7 THEN 'Popular with young children and families'
               WHEN min_age <= 12 THEN 'Popular with pre-teens' END) AS embedding_text
        FROM products LEFT JOIN top ON product_id_1 = product_id""",
    "similar_by_embedding": """
        WITH scored AS (
          SELECT a.vec_id, b.vec_id AS similar_id,
                 list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
          FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
          WHERE a.vec_id IN (0, 1, 2)),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, similar_id)
                 AS rank FROM scored)
        SELECT vec_id, similar_id, round(score, 6) AS similarity, rank::INT AS rank
        FROM ranked WHERE rank <= 5""",
    "similar_by_embedding_batch": """
        WITH scored AS (
          SELECT a.vec_id, b.vec_id AS similar_id,
                 list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
          FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
          WHERE a.vec_id % 10 = 0),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, similar_id)
                 AS rank FROM scored)
        SELECT vec_id, similar_id, round(score, 6) AS similarity, rank::INT AS rank
        FROM ranked WHERE rank <= 5""",
    "log_stats": f"""WITH {LOGS}
        SELECT count(*) AS total_queries, round(avg(success::INT), 6) AS success_rate,
               round(avg(response_time_ms), 6) AS avg_response_time_ms,
               round(avg(products_returned), 6) AS avg_products_returned,
               round(avg(used_fallback::INT), 6) AS fallback_rate
        FROM logs""",
    "tool_usage": f"""WITH {LOGS}
        SELECT tool, count(*) AS calls FROM (SELECT unnest(tools_called) AS tool FROM logs)
        GROUP BY 1""",
    "log_by_intent": performance_sql("intent_type"),
    "log_by_success": performance_sql("success"),
    "log_fallback_top": f"""WITH {LOGS}
        SELECT query, count(*) AS frequency FROM logs WHERE used_fallback GROUP BY 1
        ORDER BY 2 DESC, 1 LIMIT 20""",
    "log_failed_top": f"""WITH {LOGS}
        SELECT query, count(*) AS failures FROM logs WHERE NOT success GROUP BY 1
        ORDER BY 2 DESC, 1 LIMIT 20""",
    "log_percentiles": f"""WITH {LOGS}
        SELECT intent_type, round(quantile_cont(response_time_ms, 0.5), 6) AS p50,
               round(quantile_cont(response_time_ms, 0.95), 6) AS p95,
               round(quantile_cont(response_time_ms, 0.99), 6) AS p99
        FROM logs GROUP BY 1""",
    "log_intents": f"""WITH {LOGS}
        SELECT intent_type, count(*) AS queries,
               round(count(*) / (SELECT count(*) FROM logs), 6) AS share
        FROM logs GROUP BY 1""",
    "log_opportunities": f"""WITH {LOGS}
        SELECT split_part(query, ' ', 1) AS pattern, count(*) AS queries,
               round(count(*) / (SELECT count(*) FROM logs), 6) AS share
        FROM logs WHERE used_fallback GROUP BY 1
        HAVING count(*) / (SELECT count(*) FROM logs) >= 0.02""",
    "log_monthly_budget": f"""WITH {LOGS}
        SELECT strftime(timestamp, '%Y-%m') AS month, count(*) AS queries,
               sum(llm_tokens_used)::BIGINT AS tokens,
               count(*) FILTER (llm_tokens_used > 500) AS over_cap,
               round(sum(llm_tokens_used) * 0.2::DOUBLE / 1000, 6) AS cost_usd,
               sum(llm_tokens_used) * 0.2::DOUBLE / 1000 > 400 AS alert
        FROM logs GROUP BY 1""",
    "log_rollup_percentiles": f"""WITH {LOGS}
        SELECT intent_type, count(*) AS timed, true AS p50, true AS p95, true AS p99
        FROM logs WHERE response_time_ms IS NOT NULL GROUP BY 1""",
    "log_rollup_sessions": f"""WITH {LOGS}
        SELECT intent_type, count(DISTINCT session_id) AS sessions, true AS near FROM logs GROUP BY 1""",
    "log_rate_breaches": f"""WITH {LOGS},
        periods AS (
          SELECT session_id, 'minute' AS period, date_trunc('minute', timestamp) AS start,
                 count(*) AS calls FROM logs GROUP BY 1, 3
          UNION ALL
          SELECT session_id, 'day', date_trunc('day', timestamp), count(*) FROM logs
          GROUP BY 1, 3),
        limited AS (
          SELECT *, CASE WHEN session_id::BIGINT % 4 = 0
                         THEN CASE period WHEN 'minute' THEN 10 ELSE 6 END
                         ELSE CASE period WHEN 'minute' THEN 1 ELSE 3 END END AS allowed
          FROM periods)
        SELECT session_id, period, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, calls, allowed
        FROM limited WHERE calls > allowed""",
    "log_latest": f"""WITH {LOGS}
        SELECT log_id, session_id, query, intent_type, success FROM logs
        ORDER BY timestamp DESC LIMIT 10""",
    "log_feedback_latest": f"""WITH {LOGS}
        SELECT log_id, session_id, user_feedback, user_clicked_product FROM rated""",
    "log_feedback_summary": f"""WITH {LOGS}
        SELECT intent_type, count(user_feedback) AS ratings,
               round(avg(user_feedback), 6) AS mean_rating
        FROM rated GROUP BY 1""",
    "log_feedback_rejected": f"""WITH {LOGS}
        SELECT rating, count(*) AS rows FROM feedback WHERE rating NOT BETWEEN 1 AND 5
        GROUP BY 1""",
    "log_tool_arguments": f"""WITH {LOGS},
        calls AS (
          SELECT log_id, unnest(tools_called) AS tool,
                 generate_subscripts(tools_called, 1) - 1 + len(tools_called) AS seq
          FROM logs)
        SELECT log_id, '{{' || string_agg('"' || tool || '":"limit=' || seq || '"', ',' ORDER BY tool)
               || '}}' AS arguments
        FROM calls GROUP BY 1""",
    "logs_json": f"""WITH {LOGS}
        SELECT log_id, CASE WHEN microsecond(timestamp) % 1000000 = 0
                 THEN strftime(timestamp, '%Y-%m-%dT%H:%M:%S')
                 ELSE strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') END AS timestamp,
               to_json(tools_called)::VARCHAR AS tools_called,
               '{{"intent":"' || intent_type || '"}}' AS tool_arguments
        FROM logs""",
    "validate_requests": """
        WITH asked AS (
          SELECT conv_id, turn,
                 CASE WHEN turn % 7 = 0 THEN text || ' drop it' ELSE text END AS query
          FROM conversations)
        SELECT conv_id, turn, CASE
          WHEN length(query) > 500 THEN 'too long'
          WHEN regexp_matches(upper(query), 'DROP|DELETE|UPDATE|ALTER|EXEC') THEN 'suspicious'
          END AS rejected_for
        FROM asked""",
    "logs_appended": LOG_DAYS,
    "logs_appended_stream": LOG_DAYS,
    "log_window_metrics": WINDOW_METRICS,
    "stream_log_metrics": WINDOW_METRICS,
}

# The rollup answers as the logs do.
ORACLE_SQL["log_rollup_stats"] = ORACLE_SQL["log_stats"]
ORACLE_SQL["log_rollup_by_intent"] = ORACLE_SQL["log_by_intent"]
ORACLE_SQL["log_rollup_budget"] = ORACLE_SQL["log_monthly_budget"]
# Maintained tables are those built from all baskets.
ORACLE_SQL["edges_maintained"] = ORACLE_SQL["cooccurrence_baskets"]
ORACLE_SQL["solo_maintained"] = ORACLE_SQL["solo_baskets"]
ORACLE_SQL["degrees_maintained"] = f"""
    SELECT item_1 AS item, count(*) AS num_neighbors, sum(count)::BIGINT AS total_cooccurrence
    FROM ({ORACLE_SQL["cooccurrence_baskets"]}) GROUP BY 1"""
ORACLE_SQL["logs_feedback_merged"] = ORACLE_SQL["log_feedback_latest"]
ORACLE_SQL["logs_once"] = ORACLE_SQL["logs_appended"]
ORACLE_SQL["stream_log_percentiles"] = f"""WITH {LOGS}
    SELECT strftime(date_trunc('day', timestamp), '%Y-%m-%d %H:%M:%S') AS window_start, intent_type,
           count(*) AS timed, true AS p50, true AS p95, true AS p99
    FROM logs WHERE response_time_ms IS NOT NULL GROUP BY 1, 2"""
ORACLE_SQL["stream_rate_breaches"] = f"""WITH {LOGS},
    numbered AS (
      SELECT session_id, timestamp::TIMESTAMP AS moment,
             lag(timestamp::TIMESTAMP, 1) OVER w AS minute_back, lag(timestamp::TIMESTAMP, 3) OVER w AS day_back
      FROM logs WINDOW w AS (PARTITION BY session_id ORDER BY timestamp))
    SELECT session_id AS "user", 'minute' AS period, strftime(moment, '%Y-%m-%d %H:%M:%S.%f') AS called,
           1::INT AS allowed
    FROM numbered WHERE moment - minute_back < INTERVAL 60 SECOND
    UNION ALL
    SELECT session_id, 'day', strftime(moment, '%Y-%m-%d %H:%M:%S.%f'), 3::INT FROM numbered
    WHERE moment - day_back < INTERVAL 24 HOUR"""
ORACLE_SQL["catalog_published_edges"] = f"""WITH {PRODUCTS}, {EDGES}
    SELECT p.product_id, e.product_id_2, e.cooccurrence_count
    FROM products p LEFT JOIN edges e ON e.product_id_1 = p.product_id"""
ORACLE_SQL["cooccurrence_ids_known"] = f"""WITH {PRODUCTS}, {EDGES}
    SELECT e.* FROM edges e
    JOIN products p ON p.product_id = e.product_id_1 AND p.source_key % 3 <> 0
    JOIN products q ON q.product_id = e.product_id_2 AND q.source_key % 3 <> 0"""
ORACLE_SQL["solo_sales_ids_known"] = f"""
    SELECT s.* FROM ({ORACLE_SQL["solo_sales_ids"]}) s
    JOIN (WITH {PRODUCTS} SELECT product_id AS known FROM products WHERE source_key % 3 <> 0) ON known = product_id"""
