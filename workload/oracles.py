"""DuckDB side: for each registered query the SQL whose result it must equal."""

from __future__ import annotations

from workload import inputs

DATASET = "ds"


def iid(category: str, key: str) -> str:
    """Issue id of a category and a key expression."""
    return f"'DQ-' || upper(substr(sha256('{DATASET}|{category}|' || {key}), 1, 16))"


def issue(
    category: str,
    key: str,
    severity: str,
    confidence: float,
    count: str,
    action: str = "'FLAG_ONLY'",
    column: str = "NULL",
    value: str = "NULL",
) -> str:
    """The select list of an issue."""
    return f"""{iid(category, key)} AS issue_id, '{category}' AS category, {severity} AS severity,
    'OPEN' AS status, {confidence}::DOUBLE AS confidence, {count} AS affected_row_count,
    {action} AS action_type, {column} AS target_column, {value} AS canonical_value"""


def missing(column: str, is_text: bool) -> str:
    return f"({column} IS NULL OR regexp_full_match({column}, '\\s*'))" if is_text else f"({column} IS NULL)"


SHARE = """CASE WHEN n * 100.0 / total > 50 THEN 'CRITICAL' WHEN n * 100.0 / total > 20 THEN 'HIGH'
    WHEN n * 100.0 / total > 5 THEN 'MEDIUM' ELSE 'LOW' END"""


def completeness(source: str, columns: dict[str, bool]) -> str:
    parts = [
        f"SELECT '{c}' AS c, count(*) FILTER (WHERE {missing(c, t)}) AS n, count(*) AS total FROM t"
        for c, t in columns.items()
    ]
    fields = issue("COMPLETENESS", "c", SHARE, 1.0, "n", column="c")
    return f"""WITH t AS ({source}), s AS ({' UNION ALL '.join(parts)})
    SELECT {fields} FROM s WHERE n > 0"""


LABELLED = {"doc_id": False, "lang": True, "source": True, "quality": False, "toxic": False}
BLANKS = {"p_name": True, "p_brand": True, "p_size": False, "p_type": True}

ORACLES: dict[str, str] = {}

# --- profile and row-wise checks ---------------------------------------------------------

ORACLES["profile_columns"] = f"WITH t AS ({inputs.BLANK_PARTS}) " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS "rows", count(*) - count({c}) AS nulls,
    count(*) > count({c}) AS nullable, count(DISTINCT {c}) AS unique_count,
    (SELECT string_agg(v, '|' ORDER BY k) FROM (SELECT CAST({c} AS VARCHAR) AS v, _row_id AS k
      FROM t WHERE {c} IS NOT NULL ORDER BY _row_id LIMIT 5)) AS samples FROM t"""
    for c in BLANKS
)
ORACLES["file_roundtrip"] = f"""SELECT _row_id AS row_id, CASE WHEN total_price <> 'n/a' THEN total_price END AS total_price,
    nullif(order_date, '') AS order_date, order_priority FROM ({inputs.ORDER_TEXTS})"""
ORACLES["row_numbers"] = """SELECT count(*) AS n, 0::BIGINT AS low, count(*) - 1 AS high, count(*) AS kinds,
    CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem"""
ORACLES["completeness_labels"] = completeness(inputs.LABELLED, LABELLED)
ORACLES["completeness_rows"] = f"WITH t AS ({inputs.LABELLED}) " + " UNION ALL ".join(
    f"SELECT {iid('COMPLETENESS', repr(c))} AS issue_id, _row_id AS row_id, 'target' AS role FROM t WHERE {missing(c, x)}"
    for c, x in LABELLED.items()
)
# Spark joins an array without its nulls.
ORACLES["completeness_blank"] = completeness(inputs.BLANK_PARTS, BLANKS).replace(
    "FROM s WHERE n > 0",
    """, coalesce(samples, '') AS samples FROM s LEFT JOIN (
      SELECT c AS sc, string_agg(v, '|' ORDER BY k) AS samples FROM (
        SELECT x.c AS c, _row_id AS k, CASE x.c WHEN 'p_name' THEN p_name WHEN 'p_brand' THEN p_brand END AS v,
          row_number() OVER (PARTITION BY x.c ORDER BY _row_id) AS r
        FROM t, (SELECT unnest(['p_name', 'p_brand', 'p_size']) AS c) x
        WHERE CASE x.c WHEN 'p_name' THEN p_name IS NULL OR trim(p_name) = ''
          WHEN 'p_brand' THEN trim(p_brand) = '' ELSE p_size IS NULL END) WHERE r <= 10 GROUP BY c
    ) ON sc = c WHERE n > 0""",
)
ORACLES["completeness_required"] = completeness(inputs.BLANK_PARTS, {"p_size": False})

DIRTY = """(total_price IS NOT NULL AND (regexp_matches(total_price, '[$€£¥,\\s]')
    OR (cleaned <> '' AND NOT regexp_matches(cleaned, '^-?\\d+(\\.\\d+)?$'))))"""
BAD_DATE = """(order_date IS NOT NULL AND NOT regexp_matches(trim(order_date),
    '^(\\d{4}-\\d{2}-\\d{2}|\\d{1,2}/\\d{1,2}/\\d{2,4}|\\d{1,2}-\\d{1,2}-\\d{2,4})$'))"""
ORDER_TEXTS = f"t AS (SELECT *, regexp_replace(total_price, '[$€£¥,\\s]', '', 'g') AS cleaned FROM ({inputs.ORDER_TEXTS}))"
_amount = issue("FORMAT_VALIDITY", "'total_price|amount'", "'MEDIUM'", 0.9, "count(*)", "'SET_VALUE'", "'total_price'", "'<stripped numeric>'")
_date = issue("FORMAT_VALIDITY", "'order_date|date'", "'MEDIUM'", 0.85, "count(*)", "'FLAG_ONLY'", "'order_date'")
ORACLES["format_validity"] = f"""WITH {ORDER_TEXTS}
    SELECT {_amount} FROM t WHERE {DIRTY} HAVING count(*) > 0
    UNION ALL SELECT {_date} FROM t WHERE {BAD_DATE} HAVING count(*) > 0"""
ORACLES["format_amount_rows"] = f"""WITH {ORDER_TEXTS} SELECT _row_id AS row_id, total_price, cleaned,
    try_cast(cleaned AS DOUBLE) AS amount FROM t WHERE {DIRTY}"""
ORACLES["format_date_rows"] = f"WITH {ORDER_TEXTS} SELECT _row_id AS row_id, order_date FROM t WHERE {BAD_DATE}"

_numeric = ["event_id", "user_id", "value"]
_z = f"WITH t AS ({inputs.EVENTS}), z AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS c, _row_id, abs(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()) AS z FROM t" for c in _numeric
) + ")"
ORACLES["outlier_events"] = f"""{_z} SELECT {issue("OUTLIER", "c", "'MEDIUM'", 0.8, "count(*)", column="c")}
    FROM z WHERE z > 3.0 GROUP BY c"""
ORACLES["outlier_rows"] = f"""{_z} SELECT {iid("OUTLIER", "c")} AS issue_id, _row_id AS row_id, 'target' AS role
    FROM z WHERE z > 3.0"""
ORACLES["column_moments"] = """SELECT count(value) AS n, round(avg(value), 6) AS mean,
    round(stddev_samp(value), 6) AS std FROM events"""
ORACLES["domain_rule"] = f"""
    SELECT {issue("DOMAIN_RULE", "'c_acctbal|Balance must not be negative.'", "'HIGH'", 1.0, "count(*)", column="'c_acctbal'")}
    FROM customer WHERE c_acctbal < 0 HAVING count(*) > 0
    UNION ALL
    SELECT {issue("DOMAIN_RULE", "'c_mktsegment|Segment is retired.'", "'MEDIUM'", 1.0, "count(*)", column="'c_mktsegment'")}
    FROM customer WHERE c_mktsegment = 'MACHINERY' HAVING count(*) > 0"""
ORACLES["domain_rule_fix"] = f"""SELECT {iid("DOMAIN_RULE", "'c_acctbal|No debt.'")} AS issue_id, c_custkey AS row_id,
    'target' AS role, 'SET_VALUE' AS action_type, '0' AS canonical_value FROM customer WHERE c_acctbal < 0"""

# --- grouped checks ----------------------------------------------------------------------

_dup = """WITH g AS (SELECT text, lang, count(*) AS n, min(doc_id) AS keep,
      sha256(length(text) || ':' || text || length(lang) || ':' || lang) AS digest
    FROM documents GROUP BY text, lang HAVING count(*) > 1)"""
ORACLES["uniqueness_documents"] = f"{_dup} SELECT {issue('UNIQUENESS', 'digest', chr(39) + 'HIGH' + chr(39), 1.0, 'n', chr(39) + 'MERGE_ROWS' + chr(39))} FROM g"
ORACLES["uniqueness_rows"] = f"""{_dup} SELECT {iid("UNIQUENESS", "digest")} AS issue_id, doc_id AS row_id,
    CASE WHEN doc_id = keep THEN 'retain' ELSE 'retire' END AS role
    FROM documents d JOIN g ON d.text = g.text AND d.lang = g.lang"""
ORACLES["ref_integrity"] = f"""SELECT {issue("REFERENTIAL_INTEGRITY", "'c_nationkey'", "'HIGH'", 1.0, "count(*)", column="'c_nationkey'")}
    FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 20) HAVING count(*) > 0"""
ORACLES["ref_integrity_rows"] = f"""SELECT {iid("REFERENTIAL_INTEGRITY", "'c_nationkey'")} AS issue_id,
    c_custkey AS row_id, 'target' AS role FROM customer WHERE c_nationkey >= 20"""
ORACLES["ref_orphans"] = """SELECT l_orderkey AS value, count(*) AS n FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0) GROUP BY l_orderkey"""
_c1 = issue("CONSISTENCY", "'p_name,p_brand|' || length(p_name) || ':' || p_name", "'HIGH'", 1.0, "count(*)", column="'p_brand'")
_k2 = "'p_brand,p_type,p_size|' || length(p_brand) || ':' || p_brand || length(p_type) || ':' || p_type"
_c2 = issue("CONSISTENCY", _k2, "'HIGH'", 1.0, "count(*)", column="'p_size'")
ORACLES["consistency_part"] = f"""
    SELECT {_c1} FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1
    UNION ALL SELECT {_c2} FROM part GROUP BY p_brand, p_type HAVING count(DISTINCT p_size) > 1"""
ORACLES["consistency_rows"] = f"""SELECT {iid("CONSISTENCY", _k2)} AS issue_id, p_partkey AS row_id, 'target' AS role
    FROM part SEMI JOIN (SELECT p_brand, p_type FROM part GROUP BY p_brand, p_type
      HAVING count(DISTINCT p_size) > 1) b USING (p_brand, p_type)"""

# --- fuzzy -------------------------------------------------------------------------------

_title = """array_to_string(list_transform(regexp_extract_all({x}, '[\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+|[^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+'),
    lambda r: CASE WHEN r[1:1] = 'ß' THEN 'Ss' ELSE upper(r[1:1]) END || lower(r[2:])), '')"""
_values = f"""v AS (SELECT p_name AS value, lower(trim(p_name)) AS norm, count(*) AS n, min(_row_id) AS first_row
      FROM ({inputs.MIXED_CASE_PARTS}) GROUP BY p_name),
    norms AS (SELECT norm, arg_max(value, first_row) AS rep, max(first_row) AS rep_first,
      list_sort(list_distinct(string_split(norm, ' '))) AS tokens FROM v GROUP BY norm)"""
_expand = """cand AS (SELECT na AS norm_a, nb AS norm_b, score FROM scored WHERE score >= 75
      UNION ALL SELECT nb, na, score FROM scored WHERE score >= 75
      UNION ALL SELECT norm, norm, 100.0 FROM norms),
    pairs AS (SELECT a.value AS a, b.value AS b, score, a.n AS n_a, b.n AS n_b, a.first_row AS first_a, b.first_row AS first_b
      FROM cand JOIN v a ON a.norm = norm_a JOIN norms ra ON ra.norm = norm_a
      JOIN norms rb ON rb.norm = norm_b JOIN v b ON b.value = rb.rep
      WHERE a.value <> b.value AND (a.value <> ra.rep OR a.first_row < b.first_row))"""
_fuzzy = f"""WITH RECURSIVE {_values},
    np AS (SELECT a.norm AS na, b.norm AS nb, list_sort(list_intersect(a.tokens, b.tokens)) AS common,
        array_to_string(list_filter(a.tokens, lambda t: NOT list_contains(b.tokens, t)), ' ') AS x,
        array_to_string(list_filter(b.tokens, lambda t: NOT list_contains(a.tokens, t)), ' ') AS y,
        CASE WHEN length(a.norm) <= length(b.norm) THEN a.norm ELSE b.norm END AS needle,
        CASE WHEN length(a.norm) <= length(b.norm) THEN b.norm ELSE a.norm END AS hay
      FROM norms a JOIN norms b ON a.norm < b.norm),
    sides AS (SELECT na, nb, needle, hay FROM np UNION ALL
      SELECT na, nb, hay, needle FROM np WHERE length(hay) = length(needle)),
    windows AS (
      SELECT na, nb, needle, substr(hay, i, length(needle)) AS w
        FROM sides, unnest(range(1, length(hay) - length(needle) + 2)) u(i)
      UNION ALL SELECT na, nb, needle, left(hay, i) FROM sides, unnest(range(1, length(needle))) u(i)
      UNION ALL SELECT na, nb, needle, right(hay, i) FROM sides, unnest(range(1, length(needle))) u(i)),
    jobs AS (SELECT DISTINCT needle AS p, w AS q FROM windows UNION SELECT x, y FROM np),
    dp AS (
      SELECT p, q, 0 AS j, list_transform(range(0, length(p) + 1), lambda i: 0::BIGINT) AS cells FROM jobs
      UNION ALL
      SELECT p, q, j + 1, list_prepend(0::BIGINT, list_transform(range(1, length(p) + 1), lambda i: list_max(steps[1:i])))
      FROM (SELECT p, q, j, list_transform(range(1, length(p) + 1), lambda i:
              CASE WHEN p[i:i] = q[j + 1:j + 1] THEN cells[i] + 1 ELSE cells[i + 1] END) AS steps
            FROM dp WHERE j < length(q))),
    lcs AS (SELECT p, q, list_max(cells) AS l FROM dp WHERE j = length(q)),
    partial AS (SELECT na, nb, max(200.0 * l / (length(needle) + length(w))) AS score
      FROM windows JOIN lcs ON p = needle AND q = w GROUP BY na, nb),
    tokens AS (SELECT na, nb, length(array_to_string(common, ' ')) AS s, CASE WHEN len(common) > 0 THEN 1 ELSE 0 END AS g,
        length(x) AS nx, length(y) AS ny, l FROM np JOIN lcs ON p = x AND q = y),
    token_set AS (SELECT na, nb, CASE WHEN s > 0 AND (nx = 0 OR ny = 0) THEN 100.0
        WHEN s > 0 THEN greatest(100.0 * (1 - (nx + ny - 2 * l) / (2.0 * (s + g) + nx + ny)),
          100.0 * (1 - (g + nx) / (2.0 * s + g + nx)), 100.0 * (1 - (g + ny) / (2.0 * s + g + ny)))
        ELSE 100.0 * (1 - (nx + ny - 2 * l) / (0.0 + nx + ny)) END AS score FROM tokens),
    scored AS (SELECT na, nb, greatest(p.score, t.score) AS score FROM partial p JOIN token_set t USING (na, nb)),
    {_expand}"""
_high = "score >= 88"
_form = _title.format(x="trim(CASE WHEN length(a) >= length(b) THEN a ELSE b END)")
ORACLES["fuzzy_dedup"] = f"""{_fuzzy} SELECT a, b, CASE WHEN {_high} THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
    round(score / 100, 4) AS confidence, CASE WHEN {_high} THEN 'MERGE_ROWS' ELSE 'FLAG_ONLY' END AS action_type,
    CASE WHEN {_high} THEN {_form} END AS canonical_value, n_a + n_b AS affected_row_count FROM pairs"""
ORACLES["fuzzy_rows"] = f"""{_fuzzy}, members AS (
      SELECT score, a AS value, first_a AS keep, true AS is_a FROM pairs UNION ALL SELECT score, b, NULL, false FROM pairs),
    roles AS (SELECT _row_id, CASE WHEN {_high} AND NOT is_a THEN 'retire' WHEN {_high} AND _row_id = keep THEN 'retain'
      ELSE 'target' END AS role FROM members JOIN ({inputs.MIXED_CASE_PARTS}) r ON r.p_name = value)
    SELECT role, count(*) AS n, count(DISTINCT _row_id) AS distinct_rows FROM roles GROUP BY role"""
ORACLES["fuzzy_exact_norm"] = f"""WITH {_values}, scored AS (SELECT NULL AS na, NULL AS nb, 0.0 AS score WHERE false), {_expand}
    SELECT a, b, n_a, n_b FROM pairs"""
ORACLES["canonical_form"] = "SELECT doc_id, " + _title.format(
    x="regexp_replace(regexp_replace(CASE WHEN length(text) >= length(source) THEN text ELSE source END, '^\\s+', ''), '\\s+$', '')"
) + " AS canonical FROM documents"
ORACLES["pair_dedup"] = """SELECT DISTINCT least(l_partkey, l_suppkey) AS low, greatest(l_partkey, l_suppkey) AS high FROM lineitem"""
ORACLES["topk_samples"] = """SELECT event_type, event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 5"""

# --- entity resolution -------------------------------------------------------------------

_suffix = "inc|incorporated|llc|ltd|limited|corp|corporation|co|company|lp|llp|plc|gmbh|ag|sa|sas|bv|nv|pty|pvt"


def _generic(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


_filled = " + ".join(
    f"CASE WHEN trim(coalesce({c}, '')) <> '' THEN 1 ELSE 0 END"
    for c in ("vendor_name", "address", "tax_id", "phone", "zip", "segment")
)
SIGNALS = f"""t AS ({inputs.VENDORS}),
    s AS (SELECT _row_id AS row_id, {_filled} AS filled,
      trim(regexp_replace({_generic('vendor_name')}, '\\b({_suffix})\\b$', '')) AS name,
      upper(regexp_replace(coalesce(tax_id, ''), '[\\s-]', '', 'g')) AS tax_id,
      {_generic('address')} AS address,
      left(regexp_replace(coalesce(zip, ''), '\\D', '', 'g'), 5) AS zip,
      right(regexp_replace(coalesce(phone, ''), '\\D', '', 'g'), 10) AS phone FROM t)"""
ORACLES["normalise_signals"] = f"WITH {SIGNALS} SELECT * FROM s"
_both = {c: f"(p.{c} <> '' AND q.{c} <> '')" for c in ("tax_id", "zip", "phone")}
_w = {"tax_id": 0.30, "zip": 0.08, "phone": 0.07}
_weight = " + ".join(f"CASE WHEN {_both[c]} THEN {_w[c]}::DOUBLE ELSE 0 END" for c in _w)
_agree = " + ".join(f"CASE WHEN {_both[c]} AND p.{c} = q.{c} THEN {_w[c]}::DOUBLE ELSE 0 END" for c in _w)
LINKS = f"""{SIGNALS}, prof AS (SELECT tax_id, zip, phone, count(*) AS n, min(row_id) AS rep FROM s
      WHERE tax_id <> '' OR zip <> '' OR phone <> '' GROUP BY tax_id, zip, phone),
    scored AS (SELECT p.rep AS a, q.rep AS b, p.n AS n_a, q.n AS n_b, {_agree} AS hit, {_weight} AS weight
      FROM prof p JOIN prof q ON p.rep < q.rep),
    links AS (SELECT a, b, n_a, n_b, round(hit / weight, 4) AS composite FROM scored
      WHERE weight > 0 AND round(hit / weight, 4) >= 0.72)"""
ORACLES["er_exact_signals"] = f"WITH {LINKS} SELECT * FROM links"
ORACLES["er_components"] = """SELECT c_custkey AS node, min(c_custkey) OVER (PARTITION BY c_nationkey) AS component
    FROM customer QUALIFY count(*) OVER (PARTITION BY c_nationkey) > 1"""
_members = f"{SIGNALS}, m AS (SELECT row_id, filled, row_id % 100000000 AS cluster FROM s)"
_elect = "e AS (SELECT cluster, arg_max(row_id, filled * 1000000000000 - row_id) AS retain_id, count(*) AS size FROM m GROUP BY cluster)"
ORACLES["er_elect"] = f"WITH {_members}, {_elect} SELECT * FROM e"
_cells = " UNION ALL ".join(
    f"SELECT _row_id AS row_id, '{c}' AS c, {c} AS v FROM t WHERE trim(coalesce({c}, '')) <> ''"
    for c in ("vendor_name", "address", "tax_id", "phone", "zip", "segment")
)
ORACLES["er_canonical"] = f"""WITH {_members}, {_elect}, cells AS ({_cells}),
    counted AS (SELECT cluster, c, v, max((row_id = retain_id)::INT) AS own, count(*) FILTER (WHERE row_id <> retain_id) AS n,
      coalesce(min(row_id) FILTER (WHERE row_id <> retain_id), 0) AS first
      FROM cells JOIN m USING (row_id) JOIN e USING (cluster) GROUP BY cluster, c, v)
    SELECT cluster, c AS "column", v AS value FROM counted
    QUALIFY row_number() OVER (PARTITION BY cluster, c ORDER BY own DESC, n DESC, first) = 1"""
_clusters = f"""WITH RECURSIVE {LINKS},
    edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (SELECT DISTINCT a AS node, a AS other FROM edges UNION SELECT node, b FROM reach JOIN edges ON other = a),
    label AS (SELECT node, min(other) AS cluster FROM reach GROUP BY node),
    owned AS (SELECT p.*, coalesce(l.cluster, CASE WHEN n > 1 THEN rep END) AS cluster FROM prof p LEFT JOIN label l ON node = rep),
    m AS (SELECT s.row_id, s.filled, o.cluster FROM s JOIN owned o USING (tax_id, zip, phone) WHERE o.cluster IS NOT NULL),
    best AS (SELECT cluster, max(c) AS confidence FROM (
        SELECT cluster, composite AS c FROM links JOIN owned ON a = rep UNION ALL SELECT cluster, 1.0 FROM owned WHERE n > 1)
      GROUP BY cluster),
    {_elect}, clusters AS (SELECT cluster, retain_id, size, confidence::DOUBLE AS confidence FROM e JOIN best USING (cluster))"""
ORACLES["er_exact_clusters"] = f"{_clusters} SELECT * FROM clusters"
ORACLES["er_exact_counters"] = f"""{_clusters} SELECT
    (SELECT count(*) * (count(*) - 1) // 2 FROM s) AS row_pairs,
    CAST((SELECT coalesce(sum(n_a * n_b), 0) FROM links) + (SELECT sum(n * (n - 1) // 2) FROM prof) AS BIGINT) AS links,
    count(*) AS clusters, count(*) FILTER (WHERE confidence >= 0.88) AS merge_clusters,
    count(*) FILTER (WHERE confidence < 0.88) AS review_clusters FROM clusters"""
ORACLES["er_issues"] = f"""{_clusters} SELECT {iid("DEDUPLICATION", "'entity|' || cluster")} AS issue_id,
    'DEDUPLICATION' AS category, CASE WHEN confidence >= 0.88 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, confidence,
    size AS affected_row_count, CASE WHEN confidence >= 0.88 THEN 'MERGE_ROWS' ELSE 'FLAG_ONLY' END AS action_type FROM clusters"""

# Every tenth customer has a twin that is written differently and a bare one, every other tenth a
# bare one: what the forms share is known from how they were made.
ORACLES["er_customers"] = """
WITH k AS (
  SELECT c_custkey AS id, c_custkey % 10 = 3 AS full_twin,
    substr(md5(c_custkey::VARCHAR), 1, 6) || ' ' || substr(md5(c_custkey::VARCHAR), 7, 7) AS name,
    lpad((c_custkey % 100)::VARCHAR, 2, '0') || lpad(c_custkey::VARCHAR, 7, '0') AS tax,
    lpad((c_custkey % 1000)::VARCHAR, 3, '0') || '555' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS phone,
    lpad((c_nationkey + 100)::VARCHAR, 5, '0') AS zip
  FROM customer WHERE c_custkey % 10 IN (3, 6)
)
SELECT id AS cluster, id AS retain_id, CASE WHEN full_twin THEN 3 ELSE 2 END::BIGINT AS size, 1.0::DOUBLE AS confidence,
  concat('Name similarity 100/100 (''', name, ''' ~ ''', name, ''')',
    CASE WHEN full_twin THEN concat('; Tax Id exact match: ''', tax, '''') END,
    '; Address similarity 100/100; Zip exact match: ''', zip, '''',
    CASE WHEN full_twin THEN concat('; Phone exact match: ''', phone, '''') END) AS evidence_summary
FROM k
"""

# All scores from the definitions: LCS of every window by dynamic programming.
_signals = f"""t AS ({inputs.SUPPLIER_VENDORS}),
    s AS (SELECT _row_id AS id, trim(regexp_replace({_generic('vendor_name')}, '\\b({_suffix})\\b$', '')) AS name,
      upper(regexp_replace(coalesce(tax_id, ''), '[\\s-]', '', 'g')) AS tax_id, {_generic('address')} AS address,
      left(regexp_replace(coalesce(zip, ''), '\\D', '', 'g'), 5) AS zip,
      right(regexp_replace(coalesce(phone, ''), '\\D', '', 'g'), 10) AS phone,
      {" + ".join(f"CASE WHEN trim(coalesce({c}, '')) <> '' THEN 1 ELSE 0 END" for c in ("vendor_name", "address", "tax_id", "phone", "zip"))} AS filled
      FROM t)"""
_five = ("name", "tax_id", "address", "zip", "phone")
_share = {"name": 0.40, "tax_id": 0.30, "address": 0.15, "zip": 0.08, "phone": 0.07}
_known = {c: f"(a.{c} <> '' AND b.{c} <> '')" for c in _five}
_all = " + ".join(f"CASE WHEN {_known[c]} THEN {_share[c]}::DOUBLE ELSE 0 END" for c in _five)
_equal = " + ".join(f"CASE WHEN {_known[c]} AND a.{c} = b.{c} THEN {_share[c]}::DOUBLE ELSE 0 END" for c in ("tax_id", "zip", "phone"))
_resolved = f"""WITH RECURSIVE {_signals},
    -- Two records that differ in the tax id score 0.7 at most; rows of one supplier may still meet in a cluster.
    pairs AS (SELECT a.id AS ia, b.id AS ib, {_equal} AS equal, {_all} AS weight, {", ".join(f"a.{c} AS a_{c}, b.{c} AS b_{c}" for c in _five)}
      FROM s a JOIN s b ON a.id < b.id
      WHERE a.tax_id = '' OR b.tax_id = '' OR a.tax_id = b.tax_id OR a.id % 100000000 = b.id % 100000000),
    texts AS (SELECT x, y, bool_or(named) AS named, list_sort(list_distinct(string_split(x, ' '))) AS tx, list_sort(list_distinct(string_split(y, ' '))) AS ty
      FROM (SELECT least(a_name, b_name) AS x, greatest(a_name, b_name) AS y, true AS named FROM pairs WHERE a_name <> '' AND b_name <> ''
        UNION ALL SELECT least(a_address, b_address), greatest(a_address, b_address), false FROM pairs WHERE a_address <> '' AND b_address <> '')
      WHERE x <> y GROUP BY x, y),
    np AS (SELECT x AS na, y AS nb, named, list_sort(list_intersect(tx, ty)) AS common,
        array_to_string(list_filter(tx, lambda t: NOT list_contains(ty, t)), ' ') AS x,
        array_to_string(list_filter(ty, lambda t: NOT list_contains(tx, t)), ' ') AS y,
        CASE WHEN length(na) <= length(nb) THEN na ELSE nb END AS needle, CASE WHEN length(na) <= length(nb) THEN nb ELSE na END AS hay
      FROM texts),
    sides AS (SELECT na, nb, needle, hay FROM np WHERE named UNION ALL
      SELECT na, nb, hay, needle FROM np WHERE named AND length(hay) = length(needle)),
    windows AS (
      SELECT na, nb, needle, substr(hay, i, length(needle)) AS w FROM sides, unnest(range(1, length(hay) - length(needle) + 2)) u(i)
      UNION ALL SELECT na, nb, needle, left(hay, i) FROM sides, unnest(range(1, length(needle))) u(i)
      UNION ALL SELECT na, nb, needle, right(hay, i) FROM sides, unnest(range(1, length(needle))) u(i)),
    jobs AS (SELECT DISTINCT needle AS p, w AS q FROM windows UNION SELECT x, y FROM np),
    dp AS (
      SELECT p, q, 0 AS j, list_transform(range(0, length(p) + 1), lambda i: 0::BIGINT) AS cells FROM jobs
      UNION ALL
      SELECT p, q, j + 1, list_prepend(0::BIGINT, list_transform(range(1, length(p) + 1), lambda i: list_max(steps[1:i])))
      FROM (SELECT p, q, j, list_transform(range(1, length(p) + 1), lambda i:
              CASE WHEN p[i:i] = q[j + 1:j + 1] THEN cells[i] + 1 ELSE cells[i + 1] END) AS steps, cells
            FROM dp WHERE j < length(q))),
    lcs AS (SELECT p, q, list_max(cells) AS l FROM dp WHERE j = length(q)),
    part AS (SELECT na, nb, max(200.0::DOUBLE * l / (length(needle) + length(w))) AS score
      FROM windows JOIN lcs ON p = needle AND q = w GROUP BY na, nb),
    tokens AS (SELECT na, nb, length(array_to_string(common, ' ')) AS s, CASE WHEN len(common) > 0 THEN 1 ELSE 0 END AS g,
        length(x) AS nx, length(y) AS ny, l FROM np JOIN lcs ON p = x AND q = y),
    sets AS (SELECT na, nb, CASE WHEN s > 0 AND (nx = 0 OR ny = 0) THEN 100.0::DOUBLE
        WHEN s > 0 THEN greatest(100.0::DOUBLE * (1 - (nx + ny - 2 * l)::DOUBLE / (2 * (s + g) + nx + ny)),
          100.0::DOUBLE * (1 - (g + nx)::DOUBLE / (2 * s + g + nx)), 100.0::DOUBLE * (1 - (g + ny)::DOUBLE / (2 * s + g + ny)))
        ELSE 100.0::DOUBLE * (1 - (nx + ny - 2 * l)::DOUBLE / (nx + ny)) END AS score FROM tokens),
    raw AS (SELECT p.*, CASE WHEN a_name = '' OR b_name = '' THEN NULL WHEN a_name = b_name THEN 100.0::DOUBLE
          ELSE greatest(n.score, m.score) END AS name_score,
        CASE WHEN a_address = '' OR b_address = '' THEN NULL WHEN a_address = b_address THEN 100.0::DOUBLE ELSE d.score END AS address_score
      FROM pairs p LEFT JOIN part n ON n.na = least(a_name, b_name) AND n.nb = greatest(a_name, b_name)
        LEFT JOIN sets m ON m.na = least(a_name, b_name) AND m.nb = greatest(a_name, b_name)
        LEFT JOIN sets d ON d.na = least(a_address, b_address) AND d.nb = greatest(a_address, b_address)),
    scored AS (SELECT *, round((equal + {_share['address']}::DOUBLE * coalesce(address_score, 0) / 100
        + {_share['name']}::DOUBLE * coalesce(name_score, 0) / 100) / weight, 4) AS composite FROM raw WHERE weight > 0)"""
_profile = ", ".join(_five)
ORACLES["er_scored"] = f"""{_resolved}, prof AS (SELECT {_profile}, min(id) AS rep, count(*) AS n FROM s GROUP BY {_profile})
    SELECT ia AS a, ib AS b, p.n AS n_a, q.n AS n_b, composite
    FROM scored JOIN prof p ON ia = p.rep JOIN prof q ON ib = q.rep WHERE composite >= 0.72"""
ORACLES["er_full"] = f"""{_resolved},
    edges AS (SELECT ia AS x, ib AS y FROM scored WHERE composite >= 0.72 UNION SELECT ib, ia FROM scored WHERE composite >= 0.72),
    reach AS (SELECT DISTINCT x AS node, x AS other FROM edges UNION SELECT node, y FROM reach JOIN edges ON other = x),
    m AS (SELECT node AS id, min(other) AS cluster FROM reach GROUP BY node),
    inner_pairs AS (SELECT p.cluster, scored.* FROM scored JOIN m p ON ia = p.id JOIN m q ON ib = q.id AND p.cluster = q.cluster),
    told AS (
      SELECT cluster, ia, ib, 0 AS place, format('Name similarity {{:.0f}}/100 (''{{}}'' ~ ''{{}}'')', name_score, a_name, b_name) AS reason
        FROM inner_pairs WHERE name_score >= 72
      UNION ALL SELECT cluster, ia, ib, 1, concat('Tax Id exact match: ''', a_tax_id, '''') FROM inner_pairs WHERE a_tax_id <> '' AND a_tax_id = b_tax_id
      UNION ALL SELECT cluster, ia, ib, 2, format('Address similarity {{:.0f}}/100', address_score) FROM inner_pairs WHERE address_score >= 72
      UNION ALL SELECT cluster, ia, ib, 3, concat('Zip exact match: ''', a_zip, '''') FROM inner_pairs WHERE a_zip <> '' AND a_zip = b_zip
      UNION ALL SELECT cluster, ia, ib, 4, concat('Phone exact match: ''', a_phone, '''') FROM inner_pairs WHERE a_phone <> '' AND a_phone = b_phone),
    once AS (SELECT cluster, reason, min((ia, ib, place)) AS first FROM told GROUP BY cluster, reason),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY first) AS r, count(*) OVER (PARTITION BY cluster) AS kinds FROM once),
    summary AS (SELECT cluster, concat(string_agg(reason, '; ' ORDER BY r) FILTER (WHERE r <= 5),
        CASE WHEN any_value(kinds) > 5 THEN concat(' (and ', any_value(kinds) - 5, ' more)') ELSE '' END) AS evidence_summary FROM ranked GROUP BY cluster),
    best AS (SELECT cluster, max(composite) AS confidence FROM inner_pairs GROUP BY cluster)
    SELECT cluster, arg_max(id, filled * 1000000000000 - id) AS retain_id, count(*) AS size, any_value(confidence) AS confidence,
      coalesce(any_value(evidence_summary), concat('Composite similarity: ', round(any_value(confidence) * 100)::INT, '%')) AS evidence_summary
    FROM m JOIN s USING (id) JOIN best USING (cluster) LEFT JOIN summary USING (cluster) GROUP BY cluster"""

# --- report and scorecard ----------------------------------------------------------------

# (category, severity, row) of every finding on customers; the key separates issues
_found = """f AS (
    SELECT 'CONSISTENCY' AS category, 'HIGH' AS severity, CAST(c_nationkey AS VARCHAR) AS k, c_custkey AS r FROM customer
      WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING count(DISTINCT c_mktsegment) > 1)
    UNION ALL SELECT 'OUTLIER', 'MEDIUM', c, r FROM (
      SELECT 'a' AS c, c_custkey AS r, abs((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER ()) AS z FROM customer
      UNION ALL SELECT 'n', c_custkey, abs((c_nationkey - avg(c_nationkey) OVER ()) / stddev_samp(c_nationkey) OVER ()) FROM customer
      UNION ALL SELECT 'k', c_custkey, abs((c_custkey - avg(c_custkey) OVER ()) / stddev_samp(c_custkey) OVER ()) FROM customer)
      WHERE z > 3.0
    UNION ALL SELECT 'DOMAIN_RULE', 'HIGH', 'bal', c_custkey FROM customer WHERE c_acctbal < 0
    UNION ALL SELECT 'DOMAIN_RULE', 'MEDIUM', 'seg', c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'
    UNION ALL SELECT 'REFERENTIAL_INTEGRITY', 'HIGH', 'nat', c_custkey FROM customer WHERE c_nationkey >= 20),
    i AS (SELECT DISTINCT category, severity, k FROM f)"""
ORACLES["dq_report"] = f"""WITH {_found} SELECT count(*) AS total_count, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_count,
    count(*) FILTER (WHERE severity = 'HIGH') AS high_count, count(*) FILTER (WHERE severity = 'MEDIUM') AS medium_count,
    count(*) FILTER (WHERE severity = 'LOW') AS low_count FROM i"""
ORACLES["dq_report_categories"] = f"WITH {_found} SELECT category, count(*) AS issues FROM i GROUP BY category"
ORACLES["category_table"] = f"""WITH {_found} SELECT category, total_issues, high_critical_issues, affected_row_count,
    round(high_critical_issues * 100.0::DOUBLE / total_issues, 4) AS high_critical_share FROM
    (SELECT category, count(*) AS total_issues, count(*) FILTER (WHERE severity IN ('HIGH', 'CRITICAL')) AS high_critical_issues
     FROM i GROUP BY category) JOIN (SELECT category, count(DISTINCT r) AS affected_row_count FROM f GROUP BY category) USING (category)"""
ORACLES["scorecard"] = f"""WITH {_found}, c AS (SELECT (SELECT count(*) FROM i) AS total_issues,
      (SELECT count(*) FROM i WHERE severity = 'HIGH') AS high, (SELECT count(*) FROM i WHERE severity = 'MEDIUM') AS medium,
      (SELECT count(DISTINCT r) FROM f WHERE severity = 'HIGH') AS rows_with_issues, (SELECT count(*) FROM customer) AS total_rows),
    s AS (SELECT *, round((total_rows - rows_with_issues) * 100.0::DOUBLE / total_rows, 1) AS overall_score FROM c)
    SELECT total_issues, 0::BIGINT AS critical, high, medium, 0::BIGINT AS low, total_issues AS open, 0::BIGINT AS pending_approval,
      0::BIGINT AS approved, 0::BIGINT AS rejected, 0::BIGINT AS executed, rows_with_issues, total_rows, overall_score,
      CASE WHEN overall_score >= 95 THEN 'Excellent' WHEN overall_score >= 85 THEN 'Good' WHEN overall_score >= 70
        THEN 'Needs Attention' ELSE 'Critical' END AS label FROM s"""

# --- review ------------------------------------------------------------------------------

_key = "o_orderpriority || '|' || o_orderstatus"
ISSUES = f"""i AS (SELECT {iid("DOMAIN_RULE", _key)} AS issue_id, {_key} AS description,
      CASE WHEN o_orderstatus = 'P' THEN 'DEDUPLICATION' ELSE 'DOMAIN_RULE' END AS category,
      CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
      CASE WHEN o_orderpriority = '5-LOW' THEN 'EXECUTED' ELSE 'OPEN' END AS status,
      CASE WHEN o_orderstatus = 'F' THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END AS confidence, count(*) AS affected_row_count,
      CASE WHEN o_orderstatus = 'O' THEN 'FLAG_ONLY' ELSE 'SET_VALUE' END AS action_type,
      o_orderpriority AS p, o_orderstatus AS st, min(o_orderkey) AS low, max(o_orderkey) AS high
    FROM orders GROUP BY o_orderpriority, o_orderstatus)"""
# Each decision in turn, from the lifecycle rules: first decisions come before second ones.
DECISIONS = f"""{ISSUES},
    d AS (SELECT issue_id, CASE WHEN st = 'P' THEN 'REJECT' ELSE 'APPROVE' END AS decision, 'user' || (low % 5) AS actor,
        CASE WHEN p = '1-URGENT' THEN 1 ELSE 2 END AS rank, 'first' AS note, 1 AS turn FROM i
      UNION ALL SELECT issue_id, CASE WHEN high % 2 = 0 THEN 'REJECT' ELSE 'APPROVE' END, 'user' || (low % 5), 3, 'second', 2 FROM i),
    v AS (SELECT d.*, severity, status, affected_row_count, action_type,
        CASE WHEN decision = 'APPROVE' THEN rank >= CASE WHEN severity = 'HIGH' THEN 2 ELSE 1 END ELSE rank >= 1 END AS allowed
      FROM d JOIN i USING (issue_id)),
    one AS (SELECT *, CASE WHEN NOT allowed THEN status WHEN decision = 'REJECT' THEN 'REJECTED'
        WHEN status = 'OPEN' THEN 'APPROVED' ELSE status END AS after1 FROM v WHERE turn = 1),
    two AS (SELECT v.*, after1, CASE WHEN NOT v.allowed THEN after1 WHEN v.decision = 'REJECT' THEN 'REJECTED'
        WHEN after1 = 'OPEN' THEN 'APPROVED' ELSE after1 END AS after2 FROM v JOIN one USING (issue_id) WHERE v.turn = 2),
    u AS (SELECT i.*, after2 AS new_status,
        CASE WHEN one.allowed AND one.decision = 'APPROVE' AND i.status = 'OPEN' THEN one.actor
          WHEN two.allowed AND two.decision = 'APPROVE' AND two.after1 = 'OPEN' THEN two.actor END AS approved_by,
        CASE WHEN two.allowed AND two.decision = 'REJECT' THEN two.actor WHEN one.allowed AND one.decision = 'REJECT' THEN one.actor END AS rejected_by,
        CASE WHEN two.allowed AND two.decision = 'REJECT' THEN 'second' WHEN one.allowed AND one.decision = 'REJECT' THEN 'first'
          WHEN one.allowed AND one.decision = 'APPROVE' AND i.status = 'OPEN' THEN 'first'
          WHEN two.allowed AND two.decision = 'APPROVE' AND two.after1 = 'OPEN' THEN 'second' END AS reviewer_note
      FROM i JOIN one USING (issue_id) JOIN two USING (issue_id))"""
ORACLES["review_apply"] = f"WITH {DECISIONS} SELECT issue_id, new_status AS status, approved_by, rejected_by, reviewer_note FROM u"
ORACLES["review_outcomes"] = f"""WITH {DECISIONS}, o AS (
      SELECT issue_id, decision, actor, allowed, decision = 'REJECT' OR status = 'OPEN' AS timely FROM one
      UNION ALL SELECT issue_id, decision, actor, allowed, decision = 'REJECT' OR after1 = 'OPEN' FROM two)
    SELECT issue_id, decision, actor, allowed AND timely AS accepted,
      CASE WHEN NOT allowed THEN 'role too low' WHEN NOT timely THEN 'issue is not open' END AS reason FROM o"""
ORACLES["rejection_audit"] = f"""WITH {DECISIONS} SELECT issue_id, action_type, actor, affected_row_count, false AS success,
    'REJECTED. ' || note AS notes FROM v WHERE decision = 'REJECT' AND allowed"""
ORACLES["audit_summary"] = f"""WITH {DECISIONS} SELECT count(*) AS entries, 0::BIGINT AS successes, count(*) AS failures,
    count(DISTINCT actor) AS actors, coalesce(string_agg(DISTINCT action_type, ',' ORDER BY action_type), '') AS action_types
    FROM v WHERE decision = 'REJECT' AND allowed"""
ORACLES["audit_filter"] = f"""WITH {DECISIONS} SELECT issue_id, action_type, actor FROM v
    WHERE decision = 'REJECT' AND allowed AND action_type = 'SET_VALUE'"""
_bulk = "status = 'OPEN' AND category <> 'DEDUPLICATION' AND confidence >= 0.95"
ORACLES["bulk_approve"] = f"""WITH {ISSUES} SELECT issue_id, CASE WHEN {_bulk} THEN 'APPROVED' ELSE status END AS status,
    CASE WHEN {_bulk} THEN 'boss' END AS approved_by FROM i"""
ORACLES["issue_list"] = f"""WITH {ISSUES} SELECT issue_id, category, severity, status, confidence, description,
    action_type <> 'FLAG_ONLY' AS is_actionable, category <> 'DEDUPLICATION' AND confidence >= 0.95 AS can_bulk_approve
    FROM i WHERE status = 'OPEN' AND severity = 'HIGH'"""
ORACLES["registry_merge"] = f"""WITH {ISSUES} SELECT issue_id, CASE WHEN confidence = 1 THEN 'APPROVED' ELSE status END AS status,
    confidence FROM i"""
ORACLES["review_counts"] = f"""WITH {DECISIONS} SELECT count(*) AS total, count(*) FILTER (WHERE new_status = 'OPEN') AS open,
    count(*) FILTER (WHERE new_status = 'APPROVED') AS approved, count(*) FILTER (WHERE new_status = 'REJECTED') AS rejected,
    count(*) FILTER (WHERE new_status = 'EXECUTED') AS executed, count(*) FILTER (WHERE severity = 'HIGH') AS critical_high,
    count(*) FILTER (WHERE severity = 'MEDIUM') AS low_medium FROM u"""
ORACLES["export_checklist"] = f"""WITH {DECISIONS} SELECT
    count(*) FILTER (WHERE new_status = 'OPEN' AND severity = 'HIGH' AND action_type <> 'FLAG_ONLY') AS unresolved_serious,
    count(*) FILTER (WHERE new_status = 'APPROVED') AS approved_not_executed,
    count(*) FILTER (WHERE new_status = 'EXECUTED') AS executed, count(*) FILTER (WHERE new_status = 'REJECTED') AS rejected FROM u"""

# --- cleansing ---------------------------------------------------------------------------

_bal = """CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 6 = 0 THEN 1500.0 ELSE c_acctbal END AS c_acctbal,
    CASE WHEN c_custkey % 9 = 0 THEN 'OTHER' ELSE c_mktsegment END AS c_mktsegment"""
_merged = "CASE c_custkey WHEN 2 THEN 'Merged One' WHEN 4 THEN 'Merged Three' ELSE c_name END AS c_name"
_gone = "c_custkey % 25 IN (3, 5)"
ORACLES["cleanse_set_clear"] = f"SELECT c_custkey, c_name, c_nationkey, {_bal} FROM customer"
ORACLES["cleanse_drop"] = "SELECT * FROM customer WHERE c_custkey % 25 <> 1"
ORACLES["cleanse_merge"] = f"SELECT c_custkey, {_merged}, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE NOT {_gone}"
ORACLES["cleanse_retype"] = "SELECT c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_acctbal, c_mktsegment FROM customer"
ORACLES["cleanse_bulk"] = f"""SELECT c_custkey, {_merged}, CAST(c_nationkey AS VARCHAR) AS c_nationkey, {_bal}
    FROM customer WHERE NOT {_gone} AND c_custkey % 25 <> 1"""
_counts = {
    "set1": ("SET_VALUE", "c_custkey % 6 = 0", 0),
    "set2": ("SET_VALUE", "c_custkey % 9 = 0", 0),
    "clear": ("CLEAR_VALUE", "c_custkey % 10 = 0", 0),
    "drop": ("DROP_ROW", "c_custkey % 25 = 1", 0),
    "merge1": ("MERGE_ROWS", "c_custkey % 25 = 3", 1),
    "merge2": ("MERGE_ROWS", "false", 0),
    "merge3": ("MERGE_ROWS", "c_custkey % 25 = 5", 1),
    "retype": ("RETYPE_COLUMN", "true", 0),
}
_done = " UNION ALL ".join(
    f"SELECT '{k}' AS issue_id, '{a}' AS action_type, {str(k != 'merge2').lower()} AS success, count(*) + {extra} AS rows_affected FROM customer WHERE {w}"
    for k, (a, w, extra) in _counts.items()
)
ORACLES["cleanse_results"] = _done
ORACLES["cleanse_totals"] = """SELECT 8::BIGINT AS total, 7::BIGINT AS succeeded, 1::BIGINT AS failed, 0::BIGINT AS skipped,
    false AS all_succeeded"""
ORACLES["audit_log"] = f"""SELECT issue_id, action_type, 'bob' AS actor, success, rows_affected AS affected_row_count FROM ({_done})"""
ORACLES["cleanse_amounts"] = f"""WITH {ORDER_TEXTS} SELECT _row_id AS row_id, CASE WHEN {DIRTY} AND try_cast(cleaned AS DOUBLE) IS NOT NULL
    THEN cleaned ELSE total_price END AS total_price, order_date FROM t"""
_lost = " UNION ALL ".join(
    f"""SELECT 'drop' AS issue_id, '{c}' AS "column", c_custkey AS row_id, CAST({e} AS VARCHAR) AS before, CAST(NULL AS VARCHAR) AS after
    FROM customer WHERE c_custkey % 25 = 1"""
    for c, e in {
        "c_custkey": "c_custkey",
        "c_name": "c_name",
        "c_nationkey": "c_nationkey",
        "c_acctbal": "CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 6 = 0 THEN 1500.0 ELSE c_acctbal END",
        "c_mktsegment": "CASE WHEN c_custkey % 9 = 0 THEN 'OTHER' ELSE c_mktsegment END",
    }.items()
)
ORACLES["audit_cells"] = f"""SELECT 'set1' AS issue_id, 'c_acctbal' AS "column", c_custkey AS row_id, CAST(c_acctbal AS VARCHAR) AS before,
      '1500.0' AS after FROM customer WHERE c_custkey % 6 = 0
    UNION ALL SELECT 'set2', 'c_mktsegment', c_custkey, c_mktsegment, 'OTHER' FROM customer WHERE c_custkey % 9 = 0
    UNION ALL SELECT 'clear', 'c_acctbal', c_custkey, CASE WHEN c_custkey % 6 = 0 THEN '1500.0' ELSE CAST(c_acctbal AS VARCHAR) END, NULL
      FROM customer WHERE c_custkey % 10 = 0
    UNION ALL {_lost}"""
ORACLES["score_labels"] = """SELECT l_quantity * 2 AS score, count(*) AS n,
    CASE WHEN l_quantity * 2 >= 95 THEN 'Excellent' WHEN l_quantity * 2 >= 85 THEN 'Good' WHEN l_quantity * 2 >= 70 THEN 'Needs Attention'
      ELSE 'Critical' END AS label,
    CASE WHEN l_quantity * 2 >= 90 THEN 'green' WHEN l_quantity * 2 >= 70 THEN 'amber' ELSE 'red' END AS colour,
    CASE WHEN floor(l_quantity * 2 / 100 * 100) >= 88 THEN 'high' WHEN floor(l_quantity * 2 / 100 * 100) >= 72 THEN 'medium' ELSE 'low' END AS band,
    CASE WHEN l_quantity * 2 > 50 THEN 'CRITICAL' WHEN l_quantity * 2 > 20 THEN 'HIGH' WHEN l_quantity * 2 > 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity
    FROM lineitem GROUP BY l_quantity"""
