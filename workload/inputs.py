"""Input tables derived from the given ones, as SQL that Spark and DuckDB read alike.

The given tables have few nulls, duplicates or malformed cells, so these plant some by rule.
Every input covers its whole base table.
"""

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# documents without a label have null quality and toxic
LABELLED = """
SELECT d.doc_id AS _row_id, d.doc_id, d.lang, d.source, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

BLANK_PARTS = """
SELECT p_partkey AS _row_id,
  CASE WHEN p_partkey % 7 = 0 THEN '  ' WHEN p_partkey % 11 = 0 THEN NULL ELSE p_name END AS p_name,
  CASE WHEN p_partkey % 4 = 1 THEN '' ELSE p_brand END AS p_brand,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS p_size,
  p_type
FROM part
"""

TEXTS = "SELECT doc_id AS _row_id, text, lang FROM documents"

_DOLLARS = "CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)"
_CENTS = "lpad(CAST(CAST(round((o_totalprice - floor(o_totalprice)) * 100) AS BIGINT) AS STRING), 2, '0')"
ORDER_TEXTS = f"""
SELECT o_orderkey AS _row_id,
  CASE WHEN o_orderkey % 5 = 0 THEN concat('$', {_DOLLARS}, '.', {_CENTS})
       WHEN o_orderkey % 7 = 0 THEN concat('1,', {_DOLLARS})
       WHEN o_orderkey % 11 = 0 THEN 'n/a'
       WHEN o_orderkey % 13 = 0 THEN concat({_DOLLARS}, ' EUR')
       ELSE concat({_DOLLARS}, '.', {_CENTS}) END AS total_price,
  CASE WHEN o_orderkey % 6 = 0 THEN concat(substr(CAST(o_orderdate AS STRING), 6, 2), '/',
            substr(CAST(o_orderdate AS STRING), 9, 2), '/', substr(CAST(o_orderdate AS STRING), 1, 4))
       WHEN o_orderkey % 13 = 0 THEN 'not a date'
       WHEN o_orderkey % 17 = 0 THEN 'Q1 2024'
       WHEN o_orderkey % 19 = 0 THEN ''
       ELSE substr(CAST(o_orderdate AS STRING), 1, 10) END AS order_date,
  o_orderpriority AS order_priority
FROM orders
"""

CUSTOMERS = """
SELECT c_custkey AS _row_id, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
"""

PARTS = "SELECT p_partkey AS _row_id, p_partkey, p_name, p_brand, p_type, p_size FROM part"

MIXED_CASE_PARTS = """
SELECT p_partkey AS _row_id,
  CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 1 THEN concat(' ', p_name)
       ELSE p_name END AS p_name
FROM part
"""

EVENTS = "SELECT event_id AS _row_id, event_id, user_id, event_type, value FROM events"

# Vendors: one per customer, a twin with other spelling for every tenth, and for every tenth
# a twin without tax id but with the same name and address.
_BASE = """
SELECT c_custkey AS _row_id,
  concat(substr(md5(CAST(c_custkey AS STRING)), 1, 6), ' ', substr(md5(CAST(c_custkey AS STRING)), 7, 7)) AS vendor_name,
  concat(CAST(c_custkey % 900 + 1 AS STRING), ' ', substr(md5(CAST(c_custkey + 7 AS STRING)), 1, 8), ' street') AS address,
  concat(lpad(CAST(c_custkey % 100 AS STRING), 2, '0'), '-', lpad(CAST(c_custkey AS STRING), 7, '0')) AS tax_id,
  concat('(', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), ') 555-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')) AS phone,
  concat(lpad(CAST(c_nationkey + 100 AS STRING), 5, '0'), '-0001') AS zip,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS segment
FROM customer
"""
VENDORS = f"""
SELECT * FROM ({_BASE}) base
UNION ALL
SELECT _row_id + 100000000, concat(upper(vendor_name), ', Inc.'), upper(address),
  concat(' ', tax_id), phone, substr(zip, 1, 5), concat('seg ', CAST(_row_id % 3 AS STRING))
FROM ({_BASE}) twin WHERE _row_id % 10 = 3
UNION ALL
SELECT _row_id + 200000000, concat(vendor_name, ' LLC'), address,
  CAST(NULL AS STRING), CAST(NULL AS STRING), substr(zip, 1, 5), '  '
FROM ({_BASE}) bare WHERE _row_id % 10 IN (3, 6)
"""

# Suppliers in several spellings, so that scores lie on both sides of both thresholds: letters
# changed, words in another order, cut names, missing signals, another tax id, and exact copies.
_SUPPLIER = """
SELECT s_suppkey AS k,
  concat(substr(md5(CAST(s_suppkey AS STRING)), 1, 6), ' ', substr(md5(CAST(s_suppkey AS STRING)), 7, 7), ' ',
    CASE WHEN s_suppkey % 3 = 0 THEN 'trading' WHEN s_suppkey % 3 = 1 THEN 'metal works' ELSE 'foods' END) AS name,
  concat(CAST(s_suppkey % 90 + 1 AS STRING), ' ', substr(md5(CAST(s_suppkey + 7 AS STRING)), 1, 8), ' street') AS address,
  concat(lpad(CAST(s_suppkey % 100 AS STRING), 2, '0'), '-', lpad(CAST(s_suppkey AS STRING), 7, '0')) AS tax_id,
  concat('(', lpad(CAST(s_suppkey % 1000 AS STRING), 3, '0'), ') 555-', lpad(CAST(s_suppkey % 10000 AS STRING), 4, '0')) AS phone,
  concat(lpad(CAST(s_nationkey + 100 AS STRING), 5, '0'), '-0001') AS zip
FROM supplier
"""
SUPPLIER_VENDORS = f"""
SELECT k AS _row_id, name AS vendor_name, address, tax_id, phone, zip FROM ({_SUPPLIER}) base
UNION ALL
SELECT k + 100000000, upper(translate(name, 'a3', 'e8')), address, tax_id, concat('1', phone, '9'), CAST(NULL AS STRING)
FROM ({_SUPPLIER}) letters WHERE k % 4 = 1
UNION ALL
SELECT k + 200000000, concat(substr(name, 8, 7), ' ', substr(name, 1, 6), ', LLC'), replace(address, 'street', 'st'),
  CAST(NULL AS STRING), CAST(NULL AS STRING), zip
FROM ({_SUPPLIER}) turned WHERE k % 4 = 2
UNION ALL
SELECT k + 300000000, translate(name, 'b', 'd'), address, concat('9', tax_id), phone, zip
FROM ({_SUPPLIER}) other_tax WHERE k % 4 = 3
UNION ALL
SELECT k + 400000000, concat(substr(name, 3, 9), CASE WHEN k % 8 = 0 THEN ' depot north' ELSE '' END), CAST(NULL AS STRING), '', phone, CAST(NULL AS STRING)
FROM ({_SUPPLIER}) cut WHERE k % 4 = 0
UNION ALL
SELECT k + 500000000, name, address, tax_id, phone, zip FROM ({_SUPPLIER}) again WHERE k % 5 IN (0, 1)
UNION ALL
SELECT k + 600000000, name, address, tax_id, phone, zip FROM ({_SUPPLIER}) third WHERE k % 5 = 0
"""

# Links between customers of one nation: chains whose components are the nations.
CHAINS = """
SELECT c_custkey AS a, lag(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS b
FROM customer
"""
