"""DuckDB SQL of the registered queries that SQL can express."""

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

OP2 = """
WITH r AS (
  SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages
), o AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM r
)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM o
"""

OP3 = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
         '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, len(v) AS k, array_to_string(v, ' ') AS g FROM (
    SELECT item_id, w[i + 1 : i + 10] AS v
    FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0))
), dw AS (
  SELECT doc_id, i, k, array_to_string(w[i + 1 : i + k], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i
        FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)
), hit AS (
  SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k
), cov AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP10 = f"""
WITH rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), f AS (
  SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM f
"""

OP11 = r"""
WITH RECURSIVE f AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), bits AS (  -- CRC-32, byte by byte; keys are digits, a colon, a sign or a blank
  SELECT key, 4294967295::BIGINT AS crc, 0 AS done FROM (SELECT DISTINCT key FROM f)
  UNION ALL
  SELECT key, list_reduce([xor(crc, ascii(key[done + 1])::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
         lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), done + 1
  FROM bits WHERE done < length(key)
), fault AS (
  SELECT key, xor(crc, 4294967295) % 20 AS fault FROM bits WHERE done = length(key)
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM f JOIN fault USING (key) WHERE fault <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
         rtrim(text, E' \t\n\x0B\x0C\r') AS bare, left(role, 1) AS x FROM damaged
), r AS (
  SELECT *, CASE WHEN bare = '' THEN 1 WHEN again THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(x) OVER (PARTITION BY conv_id ORDER BY i) AS x0 FROM placed
), sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) AS n,
         count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
         count(*) FILTER (i > 1 AND x0 || x NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id
), moves(q, x, p) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), dp(conv_id, i, q, best) AS (  -- best: cost and edits with which the first i rows lead to state q
  SELECT conv_id, 0::BIGINT, 0, {'cost': 0, 'audit': ''} FROM sums
  UNION ALL
  SELECT conv_id, i + 1, p, min({'cost': cost, 'audit': audit})
  FROM (
    WITH wide AS (
      SELECT conv_id, i, q, best.cost AS cost, best.audit AS audit FROM dp
      UNION ALL SELECT conv_id, i, CASE q WHEN 2 THEN 3 ELSE 2 END, best.cost + 2, best.audit || 'I' FROM dp
      UNION ALL SELECT conv_id, i, CASE q WHEN 2 THEN 2 ELSE 3 END, best.cost + 4, best.audit || 'II' FROM dp
    )
    SELECT w.conv_id, w.i, w.q AS p, w.cost + 3 AS cost, audit || 'D' AS audit
    FROM wide w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
    UNION ALL
    SELECT w.conv_id, w.i, m.p, w.cost + CASE WHEN r.fault = 3 THEN 1 ELSE 0 END, audit || 'K'
    FROM wide w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 AND r.fault IN (0, 3) JOIN moves m ON m.q = w.q AND m.x = r.x
    UNION ALL
    SELECT w.conv_id, w.i, CASE w.q WHEN 2 THEN 3 ELSE 2 END, w.cost + 2 + CASE WHEN r.fault = 3 THEN 1 ELSE 0 END, audit || 'R'
    FROM wide w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 AND r.fault IN (0, 3)
  ) GROUP BY conv_id, i, p
), best AS (
  SELECT s.conv_id, min(CASE q WHEN 1 THEN {'cost': best.cost + 4, 'audit': best.audit || 'II'}
         WHEN 2 THEN {'cost': best.cost + 2, 'audit': best.audit || 'I'} ELSE best END) AS best
  FROM sums s JOIN dp ON dp.conv_id IS NOT DISTINCT FROM s.conv_id AND dp.i = s.n GROUP BY s.conv_id
), e AS (
  SELECT conv_id, p, best.audit[p] AS edit FROM (SELECT *, unnest(range(1, len(best.audit) + 1)) AS p FROM best)
), o AS (
  SELECT e.*, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER w AS k
  FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY p ROWS UNBOUNDED PRECEDING)
), out AS (
  SELECT o.conv_id, p, edit, k, r.role, r.text, r.x,
         bool_or(k = 1 AND edit = 'K' AND r.x = 's') OVER (PARTITION BY o.conv_id) AS opened
  FROM o LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM o.conv_id AND r.i = o.i AND edit <> 'I' WHERE edit <> 'D'
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (k + opened::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END
         || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS whole FROM out GROUP BY conv_id
)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids
     LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM ids.conv_id
     LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id
     LEFT JOIN repaired ON repaired.conv_id IS NOT DISTINCT FROM ids.conv_id
"""

OP12 = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces
), grams AS (
  SELECT lang, w[i : i + k - 1] AS g, k, count(*)::BIGINT AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)
  GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang
), c AS (
  SELECT * FROM grams WHERE k > 1 AND f >= 30
), cuts AS (
  SELECT c.lang, c.g, c.f, x.f AS l, y.f AS r, j, (2000000::HUGEINT * c.f // (x.f + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
       JOIN grams x ON x.lang = c.lang AND x.g = c.g[1 : j] JOIN grams y ON y.lang = c.lang AND y.g = c.g[j + 1 : c.k]
), weakest AS (
  SELECT lang, g, f, arg_min({{'l': l, 'r': r, 'score': score}}, (score, j)) AS cut FROM cuts GROUP BY lang, g, f
), covered AS (
  SELECT DISTINCT lang, s AS g, f AS longer
  FROM (SELECT lang, f, g[i : i + m - 1] AS s
        FROM (SELECT lang, g, f, k, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k))
), kept AS (
  SELECT * FROM weakest w
  WHERE NOT EXISTS (SELECT 1 FROM covered x WHERE x.lang = w.lang AND x.g = w.g AND 100::HUGEINT * x.longer >= 80::HUGEINT * w.f)
), ranked AS (
  SELECT *, array_to_string(g, ' ') AS phrase,
         row_number() OVER (PARTITION BY lang ORDER BY cut.score DESC, f DESC, array_to_string(g, ' ')) AS rank
  FROM kept
)
SELECT lang, rank, phrase, f AS a, cut.l AS l, cut.r AS r, n, cut.score AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

OP13 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 3))::INT AS cell
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::BIGINT AS cap,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER w AS k, sum(cap) OVER w - cap AS caps, sum(weight) OVER () - sum(weight) OVER w + weight AS weights,
         1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS total
  FROM s WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), level AS (
  SELECT arg_min(total - caps, k) AS rest, arg_min(weights, k) AS weights, min(k) AS k
  FROM o WHERE weight * (total - caps) <= cap * weights
), t AS (
  SELECT source, source_size,
         CASE WHEN level.k IS NULL OR o.k < level.k THEN cap ELSE weight * rest / level.weights END AS target
  FROM o, level
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
         CASE WHEN source_size > 0 THEN (target - floor(target / source_size) * source_size) / source_size ELSE 0 END AS fraction
  FROM t
), c AS (
  SELECT source, len(bin(size)) AS class, cell, sum(size)::BIGINT AS words FROM d WHERE size > 0 GROUP BY ALL
), marks AS (
  SELECT source, class, cell + 1 AS cut, sum(words) OVER (PARTITION BY source, class ORDER BY cell) AS given FROM c
  UNION ALL SELECT DISTINCT source, class, 0, 0 FROM c
), classes AS (
  SELECT source, class, sum(words)::DOUBLE AS words,
         row_number() OVER (PARTITION BY source ORDER BY class DESC) AS step
  FROM c GROUP BY source, class
), cuts(source, step, class, cut, owed) AS (
  SELECT source, 0::BIGINT, 0::BIGINT, 0, 0.0::DOUBLE FROM e
  UNION ALL
  SELECT source, step, class, mark.cut, wanted - mark.given
  FROM (
    SELECT n.source, n.step, n.class, any_value(e.fraction * n.words + p.owed) AS wanted,
           arg_min({'cut': m.cut, 'given': m.given::DOUBLE}, (abs(m.given::DOUBLE - (e.fraction * n.words + p.owed)), m.cut)) AS mark
    FROM cuts p JOIN classes n ON n.source IS NOT DISTINCT FROM p.source AND n.step = p.step + 1
         JOIN e ON e.source IS NOT DISTINCT FROM p.source
         JOIN marks m ON m.source IS NOT DISTINCT FROM n.source AND m.class = n.class
    GROUP BY n.source, n.step, n.class
  )
)
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN size > 0 AND cell < cut THEN 1 ELSE 0 END) AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
     LEFT JOIN cuts ON step > 0 AND cuts.source IS NOT DISTINCT FROM d.source AND cuts.class = len(bin(size))
"""

# Every pair of a label, and all that a vector reaches over links.
OP9 = """
WITH RECURSIVE vectors AS (
    SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), usable AS MATERIALIZED (
    SELECT * FROM vectors
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0
        AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.r AS a, b.r AS b, b.vec_id AS other
    FROM usable a JOIN usable b ON a.label = b.label AND a.r <> b.r
    WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) ELSE 0 END >= 0.93
), reached AS (
    SELECT a AS r, b AS at FROM links
    UNION
    SELECT reached.r, links.b FROM reached JOIN links ON reached.at = links.a
), smallest AS (
    SELECT reached.r, min(usable.vec_id) AS least FROM reached JOIN usable ON reached.at = usable.r GROUP BY reached.r
), linked AS (
    SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id,
    coalesce(vec_id = least(vec_id, coalesce(least, vec_id)), TRUE) AS kept
FROM vectors LEFT JOIN linked ON vectors.r = linked.a LEFT JOIN smallest ON vectors.r = smallest.r
"""

ORACLES = {"op2_warc": OP2, "op3_decontamination": OP3, "op9_embeddings": OP9, "op10_url_filters": OP10, "op11_conversation_repair": OP11, "op12_collocations": OP12, "op13_mixing": OP13}
