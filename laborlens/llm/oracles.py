"""SQL of the queries that it can express, in another way than the operators compute them: no segments, no histograms."""

SQL = {
    "op3_warc": """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
 r AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) END AS response FROM p)
 SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN response <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN response <> page_id THEN response END AS refers_to FROM r""",
    "op10_mixing": r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) >> 30 AS slot FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY source),
 l AS (SELECT *, 3 * source_size AS stop, CAST((SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER o, 0) AS DOUBLE) / ((SELECT sum(w) FROM s) - coalesce(sum(w) OVER o, 0)) AS level
  FROM s WINDOW o AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 t AS (SELECT source, source_size, least(CAST(stop AS DOUBLE), coalesce((SELECT arg_min(level, stop / w) FROM l WHERE level <= stop / w) * w, CAST(stop AS DOUBLE))) AS target FROM l),
 n AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS times FROM t),
 c AS (SELECT d.source, slot, sum(size) AS size, sum(sum(size)) OVER (PARTITION BY d.source ORDER BY slot) AS up_to FROM d GROUP BY d.source, slot),
 e AS (SELECT c.source, min(slot) AS slot, arg_min(c.size, slot) AS size, arg_min(c.up_to - c.size, slot) AS below FROM c JOIN n ON n.source IS NOT DISTINCT FROM c.source WHERE c.up_to > n.target - n.times * n.source_size GROUP BY c.source)
 SELECT d.doc_id, d.size, n.source_size, n.target, CAST(d.size * (n.times + CASE WHEN n.times < 3 AND (e.slot IS NULL OR d.slot < e.slot OR (d.slot = e.slot AND (n.target - n.times * n.source_size - e.below) * 2 > e.size)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
 FROM d JOIN n ON n.source IS NOT DISTINCT FROM d.source LEFT JOIN e ON e.source IS NOT DISTINCT FROM d.source""",
    "op12_collocations": r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
 total AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
 g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, CAST(count(*) AS HUGEINT) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) AS r(k)) GROUP BY ALL HAVING count(*) >= 100),
 c AS (SELECT *, string_split(phrase, ' ') AS ws FROM g WHERE k > 1),
 cut AS (SELECT c.lang, c.phrase, c.k, c.f AS a, j, l.f AS l, r.f AS r, n, 1000 * c.f * n // (l.f * r.f) AS score FROM c JOIN total USING (lang), range(1, 5) AS t(j), g AS l, g AS r
  WHERE j < c.k AND l.lang = c.lang AND l.phrase = array_to_string(ws[1:j], ' ') AND r.lang = c.lang AND r.phrase = array_to_string(ws[j + 1:], ' ')),
 best AS (SELECT lang, phrase, k, a, n, unnest(arg_min({l: l, r: r, score: score}, (score, j))) FROM cut GROUP BY lang, phrase, k, a, n),
 kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.k > b.k AND c.f >= b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
 SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
 FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000""",
    "op13_fill_middle": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
 c AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain' WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
 p AS (SELECT *, substr(t, 1, least(x, y)) AS prefix, substr(t, 1 + least(x, y), greatest(x, y) - least(x, y)) AS middle, substr(t, 1 + greatest(x, y)) AS suffix FROM c)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
}
