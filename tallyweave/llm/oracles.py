"""DuckDB SQL of the queries that SQL can express, by their contracts alone: it shares no step with the operators."""

ORACLES: dict[str, str] = {
    # all windows of 200 bytes, by their hex digits
    "op11_suffix_array_dedup": """WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents), s AS (SELECT *, len(t) // 2 AS n FROM d),
      tiles AS (SELECT r, since, substr(t, 2 * since + 1, 2398) AS x FROM (SELECT r, t, unnest(range(0, n - 199, 1000)) AS since FROM s WHERE n >= 200)),
      w AS (SELECT r, since + i AS i, md5(substr(x, 2 * i + 1, 400)) AS k FROM (SELECT r, since, x, unnest(range(0, least(1000, len(x) // 2 - 199))) AS i FROM tiles)),
      twice AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1), hit AS (SELECT r, i FROM w JOIN twice USING (k)),
      g AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM hit),
      q AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM g),
      spans AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM q GROUP BY r, k),
      gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS since FROM spans),
      kept AS (SELECT s.r, string_agg(substr(t, (2 * since + 1)::BIGINT, (2 * (a - since))::BIGINT), '' ORDER BY a) AS x, sum(b - a) AS gone, count(*) AS k, max(b) AS last FROM s JOIN gaps USING (r) GROUP BY s.r)
      SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(x, '') || substr(t, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256 FROM s LEFT JOIN kept USING (r)""",
    # near words by what a deletion leaves of them; crc32 byte by byte
    "op12_spelling_variants": """WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)) AS t),
      runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
      low AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM runs WHERE length(run) >= 6),
      each AS (SELECT doc_id, run, count(*) AS times, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM low GROUP BY ALL),
      crc AS (SELECT run, times, xor(list_reduce(range(len(h) // 2), lambda c, k: xor(c >> 8, t[1 + (xor(c, ('0x' || substr(h, 2 * k + 1, 2))::BIGINT) & 255)]), 4294967295::BIGINT), 4294967295) AS c FROM each, bits),
      found AS (SELECT CASE WHEN c % 199 = 0 THEN run[: c % length(run)] || run[c % length(run) + 2 :] ELSE run END AS word, times FROM crc),
      words AS (SELECT word, sum(times)::BIGINT AS n FROM found WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
      less AS (SELECT word, n, i, word[: i - 1] || word[i + 1 :] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
      near AS (SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON l.rest = w.word UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON l.rest = w.word),
      best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS form, max(m) AS form_n FROM near GROUP BY word),
      v AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
      path AS (SELECT word, word AS root FROM v UNION ALL SELECT path.word, v.form FROM path JOIN v ON v.word = path.root WHERE v.form IS NOT NULL),
      ends AS (SELECT path.word, path.root FROM path JOIN v ON v.word = path.root WHERE v.form IS NULL)
      SELECT v.word, form, root, n, n_near, form_n::BIGINT AS form_n FROM v JOIN ends USING (word)""",
}
