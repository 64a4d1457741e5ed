"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from .secrets import BASE_RULES, EXTRA_RULES


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secrets_sql() -> str:
    """Matches and the pieces between them give every span's place."""
    parts = []
    for rank, r in enumerate(BASE_RULES + EXTRA_RULES):
        p = _literal(r.pattern)
        parts.append(
            f"""SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(t, {p}) AS gaps,
            regexp_extract_all(t, {p}) AS hits, regexp_extract_all(t, {p}, {r.group}) AS parts FROM d WHERE regexp_matches(t, {p})"""
        )
    kinds = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    counts = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({' UNION ALL '.join(parts)}),
    e AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m),
    s AS (SELECT doc_id, rank, kind, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS a, length(hits[i]) AS n
          FROM e WHERE length(parts[i]) >= least),
    g AS (SELECT doc_id, {kinds}, coalesce(string_agg(concat(kind, ':', a, ':', a + n), ',' ORDER BY a, rank) FILTER (WHERE rank < {len(BASE_RULES)}), '') AS base,
          string_agg(concat(kind, ':', a, ':', a + n), ',' ORDER BY a, rank) AS spans FROM s GROUP BY doc_id)
    SELECT d.doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


LINES = """WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
  l AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM docs)),
  big AS (SELECT *, row_number() OVER (ORDER BY doc_id, i) AS p FROM l WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
  d AS (SELECT line, min(p) AS p, CAST(length(line) AS BIGINT) AS n FROM big GROUP BY line),
  k AS (SELECT line, p, n, unnest([n, n - 1]) AS short FROM d WHERE n >= 20),
  h AS (SELECT line, p, n, short, 0 AS side, left(line, CAST(short // 2 AS BIGINT)) AS half FROM k UNION ALL SELECT line, p, n, short, 1, right(line, CAST(short // 2 AS BIGINT)) FROM k),
  c AS (SELECT DISTINCT a.line AS x, a.n AS xn, b.line AS y, b.n AS yn, b.p AS p FROM h a JOIN h b ON a.short = b.short AND a.side = b.side AND a.half = b.half AND a.p < b.p),
  near AS (SELECT DISTINCT p FROM c WHERE CASE WHEN xn = yn THEN len(list_filter(range(1, xn + 1), lambda i: substr(x, i, 1) <> substr(y, i, 1))) <= 1
     WHEN xn = yn + 1 THEN len(list_filter(range(0, xn), lambda i: left(x, i) || substr(x, i + 2) = y)) > 0
     WHEN yn = xn + 1 THEN len(list_filter(range(0, yn), lambda i: left(y, i) || substr(y, i + 2) = x)) > 0 ELSE FALSE END),
  gone AS (SELECT doc_id, i FROM big JOIN d USING (line) WHERE big.p <> d.p UNION SELECT doc_id, i FROM big JOIN near USING (p)),
  kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS text FROM l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id),
  n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
  SELECT d.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, coalesce(n, 0) AS n_removed, CAST(length(coalesce(k.text, '')) AS BIGINT) AS n_chars, sha256(coalesce(k.text, '')) AS text_sha256
  FROM docs d LEFT JOIN kept k USING (doc_id) LEFT JOIN n USING (doc_id)"""

AUDIT = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
  w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
  f AS (SELECT doc_id, part, concat(CASE WHEN len(words) < 100 THEN 'A' END, CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' END,
          CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
          CASE WHEN doc_id > first THEN 'E' END) AS fails FROM w),
  l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
  n AS (SELECT part, fails, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
  c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
  o AS (SELECT concat(a.c, b.c, d.c, e.c, g.c) AS filter_order FROM c a, c b, c d, c e, c g WHERE len(list_distinct([a.c, b.c, d.c, e.c, g.c])) = 5),
  s AS (SELECT filter_order, CAST(i AS INTEGER) AS step, filter_order[i] AS f, filter_order[1:i-1] AS before FROM o, range(1, 6) r(i)),
  x AS (SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS hit, translate(fails, before, '') <> fails AS gone, fails = f AS alone FROM n, s),
  g AS (SELECT part, filter_order, step, f, CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND NOT hit), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND hit), 0) AS BIGINT) AS removed,
          CAST(coalesce(sum(n) FILTER (WHERE gone AND hit), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (WHERE alone), 0) AS BIGINT) AS unique_fails,
          CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND hit AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (WHERE NOT gone AND hit AND toxic), 0) AS BIGINT) AS toxic_lost
        FROM x GROUP BY ALL)
  SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM g"""


def codes_sql(rounds: int = 4) -> str:
    """Lloyd's rounds one after the other, each part compared with every entry; doubles hold these whole numbers exactly."""
    ctes = [
        "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS MATERIALIZED (SELECT vec_id, part, x[part * (len(x) // 4) + 1 : (part + 1) * (len(x) // 4)] AS x FROM v, range(4) r(part))",
        "c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 256))",
    ]
    for i in range(rounds + 1):
        ctes.append(
            f"""a{i} AS MATERIALIZED (SELECT vec_id, part, min(struct_pack(d := list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c), entry := entry)) AS best
            FROM p JOIN c{i} USING (part) GROUP BY vec_id, part)"""
        )
        if i < rounds:
            ctes.append(
                f"""m{i} AS (SELECT part, entry, list(m ORDER BY i) AS m FROM (SELECT part, best.entry AS entry, i, floor(sum(x[i]) / count(*)) AS m
                FROM p JOIN a{i} USING (vec_id, part), range(1, len(x) + 1) r(i) GROUP BY part, best.entry, i) GROUP BY part, entry),
                c{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m, c) AS c FROM c{i} LEFT JOIN m{i} USING (part, entry))"""
            )
    return f"""WITH {", ".join(ctes)},
    g AS (SELECT vec_id, string_agg(lower(printf('%02x', CAST(best.entry AS INTEGER))), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
    h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM g JOIN v USING (vec_id), h"""


REPEATS = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
  c AS (SELECT r, n, a, substr(h, 2 * a + 1, 2800) AS piece FROM (SELECT r, n, h, unnest(range(0, n - 399, 1000)) AS a FROM d WHERE n >= 400)),
  w AS (SELECT r, a + j AS i, md5_number(substr(piece, 2 * j + 1, 800)) AS m FROM (SELECT r, a, piece, unnest(range(0, least(1000, n - 399 - a))) AS j FROM c)),
  m AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
  s AS (SELECT r, i, i > lag(i, 1, -401) OVER (PARTITION BY r ORDER BY i) + 400 AS opens FROM w SEMI JOIN m USING (m)),
  g AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM (SELECT r, i, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY r ORDER BY i) AS span FROM s) GROUP BY r, span),
  k AS (SELECT r, h, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before, lead(a) OVER (PARTITION BY r ORDER BY a) AS later FROM g JOIN d USING (r)),
  o AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(concat(substr(h, 2 * before + 1, 2 * (a - before)), CASE WHEN later IS NULL THEN substr(h, 2 * b + 1) END), '' ORDER BY a) AS kept FROM k GROUP BY r)
  SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN o USING (r)"""

ORACLE: dict[str, str] = {"op3_secrets": secrets_sql(), "op6_line_dedup": LINES, "op11_filter_audit": AUDIT, "op12_vector_codes": codes_sql(), "op13_suffix_dedup": REPEATS}
