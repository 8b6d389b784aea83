"""DuckDB SQL of the operators over runs, resampling and sketches, formulated apart from the operators' methods."""

#: Remainders of the CRC-32 polynomial (reversed) for each byte, as a list t.
_CRC_TABLE = """table_ AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]),
                 lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b)))"""
_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{gap}'), lambda x: x <> '')"
_BLANK = r"[\x20\x09-\x0D]+"
_LETTERS = _WORDS.format(gap=r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _crc(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, beside the table."""
    byte = f"list_transform(range(strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {byte}), lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS INTEGER) + 1])), 4294967295)"


SQL: dict[str, str] = {
    "op11_periodic_runs": rf"""
        WITH {_CRC_TABLE},
             split AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}'), lambda x: x <> '') AS o, {_crc('CAST(doc_id AS VARCHAR)')} AS h FROM documents, table_),
             placed AS (SELECT doc_id, o, len(o) AS n, h, h // 10 AS g, CASE WHEN len(o) > 0 THEN (h // 10) % len(o) END AS a FROM split),
             words AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: o[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE o END AS w FROM placed),
             flat AS (SELECT doc_id, unnest(w) AS x, unnest(range(n)) AS i FROM words),
             windows AS (SELECT doc_id, unnest(list_transform(range(n - 15), lambda i: array_to_string(w[i + 1:i + 16], ' '))) AS x, unnest(range(n - 15)) AS i FROM words WHERE n >= 24),
             again AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM windows a JOIN windows b ON a.doc_id = b.doc_id AND a.x = b.x AND a.i < b.i),
             stretches AS (SELECT doc_id, q, min(i) AS start, max(i) - min(i) + 16 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM again) GROUP BY doc_id, q, island),
             long AS (SELECT * FROM stretches WHERE length >= greatest(24, 3 * q)),
             runs AS (SELECT * FROM long r WHERE NOT EXISTS (SELECT 1 FROM long s WHERE s.doc_id = r.doc_id AND s.q < r.q AND r.q % s.q = 0 AND s.start <= r.start AND s.start + s.length >= r.start + r.length)),
             best AS (SELECT doc_id, start, length, q, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / q DESC, start, q) AS k FROM runs),
             lines AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS t FROM runs GROUP BY doc_id),
             dropped AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM runs),
             kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM flat ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
        SELECT words.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, q AS period, 1000 * length // q AS exponent_milli, sha256(coalesce(lines.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
        FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN (SELECT * FROM best WHERE k = 1) USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op12_crc_ring": rf"""
        WITH {_CRC_TABLE},
             words AS (SELECT 0 AS origin, doc_id, {_LETTERS} AS w FROM documents
                       UNION ALL SELECT 1, NULL, {_LETTERS} FROM benchmark),
             runs AS (SELECT origin, doc_id, unnest(flatten(list_transform(range(1, len(w) + 1), lambda i: list_transform(range(i, least(i + 2, len(w)) + 1), lambda j: array_to_string(w[i:j], ' '))))) AS f FROM words),
             counted AS (SELECT origin, doc_id, f, count(*) AS c FROM runs GROUP BY origin, doc_id, f),
             hashed AS (SELECT f, {_crc('f')} % 10000 AS bucket FROM (SELECT DISTINCT f FROM counted), table_),
             shares AS (SELECT bucket, sum(CASE WHEN origin = 0 THEN c ELSE 0 END) AS s, sum(CASE WHEN origin = 1 THEN c ELSE 0 END) AS t FROM counted JOIN hashed USING (f) GROUP BY bucket),
             totals AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM shares),
             gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (all_s + 10000) AS DOUBLE) / CAST((s + 1) * (all_t + 10000) AS DOUBLE))) AS BIGINT) AS g FROM shares, totals),
             weights AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS n_features, CAST(sum(c * g) AS BIGINT) AS weight FROM counted JOIN hashed USING (f) JOIN gain USING (bucket) WHERE origin = 0 GROUP BY doc_id),
             scored AS (SELECT words.doc_id, len(w) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                               coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || words.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
                        FROM words LEFT JOIN weights USING (doc_id) WHERE origin = 0),
             ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n >= 20 AND score IS NOT NULL)
        SELECT scored.doc_id, n_features, weight, score, CASE WHEN r <= ranked.n * 5 // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)""",
    "op13_setsketch": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, min(text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
             w AS (SELECT doc_id, {_WORDS.format(gap=_BLANK)} AS ws FROM d),
             s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 2 THEN ws
                          ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: concat_ws(' ', ws[i], ws[i + 1]))) END AS sh FROM w),
             t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
             shared AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id),
             links AS (SELECT a, b FROM shared WHERE 100 * c >= 80 * (na + nb - c)),
             lab(node, label) USING KEY (node) AS (
                 SELECT doc_id AS node, doc_id AS label FROM s
                 UNION SELECT links.b AS node, min(lab.label) AS label FROM lab JOIN links ON links.a = lab.node JOIN recurring.lab AS old ON old.node = links.b WHERE lab.label < old.label GROUP BY links.b)
        SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, lab.label AS component_id, lab.label = s.doc_id AS kept FROM s JOIN lab ON lab.node = s.doc_id""",
}
