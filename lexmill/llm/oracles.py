"""DuckDB statements for the queries of this subpackage that SQL can express on whole tables."""


def _links(source: str, k: int, num: int, den: int) -> str:
    """CTEs up to ``links(a, b)``: pairs of ids of ``source(id, text)`` whose sets of k-word runs are alike."""
    run = " || ' ' || ".join(f"w[i + {j}]" for j in range(k))
    return f"""
    src AS ({source}),
    words AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM src),
    long AS (SELECT id, w FROM words WHERE len(w) >= 20),
    runs AS (SELECT DISTINCT id, {run} AS g FROM (SELECT id, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM long)),
    sizes AS (SELECT id, count(*) AS n FROM runs GROUP BY id),
    common AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM runs x JOIN runs y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2),
    links AS (SELECT a, b FROM common JOIN sizes s ON s.id = a JOIN sizes t ON t.id = b WHERE {den} * c >= {num} * (s.n + t.n - c))"""


_MAILS = "SELECT id, any_value(email_content) AS text FROM spam_assassin WHERE email_content IS NOT NULL GROUP BY id"
_GROUPS = f"""WITH RECURSIVE {_links(_MAILS, 3, 1, 2)},
    ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(id, other) AS (SELECT id, id FROM sizes UNION SELECT r.id, w.b FROM reach r JOIN ways w ON w.a = r.other),
    groups AS (SELECT id, min(other) AS group_id FROM reach GROUP BY id)"""
_CLEANED = """SELECT id, any_value(text) AS text, any_value(lower(trim(split))) AS s FROM spam_assassin_preprocessed
    WHERE text IS NOT NULL AND lower(trim(split)) IN ('train', 'test', 'valid') GROUP BY id"""

_TERMS = """SELECT term, CAST(sum(c) AS BIGINT) AS occurrences, count(*) AS records,
    CASE WHEN count(*) < 3 THEN 'rare' WHEN count(*) * 5 > any_value(total) THEN 'common' END AS mark
    FROM (SELECT id, term, count(*) AS c FROM (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term
        FROM (SELECT id, any_value(text) AS text FROM spam_assassin_preprocessed WHERE text IS NOT NULL GROUP BY id)) GROUP BY 1, 2),
    (SELECT count(DISTINCT id) AS total FROM spam_assassin_preprocessed WHERE text IS NOT NULL) GROUP BY term"""

#: Brute force; the search is approximate, and misses none of these pairs on the tables up to sf0.01.
_RANKED = """WITH once AS (SELECT row_id AS id, any_value(features) AS f FROM train_tfidf_features GROUP BY row_id),
    cells AS (SELECT id, i, CAST(f[i] AS DOUBLE) AS x FROM (SELECT id, f, unnest(range(1, len(f) + 1)) AS i FROM once) WHERE f[i] <> 0),
    norms AS (SELECT id, sqrt(sum(x * x)) AS n FROM cells GROUP BY id),
    dots AS (SELECT a.id AS id, b.id AS other, sum(a.x * b.x) AS d FROM cells a JOIN cells b ON a.i = b.i AND a.id <> b.id GROUP BY 1, 2),
    near AS (SELECT d.id, other, round(d / (p.n * q.n), 12) AS c FROM dots d JOIN norms p ON p.id = d.id JOIN norms q ON q.id = other),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, other) AS r FROM near)
    """
_NEAREST = _RANKED + "SELECT DISTINCT least(id, other) AS id_a, greatest(id, other) AS id_b FROM ranked WHERE r <= 5 AND c >= 0.8 - 1e-12"

_SOURCE = "regexp_replace(lower(regexp_replace(source, '^\\s+|\\s+$', '', 'g')), '[\\s-]+', '_', 'g')"

ORACLES = {
    "p7_held": "SELECT container, (SELECT count(*) FROM documents WHERE text <> '') AS texts, 0::BIGINT AS overfull, 0::BIGINT AS cut_early, 0::BIGINT AS misplaced FROM container_sizes",
    "p8_held": f"SELECT {_SOURCE} AS source, max_repeats, 0::BIGINT AS above_cap, false AS missed FROM source_weights w WHERE target_share > 0 AND {_SOURCE} IN (SELECT {_SOURCE} FROM documents WHERE text <> '')",
    "p5_found": _NEAREST,
    "p5_recall": _RANKED + "SELECT count(*) AS pairs, true AS enough FROM ranked WHERE r <= 5 AND c >= 0.8 - 1e-12 AND id % 20 = 0",
    "p1_found": f"SELECT term, mark FROM ({_TERMS}) WHERE mark IS NOT NULL",
    "p1_term_frequencies": _TERMS,
    "p2_groups": _GROUPS
    + """, texts AS (SELECT id, list_sort(list(g)) AS t FROM runs GROUP BY id),
    ends AS (SELECT x.id, count(DISTINCT y.t) FILTER (x.t <> y.t) AS links FROM ways w JOIN texts x ON x.id = w.a JOIN texts y ON y.id = w.b GROUP BY x.id)
    SELECT id, group_id, coalesce(links, 0) AS links FROM groups LEFT JOIN ends USING (id)""",
    "p2_found": _GROUPS + " SELECT x.id AS id_a, y.id AS id_b FROM groups x JOIN groups y ON x.group_id = y.group_id AND x.id < y.id",
    "p3_found": f"""WITH {_links(_CLEANED, 2, 7, 10)}
    SELECT a AS id_a, b AS id_b FROM links JOIN src s ON s.id = a JOIN src t ON t.id = b WHERE (s.s = 'train') <> (t.s = 'train')""",
    "p3_report": f"""WITH {_links(_CLEANED, 2, 7, 10)},
    pairs AS (SELECT a, b FROM links JOIN src s ON s.id = a JOIN src t ON t.id = b WHERE (s.s = 'train') <> (t.s = 'train')),
    kept AS (SELECT id, lower(trim(any_value(split))) AS split, any_value(source) AS source, lower(trim(any_value(label))) AS label FROM spam_assassin_preprocessed GROUP BY id),
    told AS (SELECT x.id, x.label IS NOT DISTINCT FROM y.label AS same FROM (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs) JOIN kept x ON x.id = a JOIN kept y ON y.id = b),
    each AS (SELECT id, max(CAST(same AS INTEGER)) AS same, max(CAST(NOT same AS INTEGER)) AS another FROM told GROUP BY id)
    SELECT split, source, count(*) AS records, count(same) AS overlapping, CAST(coalesce(sum(same), 0) AS BIGINT) AS same_label, CAST(coalesce(sum(another), 0) AS BIGINT) AS other_label
    FROM kept LEFT JOIN each USING (id) GROUP BY split, source""",
}
