"""DuckDB statements that give the same rows as :mod:`.queries`, written apart from them."""

from __future__ import annotations

from ..operators.tfidf import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _number(label: str) -> str:
    return f"""coalesce(CASE WHEN isfinite(try_cast({label} AS DOUBLE)) THEN CAST(trunc(try_cast({label} AS DOUBLE)) AS INTEGER) END,
        CASE WHEN lower(trim({label})) IN ('1', 'spam', 'true', 't') THEN 1 ELSE 0 END)"""


_TEXTS = "texts AS (SELECT id AS doc_id, any_value(text) AS text, any_value(label) AS raw_label FROM spam_assassin_preprocessed GROUP BY id)"
_CORPUS = f"{_TEXTS}, corpus AS (SELECT doc_id, coalesce(text, '') AS text, CAST({_number('raw_label')} AS VARCHAR) AS label FROM texts WHERE raw_label IS NOT NULL)"
_WORDS = f"{_CORPUS}, words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM corpus)"
_FREQ = f"{_WORDS}, freq AS (SELECT term, count(*) AS cnt FROM words GROUP BY term)"


def _vocab(least: int = 1) -> str:
    return f"{_FREQ}, vocab AS (SELECT term, CAST(row_number() OVER (ORDER BY cnt DESC, term) - 1 AS INTEGER) AS idx, cnt FROM freq WHERE cnt >= {least})"


_COUNTS = f"{_vocab(2)}, counts AS (SELECT doc_id, idx, count(*) AS cnt FROM words JOIN vocab USING (term) GROUP BY 1, 2)"
_SPLIT = """split AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(doc_id || ':42')) <= ceil(0.2 * count(*) OVER (PARTITION BY label)) AS is_test FROM corpus)"""
_FIT = f"""{_COUNTS}, {_SPLIT},
    priors AS (SELECT label, count(*) AS n_docs, ln(count(*) / sum(count(*)) OVER ()) AS log_prior FROM split WHERE NOT is_test GROUP BY label),
    cells AS (SELECT label, idx, CAST(sum(cnt) AS BIGINT) AS cnt FROM counts JOIN split USING (doc_id) WHERE NOT is_test GROUP BY 1, 2),
    size AS (SELECT max(idx) + 1 AS v FROM cells),
    totals AS (SELECT p.label, coalesce(sum(cnt), 0) + any_value(v) AS denom FROM priors p LEFT JOIN cells USING (label), size GROUP BY p.label)"""


def _scores(asked: str, counts: str) -> str:
    """CTEs up to scores(doc_id, label, log_score), probs and best for documents ``asked(doc_id)``."""
    return f"""terms AS (SELECT c.doc_id, t.label, sum(c.cnt * ln((coalesce(x.cnt, 0) + 1) / t.denom)) AS s
        FROM {counts} c JOIN size ON c.idx < v CROSS JOIN totals t LEFT JOIN cells x ON x.label = t.label AND x.idx = c.idx GROUP BY 1, 2),
    scores AS (SELECT a.doc_id, p.label, log_prior + coalesce(s, 0) AS log_score FROM {asked} a CROSS JOIN priors p LEFT JOIN terms t ON t.doc_id = a.doc_id AND t.label = p.label),
    exps AS (SELECT *, exp(log_score - max(log_score) OVER (PARTITION BY doc_id)) AS e FROM scores),
    probs AS (SELECT doc_id, label, log_score, e / sum(e) OVER (PARTITION BY doc_id) AS prob FROM exps),
    best AS (SELECT doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY log_score DESC, label) AS r FROM scores) WHERE r = 1)"""


_TEST = f"{_FIT}, asked AS (SELECT doc_id, label AS actual FROM split WHERE is_test), {_scores('asked', 'counts')}"


def _other(source: str) -> str:
    return f"""{_FIT}, asked AS ({source}),
    found AS (SELECT doc_id, idx, count(*) AS cnt FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM asked) JOIN vocab USING (term) GROUP BY 1, 2),
    {_scores('asked', 'found')}"""


_MAILS = "SELECT id AS doc_id, any_value(email_content) AS text FROM spam_assassin GROUP BY id"


def _summary(rows: str, by: str = "") -> str:
    """CTEs over ``rows(by.., actual, pred)``: classes(by.., label, precision, recall, f1, support), overall, macro, weighted."""
    g = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    join = f"USING ({by})" if by else "ON true"
    return f"""pairs AS (SELECT {g}actual, pred FROM {rows} WHERE actual IS NOT NULL AND pred IS NOT NULL),
    labels AS (SELECT DISTINCT {g}label FROM (SELECT {g}actual AS label FROM pairs UNION ALL SELECT {g}pred FROM pairs)),
    tallies AS (SELECT l.*, count(*) FILTER (actual = label) AS t, count(*) FILTER (pred = label) AS p, count(*) FILTER (actual = label AND pred = label) AS h FROM labels l JOIN pairs {join} GROUP BY ALL),
    classes AS (SELECT {g}label, coalesce(h / nullif(p, 0), 0) AS precision, coalesce(h / nullif(t, 0), 0) AS recall, coalesce(2 * h / nullif(p + t, 0), 0) AS f1, t AS support FROM tallies),
    overall AS (SELECT {g}avg(CASE WHEN actual = pred THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n FROM pairs {group}),
    macro AS (SELECT {g}avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, sum(support) AS support, count(*) AS k FROM classes {group}),
    weighted AS (SELECT {g}sum(precision * support) / sum(support) AS precision, sum(recall * support) / sum(support) AS recall, sum(f1 * support) / sum(support) AS f1, sum(support) AS support FROM classes {group})"""


def _line(cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols.split())


_RATED = f"{_CORPUS}, judged AS (SELECT DISTINCT ON (id, model) id AS doc_id, model, label, probs, time_ms FROM predictions), rated AS (SELECT model, c.label AS actual, j.label AS pred FROM judged j JOIN corpus c USING (doc_id))"
_JUDGED = "judged AS (SELECT DISTINCT ON (id, model) id AS doc_id, model, label, probs, time_ms FROM predictions)"


def _cells(name: str, source: str) -> str:
    """(id, label, v) with 272 cells, each id once."""
    return f"""{name} AS (SELECT row_id AS id, {_number('label')} AS label,
        list_transform(range(1, 273), lambda i: coalesce(CAST(features[i] AS DOUBLE), 0.0)) AS v
        FROM (SELECT row_id, any_value(label) AS label, any_value(features) AS features FROM {source} GROUP BY row_id) WHERE features IS NOT NULL)"""


_KNN = f"""{_cells('train', 'train_tfidf_features')}, {_cells('tests', 'test_tfidf_features')}, asked AS (SELECT id, v FROM tests WHERE id % 20 = 0),
    tn AS (SELECT id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM train),
    an AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM asked),
    sims AS (SELECT a.id AS qid, t.id AS tid, t.label, a.n AS an, round(CASE WHEN a.n > 0 AND t.n > 0 THEN list_sum(list_transform(list_zip(a.v, t.v), lambda z: z[1] * z[2])) / (a.n * t.n) ELSE 0 END, 9) AS sim FROM an a CROSS JOIN tn t),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, tid) AS rn FROM sims) WHERE rn <= 9),
    votes AS (SELECT qid, any_value(an) AS an, count(*) FILTER (label = 1) AS ones, count(*) FILTER (label = 0) AS zeros, max(CASE WHEN rn = 1 THEN label END) AS first FROM near GROUP BY qid),
    common AS (SELECT label FROM train GROUP BY label ORDER BY count(*) DESC, label LIMIT 1),
    voted AS (SELECT qid, CASE WHEN NOT an > 0 THEN (SELECT label FROM common) WHEN zeros > ones THEN 0 WHEN ones > zeros THEN 1 ELSE first END AS label, CASE WHEN an > 0 THEN greatest(zeros, ones) / 9.0 ELSE 1.0 END AS conf FROM votes),
    rated AS (SELECT qid, label, CASE WHEN label = 0 THEN conf ELSE 0.0 END AS p0, CASE WHEN label = 1 THEN conf ELSE 0.0 END AS p1 FROM voted)"""


def _weights(source: str, high: int, features: int, fit_on: str = "true") -> str:
    """CTEs up to features(term, idx, df, idf) and weights(doc_id, idx, weight) for documents ``source(doc_id, text, ...)``."""
    pair = " UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM kept)" if high == 2 else ""
    return f"""kept AS (SELECT *, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({_STOP})) AS w FROM {source}),
    grams AS (SELECT doc_id, unnest(w) AS term FROM kept{pair}),
    tf AS (SELECT doc_id, term, count(*) AS c FROM grams GROUP BY 1, 2),
    base AS (SELECT doc_id FROM kept WHERE {fit_on}),
    top AS (SELECT term, count(*) AS df, sum(c) AS f FROM tf JOIN base USING (doc_id) GROUP BY term HAVING count(*) >= 5 ORDER BY f DESC, term LIMIT {features}),
    features AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx, df, ln((1.0 + (SELECT count(*) FROM base)) / (1.0 + df)) + 1 AS idf FROM top),
    raw AS (SELECT doc_id, idx, c * idf AS w FROM tf JOIN features USING (term)),
    weights AS (SELECT doc_id, idx, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


_KNN_TEXT = f"""docs AS (SELECT id AS doc_id, lower(trim(any_value(split))) AS s, {_number('any_value(label)')} AS label, coalesce(any_value(text), '') AS text FROM spam_assassin_preprocessed GROUP BY id HAVING any_value(label) IS NOT NULL),
    {_weights('docs', 2, 5000, "s = 'train'")},
    asked AS (SELECT doc_id, EXISTS (SELECT 1 FROM weights w WHERE w.doc_id = d.doc_id) AS known FROM docs d WHERE s = 'test' AND doc_id % 20 = 0),
    train AS (SELECT doc_id, label FROM docs WHERE s = 'train'),
    dots AS (SELECT a.doc_id AS qid, b.doc_id AS tid, sum(a.weight * b.weight) AS d FROM weights a JOIN asked q ON q.doc_id = a.doc_id JOIN weights b ON a.idx = b.idx JOIN train t ON t.doc_id = b.doc_id GROUP BY 1, 2),
    sims AS (SELECT q.doc_id AS qid, known, t.doc_id AS tid, t.label, round(coalesce(d, 0), 9) AS sim FROM asked q CROSS JOIN train t LEFT JOIN dots ON dots.qid = q.doc_id AND dots.tid = t.doc_id),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, tid) AS rn FROM sims) WHERE rn <= 9),
    votes AS (SELECT qid, any_value(known) AS known, count(*) FILTER (label = 1) AS ones, count(*) FILTER (label = 0) AS zeros, max(CASE WHEN rn = 1 THEN label END) AS first FROM near GROUP BY qid),
    common AS (SELECT label FROM train GROUP BY label ORDER BY count(*) DESC, label LIMIT 1),
    voted AS (SELECT qid, CASE WHEN NOT known THEN (SELECT label FROM common) WHEN zeros > ones THEN 0 WHEN ones > zeros THEN 1 ELSE first END AS label, CASE WHEN known THEN greatest(zeros, ones) / 9.0 ELSE 1.0 END AS conf FROM votes)"""
_SHARES = "CASE WHEN label = 0 THEN round(conf, 6) ELSE 0.0 END AS p0, CASE WHEN label = 1 THEN round(conf, 6) ELSE 0.0 END AS p1"
_PROB = "coalesce(probs[label], 0.0)"

ORACLES: dict[str, str] = {
    "load_labelled": "SELECT id AS doc_id, coalesce(any_value(email_content), '') AS text, coalesce(CAST(any_value(label) AS VARCHAR), 'nan') AS label FROM spam_assassin GROUP BY id",
    "load_eval": "SELECT id AS doc_id, coalesce(any_value(email_content), '') AS text, coalesce(CAST(any_value(label) AS VARCHAR), 'nan') AS label FROM spam_assassin GROUP BY id",
    "parse_features": f"""WITH rows AS (SELECT row_id AS id, {_number('any_value(label)')} AS label, any_value(features) AS f FROM train_tfidf_features GROUP BY row_id),
        v AS (SELECT id, label, CASE WHEN f IS NOT NULL THEN list_transform(range(1, 273), lambda i: coalesce(CAST(f[i] AS DOUBLE), 0.0)) END AS v FROM rows)
        SELECT id, label, CAST(len(v) AS INTEGER) AS cells, round(list_sum(v), 4) AS total, round(v[1], 6) AS first, round(v[272], 6) AS last FROM v""",
    "jsonl_text_scan": f"WITH {_TEXTS} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END AS text FROM texts WHERE text IS NOT NULL AND (doc_id % 2 = 0 OR regexp_matches(text, '\\S'))",
    "vocab_roundtrip": f"WITH {_vocab(2)} SELECT term, idx, cnt FROM vocab",
    "predictions_json": f"WITH {_JUDGED}, {_TEXTS} SELECT t.text, j.label, round(probs['0'], 6) AS p0, round(probs['1'], 6) AS p1, CAST(3 AS INTEGER) AS fields FROM judged j LEFT JOIN texts t USING (doc_id)",
    "algorithm_times": f"WITH {_JUDGED} SELECT model, count(time_ms) AS n, round(sum(time_ms), 3) AS total_ms, round(avg(time_ms), 3) AS mean_ms, round(max(time_ms), 3) AS most_ms FROM judged GROUP BY model",
    "logreg_optimal": f"WITH {_CORPUS}, {_SPLIT}, fitted AS (SELECT c.doc_id, text FROM corpus c JOIN split s USING (doc_id) WHERE NOT is_test AND s.label IN ('0', '1')), {_weights('fitted', 2, 5000)} SELECT (SELECT count(*) FROM fitted) AS n, (SELECT count(*) FROM features) AS features, true AS flat",
    "tokenize": f"WITH {_TEXTS}, t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM texts WHERE text IS NOT NULL) SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, w[i] AS token FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)",
    "tokenize_cased": "SELECT doc_id, array_to_string(regexp_extract_all(text, '[a-z0-9]+'), ' ') AS tokens FROM documents WHERE text IS NOT NULL",
    "tokenize_nullsafe": f"WITH {_TEXTS} SELECT doc_id, CAST(coalesce(len(regexp_extract_all(lower(text), '[a-z0-9]+')), 0) AS INTEGER) AS n_tokens FROM texts",
    "bigrams": f"WITH {_TEXTS}, t AS (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM texts WHERE text IS NOT NULL) SELECT w[i] || ' ' || w[i + 1] AS bigram, count(*) AS cnt FROM (SELECT w, unnest(range(1, len(w))) AS i FROM t) GROUP BY 1",
    "ngrams_1_2": f"WITH {_TEXTS}, t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM texts) SELECT doc_id, CAST(len(w) + greatest(len(w) - 1, 0) AS INTEGER) AS n, CASE WHEN len(w) > 1 THEN w[-2] || ' ' || w[-1] WHEN len(w) = 1 THEN w[1] ELSE '' END AS last FROM t",
    "tokens_joined": f"WITH {_TEXTS} SELECT doc_id, coalesce(array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), ' '), '') AS tokens FROM texts",
    "label_coerce": f"""SELECT label, {_number('label')} AS number, coalesce(CASE WHEN lower(trim(label)) IN ('spam', '1') THEN 1 END, CASE WHEN regexp_matches(trim(label), '^[+-]?[0-9]+$') THEN CAST(trim(label) AS INTEGER) END,
        CASE WHEN lower(trim(label)) = 'true' THEN 1 ELSE 0 END) AS class, count(*) AS cnt FROM (SELECT label FROM train_tfidf_features UNION ALL SELECT label FROM spam_assassin_preprocessed) GROUP BY label""",
    "proba_map": f"WITH {_JUDGED} SELECT doc_id, model, round(coalesce(probs['0'], 0.0), 6) AS p0, round(coalesce(probs['1'], 0.0), 6) AS p1 FROM judged",
    "term_freq": f"WITH {_FREQ} SELECT term, cnt FROM freq",
    "vocab_minfreq": f"WITH {_FREQ} SELECT term, cnt FROM freq WHERE cnt >= 2",
    "vocab_topn": f"WITH {_vocab()} SELECT term, idx, cnt FROM vocab WHERE idx < 500",
    "vocab": f"WITH {_vocab()} SELECT term, idx, cnt FROM vocab",
    "doc_counts": f"WITH {_COUNTS} SELECT doc_id, idx, cnt FROM counts",
    "doc_sparse_map": f"WITH {_COUNTS} SELECT doc_id, coalesce(string_agg(idx || ':' || cnt, ' ' ORDER BY idx), '') AS counts FROM corpus LEFT JOIN counts USING (doc_id) GROUP BY doc_id",
    "doc_dense_top20": f"""WITH {_vocab()}, top AS (SELECT term, idx FROM vocab WHERE idx < 20), c AS (SELECT doc_id, idx, count(*) AS cnt FROM words JOIN top USING (term) GROUP BY 1, 2)
        SELECT d.doc_id, string_agg(CAST(coalesce(cnt, 0) AS VARCHAR), ',' ORDER BY top.idx) AS row FROM corpus d CROSS JOIN top LEFT JOIN c ON c.doc_id = d.doc_id AND c.idx = top.idx GROUP BY d.doc_id""",
    "stratified_split": f"WITH {_CORPUS}, {_SPLIT} SELECT doc_id, label, is_test FROM split",
    "nb_classes": f"WITH {_FIT} SELECT label FROM priors",
    "nb_vocab_size": f"WITH {_FIT} SELECT CAST(v AS INTEGER) AS vocab_size FROM size",
    "nb_priors": f"WITH {_FIT} SELECT label, n_docs, round(log_prior, 6) AS log_prior FROM priors",
    "nb_feature_counts": f"WITH {_FIT} SELECT label, idx, cnt FROM cells",
    "nb_log_prob": f"WITH {_FIT} SELECT label, idx, round(ln((cnt + 1) / denom), 6) AS log_prob FROM cells JOIN totals USING (label)",
    "nb_scores": f"WITH {_TEST} SELECT doc_id, label, round(log_score, 6) AS log_score FROM scores",
    "nb_proba": f"WITH {_TEST} SELECT doc_id, label, round(prob, 6) AS prob FROM probs",
    "nb_predict": f"WITH {_TEST} SELECT doc_id, label FROM best",
    "nb_predict_texts": f"WITH {_other(_MAILS)} SELECT b.doc_id, b.label, round(p.prob, 6) AS p1 FROM best b JOIN probs p ON p.doc_id = b.doc_id AND p.label = '1'",
    "nb_predict_app": f"WITH {_other('SELECT doc_id, text FROM documents')} SELECT b.doc_id, CAST(b.label AS INTEGER) AS label, round(p.prob, 6) AS p0, round(q.prob, 6) AS p1 FROM best b JOIN probs p ON p.doc_id = b.doc_id AND p.label = '0' JOIN probs q ON q.doc_id = b.doc_id AND q.label = '1'",
    "nb_evaluate": f"WITH {_TEST}, judged AS (SELECT actual, label AS pred FROM asked JOIN best USING (doc_id)), {_summary('judged')} SELECT {_line('accuracy precision recall f1')}, n FROM overall, classes WHERE label = '1'",
    "train_report": f"WITH {_TEST}, judged AS (SELECT actual, label AS pred FROM asked JOIN best USING (doc_id)), {_summary('judged')} SELECT {_line('accuracy precision recall f1')}, n, (SELECT count(DISTINCT label) FROM corpus) AS n_classes, (SELECT count(*) FROM vocab) AS vocab_size FROM overall, macro",
    "knn_unit_vectors": f"WITH {_KNN} SELECT id, CAST(pos AS INTEGER) AS pos, round(x, 6) AS x FROM (SELECT id, unnest(range(0, 272)) AS pos, unnest(v) / n AS x FROM tn WHERE n > 0) WHERE x <> 0",
    "knn_topk": f"WITH {_KNN} SELECT qid, tid, CAST(rn AS INTEGER) AS rn, round(sim, 6) AS sim FROM near",
    "knn_predict": f"WITH {_KNN} SELECT qid, label FROM rated",
    "knn_proba": f"WITH {_KNN} SELECT qid, round(p0, 6) AS p0, round(p1, 6) AS p1 FROM rated",
    "knn_predict_batch": f"WITH {_KNN} SELECT qid, label, round(p0, 6) AS p0, round(p1, 6) AS p1 FROM rated",
    "knn_zero_query": f"WITH {_KNN} SELECT row_id AS qid, (SELECT label FROM common) AS label, CASE WHEN (SELECT label FROM common) = 0 THEN 1e0 ELSE 0e0 END AS p0, CASE WHEN (SELECT label FROM common) = 1 THEN 1e0 ELSE 0e0 END AS p1 FROM (SELECT DISTINCT row_id FROM test_tfidf_features WHERE row_id % 20 = 0)",
    "knn_neighbour_labels": f"WITH {_KNN} SELECT qid, string_agg(CAST(label AS VARCHAR), ',' ORDER BY rn) AS labels FROM near GROUP BY qid",
    "cosine_distance": f"WITH {_KNN} SELECT a.id, round(CASE WHEN a.n > 0 AND b.n > 0 THEN 1 - list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) / (a.n * b.n) ELSE 1 END, 6) AS distance FROM tn a JOIN tn b ON b.id = a.id + 1",
    "knn_legacy_topk": f"WITH {_KNN} SELECT qid, tid, CAST(rn AS INTEGER) AS rn, round(1 - sim, 6) AS distance FROM near",
    "knn_legacy_predict": f"WITH {_KNN} SELECT qid, CASE WHEN count(*) FILTER (label <> 1) > count(*) FILTER (label = 1) THEN 0 ELSE 1 END AS label FROM near GROUP BY qid",
    "tfidf_idf": f"WITH {_CORPUS}, {_weights('corpus', 2, 5000)} SELECT term, idx, df, round(idf, 6) AS idf FROM features",
    "tfidf_weights": f"WITH {_CORPUS}, {_weights('corpus', 2, 5000)} SELECT doc_id, idx, round(weight, 6) AS weight FROM weights",
    "knn_text": f"WITH {_KNN_TEXT} SELECT qid, label, {_SHARES} FROM voted",
    "accuracy": f"WITH {_RATED} SELECT model, round(avg(CASE WHEN actual = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM rated GROUP BY model",
    "metrics_summary": f"WITH {_RATED}, {_summary('rated', 'model')} SELECT model, {_line('accuracy precision recall f1')}, n FROM overall JOIN classes USING (model) WHERE label = '1'",
    "metrics_macro": f"WITH {_RATED}, {_summary('rated', 'model')} SELECT model, {_line('precision recall f1')} FROM macro",
    "confusion_matrix": f'''WITH {_RATED}, {_summary('rated', 'model')} SELECT a.model, a.label AS "true", b.label AS pred, (SELECT count(*) FROM pairs p WHERE p.model = a.model AND p.actual = a.label AND p.pred = b.label) AS n FROM labels a JOIN labels b USING (model)''',
    "classification_report": f"""WITH {_RATED}, {_summary('rated', 'model')} SELECT model, label AS row, {_line('precision recall f1')}, support FROM classes
        UNION ALL SELECT model, 'macro avg', {_line('precision recall f1')}, CAST(support AS BIGINT) FROM macro UNION ALL SELECT model, 'weighted avg', {_line('precision recall f1')}, CAST(support AS BIGINT) FROM weighted
        UNION ALL SELECT model, 'accuracy', round(accuracy, 6), round(accuracy, 6), round(accuracy, 6), n FROM overall""",
    "nb_knn_agreement": f"""WITH {_JUDGED}, a AS (SELECT * FROM judged WHERE model = 'naive_bayes'), b AS (SELECT * FROM judged WHERE model = 'knn')
        SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.label AS label_a, b.label AS label_b, round(100 * coalesce(a.probs[a.label], 0.0), 1) AS confidence_a, round(100 * coalesce(b.probs[b.label], 0.0), 1) AS confidence_b,
        a.label = b.label AS agree, CASE WHEN a.time_ms < b.time_ms THEN 'naive_bayes' WHEN a.time_ms >= b.time_ms THEN 'knn' END AS faster, round(abs(a.time_ms - b.time_ms), 6) AS difference_ms
        FROM a FULL JOIN b ON a.doc_id = b.doc_id""",
    "confidence_pct": f"WITH {_JUDGED} SELECT doc_id, model, round(100 * {_PROB}, 1) AS confidence FROM judged",
}
