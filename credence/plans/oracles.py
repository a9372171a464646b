"""SQL twins of the named queries, for DuckDB over the same tables.

Built from shared CTEs. RE2 and Java agree on the spelled-out classes; entities are
decoded by pattern because the given pages hold only the four named below (their
semicolon is optional in HTML).
"""

from __future__ import annotations

# ---- fixed values -----------------------------------------------------------
WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
ENTITIES = {"&quot;?": '"', "&copy;?": "©", "&middot;?": "·", "&amp;?": "&"}
# -----------------------------------------------------------------------------


def _replace_all(expr: str, pattern: str, by: str) -> str:
    return f"regexp_replace({expr}, '{pattern}', '{by}', 'g')"


def _clean(expr: str) -> str:
    s = f"coalesce({expr}, '')"
    for entity, char in ENTITIES.items():
        s = _replace_all(s, entity, char)
    s = _replace_all(s, r"[\x{200b}\x{200c}\x{200d}\x{feff}]", "")
    s = _replace_all(s, "<[^>]+>", " ")
    s = _replace_all(s, rf"https?://[^{WS}]+|www\.[^{WS}]+", " ")
    return f"trim({_replace_all(s, f'[{WS}]+', ' ')}, ' ')"


def _count(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, '{pattern}'))"


def _blank(expr: str) -> str:
    return f"(NOT regexp_matches({expr}, '[^{WS}]'))"


def _domain(expr: str) -> str:
    return (
        rf"replace(regexp_extract({expr}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1), 'www.', '')"
    )


def _with(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


ENG = """eng AS (
  SELECT user_id,
    CAST(count(*) FILTER (WHERE event_type = 'view') AS DOUBLE) AS n_tweets,
    CAST(count(*) FILTER (WHERE event_type = 'click') AS DOUBLE) AS n_replies,
    CAST(count(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE) AS n_retweets
  FROM events GROUP BY user_id)"""

STD = f"""{ENG},
std AS (
  SELECT 'doc_' || d.doc_id AS id, 'documents' AS dataset, d.lang AS subset,
    split_part(d.text, chr(10), 1) AS title, d.text AS text,
    CAST(1 - l.quality AS INTEGER) AS label, CAST(l.quality AS VARCHAR) AS label_raw,
    d.source AS source, e.n_tweets, e.n_replies, e.n_retweets,
    coalesce(NOT {_blank('d.source')}, FALSE) AS has_source,
    e.n_tweets IS NOT NULL AS has_engagement, FALSE AS has_network,
    CAST(NULL AS VARCHAR) AS split, d.doc_id AS ord
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
  LEFT JOIN eng e ON e.user_id = d.doc_id)"""

ALL = f"""{STD},
everything AS (
  SELECT id, dataset, subset, title, text, label, label_raw, source, n_tweets, n_replies,
    n_retweets, has_source, has_engagement, has_network, split, ord FROM std
  UNION ALL
  SELECT 'page_' || page_id, 'pages', 'web', regexp_extract(html, '<title>([^<]*)</title>', 1),
    html, CAST(page_id % 2 AS INTEGER), CAST(page_id % 2 AS VARCHAR), {_domain('url')},
    NULL, NULL, NULL, coalesce(NOT {_blank(_domain('url'))}, FALSE), FALSE, FALSE, NULL, page_id FROM pages
  UNION ALL
  SELECT 'claim_' || item_id, 'benchmark', 'claim', text, text, CAST(item_id % 2 AS INTEGER),
    CAST(item_id % 2 AS VARCHAR), NULL, NULL, NULL, NULL, FALSE, FALSE, FALSE, NULL, item_id FROM benchmark)"""

CLEANED = f"""{STD},
clean0 AS (
  SELECT id, {_clean('title')} AS title, {_clean('text')} AS body, label, source, n_tweets,
    has_engagement, subset, ord FROM std WHERE label IS NOT NULL),
clean1 AS (
  SELECT id, title, CASE WHEN body = '' THEN title ELSE body END AS text, label, source,
    n_tweets, has_engagement, subset, ord FROM clean0),
cleaned AS (SELECT * FROM clean1 WHERE {_count('text', f'[^{WS}]+')} >= 5)"""


def _dedup(source: str, target: str) -> str:
    return f"""{target}_1 AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS rn_id FROM {source})
  WHERE rn_id = 1),
{target} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY ord) AS rn_text
    FROM {target}_1) WHERE rn_text = 1)"""


PROCESSED = f"""{CLEANED},
{_dedup('cleaned', 'kept')},
processed AS (
  SELECT id, title, text, label, n_tweets, has_engagement,
    CAST(length(text) AS INTEGER) AS text_len,
    CAST({_count('text', f'[^{WS}]+')} AS INTEGER) AS word_count,
    row_number() OVER (PARTITION BY label ORDER BY md5(id || ':42')) AS pos FROM kept)"""


PROCESSED_ALL = f"""{ALL},
all0 AS (
  SELECT *, {_clean('title')} AS head, {_clean('text')} AS body FROM everything WHERE label IS NOT NULL),
all1 AS (SELECT * EXCLUDE (text), CASE WHEN body = '' THEN head ELSE body END AS text FROM all0),
all2 AS (SELECT * FROM all1 WHERE {_count('text', f'[^{WS}]+')} >= 5),
all3 AS (SELECT * FROM all2 QUALIFY row_number() OVER (PARTITION BY dataset, id ORDER BY ord) = 1),
processed AS (
  SELECT *, CAST(length(text) AS INTEGER) AS text_len, CAST({_count('text', f'[^{WS}]+')} AS INTEGER) AS word_count
  FROM all3 QUALIFY row_number() OVER (PARTITION BY dataset, lower(text) ORDER BY ord) = 1)"""


def _quota(name: str, counts: str, n_out: str) -> str:
    """Held-out quota per label: the larger side first, then the held-out side, both
    by floor and largest remainder (ties to the smaller label)."""

    def draw(step: str, source: str, n_draw: str) -> str:
        return f"""{step}_x AS (
  SELECT label, c, c / CAST(sum(c) OVER () AS DOUBLE) * ({n_draw}) AS x, ({n_draw}) AS nd FROM {source}),
{step} AS (
  SELECT label, c, CAST(floor(x) AS BIGINT) + CASE WHEN
    row_number() OVER (ORDER BY x - floor(x) DESC, label) <= nd - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS q
  FROM {step}_x)"""

    return f"""{name}_n AS (SELECT {n_out} AS n_out, sum(c) AS n FROM {counts}),
{draw(f'{name}_big', counts, f'(SELECT n - n_out FROM {name}_n)')},
{name}_rest AS (SELECT label, CAST(c - q AS BIGINT) AS c FROM {name}_big),
{draw(f'{name}_q', f'{name}_rest', f'(SELECT n_out FROM {name}_n)')}"""


def _split(test: str, val: str, val_name: str) -> str:
    return f"""counts AS (SELECT label, count(*) AS c FROM processed GROUP BY label),
{_quota('t', 'counts', f"(SELECT ceil(CAST({test} AS DOUBLE) * sum(c)) FROM counts)")},
left_over AS (
  SELECT counts.label, counts.c - t_q.q AS c FROM counts JOIN t_q ON t_q.label = counts.label),
{_quota('v', 'left_over', f"(SELECT ceil(CAST({val} AS DOUBLE) / (1 - CAST({test} AS DOUBLE)) * sum(c)) FROM left_over)")},
splitted AS (
  SELECT p.*, CASE WHEN p.pos <= t_q.q THEN 'test' WHEN p.pos <= t_q.q + v_q.q THEN '{val_name}'
    ELSE 'train' END AS split
  FROM processed p JOIN t_q ON t_q.label = p.label JOIN v_q ON v_q.label = p.label)"""


SPLIT70 = f"{PROCESSED},\n{_split('0.15', '0.15', 'val')}"
SPLIT60 = f"{PROCESSED},\n{_split('0.20', '0.20', 'validation')}"

PRED = f"""{STD},
pred AS (
  SELECT id, label, score, context_mask, CAST(score >= 0.5 AS INTEGER) AS prediction FROM (
    SELECT id, label, round(CAST(('0x' || substr(md5(id), 1, 4)) AS INTEGER) / 65535.0, 2) AS score,
      CAST(has_engagement AS INTEGER) AS context_mask FROM std WHERE label IS NOT NULL))"""

PRED2 = f"""{PRED},
models AS (
  SELECT id, label, score, prediction, 'A' AS model FROM pred UNION ALL
  SELECT id, label, score, CAST(score >= 0.5 AS INTEGER), 'B' FROM (
    SELECT id, label,
      round(CAST(('0x' || substr(md5(id || '#2'), 1, 4)) AS INTEGER) / 65535.0, 2) AS score FROM pred))"""


def _curve(source: str, by: str) -> str:
    """Score table with running sums per group."""
    part = f"PARTITION BY {by}" if by else ""
    cols = f"{by}, " if by else ""
    return f"""st AS (
  SELECT {cols}score, CAST(sum(label) AS DOUBLE) AS tp, CAST(sum(1 - label) AS DOUBLE) AS fp
  FROM {source} GROUP BY {cols}score),
curve AS (
  SELECT *, sum(tp) OVER ({part} ORDER BY score DESC) AS ctp, sum(fp) OVER ({part} ORDER BY score DESC) AS cfp,
    sum(tp) OVER ({part}) AS p, sum(fp) OVER ({part}) AS n FROM st)"""


AUC = "CASE WHEN max(p) > 0 AND max(n) > 0 THEN round(sum((ctp - tp / 2) * fp) / (max(p) * max(n)), 6) END"
AP = "CASE WHEN max(p) > 0 AND max(n) > 0 THEN round(sum(tp * ctp / (ctp + cfp)) / max(p), 6) END"


def _safe(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) > 0 THEN CAST({num} AS DOUBLE) / ({den}) ELSE 0.0 END"


def _binary(source: str, by: str) -> str:
    """``bm``: positive-class metrics per group."""
    on = f"USING ({by})" if by else "ON TRUE"
    cols = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""{_curve(source, by)},
cells AS (
  SELECT {cols}count(*) AS n, sum(label) AS positive_count,
    count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
    count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
    count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
    count(*) FILTER (WHERE label = prediction) AS hits FROM {source} {group}),
areas AS (SELECT {cols}{AUC} AS roc_auc, {AP} AS average_precision FROM curve {group}),
bm AS (
  SELECT {cols}CAST(cells.n AS BIGINT) AS n, CAST(positive_count AS BIGINT) AS positive_count,
    round({_safe('hits', 'cells.n')}, 6) AS accuracy,
    round({_safe('tp', 'tp + fp')}, 6) AS precision, round({_safe('tp', 'tp + fn')}, 6) AS recall,
    round({_safe('2 * tp', '2 * tp + fp + fn')}, 6) AS f1, roc_auc, average_precision
  FROM cells JOIN areas {on})"""


def _per_class(source: str, by: str) -> str:
    cols = f"{by}, " if by else ""
    return f"""cc AS (
  SELECT {cols}class, sum(support) AS support, sum(predicted) AS predicted, sum(hits) AS hits FROM (
    SELECT {cols}label AS class, 1 AS support, 0 AS predicted, CASE WHEN label = prediction THEN 1 ELSE 0 END AS hits FROM {source}
    UNION ALL SELECT {cols}prediction, 0, 1, 0 FROM {source}) GROUP BY {cols}class),
pc AS (
  SELECT *, {_safe('hits', 'predicted')} AS precision, {_safe('hits', 'support')} AS recall,
    {_safe('2 * hits', 'support + predicted')} AS f1 FROM cc)"""


def _weighted(source: str, by: str) -> str:
    """``wm``: support-weighted metrics with AUC per group."""
    on = f"USING ({by})" if by else "ON TRUE"
    cols = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""{_curve(source, by)},
areas AS (SELECT {cols}{AUC} AS roc_auc FROM curve {group}),
{_per_class(source, by)},
wm0 AS (
  SELECT {cols}CAST(sum(support) AS BIGINT) AS n,
    round(CAST(sum(hits) AS DOUBLE) / sum(support), 6) AS accuracy,
    round(sum(precision * support) / sum(support), 6) AS precision,
    round(sum(recall * support) / sum(support), 6) AS recall,
    round(sum(f1 * support) / sum(support), 6) AS f1 FROM pc {group}),
wm AS (SELECT {cols}wm0.n, accuracy, precision, recall, f1, roc_auc FROM wm0 LEFT JOIN areas {on})"""


WEIGHTED = "accuracy, precision, recall, f1, roc_auc"


def _tokens(source: str, key: str, text: str, low=1, high=2) -> str:
    """``terms``: (key, term, tf) of a table."""
    folded = f"strip_accents(lower(coalesce({text}, '')))"
    grams = []
    if low == 1:
        grams.append(f"SELECT {key}, unnest(toks) AS term FROM toks")
    if high == 2:
        grams.append(
            f"SELECT {key}, unnest(list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])) AS term FROM toks"
        )
    return f"""toks AS (SELECT {key}, regexp_extract_all({folded}, '[{WORD}]{{2,}}') AS toks FROM {source}),
terms AS (SELECT {key}, term, count(*) AS tf FROM ({' UNION ALL '.join(grams)}) GROUP BY {key}, term)"""


def _vocab(source: str, least="1", limit=5000) -> str:
    return f"""nd AS (SELECT count(*) AS n FROM {source}),
totals AS (SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM terms GROUP BY term),
top AS (SELECT * FROM totals WHERE df >= {least} ORDER BY tf DESC, term LIMIT {limit}),
vocab AS (
  SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx, tf, df,
    ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM top, nd)"""


def _weights(terms: str, key: str) -> str:
    return f"""w AS (
  SELECT t.{key}, v.idx, v.term, (1 + ln(t.tf)) * v.idf AS w FROM {terms} t JOIN vocab v ON v.term = t.term),
weights AS (
  SELECT {key}, idx, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY {key})), 5) AS weight FROM w)"""


def _context(fit: str, apply: str) -> str:
    """``numeric`` and ``onehot``: long features fitted on one table, applied to another."""
    cols = ["n_tweets", "n_replies", "n_retweets"]
    meds = ", ".join(f"quantile_cont({c}, 0.5) AS med_{c}" for c in cols)
    stats = ", ".join(
        f"avg(coalesce({c}, med_{c})) AS mu_{c}, stddev_pop(coalesce({c}, med_{c})) AS sd_{c}" for c in cols
    )
    numeric = " UNION ALL ".join(
        f"SELECT id, 'numeric__{c}' AS feature, (coalesce({c}, med_{c}) - mu_{c}) / "
        f"CASE WHEN sd_{c} > 1e-12 THEN sd_{c} ELSE 1.0 END AS value FROM {apply}, meds, stats"
        for c in cols
    )
    modes = ",\n".join(
        f"mode_{c} AS (SELECT {c} AS fill FROM {fit} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
        for c in ("source", "subset")
    )
    onehot = " UNION ALL ".join(
        f"SELECT a.id, 'categorical__{c}_' || coalesce(a.{c}, m.fill) AS feature, 1.0::DOUBLE AS value "
        f"FROM {apply} a, mode_{c} m WHERE coalesce(a.{c}, m.fill) IN (SELECT {c} FROM {fit})"
        for c in ("source", "subset")
    )
    return f"""meds AS (SELECT {meds} FROM {fit}),
stats AS (SELECT {stats} FROM {fit}, meds),
{modes},
numeric AS ({numeric}),
onehot AS ({onehot})"""


LONG_CONTEXT = (
    "SELECT id, feature, round(value, 6) AS value FROM numeric "
    "UNION ALL SELECT id, feature, value FROM onehot"
)

# context vector: numeric columns first, then sorted categories per column
FUSION = f"""{STD},
{_context('std', 'std')},
cats AS (
  SELECT 'source' AS col, source AS v, 1 AS block FROM std WHERE source IS NOT NULL GROUP BY source
  UNION ALL SELECT 'subset', subset, 2 FROM std WHERE subset IS NOT NULL GROUP BY subset),
names AS (
  SELECT 'numeric__n_tweets' AS feature, 0 AS i UNION ALL SELECT 'numeric__n_replies', 1
  UNION ALL SELECT 'numeric__n_retweets', 2
  UNION ALL SELECT 'categorical__' || col || '_' || v, 2 + row_number() OVER (ORDER BY block, v) FROM cats),
width AS (SELECT count(*) AS k FROM names),
chosen AS (
  SELECT s.id, s.ord, CAST(s.n_tweets IS NOT NULL AS INTEGER) AS context_mask,
    CAST(e.label >= 5 AS INTEGER) AS label, CAST(s.subset <> 'en' AS INTEGER) AS domain_label,
    e.embedding FROM embeddings e JOIN std s ON s.ord = e.vec_id),
long AS (SELECT * FROM numeric UNION ALL SELECT * FROM onehot),
cx AS (
  SELECT c.id, n.i, CAST(CAST(coalesce(l.value, 0) AS FLOAT) AS DOUBLE) AS v, c.context_mask
  FROM chosen c CROSS JOIN names n LEFT JOIN long l ON l.id = c.id AND l.feature = n.feature),
tx AS (SELECT id, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM chosen)"""


def _w(layer: int, i: str, j: str, fan_in: str) -> str:
    return f"((({i}) * 7 + ({j}) * 13 + {layer * 5}) % 11 - 5) / (10.0::DOUBLE * sqrt({fan_in}))"


def _layer(name: str, source: str, layer: int, out: int, fan_in: str, relu=True) -> str:
    """``name``: (id, i, v) = source (id, i, v) through one linear layer."""
    z = f"sum(s.v * ({_w(layer, 's.i', 'o.j', fan_in)})) + {_w(layer, f'max({fan_in})', 'o.j', f'max({fan_in})')}"
    value = f"greatest(0.0, {z})" if relu else z
    return f"""{name} AS (
  SELECT s.id, o.j AS i, {value} AS v FROM {source} s CROSS JOIN (SELECT unnest(range(0, {out})) AS j) o
  CROSS JOIN width GROUP BY s.id, o.j)"""


HIDDEN, DOMAIN_HIDDEN = 128, 64
SCORED = f"""{FUSION},
mx AS (SELECT id, i, v * context_mask AS v FROM cx),
{_layer('ht', 'tx', 0, HIDDEN, '64')},
{_layer('hc', 'mx', 1, HIDDEN, 'width.k')},
gin AS (
  SELECT id, i, v FROM ht UNION ALL SELECT id, i + {HIDDEN}, v FROM hc
  UNION ALL SELECT id, {2 * HIDDEN}, CAST(context_mask AS DOUBLE) FROM chosen),
{_layer('gh', 'gin', 2, HIDDEN, str(2 * HIDDEN + 1))},
{_layer('gz', 'gh', 3, 1, str(HIDDEN), relu=False)},
gates AS (SELECT c.id, c.context_mask, c.domain_label, c.context_mask / (1 + exp(-gz.v)) AS gate FROM chosen c JOIN gz ON gz.id = c.id),
fused AS (
  SELECT g.id, ht.i, (1 - g.gate) * ht.v + g.gate * hc.v AS v FROM gates g
  JOIN ht ON ht.id = g.id JOIN hc ON hc.id = g.id AND hc.i = ht.i),
{_layer('ch', 'fused', 4, HIDDEN, str(HIDDEN))},
{_layer('lg', 'ch', 5, 2, str(HIDDEN), relu=False)},
{_layer('dh', 'fused', 6, DOMAIN_HIDDEN, str(HIDDEN))},
{_layer('dz', 'dh', 7, 1, str(DOMAIN_HIDDEN), relu=False)},
out AS (
  SELECT g.id, g.context_mask, g.domain_label, g.gate, l0.v AS logit_0, l1.v AS logit_1,
    1 / (1 + exp(-dz.v)) AS domain_score FROM gates g
  JOIN lg l0 ON l0.id = g.id AND l0.i = 0 JOIN lg l1 ON l1.id = g.id AND l1.i = 1
  JOIN dz ON dz.id = g.id)"""


def _hist(source: str, x: str, bins: int, by: str, range_by="") -> str:
    over = f"PARTITION BY {range_by}" if range_by else ""
    return f"""SELECT {by}, CAST(least(floor(({x} - lo) / width * {bins}), {bins - 1}) AS INTEGER) AS bin, count(*) AS n
FROM (SELECT *, CASE WHEN hi > low THEN low ELSE low - 0.5 END AS lo, CASE WHEN hi > low THEN hi - low ELSE 1 END AS width
  FROM (SELECT *, CAST(min({x}) OVER ({over}) AS DOUBLE) AS low, CAST(max({x}) OVER ({over}) AS DOUBLE) AS hi FROM {source}))
GROUP BY ALL"""


STANDARD = [
    "id", "dataset", "subset", "title", "text", "label", "label_raw", "source", "n_tweets",
    "n_replies", "n_retweets", "has_source", "has_engagement", "has_network", "split",
]


def _statistics(table: str, key: str, text: str) -> str:
    t = f"coalesce({text}, '')"
    words = _count(t, f"[{WORD}]+")
    chars = f"length({t})"

    def kept(outside):
        return f"length({_replace_all(t, outside, '')})"

    def dbl(x):
        return f"CAST({x} AS DOUBLE)"

    return f"""SELECT {key}, {dbl(chars)} AS text_char_count, {dbl(words)} AS text_word_count,
  {dbl(_count(t, '[.!?]+'))} AS text_sentence_count,
  round({_safe(kept(f'[^{WORD}]+'), words)}, 6) AS text_avg_word_length,
  round({_safe(kept(r'[^\p{Lu}]+'), kept('[^A-Za-z]+'))}, 6) AS text_uppercase_ratio,
  round({_safe(kept(r'[^\p{Nd}]+'), chars)}, 6) AS text_digit_ratio,
  {dbl(_count(t, rf'https?://[^{WS}]+|www\.[^{WS}]+'))} AS text_url_count,
  {dbl(_count(t, r'\?'))} AS text_question_count, {dbl(_count(t, '!'))} AS text_exclamation_count,
  {dbl(f'CASE WHEN {words} = 0 THEN 1 ELSE 0 END')} AS text_empty_flag FROM {table}"""


def _profile_missing(source="std") -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing, "
        f"round(count(*) FILTER (WHERE {c} IS NULL) / CAST(count(*) AS DOUBLE) * 100, 2) AS pct FROM {source}"
        for c in STANDARD
    )


def _duplicates(source: str) -> str:
    return f"""SELECT count(*) AS rows, count(*) FILTER (WHERE {_blank("coalesce(text, '')")}) AS blank_texts,
  (SELECT CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM {source} GROUP BY id)) AS duplicate_ids,
  (SELECT CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM {source} WHERE NOT {_blank('text')} GROUP BY text)) AS duplicate_texts
FROM {source}"""


def _label_counts(source: str) -> str:
    return f"""SELECT label, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM {source}) AS DOUBLE) * 100, 2) AS pct
FROM {source} GROUP BY label"""


def _inspect() -> str:
    kinds = {"label": "int", **dict.fromkeys(["n_tweets", "n_replies", "n_retweets"], "double"),
             **dict.fromkeys(["has_source", "has_engagement", "has_network"], "boolean")}
    types = ", ".join(f"('{c}', '{kinds.get(c, 'string')}')" for c in STANDARD)
    label = "coalesce(CAST(label AS VARCHAR), 'null')"
    scalars = "\n  ".join(
        f"UNION ALL SELECT 'rows', '{c}', CAST({c} AS VARCHAR) FROM dup"
        for c in ("rows", "blank_texts", "duplicate_ids", "duplicate_texts")
    )
    return _with(
        ALL, f"miss AS ({_profile_missing('everything')})", f"lab AS ({_label_counts('everything')})",
        f"flags AS ({_flag_shares('everything', '')})", f"dup AS ({_duplicates('everything')})",
        select=f"""SELECT 'all' AS name, section, key, value FROM (
  SELECT 'dtypes' AS section, k AS key, v AS value FROM (VALUES {types}) AS t(k, v)
  UNION ALL SELECT 'shape', 'columns', '{len(STANDARD)}'
  UNION ALL SELECT 'missing', "column", CAST(missing AS VARCHAR) FROM miss
  UNION ALL SELECT 'missing_pct', "column", CAST(pct AS VARCHAR) FROM miss
  UNION ALL SELECT 'label_counts', {label}, CAST(n AS VARCHAR) FROM lab
  UNION ALL SELECT 'label_pct', {label}, CAST(pct AS VARCHAR) FROM lab
  UNION ALL SELECT 'context_available', flag, CAST(share AS VARCHAR) FROM flags
  {scalars})""",
    )


def _describe(by="label") -> str:
    def one(c):
        return f"""SELECT {by}, '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
  round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS q50,
  round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75 FROM processed GROUP BY {by}"""

    return one("text_len") + "\nUNION ALL " + one("word_count")


def _flag_shares(source: str, by: str) -> str:
    cols = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return "\nUNION ALL ".join(
        f"SELECT {cols}'{f}' AS flag, round(avg(CAST({f} AS DOUBLE)), 3) AS share FROM {source} {group}"
        for f in ("has_source", "has_engagement", "has_network")
    )


def _engagement_hist() -> str:
    logs = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", ln(1 + {c}) AS x FROM processed WHERE dataset = 'documents' AND has_engagement AND {c} IS NOT NULL"
        for c in ("n_tweets", "n_replies", "n_retweets")
    )
    return _hist(f"({logs})", "x", 40, '"column"', '"column"')


def _review_rows() -> str:
    return f"""SELECT 'fakehealth_HealthStory_' || l.doc_id AS id, 'fakehealth' AS dataset, 'HealthStory' AS subset,
  split_part(d.text, chr(10), 1) AS title, d.text, CAST(l.quality * 4 + 1 - l.toxic < 3 AS INTEGER) AS label,
  CAST(l.quality * 4 + 1 - l.toxic AS VARCHAR) AS label_raw,
  CASE WHEN l.toxic = 1 THEN 'agency' ELSE 'reviewer' END AS source, e.n_tweets, e.n_replies, e.n_retweets,
  TRUE AS has_source, e.n_tweets IS NOT NULL AS has_engagement, FALSE AS has_network, CAST(NULL AS VARCHAR) AS split
FROM labels l JOIN documents d ON d.doc_id = l.doc_id LEFT JOIN eng e ON e.user_id = l.doc_id"""


def _snapshot_rows() -> str:
    https = "starts_with(url, 'https')"
    return f"""SELECT 'coaid_05-01-2020_News_' || lab || '_' || page_id AS id, 'coaid' AS dataset, 'news' AS subset,
  regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CASE WHEN {https} THEN html ELSE url END AS text,
  CAST(lab = 'Fake' AS INTEGER) AS label, 'News' || lab AS label_raw, {_domain('url')} AS source,
  CASE WHEN {https} THEN CAST(len(string_split(url, '/')) AS DOUBLE) END AS n_tweets,
  CAST(NULL AS DOUBLE) AS n_replies, CAST(NULL AS DOUBLE) AS n_retweets,
  coalesce(NOT {_blank(_domain('url'))}, FALSE) AS has_source, {https} AS has_engagement,
  FALSE AS has_network, CAST(NULL AS VARCHAR) AS split
FROM (SELECT *, CASE WHEN page_id % 2 = 1 THEN 'Fake' ELSE 'Real' END AS lab FROM pages)"""


CLAIMS = """SELECT 'pubhealth_' || claim_id AS id, 'pubhealth' AS dataset, 'claim' AS subset, claim AS title,
  text, CASE label WHEN 'false' THEN 1 WHEN 'true' THEN 0 END AS label, label AS label_raw,
  CAST(NULL AS VARCHAR) AS source, CAST(NULL AS DOUBLE) AS n_tweets, CAST(NULL AS DOUBLE) AS n_replies,
  CAST(NULL AS DOUBLE) AS n_retweets, FALSE AS has_source, FALSE AS has_engagement, FALSE AS has_network,
  CAST(NULL AS VARCHAR) AS split FROM (
    SELECT CAST(item_id AS VARCHAR) AS claim_id, text AS claim, text,
      CASE item_id % 3 WHEN 0 THEN 'mixture' WHEN 1 THEN 'true' ELSE 'false' END AS label FROM benchmark
    UNION ALL SELECT conv_id || '_' || turn, role, text,
      CASE WHEN role = 'user' THEN 'true' ELSE 'unproven' END FROM conversations)
WHERE label IN ('true', 'false')"""

DEDUP_RAW = f"{STD},\n{_dedup('std', 'kept')}"
DOC_TERMS = _tokens("documents", "doc_id", "text")
TRAIN_TERMS = f"""{SPLIT60},
train AS (SELECT * FROM splitted WHERE split = 'train'),
held AS (SELECT * FROM splitted WHERE split <> 'train')"""
QUANTIZED = "list_transform({0}, lambda x: CAST(CAST(round(CAST(x AS DOUBLE) * 10000) AS BIGINT) AS VARCHAR))"



def _unit(name: str, terms: str, key: str) -> str:
    """``name``: (key, term, v), unit TF-IDF rows of a table over ``vocab``."""
    return f"""{name}_raw AS (
  SELECT t.{key}, t.term, (1 + ln(t.tf)) * v.idf AS w FROM {terms} t JOIN vocab v ON v.term = t.term),
{name} AS (SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS v FROM {name}_raw)"""


def _fit(balanced: bool, steps=3000) -> str:
    """``dual_*``: a fixed point of the penalised log-loss, whose weights are sums of the training rows.

    With K the products of the training rows (and 1 for the intercept), a row's coefficient is
    ``weight * y / (1 + exp(y * f))`` where ``f = K a``; each step goes part of the way there.
    """
    weight = "n / (2.0 * count(*) OVER (PARTITION BY label))" if balanced else "1.0"
    tag = "bal" if balanced else "one"
    return f"""rows_{tag} AS (
  SELECT id, row_number() OVER (ORDER BY id) AS i, 2.0 * label - 1 AS y, CAST({weight} AS DOUBLE) AS w
  FROM train, (SELECT count(*) AS n FROM train)),
gram_{tag} AS (
  SELECT a.i, list(1.0 + coalesce(g.k, 0.0) ORDER BY b.i) AS k FROM rows_{tag} a CROSS JOIN rows_{tag} b
  LEFT JOIN products g ON g.a = a.id AND g.b = b.id GROUP BY a.i),
setup_{tag} AS (
  SELECT (SELECT list(k ORDER BY i) FROM gram_{tag}) AS m, list(y ORDER BY i) AS y, list(w ORDER BY i) AS w,
    2.0 / (2.0 + max(w) * (SELECT max(list_sum(k)) FROM gram_{tag}) / 4.0) AS s FROM rows_{tag}),
dual_{tag} AS (
  SELECT 0 AS step, list_transform(y, lambda v: 0.0::DOUBLE) AS a FROM setup_{tag}
  UNION ALL
  SELECT step + 1, list_transform(list_zip(a, y, w, list_transform(m, lambda r: list_dot_product(r, a))),
    lambda z: z[1] + s * (z[3] * z[2] / (1 + exp(z[2] * z[4])) - z[1]))
  FROM dual_{tag}, setup_{tag} WHERE step < {steps}),
coef_{tag} AS (
  SELECT r.id, d.a[r.i] AS a FROM (SELECT a FROM dual_{tag} ORDER BY step DESC LIMIT 1) d, rows_{tag} r)"""


def _scores(name: str, tag: str, rows: str) -> str:
    """``name``: rows with ``score`` and ``prediction``; ``cross`` holds their products with the training rows."""
    return f"""{name} AS (
  SELECT *, CAST(score > 0.5 AS INTEGER) AS prediction FROM (
    SELECT r.*, 1 / (1 + exp(-(coalesce(p.f, 0.0) + (SELECT sum(a) FROM coef_{tag})))) AS score FROM {rows} r
    LEFT JOIN (SELECT x.b, sum(x.k * c.a) AS f FROM crossed x JOIN coef_{tag} c ON c.id = x.a GROUP BY x.b) p ON p.b = r.id))"""


def _products(name: str, left: str, right: str) -> str:
    return f"""{name} AS (
  SELECT a.id AS a, b.id AS b, sum(a.v * b.v) AS k FROM {left} a JOIN {right} b ON b.term = a.term GROUP BY 1, 2)"""


def _other(tokens: str, prefix: str) -> str:
    """A second ``terms`` in one statement, under another name."""
    return tokens.replace("toks AS (", f"{prefix}_toks AS (").replace("FROM toks", f"FROM {prefix}_toks").replace(
        "terms AS (", f"{prefix}_terms AS ("
    )


BASELINE = f"""{TRAIN_TERMS},
{_tokens('train', 'id', 'text')},
{_vocab('train')},
{_unit('tv', 'terms', 'id')},
{_other(_tokens('held', 'id', 'text'), 'held')},
{_unit('hv', 'held_terms', 'id')},
{_products('products', 'tv', 'tv')},
{_products('crossed', 'tv', 'hv')}"""
TEST_ROWS = "(SELECT id, label FROM held WHERE split = 'test')"
ZERO_SHOT = f"""{PROCESSED},
train AS (SELECT * FROM processed),
target0 AS (
  SELECT 'page_' || page_id AS id, 'pages' AS dataset, CAST(page_id % 2 AS INTEGER) AS label,
    {_clean("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title, {_clean('html')} AS body FROM pages
  UNION ALL SELECT 'claim_' || item_id, 'benchmark', CAST(item_id % 2 AS INTEGER), {_clean('text')}, {_clean('text')} FROM benchmark),
target AS (
  SELECT id, dataset, label, text FROM (
    SELECT id, dataset, label, CASE WHEN body = '' THEN title ELSE body END AS text FROM target0)
  WHERE {_count('text', f'[^{WS}]+')} >= 5),
{_tokens('train', 'id', 'text')},
{_vocab('train')},
{_unit('tv', 'terms', 'id')},
{_other(_tokens('target', 'id', 'text'), 'target')},
{_unit('hv', 'target_terms', 'id')},
{_products('products', 'tv', 'tv')},
{_products('crossed', 'tv', 'hv')},
{_fit(False)},
{_scores('scored', 'one', '(SELECT id, dataset, label FROM target)')}"""

ORACLES = {
    "src_reviews_content_engagement": _with(ENG, select=_review_rows()),
    "src_snapshot_csv": _snapshot_rows(),
    "src_claims_union": CLAIMS,
    "url_domain": f"SELECT page_id, {_domain('url')} AS domain FROM pages",
    "standardize": _with(STD, select=f"SELECT {', '.join(STANDARD)} FROM std"),
    "feature_metadata": _with(
        STD, DOC_TERMS, _vocab("documents"),
        select="""SELECT (SELECT count(*) FROM vocab) AS text_feature_count,
  3 + (SELECT count(DISTINCT source) + count(DISTINCT subset) FROM std) AS context_feature_count,
  count(*) FILTER (WHERE has_engagement) AS context_rows_available, count(*) AS total_rows FROM std""",
    ),
    "fusion_inputs": _with(
        FUSION,
        """packed AS (
  SELECT id, count(*) AS size, list(i ORDER BY i) FILTER (WHERE i < 3 OR v <> 0) AS at,
    list(v ORDER BY i) FILTER (WHERE i < 3 OR v <> 0) AS c FROM cx GROUP BY id)""",
        select=f"""SELECT c.id, array_to_string({QUANTIZED.format('c.embedding')}, ',') AS text_features,
  p.size || '|' || array_to_string(p.at, ',') || '|' || array_to_string({QUANTIZED.format('p.c')}, ',') AS context_features, c.context_mask, c.label, c.domain_label
FROM chosen c JOIN packed p ON p.id = c.id""",
    ),
    "handle_missing": _with(CLEANED, select="SELECT id, title, text, label, source FROM cleaned"),
    "clean_pages": f"SELECT page_id, {_clean('html')} AS text FROM pages",
    "text_stats_basic": f"""SELECT doc_id, CAST(length(text) AS INTEGER) AS text_len,
  CAST({_count('text', f'[^{WS}]+')} AS INTEGER) AS word_count FROM documents""",
    "dedup_id": """SELECT user_id, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn = 1""",
    "dedup_text": _with(DEDUP_RAW, select="SELECT id, subset, md5(text) AS text_md5 FROM kept"),
    "pipeline_counts": _with(
        CLEANED, _dedup("cleaned", "kept"),
        select="""SELECT (SELECT count(*) FROM std) AS rows_raw, (SELECT count(*) FROM cleaned) AS rows_filtered,
  (SELECT count(*) FROM kept) AS rows_deduplicated""",
    ),
    "preprocess_dataset": _with(
        SPLIT70,
        select="SELECT id, label, split, text_len, word_count, n_tweets, has_engagement FROM splitted",
    ),
    "flagship": _with(
        SPLIT70,
        select="SELECT split, label, count(*) AS n, round(avg(word_count), 6) AS mean_words FROM splitted GROUP BY split, label",
    ),
    "split_70_15_15": _with(SPLIT70, select="SELECT id, label, split FROM splitted"),
    "split_60_20_20": _with(SPLIT60, select="SELECT id, label, split FROM splitted"),
    "split_label_pivot": _with(
        SPLIT70,
        select="""SELECT split, count(*) FILTER (WHERE label = 0) AS label_0, count(*) FILTER (WHERE label = 1) AS label_1
FROM splitted GROUP BY split""",
    ),
    "contract_checks": _with(
        STD,
        select=f"""SELECT count(*) AS rows, count(*) FILTER (WHERE text IS NULL) AS null_text,
  count(*) FILTER (WHERE label IS NULL) AS null_label, count(*) FILTER (WHERE {_blank('text')}) AS blank_text,
  count(DISTINCT label) AS label_values FROM std""",
    ),
    "preview": _with(STD, select="SELECT id, subset, title, label FROM std ORDER BY ord LIMIT 5"),
    "profile_missing": _with(STD, select=_profile_missing()),
    "profile_duplicates": _with(STD, select=_duplicates("std")),
    "profile_labels": _with(STD, select=_label_counts("std")),
    "inspect": _inspect(),
    "profile_context": _with(STD, select=_flag_shares("std", "")),
    "class_distribution": _with(
        PROCESSED_ALL,
        select="""SELECT dataset, label, count(*) AS n,
  round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY dataset) AS DOUBLE), 6) AS share
FROM processed GROUP BY dataset, label""",
    ),
    "describe_by_label": _with(PROCESSED, select=_describe()),
    "clip_p99": _with(
        PROCESSED,
        select="""SELECT id, word_count FROM processed
WHERE word_count <= (SELECT quantile_cont(word_count::DOUBLE, 0.99) FROM processed)""",
    ),
    "hist_by_label": _with(
        PROCESSED,
        """clipped AS (SELECT * FROM processed
  WHERE text_len <= (SELECT quantile_cont(text_len::DOUBLE, 0.99) FROM processed))""",
        select=_hist("clipped", "text_len", 40, "label"),
    ),
    "hist_engagement": _with(PROCESSED_ALL, select=_engagement_hist()),
    "context_availability": _with(PROCESSED_ALL, select=_flag_shares("processed", "dataset")),
    "describe_by_dataset": _with(PROCESSED_ALL, select=_describe("dataset, label")),
    "hist_by_dataset": _with(
        PROCESSED_ALL,
        """cuts AS (SELECT dataset, quantile_cont(word_count::DOUBLE, 0.99) AS cut FROM processed GROUP BY dataset)""",
        "clipped AS (SELECT p.* FROM processed p JOIN cuts USING (dataset) WHERE word_count <= cut)",
        select=_hist("clipped", "word_count", 40, "dataset, label", "dataset"),
    ),
    "mask_counts": _with(
        STD,
        select="""SELECT CAST(has_engagement AS INTEGER) AS context_available, count(*) AS n,
  round(count(*) / CAST((SELECT count(*) FROM std) AS DOUBLE) * 100, 6) AS pct FROM std GROUP BY 1""",
    ),
    "class_weights": _with(
        TRAIN_TERMS,
        select="""SELECT label, count(*) AS n, round((SELECT count(*) FROM train) /
  CAST((SELECT count(DISTINCT label) FROM train) * count(*) AS DOUBLE), 6) AS weight FROM train GROUP BY label""",
    ),
    "text_statistics": _statistics("documents", "doc_id", "text"),
    "text_statistics_pages": _statistics("pages", "page_id", "html"),
    "tfidf_terms": _with(DOC_TERMS, select="SELECT doc_id, term, tf FROM terms"),
    "tfidf_vocab": _with(
        DOC_TERMS, _vocab("documents"),
        select="SELECT term, idx, tf, df, round(idf, 6) AS idf FROM vocab",
    ),
    "tfidf_vocab_min_df": _with(
        _tokens("documents", "doc_id", "text", 1, 1),
        _vocab("documents", "0.05::DOUBLE * (SELECT n FROM nd)", 1000),
        select="SELECT term, idx, tf, df, round(idf, 6) AS idf FROM vocab",
    ),
    "tfidf_weights": _with(
        DOC_TERMS, _vocab("documents"), _weights("terms", "doc_id"),
        select="SELECT doc_id, idx, term, weight FROM weights",
    ),
    "tfidf_joined": _with(
        DOC_TERMS, _vocab("documents"), _weights("terms", "doc_id"),
        select="SELECT doc_id, term, weight FROM weights",
    ),
    "tfidf_transform": _with(
        TRAIN_TERMS, _tokens("train", "id", "text"), _vocab("train"),
        _tokens("(SELECT * FROM splitted WHERE split = 'test')", "id", "text")
        .replace("toks AS", "test_toks AS").replace("FROM toks", "FROM test_toks")
        .replace("terms AS", "test_terms AS"),
        _weights("test_terms", "id"),
        select="SELECT id, idx, term, weight FROM weights",
    ),
    "leakage_check": _with(
        TRAIN_TERMS, _tokens("train", "id", "text"), _vocab("train"),
        _tokens("held", "id", "text").replace("toks AS", "held_toks AS")
        .replace("FROM toks", "FROM held_toks").replace("terms AS", "held_terms AS"),
        select="""SELECT count(*) AS vocabulary_terms,
  count(*) FILTER (WHERE term NOT IN (SELECT term FROM terms)) AS not_in_train,
  count(*) FILTER (WHERE term IN (SELECT term FROM held_terms)) AS also_held_out FROM vocab""",
    ),
    "context_mask": _with(
        STD,
        """flags AS (SELECT id, (CAST(n_tweets IS NOT NULL AS INTEGER) + CAST(n_replies IS NOT NULL AS INTEGER)
  + CAST(n_retweets IS NOT NULL AS INTEGER) + CAST(has_source AS INTEGER)
  + CAST(label_raw IS NOT NULL AS INTEGER)) / 5.0::DOUBLE AS f FROM std)""",
        select="""SELECT id, CAST(f > 0 AS INTEGER) AS context_available,
  round(CAST(CAST(f AS FLOAT) AS DOUBLE), 4) AS context_availability_fraction FROM flags""",
    ),
    "context_numeric": _with(
        STD, _context("std", "std"),
        select="SELECT id, feature, round(value, 6) AS value FROM numeric",
    ),
    "context_onehot": _with(
        STD, _context("std", "std"), select="SELECT id, feature, value FROM onehot"
    ),
    "context_features_long": _with(STD, _context("std", "std"), select=LONG_CONTEXT),
    "context_transform": _with(
        STD,
        "known AS (SELECT * FROM std WHERE label IS NOT NULL)",
        "fresh AS (SELECT * FROM std WHERE label IS NULL)",
        _context("known", "fresh"),
        select=LONG_CONTEXT,
    ),
    "binary_metrics": _with(PRED, _binary("pred", ""), select="SELECT * FROM bm"),
    "roc_points": _with(
        PRED, _curve("pred", ""),
        select="""SELECT score AS threshold, round(cfp / n, 6) AS fpr, round(ctp / p, 6) AS tpr FROM curve
UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0""",
    ),
    "pr_points": _with(
        PRED, _curve("pred", ""),
        select="""SELECT score AS threshold, round(ctp / (ctp + cfp), 6) AS precision, round(ctp / p, 6) AS recall FROM curve
UNION ALL SELECT NULL, 1.0, 0.0""",
    ),
    "roc_auc": _with(
        PRED, _curve("pred", "context_mask"),
        select=f"SELECT context_mask, {AUC} AS roc_auc FROM curve GROUP BY context_mask",
    ),
    "avg_precision": _with(
        PRED, _curve("pred", "context_mask"),
        select=f"SELECT context_mask, {AP} AS average_precision FROM curve GROUP BY context_mask",
    ),
    "confusion": _with(
        PRED,
        select="""SELECT CAST(a.l AS INTEGER) AS label, CAST(b.l AS INTEGER) AS prediction, count(pred.id) AS n
FROM (SELECT unnest([0, 1]) AS l) a CROSS JOIN (SELECT unnest([0, 1]) AS l) b
LEFT JOIN pred ON pred.label = a.l AND pred.prediction = b.l GROUP BY ALL""",
    ),
    "weighted_metrics": _with(PRED, _weighted("pred", ""), select=f"SELECT n, {WEIGHTED} FROM wm"),
    "class_report": _with(
        PRED, _per_class("pred", ""),
        select="""SELECT CAST(class AS VARCHAR) AS class, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM pc
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hits) / CAST(sum(support) AS DOUBLE), 6), CAST(sum(support) AS BIGINT) FROM pc
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM pc
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
  round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pc""",
    ),
    "model_comparison": _with(PRED2, _binary("models", "model"), select="SELECT * FROM bm"),
    "missing_context": _with(
        PRED, _weighted("pred", "context_mask"),
        "long AS (UNPIVOT (SELECT context_mask, accuracy, precision, recall, f1, roc_auc FROM wm) "
        "ON accuracy, precision, recall, f1, roc_auc INTO NAME metric VALUE value)",
        select="""SELECT a.metric, a.value AS context_available, b.value AS context_missing
FROM long a JOIN long b ON b.metric = a.metric WHERE a.context_mask = 1 AND b.context_mask = 0""",
    ),
    "final_metrics": _with(
        PRED,
        """assigned AS (SELECT *, 'overall' AS experiment FROM pred UNION ALL
  SELECT *, CASE WHEN context_mask = 1 THEN 'context_available' ELSE 'context_missing' END FROM pred)""",
        _weighted("assigned", "experiment"),
        select=f"SELECT experiment, n, {WEIGHTED} FROM wm",
    ),
    "exp_c_compare": _with(
        PRED2,
        "a AS (SELECT * FROM models WHERE model = 'A')",
        "b AS (SELECT * FROM models WHERE model = 'B')",
        _weighted("a", ""),
        _binary("b", "").replace("st AS", "st_b AS").replace("FROM st)", "FROM st_b)")
        .replace("curve AS", "curve_b AS").replace("FROM curve", "FROM curve_b")
        .replace("areas AS", "areas_b AS").replace("JOIN areas", "JOIN areas_b"),
        "ours AS (UNPIVOT (SELECT accuracy, precision, recall, f1, roc_auc FROM wm) "
        "ON accuracy, precision, recall, f1, roc_auc INTO NAME metric VALUE value)",
        "base AS (UNPIVOT (SELECT accuracy, precision, recall, f1, roc_auc, average_precision FROM bm) "
        "ON accuracy, precision, recall, f1, roc_auc, average_precision INTO NAME metric VALUE value)",
        select="SELECT ours.metric, ours.value AS model, base.value AS baseline FROM ours LEFT JOIN base ON base.metric = ours.metric",
    ),
    "baseline_predictions": "WITH RECURSIVE " + ",\n".join(
        [BASELINE, _fit(False), _scores("scored", "one", TEST_ROWS)]
    ) + "\nSELECT id, label, prediction, round(score, 4) AS score FROM scored",
    "balanced_predictions": "WITH RECURSIVE " + ",\n".join(
        [BASELINE, _fit(True), _scores("scored", "bal", TEST_ROWS)]
    ) + "\nSELECT id, label, prediction, round(score, 4) AS score FROM scored",
    "imbalance_experiment": "WITH RECURSIVE " + ",\n".join(
        [
            BASELINE, _fit(False), _fit(True),
            _scores("plain", "one", "(SELECT id, label, split AS part FROM held)"),
            _scores("weighed", "bal", "(SELECT id, label, split AS part FROM held)"),
            "pair AS (SELECT *, 'Unweighted' AS model FROM plain UNION ALL SELECT *, 'Class weighted' FROM weighed)",
            _binary("pair", "part, model"),
        ]
    ) + "\nSELECT * FROM bm",
    "zero_shot_metrics": "WITH RECURSIVE " + ",\n".join([ZERO_SHOT, _weighted("scored", "dataset")])
    + f"\nSELECT dataset, n, {WEIGHTED} FROM wm",
    "gated_scores": _with(
        SCORED,
        select="""SELECT id, context_mask, round(gate, 5) AS gate, round(logit_0, 5) AS logit_0, round(logit_1, 5) AS logit_1,
  CAST(logit_1 > logit_0 AS INTEGER) AS prediction, round(1 / (1 + exp(logit_0 - logit_1)), 5) AS score FROM out""",
    ),
    "gate_stats": _with(
        SCORED,
        select="""SELECT context_mask, count(*) AS n, round(avg(gate), 5) AS mean, round(stddev_pop(gate), 5) AS std,
  round(min(gate), 5) AS min, round(max(gate), 5) AS max, bool_and(abs(gate) <= 1e-8) AS all_zero FROM out GROUP BY context_mask""",
    ),
    "gate_hist": _with(
        SCORED,
        "rounded AS (SELECT context_mask, round(gate, 6) AS gate FROM out)",
        select=_hist("rounded", "gate", 30, "context_mask", "context_mask"),
    ),
    "feature_contract": _with(
        FUSION,
        select="""SELECT count(*) AS rows, count(*) FILTER (WHERE digit = '0') AS null_features,
  count(*) FILTER (WHERE digit = '1') AS bad_text_dim, count(*) FILTER (WHERE digit = '2') AS bad_context_dim,
  count(*) FILTER (WHERE digit = '3') AS bad_mask, count(*) FILTER (WHERE digit = '4') AS bad_label
FROM (SELECT substr(md5(id), 1, 1) AS digit FROM chosen)""",
    ),
    "forward_metrics": _with(
        SCORED,
        """judged AS (SELECT c.label, CAST(o.logit_1 > o.logit_0 AS INTEGER) AS prediction,
  ln(1 + exp(CASE WHEN c.label = 1 THEN o.logit_0 - o.logit_1 ELSE o.logit_1 - o.logit_0 END)) AS loss
  FROM out o JOIN chosen c ON c.id = o.id)""",
        _per_class("judged", ""),
        select="""SELECT round((SELECT avg(loss) FROM judged), 5) AS loss,
  round(CAST(sum(hits) AS DOUBLE) / sum(support), 5) AS accuracy, round(sum(f1 * support) / sum(support), 5) AS f1 FROM pc""",
    ),
    "domain_scores": _with(
        SCORED, select="SELECT id, domain_label, round(domain_score, 5) AS domain_score FROM out"
    ),
    "domain_bce": _with(
        SCORED,
        select="""SELECT count(*) AS n, round(avg(-(domain_label * greatest(ln(domain_score), -100)
  + (1 - domain_label) * greatest(ln(1 - domain_score), -100))), 5) AS loss FROM out""",
    ),
}
