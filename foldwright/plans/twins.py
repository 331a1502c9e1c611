"""SQL twins of the registered queries, for checking results with an independent engine."""

from __future__ import annotations

from foldwright.functions.probs import linspace
from foldwright.operators.review import pair_ranks
from foldwright.operators.tuning import simplex_candidates
from foldwright.schema import CLASS_NAMES, PRIORITY_PAIRS

K = 3


def dbl(x: float) -> str:
    """A DOUBLE literal; plain decimals would be exact decimals in SQL."""
    r = repr(float(x))
    return r if "e" in r else r + "e0"


def prob(name: str = "prob", a: int = 7, b: int = 13, c: int = 29) -> str:
    return f"""{name}_base AS (SELECT o_orderkey AS key,
  CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS label,
  CAST(o_orderkey % 5 AS INT) AS fold, CAST(floor(o_totalprice) AS BIGINT) AS t FROM orders),
{name}_score AS (SELECT key, label, fold,
  CAST(1 + (key * {a} + t) % 97 + CASE WHEN label = 0 THEN 60 ELSE 0 END AS DOUBLE) AS s0,
  CAST(1 + (key * {b} + t) % 89 + CASE WHEN label = 1 THEN 30 ELSE 0 END AS DOUBLE) AS s1,
  CAST(1 + (key * {c} + t) % 83 + CASE WHEN label = 2 THEN 90 ELSE 0 END AS DOUBLE) AS s2 FROM {name}_base),
{name} AS (SELECT key, label, fold, s0/(s0+s1+s2) AS p0, s1/(s0+s1+s2) AS p1, s2/(s0+s1+s2) AS p2
  FROM {name}_score)"""


PROB = prob()
PROB2 = prob("prob2", 11, 17, 23)


def argmax(a: str, b: str, c: str) -> str:
    return f"CASE WHEN {a} >= {b} AND {a} >= {c} THEN 0 WHEN {b} >= {c} THEN 1 ELSE 2 END"


SCORED = PROB + f""",
scored AS (SELECT *, {argmax('p0', 'p1', 'p2')} AS pred FROM prob)"""


def name_of(col: str, names=CLASS_NAMES) -> str:
    whens = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    return f"CASE {col} {whens} ELSE '?' END"


def _term(p: str) -> str:
    return f"CASE WHEN {p} > 0 THEN -({p}/(p0+p1+p2)) * ln({p}/(p0+p1+p2)) ELSE 0 END"


DIAG = SCORED + f""",
diag AS (SELECT key, label, fold, pred AS pred_class, CAST(label = pred AS INT) AS is_correct,
  greatest(p0, p1, p2) AS top1, list_reverse_sort([p0, p1, p2])[2] AS top2,
  greatest(p0, p1, p2) - list_reverse_sort([p0, p1, p2])[2] AS margin,
  {_term('p0')} + {_term('p1')} + {_term('p2')} AS entropy, p0, p1, p2 FROM scored)"""


# --- confusion ----------------------------------------------------------------------------

def wide(src: str, k: int = K, group: str = "", n: str | None = None) -> str:
    g = f"{group}, " if group else ""
    cells = ", ".join(
        (f"count(*) FILTER (label = {i} AND pred = {j}) AS c_{i}_{j}" if n is None else
         f"coalesce(sum({n}) FILTER (label = {i} AND pred = {j}), 0) AS c_{i}_{j}")
        for i in range(k) for j in range(k))
    return f"SELECT {g}{cells} FROM {src}" + (f" GROUP BY {group}" if group else "")


def terms(i: int, k: int = K, cell=lambda i, j: f"c_{i}_{j}") -> dict[str, str]:
    tp = cell(i, i)
    support = "(" + " + ".join(cell(i, j) for j in range(k)) + ")"
    predicted = "(" + " + ".join(cell(j, i) for j in range(k)) + ")"

    def ratio(a, b):
        return f"(CASE WHEN {b} = 0 THEN 0e0 ELSE CAST({a} AS DOUBLE) / {b} END)"

    return {"tp": tp, "support": support, "predicted": predicted, "precision": ratio(tp, predicted),
            "recall": ratio(tp, support), "f1": ratio(f"(2 * {tp})", f"({support} + {predicted})")}


def macro(k: int = K, cell=lambda i, j: f"c_{i}_{j}", observed: bool = False) -> str:
    ts = [terms(i, k, cell) for i in range(k)]
    total = "(" + " + ".join(t["f1"] for t in ts) + ")"
    if not observed:
        return f"{total} / {dbl(k)}"
    seen = " + ".join(f"CASE WHEN {t['support']} + {t['predicted']} > 0 THEN 1 ELSE 0 END" for t in ts)
    return f"{total} / ({seen})"


def class_distribution() -> str:
    rows = " UNION ALL ".join(
        f"SELECT {i} AS label, '{n}' AS label_name, count(*) FILTER (label = {i}) AS n, "
        f"round(count(*) FILTER (label = {i}) / count(*), 6) AS share FROM prob" for i, n in enumerate(CLASS_NAMES))
    return f"WITH {PROB} {rows}"


def class_weights() -> str:
    rows = " UNION ALL ".join(
        f"SELECT {i} AS label, count(*) FILTER (label = {i}) AS n, "
        f"round(count(*) / (3 * count(*) FILTER (label = {i})), 6) AS weight FROM prob" for i in range(K))
    return f"WITH {PROB} {rows}"


def prediction_mix() -> str:
    rows = " UNION ALL ".join(
        f"SELECT {i} AS predicted, count(*) FILTER (pred = {i}) AS n, "
        f"round(count(*) FILTER (pred = {i}) / count(*), 6) AS share, "
        f"count(*) FILTER (pred = {i}) / count(*) < 1e-2 AS too_rare FROM scored" for i in range(K))
    return f"WITH {SCORED} {rows}"


def size_summary() -> str:
    return """WITH d AS (SELECT n_chars AS width, len(string_split(text, chr(10))) AS height, lang FROM documents)
SELECT count(*) AS n, min(width) AS width_min, max(width) AS width_max, min(height) AS height_min,
  max(height) AS height_max, string_agg(DISTINCT lang, ',' ORDER BY lang) AS channels,
  CAST(trunc(quantile_cont(width, 0.5)) AS BIGINT) AS width_median,
  CAST(trunc(quantile_cont(height, 0.5)) AS BIGINT) AS height_median FROM d"""


_DOCS = "docs AS (SELECT doc_id AS key, md5(text) AS hash FROM documents)"
_GROUPS = _DOCS + ", grp AS (SELECT hash, count(*) AS n, min(key) AS first_key FROM docs GROUP BY hash HAVING count(*) > 1)"


def eda_stats() -> str:
    return f"""WITH s AS ({size_summary()}), l AS (SELECT quality FROM labels JOIN documents USING (doc_id)), {_GROUPS}
SELECT (SELECT count(*) FROM l WHERE quality = 0) AS n_low, (SELECT count(*) FROM l WHERE quality = 1) AS n_high,
  round((SELECT avg(1 - quality) FROM l), 6) AS share_low, round((SELECT avg(quality) FROM l), 6) AS share_high, s.*,
  (SELECT count(*) FROM grp) AS duplicate_groups, CAST((SELECT coalesce(sum(n), 0) FROM grp) AS BIGINT) AS duplicate_total,
  (SELECT count(*) FROM grp) > 0 AS need_group_split, 0 AS n_corrupt FROM s"""


def _histogram(src: str, value: str, bins: int, by: str) -> str:
    g = f"{by}, " if by else ""
    join = f"JOIN ends USING ({by})" if by else "CROSS JOIN ends"
    group = f"GROUP BY {by}" if by else ""
    return f"""ends AS (SELECT {g} min({value}) AS lo, max({value}) AS hi, count(*) AS total FROM {src} {group}),
binned AS (SELECT {g} lo, hi, total, (hi - lo) / {dbl(bins)} AS width,
  CAST(least(floor(({value} - lo) / ((hi - lo) / {dbl(bins)})), {bins - 1}) AS INT) AS bin FROM {src} {join})
SELECT {g} bin, round(lo + bin * width, 6) AS left_edge, count(*) AS n,
  round(count(*) / (total * width), 6) AS density FROM binned GROUP BY {g} bin, lo, width, total"""


def histogram(value: str, bins: int) -> str:
    return f"WITH {DIAG}, {_histogram('diag', value, bins, 'label')}"


HISTOGRAM_SIZES = "WITH d AS (SELECT CAST(n_chars AS DOUBLE) AS v FROM documents), " + _histogram("d", "v", 40, "")
CONTENT_HASH = "SELECT doc_id AS key, substr(sha256(text), 1, 16) AS digest FROM documents"
TABLE_DIGEST = """SELECT count(*) AS n_rows,
  CAST(sum(CAST(concat('0x', substr(md5(concat_ws(chr(1), doc_id::VARCHAR, quality::VARCHAR, toxic::VARCHAR)), 1, 15))
    AS HUGEINT)) AS VARCHAR) AS content_sum FROM labels"""


def confusion() -> str:
    rows = " UNION ALL ".join(
        f"SELECT {i} AS label, {j} AS pred, count(*) FILTER (label = {i} AND pred = {j}) AS n FROM scored"
        for i in range(K) for j in range(K))
    return f"WITH {SCORED} {rows}"


def confusion_norm() -> str:
    rows = " UNION ALL ".join(
        f"SELECT {i} AS label, {j} AS pred, round(count(*) FILTER (label = {i} AND pred = {j}) / "
        f"count(*) FILTER (label = {i}), 6) AS share FROM scored" for i in range(K) for j in range(K))
    return f"WITH {SCORED} {rows}"


def prf_support() -> str:
    rows = " UNION ALL ".join(
        "SELECT {i} AS label, round({precision}, 6) AS precision, round({recall}, 6) AS recall, "
        "round({f1}, 6) AS f1, {support} AS support FROM w".format(i=i, **terms(i)) for i in range(K))
    return f"WITH {SCORED}, w AS ({wide('scored')}) {rows}"


def macro_f1(k: int = K, observed: bool = False) -> str:
    return f"WITH {SCORED}, w AS ({wide('scored', k)}) SELECT round({macro(k, observed=observed)}, 6) AS macro_f1 FROM w"


def classification_report() -> str:
    ts = [terms(i) for i in range(K)]
    n = " + ".join(t["support"] for t in ts)
    acc = "CAST(" + " + ".join(t["tp"] for t in ts) + f" AS DOUBLE) / ({n})"

    def row(name, p, r, f, s):
        return (f"SELECT '{name}' AS name, round({p}, 6) AS precision, round({r}, 6) AS recall, round({f}, 6) AS f1, "
                f"{s} AS support FROM w")

    def mean(m):
        return "(" + " + ".join(t[m] for t in ts) + ") / 3e0"

    def weighted(m):
        return "(" + " + ".join(f"{t[m]} * {t['support']}" for t in ts) + f") / ({n})"

    rows = [row(CLASS_NAMES[i], t["precision"], t["recall"], t["f1"], t["support"]) for i, t in enumerate(ts)]
    rows += [row("accuracy", acc, acc, acc, n),
             row("macro avg", mean("precision"), mean("recall"), mean("f1"), n),
             row("weighted avg", weighted("precision"), weighted("recall"), weighted("f1"), n)]
    return f"WITH {SCORED}, w AS ({wide('scored')}) " + " UNION ALL ".join(rows)


_ALL = " + ".join(f"c_{i}_{j}" for i in range(K) for j in range(K))


def fold_error_rates() -> str:
    return f"""WITH {SCORED}, w AS ({wide('scored', group='fold')}),
r AS (SELECT fold, {_ALL} AS n_val, {macro(observed=True)} AS f FROM w),
e AS (SELECT fold, n_val, round_even(f, 4) AS macro_f1, round_even(1e0 - f, 4) AS error_rate FROM r)
SELECT *, max(error_rate) OVER () - min(error_rate) OVER () > 2e-2 AS uneven FROM e"""


def fold_consistency() -> str:
    return f"""WITH {SCORED}, w AS ({wide('scored', group='fold')}), r AS (SELECT {macro()} AS f FROM w)
SELECT round(avg(f), 6) AS mean, round(stddev_pop(f), 6) AS std, round(min(f), 6) AS min FROM r"""


def fold_scores() -> str:
    return f"""WITH {SCORED}, w AS ({wide('scored', group='fold')}), c AS (SELECT fold, count(*) AS n FROM scored GROUP BY fold)
SELECT fold, n, round({macro()}, 6) AS macro_f1 FROM w JOIN c USING (fold)"""


def _cv() -> str:
    return f"""WITH {SCORED}, w AS ({wide('scored', group='fold')}), f AS (SELECT {macro()} AS f FROM w),
a AS ({wide('scored')}), o AS (SELECT {macro()} AS oof FROM a),
s AS (SELECT avg(f) AS cv_mean, stddev_samp(f) AS cv_std, (SELECT oof FROM o) AS oof FROM f)"""


def cv_summary() -> str:
    return _cv() + """ SELECT round(cv_mean, 6) AS cv_mean, round(cv_std, 6) AS cv_std, round(oof, 6) AS oof_overall,
  round(abs(cv_mean - oof), 6) AS gap, abs(cv_mean - oof) < 5e-2 AS consistent FROM s"""


def compare_cv_oof() -> str:
    return _cv() + """ SELECT 'cv_matches_oof' AS "check", abs(cv_mean - oof) < 5e-2 AS ok,
  CASE WHEN abs(cv_mean - oof) < 5e-2 THEN 0 ELSE 1 END AS n_bad FROM s"""


def fold_label_pivot() -> str:
    ns = ", ".join(f"count(*) FILTER (label = {i}) AS n_{i}" for i in range(K))
    shares = ", ".join(f"round(n_{i} / n, 6) AS share_{i}" for i in range(K))
    return f"WITH {PROB}, c AS (SELECT fold, count(*) AS n, {ns} FROM prob GROUP BY fold) SELECT *, {shares} FROM c"


def class_action_table() -> str:
    rows = []
    for i in range(K):
        t = terms(i)
        a, b = [j for j in range(K) if j != i]
        gap = f"greatest(0e0, 9.9e-1 - {t['f1']})"
        rows.append(f"""SELECT {i} AS class_id, '{CLASS_NAMES[i]}' AS class_name, round({t['precision']}, 6) AS precision,
  round({t['recall']}, 6) AS recall, round({t['f1']}, 6) AS f1, {t['support']} AS support,
  round({gap}, 6) AS gap_to_target,
  CASE WHEN c_{i}_{a} >= c_{i}_{b} THEN '{CLASS_NAMES[a]}' ELSE '{CLASS_NAMES[b]}' END AS missed_as,
  greatest(c_{i}_{a}, c_{i}_{b}) AS n_missed,
  CASE WHEN c_{a}_{i} >= c_{b}_{i} THEN '{CLASS_NAMES[a]}' ELSE '{CLASS_NAMES[b]}' END AS taken_from,
  greatest(c_{a}_{i}, c_{b}_{i}) AS n_taken,
  CASE WHEN {gap} = 0 THEN 'at_target' WHEN {t['recall']} < {t['precision']} THEN 'low_recall_lower_threshold'
    ELSE 'low_precision_raise_threshold' END AS advice FROM w""")
    return f"WITH {SCORED}, w AS ({wide('scored')}) " + " UNION ALL ".join(rows)


# --- row functions --------------------------------------------------------------------------

def diagnose() -> str:
    return f"""WITH {DIAG} SELECT key, label, fold, pred_class, is_correct, round(top1, 6) AS top1, round(top2, 6) AS top2,
  round(margin, 6) AS margin, round(entropy, 6) AS entropy, round(p0, 6) AS prob_0, round(p1, 6) AS prob_1,
  round(p2, 6) AS prob_2 FROM diag"""


def entropy_clip() -> str:
    t = " + ".join(f"least(greatest(p{i}, 1e-12), 1e0) * ln(least(greatest(p{i}, 1e-12), 1e0))" for i in range(K))
    return f"WITH {PROB} SELECT key, round(-({t}), 6) AS entropy FROM prob"


def label_quality() -> str:
    return f"WITH {PROB} SELECT key, round(CASE label WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 6) AS quality FROM prob"


def softmax() -> str:
    es = [f"exp(p{i} - greatest(p0, p1, p2))" for i in range(K)]
    cols = ", ".join(f"round({e} / ({' + '.join(es)}), 6) AS s{i}" for i, e in enumerate(es))
    return f"WITH {PROB} SELECT key, {cols} FROM prob"


def mean_probs() -> str:
    cols = ", ".join(f"round((a.p{i} + b.p{i}) / 2e0, 6) AS m{i}" for i in range(K))
    return f"WITH {PROB}, {PROB2} SELECT key, {cols} FROM prob a JOIN prob2 b USING (key)"


def apply_multipliers(w) -> str:
    cells = [f"(p{i} * {dbl(x)})" for i, x in enumerate(w)]
    return f"WITH {PROB} SELECT key, {argmax(*cells)} AS predicted FROM prob"


def _quantile(src: str, value: str, q: float, name: str) -> str:
    """Linear interpolation between the two neighbouring ranks, as a one-row table."""
    return f"""{name}_s AS (SELECT {value} AS v, row_number() OVER (ORDER BY {value}) - 1 AS r FROM {src}),
{name}_h AS (SELECT {dbl(q)} * (count(*) - 1) AS h, count(*) - 1 AS last FROM {src}),
{name}_ab AS (SELECT h - floor(h) AS t, (SELECT v FROM {name}_s WHERE r = floor(h)) AS a,
  (SELECT v FROM {name}_s WHERE r = least(floor(h) + 1, last)) AS b FROM {name}_h),
{name} AS (SELECT CASE WHEN t < 0.5 THEN a + (b - a) * t ELSE b - (b - a) * (1 - t) END AS q FROM {name}_ab)"""


def quantiles() -> str:
    qs = [0.05, 0.25, 0.5, 0.95]
    parts = ", ".join(_quantile("diag", "margin", q, f"q{round(q * 100)}") for q in qs)
    cols = ", ".join(f"round((SELECT q FROM q{round(q * 100)}), 6) AS p{round(q * 100)}" for q in qs)
    return f"WITH {DIAG}, {parts} SELECT round(min(margin), 6) AS p0, round(max(margin), 6) AS p100, {cols} FROM diag"


NORMALIZE_PATH = """WITH r AS (SELECT page_id, concat('/data/', regexp_replace(url, '^.*://', ''), '/img.png') AS p FROM pages)
SELECT page_id, regexp_replace(p, '/+', '/', 'g') AS path FROM r"""
REBASE_PATHS = """SELECT page_id, concat('/local/cache/', regexp_replace(url, '^.*://', '')) AS path FROM pages"""
LABEL_NAMES = """SELECT o_orderkey AS key, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS label,
  o_orderstatus AS label_name FROM orders"""
HEX_BITS = """SELECT doc_id AS key, substr(md5(text), 1, 16) AS hex,
  bit_count(CAST(concat('0x', substr(md5(text), 1, 16)) AS UBIGINT)) AS bits FROM documents"""


# --- ambiguity and label noise ------------------------------------------------------------------

def _pair(a: str = "label", b: str = "pred_class") -> str:
    return (f"CASE WHEN {a} <> {b} THEN concat({name_of(a)}, '→', {name_of(b)}) "
            f"ELSE concat({name_of(a)}, ' (correct, low margin)') END")


_PRIO = "((label = 0 AND pred_class = 2) OR (label = 2 AND pred_class = 0))"


def _ambig(pct: float = 5.0, name: str = "ambig") -> str:
    return f"""{_quantile('diag', 'margin', pct / 100, name + '_lo')},
{_quantile('diag', 'entropy', (100 - pct) / 100, name + '_hi')},
{name} AS (SELECT d.*, CASE WHEN margin < lo.q AND entropy > hi.q THEN 'both' WHEN margin < lo.q THEN 'low_margin'
    ELSE 'high_entropy' END AS source, {_pair()} AS pair, {_PRIO} AS is_priority_pair
  FROM diag d, {name}_lo lo, {name}_hi hi WHERE margin < lo.q OR entropy > hi.q)"""


def ambiguous() -> str:
    return f"""WITH {DIAG}, {_ambig()} SELECT key, fold, label, pred_class, round(margin, 6) AS margin,
  round(entropy, 6) AS entropy, round(top1, 6) AS top1, round(top2, 6) AS top2, pair, is_priority_pair, source FROM ambig"""


def margin_issues(top_n: int | None = None) -> str:
    tail = f" ORDER BY diag.margin, key LIMIT {top_n}" if top_n else ""
    return f"""WITH {DIAG} SELECT key, fold, label, pred_class, round(diag.margin, 6) AS margin,
  'wrong_prediction_low_margin' AS source, diag.margin < 1.5e-1 / 2 AS is_high_priority FROM diag
  WHERE is_correct = 0 AND diag.margin < 1.5e-1{tail}"""


def _cl(both: bool = False) -> str:
    kept = [f"CASE WHEN p{i} >= t{i} THEN p{i} END" for i in range(K)]
    top = f"greatest({', '.join(kept)})"
    conf = "CASE " + " ".join(f"WHEN ({kept[i]}) = ({top}) THEN {i}" for i in range(K)) + " END"
    gaps = " UNION ALL ".join(
        f"SELECT key, label, {j} AS j, CASE WHEN label = {j} THEN -quality ELSE p{j} - quality END AS v FROM qual"
        for j in range(K))
    extra = (" AND key IN (SELECT key FROM gap JOIN cuts USING (label, j) WHERE label = j AND v >= cut)" if both else "")
    return f"""qual AS (SELECT *, CASE label WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS quality FROM diag),
th AS (SELECT avg(p0) FILTER (label = 0) AS t0, avg(p1) FILTER (label = 1) AS t1, avg(p2) FILTER (label = 2) AS t2
  FROM diag),
conf AS (SELECT label, {conf} AS c FROM diag, th),
cell AS (SELECT label, c, count(*) AS n FROM conf WHERE c IS NOT NULL GROUP BY ALL),
joint AS (SELECT label, c, n * (SELECT count(*) FROM diag d WHERE d.label = cell.label)
  / (sum(n) OVER (PARTITION BY label)) AS x FROM cell),
quota AS (SELECT label, c AS j, CAST(round_even(1e-1 * x, 0) AS BIGINT) AS n FROM joint WHERE c <> label),
quota2 AS (SELECT * FROM quota UNION ALL SELECT label, label, sum(n) FROM quota GROUP BY label),
gap AS ({gaps}),
ranked AS (SELECT label, j, v, row_number() OVER (PARTITION BY label, j ORDER BY v DESC) AS r FROM gap),
cuts AS (SELECT label, j, v AS cut FROM ranked JOIN quota2 q USING (label, j) WHERE r = q.n),
hit AS (SELECT DISTINCT key FROM gap JOIN cuts USING (label, j) WHERE label <> j AND v >= cut),
found AS (SELECT key, fold, label, {name_of('label')} AS label_name, pred_class, {name_of('pred_class')} AS pred_name,
  quality, top1 AS confidence, margin, entropy FROM qual
  WHERE key IN (SELECT key FROM hit){extra} AND pred_class <> label),
{_quantile('found', 'quality', 0.25, 'fq')},
issues AS (SELECT *, quality <= (SELECT q FROM fq) AS is_high_priority FROM found)"""


def confident_learning(both: bool = False) -> str:
    return f"""WITH {DIAG}, {_cl(both)} SELECT key, fold, label, label_name, pred_class, pred_name,
  round(quality, 6) AS quality, round(confidence, 6) AS confidence, round(margin, 6) AS margin,
  round(entropy, 6) AS entropy, is_high_priority FROM issues"""


def _flagged(pct: float = 5.0) -> str:
    return f"""{DIAG}, {_ambig(pct)}, {_cl()},
flagged AS (SELECT *, key IN (SELECT key FROM issues) AS is_double_flagged FROM ambig)"""


def double_flag() -> str:
    return f"WITH {_flagged()} SELECT key, is_priority_pair, is_double_flagged FROM flagged"


def pair_distribution() -> str:
    return f"""WITH {_flagged()} SELECT pair, count(*) AS n, round(avg(margin), 6) AS margin_mean,
  CAST(count(*) FILTER (is_double_flagged) AS BIGINT) AS double_flagged FROM flagged GROUP BY pair"""


def ambiguous_with_cap() -> str:
    cols = ("key, label, pred_class, round(margin, 6) AS margin, round(entropy, 6) AS entropy, source")
    fits = "(SELECT count(*) FROM a5) <= (SELECT CAST(floor(count(*) * 3e0 / 100) AS BIGINT) FROM diag)"
    return f"""WITH {DIAG}, {_ambig(5.0, 'a5')}, {_ambig(2.5, 'a2')}
SELECT {cols} FROM a5 WHERE {fits} UNION ALL SELECT {cols} FROM a2 WHERE NOT ({fits})"""


def _merged() -> str:
    return f"""{_flagged()},
merged AS (SELECT key, coalesce(i.fold, a.fold) AS fold, coalesce(i.label, a.label) AS label,
  coalesce(i.pred_class, a.pred_class) AS pred_class,
  CASE WHEN i.key IS NOT NULL THEN 'label_issue' ELSE 'ambiguous_filter' END AS source,
  coalesce(i.margin, a.margin) AS margin, coalesce(i.entropy, a.entropy) AS entropy, i.quality, a.source AS ambig_source,
  coalesce(((i.label = 0 AND i.pred_class = 2) OR (i.label = 2 AND i.pred_class = 0)), false)
    OR coalesce(a.is_priority_pair, false) AS is_priority_pair,
  coalesce(a.is_double_flagged, false) AS is_double_flagged, coalesce(i.is_high_priority, false) AS is_high_priority,
  i.key IS NOT NULL AS from_issue, a.is_priority_pair AS a_prio, a.is_double_flagged AS a_double,
  i.is_high_priority AS i_high, i.margin AS i_margin
  FROM issues i FULL JOIN flagged a USING (key))"""


def merge_candidates(compat: bool = False) -> str:
    if compat:
        return f"""WITH {_merged()} SELECT key, source, round(margin, 6) AS margin, round(quality, 6) AS quality,
  CASE WHEN from_issue THEN NULL ELSE ambig_source END AS ambig_source,
  CASE WHEN from_issue THEN NULL ELSE a_prio END AS is_priority_pair,
  CASE WHEN from_issue THEN NULL ELSE a_double END AS is_double_flagged, i_high AS is_high_priority FROM merged"""
    return f"""WITH {_merged()} SELECT key, fold, label, pred_class, source, round(margin, 6) AS margin,
  round(entropy, 6) AS entropy, round(quality, 6) AS quality, ambig_source, is_priority_pair, is_double_flagged,
  is_high_priority FROM merged"""


def _ordered() -> str:
    ranks = pair_ranks(K, CLASS_NAMES, PRIORITY_PAIRS)
    rank = "CASE " + " ".join(f"WHEN label = {a} AND pred_class = {b} THEN {r}" for (a, b), r in ranks.items()) + " END"
    order = "is_double_flagged DESC, is_priority_pair DESC, margin, key"
    return f"""{_merged()}, pr AS (SELECT *, {rank} AS pair_rank FROM merged),
rn AS (SELECT *, concat({name_of('label')}, ' → ', {name_of('pred_class')}) AS pair_key,
  row_number() OVER (ORDER BY pair_rank, {order}) - 1 AS position,
  row_number() OVER (PARTITION BY pair_rank ORDER BY {order}) - 1 AS in_pair FROM pr),
pages_of AS (SELECT pair_rank, CAST(ceil(count(*) / 50) AS BIGINT) AS n_pages FROM rn GROUP BY pair_rank),
ordered AS (SELECT rn.*, position + 2 AS csv_row, in_pair // 50 + 1 AS page_in_pair,
  in_pair // 50 + 1 + coalesce((SELECT sum(n_pages) FROM pages_of p WHERE p.pair_rank < rn.pair_rank), 0) AS page FROM rn)"""


def review_order() -> str:
    return f"""WITH {_ordered()} SELECT key, pair_key, position, csv_row, page_in_pair, CAST(page AS BIGINT) AS page
  FROM ordered"""


def review_log() -> str:
    return f"""WITH {_ordered()} SELECT position, key, fold, label AS label_old, label AS label_new, 'pending' AS decision,
  '' AS reason, '' AS reviewer, round(margin, 6) AS margin, round(quality, 6) AS quality, is_double_flagged FROM ordered"""


def review_caption() -> str:
    return f"""WITH {_ordered()} SELECT key,
  concat('[Baris ', csv_row, '] ', CASE WHEN label = pred_class THEN concat('✓ ', {name_of('label')})
    ELSE concat('✗ ', {name_of('label')}, '→', {name_of('pred_class')}) END, chr(10), 'M=', printf('%.2f', margin),
    CASE WHEN quality IS NULL THEN '' ELSE concat(' Q=', printf('%.2f', quality)) END) AS caption,
  CASE WHEN label <> pred_class THEN 'mislabel' WHEN margin < 3e-1 THEN 'ambiguous' ELSE 'correct' END AS severity
  FROM ordered"""


def _log() -> str:
    return f"""{_merged()},
log AS (SELECT key, fold, label AS label_old, CASE WHEN is_high_priority THEN 'drop' WHEN from_issue THEN 'relabel'
    ELSE 'keep' END AS decision,
  CASE WHEN from_issue AND NOT is_high_priority THEN pred_class ELSE label END AS label_new FROM merged)"""


def _report(rows: list[tuple[str, str]], src: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS \"check\", coalesce({n}, 0) = 0 AS ok, CAST(coalesce({n}, 0) AS BIGINT) AS n_bad FROM {src}"
        for name, n in rows)


def validate_review() -> str:
    rows = [("required_columns", "0"),
            ("decision_known", "(SELECT count(*) FROM log WHERE decision NOT IN ('keep', 'relabel', 'drop'))"),
            ("no_pending", "(SELECT count(*) FROM log WHERE decision = 'pending')"),
            ("relabel_changes_label", "(SELECT count(*) FROM log WHERE decision = 'relabel' AND label_old = label_new)"),
            ("new_label_known", "(SELECT count(*) FROM log WHERE label_new NOT BETWEEN 0 AND 2)"),
            ("key_once", "(SELECT count(*) - count(DISTINCT key) FROM log)")]
    return f"WITH {_log()}, one AS (SELECT 1) " + _report(rows, "one")


def review_decisions() -> str:
    cols = ", ".join(f"count(*) FILTER (decision = '{d}') AS n_{d}" for d in ("keep", "relabel", "drop", "pending"))
    return f"WITH {_log()} SELECT count(*) AS n, {cols} FROM log"


def _after() -> str:
    return f"""{_log()},
after AS (SELECT p.key, CASE WHEN l.decision = 'relabel' THEN l.label_new ELSE p.label END AS label, p.fold
  FROM prob p LEFT JOIN log l USING (key) WHERE l.decision IS DISTINCT FROM 'drop')"""


def apply_review() -> str:
    return f"WITH {_after()} SELECT * FROM after"


def cleaning_summary() -> str:
    ns = ", ".join(f"count(*) FILTER (label = {i}) AS n_{n}" for i, n in enumerate(CLASS_NAMES))
    ws = ", ".join(f"round(total_after / (3 * n_{n}), 6) AS weight_{n}" for n in CLASS_NAMES)
    decisions = ", ".join(f"(SELECT count(*) FROM log WHERE decision = '{d}') AS {c}" for d, c in (
        ("drop", "log_drops"), ("relabel", "n_relabeled"), ("keep", "n_kept")))
    return f"""WITH {_after()},
c AS (SELECT (SELECT count(*) FROM prob) AS total_before, count(*) AS total_after, {decisions}, {ns} FROM after)
SELECT total_before, total_after, total_before - total_after AS n_dropped, log_drops, n_relabeled, n_kept,
  round_even((total_before - total_after) / total_before * 100, 2) AS drop_pct,
  total_before - total_after <= floor(total_before * 3e0 / 100) AS within_cap,
  {', '.join('n_' + n for n in CLASS_NAMES)}, {ws} FROM c"""


def class_weights_v2() -> str:
    rows = " UNION ALL ".join(
        f"SELECT {i} AS label, count(*) FILTER (label = {i}) AS n, "
        f"round(count(*) / (3 * count(*) FILTER (label = {i})), 6) AS weight FROM after" for i in range(K))
    return f"WITH {_after()} {rows}"


FOLD_UNCHANGED = f"""WITH {PROB} SELECT key, fold AS fold_before, (fold + 1) % 5 AS fold_after FROM prob WHERE label = 2"""
VALIDATE_FOLD_STABILITY = f"WITH {PROB}, one AS (SELECT 1) " + _report(
    [("fold_unchanged", "(SELECT count(*) FROM prob WHERE label = 2)"), ("no_new_key", "0")], "one")


# --- duplicates and splits -----------------------------------------------------------------------

DUPLICATE_GROUPS = f"WITH {_GROUPS} SELECT * FROM grp"
DUPLICATE_MEMBERS = f"WITH {_GROUPS} SELECT hash, key FROM docs JOIN grp USING (hash)"
DUPLICATE_SUMMARY = f"""WITH {_GROUPS} SELECT count(*) AS duplicate_groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS
  duplicate_total, coalesce(max(n), 0) AS largest, count(*) > 0 AS need_group_split FROM grp"""
GROUP_IDS = f"""WITH {_GROUPS}, dup AS (SELECT hash, row_number() OVER (ORDER BY n DESC, hash) - 1 AS group_id FROM grp),
uni AS (SELECT key, row_number() OVER (ORDER BY key) - 1 + (SELECT count(*) FROM dup) AS group_id FROM docs
  WHERE hash NOT IN (SELECT hash FROM dup))
SELECT key, group_id FROM docs JOIN dup USING (hash) UNION ALL SELECT key, group_id FROM uni"""

_COMPONENTS = """h AS (SELECT o_orderkey AS key, xor(o_custkey * 2654435761, CAST(1 << (o_orderkey % 3) AS BIGINT)) AS hash
  FROM orders),
d AS (SELECT hash, min(key) AS id FROM h GROUP BY hash),
edge AS (SELECT a.id AS a, b.id AS b FROM d a JOIN d b ON a.id <> b.id AND bit_count(xor(a.hash, b.hash)) <= 2),
reach AS (SELECT id AS a, id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
root AS (SELECT b AS id, min(a) AS root FROM reach GROUP BY b),
out AS (SELECT h.key, root.root FROM h JOIN d USING (hash) JOIN root USING (id))"""
COMPONENTS = f"WITH RECURSIVE {_COMPONENTS} SELECT key, root FROM out"
COMPONENT_GROUPS = f"WITH RECURSIVE {_COMPONENTS} SELECT root, count(*) AS n FROM out GROUP BY root HAVING count(*) > 1"

STAR = f"""WITH RECURSIVE {_COMPONENTS},
m AS (SELECT root.root, list({{'id': d.id, 'hash': d.hash}} ORDER BY d.id) AS members FROM root JOIN d USING (id) GROUP BY root.root),
s AS (SELECT root, members, list_reduce(members, lambda acc, x:
    CASE WHEN len(list_filter(acc, lambda y: bit_count(xor(y.hash, x.hash)) <= 2)) > 0 THEN acc ELSE list_append(acc, x) END,
    list_filter(members, lambda y: false)) AS seeds FROM m),
e AS (SELECT seeds, unnest(members) AS x FROM s)
SELECT h.key, list_filter(e.seeds, lambda y: bit_count(xor(y.hash, e.x.hash)) <= 2)[1].id AS root
FROM e JOIN h ON h.hash = e.x.hash"""


def _shuffled(key: str = "key", seed: int = 42) -> str:
    return f"md5(concat({key}, ':{seed}')), {key}"


def stratified_kfold() -> str:
    return f"""WITH {PROB} SELECT key, label,
  CAST((row_number() OVER (PARTITION BY label ORDER BY {_shuffled()}) - 1) % 5 AS INT) AS fold FROM prob"""


def sample_per_class() -> str:
    return f"""WITH {PROB}, r AS (SELECT key, label, row_number() OVER (PARTITION BY label ORDER BY {_shuffled()}) AS r
  FROM prob) SELECT key, label FROM r WHERE r <= 5"""


def split_fold() -> str:
    return f"""WITH {PROB} SELECT CASE WHEN fold = 3 THEN 'val' ELSE 'train' END AS part, label, count(*) AS n
  FROM prob GROUP BY ALL"""


EXCLUDE = """SELECT doc_id AS key, source FROM documents d
  WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1)"""
FOLD_OVERLAP = """SELECT l_orderkey AS key, count(DISTINCT l_linenumber) AS n_folds FROM lineitem GROUP BY l_orderkey
  HAVING count(DISTINCT l_linenumber) > 1"""
VALIDATE_FOLDS = "WITH one AS (SELECT 1) " + _report([
    ("columns", "0"), ("label_known", "0"),
    ("no_fold_overlap", "(SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey "
                        "HAVING min(l_linenumber) <> max(l_linenumber)))"),
    ("key_once", "(SELECT count(*) - count(DISTINCT l_orderkey) FROM lineitem)"),
    ("classes_in_every_fold", "(SELECT count(*) FROM (SELECT l_linenumber FROM lineitem GROUP BY l_linenumber "
                              "HAVING count(DISTINCT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) = 1))"),
], "one")


# --- vectors ----------------------------------------------------------------------------------------

_VECS = """vecs AS (SELECT vec_id AS key, CAST(vec_id % 5 AS INT) AS fold, label,
  CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""
_NORM = "sqrt(list_sum(list_transform({v}, lambda x: x * x)))"


def _spread(src: str) -> str:
    cols = ", ".join(f"round(v[{i + 1}], 6) AS v{i}" for i in range(4))
    return (f"SELECT key, len(v) AS dim, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm2, {cols} "
            f"FROM {src}")


L2NORM = f"""WITH {_VECS}, w AS (SELECT key, list_transform(v, lambda x: x * 3 + 1) AS v FROM vecs),
n AS (SELECT key, v, {_NORM.format(v='v')} AS s FROM w),
u AS (SELECT key, list_transform(v, lambda x: x / s) AS v FROM n) {_spread('u')}"""
CONCAT_FEATURES = f"""WITH {_VECS}, w AS (SELECT key, v, list_transform(v, lambda x: x * 1000 + 1) AS b FROM vecs),
n AS (SELECT *, {_NORM.format(v='v')} AS s, {_NORM.format(v='b')} AS t FROM w)
SELECT key, 128 AS dim, 2e0 AS norm2, round(v[1] / s, 6) AS first, round(b[1] / t, 6) AS mid FROM n"""
VEC_MEAN = f"""WITH {_VECS}, r AS (SELECT key, v, list_reverse(v) AS b FROM vecs),
u AS (SELECT key, list_transform(list_zip(v, b), lambda x: (x[1] + x[2]) / 2) AS v FROM r) {_spread('u')}"""
COSINE = f"""WITH {_VECS} SELECT key,
  round(list_dot_product(v, list_reverse(v)) / list_sum(list_transform(v, lambda x: x * x)), 6) AS similarity FROM vecs"""
ALIGN_VECTORS = f"WITH {_VECS} SELECT key, fold, label, len(v) AS dim FROM vecs WHERE label <> 9"
ALIGNMENT_REPORT = "WITH one AS (SELECT 1) " + _report([
    ("every_key_has_a_vector", "(SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings))"),
    ("vector_keys_unique", "0")], "one") + """ UNION ALL SELECT 'vectors_without_fold_row', true,
  (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) FROM one"""
TEMPLATE_ALIGNMENT = "WITH one AS (SELECT 1) " + _report([
    ("no_missing_vector", "(SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings))"),
    ("no_extra_vector", "(SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents))"),
    ("vector_ids_unique", "0")], "one")
VALIDATE_VECTORS = "WITH one AS (SELECT 1) " + _report([
    ("finite", "(SELECT count(*) FROM embeddings WHERE label = 0)"),
    ("constant_length", "(SELECT max(CASE WHEN label = 0 THEN 1 ELSE 0 END) - min(CASE WHEN label = 0 THEN 1 ELSE 0 END) "
                        "FROM embeddings)"),
    ("row_count", "1")], "one")

_NEAR = f"""{_VECS}, unit AS (SELECT key, fold, label, list_transform(v, lambda x: x / n) AS v
  FROM (SELECT *, {_NORM.format(v='v')} AS n FROM vecs)),
pairs AS (SELECT q.key AS q_key, t.key AS t_key, t.label AS t_label,
  least(greatest(1 - list_dot_product(q.v, t.v), 0e0), 2e0) AS d0 FROM unit q JOIN unit t ON q.fold <> t.fold),
clean AS (SELECT q_key, t_key, t_label, CASE WHEN d0 < 1e-12 THEN 0e0 ELSE d0 END AS dist FROM pairs),
near AS (SELECT * FROM clean QUALIFY row_number() OVER (PARTITION BY q_key ORDER BY dist, t_key) <= 15)"""


def knn_join() -> str:
    return f"WITH {_NEAR} SELECT q_key, t_key, t_label, round(dist, 6) AS dist FROM near"


def knn_oof(k: int = 10) -> str:
    cols = ", ".join(
        f"round(CASE WHEN z > 0 THEN z{c} / z ELSE w{c} / w END, 6) AS p{c}" for c in range(k))
    sums = ", ".join(
        f"coalesce(sum(CASE WHEN dist > 0 THEN 1 / dist END) FILTER (t_label = {c}), 0) AS w{c}, "
        f"count(*) FILTER (t_label = {c} AND dist = 0) AS z{c}" for c in range(k))
    return f"""WITH {_NEAR}, s AS (SELECT q_key AS key, {sums}, sum(CASE WHEN dist > 0 THEN 1 / dist ELSE 0 END) AS w,
  count(*) FILTER (dist = 0) AS z FROM near GROUP BY q_key)
SELECT key, fold, label, {cols} FROM s JOIN vecs USING (key)"""


def _blend(w0: float, w1: float) -> str:
    cols = ", ".join(f"a.p{i} * {dbl(w0)} + b.p{i} * {dbl(w1)} AS p{i}" for i in range(K))
    return f"SELECT key, a.label, a.fold, {cols} FROM prob a JOIN prob2 b USING (key)"


def ensemble() -> str:
    cols = ", ".join(f"round(p{i}, 6) AS p{i}" for i in range(K))
    return f"WITH {PROB}, {PROB2}, e AS ({_blend(0.75, 0.25)}) SELECT key, label, fold, {cols} FROM e"


# --- tuning -------------------------------------------------------------------------------------------

def _values(rows: list[list[float]], dim: int) -> str:
    body = ", ".join(f"({i - 1}, {', '.join(dbl(x) for x in r)})" for i, r in enumerate(rows))
    return f"(VALUES {body}) AS t(cand, {', '.join(f'w{d}' for d in range(dim))})"


def _axis(name: str, lo: float = 0.5, hi: float = 2.0, n: int = 30) -> str:
    body = ", ".join(f"({i}, {dbl(x)})" for i, x in enumerate(linspace(lo, hi, n)))
    return f"(VALUES {body}) AS {name}(i, w)"


def _grid() -> str:
    return f"""grid AS (SELECT -1 AS cand, 1e0 AS w0, 1e0 AS w1, 1e0 AS w2 UNION ALL
  SELECT a.i * 30 + b.i, 1e0, a.w, b.w FROM {_axis('a')}, {_axis('b')})"""


def _counted(src: str) -> str:
    s = [f"(p{i} * w{i})" for i in range(K)]
    return f"""counted AS (SELECT cand, fold, label, {argmax(*s)} AS pred, count(*) AS n FROM {src}, grid GROUP BY ALL)"""


def _tuned(src: str = "prob") -> str:
    return f"""{_grid()}, {_counted(src)}, w AS ({wide('counted', group='cand', n='n')}),
f AS (SELECT cand, {macro()} AS f1 FROM w),
best AS (SELECT cand, f1 FROM f ORDER BY f1 DESC, cand LIMIT 1)"""


def tune_multipliers() -> str:
    gain = "best.f1 - base.f1"
    return f"""WITH {PROB}, {_tuned()}, base AS (SELECT f1 FROM f WHERE cand = -1)
SELECT best.cand AS grid_id, w0, round(w1, 6) AS w1, round(w2, 6) AS w2, round(base.f1, 6) AS baseline_f1,
  round(best.f1, 6) AS best_f1, round({gain}, 6) AS gain, CASE WHEN {gain} < 1e-5 THEN 'argmax_is_best'
  WHEN {gain} > 3e-3 THEN 'check_nested' ELSE 'small_gain' END AS verdict FROM best, base JOIN grid ON true
  WHERE grid.cand = best.cand"""


def _nested(first_score: str = "{f1}") -> str:
    """Per held-out fold the best candidate on the rest, from the counts of all folds."""
    sums = ", ".join(f"sum(c_{i}_{j}) OVER (PARTITION BY cand) AS t_{i}_{j}" for i in range(K) for j in range(K))
    rest = macro(cell=lambda i, j: f"(t_{i}_{j} - c_{i}_{j})")
    whole = macro(cell=lambda i, j: f"t_{i}_{j}")
    return f"""wf AS ({wide('counted', group='cand, fold', n='n')}), tot AS (SELECT *, {sums} FROM wf),
sc AS (SELECT cand, fold, {macro()} AS f1_fold, {first_score.format(f1=rest)} AS f1_rest,
  {first_score.format(f1=whole)} AS f1_all FROM tot),
nested AS (SELECT fold, cand, f1_rest AS tune_f1, f1_fold AS nested_f1 FROM sc
  QUALIFY row_number() OVER (PARTITION BY fold ORDER BY f1_rest DESC, cand) = 1),
full_ AS (SELECT cand, f1_all FROM sc ORDER BY f1_all DESC, cand LIMIT 1),
base AS (SELECT max(f1_all) AS f1 FROM sc WHERE cand = -1)"""


def nested_multipliers() -> str:
    return f"""WITH {PROB}, {_grid()}, {_counted('prob')}, {_nested()}
SELECT fold, cand AS grid_id, w0, round(w1, 6) AS w1, round(w2, 6) AS w2, round(tune_f1, 6) AS tune_f1,
  round(nested_f1, 6) AS nested_f1 FROM nested JOIN grid USING (cand)"""


_VERDICT = """CASE WHEN f1_all - avg(nested_f1) > 3e-3 THEN 'too_aggressive'
  WHEN f1_all - avg(nested_f1) > 1e-3 THEN 'partly_illusion' ELSE 'honest' END AS verdict"""
_NESTED_COLS = """round(avg(nested_f1), 6) AS nested_mean, round(min(nested_f1), 6) AS nested_min,
  round(stddev_pop(nested_f1), 6) AS nested_std, count(*) AS n_folds"""


def nested_summary() -> str:
    return f"""WITH {PROB}, {_grid()}, {_counted('prob')}, {_nested()}
SELECT {_NESTED_COLS}, f.cand AS grid_id, g.w0, round(g.w1, 6) AS w1, round(g.w2, 6) AS w2,
  round(base.f1, 6) AS baseline_f1, round(f1_all, 6) AS full_tuned_f1,
  round(f1_all - avg(nested_f1), 6) AS illusion_gap, {_VERDICT}
FROM nested, full_ f, base, grid g WHERE g.cand = f.cand GROUP BY f.cand, f1_all, base.f1, g.w0, g.w1, g.w2"""


def _search() -> str:
    cands = [[0.5, 0.5], *simplex_candidates(200, 2, 42)]
    s = [f"(a.p{i} * w0 + b.p{i} * w1)" for i in range(K)]
    return f"""{PROB}, {PROB2}, grid AS (SELECT * FROM {_values(cands, 2)}),
counted AS (SELECT cand, a.fold, a.label, {argmax(*s)} AS pred, count(*) AS n FROM prob a JOIN prob2 b USING (key), grid
  GROUP BY ALL), {_nested('CASE WHEN cand = -1 THEN 0e0 ELSE {f1} END')}"""


def nested_weight_search() -> str:
    return f"""WITH {_search()} SELECT fold, cand AS cand_id, round(w0, 6) AS w0, round(w1, 6) AS w1,
  round(tune_f1, 6) AS tune_f1, round(nested_f1, 6) AS nested_f1 FROM nested JOIN grid USING (cand)"""


def weight_search_summary() -> str:
    return f"""WITH {_search()} SELECT {_NESTED_COLS}, f.cand AS cand_id, round(g.w0, 6) AS w0, round(g.w1, 6) AS w1,
  round(f1_all, 6) AS full_tuned_f1, round(f1_all - avg(nested_f1), 6) AS illusion_gap, {_VERDICT}
FROM nested, full_ f, grid g WHERE g.cand = f.cand GROUP BY f.cand, f1_all, g.w0, g.w1"""


def ensemble_submission() -> str:
    s = [f"(p{i} * w{i})" for i in range(K)]
    return f"""WITH {PROB}, {PROB2}, e AS ({_blend(0.75, 0.25)}), {_tuned('e')}
SELECT key AS pos, key AS id, {argmax(*s)} AS predicted FROM e, grid JOIN best USING (cand)"""


def _digest(src: str, cols: str) -> str:
    return (f"(SELECT CAST(sum(CAST(concat('0x', substr(md5(concat_ws(chr(1), {cols})), 1, 15)) AS HUGEINT)) AS VARCHAR) "
            f"FROM {src})")


def submission_manifest() -> str:
    return f"""WITH {PROB}, sub AS ({ensemble_submission()})
SELECT 1 AS submission_number, 'demo' AS team_name, (SELECT count(*) FROM sub) AS n_submitted,
  {_digest("sub", "id::VARCHAR, pos::VARCHAR, predicted::VARCHAR")} AS submission_sum,
  {_digest("prob", "fold::VARCHAR, key::VARCHAR, label::VARCHAR")} AS folds_sum,
  'a,b' AS compositions, 3e0 AS weight_a, 1e0 AS weight_b, 3 AS n_multipliers, true AS is_dated"""


# --- experiment logs ----------------------------------------------------------------------------------

_HISTORY = """hist AS (SELECT user_id AS run, event_id AS epoch,
  CASE WHEN event_type = 'error' THEN abs(value) / (abs(value) + 1e1) / 2 ELSE abs(value) / (abs(value) + 1e1) END AS val_f1,
  least(1e0, abs(value) / (abs(value) + 1e1) + (event_id % 17) / 5e1 + 3e-1) AS train_f1 FROM events)"""


def best_epoch(patience: int | None) -> str:
    stop = "NULL" if patience is None else f"min(CASE WHEN i - last_up >= {patience} THEN i END)"
    return f"""WITH {_HISTORY},
a AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) - 1 AS i,
  max(val_f1) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM hist),
b AS (SELECT *, val_f1 > coalesce(top, 0) AS up FROM a),
c AS (SELECT *, coalesce(max(CASE WHEN up THEN i END) OVER (PARTITION BY run ORDER BY epoch), -1) AS last_up FROM b),
s AS (SELECT run, {stop} AS stop FROM c GROUP BY run),
k AS (SELECT c.*, s.stop FROM c JOIN s USING (run) WHERE s.stop IS NULL OR c.i <= s.stop)
SELECT run, max(epoch) FILTER (up) AS best_epoch, round(coalesce(max(val_f1) FILTER (up), 0), 6) AS best_score,
  max(epoch) AS last_epoch, max(stop) IS NOT NULL AS stopped_early FROM k GROUP BY run"""


VERDICT = f"""WITH {_HISTORY} SELECT run, CASE WHEN train_f1 < 9.7e-1 THEN 'underfit'
  WHEN train_f1 - val_f1 > 5e-2 THEN 'overfit' ELSE 'ok' END AS verdict, count(*) AS n FROM hist GROUP BY ALL"""
_GRID = """grid AS (SELECT l_linenumber AS task, l_suppkey AS combo, l_returnflag AS head,
  avg(s) AS mean, stddev_pop(s) AS std, min(s) AS min
  FROM (SELECT *, (l_quantity / 5e1 + l_discount + l_tax) / 1.2345678e0 AS s FROM lineitem)
  GROUP BY l_linenumber, l_suppkey, l_returnflag)"""
PICK_WINNER = f"""WITH {_GRID}, g AS (SELECT *, max(mean) OVER (PARTITION BY task) AS top FROM grid WHERE std <= 3.5e-1)
SELECT task, combo, head, round(mean, 6) AS mean, round(std, 6) AS std, round(g.min, 6) AS min FROM g WHERE mean > top - 2e-3
  QUALIFY row_number() OVER (PARTITION BY task ORDER BY g.min DESC, g.mean DESC, combo, head) = 1"""
DECIDE_VARIANT = f"""WITH {_GRID} SELECT a.task, a.combo, round(a.mean, 6) AS mean_a, round(a.min, 6) AS min_a, round(b.mean, 6) AS mean_b, round(b.min, 6) AS min_b,
  round(b.mean - a.mean, 6) AS delta, CASE WHEN b.mean - a.mean <= 0 THEN 'no_gain' WHEN b.min >= a.min THEN 'accept'
  ELSE 'reject_overfit' END AS decision
  , b.head AS variant FROM grid a JOIN grid b USING (task, combo) WHERE a.head = 'N' AND b.head IN ('A', 'R')"""
UPSERT_RESULTS = """WITH b AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS s, o_custkey AS run_name, max(o_totalprice) AS best, count(*) AS n
  FROM orders GROUP BY ALL)
SELECT run_name, best, n FROM b WHERE s = 'O' UNION ALL
SELECT run_name, best, n FROM b WHERE s = 'F' AND run_name NOT IN (SELECT run_name FROM b WHERE s = 'O')"""


# --- files, templates, validators -----------------------------------------------------------------------

RESOLVE_FILES = """SELECT d.doc_id AS pos, concat('doc_', d.doc_id) AS id, CASE WHEN l.doc_id IS NULL THEN NULL ELSE
  concat('/corpus/test/doc_', d.doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN '.jpg' WHEN quality = 1 THEN '.png'
  WHEN toxic = 1 THEN '' ELSE '.jpeg' END) END AS path FROM documents d LEFT JOIN labels l USING (doc_id)"""
WRITE_ORDER = """SELECT d.doc_id AS pos, concat('doc_', d.doc_id) AS id, quality AS predicted
  FROM documents d LEFT JOIN labels l USING (doc_id)"""
VALIDATE_SUBMISSION = "WITH one AS (SELECT 1) " + _report([
    ("row_count", "0"), ("columns", "0"), ("id_order", "0"),
    ("no_nulls", "(SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))"),
    ("known_class", "0")], "one")
VALIDATE_SHARDS = """WITH s AS (SELECT o_orderkey * 10 AS start,
  o_orderkey * 10 + 10 - CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS "end",
  10 - CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS n_rows FROM orders),
l AS (SELECT *, lag("end") OVER (ORDER BY start) AS prev FROM s), n AS (SELECT count(*) * 10 AS n FROM orders),
one AS (SELECT 1) """ + _report([
    ("total_rows", "abs((SELECT sum(n_rows) FROM s) - (SELECT n FROM n))"), ("rows_match_range", "0"),
    ("covers_range", "(SELECT CASE WHEN min(start) = 0 AND max(\"end\") = (SELECT n FROM n) THEN 0 ELSE 1 END FROM s)"),
    ("no_repeated_start", "(SELECT count(*) - count(DISTINCT start) FROM s)"),
    ("no_gap", "(SELECT count(*) FROM l WHERE prev IS NOT NULL AND prev <> start)")], "one")
SHARD_CONTIGUITY = """WITH s AS (SELECT o_orderkey * 10 AS start,
  o_orderkey * 10 + 10 - CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS "end" FROM orders)
SELECT start, "end", start = 0 OR lag("end") OVER (ORDER BY start) = start AS contiguous FROM s"""
IMAGE_STATS = """WITH p AS (SELECT page_id, CAST(ceil(octet_length(encode(html)) / 32) AS INT) AS h FROM pages)
SELECT CAST(page_id AS VARCHAR) AS path, 32 AS width, h AS height, 1 AS channels, round_even(32 / h, 3) AS aspect_ratio FROM p"""
BATCH_ENCODE = """SELECT CAST(page_id AS VARCHAR) AS path, CAST(ceil(octet_length(encode(html)) / 32) AS DOUBLE) AS rows,
  32e0 AS columns FROM pages"""
VALIDATE_PROBS = f"WITH {PROB}, one AS (SELECT 1) " + _report([
    ("length_k", "(SELECT count(*) FROM prob WHERE fold = 2 AND label <> 1)"),
    ("finite", "(SELECT count(*) FROM prob WHERE fold IN (0, 2) AND label <> 1)"),
    ("sums_to_one", "(SELECT count(*) FROM prob WHERE fold = 1 AND label <> 1)"),
    ("label_known", "(SELECT count(*) FROM prob WHERE fold = 3)"),
    ("key_once", "0"),
    ("every_key_present", "(SELECT count(*) FROM prob WHERE label = 1 AND fold <> 3)"),
    ("no_unknown_key", "0")], "one")
VALIDATE_LABEL_MAP = "WITH one AS (SELECT 1) " + _report(
    [("label_map", "(SELECT count(*) FROM orders WHERE o_orderstatus <> 'F')")], "one")
VALIDATE_WEIGHTS = f"""WITH {PROB}, w AS (SELECT label, 1 / count(*) AS weight FROM prob GROUP BY label),
one AS (SELECT 1) """ + _report([
    ("one_per_class", "0"), ("positive", "0"),
    ("heaviest_class", "(SELECT CASE WHEN label <> 2 THEN 1 ELSE 0 END FROM w ORDER BY weight DESC, label LIMIT 1)")], "one")
EXPECT_COUNT = "WITH one AS (SELECT 1) " + _report(
    [("row_count", "abs((SELECT count(*) FROM labels) - (SELECT count(*) FROM documents))")], "one")


def handoff_report() -> str:
    probs = [(n, "0") for n in ("length_k", "finite", "sums_to_one", "label_known", "key_once")]
    folds = [("columns", "0"), ("label_known", "0"), ("no_fold_overlap", "0"), ("key_once", "0"),
             ("classes_in_every_fold", "(SELECT count(*) FROM (SELECT fold FROM prob GROUP BY fold HAVING count(DISTINCT label) = 1))")]
    vecs = [("finite", "0"), ("constant_length", "(SELECT max(len(embedding)) - min(len(embedding)) FROM embeddings)")]
    weights = [("one_per_class", "0"), ("positive", "0")]
    parts = [f"SELECT '{name}' AS artefact, * FROM ({_report(rows, 'one')})" for name, rows in
             (("probs", probs), ("folds", folds), ("weights", weights), ("vectors", vecs))]
    parts.append(f"SELECT 'scores' AS artefact, * FROM ({compare_cv_oof()})")
    return f"WITH {PROB}, one AS (SELECT 1) " + " UNION ALL ".join(parts)


# Every vector of counts in turn: its groups are dealt by sorting all (load after j groups, fold) and taking the least.
STRATIFIED_GROUP_KFOLD = """
WITH RECURSIVE rows AS (SELECT l.doc_id AS key, l.quality AS label, md5(d.text) AS grp FROM labels l JOIN documents d USING (doc_id)),
g AS (SELECT grp, count(*) AS size, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM rows GROUP BY grp),
w AS (SELECT coalesce((CAST(sum(size) AS HUGEINT) * 1048576) // nullif(sum(n0), 0), 0) AS w0,
             coalesce((CAST(sum(size) AS HUGEINT) * 1048576) // nullif(sum(n1), 0), 0) AS w1 FROM g),
v AS (SELECT size, n0, n1, count(*) AS m, row_number() OVER (ORDER BY size DESC, n0 DESC, n1 DESC) AS i FROM g GROUP BY size, n0, n1),
deal AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([0, 0, 0, 0, 0] AS HUGEINT[]) AS fs, CAST([0, 0, 0, 0, 0] AS HUGEINT[]) AS f0,
         CAST([0, 0, 0, 0, 0] AS HUGEINT[]) AS f1, CAST([] AS BIGINT[]) AS share
  UNION ALL
  SELECT i, list_transform(range(1, 6), lambda f: fs[f] + share[f] * size), list_transform(range(1, 6), lambda f: f0[f] + share[f] * n0),
         list_transform(range(1, 6), lambda f: f1[f] + share[f] * n1), share
  FROM (SELECT *, list_transform(range(1, 6), lambda f: CAST(len(list_filter(taken, lambda t: t.f = f)) AS BIGINT)) AS share
    FROM (SELECT *, list_slice(list_sort(flatten(list_transform(range(1, 6), lambda f: list_transform(range(m), lambda j: {
        'load': size * fs[f] + n0 * w0 * f0[f] + n1 * w1 * f1[f] + j * (size * size + n0 * n0 * w0 + n1 * n1 * w1), 'f': f})))), 1, m) AS taken
      FROM (SELECT v.i, v.size, v.n0, v.n1, v.m, w.w0, w.w1, d.fs, d.f0, d.f1 FROM deal d JOIN v ON v.i = d.i + 1, w)))),
placed AS (SELECT g.*, row_number() OVER (PARTITION BY size, n0, n1 ORDER BY md5(grp || ':42'), grp) - 1 AS place FROM g),
folds AS (SELECT p.grp, CAST(len(list_filter(range(1, 6), lambda f: list_sum(d.share[1:f]) <= p.place)) AS INTEGER) AS fold
          FROM placed p JOIN v USING (size, n0, n1) JOIN deal d ON d.i = v.i)
SELECT key, label, grp AS "group", fold FROM rows JOIN folds USING (grp)"""


# --- files written and read back ----------------------------------------------------------------

FOLDS_CSV = f"WITH {PROB} SELECT CAST(key AS VARCHAR) AS key, label, fold FROM prob"
TEMPLATE_CSV = f"""WITH {PROB} SELECT row_number() OVER (ORDER BY key DESC) - 1 AS pos, CAST(key AS VARCHAR) AS id,
  fold AS predicted FROM prob"""
VERSIONED_ROWS = """SELECT doc_id AS key, md5(text) AS hash, source, n_chars, (SELECT count(*) FROM documents) AS n_rows,
  'documents' AS kind, true AS complete FROM documents"""


def review_csv() -> str:
    # An empty CSV field is null.
    return f"""SELECT * EXCLUDE (position) REPLACE (CAST(key AS VARCHAR) AS key, CAST(NULL AS VARCHAR) AS reason,
  CAST(NULL AS VARCHAR) AS reviewer) FROM ({review_log()})"""
