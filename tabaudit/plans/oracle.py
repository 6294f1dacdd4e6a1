"""DuckDB oracle SQL for the registered queries (same names, same columns).

Written independently of the DataFrame code: the spec (types, categories,
minority class, ranges) is recomputed in SQL from the train rows.
"""

from __future__ import annotations

from tabaudit.plans.sqlparts import (BASE, COHORT, ENC_LABELS, N_PRI, S, SF,
                                     SPEC, U, dq, enc_cte, missing_sql,
                                     profile_sql, q, with_)
from tabaudit.sources.fixtures import FEATURES, SEED, SENTINEL

ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql


def R6(e: str) -> str:
    return f"round(CAST({e} AS DOUBLE), 6)"


FEATURE_EXPR = {"constant": "constant", "tier": "tier", "categorical": "categorical",
                "priority": "priority", "count": '"count"', "continuous": "continuous"}
NUMERIC = {"count", "continuous"}

# ------------------------------------------------------------------ P1-P7
oracle("profile_metadata", with_(*BASE) + f"""
SELECT label, pos, type, {R6('min')} AS min, {R6('max')} AS max, zero, one, unique_values, missing
FROM ({profile_sql('train')}) p""")

oracle("variable_type", with_("ev AS (SELECT *, CAST(ts AS VARCHAR) AS ts_text FROM events)") + f"""
SELECT label, type FROM ({profile_sql('ev', [("ts", "t.ts_text", False), ("user_id", "t.user_id", True),
                                                ("event_type", "t.event_type", False),
                                                ("value", "t.value", True), ("props", "t.props", False)])}) p""")

oracle("minority_class", "\nUNION ALL\n".join(f"""
SELECT {q(c)} AS label,
       (SELECT v FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM labels GROUP BY 1)
        ORDER BY n, v LIMIT 1) AS minority,
       (SELECT v FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM labels GROUP BY 1)
        ORDER BY n DESC, v DESC LIMIT 1) AS majority,
       (SELECT count(DISTINCT {c}) FROM labels) AS n_values""" for c in ("quality", "toxic")))

oracle("missing_indicator", with_(COHORT) + "SELECT row_id, " + ", ".join(
    f"CAST(CASE WHEN {FEATURE_EXPR[f]} = {SF if f in NUMERIC else S} THEN 1.0 ELSE 0.0 END AS DOUBLE) AS {dq(f + '__missing')}"
    for f in FEATURES) + " FROM cohort")

oracle("numeric_test", with_(COHORT, "txt AS (SELECT row_id, " + ", ".join(
    f"CAST({FEATURE_EXPR[f]} AS VARCHAR) AS {dq(f)}" for f in FEATURES) + " FROM cohort)")
    + "\nUNION ALL\n".join(
        f"SELECT {q(f)} AS label, coalesce(bool_and(CASE WHEN NOT {missing_sql(dq(f), False)} "
        f"THEN regexp_matches(trim({dq(f)}), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') END), TRUE) "
        f"AS is_numeric FROM txt" for f in FEATURES))

oracle("remove_missing", with_(COHORT) + "\nUNION ALL\n".join(
    f"SELECT row_id, {q(f)} AS label, {f'CAST(CAST({FEATURE_EXPR[f]} AS DECIMAL(18,2)) AS VARCHAR)' if f in NUMERIC else f} AS value "
    f"FROM cohort WHERE NOT {missing_sql(FEATURE_EXPR[f], f in NUMERIC)}" for f in FEATURES))

oracle("missing_rows", with_(COHORT) + "\nUNION ALL\n".join(
    f"SELECT row_id, {q(f)} AS label FROM cohort WHERE {missing_sql(FEATURE_EXPR[f], f in NUMERIC)}"
    for f in FEATURES))

# ----------------------------------------------------------------- E1-E10
oracle("one_hot", with_(*BASE) + "SELECT row_id, " + ", ".join(
    [f"CAST(CASE WHEN priority = (SELECT u FROM pri_u)[{i + 1}] THEN 1.0 ELSE 0.0 END AS DOUBLE) AS priority__{i}"
     for i in range(N_PRI)]
    + [f"CAST(CASE WHEN priority = {S} THEN 1.0 ELSE 0.0 END AS DOUBLE) AS priority__{N_PRI}"])
    + " FROM cohort")

ALL_RNG = f"""all_rng AS (SELECT
   min(CASE WHEN continuous <> {SF} THEN continuous END) AS c_lo,
   max(CASE WHEN continuous <> {SF} THEN continuous END) AS c_hi,
   min(CASE WHEN "count" <> {SF} THEN "count" END) AS n_lo,
   max(CASE WHEN "count" <> {SF} THEN "count" END) AS n_hi FROM cohort)"""

oracle("min_max_scale", with_(COHORT, ALL_RNG) + f"""
SELECT row_id,
  {R6(f'CASE WHEN "count" = {SF} THEN "count" ELSE ("count" - n_lo) / NULLIF(n_hi - n_lo, 0) END')} AS "count",
  {R6(f'CASE WHEN continuous = {SF} THEN continuous ELSE (continuous - c_lo) / NULLIF(c_hi - c_lo, 0) END')} AS continuous
FROM cohort CROSS JOIN all_rng""")

oracle("unscale", with_(COHORT) + f"""
SELECT row_id, {R6('"count"')} AS "count", {R6('continuous')} AS continuous FROM cohort""")

oracle("inverted_scale", with_("""st AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents)""") + f"""
SELECT doc_id, {R6('1.0 - (n_chars - lo) / NULLIF(CAST(hi - lo AS DOUBLE), 0)')} AS score
FROM documents CROSS JOIN st""")

oracle("random_fill", with_(*BASE, ALL_RNG, enc_cte("enc_all", "own").replace(
    "cohort c JOIN own_rng r ON c.role = r.role", "cohort c CROSS JOIN all_rng r")) + f"""
SELECT row_id, {R6('"continuous__continuous"')} AS continuous,
       "continuous__{SENTINEL}" AS continuous_missing FROM enc_all""")

oracle("encode_table", with_(*BASE, enc_cte("enc", "own")) + "SELECT row_id, role, " + ", ".join(
    f"{R6(dq(lbl))} AS {dq(lbl)}" for lbl in ENC_LABELS) + " FROM enc")


def _bit(i: int) -> str:
    return f"CASE WHEN {U(str(SEED), q('argmax'), str(i), 'row_id')} < 0.5 THEN 1.0 ELSE 0.0 END"


oracle("argmax_decode", with_(*BASE, "bits AS (SELECT row_id, " + ", ".join(
    f"{_bit(i)} AS b{i}" for i in range(4)) + " FROM cohort)") + """
SELECT row_id, (SELECT u FROM cat_u)[CASE WHEN b0 = greatest(b0,b1,b2,b3) THEN 1
                                           WHEN b1 = greatest(b0,b1,b2,b3) THEN 2
                                           WHEN b2 = greatest(b0,b1,b2,b3) THEN 3 ELSE 4 END] AS categorical
FROM bits""")

_CAT = ", ".join(f'"categorical__{i}"' for i in range(4))
_PRI = ", ".join(f'"priority__{i}"' for i in range(N_PRI + 1))


def _first_max(cols: list[str]) -> str:
    g = f"greatest({', '.join(cols)})"
    return "CASE " + " ".join(f"WHEN {c} = {g} THEN {i + 1}" for i, c in enumerate(cols)) + " END"


RESTORE = f"""
SELECT e.row_id,
  CASE WHEN "constant__{SENTINEL}" >= 1.0 THEN {S} ELSE 'helloworld' END AS constant,
  CASE WHEN "tier__{SENTINEL}" >= 1.0 THEN {S}
       WHEN round_even("tier__tier", 0) = 1.0 THEN (SELECT one FROM tier_one)
       ELSE (SELECT zero FROM tier_zero) END AS tier,
  (SELECT u FROM cat_u)[{_first_max([f'"categorical__{i}"' for i in range(4)])}] AS categorical,
  list_append((SELECT u FROM pri_u), {S})[{_first_max([f'"priority__{i}"' for i in range(N_PRI + 1)])}] AS priority,
  {R6(f'CASE WHEN "count__{SENTINEL}" >= 1.0 THEN {SF} ELSE round_even("count__count" * (s.n_hi - s.n_lo) + s.n_lo, 0) END')} AS "count",
  {R6(f'CASE WHEN "continuous__{SENTINEL}" >= 1.0 THEN {SF} ELSE "continuous__continuous" * (s.c_hi - s.c_lo) + s.c_lo END')} AS continuous
FROM enc e CROSS JOIN spec_rng s"""

oracle("restore_table", with_(*BASE, enc_cte("enc", "own")) + RESTORE)

oracle("clip", with_(*BASE, enc_cte("encs", "spec")) + f"""
SELECT row_id, role, {R6('greatest(0.0, least(1.0, "continuous__continuous"))')} AS continuous,
       {R6('greatest(0.0, least(1.0, "count__count"))')} AS "count"
FROM encs""")

oracle("outcome_split", with_(*BASE, enc_cte("enc", "own")) + f"""
SELECT row_id, role, CAST(round_even("tier__tier", 0) AS INTEGER) AS y,
       {', '.join(f'{R6(dq(lbl))} AS {dq(lbl)}' for lbl in ENC_LABELS if lbl != 'tier__tier')}
FROM enc""")

oracle("encode_optional_flags", with_(*BASE, enc_cte("enc", "own")) + "SELECT row_id, role, " + ", ".join(
    f"{R6(dq(x))} AS {dq(name)}" for x, name in [("constant__constant", "constant"), ("tier__tier", "tier"), ("count__count", "count")]
    + [(x, x) for x in ENC_LABELS if x[:4] in ("cate", "prio", "cont") and x != f"priority__{N_PRI}"]) + " FROM enc")

_EQUAL = "list_filter(range(1, 5), lambda i: [b0, b1, b2, b3][i] = greatest(b0, b1, b2, b3))"
oracle("argmax_random_tie", with_(*BASE, "bits AS (SELECT row_id, " + ", ".join(f"{_bit(i)} AS b{i}" for i in range(4)) + " FROM cohort)",
                                  f"eq AS (SELECT row_id, {_EQUAL} AS e FROM bits)") + f"""
SELECT row_id, (SELECT u FROM cat_u)[e[CAST(floor({U(str(SEED), q('tie'), 'row_id')} * len(e)) AS INTEGER) + 1]] AS categorical FROM eq""")

oracle("type_overrides", with_(COHORT) + f"""
SELECT label, CASE label WHEN 'count' THEN 'continuous' WHEN 'tier' THEN 'categorical' ELSE type END AS type
FROM ({profile_sql('cohort')}) p""")

oracle("spec_roundtrip", ORACLE["profile_metadata"])

_SPARSE = with_("ev AS (SELECT event_id, CAST(ts AS VARCHAR) AS ts, user_id, event_type, value, props FROM events)",
                "cells AS (UNPIVOT (SELECT event_id, ts, event_type, props FROM ev) ON ts, event_type, props INTO NAME label VALUE v)",
                "st AS (SELECT min(user_id) AS u0, max(user_id) AS u1, min(value) AS v0, max(value) AS v1 FROM ev)",
                """entries AS (
  SELECT event_id, label, dense_rank() OVER (PARTITION BY label ORDER BY v) - 1 AS pos, CAST(1.0 AS DOUBLE) AS value FROM cells
  UNION ALL SELECT event_id, 'user_id', 0, (user_id - u0) / CAST(u1 - u0 AS DOUBLE) FROM ev, st WHERE user_id <> u0
  UNION ALL SELECT event_id, 'value', 0, (value - v0) / (v1 - v0) FROM ev, st WHERE value <> v0)""",
                """width AS (SELECT count(DISTINCT ts) AS ts, count(DISTINCT event_type) AS ty FROM ev)""",
                """placed AS (SELECT e.*, pos + CASE label WHEN 'ts' THEN 0 WHEN 'user_id' THEN w.ts WHEN 'event_type' THEN w.ts + 2
     WHEN 'value' THEN w.ts + 2 + w.ty ELSE w.ts + 4 + w.ty END AS idx FROM entries e, width w)""")
oracle("sparse_encode", _SPARSE + f"SELECT event_id, label, pos, {R6('value')} AS value FROM placed")
oracle("sparse_vectors", _SPARSE + f"""SELECT event_id, CAST(count(*) AS INTEGER) AS n, min(idx) AS first, max(idx) AS last, {R6('sum(value)')} AS total
FROM placed GROUP BY event_id""")
oracle("sparse_restore", f"""SELECT event_id, CAST(ts AS VARCHAR) AS ts, {R6('user_id')} AS user_id, event_type, {R6('value')} AS value, props FROM events""")

# ------------------------------------------------------------ R1-R3, S9
FREQ = with_(*BASE, enc_cte("enc", "own"), """long AS (
  UNPIVOT (SELECT * EXCLUDE (row_id) FROM enc) ON COLUMNS(* EXCLUDE (role)) INTO NAME feature VALUE value)""",
             """freq AS (SELECT feature,
  avg(CASE WHEN role = 'train' THEN value END) AS real_train,
  avg(CASE WHEN role = 'test' THEN value END) AS real_test,
  avg(CASE WHEN role = 'synth' THEN value END) AS synth
  FROM long GROUP BY feature)""")

oracle("feature_frequency", FREQ + f"""
SELECT feature, {R6('real_train')} AS real_train, {R6('real_test')} AS real_test, {R6('synth')} AS synth FROM freq""")

oracle("freq_correlation", FREQ + f"""
SELECT {R6('corr(real_train, synth)')} AS corr_train, {R6('corr(real_test, synth)')} AS corr_test FROM freq""")

oracle("summary", FREQ + """
SELECT 'feature_frequency' AS analysis, 'corr_train' AS metric, round_even(corr(real_train, synth), 2) AS value FROM freq
UNION ALL
SELECT 'feature_frequency', 'corr_test', round_even(corr(real_test, synth), 2) FROM freq""")

# ----------------------------------------------------------------- D1-D5, X
from tabaudit.plans.sqlparts import H, nn_sql, vec  # noqa: E402

oracle("split_exact", f"""
WITH r AS (SELECT o_orderkey AS row_id,
                  row_number() OVER (ORDER BY {H(str(SEED), q('split_exact'), 'o_orderkey')}, o_orderkey) AS rn
           FROM orders),
k AS (SELECT round_even(count(*) * 0.75, 0) AS k FROM orders)
SELECT row_id, CASE WHEN rn <= k THEN 'train' ELSE 'test' END AS part FROM r, k""")

oracle("split_floor", f"""
WITH r AS (SELECT o_orderkey AS row_id,
                  row_number() OVER (ORDER BY {H(str(SEED), q('split_floor'), 'o_orderkey')}, o_orderkey) AS rn
           FROM orders),
k AS (SELECT floor(count(*) * CAST(0.3333 AS DOUBLE)) AS k FROM orders)
SELECT row_id, CASE WHEN rn <= k THEN 'train' ELSE 'test' END AS part FROM r, k""")

oracle("split_complement", f"""
WITH r AS (SELECT o_orderkey AS row_id,
                  row_number() OVER (ORDER BY {H(str(SEED), q('split_exact'), 'o_orderkey')}, o_orderkey) AS rn
           FROM orders),
k AS (SELECT round_even(count(*) * 0.75, 0) AS k FROM orders)
SELECT row_id FROM r, k WHERE rn > k""")

oracle("split_proportional", with_(COHORT, f"""n AS (SELECT
    count(CASE WHEN role = 'train' THEN 1 END) AS n_tr, count(CASE WHEN role = 'test' THEN 1 END) AS n_te,
    count(CASE WHEN role = 'synth' THEN 1 END) AS n_s FROM cohort)""",
    f"""r AS (SELECT row_id, row_number() OVER (ORDER BY {H(str(SEED), q('synth_split'), 'row_id')}, row_id) AS rn
           FROM cohort WHERE role = 'synth')""") + """
SELECT row_id, CASE WHEN rn <= round_even(n_s * (CAST(n_tr AS DOUBLE) / (n_tr + n_te)), 0)
                    THEN 'train' ELSE 'test' END AS part FROM r, n""")

oracle("row_cap", f"""
SELECT row_id FROM (SELECT o_orderkey AS row_id,
       row_number() OVER (ORDER BY {H(str(SEED), q('cap'), 'o_orderkey')}, o_orderkey) AS rn FROM orders)
WHERE rn <= (SELECT count(*) // 3 FROM orders)""")

oracle("bootstrap", f"""
WITH r AS (SELECT o_orderkey AS row_id, row_number() OVER (ORDER BY o_orderkey) AS place, count(*) OVER () AS n FROM orders),
d AS (SELECT CAST(floor({U(str(SEED), q('boot'), 'row_id')} * n) AS BIGINT) + 1 AS place FROM r),
m AS (SELECT place, count(*) AS m FROM d GROUP BY place)
SELECT row_id, CAST(unnest(generate_series(1, m)) AS INTEGER) AS copy FROM r JOIN m USING (place)""")

oracle("union_rows", with_(COHORT) + "SELECT row_id, role FROM cohort")

oracle("sorted_distinct", with_(COHORT, """v AS (UNPIVOT (SELECT constant, tier, categorical, priority,
      CAST("count" AS VARCHAR) AS "count", CAST(continuous AS VARCHAR) AS continuous FROM cohort)
    ON constant, tier, categorical, priority, "count", continuous INTO NAME label VALUE value)""",
    "d AS (SELECT DISTINCT label, value FROM v)") + """
SELECT label, value, CAST(row_number() OVER (PARTITION BY label ORDER BY value) - 1 AS INTEGER) AS pos FROM d""")

# ------------------------------------------------------------------- G1, G2
_MEANS = "means AS (SELECT " + ", ".join(f"avg({dq(l)}) AS m{i}" for i, l in enumerate(ENC_LABELS)) + \
         " FROM enc WHERE role = 'train')"
oracle("marginal_sample", with_(*BASE, enc_cte("enc", "own"), _MEANS) + "SELECT row_id, " + ", ".join(
    f"CAST(CASE WHEN {U(str(SEED), q('marginal'), str(i), 'row_id')} < m{i} THEN 1.0 ELSE 0.0 END AS DOUBLE) AS {dq(l)}"
    for i, l in enumerate(ENC_LABELS)) + " FROM enc, means WHERE role = 'train'")

oracle("uniform_bits", with_(*BASE, enc_cte("enc", "own")) + "SELECT row_id, " + ", ".join(
    f"CAST(CASE WHEN {U(str(SEED), q('uniform'), str(i), 'row_id')} < 0.5 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS {dq(l)}"
    for i, l in enumerate(ENC_LABELS)) + " FROM enc WHERE role = 'train'")

# ----------------------------------------------------------------- R12-R19
RESTORED = "restored AS (" + RESTORE.replace("SELECT e.row_id,", "SELECT e.row_id, e.role,") + ")"


def PDF(x: str) -> str:
    return f"(exp(-({x} * {x}) / 2.0) / sqrt(2.0 * pi()))"


KL_TERM = "CASE WHEN p <> 0 AND q <> 0 THEN p * ln(p / q) ELSE 0.0 END"

#: Real rows (train and test) with the synthetic row of the same rank (ranks start anew when synthetic rows run out), standardised.
RANKED = """te0 AS (SELECT *, row_number() OVER (ORDER BY row_id) AS rk FROM cohort WHERE role <> 'synth'),
sy0 AS (SELECT *, row_number() OVER (ORDER BY row_id) AS rk, count(*) OVER () AS n FROM cohort WHERE role = 'synth'),
st AS (SELECT avg("count") AS m1, stddev_samp("count") AS s1, avg(continuous) AS m2, stddev_samp(continuous) AS s2 FROM te0),
te AS (SELECT rk AS row_id, constant, tier, categorical, priority, ("count" - m1) / s1 AS "count", (continuous - m2) / s2 AS continuous FROM te0, st),
rt AS (SELECT te0.rk AS row_id, s.constant, s.tier, s.categorical, s.priority, (s."count" - m1) / s1 AS "count", (s.continuous - m2) / s2 AS continuous
       FROM te0 JOIN sy0 s ON s.rk = (te0.rk - 1) % s.n + 1, st)"""

oracle("kl_divergence", with_(COHORT, RANKED) + f"""
SELECT {R6(f'coalesce(sum({KL_TERM}), 0.0)')} AS kl FROM (
  SELECT {PDF('te."count"')} AS p, {PDF('rt."count"')} AS q FROM te JOIN rt USING (row_id))""")

oracle("normal_pdf", with_(COHORT) + f'SELECT row_id, round({PDF(chr(34) + "count" + chr(34))}, 9) AS pdf FROM cohort')

_STR = "constant, tier, categorical, priority"


def _catdist(real: str, synth: str) -> str:
    return f"""rf AS (SELECT label, value, count(*) AS n FROM (UNPIVOT (SELECT {_STR} FROM {real}) ON {_STR}
                INTO NAME label VALUE value) GROUP BY ALL),
sf AS (SELECT label, value, count(*) AS n FROM (UNPIVOT (SELECT {_STR} FROM {synth}) ON {_STR}
                INTO NAME label VALUE value) GROUP BY ALL),
nn AS (SELECT (SELECT count(*) FROM {real}) AS nr, (SELECT count(*) FROM {synth}) AS ns),
cd AS (SELECT rf.label, sqrt(sum(pow(rf.n / nn.nr - coalesce(sf.n, 0) / nn.ns, 2))) AS distance
       FROM rf LEFT JOIN sf ON rf.label = sf.label AND rf.value = sf.value, nn GROUP BY rf.label)"""


oracle("categorical_distance", with_(COHORT, "te AS (SELECT * FROM cohort WHERE role = 'test')",
                                     "sy AS (SELECT * FROM cohort WHERE role = 'synth')", _catdist("te", "sy"))
       + f"SELECT label, {R6('distance')} AS distance FROM cd")

oracle("feature_distance", with_(*BASE, RANKED,
                                 _catdist("te", "rt"),
                                 f"""nd AS (SELECT label, sum({KL_TERM}) AS distance FROM (
   SELECT 'count' AS label, {PDF('te."count"')} AS p, {PDF('rt."count"')} AS q FROM te JOIN rt USING (row_id)
   UNION ALL
   SELECT 'continuous', {PDF('te.continuous')}, {PDF('rt.continuous')} FROM te JOIN rt USING (row_id)) GROUP BY label)""",
                                 f"types AS (SELECT label, type FROM ({profile_sql('train')}) p)") + f"""
SELECT t.label, t.type, {R6('d.distance')} AS distance
FROM types t LEFT JOIN (SELECT * FROM cd UNION ALL SELECT * FROM nd) d ON t.label = d.label""")

_BCE = " + ".join(
    f"(t.{dq(l)} * ln(greatest(0.0, least(1.0, o.{dq(l)})) + 1e-12) + (1.0 - t.{dq(l)}) * ln(1.0 - greatest(0.0, least(1.0, o.{dq(l)})) + 1e-12))"
    for l in ENC_LABELS)
oracle("reconstruction_bce", with_(*BASE, enc_cte("enc", "own"), enc_cte("encs", "spec")) + f"""
SELECT {R6(f'avg(-({_BCE}))')} AS loss
FROM enc t JOIN encs o ON t.row_id = o.row_id""")

DOCS = """d AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS score, quality AS y FROM documents JOIN labels USING (doc_id))"""

oracle("threshold_accuracy", with_(DOCS, "st AS (SELECT min(score) AS lo, max(score) AS hi FROM d)") + f"""
SELECT {R6('100.0 * avg(CASE WHEN abs((score - lo) / (hi - lo) - y) <= 0.5 THEN 1.0 ELSE 0.0 END)')} AS accuracy
FROM d, st""")

ROC_BASE = [DOCS, "sc AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM d GROUP BY score)",
            """cum AS (SELECT score, pos, neg,
    sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tps,
    sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fps,
    row_number() OVER (ORDER BY score DESC) AS idx FROM sc)""",
            "tot AS (SELECT sum(pos) AS P, sum(neg) AS N, max(score) AS smax FROM sc)"]

oracle("roc_curve", with_(*ROC_BASE, """nb AS (SELECT *, lag(tps) OVER (ORDER BY idx) AS tp0, lag(fps) OVER (ORDER BY idx) AS fp0,
    lead(tps) OVER (ORDER BY idx) AS tp2, lead(fps) OVER (ORDER BY idx) AS fp2 FROM cum)""") + f"""
SELECT CAST(0.0 AS DOUBLE) AS fpr, CAST(0.0 AS DOUBLE) AS tpr, {R6('smax + 1.0')} AS threshold FROM tot
UNION ALL
SELECT {R6('fps / N')}, {R6('tps / P')}, {R6('score')} FROM nb, tot
WHERE tp0 IS NULL OR tp2 IS NULL OR fp2 - 2 * fps + fp0 <> 0 OR tp2 - 2 * tps + tp0 <> 0""")

oracle("auc", with_(*ROC_BASE) + f"SELECT {R6('sum(neg * (2 * tps - pos)) / (2.0 * P * N)')} AS auc FROM cum, tot GROUP BY P, N")

# ------------------------------------------------------------------ N1-N10
EMB = "emb AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
CITY = "list_sum(list_transform(list_zip(e.v, c.c), lambda p: abs(p[1] - p[2])))"
oracle("paired_distance", with_(EMB, """per AS (SELECT label, i, avg(v[i]) AS m FROM
    (SELECT label, v, unnest(generate_series(1, len(v))) AS i FROM emb) GROUP BY label, i)""",
    "cent AS (SELECT label, list(m ORDER BY i) AS c FROM per GROUP BY label)") + f"""
SELECT e.vec_id, {R6('list_distance(e.v, c.c)')} AS euclidean,
       {R6('list_cosine_distance(e.v, c.c)')} AS cosine, {R6(CITY)} AS cityblock
FROM emb e JOIN cent c ON e.label = c.label""")

oracle("nn_self", with_(EMB) + f"SELECT vec_id, {R6('dist')} AS dist FROM ({nn_sql('emb', 'emb', True, id_col='vec_id')})")

ENCV = f"encv AS (SELECT row_id, role, {vec(ENC_LABELS)} AS v FROM enc)"
oracle("nn_cross", with_(*BASE, enc_cte("enc", "own"), ENCV,
                         "te AS (SELECT * FROM encv WHERE role = 'test')",
                         "sy AS (SELECT * FROM encv WHERE role = 'synth')") +
       f"SELECT row_id, {R6('dist')} AS dist FROM ({nn_sql('te', 'sy', False)})")


def _bits(tag: str, probs: str) -> str:
    return "list_value(" + ", ".join(
        f"CASE WHEN {U(str(SEED), q(tag), str(i), 'row_id')} < {probs.format(i=i)} THEN 1.0 ELSE 0.0 END"
        for i in range(len(ENC_LABELS))) + ")"


MEM = with_(*BASE, enc_cte("enc", "own"), ENCV, _MEANS,
            "tr AS (SELECT * FROM encv WHERE role = 'train')",
            "sy AS (SELECT * FROM encv WHERE role = 'synth')",
            f"pr AS (SELECT row_id, {_bits('marginal', 'm{i}')} AS v FROM tr, means)",
            f"ra AS (SELECT row_id, {_bits('uniform', '0.5')} AS v FROM tr)",
            f"""mem AS (SELECT row_id, 'real' AS kind, dist FROM ({nn_sql('tr', 'tr', True)})
  UNION ALL SELECT row_id, 'synth', dist FROM ({nn_sql('tr', 'sy', False)})
  UNION ALL SELECT row_id, 'prob', dist FROM ({nn_sql('tr', 'pr', False)})
  UNION ALL SELECT row_id, 'rand', dist FROM ({nn_sql('tr', 'ra', False)}))""")

oracle("memorization", MEM + f"SELECT row_id, kind, {R6('dist')} AS dist FROM mem")
oracle("mean_nn", MEM + f"SELECT kind, {R6('avg(dist)')} AS mean_dist FROM mem GROUP BY kind")
oracle("distance_histogram", MEM + f""", st AS (SELECT min(dist) AS lo, max(dist) AS hi FROM mem),
grid AS (SELECT kind, unnest(generate_series(0, 29)) AS bin FROM (SELECT DISTINCT kind FROM mem)),
cnt AS (SELECT kind, CAST(least(floor((dist - lo) * 30.0 / (hi - lo)), 29) AS INTEGER) AS bin, count(*) AS n
        FROM mem, st GROUP BY ALL)
SELECT g.kind, CAST(g.bin AS INTEGER) AS bin, {R6('lo + (hi - lo) * g.bin / 30.0')} AS lo,
       {R6('lo + (hi - lo) * (g.bin + 1) / 30.0')} AS hi, coalesce(c.n, 0) AS n
FROM grid g LEFT JOIN cnt c ON g.kind = c.kind AND g.bin = c.bin, st""".replace("WITH ", "WITH ", 1))

oracle("cosine_min", with_(EMB, "a AS (SELECT * FROM emb WHERE label < 5)", "b AS (SELECT * FROM emb WHERE label >= 5)")
       + f"SELECT vec_id, {R6('dist')} AS dist FROM ({nn_sql('a', 'b', False, 'list_cosine_distance', 'vec_id')})")

MEMB = with_(*BASE, enc_cte("enc", "own"), ENCV,
             "tr AS (SELECT * FROM encv WHERE role = 'train')",
             "te AS (SELECT * FROM encv WHERE role = 'test')",
             "sy AS (SELECT * FROM encv WHERE role = 'synth')",
             f"""u AS (SELECT row_id, 1 AS label, dist FROM ({nn_sql('tr', 'sy', False, 'list_cosine_distance')})
   UNION ALL SELECT row_id, 0, dist FROM ({nn_sql('te', 'sy', False, 'list_cosine_distance')}))""",
             "st AS (SELECT min(dist) AS lo, max(dist) AS hi FROM u)",
             "sc AS (SELECT row_id, label, dist, 1.0 - (dist - lo) / (hi - lo) AS prob FROM u, st)")
oracle("membership_score", MEMB + f"SELECT row_id, label, {R6('dist')} AS dist, {R6('prob')} AS prob FROM sc")
oracle("membership_attack", MEMB + f""", s2 AS (SELECT prob AS score, sum(label) AS pos, sum(1 - label) AS neg FROM sc GROUP BY prob),
c2 AS (SELECT pos, neg, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tps FROM s2)
SELECT {R6('sum(neg * (2 * tps - pos)) / (2.0 * sum(pos) * sum(neg))')} AS auc FROM c2""")

oracle("membership_roc", MEMB + f""", s2 AS (SELECT round(prob, 6) AS score, sum(label) AS pos, sum(1 - label) AS neg FROM sc GROUP BY 1),
cum AS (SELECT score, pos, neg,
    sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tps,
    sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fps,
    row_number() OVER (ORDER BY score DESC) AS idx FROM s2),
tot AS (SELECT sum(pos) AS P, sum(neg) AS N, max(score) AS smax FROM s2),
nb AS (SELECT *, lag(tps) OVER (ORDER BY idx) AS tp0, lag(fps) OVER (ORDER BY idx) AS fp0,
    lead(tps) OVER (ORDER BY idx) AS tp2, lead(fps) OVER (ORDER BY idx) AS fp2 FROM cum)
SELECT CAST(0.0 AS DOUBLE) AS fpr, CAST(0.0 AS DOUBLE) AS tpr, {R6('smax + 1.0')} AS threshold FROM tot
UNION ALL
SELECT {R6('fps / N')}, {R6('tps / P')}, {R6('score')} FROM nb, tot
WHERE tp0 IS NULL OR tp2 IS NULL OR fp2 - 2 * fps + fp0 <> 0 OR tp2 - 2 * tps + tp0 <> 0""")

oracle("summary_membership", MEMB + f""", s2 AS (SELECT prob AS score, sum(label) AS pos, sum(1 - label) AS neg FROM sc GROUP BY prob),
c2 AS (SELECT pos, neg, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tps FROM s2)
SELECT 'membership_inference' AS analysis, 'auc' AS metric,
       round_even(sum(neg * (2 * tps - pos)) / (2.0 * sum(pos) * sum(neg)), 2) AS value FROM c2""")

# ------------------------------------------------------------------ S5, S8
oracle("default_header", "SELECT c_custkey AS C0, c_name AS C1, c_nationkey AS C2, c_acctbal AS C3, "
                         "c_mktsegment AS C4 FROM customer")


def _u(tag: str) -> str:
    return U(str(SEED), q(tag), "o_orderkey")


oracle("example_dataset", f"""
SELECT o_orderkey AS row_id, 'helloworld' AS constant,
       CASE WHEN {_u('binary01')} < 0.5 THEN '0' ELSE '1' END AS binary01,
       CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) THEN 'B' ELSE 'A' END AS binaryAB,
       (['X', 'Y', 'Z'])[CAST(floor({_u('categorical')} * 3) AS INTEGER) + 1] AS categorical,
       CAST(floor({_u('count')} * 15) + 5 AS BIGINT) AS "count",
       {_u('continuous')} AS continuous
FROM orders""")

# -------------------------------------------------------------- R4-R11
_FITTED = [lbl for lbl in ENC_LABELS if lbl != "tier__tier"] + ["intercept"]


def _zeros(arms) -> str:
    """At a minimum all residuals are 0."""
    return (f"SELECT arm, feature, CAST(0.0 AS DOUBLE) AS residual FROM (SELECT unnest([{', '.join(q(a) for a in arms)}]) AS arm) a, "
            f"(SELECT unnest([{', '.join(q(x) for x in _FITTED)}]) AS feature) f")


oracle("effect_residual", _zeros(("train", "test", "synth")))
oracle("arm_residual", _zeros(("gan_real", "gan_train", "gan_test")))
oracle("arm_rows", with_(*BASE, enc_cte("enc", "own"), """n AS (SELECT
    count(CASE WHEN role = 'train' THEN 1 END) AS n_tr, count(CASE WHEN role = 'test' THEN 1 END) AS n_te,
    count(CASE WHEN role = 'synth' THEN 1 END) AS n_s FROM cohort)""",
    f"""r AS (SELECT row_id, row_number() OVER (ORDER BY {H(str(SEED), q('synth_split'), 'row_id')}, row_id) AS rn
           FROM cohort WHERE role = 'synth')""") + """
SELECT e.row_id, CAST(round_even("tier__tier", 0) AS INTEGER) AS y,
       CASE role WHEN 'train' THEN 0 WHEN 'test' THEN 2 ELSE (CASE WHEN rn <= k THEN 1 END) END AS arm,
       role = 'test' AS on_real, coalesce(rn > k, FALSE) AS on_synth
FROM enc e LEFT JOIN r USING (row_id), (SELECT round_even(n_s * (CAST(n_tr AS DOUBLE) / (n_tr + n_te)), 0) AS k FROM n)""")

# ---------------------------------------------------------------- R8, S1
oracle("constant_outcome_guard", with_(COHORT) + """
SELECT role AS arm, count(DISTINCT tier) <= 1 AS constant FROM cohort GROUP BY role
UNION ALL SELECT 'train_0', TRUE UNION ALL SELECT 'train_1', TRUE""")

_BITS = [x for x in ENC_LABELS if x not in ("count__count", "continuous__continuous")]
oracle("generator_fidelity", with_(*BASE, enc_cte("enc", "own")) + " UNION ALL ".join(
    f"SELECT {q(x)} AS feature, TRUE AS ok FROM enc WHERE role = 'train' HAVING avg({dq(x)}) > 0" for x in _BITS))

oracle("file_roundtrip", with_(COHORT) + 'SELECT row_id, constant, tier, categorical, priority, "count", continuous FROM cohort')

oracle("summary_nearest", MEM + """
SELECT 'nearest_neighbors' AS analysis, kind AS metric, round_even(avg(dist), 2) AS value FROM mem GROUP BY kind""")

oracle("feather_roundtrip", with_(COHORT) + 'SELECT row_id, constant, tier, categorical, priority, "count", continuous FROM cohort')

oracle("npy_roundtrip", with_(COHORT) + 'SELECT row_id, constant, tier, categorical, priority, "count", continuous FROM cohort')

oracle("file_row_ids", with_(COHORT) + """
SELECT row_number() OVER (ORDER BY row_id) - 1 AS line, tier, categorical, priority, continuous FROM cohort""")

oracle("tree_joint_shares", " UNION ALL ".join(
    f"SELECT {q(a)} AS a, {q(b)} AS b, TRUE AS ok, TRUE AS whole" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1:]))
