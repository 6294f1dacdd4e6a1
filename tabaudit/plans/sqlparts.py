"""SQL text pieces for the DuckDB oracle: the cohort fixture and its
encoding, written independently of the DataFrame code (types, categories,
minority class and ranges are all recomputed in SQL from the train rows).
"""

from __future__ import annotations

from tabaudit.sources.fixtures import (BINARY_CUT, CAT_MISS_RATE,
                                       CONT_MISS_RATE, SEED, SENTINEL,
                                       TIER_NOISE)


def U(*parts: str) -> str:
    """SQL keyed uniform, identical to functions.rand.hash_uniform."""
    joined = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return ("(CAST(('0x' || substr(md5(concat_ws('|', " + joined
            + ")), 1, 8)) AS BIGINT) / CAST(4294967296.0 AS DOUBLE))")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def dq(s: str) -> str:
    return '"' + s.replace('"', '""') + '"'


S = q(SENTINEL)
SF = f"CAST({SENTINEL}.0 AS DOUBLE)"

COHORT = f"""cohort AS (
  SELECT o_orderkey AS row_id,
         'helloworld' AS constant,
         CASE WHEN (o_totalprice > CAST({BINARY_CUT} AS DOUBLE))
                   <> ({U(str(SEED), q('tier_noise'), 'o_orderkey')} < CAST({TIER_NOISE} AS DOUBLE))
              THEN 'H' ELSE 'L' END AS tier,
         CASE WHEN {U(str(SEED), q('miss_categorical'), 'o_orderkey')} < CAST({CAT_MISS_RATE} AS DOUBLE)
              THEN {S} ELSE o_orderstatus END AS categorical,
         o_orderpriority AS priority,
         CAST(day(o_orderdate) AS DOUBLE) AS "count",
         CASE WHEN {U(str(SEED), q('miss_continuous'), 'o_orderkey')} < CAST({CONT_MISS_RATE} AS DOUBLE)
              THEN {SF} ELSE o_totalprice END AS continuous,
         CASE WHEN {U(str(SEED), q('split'), 'o_orderkey')} < CAST(0.5 AS DOUBLE) THEN 'train'
              WHEN {U(str(SEED), q('split'), 'o_orderkey')} < CAST(0.75 AS DOUBLE) THEN 'test'
              ELSE 'synth' END AS role
  FROM orders)"""

# Spec values recomputed from the train rows.
SPEC = f"""train AS (SELECT * FROM cohort WHERE role = 'train'),
tier_one AS (SELECT tier AS one FROM train WHERE tier <> {S} AND tier <> ''
            GROUP BY tier ORDER BY count(*), tier LIMIT 1),
tier_zero AS (SELECT tier AS zero FROM train WHERE tier <> {S} AND tier <> ''
            GROUP BY tier ORDER BY count(*) DESC, tier DESC LIMIT 1),
cat_u AS (SELECT list_sort(list_distinct(list(categorical))) AS u FROM train),
pri_u AS (SELECT list_sort(list_distinct(list(priority))) AS u FROM train),
spec_rng AS (SELECT min(CASE WHEN continuous <> {SF} THEN continuous END) AS c_lo,
                    max(CASE WHEN continuous <> {SF} THEN continuous END) AS c_hi,
                    min(CASE WHEN "count" <> {SF} THEN "count" END) AS n_lo,
                    max(CASE WHEN "count" <> {SF} THEN "count" END) AS n_hi FROM train),
own_rng AS (SELECT role,
                    min(CASE WHEN continuous <> {SF} THEN continuous END) AS c_lo,
                    max(CASE WHEN continuous <> {SF} THEN continuous END) AS c_hi,
                    min(CASE WHEN "count" <> {SF} THEN "count" END) AS n_lo,
                    max(CASE WHEN "count" <> {SF} THEN "count" END) AS n_hi
             FROM cohort GROUP BY role)"""

N_CAT = 4        # '-999999', F, O, P  (sentinel already a category: no extra column)
N_PRI = 5        # five order priorities, plus one missing column

FILL_SEED = "0"


def _fill(label: str) -> str:
    return U(FILL_SEED, q("fill"), q(label), "c.row_id")


def enc_columns(rng: str = "r") -> list[tuple[str, str]]:
    """(label, SQL expression) of the encoded cohort, require_missing=True.
    ``rng`` is the alias of the range row used for scaling."""
    cols = [
        ("constant__constant", "CAST(0.0 AS DOUBLE)"),
        (f"constant__{SENTINEL}", f"CASE WHEN c.constant = {S} THEN 1.0 ELSE 0.0 END"),
        ("tier__tier", f"CASE WHEN c.tier = {S} THEN (CASE WHEN {_fill('tier')} < 0.5 THEN 1.0 ELSE 0.0 END) "
                           f"WHEN c.tier = (SELECT one FROM tier_one) THEN 1.0 ELSE 0.0 END"),
        (f"tier__{SENTINEL}", f"CASE WHEN c.tier = {S} THEN 1.0 ELSE 0.0 END"),
    ]
    for i in range(N_CAT):
        cols.append((f"categorical__{i}",
                     f"CASE WHEN c.categorical = (SELECT u FROM cat_u)[{i + 1}] THEN 1.0 ELSE 0.0 END"))
    for i in range(N_PRI):
        cols.append((f"priority__{i}",
                     f"CASE WHEN c.priority = (SELECT u FROM pri_u)[{i + 1}] THEN 1.0 ELSE 0.0 END"))
    cols.append((f"priority__{N_PRI}", f"CASE WHEN c.priority = {S} THEN 1.0 ELSE 0.0 END"))
    for lbl, lo, hi in (("count", "n_lo", "n_hi"), ("continuous", "c_lo", "c_hi")):
        col = f'c."{lbl}"' if lbl == "count" else f"c.{lbl}"
        miss = f"({col} = {SF} OR {col} IS NULL OR isnan({col}))"
        cols.append((f"{lbl}__{lbl}",
                     f"CASE WHEN {miss} THEN {_fill(lbl)} "
                     f"ELSE ({col} - {rng}.{lo}) / NULLIF({rng}.{hi} - {rng}.{lo}, 0) END"))
        cols.append((f"{lbl}__{SENTINEL}", f"CASE WHEN {col} = {SF} THEN 1.0 ELSE 0.0 END"))
    return [(lbl, f"CAST({e} AS DOUBLE)") for lbl, e in cols]


ENC_LABELS = [lbl for lbl, _ in enc_columns()]


def enc_cte(name: str = "enc", scale: str = "own") -> str:
    """CTE ``name``(row_id, role, <features>) encoding every cohort row.
    scale='own': each role scaled by its own range; 'spec': train range."""
    cols = ",\n       ".join(f"{e} AS {dq(lbl)}" for lbl, e in enc_columns("r"))
    if scale == "own":
        src = "cohort c JOIN own_rng r ON c.role = r.role"
    else:
        src = "cohort c CROSS JOIN spec_rng r"
    return f"""{name} AS (SELECT c.row_id, c.role,
       {cols}
  FROM {src})"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE = [COHORT, SPEC]


NUM_RE = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"

# (label, SQL expression on alias t, numeric input?) of the cohort features.
COHORT_COLS = [
    ("constant", "t.constant", False),
    ("tier", "t.tier", False),
    ("categorical", "t.categorical", False),
    ("priority", "t.priority", False),
    ("count", 't."count"', True),
    ("continuous", "t.continuous", True),
]


def missing_sql(expr: str, numeric: bool) -> str:
    if numeric:
        return f"({expr} IS NULL OR isnan({expr}) OR {expr} = {SF})"
    return f"({expr} IS NULL OR {expr} = {S} OR {expr} = '')"


def text_sql(expr: str, numeric: bool) -> str:
    return f"CAST({expr} AS VARCHAR)" if numeric else expr


def profile_sql(source: str, cols=COHORT_COLS, max_uniq: int = 10) -> str:
    """SELECT producing (label, pos, type, min, max, zero, one, unique_values,
    missing) for each column of ``source`` (a relation aliased t)."""
    parts = []
    for pos, (label, expr, numeric) in enumerate(cols):
        miss = missing_sql(expr, numeric)
        txt = text_sql(expr, numeric)
        num = "TRUE" if numeric else f"regexp_matches(trim({expr}), '{NUM_RE}')"
        val = (f"CAST({expr} AS DOUBLE)" if numeric
               else f"TRY_CAST(CASE WHEN regexp_matches(trim({expr}), '{NUM_RE}') THEN trim({expr}) END AS DOUBLE)")
        sent = f"{expr} = {SF}" if numeric else f"{expr} = {S}"
        parts.append(f"""SELECT {q(label)} AS label, {pos} AS pos, typ AS type,
       CASE WHEN typ IN ('continuous','count') THEN vmin END AS min,
       CASE WHEN typ IN ('continuous','count') THEN vmax END AS max,
       CASE WHEN typ = 'constant' THEN tmin WHEN typ = 'binary' THEN
            (CASE WHEN n_first <= n_uniq_rows - n_first THEN tmax ELSE tmin END) END AS zero,
       CASE WHEN typ = 'binary' THEN
            (CASE WHEN n_first <= n_uniq_rows - n_first THEN tmin ELSE tmax END) END AS one,
       CASE WHEN typ = 'categorical' THEN uniq END AS unique_values,
       n_sent > 0 AS missing
FROM (SELECT *, CASE WHEN n_uniq = 1 THEN 'constant' WHEN n_uniq = 2 THEN 'binary'
                     WHEN n_uniq > {max_uniq} AND coalesce(all_num, TRUE) THEN
                          (CASE WHEN coalesce(dev, 0) > 1e-10 THEN 'continuous' ELSE 'count' END)
                     ELSE 'categorical' END AS typ
      FROM (SELECT count(DISTINCT CASE WHEN NOT {miss} THEN {txt} END) AS n_uniq,
                   bool_and(CASE WHEN NOT {miss} THEN {num} END) AS all_num,
                   min(CASE WHEN NOT {miss} THEN {val} END) AS vmin,
                   max(CASE WHEN NOT {miss} THEN {val} END) AS vmax,
                   max(CASE WHEN NOT {miss} THEN abs({val} - round({val})) END) AS dev,
                   min(CASE WHEN NOT {miss} THEN {txt} END) AS tmin,
                   max(CASE WHEN NOT {miss} THEN {txt} END) AS tmax,
                   count(CASE WHEN NOT {miss} AND {txt} = (SELECT min({txt}) FROM {source} t
                          WHERE NOT {miss}) THEN 1 END) AS n_first,
                   count(CASE WHEN NOT {miss} THEN 1 END) AS n_uniq_rows,
                   array_to_string(list_sort(list_distinct(list(coalesce({txt}, {S})))), ',') AS uniq,
                   count(CASE WHEN {sent} THEN 1 END) AS n_sent
            FROM {source} t) a) b""")
    return "\nUNION ALL\n".join(parts)


def H(*parts: str) -> str:
    """SQL keyed 32-bit hash, identical to functions.rand.hash_int."""
    joined = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return "CAST(('0x' || substr(md5(concat_ws('|', " + joined + ")), 1, 8)) AS BIGINT)"


def vec(labels: list[str], alias: str = "") -> str:
    pre = f"{alias}." if alias else ""
    return "list_value(" + ", ".join(f"{pre}{dq(lbl)}" for lbl in labels) + ")"


def nn_sql(a: str, b: str, self_join: bool, fn: str = "list_distance", id_col: str = "row_id") -> str:
    """Brute-force nearest-neighbour distance (a.v against b.v)."""
    excl = f" WHERE a.{id_col} <> b.{id_col}" if self_join else ""
    return (f"SELECT a.{id_col} AS {id_col}, min({fn}(a.v, b.v)) AS dist "
            f"FROM {a} a CROSS JOIN {b} b{excl} GROUP BY a.{id_col}")
