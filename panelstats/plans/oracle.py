"""DuckDB SQL equivalent to each SQL-expressible key of :mod:`panelstats.plans.catalog`.

The driver registers the parquet tables as views under their own names; every string
here runs on those views alone.  Float outputs are rounded to the same decimals as the
Spark side; every literal that meets a double is cast to DOUBLE (a DECIMAL literal would
change DuckDB's arithmetic).
"""

from __future__ import annotations

import re

from panelstats import constants as K
from panelstats.plans import fixtures as fx

D = fx.DIGITS
SC = fx.SCORES
MEANS = [f"{s}_mean" for s in SC]
RANGES = [f"{s}_max_min_diff" for s in SC]


def R(expr: str, digits: int = D) -> str:
    """``floor(e * 10^d + 0.5) / 10^d``: the rounding the Spark side uses
    (``fixtures.half_up``), so both engines round the same double to the same double."""
    scale = f"CAST(1e{digits} AS DOUBLE)"
    return f"(FLOOR(({expr}) * {scale} + CAST(0.5 AS DOUBLE)) / {scale})"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


ASSESS = ("assess AS (SELECT l_orderkey AS point_id, l_returnflag AS point, l_linenumber AS rater, "
          "l_linestatus AS status, l_shipdate AS visit_ts, l_quantity, l_extendedprice, l_discount, "
          "l_tax FROM lineitem)")
CLASSES = ("classes AS (SELECT o_orderkey AS point_id, o_orderpriority AS class, o_orderstatus AS status, "
           "c_acctbal AS lat, o_totalprice AS lon FROM orders JOIN customer ON o_custkey = c_custkey)")
NULLS = ("nl AS (SELECT l_orderkey, l_linenumber, l_quantity, "
         "CASE WHEN l_discount <> 0 THEN l_discount END AS l_discount, "
         "CASE WHEN l_tax <> 0 THEN l_tax END AS l_tax FROM lineitem)")
NL_COLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"]

_AGG = {"mean": "AVG({c})", "media": "AVG({c})", "min": "MIN({c})", "max": "MAX({c})",
        "max_min_diff": "MAX({c}) - MIN({c})", "sd": "STDDEV_SAMP({c})"}


def profile_cte(name: str, stats, keys=("point_id",), src="assess", cols=SC, exact: bool = False) -> str:
    exprs = ", ".join(f"{_AGG[s].format(c=c) if exact else R(_AGG[s].format(c=c))} AS {c}_{s}" for c in cols for s in stats)
    k = ", ".join(keys)
    nn = " AND ".join(f"{x} IS NOT NULL" for x in keys)
    return f"{name} AS (SELECT {k}, {exprs} FROM {src} WHERE {nn} GROUP BY {k})"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


TYPED = ("SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_shipdate, "
         + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in SC) + " FROM lineitem")

LINEITEM_TYPES = [("l_orderkey", "int64"), ("l_partkey", "int64"), ("l_suppkey", "int64"),
                  ("l_linenumber", "int32"), ("l_quantity", "float64"), ("l_extendedprice", "float64"),
                  ("l_discount", "float64"), ("l_tax", "float64"), ("l_returnflag", "object"),
                  ("l_linestatus", "object"), ("l_shipdate", "datetime64[ns]")]

PROFILE_COLUMNS = "\nUNION ALL\n".join(
    f"SELECT {i} AS position, {_q(c)} AS \"column\", {_q(t)} AS dtype, COUNT({c}) AS non_null, "
    f"COUNT(*) AS \"rows\" FROM lineitem" for i, (c, t) in enumerate(LINEITEM_TYPES))

_ODD = ["12:30", "2024-3", "7d", "5f", "0x1p3", "Infinity", "2024-02-30", "2024-13-01", " 5.3 ", "1e1", "-.5", "5.", ""]
DAMAGED = ("CASE WHEN l_linenumber = 3 AND l_orderkey % 11 = 0 THEN list_extract([" + ", ".join(_q(x) for x in _ODD)
           + f"], CAST(l_orderkey % {len(_ODD)} AS INT) + 1) WHEN l_returnflag = 'R' THEN CAST(l_shipdate AS VARCHAR) "
             "ELSE CAST(l_quantity AS VARCHAR) END")
_NUM = (r"CASE WHEN regexp_matches(raw, '^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$') "
        "THEN TRY_CAST(trim(raw) AS DOUBLE) END")
_DAY = (r"CASE WHEN regexp_matches(raw, '^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?\s*$') "
        "THEN TRY_CAST(substr(trim(raw), 1, 10) AS DATE) END")
_SCORE = f"COALESCE({_NUM}, TRY_CAST(CAST(day({_DAY}) AS VARCHAR) || '.' || CAST(month({_DAY}) AS VARCHAR) AS DOUBLE))"
REPAIR = with_(f"r AS (SELECT l_orderkey, l_linenumber, {DAMAGED} AS raw FROM lineitem)") + (
    f"SELECT l_orderkey, l_linenumber, raw, {_SCORE} AS score, "
    f"(({_NUM}) IS NULL AND ({_DAY}) IS NOT NULL) AS was_repaired FROM r")
SCAN_CSV = with_(f"r AS (SELECT *, {DAMAGED} AS raw FROM lineitem)") + (
    f"SELECT l_orderkey, l_linenumber, {_SCORE} AS l_quantity, l_extendedprice, l_discount, l_tax FROM r")

NAMED = ("na AS (SELECT l_orderkey AS point_id, 'P' || CAST(l_orderkey // 2 AS VARCHAR) AS point, "
         f"{fx.ROW_ORDER} AS seq, l_shipdate AS visit_ts, l_returnflag AS species, "
         "CAST(l_linenumber % 3 AS VARCHAR) AS height, l_quantity, l_extendedprice, "
         "CASE WHEN l_discount <> 0 THEN l_discount END AS l_discount, l_tax FROM lineitem)")
NAMED_CLASSES = ("nc AS (SELECT o_orderkey AS point_id, 'P' || CAST(o_orderkey // 2 AS VARCHAR) AS point, "
                 "o_orderpriority AS class FROM orders)")


def _first_visit(src: str) -> str:
    return (f"fv AS (SELECT point, CAST(visit_ts AS DATE) AS visit_date FROM (SELECT point, visit_ts, ROW_NUMBER() OVER "
            f"(PARTITION BY point ORDER BY seq) AS rn FROM {src}) WHERE rn = 1)")


def _unpivot(src: str, cols) -> str:
    return " UNION ALL ".join(f"SELECT point, visit_date, {_q(c)} AS score, {R(c)} AS sd FROM {src}" for c in cols)


DISAGREEMENT = with_(
    NAMED, "a AS (SELECT * FROM na WHERE l_discount IS NOT NULL)",
    profile_cte("sd", ["sd"], keys=("point_id", "point"), src="a", exact=True),
    "sp AS (SELECT DISTINCT point_id, point, species FROM a)", _first_visit("a"),
    "j AS (SELECT sd.*, visit_date FROM sd LEFT JOIN sp USING (point_id, point) JOIN fv USING (point))") + _unpivot(
    "j", [f"{c}_sd" for c in SC])

_STATS = [f"{c}_{s}" for c in SC for s in ("media", "sd")]
TRAINING = with_(
    NAMED, NAMED_CLASSES,
    "hc AS (SELECT point_id, point, height, COUNT(*) AS n, MIN(seq) AS f FROM na GROUP BY 1, 2, 3)",
    "hm AS (SELECT point_id, point, height FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY point_id, point "
    "ORDER BY n DESC, f) AS rn FROM hc) WHERE rn = 1)",
    profile_cte("st", ["media", "sd"], keys=("point_id", "point"), src="na", exact=True),
    "sp AS (SELECT DISTINCT point_id, point, species FROM na)", _first_visit("na"),
    "ic AS (SELECT DISTINCT point, class, point_id AS class_id FROM nc)",
    "x AS (SELECT st.*, hm.height, species, visit_date, class, class_id, CAST(st.point_id AS VARCHAR) || ':' || species "
    "|| ':' || CAST(class_id AS VARCHAR) AS row_key FROM st JOIN hm USING (point_id, point) LEFT JOIN sp USING (point_id, point) "
    "JOIN fv USING (point) JOIN ic USING (point) WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in _STATS) + ")",
    "sz AS (SELECT class, COUNT(*) AS c, ROW_NUMBER() OVER (ORDER BY class) - 1 AS factor FROM x GROUP BY class)",
    "o AS (SELECT class, factor, COALESCE(SUM(c) OVER (ORDER BY class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
    "AS off FROM sz)") + (
    "SELECT point, " + ", ".join(f"{R(c)} AS {c}" for c in _STATS) + ", CAST(height AS DOUBLE) AS height, species, visit_date, "
    "class, class_id AS point_id, row_key, CAST(factor AS INTEGER) AS factor, CAST((off + ROW_NUMBER() OVER (PARTITION BY class "
    "ORDER BY md5(row_key || ':667'), row_key) - 1) % 5 AS INTEGER) AS fold FROM x JOIN o USING (class)")

SIGNED_ZERO = with_(
    f"e AS (SELECT {fx.ROW_ORDER} AS seq, CASE WHEN l_linenumber <= 2 THEN 0.0::DOUBLE "
    "WHEN l_linenumber <> 3 THEN l_discount + 0.0::DOUBLE END AS k, l_returnflag FROM lineitem)",
    "c AS (SELECT k, l_returnflag, COUNT(*) AS n, MIN(seq) AS f FROM e GROUP BY 1, 2)",
    "m AS (SELECT k, l_returnflag FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY k ORDER BY n DESC, f) AS rn FROM c) WHERE rn = 1)"
) + "SELECT seq, e.k, m.l_returnflag FROM e JOIN m ON e.k IS NOT DISTINCT FROM m.k"

_any_null = " OR ".join(f"{c} IS NULL" for c in NL_COLS)
NULL_COUNTS = with_(NULLS, "t AS (SELECT COUNT(*) * 5 AS cells, "
                    + " + ".join(f"(COUNT(*) - COUNT({c}))" for c in NL_COLS) + " AS miss FROM nl)") + (
    "SELECT false AS is_na, CAST(cells - miss AS BIGINT) AS n FROM t WHERE cells - miss > 0 "
    "UNION ALL SELECT true AS is_na, CAST(miss AS BIGINT) AS n FROM t WHERE miss > 0")

MODE_CTE = ("mc AS (SELECT user_id, event_type, COUNT(*) AS n, MIN(event_id) AS f FROM events GROUP BY 1, 2), "
            "mr AS (SELECT user_id, event_type, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY n DESC, f ASC) "
            "AS rn FROM mc), m AS (SELECT user_id, event_type FROM mr WHERE rn = 1)")

_ord_case = ("CASE o_orderpriority " + " ".join(f"WHEN {_q(v)} THEN {i}" for i, v in enumerate(fx.PRIORITY_ORDER))
             + " END")
_label = f"CASE WHEN class IN {_in(fx.PRIORITY_NEGATIVE)} THEN 0 ELSE 1 END"

TWO_KEY = [ASSESS, profile_cte("p2", ["media", "sd"], keys=("point_id", "point")),
           "attrs AS (SELECT DISTINCT point_id, point, status FROM assess)"]

EVENT_CTES = [
    profile_cte("prof", ["media", "sd"], keys=("user_id", "event_type"), src="events", cols=["value"]),
    "v AS (SELECT user_id, CAST(ts AS DATE) AS visit_date FROM (SELECT user_id, ts, ROW_NUMBER() OVER "
    "(PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn = 1)"]

FEATURE_RANGES = with_(ASSESS, profile_cte("p", ["mean"])) + "\nUNION ALL\n".join(
    f"SELECT {_q(m)} AS feature, {R(f'MIN({m})')} AS \"min\", {R(f'MAX({m})')} AS \"max\", "
    f"{R(f'AVG({m})')} AS mean FROM p" for m in MEANS)

SCORE_CORR = "\nUNION ALL\n".join(
    f"SELECT {_q(a)} AS feature_a, {_q(b)} AS feature_b, {R(f'CORR({a}, {b})')} AS corr FROM lineitem"
    for a in SC for b in SC)

SCORED = [ASSESS, CLASSES, profile_cte("p", ["mean", "min", "max", "max_min_diff"], exact=True),
          f"x AS (SELECT p.*, c.class, {_label} AS label FROM p JOIN classes c USING (point_id))"]

MELTED = SCORED + ["g AS (SELECT * FROM x WHERE l_quantity_max_min_diff <= CAST(40.0 AS DOUBLE))",
                   "melted AS (" + " UNION ALL ".join(
                       f"SELECT point_id, class, {_q(r)} AS variable, {r} AS value FROM g" for r in RANGES) + ")"]


def box_sql(ctes, src: str, by, value: str) -> str:
    b = ", ".join(by)
    nn = " AND ".join(f"{g} IS NOT NULL" for g in by)
    inside = "(v >= lower_fence AND v <= upper_fence)"
    rnd = lambda e, a: f"{R(e, fx.BOX_DIGITS)} AS \"{a}\""
    return with_(*ctes,
                 f"src AS (SELECT {b}, CAST({value} AS DOUBLE) AS v FROM {src} WHERE {nn} AND {value} IS NOT NULL)",
                 f"st AS (SELECT {b}, COUNT(v) AS n, MIN(v) AS mn, MAX(v) AS mx, QUANTILE_CONT(v, 0.25) AS q1, "
                 f"QUANTILE_CONT(v, 0.5) AS med, QUANTILE_CONT(v, 0.75) AS q3 FROM src GROUP BY {b})",
                 "f AS (SELECT *, q3 - q1 AS iqr, q1 - CAST(1.5 AS DOUBLE) * (q3 - q1) AS lower_fence, "
                 "q3 + CAST(1.5 AS DOUBLE) * (q3 - q1) AS upper_fence FROM st)",
                 f"w AS (SELECT {b}, MIN(CASE WHEN {inside} THEN v END) AS wl, MAX(CASE WHEN {inside} THEN v END) "
                 f"AS wh, COUNT(CASE WHEN NOT {inside} THEN 1 END) AS no FROM src JOIN f USING ({b}) "
                 f"WHERE v IS NOT NULL GROUP BY {b})") + (
        f"SELECT {b}, CAST(n AS BIGINT) AS n, {rnd('mn', 'min')}, {rnd('q1', 'q1')}, {rnd('med', 'median')}, "
        f"{rnd('q3', 'q3')}, {rnd('mx', 'max')}, {rnd('iqr', 'iqr')}, {rnd('lower_fence', 'lower_fence')}, "
        f"{rnd('upper_fence', 'upper_fence')}, {rnd('wl', 'whisker_low')}, {rnd('wh', 'whisker_high')}, "
        f"CAST(COALESCE(no, 0) AS BIGINT) AS n_outliers FROM f LEFT JOIN w USING ({b})")


BOX_OUTLIERS = with_(*SCORED,
                     "src AS (SELECT point_id, class, CAST(l_extendedprice_mean AS DOUBLE) AS v FROM x "
                     "WHERE class IS NOT NULL)",
                     "st AS (SELECT class, QUANTILE_CONT(v, 0.25) AS q1, QUANTILE_CONT(v, 0.75) AS q3 "
                     "FROM src GROUP BY class)",
                     "f AS (SELECT class, q1 - CAST(1.5 AS DOUBLE) * (q3 - q1) AS lower_fence, "
                     "q3 + CAST(1.5 AS DOUBLE) * (q3 - q1) AS upper_fence FROM st)") + (
    f"SELECT point_id, class, {R('v', fx.BOX_DIGITS)} AS l_extendedprice_mean, "
    f"{R('lower_fence', fx.BOX_DIGITS)} AS lower_fence, {R('upper_fence', fx.BOX_DIGITS)} AS upper_fence, CASE WHEN v < lower_fence THEN 'low' ELSE 'high' END AS side "
    "FROM src JOIN f USING (class) WHERE v IS NOT NULL AND (v < lower_fence OR v > upper_fence)")

RANKED_ORDERS = ("h AS (SELECT o_orderkey, o_orderpriority, md5(CAST(o_orderkey AS VARCHAR) || ':667') AS h "
                 "FROM orders), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY h, "
                 "o_orderkey) AS rk FROM h), sz AS (SELECT o_orderpriority, COUNT(*) AS c FROM orders GROUP BY 1)")

SPLIT = with_(RANKED_ORDERS,
              "t AS (SELECT *, SUM(c) OVER () AS n FROM sz)",
              "t2 AS (SELECT *, n - CEIL(CAST(0.3 AS DOUBLE) * n) AS ntr FROM t)",
              "t3 AS (SELECT *, CAST(c AS DOUBLE) * CAST(ntr AS DOUBLE) / CAST(n AS DOUBLE) AS cont FROM t2)",
              "t4 AS (SELECT *, FLOOR(cont) AS fl, cont - FLOOR(cont) AS rem FROM t3)",
              "t5 AS (SELECT *, ntr - SUM(fl) OVER () AS need, ROW_NUMBER() OVER (ORDER BY rem DESC, "
              "o_orderpriority ASC) AS rr FROM t4)",
              "q AS (SELECT o_orderpriority, c - (fl + CASE WHEN rr <= need THEN 1 ELSE 0 END) AS test_n FROM t5)") + (
    "SELECT o_orderkey, o_orderpriority, CASE WHEN rk <= test_n THEN 'test' ELSE 'train' END AS split "
    "FROM r JOIN q USING (o_orderpriority)")

FOLDS_CTE = with_(RANKED_ORDERS,
                  "o AS (SELECT o_orderpriority, COALESCE(SUM(c) OVER (ORDER BY o_orderpriority ROWS BETWEEN "
                  "UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM sz)",
                  "fo AS (SELECT o_orderkey, o_orderpriority, CAST((off + rk - 1) % 5 AS INTEGER) AS fold "
                  "FROM r JOIN o USING (o_orderpriority))")

CONF = ("c AS (SELECT CAST(quality AS VARCHAR) AS label, CAST(toxic AS VARCHAR) AS prediction, COUNT(*) AS n "
        "FROM labels GROUP BY 1, 2)")


def _div(a, b):
    return f"CASE WHEN {b} = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"


REPORT = with_(
    CONF,
    "sup AS (SELECT label AS class, SUM(n) AS support FROM c GROUP BY 1)",
    "prd AS (SELECT prediction AS class, SUM(n) AS predicted FROM c GROUP BY 1)",
    "tp AS (SELECT label AS class, n AS tp FROM c WHERE label = prediction)",
    "per AS (SELECT COALESCE(sup.class, prd.class) AS class, COALESCE(support, 0) AS support, "
    "COALESCE(predicted, 0) AS predicted FROM sup FULL JOIN prd ON sup.class = prd.class)",
    "per2 AS (SELECT per.*, COALESCE(tp.tp, 0) AS tp FROM per LEFT JOIN tp ON tp.class = per.class)",
    f"m AS (SELECT class, {_div('tp', 'predicted')} AS precision, {_div('tp', 'support')} AS recall, "
    f"{_div('2 * tp', 'support + predicted')} AS f1_score, support, tp FROM per2)") + (
    f"SELECT class, {R('precision')} AS precision, {R('recall')} AS recall, {R('f1_score')} "
    "AS f1_score, CAST(support AS BIGINT) AS support FROM m\n"
    f"UNION ALL SELECT 'accuracy', NULL, NULL, {R(_div('SUM(tp)', 'SUM(support)'))}, "
    "CAST(SUM(support) AS BIGINT) FROM m\n"
    f"UNION ALL SELECT 'macro avg', {R('AVG(precision)')}, {R('AVG(recall)')}, {R('AVG(f1_score)')}, "
    "CAST(SUM(support) AS BIGINT) FROM m\n"
    f"UNION ALL SELECT 'weighted avg', {R('SUM(precision * support) / SUM(support)')}, "
    f"{R('SUM(recall * support) / SUM(support)')}, {R('SUM(f1_score * support) / SUM(support)')}, "
    "CAST(SUM(support) AS BIGINT) FROM m")

CONFUSION = with_(
    CONF,
    "w AS (SELECT prediction, CAST(COALESCE(SUM(CASE WHEN label = '0' THEN n END), 0) AS BIGINT) AS ref_0, "
    "CAST(COALESCE(SUM(CASE WHEN label = '1' THEN n END), 0) AS BIGINT) AS ref_1 FROM c GROUP BY prediction)") + (
    "SELECT prediction, ref_0, ref_1, " + R(_div(
        "SUM(CASE WHEN prediction = '0' THEN ref_0 WHEN prediction = '1' THEN ref_1 ELSE 0 END) OVER ()",
        "SUM(ref_0 + ref_1) OVER ()")) + " AS accuracy FROM w")

_sig = "(1.0::DOUBLE / (1.0::DOUBLE + EXP(-({x}))))"
CONTRIB = [ASSESS, CLASSES, profile_cte("p", ["mean"]),
           "st AS (SELECT " + ", ".join(f"AVG({m}) AS a{i}" for i, m in enumerate(MEANS)) + ", "
           + ", ".join(f"STDDEV_POP({m}) AS s{i}" for i, m in enumerate(MEANS)) + " FROM p)",
           f"bs AS (SELECT LN(share / (1.0::DOUBLE - share)) AS base FROM (SELECT AVG({_label}) AS share FROM classes))",
           "contrib AS (" + " UNION ALL ".join(
               f"SELECT p.point_id AS id, {_q(m)} AS feature, p.{m} AS value, "
               f"TANH((p.{m} - st.a{i}) / st.s{i}) AS contribution, bs.base AS base FROM p, st, bs"
               for i, m in enumerate(MEANS)) + ")"]

PATH_CTE = ("path AS (SELECT id, feature, contribution, base, CAST(ROW_NUMBER() OVER w AS INTEGER) AS step, "
            "base + SUM(contribution) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lo "
            "FROM contrib WINDOW w AS (PARTITION BY id ORDER BY ABS(contribution), feature))")

_FIELD = re.compile(r"\{(\w+)\}")


def _fill(template: str, **fields: str) -> str:
    parts, pos = [], 0
    for m in _FIELD.finditer(template):
        if m.start() > pos:
            parts.append(_q(template[pos:m.start()]))
        parts.append(fields[m.group(1)])
        pos = m.end()
    if pos < len(template):
        parts.append(_q(template[pos:]))
    return "(" + " || ".join(parts) + ")"


def _pct(x):
    return f"printf('%.2f%%', {_sig.format(x=x)} * 100.0::DOUBLE)"


TEXT = with_(*CONTRIB, PATH_CTE,
             "sent AS (SELECT id, step, lo, " + _fill(
                 K.TEXT_STEP, feature="feature",
                 direction=f"CASE WHEN contribution > 0 THEN {_q(K.TEXT_UP)} ELSE {_q(K.TEXT_DOWN)} END",
                 amount="printf('%.2f', ABS(contribution))", prob=_pct("lo")) + " AS s FROM path)",
             "agg AS (SELECT id, STRING_AGG(s, ' ' ORDER BY step) AS steps, ARG_MAX(lo, step) AS fin FROM sent "
             "GROUP BY id)",
             "b AS (SELECT id, MAX(base) AS base FROM contrib GROUP BY id)") + (
    "SELECT id, " + _fill(K.TEXT_BASE, base="printf('%.2f', base)", prob=_pct("base"))
    + " || ' ' || steps || ' ' || " + _fill(K.TEXT_FINAL, prob=_pct("fin")) + " AS text FROM agg JOIN b USING (id)")


def _p(stats):
    return with_(ASSESS, profile_cte("p", stats)) + "SELECT * FROM p"


ORACLE: dict[str, str] = {
    "scan_typed": TYPED,
    "profile_columns": PROFILE_COLUMNS,
    "select_scores": "SELECT " + ", ".join(SC) + " FROM lineitem",
    "drop_by_pattern": with_(ASSESS, profile_cte("p", ["mean"], cols=SC[:3])) + "SELECT * FROM p",
    "keep_stat_columns": _p(["mean"]).replace("SELECT * FROM p", "SELECT point_id, l_quantity_mean, l_extendedprice_mean, l_discount_mean FROM p"),
    "select_positions": "SELECT l_returnflag, l_shipdate FROM lineitem",
    "class_table_csv": with_(CLASSES) + f"SELECT point_id, class, status, {R('lat')} AS lat, {R('lon')} AS lon FROM classes",
    "head_n": _p(["mean"]) + " ORDER BY point_id LIMIT 10",
    "scan_csv": SCAN_CSV,
    "scan_sheets": SCAN_CSV,
    "write_roundtrip": TYPED,
    "repair_date_scores": REPAIR,
    "rows_any_null": with_(NULLS) + f"SELECT * FROM nl WHERE {_any_null}",
    "drop_any_null": with_(NULLS) + f"SELECT * FROM nl WHERE NOT ({_any_null})",
    "null_cell_counts": NULL_COUNTS,
    "range_guard": with_(NULLS) + "SELECT * FROM nl WHERE l_discount <= CAST(0.05 AS DOUBLE)",
    "profile_mean": _p(["mean"]),
    "profile_stats": _p(["mean", "min", "max", "max_min_diff"]),
    "profile_mean_sd": _p(["media", "sd"]),
    "mode_first_seen": with_(MODE_CTE) + "SELECT * FROM m",
    "mode_fill_signed_zero": SIGNED_ZERO,
    "mode_fill": with_(MODE_CTE) + ("SELECT e.event_id, e.user_id, m.event_type, e.value FROM events e "
                                    "JOIN m USING (user_id)"),
    "first_row_per_key": ("SELECT user_id, event_id, ts, event_type, value FROM (SELECT *, ROW_NUMBER() OVER "
                          "(PARTITION BY user_id ORDER BY event_id) AS rn FROM events) WHERE rn = 1"),
    "class_distribution": ("SELECT o_orderpriority, COUNT(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL "
                           "GROUP BY 1"),
    "class_order": f"SELECT o_orderpriority, {_ord_case} AS ordinal, COUNT(*) AS n FROM orders GROUP BY 1",
    "label_ordinal": f"SELECT o_orderkey, o_orderpriority, {_ord_case} AS label FROM orders",
    "label_binary": with_("o AS (SELECT o_orderkey, CASE WHEN o_orderpriority <> '3-MEDIUM' THEN o_orderpriority "
                          "END AS class FROM orders)") + f"SELECT o_orderkey, class, {_label} AS label FROM o",
    "label_index": ("SELECT o_orderkey, o_orderpriority, CAST(DENSE_RANK() OVER (ORDER BY o_orderpriority) - 1 "
                    "AS DOUBLE) AS label_index FROM orders"),
    "distinct_attrs": "SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem",
    "join_label_inner": with_(ASSESS, CLASSES, profile_cte("p", ["mean"]))
    + "SELECT p.*, c.class FROM p JOIN classes c USING (point_id)",
    "join_geo_inner": with_(ASSESS, CLASSES, profile_cte("p", ["mean", "min", "max", "max_min_diff"]))
    + "SELECT * FROM p JOIN classes USING (point_id)",
    "join_left_suffix": with_(ASSESS, CLASSES, "rest AS (SELECT * FROM classes WHERE class <> '5-LOW')") + (
        "SELECT a.point_id, a.point, a.rater, a.status AS status_left, a.visit_ts, "
        + ", ".join(f"a.{s}" for s in SC)
        + ", c.class, c.status AS status_right, c.lat, c.lon FROM assess a LEFT JOIN rest c "
          "ON a.point_id = c.point_id"),
    "join_two_keys": with_(*TWO_KEY) + "SELECT * FROM p2 JOIN attrs USING (point_id, point)",
    "join_left_two_keys": with_(*TWO_KEY) + (
        "SELECT p2.*, a.status FROM p2 LEFT JOIN (SELECT * FROM attrs WHERE point <> 'N') a USING (point_id, point)"),
    "join_fanout": with_(NAMED, NAMED_CLASSES, profile_cte("pn", ["mean"], keys=("point_id", "point"), src="na"),
                         "ids AS (SELECT DISTINCT point, point_id, class FROM nc)") + (
        "SELECT pn.* EXCLUDE (point_id), ids.point_id, ids.class FROM pn JOIN ids USING (point)"),
    "join_first_visit": with_(*EVENT_CTES) + "SELECT * FROM prof JOIN v USING (user_id)",
    "disagreement_over_time": with_(*EVENT_CTES) + (
        "SELECT user_id, visit_date, event_type AS score, value_sd AS sd FROM prof JOIN v USING (user_id)"),
    "disagreement_unpivoted": DISAGREEMENT,
    "training_table": TRAINING,
    "feature_ranges": FEATURE_RANGES,
    "score_correlation": SCORE_CORR,
    "scatter_bins": with_(ASSESS, CLASSES, profile_cte("p", ["mean"]),
                          "x AS (SELECT p.*, c.class FROM p JOIN classes c USING (point_id))") + (
        "SELECT class, CAST(FLOOR(l_quantity_mean / 5.0::DOUBLE) AS BIGINT) AS x_bin, "
        "CAST(FLOOR(l_tax_mean / 0.01::DOUBLE) AS BIGINT) AS y_bin, "
        f"{R('FLOOR(l_quantity_mean / 5.0::DOUBLE) * 5.0::DOUBLE')} AS x_low, "
        f"{R('FLOOR(l_tax_mean / 0.01::DOUBLE) * 0.01::DOUBLE')} AS y_low, COUNT(*) AS n FROM x "
        "WHERE l_quantity_mean IS NOT NULL AND l_tax_mean IS NOT NULL GROUP BY 1, 2, 3, 4, 5"),
    "melt_ranges": with_(*MELTED) + f"SELECT point_id, class, variable, {R('value')} AS value FROM melted",
    "box_by_variable": box_sql(MELTED, "melted", ["variable"], "value"),
    "box_by_class": box_sql(SCORED, "x", ["class", "label"], "l_quantity_mean"),
    "box_outliers": BOX_OUTLIERS,
    "stratified_split": SPLIT,
    "stratified_folds": FOLDS_CTE + "SELECT * FROM fo",
    "split_sizes": f"SELECT split, COUNT(*) AS n FROM ({SPLIT}) GROUP BY split",
    "fold_rows": FOLDS_CTE + "SELECT * FROM fo WHERE fold <> 0",
    "classification_report": REPORT,
    "confusion_matrix": CONFUSION,
    "sigmoid": with_(*CONTRIB) + (f"SELECT id, feature, {R('contribution')} AS contribution, "
                                  f"{R(_sig.format(x='contribution'))} AS probability FROM contrib"),
    "attribution_total": with_(*CONTRIB) + (
        f"SELECT id, {R('MAX(base)')} AS base, {R('MAX(base) + SUM(contribution)')} AS logodds, "
        f"{R(_sig.format(x='MAX(base) + SUM(contribution)'))} AS probability FROM contrib GROUP BY id"),
    "attribution_path": with_(*CONTRIB, PATH_CTE) + (
        f"SELECT id, step, feature, {R('contribution')} AS contribution, {R('lo')} AS logodds, "
        f"{R(_sig.format(x='lo'))} AS probability FROM path"),
    "attribution_text": TEXT,
    "attribution_summary": with_(*CONTRIB) + (
        f"SELECT feature, {R('AVG(ABS(contribution))')} AS mean_abs, {R('CORR(value, contribution)')} "
        "AS value_corr, COUNT(*) AS n FROM contrib GROUP BY feature"),
}


# ------------------------------------------------------------------ companions of the model keys
_ORD = "CASE class " + " ".join(f"WHEN {_q(v)} THEN {i}" for i, v in enumerate(fx.PRIORITY_ORDER)) + " END"
POINTS = SCORED + [f"pts AS (SELECT x.*, {_ORD} AS ordinal FROM x)"]


def _hash_ranked(src: str, key: str, cls: str, seed: int = K.SPLIT_SEED) -> list[str]:
    return [f"rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {cls} ORDER BY md5(CAST({key} AS VARCHAR) || ':{seed}'), {key}) AS rk "
            f"FROM {src})", f"szs AS (SELECT {cls}, COUNT(*) AS c FROM {src} GROUP BY 1)"]


def _supports(cls: str) -> str:
    """Rows of the test part per class, and three times their total."""
    return with_(*POINTS, *_hash_ranked("pts", "point_id", cls),
                 f"t AS (SELECT *, SUM(c) OVER () AS n FROM szs)",
                 f"t2 AS (SELECT *, CAST(c AS DOUBLE) * (n - CEIL(CAST({K.TEST_SHARE} AS DOUBLE) * n)) / n AS cont, "
                 f"n - CEIL(CAST({K.TEST_SHARE} AS DOUBLE) * n) AS ntr FROM t)",
                 f"t3 AS (SELECT *, ntr - SUM(FLOOR(cont)) OVER () AS need, ROW_NUMBER() OVER (ORDER BY cont - FLOOR(cont) DESC, {cls}) AS rr FROM t2)",
                 f"q AS (SELECT {cls}, c - (FLOOR(cont) + CASE WHEN rr <= need THEN 1 ELSE 0 END) AS test_n FROM t3)",
                 f"s AS (SELECT CAST({cls} AS VARCHAR) AS class, COUNT(*) AS support FROM rk JOIN q USING ({cls}) WHERE rk <= test_n GROUP BY 1)") + (
        "SELECT class, support FROM s UNION ALL SELECT u.c, CAST(SUM(support) AS BIGINT) FROM s, "
        "(VALUES ('accuracy'), ('macro avg'), ('weighted avg')) u(c) GROUP BY 1")


_CV = (f"WITH t AS ({TRAINING}) SELECT fold, COUNT(*) AS n_test, true AS agrees, true AS mean_agrees, "
       f"CAST({K.N_FOLDS} AS BIGINT) AS folds_scored FROM t GROUP BY fold")
_TRAINING_SUPPORTS = (f"WITH t AS ({TRAINING}), s AS (SELECT CAST(factor AS VARCHAR) AS class, COUNT(*) AS support FROM t WHERE fold = 0 GROUP BY 1) "
                      "SELECT class, support FROM s UNION ALL SELECT u.c, CAST(SUM(support) AS BIGINT) FROM s, "
                      "(VALUES ('accuracy'), ('macro avg'), ('weighted avg')) u(c) GROUP BY 1")

_FORM = with_(*POINTS) + " UNION ALL ".join(
    f"SELECT '{case}' AS \"case\", " + ", ".join(f"{R(f'{agg}({m})')} AS {m}" for m in MEANS) + ", true AS in_range FROM pts"
    for case, agg in (("min", "MIN"), ("mean", "AVG"), ("max", "MAX")))

_each_point = with_(*POINTS) + "SELECT point_id, {what} FROM pts"
_exact = _each_point.format(what="CAST(4 AS BIGINT) AS features, true AS exact")

ORACLE |= {
    "tree_multiclass_check": _supports("ordinal"),
    "boosted_binary_check": _supports("label"),
    "boosted_multiclass_check": _TRAINING_SUPPORTS,
    "cv_accuracy_check": _CV,
    "score_points_check": _each_point.format(what="class, label, true AS fits"),
    "score_rows_check": _FORM,
    "explain_rows_check": "SELECT c AS \"case\", true AS ends_at_probability FROM (VALUES ('min'), ('mean'), ('max')) v(c)",
    "raw_scoring_check": _each_point.format(what="class, true AS same"),
    "model_roundtrip_check": _each_point.format(what="true AS same"),
    "feature_importance_check": " UNION ALL ".join(f"SELECT {_q(m)} AS feature, true AS adds_up" for m in MEANS),
    "tree_rules_check": _each_point.format(what="CAST(1 AS INTEGER) AS rules_met"),
    "tree_nodes_check": with_(*POINTS, f"t AS (SELECT CAST(COUNT(*) - CEIL(CAST({K.TEST_SHARE} AS DOUBLE) * COUNT(*)) AS BIGINT) AS n FROM pts)")
    + "SELECT true AS agrees, n AS root_rows, n AS leaf_rows FROM t",
    "attribute_points_check": _exact,
    "missing_attribution": _each_point.format(what="CAST(4 AS BIGINT) AS features, true AS exact, true AS learned"),
    "attribution_ranking_check": with_(*POINTS) + " UNION ALL ".join(
        f"SELECT {_q(m)} AS feature, COUNT(*) AS n, true AS in_range FROM pts" for m in MEANS),
    "thematic_points_check": with_(*POINTS) + (
        f"SELECT point_id, c.status, {R('c.lat')} AS lat, {R('c.lon')} AS lon, {R('AVG(c.lat) OVER ()')} AS center_lat, "
        f"{R('AVG(c.lon) OVER ()')} AS center_lon FROM pts JOIN classes c USING (point_id)"),
    "box_by_prediction_check": with_(*POINTS) + (
        f"SELECT COUNT(*) AS n, {R('MIN(l_quantity_max_min_diff)')} AS least, {R('MAX(l_quantity_max_min_diff)')} AS most FROM pts"),
    "tune_boosted_check": (f"SELECT CAST({K.SEARCH_CANDIDATES} AS BIGINT) AS candidates, 1 AS inside, CAST(1 AS BIGINT) AS best, "
                           "true AS is_highest"),
}

_ASKED = POINTS + ["asked AS (SELECT *, l_quantity_mean > 25.0::DOUBLE AND l_discount_mean > 0.045::DOUBLE AS planted, "
                   "l_quantity_mean / 10.0::DOUBLE AS tens FROM pts)"]
_CLEAR = "WHERE ABS(l_quantity_mean - 25.0::DOUBLE) > {q}::DOUBLE AND ABS(l_discount_mean - 0.045::DOUBLE) > {d}::DOUBLE"
_clear = _CLEAR.format(q=0.7, d=0.004)

ORACLE |= {
    "planted_folds": with_(*_ASKED) + f"SELECT point_id, CAST(point_id % 5 AS INTEGER) AS fold, CAST(planted AS INTEGER) AS prediction FROM asked {_clear}",
    "planted_softmax": with_(*_ASKED) + ("SELECT point_id, CAST(LEAST(FLOOR(tens), 4) AS INTEGER) AS prediction, true AS adds_up, 5 AS classes "
                                         "FROM asked WHERE ABS(tens - ROUND(tens)) * 10.0::DOUBLE > 0.7::DOUBLE"),
    "planted_tree": with_(*_ASKED) + f"SELECT point_id, CAST(planted AS INTEGER) AS prediction FROM asked {_CLEAR.format(q=2.5, d=0.01)}",
    "planted_search": (f"SELECT CAST({K.SEARCH_CANDIDATES} AS BIGINT) AS candidates, CAST(1 AS BIGINT) AS best, true AS found, true AS is_highest"),
    "planted_grid": ("SELECT CAST(row_number() OVER (ORDER BY d, e, a) - 1 AS INTEGER) AS candidate, CAST(d AS INTEGER) AS max_depth, e AS learning_rate, "
                     "a AS reg_alpha, true AS found FROM (VALUES (3), (5)) x(d), (VALUES (0.3::DOUBLE), (0.5::DOUBLE)) y(e), "
                     "(VALUES (0.0::DOUBLE), (0.1::DOUBLE)) z(a)"),
    "planted_importance": "SELECT f AS feature, true AS is_share FROM (VALUES ('l_quantity_mean'), ('l_discount_mean')) v(f)",
    "planted_map": with_(*_ASKED) + (
        f"SELECT point_id, c.status, CAST(planted AS INTEGER) AS prediction, CASE WHEN planted THEN {_q(K.PREDICTION_TEXT[1])} ELSE "
        f"{_q(K.PREDICTION_TEXT[0])} END AS prediction_class, CASE WHEN planted THEN '255,0,0' ELSE '0,255,0' END AS color "
        f"FROM asked JOIN classes c USING (point_id) {_clear}"),
}
