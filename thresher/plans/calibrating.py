"""Thresholds, fusion and route calibration."""

from pyspark.sql import functions as F

from thresher.fixed_values import OPERATING_TARGET, RECALL_TARGETS
from thresher.functions.scores import route
from thresher.operators import calibration as K
from thresher.plans.expressions import FUSED_SQL
from thresher.plans.registry import query
from thresher.plans.views import SCORED, SCORED_BIG, auc_sql, confusion_sql

# --- SQL fragments -------------------------------------------------------------------


def recall_cut_sql(source, score, target, keys="", method="misses"):
    """(keys, threshold, positives) from the ordered positives."""
    n = "count(*)"
    if method == "misses":
        place = f"least(greatest(floor((1.0::DOUBLE - {target}::DOUBLE) * {n} + 1e-12::DOUBLE), 0), {n} - 1)"
    else:
        place = f"{n} - ceil({target}::DOUBLE * {n})"
    lead, tail = (f"{keys}, ", f" GROUP BY {keys}") if keys else ("", "")
    return f"SELECT {lead}list_sort(list({score}))[({place} + 1)::INT] AS threshold, {n} AS positives FROM {source} WHERE y = 1{tail}"


FUSION_CELLS = f"""fused AS (SELECT (i / 20.0::DOUBLE) AS alpha, y, round({FUSED_SQL.format(a='(i / 20.0::DOUBLE)')}, 9) AS score FROM scored, range(21) t(i)),
cuts AS ({recall_cut_sql('fused', 'score', OPERATING_TARGET, 'alpha', 'ceil')}),
cells AS (SELECT f.alpha, c.threshold, count(*) AS n, count(*) FILTER (y = 1 AND score >= threshold) AS tp, count(*) FILTER (y = 1 AND score < threshold) AS fn,
    count(*) FILTER (y = 0 AND score >= threshold) AS fp, count(*) FILTER (y = 0 AND score < threshold) AS tn
  FROM fused f JOIN cuts c ON c.alpha = f.alpha GROUP BY f.alpha, c.threshold)"""

BEST_FUSION = SCORED + ",\n" + FUSION_CELLS + """,
best_fusion AS (SELECT *, tp / nullif(tp + fn, 0)::DOUBLE AS recall, fp / nullif(fp + tn, 0)::DOUBLE AS fpr, tp / nullif(tp + fp, 0)::DOUBLE AS precision
  FROM cells ORDER BY fpr, precision DESC, alpha LIMIT 1)"""


def curve_sql(source, score):
    return f"""curve AS (
  SELECT s AS threshold, tp, fp, tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(positives, 0)::DOUBLE AS recall
  FROM (SELECT s, sum(p) OVER (ORDER BY s DESC) AS tp, sum(q) OVER (ORDER BY s DESC) AS fp, sum(p) OVER () AS positives
    FROM (SELECT {score} AS s, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM {source} GROUP BY {score})))"""


def cut_points_sql(source, score, steps):
    """Exact quantiles with the same interpolation, distinct, with infinities."""
    return f"""ordered AS (SELECT {score} AS v, row_number() OVER (ORDER BY {score}) - 1 AS r, count(*) OVER () AS n FROM {source}),
spots AS (SELECT DISTINCT (n - 1) * (i / {steps - 1}.0::DOUBLE) AS spot FROM ordered, range({steps}) t(i)),
ends AS (SELECT spot - floor(spot) AS f, (SELECT v FROM ordered WHERE r = floor(spot)) AS lo, (SELECT v FROM ordered WHERE r = ceil(spot)) AS hi FROM spots),
cut_points AS (SELECT DISTINCT CASE WHEN f >= 0.5 THEN hi - (hi - lo) * (1.0::DOUBLE - f) ELSE lo + (hi - lo) * f END AS cut FROM ends
  UNION SELECT '-inf'::DOUBLE UNION SELECT 'inf'::DOUBLE)"""


STEPS = 21


def route_grid_sql(steps=STEPS):
    """Brute force: every pair judged on every row."""
    return SCORED + ",\n" + cut_points_sql("scored", "router", steps) + """,
pairs AS (SELECT a.cut AS low, b.cut AS high FROM cut_points a JOIN cut_points b ON a.cut <= b.cut),
judged AS (SELECT low, high, y, CASE WHEN router >= high THEN 1 WHEN router >= low THEN (direct >= 0.5)::INT ELSE 0 END AS said,
    (router >= low AND router < high)::INT AS routed FROM scored, pairs),
counted AS (SELECT low, high, count(*) FILTER (y = 1 AND said = 1) AS tp, count(*) FILTER (y = 0 AND said = 1) AS fp,
    count(*) FILTER (y = 1 AND said = 0) AS fn, count(*) FILTER (y = 0 AND said = 0) AS tn, sum(routed)::BIGINT AS routed, count(*) AS n
  FROM judged GROUP BY low, high),
grid AS (SELECT low, high, tp, fp, fn, tn, routed, tp / nullif(tp + fn, 0)::DOUBLE AS recall, fp / nullif(fp + tn, 0)::DOUBLE AS fpr,
    coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, (tp + tn) / n::DOUBLE AS accuracy, routed / n::DOUBLE AS route_rate FROM counted)"""




def shown(df):
    """Replaces infinities by large finite numbers."""
    finite = lambda c: F.when(F.col(c) == float("-inf"), -1e9).when(F.col(c) == float("inf"), 1e9).otherwise(F.col(c)).alias(c)
    return df.select(*[finite(c) if c in ("low", "high", "cut") else F.col(c) for c in df.columns])


def shown_sql(c):
    return f"CASE WHEN {c} = '-inf'::DOUBLE THEN -1e9 WHEN {c} = 'inf'::DOUBLE THEN 1e9 ELSE {c} END::DOUBLE AS {c}"


GRID_COLUMNS = "tp, fp, fn, tn, routed, recall, fpr, precision, accuracy, route_rate"

# --- queries -------------------------------------------------------------------------


@query("K1b, T2, T3", f"WITH {SCORED_BIG} {recall_cut_sql('scored_big', 's1', 0.9)}")
def recall_threshold_by_misses(t):
    return K.threshold_for_recall(t.scored_big(), "y", "s1", 0.9)


@query("K1, T2, T3", f"WITH {SCORED_BIG} {recall_cut_sql('scored_big', 's1', 0.95, 'split', 'ceil')}")
def recall_threshold_by_ceiling(t):
    return K.threshold_for_recall(t.scored_big(), "y", "s1", 0.95, "ceil", ["split"])


@query("K2", f"""WITH {SCORED_BIG}, {curve_sql('scored_big', 's1')}
SELECT 0.9::DOUBLE AS target, threshold, recall, precision FROM curve WHERE recall >= 0.9 ORDER BY precision DESC, threshold DESC LIMIT 1""")
def threshold_from_pr_curve(t):
    return K.threshold_from_curve(t.scored_big(), "y", "s1", (0.9,), required=True)


@query("K3", f"""WITH {SCORED_BIG}, {curve_sql('scored_big', 's1')},
targets AS (SELECT unnest([{', '.join(str(r) for r in RECALL_TARGETS)}])::DOUBLE AS target)
SELECT target, threshold, recall, precision FROM (
  SELECT target, threshold, recall, precision, row_number() OVER (PARTITION BY target ORDER BY precision DESC, threshold DESC) AS place
  FROM curve JOIN targets ON recall >= target) WHERE place = 1""")
def recall_target_sweep(t):
    return K.threshold_from_curve(t.scored_big(), "y", "s1")


@query("K4", f"""WITH {BEST_FUSION}, winner AS (SELECT y, score FROM fused WHERE alpha = (SELECT alpha FROM best_fusion))
SELECT alpha, threshold, n, tp, fn, fp, tn, recall, fpr, precision, round((SELECT auc FROM ({auc_sql('winner', 'y', 'score')})), 9) AS auc FROM best_fusion""")
def fusion_calibration(t):
    best = K.calibrate_fusion(t.scored(), "y", "direct", "class_bill", OPERATING_TARGET, digits=9)
    return best.withColumn("auc", F.round("auc", 9))


@query("K5", f"WITH {SCORED}, {cut_points_sql('scored', 'router', 101)} SELECT {shown_sql('cut')} FROM cut_points")
def cut_points(t):
    return shown(K.cut_points(t.scored(), "router"))


@query("K6", f"""WITH {route_grid_sql()} SELECT {shown_sql('low')}, {shown_sql('high')}, {GRID_COLUMNS} FROM grid""")
def route_grid(t):
    return shown(K.route_grid(t.scored(), "y", "router", "direct", 0.5, STEPS))


@query("K6", f"""WITH {route_grid_sql()} SELECT {shown_sql('low')}, {shown_sql('high')}, {GRID_COLUMNS} FROM (
  SELECT * FROM grid WHERE recall >= 0.5 ORDER BY fpr, route_rate, precision DESC, low, high LIMIT 1)""")
def accuracy_first_route(t):
    return shown(K.accuracy_first(K.route_grid(t.scored(), "y", "router", "direct", 0.5, STEPS), 0.5))


@query("K7", f"""WITH {route_grid_sql()}, caps AS (SELECT unnest([0.1, 0.2, 0.3, 0.5])::DOUBLE AS cap),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cap ORDER BY (recall >= 0.5) DESC, CASE WHEN recall >= 0.5 THEN fpr ELSE -recall END,
    CASE WHEN recall >= 0.5 THEN -recall ELSE fpr END, low, high) AS place FROM grid JOIN caps ON route_rate <= cap + 1e-12)
SELECT cap, {shown_sql('low')}, {shown_sql('high')}, {GRID_COLUMNS} FROM ranked WHERE place = 1""")
def speed_profiles(t):
    return shown(K.speed_profiles(K.route_grid(t.scored(), "y", "router", "direct", 0.5, STEPS), 0.5))


ROUTED = SCORED + """,
routed AS (SELECT *, CASE WHEN router >= 0.55 THEN 1 WHEN router >= 0.45 THEN (direct >= 0.5)::INT ELSE 0 END AS said,
  (router >= 0.45 AND router < 0.55)::INT AS uncertain FROM scored WHERE split = 'test')"""


@query("K8", f"WITH {ROUTED} SELECT c.*, (SELECT avg(uncertain) FROM routed) AS route_rate FROM ({confusion_sql('y', 'said = 1')('routed')}) c")
def fixed_point_on_test(t):
    test = t.scored().filter(F.col("split") == "test")
    return K.evaluate_route(test, "y", "router", "direct", 0.45, 0.55, 0.5)


LONG = SCORED + """,
long AS (SELECT 'direct' AS candidate, 0 AS position, id, y, direct AS score FROM scored
  UNION ALL SELECT 'class_bill', 1, id, y, class_bill FROM scored UNION ALL SELECT 'router', 2, id, y, router FROM scored)"""


@query("K9", f"""WITH {LONG}, cuts AS ({recall_cut_sql('long', 'score', 0.9, 'candidate, position')}), areas AS ({auc_sql('long', 'y', 'score', 'candidate')}),
judged AS (SELECT l.candidate, l.position, c.threshold, count(*) FILTER (y = 1 AND score >= threshold) / count(*) FILTER (y = 1)::DOUBLE AS recall,
    count(*) FILTER (y = 0 AND score >= threshold) / count(*) FILTER (y = 0)::DOUBLE AS fpr
  FROM long l JOIN cuts c ON c.candidate = l.candidate GROUP BY l.candidate, l.position, c.threshold)
SELECT j.candidate, threshold, recall, fpr, round(auc, 9) AS auc FROM judged j JOIN areas a ON a.candidate = j.candidate
ORDER BY round(fpr, 12), auc DESC, position LIMIT 1""")
def best_candidate(t):
    long = t.scored().select("id", "y", F.expr("stack(3, 'direct', 0, direct, 'class_bill', 1, class_bill, 'router', 2, router) AS (candidate, position, score)"))
    return K.select_candidate(long, "candidate", "position", "y", "score", 0.9).withColumn("auc", F.round("auc", 9))


def report_sql(part, split, threshold):
    cells = confusion_sql("y", f"s1 >= {threshold}")(f"(SELECT * FROM scored_big WHERE split = '{split}')")
    return f"""SELECT '{part}' AS part, {threshold}::DOUBLE AS threshold, n, positive, accuracy, precision, recall,
  round((SELECT auc FROM ({auc_sql(f"(SELECT * FROM scored_big WHERE split = '{split}')", 'y', 's1')})), 9) AS auc FROM ({cells})"""


CHOSEN = "(SELECT threshold FROM chosen)"


@query("K10", f"""WITH {SCORED_BIG}, {curve_sql("(SELECT * FROM scored_big WHERE split = 'val')", 's1')},
chosen AS (SELECT threshold FROM curve WHERE recall >= 0.9 ORDER BY precision DESC, threshold DESC LIMIT 1)
{report_sql('validation', 'val', CHOSEN)} UNION ALL {report_sql('test', 'test', CHOSEN)} UNION ALL {report_sql('test_fixed', 'test', '0.5')}""")
def select_on_val_report_on_test(t):
    big = t.scored_big()
    report = K.select_then_report(big.filter(F.col("split") == "val"), big.filter(F.col("split") == "test"), "y", "s1", 0.9)
    return report.withColumn("auc", F.round("auc", 9))


@query("K11", """WITH routed AS (SELECT l_tax AS router_cost, l_discount AS large_cost, (l_quantity >= 20 AND l_quantity < 30)::INT AS routed FROM lineitem)
SELECT round(avg(router_cost), 9) AS router_cost, round(avg(large_cost), 9) AS large_cost, round(avg(routed), 9) AS route_rate,
  round(avg(router_cost) + avg(routed) * avg(large_cost), 9) AS expected_cost FROM routed""")
def expected_cost(t):
    rows = t.table("lineitem")
    _, routed = route("l_quantity", "l_quantity", 20, 30, 25)
    cost = K.expected_cost(rows.withColumn("routed", routed), "routed", "l_tax", "l_discount")
    return cost.select(*[F.round(c, 9).alias(c) for c in cost.columns])


@query("K6, K7, K8", f"""WITH {route_grid_sql()}, caps AS (SELECT unnest([0.1, 0.2, 0.3, 0.5])::DOUBLE AS cap),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cap ORDER BY (recall >= 0.5) DESC, CASE WHEN recall >= 0.5 THEN fpr ELSE -recall END,
    CASE WHEN recall >= 0.5 THEN -recall ELSE fpr END, low, high) AS place FROM grid JOIN caps ON route_rate <= cap + 1e-12),
points AS (SELECT 'route_cap_' || (cap * 100)::INT || 'pct' AS profile, low, high FROM ranked WHERE place = 1
  UNION ALL SELECT 'accuracy_first', low, high FROM (SELECT * FROM grid WHERE recall >= 0.5 ORDER BY fpr, route_rate, precision DESC, low, high LIMIT 1)),
applied AS (SELECT profile, y, CASE WHEN router >= high THEN 1 WHEN router >= low THEN (class_bill >= 0.5)::INT ELSE 0 END AS said,
  (router >= low AND router < high)::INT AS routed FROM scored, points),
rates AS (SELECT profile, avg(routed) AS route_rate FROM applied GROUP BY profile)
SELECT c.*, r.route_rate FROM ({confusion_sql('y', 'said = 1', 'profile')('applied')}) c JOIN rates r ON r.profile = c.profile""")
def profiles_with_another_model(t):
    """Profiles calibrated with one large model, evaluated with another."""
    points = K.calibrate_route(t.scored(), "y", "router", "direct", 0.5, 0.5, STEPS)
    return K.evaluate_routes(t.scored(), "y", "router", "class_bill", points, 0.5)
