"""DuckDB oracle SQL for the registered queries (tables are pre-registered views)."""

from __future__ import annotations

U52 = "4503599627370496.0"

# design: x mapped into [1, 2), y = synthetic response
DESIGN = """
e AS (SELECT vec_id AS id,
             list_transform(embedding, lambda v: 1.0 + abs(v::DOUBLE) / (1.0 + abs(v::DOUBLE))) AS x
      FROM embeddings),
el AS (SELECT id, x, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM e),
d AS (SELECT id, any_value(x) AS x,
             sum(3.0 + i * pow(v, 3) + (i / 3.0) * ln(v * v + pow(v, 4)) - 5.0 * i * v) / count(*)
             + any_value(x[1] * pow(x[2], 2) - x[5] * x[3] + x[2] * x[4] + x[51] + x[50] * pow(x[54], 2)) AS y
      FROM el GROUP BY id)
"""

# long [x | y] with 0-based positions
DESIGN_LONG = DESIGN + """,
lv AS (SELECT id, i - 1 AS pos, v AS val FROM el
       UNION ALL SELECT id, len(x) AS pos, y AS val FROM d)
"""

SCALER = DESIGN_LONG + """,
sc AS (SELECT pos, avg(val) AS mean,
              CASE WHEN stddev_pop(val) = 0 THEN 1.0 ELSE stddev_pop(val) END AS scale
       FROM lv GROUP BY pos)
"""

SPLIT = """
sp AS (SELECT vec_id AS id,
              row_number() OVER (ORDER BY md5(concat_ws('|', vec_id, 42)), vec_id)
                <= ceil(0.15 * count(*) OVER ()) AS is_test
       FROM embeddings)
"""

RASTER = """
c AS (SELECT l_suppkey AS sample_id, ((l_linenumber - 1) * 12 + month(l_shipdate) - 1) AS pos,
             round(sum(l_discount), 6) AS value FROM lineitem GROUP BY 1, 2),
p AS (SELECT l_suppkey AS sample_id, ((l_linenumber - 1) * 12 + month(l_shipdate) - 1) AS pos,
             round(count(*) * 0.05, 6) AS value FROM lineitem GROUP BY 1, 2),
g AS (SELECT range AS pos FROM range(0, 84)),
s AS (SELECT s_suppkey AS sample_id FROM supplier)
"""

REPORT = "WITH " + RASTER + """,
f AS (SELECT s.sample_id, g.pos,
             coalesce(CASE WHEN c.value < 0.5 THEN 0.0 ELSE c.value END, 0.0) AS gt,
             coalesce(CASE WHEN p.value < 0.5 THEN 0.0 ELSE p.value END, 0.0) AS pr
      FROM s CROSS JOIN g
      LEFT JOIN c ON c.sample_id = s.sample_id AND c.pos = g.pos
      LEFT JOIN p ON p.sample_id = s.sample_id AND p.pos = g.pos),
m AS (SELECT pos, avg(gt) AS gm, stddev_pop(gt) AS gs, avg(pr) AS pm, stddev_pop(pr) AS ps
      FROM f GROUP BY pos),
cm AS (SELECT pos,
              CASE WHEN gm > 0 THEN gm END AS gt_mean_masked,
              CASE WHEN pm > 0 THEN pm END AS pred_mean_masked,
              CASE WHEN gm > 0 THEN gs END AS gt_std_masked,
              CASE WHEN pm > 0 THEN ps END AS pred_std_masked,
              CASE WHEN gm - pm <> 0 THEN gm - pm END AS diff_mean,
              CASE WHEN gs - ps <> 0 THEN gs - ps END AS diff_std,
              sign(gm - pm) AS sign
       FROM m),
er AS (SELECT sample_id, pos, CASE WHEN abs(gt) > 1e-6 THEN (gt - pr) / gt * 100.0 END AS err_pct FROM f),
cnt AS (SELECT sample_id, count_if(err_pct < 0) AS n_neg, count_if(err_pct > 0) AS n_pos
        FROM er GROUP BY sample_id)
"""

PRED = """
pr AS (SELECT l.l_returnflag AS model, l.l_linenumber AS task, l.l_extendedprice / 1000.0 AS y,
              l.l_quantity * pt.p_retailprice / 1000.0 AS mean,
              l.l_quantity * pt.p_retailprice / 1000.0 * 0.1 + 1.0 AS sd
       FROM lineitem l JOIN part pt ON l.l_partkey = pt.p_partkey),
pi AS (SELECT *, mean - 1.96 * sd AS lower, mean + 1.96 * sd AS upper FROM pr)
"""

LOSS = """
h AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch,
             value AS loss FROM events)
"""


def R(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


ORACLE_SQL = {
    "fn1_response": f"WITH {DESIGN} SELECT id, {R('y')} AS y FROM d",

    "src8_design": f"""
WITH gen AS (
  SELECT e.vec_id AS id, j.j AS j,
         1.0 + (CASE WHEN j.j = 19 THEN 2.0 ELSE 1.0 END)
             * ((('0x' || substr(md5(concat_ws('|', e.vec_id, j.j, 42)), 1, 13))::UBIGINT)::DOUBLE / {U52}) AS v
  FROM embeddings e CROSS JOIN range(0, 100) AS j(j))
SELECT id, {R('sum(v)')} AS x_sum, {R('max(CASE WHEN j = 19 THEN v END)')} AS x19,
  {R('''sum(3.0 + (j + 1) * pow(v, 3) + ((j + 1) / 3.0) * ln(v * v + pow(v, 4)) - 5.0 * (j + 1) * v) / count(*)
    + max(CASE WHEN j = 0 THEN v END) * pow(max(CASE WHEN j = 1 THEN v END), 2)
    - max(CASE WHEN j = 4 THEN v END) * max(CASE WHEN j = 2 THEN v END)
    + max(CASE WHEN j = 1 THEN v END) * max(CASE WHEN j = 3 THEN v END)
    + max(CASE WHEN j = 50 THEN v END)
    + max(CASE WHEN j = 49 THEN v END) * pow(max(CASE WHEN j = 53 THEN v END), 2)''')} AS y
FROM gen GROUP BY id""",

    "agg1_scaler": f"WITH {SCALER} SELECT pos::BIGINT AS pos, {R('mean')} AS mean, {R('scale')} AS scale FROM sc",

    "prj4_standardise": f"""WITH {SCALER},
z AS (SELECT lv.id, lv.pos, (lv.val - sc.mean) / sc.scale AS z FROM lv JOIN sc USING (pos)),
w AS (SELECT max(pos) AS tpos FROM sc)
SELECT id, {R('max(CASE WHEN pos = w.tpos THEN z END)')} AS z_y,
       {R('sum(CASE WHEN pos < w.tpos THEN z ELSE 0.0 END)')} AS z_sum,
       {R('sum(CASE WHEN pos < w.tpos THEN z * z ELSE 0.0 END)')} AS z_sq
FROM z, w GROUP BY id""",

    "agg2_4_normalisers": f"""WITH {DESIGN}
SELECT (i - 1)::BIGINT AS pos, {R('avg(v)')} AS mean, {R('stddev_samp(v) + 1e-6')} AS std_eps,
       {R('greatest(stddev_samp(v), 1e-12)')} AS std_clamped, {R('min(v)')} AS min, {R('max(v)')} AS max,
       {R('greatest(max(v) - min(v), 1e-12)')} AS range
FROM el GROUP BY i""",

    "agg5_is_standardised": f"""WITH {DESIGN},
st AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM el GROUP BY i),
z AS (SELECT el.i, (el.v - st.m) / CASE WHEN st.s = 0 THEN 1.0 ELSE st.s END AS v FROM el JOIN st USING (i)),
st2 AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM z GROUP BY i)
SELECT 'raw' AS dataset, bool_and(abs(m) <= 0.01 AND abs(s - 1.0) <= 0.01001) AS is_standardised FROM st
UNION ALL
SELECT 'standardised', bool_and(abs(m) <= 0.01 AND abs(s - 1.0) <= 0.01001) FROM st2""",

    "agg6_station": f"""WITH {DESIGN},
am AS (SELECT CAST(trunc(quantile_cont(list_position(x, list_max(x)) - 1, 0.5)) AS BIGINT) AS st FROM d)
SELECT id, am.st AS station, {R('x[am.st + 1]')} AS value FROM d, am""",

    "srt2_split": f"WITH {SPLIT} SELECT id, is_test FROM sp",

    "job1_prepare": f"""WITH {SCALER}, {SPLIT},
z AS (SELECT lv.id, lv.pos, (lv.val - sc.mean) / sc.scale AS z FROM lv JOIN sc USING (pos)),
w AS (SELECT max(pos) AS tpos FROM sc),
per AS (SELECT id, max(CASE WHEN pos = w.tpos THEN z END) AS y,
               sum(CASE WHEN pos < w.tpos THEN z ELSE 0.0 END) AS xs FROM z, w GROUP BY id)
SELECT CASE WHEN sp.is_test THEN 'test' ELSE 'train' END AS split, count(*) AS n,
       {R('avg(y)')} AS y_mean, {R('sum(xs)')} AS x_sum
FROM per JOIN sp USING (id) GROUP BY sp.is_test""",

    "agg7_valid_cells": f"""WITH {RASTER}
SELECT g.pos::BIGINT AS pos, count_if(c.value >= 0.5)::BIGINT AS n_valid
FROM g LEFT JOIN c ON c.pos = g.pos GROUP BY g.pos""",

    "prj7_truncate": f"""WITH {RASTER},
k AS (SELECT pos FROM c GROUP BY pos HAVING count_if(value >= 0.5) > 0)
SELECT s.sample_id, k.pos::BIGINT AS pos, {R('coalesce(c.value, 0.0)')} AS value
FROM s CROSS JOIN k LEFT JOIN c ON c.sample_id = s.sample_id AND c.pos = k.pos""",

    "agg8_maps": REPORT + f"""
SELECT pos::BIGINT AS pos, {R('gt_mean_masked')} AS gt_mean_masked, {R('pred_mean_masked')} AS pred_mean_masked,
       {R('gt_std_masked')} AS gt_std_masked, {R('pred_std_masked')} AS pred_std_masked,
       {R('diff_mean')} AS diff_mean, {R('diff_std')} AS diff_std, sign::BIGINT AS sign FROM cm""",

    "prj12_mean_error": REPORT + f"SELECT pos::BIGINT AS pos, {R('avg(err_pct)')} AS mean_err_pct FROM er GROUP BY pos",

    "agg10_error_counts": REPORT + "SELECT sample_id, n_neg::BIGINT AS n_neg, n_pos::BIGINT AS n_pos FROM cnt",

    "srt1_best_worst": REPORT + """
SELECT * FROM (SELECT 'best' AS which, sample_id FROM cnt ORDER BY n_neg DESC, sample_id ASC LIMIT 1)
UNION ALL
SELECT * FROM (SELECT 'worst' AS which, sample_id FROM cnt ORDER BY n_pos DESC, sample_id ASC LIMIT 1)""",

    "agg11_12_limits": REPORT + f""",
lim AS (SELECT least(min(gt_mean_masked), min(pred_mean_masked)) AS min_mean,
               greatest(max(gt_mean_masked), max(pred_mean_masked)) AS max_mean,
               max(abs(diff_mean)) AS max_abs_diff,
               quantile_cont(diff_mean, 0.05) AS p5_diff FROM cm)
SELECT {R('min_mean', 9)} AS min_mean, {R('max_mean', 9)} AS max_mean, {R('max_abs_diff', 9)} AS max_abs_diff,
       {R('p5_diff', 9)} AS p5_diff,
       {R('least(greatest(p5_diff, max_abs_diff * 1e-6), max_abs_diff * 0.01)', 12)} AS linthresh FROM lim""",

    "agg13_histogram": f"""
WITH r AS (SELECT l_returnflag AS flag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(l_extendedprice) AS n
           FROM lineitem GROUP BY 1),
b AS (SELECT r.flag, r.lo, r.hi, r.n,
             CAST(CASE WHEN (r.hi - r.lo) / 30 > 0
                       THEN least(floor((l.l_extendedprice - r.lo) / ((r.hi - r.lo) / 30)), 29) ELSE 0 END AS BIGINT) AS bin
      FROM lineitem l JOIN r ON l.l_returnflag = r.flag)
SELECT flag, bin, {R('lo + bin * ((hi - lo) / 30)')} AS bin_left, count(*)::BIGINT AS n,
       {R('count(*) / (n * ((hi - lo) / 30))', 12)} AS density
FROM b GROUP BY flag, bin, lo, hi, n""",

    "agg14_zero_counts": """
SELECT l_returnflag AS model,
       count_if((CASE WHEN l_discount * 10 < 0.5 THEN 0.0 ELSE l_discount * 10 END) = 0)::BIGINT AS n_zero
FROM lineitem GROUP BY 1""",

    "met_scores": f"""WITH {PRED},
t AS (SELECT model, task, count(y) AS n, sum((mean - y) * (mean - y)) AS sse, var_pop(y) * count(y) AS sst,
             sum(y) AS sum_y, sum(abs(mean - y) / greatest(abs(y), 2.220446049250313e-16)) AS sum_ape,
             sum(CASE WHEN y >= lower AND y <= upper THEN 1 ELSE 0 END) AS n_in
      FROM pi GROUP BY model, task)
SELECT model, {R('avg(sqrt(sse / n))')} AS rmse,
       {R('sqrt(sum(sse) / sum(n)) / (sum(sum_y) / sum(n))')} AS nrmse,
       {R('100.0 * sum(sum_ape) / sum(n)')} AS mape,
       {R('avg(CASE WHEN sst <> 0 THEN 1.0 - sse / sst WHEN sse = 0 THEN 1.0 ELSE 0.0 END)')} AS r2,
       {R('sum(n_in) / sum(n)')} AS coverage,
       {R('abs(sum(n_in) / sum(n) - 0.95)')} AS qce,
       abs(sum(sum_y) / sum(n)) < 2.220446049250313e-16 AS mean_near_zero
FROM t GROUP BY model""",

    "met7_msll": f"""WITH {PRED},
tv AS (SELECT greatest(var_samp(y), 1e-12) AS tv FROM pr),
tm AS (SELECT task, avg(y) AS tm FROM pr GROUP BY task),
j AS (SELECT pi.model, pi.task,
             0.5 * ln(2.0 * pi() * greatest(sd * sd, 1e-12)) + (y - mean) * (y - mean) / (2.0 * greatest(sd * sd, 1e-12)) AS loss,
             0.5 * ln(2.0 * pi() * tv.tv) + (y - tm.tm) * (y - tm.tm) / (2.0 * tv.tv) AS triv
      FROM pi JOIN tm USING (task), tv)
SELECT model, task::BIGINT AS task, {R('avg(loss) - avg(triv)')} AS msll FROM j GROUP BY model, task""",

    "met8_interval": f"""
SELECT p_partkey AS id,
       {R('p_retailprice / 1000.0 - 1.959963984540054 * (p_size / 100.0)')} AS lower,
       {R('p_retailprice / 1000.0 + 1.959963984540054 * (p_size / 100.0)')} AS upper
FROM part""",

    "win1_3_spectrum": f"""WITH {DESIGN},
st AS (SELECT i - 1 AS pos, pow(stddev_pop(v), 2) AS variance FROM el GROUP BY i),
k AS (SELECT pos, variance, row_number() OVER (ORDER BY variance DESC, pos) AS k FROM st),
r AS (SELECT k, pos, variance / sum(variance) OVER () AS ratio FROM k),
c AS (SELECT k, pos, ratio, sum(ratio) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_ratio FROM r)
SELECT k::BIGINT AS k, pos::BIGINT AS pos, {R('ratio')} AS ratio, {R('cum_ratio')} AS cum_ratio,
       coalesce(min(CASE WHEN cum_ratio > 0.95 THEN k END) OVER (), 1)::BIGINT AS n_components,
       coalesce(min(CASE WHEN cum_ratio >= 0.90 THEN k END) OVER (), max(k) OVER () + 1)::BIGINT AS r90
FROM c""",

    "win4_6_loss_curves": f"""WITH {LOSS},
s AS (SELECT run, epoch, loss,
             CASE WHEN count(loss) OVER w20 = 20 THEN regr_slope(loss, epoch) OVER w20 END AS slope,
             min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_loss
      FROM h WINDOW w20 AS (PARTITION BY run ORDER BY epoch ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
f AS (SELECT *, CASE WHEN epoch > 50 AND slope IS NOT NULL AND slope > -1e-5 THEN 1 ELSE 0 END AS st FROM s),
isl AS (SELECT *, sum(1 - st) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM f),
cnt AS (SELECT *, sum(st) OVER (PARTITION BY run, island ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS counter FROM isl)
SELECT run, epoch::BIGINT AS epoch, {R('slope')} AS slope, counter::BIGINT AS counter, counter > 75 AS stop,
       {R('best_loss')} AS best_loss FROM cnt""",

    "fn4_6_schedules": f"""WITH {LOSS}
SELECT run, epoch::BIGINT AS epoch,
       {R('CASE WHEN epoch < 50 THEN 0.001 WHEN epoch < 250 THEN 0.001 + 0.999 / (1.0 + exp(-10.0 * ((epoch - 50.0) / 200.0 - 0.5))) ELSE 1.0 END')} AS kl_weight,
       {R('CASE WHEN epoch < 20 THEN epoch / 20.0 ELSE 0.5 * (1.0 + cos(pi() * (epoch - 20) / 180.0)) END')} AS lr_factor,
       {R('CASE WHEN epoch < 100 THEN 1.0 ELSE 0.5 END')} AS clip
FROM h""",

    "set2_last_wins": f"""
SELECT o_orderpriority AS model, {R('arg_max(o_totalprice / 1000.0, o_orderkey)')} AS rmse,
       {R('arg_max(o_custkey / 100.0, o_orderkey)')} AS train_time,
       {R('arg_max(o_orderkey % 97 / 1000.0, o_orderkey)')} AS infer_time
FROM orders GROUP BY 1""",

    "set1_union_models": f"""
SELECT o_orderpriority AS name, count(*) AS n, {R('sum(o_totalprice / 1000.0)')} AS rmse_sum FROM orders GROUP BY 1""",
}


def _normal(keys: str) -> str:
    """Box-Muller on two md5 uniforms, as ``hash_normal`` (keys joined with '|')."""
    u1 = f"(((('0x' || substr(md5(concat_ws('|', {keys}, 'n1')), 1, 13))::UBIGINT)::DOUBLE + 0.5) / {U52})"
    u2 = f"((('0x' || substr(md5(concat_ws('|', {keys}, 'n2')), 1, 13))::UBIGINT)::DOUBLE / {U52})"
    return f"(sqrt(-2.0 * ln({u1})) * cos(2.0 * pi() * {u2}))"


LSCALES = DESIGN + """,
cs AS (SELECT i - 1 AS pos, count(v) AS n, greatest(max(v) - min(v), 1e-12) AS rng FROM el GROUP BY i),
ls AS (SELECT pos, n, count(*) OVER () AS d, rng,
              3.0 * rng / pow(n::DOUBLE, 1.0 / count(*) OVER ()) AS ls_range,
              -ln(0.1) / (rng * count(*) OVER ()) AS ls_lower,
              avg(rng) OVER () / sqrt((count(*) OVER ())::DOUBLE) AS ls_mean_range FROM cs)
"""

ORACLE_SQL.update({
    "prj9_scatter": f"""WITH {RASTER},
k AS (SELECT pos FROM c GROUP BY pos HAVING count_if(value >= 0.5) > 0),
kv AS (SELECT s.sample_id, k.pos, CASE WHEN coalesce(c.value, 0.0) < 0.5 THEN 0.0 ELSE coalesce(c.value, 0.0) END AS value
       FROM s CROSS JOIN k LEFT JOIN c ON c.sample_id = s.sample_id AND c.pos = k.pos)
SELECT s.sample_id, g.pos::BIGINT AS pos, (g.pos // 12)::BIGINT AS row, (g.pos % 12)::BIGINT AS col,
       {R('coalesce(kv.value, 0.0)')} AS value
FROM s CROSS JOIN g LEFT JOIN kv ON kv.sample_id = s.sample_id AND kv.pos = g.pos""",

    "agg3_minmax_scaled": f"""WITH {DESIGN},
st AS (SELECT i, min(v) AS lo, greatest(max(v) - min(v), 1e-12) AS rg FROM el GROUP BY i),
sc AS (SELECT el.id, (el.v - st.lo) / st.rg AS s FROM el JOIN st USING (i))
SELECT id, {R('sum(s)')} AS scaled_sum, {R('max(s)')} AS scaled_max FROM sc GROUP BY id""",

    "agg16_means": f"""WITH {DESIGN},
st AS (SELECT i, stddev_samp(v) AS ss, max(v) - min(v) AS rg, var_pop(v) AS vp FROM el GROUP BY i)
SELECT {R('avg(ss + 1e-6)')} AS mean_std, {R('avg(rg)')} AS mean_range, {R('avg(vp)')} AS mean_var FROM st""",

    "srt4_top_ratios": f"""WITH {DESIGN},
st AS (SELECT i - 1 AS pos, pow(stddev_pop(v), 2) AS variance FROM el GROUP BY i),
k AS (SELECT pos, variance, row_number() OVER (ORDER BY variance DESC, pos) AS k FROM st),
r AS (SELECT k, pos, variance / sum(variance) OVER () AS ratio FROM k)
SELECT k::BIGINT AS k, pos::BIGINT AS pos, {R('ratio')} AS ratio FROM r ORDER BY ratio DESC, pos LIMIT 10""",

    "gp6_initial_lengthscale": f"""WITH {LSCALES}
SELECT pos::BIGINT AS pos, {R('ls_range')} AS ls_range, {R('ls_lower')} AS ls_lower,
       {R('ls_mean_range')} AS ls_mean_range FROM ls""",

    "gp4_5_priors": f"""WITH {LSCALES},
ag AS (SELECT sum(ln(1.0 / ls_range)) AS slb, sum(1.0 / ls_range) AS sb, any_value(n) AS n, any_value(d) AS d,
              sum(-ln(ls_range) - 0.5 * ln(2.0 * pi()) - pow(ln(ls_range) - ln(d::DOUBLE) / 2.0, 2) / 2.0) AS lognormal
       FROM ls)
SELECT {R('0.25 * (1.2 * slb - pow(n::DOUBLE, -1.0 / d) * (0.2 + d) * sb)')} AS reference_prior,
       {R('lognormal')} AS lognormal_prior FROM ag""",

    "srt6_padding": f"""WITH {DESIGN},
st AS (SELECT i - 1 AS j, avg(v) AS m, stddev_samp(v) + 1e-6 AS s FROM el GROUP BY i),
pts AS (SELECT d.id, st.j, st.m + st.s * {_normal("d.id, st.j, 42")} AS x FROM d CROSS JOIN st)
SELECT id, {R('sum(x)')} AS x_sum, {R('max(CASE WHEN j = 0 THEN x END)')} AS x0 FROM pts GROUP BY id""",

    "srt5_predictive_draws": f"""WITH {PRED.replace("SELECT l.l_returnflag AS model,", "SELECT l.l_orderkey * 8 + l.l_linenumber AS id, l.l_returnflag AS model,")},
dr AS (SELECT pi.task, pi.mean + pi.sd * {_normal("pi.id, pi.task, g.draw, 42")} AS value
       FROM pi CROSS JOIN (SELECT range AS draw FROM range(1, 33)) g)
SELECT task::BIGINT AS task, count(*) AS n, {R('avg(value)')} AS draw_mean, {R('stddev_pop(value)')} AS draw_sd
FROM dr GROUP BY task""",

    "job6_parity": f"""WITH {PRED.replace("SELECT l.l_returnflag AS model,", "SELECT l.l_orderkey * 8 + l.l_linenumber AS id, l.l_returnflag AS model,")},
f AS (SELECT id, CASE WHEN y < 0.5 THEN 0.0 ELSE y END AS yt, CASE WHEN mean < 0.5 THEN 0.0 ELSE mean END AS yp, sd FROM pi)
SELECT id, {R('yt')} AS y_true, {R('yp - yt')} AS residual, {R('sd')} AS sd FROM f""",

    "src2_assemble": f"""
SELECT vec_id AS id, len(embedding)::BIGINT AS width,
       {R('list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))')} AS x_sq FROM embeddings""",
})

ORACLE_SQL.update({
    "gp_inducing_choice": """
WITH v AS (SELECT DISTINCT l_quantity::DOUBLE AS x0, l_discount::DOUBLE AS x1, l_tax::DOUBLE AS x2 FROM lineitem),
o AS (SELECT *, row_number() OVER (ORDER BY md5('[' || x0 || ',' || x1 || ',' || x2 || ']|42')) - 1 AS place FROM v)
SELECT place::INTEGER AS place, x0, x1, x2 FROM o WHERE place < 128""",

    "src1_text_matrix": f"""
SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, len(embedding)::BIGINT AS width,
       {R('list_sum(list_transform(embedding, lambda v, i: v::DOUBLE * i))')} AS weighted FROM embeddings""",

    "pca_invariants": f"""WITH {DESIGN},
c AS (SELECT covar_samp(a.v, b.v) AS c, a.i AS i, b.i AS j FROM el a JOIN el b ON a.id = b.id GROUP BY a.i, b.i)
SELECT {R('sum(CASE WHEN i = j THEN c ELSE 0 END)')} AS total, {R('sum(c * c)')} AS squares FROM c""",

    "pca_score_norms": f"""WITH {DESIGN},
m AS (SELECT i, avg(v) AS m FROM el GROUP BY i)
SELECT el.id AS id, {R('sum((v - m) * (v - m))')} AS norm FROM el JOIN m ON el.i = m.i GROUP BY el.id""",

    "trend_part": """
SELECT round(regr_intercept(p_retailprice, p_size), 3) AS intercept,
       round(regr_slope(p_retailprice, p_size), 4) AS slope FROM part""",
})

ORACLE_SQL.update({
    "pca_wide_invariants": """
WITH w AS (SELECT j % 64 AS i, sum((1 + cos(j) / 2) * (1 + cos(j) / 2)) AS w FROM range(21600) t(j) GROUP BY 1),
v AS (SELECT i, var_samp(embedding[i + 1]::DOUBLE) AS v FROM embeddings, range(64) t(i) GROUP BY i)
SELECT (SELECT count(*) FROM embeddings) AS n, 21600::BIGINT AS d, 64::BIGINT AS k,
       round(sum(v * w), 4) AS explained_variance, round(sum(v * w), 4) AS score_variance
FROM v JOIN w USING (i)""",
})


def _matern(a: str, z: list[float]) -> str:
    """Matern-5/2 between the line item of alias a and a point, lengthscales 20, 0.1, 0.1."""
    r = "sqrt(5.0) * sqrt({})".format(" + ".join(
        f"pow(({a}.x{i} - {v}) / {ls}, 2)" for i, (v, ls) in enumerate(zip(z, (20.0, 0.1, 0.1)))))
    return f"(1 + {r} + pow({r}, 2) / 3) * exp(-{r})"


ORACLE_SQL.update({
    # K = kernel of the two points with 1e-6 on its diagonal, A = K + (s2 / sigma2) sum k k^T
    "gp_fixed_lineitem": f"""
WITH li AS (SELECT (l_orderkey * 8 + l_linenumber)::BIGINT AS id, l_quantity::DOUBLE AS x0, l_discount::DOUBLE AS x1,
                   l_tax::DOUBLE AS x2, l_extendedprice::DOUBLE AS y FROM lineitem),
pts AS (SELECT 10.0::DOUBLE AS x0, 0.05::DOUBLE AS x1, 0.04::DOUBLE AS x2),
k AS (SELECT id, y, {_matern("li", [10.0, 0.05, 0.04])} AS k1, {_matern("li", [40.0, 0.02, 0.06])} AS k2 FROM li),
m AS (SELECT avg(y) AS ybar FROM k),
s AS (SELECT sum(k1 * k1) AS s11, sum(k1 * k2) AS s12, sum(k2 * k2) AS s22, sum(k1 * (y - ybar)) AS b1,
             sum(k2 * (y - ybar)) AS b2, any_value(ybar) AS ybar FROM k, m),
c AS (SELECT *, 1.000001 AS g, {_matern("pts", [40.0, 0.02, 0.06])} AS c, 1e9 / 4e8 AS r FROM s, pts),
a AS (SELECT *, g + r * s11 AS a11, c + r * s12 AS a12, g + r * s22 AS a22 FROM c),
w AS (SELECT *, a11 * a22 - a12 * a12 AS det, g * g - c * c AS kdet FROM a)
SELECT id, round(ybar + r * (k1 * (a22 * b1 - a12 * b2) + k2 * (a11 * b2 - a12 * b1)) / det, 2) AS mean,
       round(sqrt(1e9 * (1 - (g * k1 * k1 - 2 * c * k1 * k2 + g * k2 * k2) / kdet
                           + (a22 * k1 * k1 - 2 * a12 * k1 * k2 + a11 * k2 * k2) / det) + 4e8), 2) AS sd
FROM k, w""",

    "jn2_align": f"""
WITH r AS (SELECT min(l_returnflag) AS model, avg(l_quantity * p_retailprice / 1000.0) AS mean,
                  avg(l_extendedprice / 1000.0) AS y
           FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, l_linenumber)
SELECT model, count(*) AS n, {R('avg(abs(mean - y))')} AS mae FROM r GROUP BY model""",
})

ORACLE_SQL.update({
    "vae_embeddings": f"""WITH {DESIGN},
h AS (SELECT el.id, u.i, greatest(sum(el.v * cos(1 + 3 * u.i + 5 * (el.i - 1)) / 8), 0) AS h
      FROM el, range(8) u(i) GROUP BY el.id, u.i),
l AS (SELECT id, k, sum(h * cos(2 + 3 * k + 5 * i) / sqrt(8)) AS mean, sum(h * cos(3 + 3 * k + 5 * i) / sqrt(8)) AS logvar
      FROM h, range(2) w(k) GROUP BY id, k),
z AS (SELECT *, mean + exp(logvar / 2) * {_normal("id, k, 42")} AS z FROM l),
g AS (SELECT id, i, greatest(sum(z * cos(4 + 3 * i + 5 * k) / sqrt(2)), 0) AS g FROM z, range(8) u(i) GROUP BY id, i),
x AS (SELECT id, sum(g * (SELECT sum(cos(5 + 3 * j + 5 * g.i)) FROM range(64) t(j)) / sqrt(8)) AS x FROM g GROUP BY id)
SELECT z.id, {R('max(CASE WHEN k = 0 THEN mean END)')} AS mean0, {R('max(CASE WHEN k = 1 THEN logvar END)')} AS logvar1,
       {R('max(CASE WHEN k = 0 THEN z END)')} AS z0, {R('max(CASE WHEN k = 1 THEN z END)')} AS z1,
       {R('max(x.x)')} AS x_hat_sum
FROM z JOIN x ON x.id = z.id GROUP BY z.id""",

    "src10_results": f"""WITH {PRED}
SELECT model, task::BIGINT AS task, count(*) AS n, {R('avg(mean)')} AS mean, {R('avg(y)')} AS y
FROM pi WHERE model IN ('A', 'R') GROUP BY model, task""",

    "job6_frontier": f"""
WITH c AS (SELECT o_orderpriority AS model, arg_max(o_totalprice / 1000.0, o_orderkey) AS rmse,
                  arg_max(o_custkey / 100.0, o_orderkey) + arg_max(o_orderkey % 97 / 1000.0, o_orderkey) AS time
           FROM orders GROUP BY 1),
f AS (SELECT *, min(rmse) OVER (ORDER BY time, rmse ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM c)
SELECT model, {R('time')} AS time, {R('rmse')} AS rmse, coalesce(rmse < best, TRUE) AS frontier FROM f""",
})
