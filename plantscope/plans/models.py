"""Model, inference, diagnostics and governance queries over ``lineitem``, ``orders`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from plantscope.functions.special import normal_quantile_sql
from plantscope.operators import frames as fr
from plantscope.operators import governance as gv
from plantscope.operators import inference as inf
from plantscope.operators import models as md
from plantscope.operators import residuals as rs
from plantscope.operators import series_models as sm
from plantscope.operators.stats import attach_stats
from plantscope.plans.frames import FACTORIAL_SQL, FACTORS, factorial
from plantscope.plans.registry import Query, read, tidy

X = ["l_quantity", "l_discount"]
X3 = ["l_quantity", "l_discount", "l_tax"]
Y = "price"
KEY = ["l_orderkey", "l_linenumber", "l_partkey"]


def lines(spark, d):
    return read(spark, d, "lineitem").withColumn(Y, F.col("l_extendedprice") / 1000)


def linear(spark, d):
    df = lines(spark, d)
    return md.fit_linear(df, Y, X), df


OLS = """m AS (SELECT count(*) AS n, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(y) AS my, var_pop(l_quantity) AS s11, var_pop(l_discount) AS s22,
 covar_pop(l_quantity, l_discount) AS s12, covar_pop(l_quantity, y) AS s1y, covar_pop(l_discount, y) AS s2y, var_pop(y) AS syy FROM (SELECT *, l_extendedprice/1000 AS y FROM lineitem)),
o1 AS (SELECT *, (s22*s1y-s12*s2y)/(s11*s22-s12*s12) AS b1, (s11*s2y-s12*s1y)/(s11*s22-s12*s12) AS b2 FROM m),
o AS (SELECT *, my-b1*m1-b2*m2 AS b0, n*syy AS sst, n*(syy-b1*s1y-b2*s2y) AS sse FROM o1)"""
SC = f"{OLS}, sc AS (SELECT l.*, l_extendedprice/1000 AS actual, b0+b1*l_quantity+b2*l_discount AS predicted FROM lineitem l, o)"


def coefs(spark, d):
    model, df = linear(spark, d)
    return tidy(model.table(df))


def split(spark, d):
    s = md.random_split(lines(spark, d), KEY)
    return tidy(s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg(Y).alias("mean")))


def holdout(fit, inputs=X3):
    """Fit on the training rows, score the test rows."""

    def run(spark, d):
        s = md.random_split(lines(spark, d), KEY)
        model = fit(s.where(F.col("split") == "train"), Y, inputs)
        scored = md.score(model, s.where(F.col("split") == "test"))
        return tidy(md.regression_metrics(scored, Y, "predicted", n_inputs=len(inputs)))

    return run


def factorial_model(spark, d):
    fx = factorial(spark, d)
    return md.fit_factorial(fx, "y", FACTORS), fx


def factorial_coefs(spark, d):
    model, fx = factorial_model(spark, d)
    return tidy(model.table(fx))


def labelled(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "n_chars", "lang")
    t = docs.join(read(spark, d, "labels"), "doc_id")
    return t.withColumns({"log_chars": F.ln(F.col("n_chars") + 1), "is_en": (F.col("lang") == "en").cast("double"), "label": F.col("quality").cast("double")})


def logistic(spark, d):
    df = md.random_split(labelled(spark, d), ["doc_id"])
    model = md.fit_logistic(df.where(F.col("split") == "train"), "label", ["log_chars", "is_en"])
    return tidy(md.classification_report(model.transform(df.where(F.col("split") == "test")), "label"))


def life(spark, d):
    df = lines(spark, d).select(F.col("l_quantity").alias("life"), (F.col("l_returnflag") != "N").cast("int").alias("seen"), "l_discount", "l_tax")
    m = md.fit_life(df, "life", "seen", ["l_discount", "l_tax"])
    fit = df.agg(F.sum(m.loglik("life", "seen")).alias("loglik"), F.avg(m.median_life()).alias("mean_median_life"))
    return tidy(fit.withColumns({"shape": F.lit(m.shape), "aic": 2.0 * (2 + len(m.coefficients)) - 2 * F.col("loglik")}), 3)


def selected(spark, d):
    df = lines(spark, d)
    names = md.select_features(df, Y, [*X3, "l_linenumber"])
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "rank long, feature string")


def scored(spark, d):
    model, df = linear(spark, d)
    return md.score(model, df).withColumn("actual", F.col(Y))


def metrics(spark, d):
    return tidy(md.regression_metrics(scored(spark, d), "actual", "predicted", ["l_returnflag"], 2))


METRICS_SQL = f"""WITH {SC}, a AS (SELECT l_returnflag, count(*) AS n, avg((actual-predicted)**2) AS mse, avg(abs(actual-predicted)) AS mae, 1-sum((actual-predicted)**2)/(var_pop(actual)*count(*)) AS r2 FROM sc GROUP BY 1)
SELECT l_returnflag, n, round(mse,6)+0.0 AS mse, round(mae,6)+0.0 AS mae, round(sqrt(mse),6)+0.0 AS rmse, round(r2,6)+0.0 AS r2, round(1-(1-r2)*(n-1)/(n-3),6)+0.0 AS adj_r2 FROM a"""


def score_rows(spark, d):
    return tidy(scored(spark, d).groupBy("l_suppkey").agg(F.avg("predicted").alias("mean_predicted"), F.min("predicted").alias("lo"), F.max("predicted").alias("hi")))


def ranges(spark, d):
    return tidy(md.input_ranges(lines(spark, d), X3, ["l_returnflag"]))


RANGES_SQL = " UNION ALL ".join(
    f"""SELECT l_returnflag, '{c}' AS "column", min({c}) AS min, max({c}) AS max, round(avg({c}),6)+0.0 AS mean, round(stddev_samp({c}),6)+0.0 AS std FROM lineitem GROUP BY 1""" for c in X3
)


def effects(spark, d):
    model, df = linear(spark, d)
    return tidy(md.scaled_effects(model, df, X))


EFFECTS_SQL = f"""WITH {OLS}, s AS (SELECT 'l_quantity' AS "column", b1 AS c, sqrt(s11*n/(n-1)) AS sd FROM o UNION ALL SELECT 'l_discount', b2, sqrt(s22*n/(n-1)) FROM o)
SELECT "column", round(c,6)+0.0 AS coefficient, round(sd,6)+0.0 AS std, round(c*sd,6)+0.0 AS effect, CASE WHEN c*sd < 0 THEN 'negative' ELSE 'positive' END AS sign FROM s"""


# -- validation and inference ----------------------------------------------------------------


def folds(spark, d):
    df = lines(spark, d)
    return tidy(md.cross_validated(df, Y, fr.design_terms(X3, 2), KEY))


def loo(spark, d):
    model, fx = factorial_model(spark, d)
    return tidy(inf.leave_one_out(model, fx))


def residuals(spark, d):
    return rs.with_residual(scored(spark, d))


def order_scored(spark, d):
    """One-input fit on orders: a long series with a unique order."""
    o = read(spark, d, "orders").select("o_orderdate", "o_orderkey", (F.col("o_totalprice") / 1000).alias("actual"), (F.col("o_custkey") / 100).alias("x"))
    model = md.fit_linear(o, "actual", ["x"])
    return rs.with_residual(o.withColumn("predicted", model.prediction()))


OSC = """r AS (SELECT o_orderdate, o_orderkey, o_totalprice/1000 AS actual, o_custkey/100 AS x FROM orders), ab AS (SELECT regr_slope(actual,x) AS b, regr_intercept(actual,x) AS a FROM r),
e AS (SELECT r.*, a+b*x AS predicted, actual-(a+b*x) AS residual FROM r, ab)"""


def res_table(spark, d):
    return tidy(order_scored(spark, d).select("o_orderkey", "actual", "predicted", "residual"))


STATS_SQL = f"""WITH {OSC}, m AS (SELECT count(*) AS n, avg(residual) AS mean, stddev_samp(residual) AS std FROM e),
k AS (SELECT n, mean, std, (SELECT avg(((residual-mean)/std)**3) FROM e) AS sk, (SELECT avg(((residual-mean)/std)**4)-3 FROM e) AS ku FROM m)
SELECT n, round(mean,6)+0.0 AS mean, round(std,6)+0.0 AS std, round(sk,6)+0.0 AS skewness, round(ku,6)+0.0 AS excess_kurtosis, round(sk*sk+ku*ku,6)+0.0 AS normality_score,
 round(greatest(0,1-(sk*sk+ku*ku)/10),6)+0.0 AS normality_p, greatest(0,1-(sk*sk+ku*ku)/10) > 0.05 AS is_normal FROM k"""

HIST_SQL = f"""WITH {OSC}, q AS (SELECT count(*) AS n, min(residual) AS lo, max(residual) AS hi, quantile_cont(residual,0.75)-quantile_cont(residual,0.25) AS iqr FROM e),
b AS (SELECT *, least(greatest(ceil((hi-lo)/(2*iqr/n**(1/3))),5),10)::INT AS bins FROM q), h AS (SELECT least(floor((residual-lo)/((hi-lo)/bins)),bins-1)::BIGINT AS bin, count(*) AS c FROM e, b GROUP BY 1),
g AS (SELECT *, unnest(generate_series(0,bins-1)) AS bin FROM b)
SELECT g.bin, round(lo+g.bin*(hi-lo)/bins,6)+0.0 AS "left", round(lo+(g.bin+1)*(hi-lo)/bins,6)+0.0 AS "right", coalesce(c,0) AS count, bins::BIGINT AS bins FROM g LEFT JOIN h ON g.bin = h.bin"""


def qq(spark, d):
    return tidy(rs.qq_points(order_scored(spark, d), ["o_orderkey"]))


def _qq_sql():
    return f"""WITH {OSC}, k AS (SELECT o_orderkey, residual, row_number() OVER (ORDER BY residual, o_orderkey) AS rank, count(*) OVER () AS n FROM e), p AS (SELECT *, (rank-0.5)/n AS p FROM k)
SELECT o_orderkey, rank, round(residual,6)+0.0 AS sample, round({normal_quantile_sql('p')},6)+0.0 AS theoretical FROM p"""


def dw(spark, d):
    return tidy(rs.durbin_watson(order_scored(spark, d), ["o_orderdate", "o_orderkey"]))


def run_order(spark, d):
    df = order_scored(spark, d).withColumnRenamed("o_orderkey", "Run Order")
    col = rs.find_order_column(df)
    out = rs.ordered_residuals(df, col, ["o_orderdate"])
    return tidy(out.select("observation", F.col("order_basis"), "residual"))


def quarters(spark, d):
    return tidy(rs.variance_by_quarter(order_scored(spark, d), ["x", "o_orderkey"]), 5)


def correlations(spark, d):
    return tidy(rs.residual_correlations(order_scored(spark, d), ["x"]))


def anova_sums(spark, d):
    model, df = linear(spark, d)
    return tidy(inf.anova_overall(model, df).drop("p_value", "label"), 4)


def anova_p(spark, d):
    model, df = linear(spark, d)
    return tidy(inf.anova_overall(model, df).select("f_stat", "p_value", "label"), 4)


def coef_inference(spark, d):
    model, df = linear(spark, d)
    return tidy(inf.coefficient_table(model, df).select("term", "coefficient", "std_err", "t_stat"), 5)


def coef_p(spark, d):
    model, df = linear(spark, d)
    return tidy(inf.coefficient_table(model, df))


COEF_SQL = f"""WITH {OLS}, v AS (SELECT *, sse/(n-3)/n AS u, s11*s22-s12*s12 AS det FROM o), w AS (SELECT 'l_quantity' AS term, b1 AS c, sqrt(u*s22/det) AS se FROM v UNION ALL SELECT 'l_discount', b2, sqrt(u*s11/det) FROM v
 UNION ALL SELECT 'intercept', b0, sqrt(u*(1+(m1*m1*s22-2*m1*m2*s12+m2*m2*s11)/det)) FROM v)
SELECT term, round(c,5)+0.0 AS coefficient, round(se,5)+0.0 AS std_err, round(c/se,5)+0.0 AS t_stat FROM w"""


def lof(spark, d):
    model, df = linear(spark, d)
    return tidy(inf.lack_of_fit(df, Y, X, model.sse, model.n - model.p), 4)


LOF_SQL = f"""WITH {OLS}, c AS (SELECT var_pop(l_extendedprice/1000)*count(*) AS ss, count(*) AS k FROM lineitem GROUP BY l_quantity, l_discount),
p AS (SELECT sum(ss) AS pss, (sum(k)-count(*))::BIGINT AS pdf FROM c), z AS (SELECT pss, pdf, pss/pdf AS pms, (n-3-pdf)::BIGINT AS ldf, greatest(sse-pss,0) AS lss FROM p, o)
SELECT round(pss,4)+0.0 AS pure_ss, pdf AS pure_df, round(pms,4)+0.0 AS pure_ms, ldf AS lof_df, round(lss,4)+0.0 AS lof_ss, round(lss/ldf,4)+0.0 AS lof_ms, round(lss/ldf/pms,4)+0.0 AS f_stat FROM z"""


def main_ss(spark, d):
    return tidy(inf.main_effect_ss(factorial(spark, d), "y", FACTORS), 5)


MAIN_SQL = f"WITH {FACTORIAL_SQL} " + " UNION ALL ".join(
    f"""SELECT '{f}' AS factor, (count(*)-1)::BIGINT AS df, round(sum(k*(m-g)**2),5)+0.0 AS ss FROM (SELECT {f}, count(*) AS k, avg(y) AS m, (SELECT avg(y) FROM fx) AS g FROM fx GROUP BY 1)""" for f in FACTORS
)


def fact(fn, digits=5):
    def run(spark, d):
        model, fx = factorial_model(spark, d)
        return tidy(fn(model, fx), digits)

    return run


MARGIN_SQL = f"WITH {FACTORIAL_SQL} " + " UNION ALL ".join(f"SELECT '{f}' AS factor, {f} AS level, round(avg(y),5)+0.0 AS mean FROM fx GROUP BY 2" for f in FACTORS)
PAIRS = [("priority", "status"), ("priority", "quarter"), ("status", "quarter")]
LINES_SQL = f"WITH {FACTORIAL_SQL} " + " UNION ALL ".join(
    f"SELECT '{a}' AS left_factor, '{b}' AS right_factor, {a} AS left_level, {b} AS right_level, round(avg(y),5)+0.0 AS mean FROM fx GROUP BY 3,4" for a, b in PAIRS
)
CORNER_SQL = f"WITH {FACTORIAL_SQL} " + " UNION ALL ".join(
    f"""SELECT '{a}' AS left_factor, '{b}' AS right_factor, round(abs(sum(CASE WHEN ({a}=ha)=({b}=hb) THEN m ELSE -m END)),5)+0.0 AS strength FROM
 (SELECT {a}, {b}, avg(y) AS m FROM fx GROUP BY 1,2), (SELECT min({a}) AS la, max({a}) AS ha, min({b}) AS lb, max({b}) AS hb FROM fx) WHERE {a} IN (la,ha) AND {b} IN (lb,hb)""" for a, b in PAIRS
)


def interaction(spark, d):
    df = lines(spark, d)
    return tidy(inf.interaction_strength(md.fit_quadratic(df, Y, X3), df, X3))


def least_squares_sql(source, terms, target, prefix):
    """CTEs that clear the target and later terms of each term in turn; the last one holds what is left."""
    centred = ", ".join(f"{e} - avg({e}) OVER () AS e{i}" for i, e in enumerate([*terms, target]))
    steps, y = [f"{prefix}0 AS MATERIALIZED (SELECT {centred} FROM {source})"], len(terms)
    for k in range(len(terms) - 1):
        rest = range(k + 1, y + 1)
        parts = ", ".join(f"sum(e{j}*e{k})/sum(e{k}*e{k}) AS g{j}" for j in rest)
        left = ", ".join(f"e{j} - g{j}*e{k} AS e{j}" for j in rest)
        steps.append(f"{prefix}{k + 1} AS MATERIALIZED (SELECT {left} FROM {prefix}{k}, (SELECT {parts} FROM {prefix}{k}))")
    return ", ".join(steps), f"(SELECT sum(e{y - 1}*e{y})/sum(e{y - 1}*e{y - 1}) FROM {prefix}{y - 1})"


def _interaction_sql():
    pairs = [(a, b) for i, a in enumerate(X3) for b in X3[i + 1 :]]
    ctes, out = [], []
    for i, (a, b) in enumerate(pairs):
        own = [*X3, *[f"{c}*{c}" for c in X3], *[f"{p}*{q}" for p, q in pairs if (p, q) != (a, b)], f"{a}*{b}"]
        cte, coef = least_squares_sql("lineitem", own, "l_extendedprice/1000", f"s{i}_")
        ctes.append(cte)
        out.append(f"""SELECT '{a}' AS "left", '{b}' AS "right", (SELECT avg(abs({a}-ma)*abs({b}-mb)) FROM lineitem, (SELECT avg({a}) AS ma, avg({b}) AS mb FROM lineitem)) * abs({coef}) AS s""")
    return f"""WITH {", ".join(ctes)} SELECT "left", "right", round(s,6)+0.0 AS strength, s >= 0.01 AS significant FROM ({" UNION ALL ".join(out)})"""


INTERACTION_SQL = _interaction_sql()


def sensitivity(spark, d):
    df = lines(spark, d)
    model = md.fit_quadratic(df, Y, X)
    return tidy(inf.permutation_sensitivity(lambda t: md.score(model, t), df, Y, X, KEY))


def effect_size(spark, d):
    model, df = linear(spark, d)
    return tidy(inf.effect_sizes(model, df, X))


def contributions(spark, d):
    model, df = linear(spark, d)
    rows = inf.linear_contributions(model, df, X, ["l_orderkey"])
    return tidy(inf.contribution_ranking(rows, X))


CONTRIB_SQL = f"""WITH {OLS} SELECT 'l_quantity' AS input, (SELECT round(avg(abs(b1*(l_quantity-m1))),6)+0.0 FROM lineitem, o) AS mean_abs_contribution
UNION ALL SELECT 'l_discount', (SELECT round(avg(abs(b2*(l_discount-m2))),6)+0.0 FROM lineitem, o)"""


def extrapolation(spark, d):
    li = read(spark, d, "lineitem")
    points = li.select(*KEY, (F.col("l_quantity") * 1.2 - 5).alias("l_quantity"), (F.col("l_discount") + 0.02).alias("l_discount"))
    return tidy(inf.extrapolation_risk(li, points, X).groupBy("is_extrapolation").agg(F.count(F.lit(1)).alias("n"), F.avg("max_risk").alias("mean_risk"), F.max("max_risk").alias("worst")))


EXTRA_SQL = """WITH r AS (SELECT min(l_quantity) AS a1, max(l_quantity) AS z1, min(l_discount) AS a2, max(l_discount) AS z2 FROM lineitem), p AS (SELECT l_quantity*1.2-5 AS q, l_discount+0.02 AS c FROM lineitem),
k AS (SELECT greatest(CASE WHEN q<a1 THEN (a1-q)/(z1-a1) WHEN q>z1 THEN (q-z1)/(z1-a1) ELSE 0 END, CASE WHEN c<a2 THEN (a2-c)/(z2-a2) WHEN c>z2 THEN (c-z2)/(z2-a2) ELSE 0 END) AS m FROM p, r)
SELECT m > 0 AS is_extrapolation, count(*) AS n, round(avg(m),6)+0.0 AS mean_risk, round(max(m),6)+0.0 AS worst FROM k GROUP BY 1"""


def comparison(spark, d):
    df = lines(spark, d)
    scores, normal = {}, {}
    for name, degree in (("linear", 1), ("quadratic", 2)):
        terms = fr.design_terms(X, degree)
        scores[name] = md.cross_validated(df, Y, terms, KEY)
        model = md.fit_least_squares(df, Y, terms)
        normal[name] = rs.residual_stats(rs.with_residual(md.score(model, df), Y))
    return tidy(inf.compare_models(scores, normal, df))


def forest_folds(spark, d):
    df = lines(spark, d)
    fit = lambda train: (lambda t, m=md.fit_forest(train, Y, X): md.score(m, t))
    return tidy(inf.model_folds(df, fit, Y, KEY))


def applicability(spark, d):
    df = lines(spark, d).withColumns({"one": F.lit(1.0), "twice": F.col("l_quantity") * 2 + F.col("l_tax"), "rare": (F.col("l_quantity") > 48).cast("int")})
    return tidy(gv.applicability(df, ["l_quantity", "l_discount", "twice", "one"], "rare").select("warning", "column"))


APPL_SQL = """SELECT 'class_imbalance' AS warning, 'rare' AS "column" FROM lineitem HAVING count(*) FILTER (l_quantity<=48)/count(*) FILTER (l_quantity>48) > 4
UNION ALL SELECT 'constant_input', 'one' UNION ALL SELECT 'collinear', 'l_quantity' FROM lineitem HAVING 1/(1-corr(l_quantity,l_quantity*2+l_tax)**2) > 10
UNION ALL SELECT 'collinear', 'twice' FROM lineitem HAVING 1/(1-corr(l_quantity,l_quantity*2+l_tax)**2) > 10"""


def discrepancy(spark, d):
    df = lines(spark, d)
    a, b = md.fit_linear(df, Y, ["l_quantity"]), md.fit_linear(df, Y, X)
    t = df.withColumns({"a": a.prediction(), "b": b.prediction()})
    return tidy(gv.discrepancy(t, "a", "b", 10.0, 0.001, 0.01))


DISC_SQL = f"""WITH {OLS}, one AS (SELECT regr_slope(l_extendedprice/1000,l_quantity) AS s, regr_intercept(l_extendedprice/1000,l_quantity) AS i FROM lineitem),
k AS (SELECT abs((i+s*l_quantity)-(b0+b1*l_quantity+b2*l_discount))/10 AS x FROM lineitem, one, o)
SELECT round(max(x),6)+0.0 AS max_difference, round(avg(x),6)+0.0 AS mean_difference, (max(x) > 0.01 OR avg(x) > 0.001) AS needs_review FROM k"""


def recommend(spark, d):
    s = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_samples"), F.count_distinct("l_returnflag").alias("n_features"))
    t = s.withColumns({"is_binary": F.col("l_suppkey") % 7 == 0, "nonlinear": F.col("l_suppkey") % 2 == 0, "interpretable": F.col("l_suppkey") % 3 == 0, "n_samples": F.floor(F.col("n_samples") / (F.col("l_suppkey") % 20 + 1))})
    return tidy(gv.recommend_models(t).select("l_suppkey", "recommended"))


REC_SQL = """WITH s AS (SELECT l_suppkey AS k, floor(count(*)/(l_suppkey%20+1)) AS n, count(DISTINCT l_returnflag) AS f FROM lineitem GROUP BY 1), t AS (SELECT *, k%7=0 AS b, k%2=0 AS c, k%3=0 AS p FROM s)
SELECT k AS l_suppkey, concat_ws(',', CASE WHEN b THEN 'logistic_regression' END, CASE WHEN NOT b AND n<50 THEN 'linear' END, CASE WHEN NOT b AND n<50 AND f>=2 THEN 'quadratic' END,
 CASE WHEN NOT b AND n>=50 AND n<200 THEN 'quadratic' END, CASE WHEN NOT b AND n>=50 AND n<200 AND c THEN 'residual_hybrid' END, CASE WHEN NOT b AND n>=200 AND p THEN 'linear' END,
 CASE WHEN NOT b AND n>=200 AND p THEN 'residual_hybrid' END, CASE WHEN NOT b AND n>=200 AND NOT p THEN 'boosted_trees' END, CASE WHEN NOT b AND n>=100 AND NOT p THEN 'random_forest' END) AS recommended FROM t"""


def interval(spark, d):
    model, df = linear(spark, d)
    t = gv.prediction_interval(md.score(model, df), (model.sse / model.n) ** 0.5, model.n)
    inside = ((F.col(Y) >= F.col("lower")) & (F.col(Y) <= F.col("upper"))).cast("double")
    return tidy(t.groupBy("l_returnflag").agg(F.avg(inside).alias("covered"), F.max("half_width").alias("half_width")), 4)


def experiments(spark, d):
    """One experiment per order: predicted by the priority's mean, actual its own price."""
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("model_id"), (F.col("o_totalprice") / 1000).alias("actual"))
    m = o.groupBy("model_id").agg(F.avg("actual").alias("predicted"), F.stddev_pop("actual").alias("rmse"))
    e = attach_stats(o, m, ["model_id"])
    k = F.col("o_orderkey") % 4
    return e.withColumns(
        {"tolerance": F.when(k == 0, 100.0), "spec_range": F.when(k == 1, 150.0), "rmse": F.when(k < 3, F.col("rmse")),
         "result": F.when(F.abs(F.col("actual") - F.col("predicted")) < 120, "pass").otherwise("fail")}
    )


EXP = """x AS (SELECT o_orderkey, o_orderpriority AS model_id, o_totalprice/1000 AS actual, o_orderkey%4 AS k FROM orders), xm AS (SELECT model_id, avg(actual) AS predicted, stddev_pop(actual) AS rm FROM x GROUP BY 1),
ex AS (SELECT o_orderkey, model_id, actual, predicted, CASE WHEN k=0 THEN 100.0::DOUBLE END AS tolerance, CASE WHEN k=1 THEN 150.0 END AS spec, CASE WHEN k<3 THEN rm END AS rm FROM x JOIN xm USING (model_id)),
ey AS (SELECT *, coalesce(tolerance, least(spec*0.5, 2*rm)) AS lim FROM ex)"""


def verdicts(spark, d):
    v = gv.experiment_verdict(experiments(spark, d))
    return tidy(v.groupBy("model_id", "verdict").agg(F.count(F.lit(1)).alias("n"), F.avg("used_tolerance").alias("mean_tolerance")), 5)


VERDICT_SQL = f"""WITH {EXP}, z AS (SELECT model_id, lim, CASE WHEN lim IS NULL THEN 'insufficient_data' WHEN abs(actual-predicted)/lim<=0.5 THEN 'supports' WHEN abs(actual-predicted)/lim<=1 THEN 'partially_supports'
 WHEN abs(actual-predicted)/lim<=2 THEN 'does_not_support' ELSE 'needs_remodel' END AS verdict FROM ey) SELECT model_id, verdict, count(*) AS n, round(avg(lim),5)+0.0 AS mean_tolerance FROM z GROUP BY 1,2"""


def class_verdicts(spark, d):
    s = read(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.avg((F.col("l_quantity") > 9).cast("double")).alias("accuracy"), F.avg((F.col("l_discount") > 0.005).cast("double")).alias("recall")
    )
    s = s.withColumn("recall", F.when(F.col("l_suppkey") % 10 != 0, F.col("recall")))
    return tidy(gv.classification_verdict(s))


CLASS_SQL = """WITH s AS (SELECT l_suppkey, avg((l_quantity>9)::INT) AS accuracy, CASE WHEN l_suppkey%10<>0 THEN avg((l_discount>0.005)::INT) END AS recall FROM lineitem GROUP BY 1)
SELECT l_suppkey, round(accuracy,6)+0.0 AS accuracy, round(recall,6)+0.0 AS recall, CASE WHEN recall IS NULL THEN 'insufficient_data' WHEN accuracy>=0.8 AND recall>=0.9 THEN 'supports'
 WHEN accuracy>=0.8 OR recall>=0.9 THEN 'partially_supports' WHEN recall<0.45 THEN 'needs_remodel' ELSE 'does_not_support' END AS verdict FROM s"""


def evidence(spark, d):
    return tidy(gv.confirmation_evidence(experiments(spark, d), ["model_id"]), 5)


def next_experiments(spark, d):
    df = lines(spark, d)
    model = md.fit_quadratic(df, Y, X)
    res = rs.with_residual(md.score(model, df), Y)
    strengths = inf.interaction_strength(model, df, X)
    stats = rs.residual_stats(res)
    quarter = rs.variance_by_quarter(res, ["l_quantity", *KEY])
    return tidy(gv.recommend_experiments(strengths, stats, quarter, md.input_ranges(df, X), X[0], Y), 3)


def candidates(spark, d):
    return tidy(gv.next_run_candidates(lines(spark, d), X))


CAND_SQL = """WITH s AS (SELECT min(l_quantity) AS a1, max(l_quantity) AS z1, avg(l_quantity) AS m1, min(l_discount) AS a2, max(l_discount) AS z2, avg(l_discount) AS m2 FROM lineitem), c AS (
SELECT 'low_boundary' AS reason, 'l_quantity' AS varied, a1 AS q, m2 AS c FROM s UNION ALL SELECT 'high_boundary','l_quantity',z1,m2 FROM s UNION ALL SELECT 'low_boundary','l_discount',m1,a2 FROM s
UNION ALL SELECT 'high_boundary','l_discount',m1,z2 FROM s UNION ALL SELECT 'center_point',NULL,(a1+z1)/2,(a2+z2)/2 FROM s)
SELECT reason, varied, round(q,6)+0.0 AS l_quantity, round(c,6)+0.0 AS l_discount FROM c"""


def spread(spark, d):
    df = lines(spark, d)
    model = md.fit_forest(df, Y, X)
    return tidy(gv.forest_spread(model, gv.next_run_candidates(df, X)))


def tree_grid(spark, d):
    """The grid of a boosted model a segment."""
    df = lines(spark, d)
    models = sm.fit_boosted_trees(df, Y, X, ["l_returnflag"], rounds=30)
    return tidy(gv.response_grid(models, df, "l_quantity", "l_discount", X, 11, ["l_returnflag"]), 5)


def tree_profile(spark, d):
    """The profile of a forest of all rows, and its best setting, per segment."""
    df = lines(spark, d)
    model = md.fit_forest(df, Y, X)
    return tidy(gv.best_setting(gv.one_at_a_time(model, df, X, ["l_returnflag"]), "maximize", by=["l_returnflag"]), 5)


def tree_interaction(spark, d):
    df = lines(spark, d)
    return tidy(inf.interaction_strength(sm.fit_boosted_trees(df, Y, X3, ["l_returnflag"], rounds=30), df, X3))


def grid(spark, d):
    model, df = linear(spark, d)
    return tidy(gv.response_grid(model, df, "l_quantity", "l_discount", X, 11, ["l_returnflag"]), 5)


GRID_SQL = f"""WITH {OLS}, r AS (SELECT l_returnflag, min(l_quantity) AS a1, max(l_quantity) AS z1, min(l_discount) AS a2, max(l_discount) AS z2 FROM lineitem GROUP BY 1),
g AS (SELECT l_returnflag, a1+i*(z1-a1)/10 AS q, a2+j*(z2-a2)/10 AS c FROM r, (SELECT unnest(generate_series(0,10)) AS i), (SELECT unnest(generate_series(0,10)) AS j))
SELECT l_returnflag, round(q,5)+0.0 AS l_quantity, round(c,5)+0.0 AS l_discount, round(b0+b1*q+b2*c,5)+0.0 AS predicted FROM g, o"""


def profile(spark, d):
    model, df = linear(spark, d)
    return tidy(gv.one_at_a_time(model, df, X, ["l_returnflag"]), 5)


PROFILE = f"""{OLS}, q AS (SELECT l_returnflag, min(l_quantity) AS a1, median(l_quantity) AS d1, max(l_quantity) AS z1, min(l_discount) AS a2, median(l_discount) AS d2, max(l_discount) AS z2 FROM lineitem GROUP BY 1),
pr AS (SELECT l_returnflag, input, setting, value, CASE WHEN input='l_quantity' THEN b0+b1*value+b2*d2 ELSE b0+b1*d1+b2*value END AS predicted FROM o, (
 SELECT *, 'l_quantity' AS input, unnest(['low','mid','high']) AS setting, unnest([a1,(a1+z1)/2,z1]) AS value FROM q UNION ALL SELECT *, 'l_discount', unnest(['low','mid','high']), unnest([a2,(a2+z2)/2,z2]) FROM q))"""


def best(objective, target=None):
    def run(spark, d):
        model, df = linear(spark, d)
        return tidy(gv.best_setting(gv.one_at_a_time(model, df, X, ["l_returnflag"]), objective, target, ["l_returnflag"]), 5)

    return run


def best_sql(cost):
    return f"""WITH {PROFILE}, k AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY {cost}, input, setting) AS r FROM pr)
SELECT l_returnflag, input, setting, round(value,5)+0.0 AS value, round(predicted,5)+0.0 AS predicted FROM k WHERE r = 1"""


def credibility(spark, d):
    model, df = linear(spark, d)
    return tidy(gv.credibility(model, df, X, "validated"))


CRED_SQL = f"""WITH {SC}, q AS (SELECT quantile_cont(l_quantity,0.05) AS a, quantile_cont(l_quantity,0.95) AS z, avg(l_quantity) AS m FROM lineitem UNION ALL SELECT quantile_cont(l_discount,0.05), quantile_cont(l_discount,0.95), avg(l_discount) FROM lineitem),
c AS (SELECT avg(least(greatest(abs(m-a),abs(z-m),1e-9)/((z-a)/2+1e-9),1)) AS dc FROM q), f AS (SELECT greatest(0,1-least(sqrt(avg((actual-predicted)**2))/stddev_samp(actual),1)) AS pa, greatest(0,least(1,1-avg((actual-predicted)**2)/var_pop(actual))) AS st FROM sc),
t AS (SELECT dc, pa, st, CASE WHEN b1+b2 > 0 THEN 1.0 ELSE 0.5 END AS en, 0.15*dc+0.25*pa+0.20*st+0.10*(CASE WHEN b1+b2 > 0 THEN 1.0 ELSE 0.5 END)+0.15*0.7+0.15*0.8 AS co FROM c, f, o)
SELECT round(dc,6)+0.0 AS data_coverage, round(pa,6)+0.0 AS predictive_accuracy, round(st,6)+0.0 AS stability, en::DOUBLE AS engineering, 0.7::DOUBLE AS validation, 0.8::DOUBLE AS extrapolation, round(co,6)+0.0 AS composite,
 CASE WHEN co>=0.8 THEN 'production_ready' WHEN co>=0.6 THEN 'engineering_reference' WHEN co>=0.4 THEN 'exploratory' WHEN co>=0.2 THEN 'needs_more_data' ELSE 'not_recommended' END AS level FROM t"""


def res_query(fn, digits=6):
    return lambda spark, d: tidy(fn(order_scored(spark, d)), digits)


QUERIES = [
    Query("model_random_split", split),
    Query("model_linear_coefficients", coefs, f"WITH {OLS} SELECT 'intercept' AS term, round(b0,6)+0.0 AS coefficient FROM o UNION ALL SELECT 'l_quantity', round(b1,6)+0.0 FROM o UNION ALL SELECT 'l_discount', round(b2,6)+0.0 FROM o"),
    Query("model_linear_holdout", holdout(md.fit_linear)),
    Query("model_quadratic_holdout", holdout(md.fit_quadratic)),
    Query("model_factorial_coefficients", factorial_coefs),
    Query("model_forest_holdout", holdout(md.fit_forest)),
    Query("model_boosted_holdout", holdout(md.fit_boosted)),
    Query("model_hybrid_holdout", holdout(md.fit_hybrid)),
    Query("model_logistic_report", logistic),
    Query("model_weibull_life", life),
    Query("model_selected_features", selected),
    Query("model_regression_metrics", metrics, METRICS_SQL),
    Query("model_batch_scoring", score_rows, f"WITH {SC} SELECT l_suppkey, round(avg(predicted),6)+0.0 AS mean_predicted, round(min(predicted),6)+0.0 AS lo, round(max(predicted),6)+0.0 AS hi FROM sc GROUP BY 1"),
    Query("model_input_ranges", ranges, RANGES_SQL),
    Query("model_scaled_effects", effects, EFFECTS_SQL),
    Query("validation_folds", folds),
    Query("validation_forest_folds", forest_folds),
    Query("validation_leave_one_out", loo),
    Query("residual_table", res_table, f"WITH {OSC} SELECT o_orderkey, round(actual,6)+0.0 AS actual, round(predicted,6)+0.0 AS predicted, round(residual,6)+0.0 AS residual FROM e"),
    Query("residual_stats", res_query(rs.residual_stats), STATS_SQL),
    Query("residual_histogram", res_query(rs.residual_histogram), HIST_SQL),
    Query("residual_qq_points", qq, _qq_sql()),
    Query("residual_durbin_watson", dw, f"""WITH {OSC}, s AS (SELECT residual, residual - lag(residual) OVER (ORDER BY o_orderdate, o_orderkey) AS dr FROM e), k AS (SELECT count(*) AS n, sum(dr*dr)/sum(residual*residual) AS w FROM s)
SELECT n, round(w,6)+0.0 AS durbin_watson, CASE WHEN w<1.5 THEN 'positive' WHEN w>2.5 THEN 'negative' ELSE 'none' END AS reading FROM k"""),
    Query("residual_outliers", lambda s, d: tidy(rs.residual_outliers(residuals(s, d), threshold=1.5).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.max("z").alias("worst"))), f"""WITH {SC}, e AS (SELECT l_returnflag, actual-predicted AS r FROM sc), ms AS (SELECT avg(r) AS m, stddev_samp(r) AS s FROM e)
SELECT l_returnflag, count(*) AS n, round(max((r-m)/s),6)+0.0 AS worst FROM e, ms WHERE abs((r-m)/s) >= 1.5 GROUP BY 1"""),
    Query("residual_run_order", run_order, f"WITH {OSC} SELECT o_orderkey::DOUBLE AS observation, 'Run Order' AS order_basis, round(residual,6)+0.0 AS residual FROM e"),
    Query("residual_quarter_variance", quarters, f"""WITH {OSC}, k AS (SELECT residual, row_number() OVER (ORDER BY x, o_orderkey) AS rn, floor(count(*) OVER ()/4) AS sz FROM e), v AS (SELECT floor((rn-1)/sz) AS q, var_pop(residual) AS v, count(*) AS c FROM k WHERE floor((rn-1)/sz) < 4 GROUP BY 1)
SELECT sum(c)::BIGINT AS n, round(min(v),5)+0.0 AS min_variance, round(max(v),5)+0.0 AS max_variance, max(v) > 3*min(v) AS heteroscedastic FROM v"""),
    Query("residual_correlations", correlations, f"WITH {OSC} SELECT 'x' AS against, round(corr(x,residual),6)+0.0 AS correlation FROM e UNION ALL SELECT 'prediction_and_size', round(corr(predicted,abs(residual)),6)+0.0 FROM e"),
    Query("anova_sums", anova_sums, f"""WITH {OLS} SELECT round(sst-sse,4)+0.0 AS ss_reg, round(sse,4)+0.0 AS ss_res, round(sst,4)+0.0 AS ss_tot, 2::BIGINT AS df_reg, n-3 AS df_res, round((sst-sse)/2/(sse/(n-3)),4)+0.0 AS f_stat,
 round(1-sse/sst,4)+0.0 AS r2, round(1-(sse/sst)*(n-1)/(n-3),4)+0.0 AS adj_r2 FROM o"""),
    Query("anova_significance", anova_p),
    Query("anova_coefficients", coef_inference, COEF_SQL),
    Query("anova_coefficient_intervals", coef_p),
    Query("anova_lack_of_fit", lof, LOF_SQL),
    Query("anova_main_effects", main_ss, MAIN_SQL),
    Query("anova_factorial_rows", fact(lambda m, fx: inf.factorial_anova(m, fx, "y"))),
    Query("anova_pareto_terms", fact(lambda m, fx: inf.pareto_terms(m, fx, "y"))),
    Query("anova_marginal_means", fact(inf.marginal_means), MARGIN_SQL),
    Query("anova_interaction_lines", fact(inf.interaction_lines), LINES_SQL),
    Query("anova_fit_level", lambda s, d: tidy(inf.fit_quality(*linear(s, d)))),
    Query("interaction_corner_contrasts", fact(inf.corner_contrasts), CORNER_SQL),
    Query("interaction_strength", interaction, INTERACTION_SQL),
    Query("interaction_strength_trees", tree_interaction),
    Query("sensitivity_permutation", sensitivity),
    Query("sensitivity_effect_size", effect_size, f"""WITH {OLS} SELECT 'l_quantity' AS input, round(abs(b1*sqrt(s11)/sqrt(syy)),6)+0.0 AS effect_size FROM o UNION ALL SELECT 'l_discount', round(abs(b2*sqrt(s22)/sqrt(syy)),6)+0.0 FROM o"""),
    Query("contribution_linear", contributions, CONTRIB_SQL),
    Query("contribution_factors", fact(inf.factor_contributions)),
    Query("extrapolation_risk", extrapolation, EXTRA_SQL),
    Query("governance_credibility", credibility, CRED_SQL),
    Query("governance_model_comparison", comparison),
    Query("governance_applicability", applicability, APPL_SQL),
    Query("governance_vif", lambda s, d: tidy(gv.vif_pair(lines(s, d), "l_quantity", "l_extendedprice")), "SELECT round(1/(1-corr(l_quantity,l_extendedprice)**2),6)+0.0 AS vif FROM lineitem"),
    Query("governance_discrepancy", discrepancy, DISC_SQL),
    Query("governance_model_recommendation", recommend, REC_SQL),
    Query("governance_prediction_interval", interval),
    Query("governance_experiment_verdicts", verdicts, VERDICT_SQL),
    Query("governance_classification_verdicts", class_verdicts, CLASS_SQL),
    Query("governance_confirmation_evidence", evidence, f"""WITH {EXP} SELECT model_id, count(*) AS n, count(*) FILTER (abs(actual-predicted)<120) AS n_pass, round(avg(abs(actual-predicted)),5)+0.0 AS mean_abs_error,
 round(count(*) FILTER (abs(actual-predicted)<120)/count(*),5)+0.0 AS pass_rate FROM ey GROUP BY 1"""),
    Query("governance_next_experiments", next_experiments),
    Query("governance_next_run_candidates", candidates, CAND_SQL),
    Query("governance_forest_spread", spread),
    Query("governance_response_grid", grid, GRID_SQL),
    Query("governance_response_grid_trees", tree_grid),
    Query("governance_best_setting_forest", tree_profile),
    Query("governance_one_at_a_time", profile, f"WITH {PROFILE} SELECT l_returnflag, input, setting, round(value,5)+0.0 AS value, round(predicted,5)+0.0 AS predicted FROM pr"),
    Query("governance_best_setting_maximize", best("maximize"), best_sql("-predicted")),
    Query("governance_best_setting_minimize", best("minimize"), best_sql("predicted")),
    Query("governance_best_setting_target", best("target", 40.0), best_sql("abs(predicted-40.0)")),
]
