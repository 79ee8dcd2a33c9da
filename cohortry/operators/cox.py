"""Cox regression for many training sets at once.

Rows carry (k, stratum, time, event, x); k names the training set (a fold or
model).  One Newton step for all k is one aggregation to (k, stratum, time)
sums, running sums from late to early times, and a sum per k; only gradients
and Hessians (p + p^2 numbers per k) reach the driver.  Ties follow Efron.
A step that lowers the likelihood of a k is halved for that k alone.
Covariates are standardised per k inside the fit (sample sd), risks are
centred at the training mean.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lineage import settle
from ..functions.tails import chi2_tail
from .ordered import join_null_safe, row_number, running_totals
from .prep import pca, project


class CoxFit:
    """Coefficients and centring constants per training set."""

    def __init__(self, names, keys, beta, mean, sd, variance, iterations):
        self.names, self.keys = list(names), list(keys)
        self.beta, self.mean, self.sd, self.variance = beta, mean, sd, variance
        self.iterations = iterations

    def linear(self, k: Column) -> Column:
        """(x - mean) . beta of training set ``k`` as a column expression."""
        out = None
        for i, key in enumerate(self.keys):
            total = None
            for name, b, m in zip(self.names, self.beta[i], self.mean[i]):
                term = (F.col(name) - F.lit(float(m))) * F.lit(float(b))
                total = term if total is None else total + term
            out = F.when(k == F.lit(key), total) if out is None else out.when(k == F.lit(key), total)
        return out

    def frame(self, spark) -> DataFrame:
        rows = [
            (k, n, float(b), float(m))
            for k, bs, ms in zip(self.keys, self.beta, self.mean)
            for n, b, m in zip(self.names, bs, ms)
        ]
        kind = "int" if isinstance(self.keys[0], int) else "string"
        return spark.createDataFrame(rows, f"k {kind}, covariate string, coefficient double, train_mean double")


def training_rows(df: DataFrame, folds: Sequence[int]) -> DataFrame:
    """(k, row) where the row is outside fold k."""
    spread = df.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in folds])))
    return spread.where(F.col("k") != F.col("fold"))


def _upper(p: int):
    return [(a, b) for a in range(p) for b in range(a, p)]


def fit(
    rows: DataFrame, covariates: Sequence[str], *, duration: str = "duration", event: str = "event",
    stratum: str | None = None, penalizer: float = 0.0, iterations: int = 25, tolerance: float = 1e-9,
    constants: bool = False,
) -> CoxFit:
    """Newton fit of every ``k`` in ``rows``; non-convergence is an error.

    ``penalizer`` is the ridge term of the mean log likelihood over standardised covariates.  With ``constants`` a
    covariate that is constant in a training set gets the coefficient 0 there; without, it is an error.
    """
    p = len(covariates)
    data = rows.select(
        "k", (F.col(stratum).cast("string") if stratum else F.lit("")).alias("_g"),
        F.col(duration).cast("double").alias("_t"), F.col(event).cast("int").alias("_e"), *covariates,
    )
    stats = data.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(covariates)],
        *[F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(covariates)],
    ).orderBy("k").collect()
    keys = [r["k"] for r in stats]
    n = np.array([r["n"] for r in stats], float)
    mean = np.array([[r[f"m{i}"] for i in range(p)] for r in stats])
    sd = np.array([[r[f"s{i}"] or 1.0 for i in range(p)] for r in stats])

    def pick(values: np.ndarray) -> Column:
        """Constant of the row's training set (number of sets is small)."""
        out = None
        for key, v in zip(keys, values):
            cond = F.col("k") == F.lit(key)
            out = F.when(cond, F.lit(float(v))) if out is None else out.when(cond, F.lit(float(v)))
        return out

    data = data.withColumns({
        f"z{i}": (F.col(c) - pick(mean[:, i])) / pick(sd[:, i]) for i, c in enumerate(covariates)
    }).select("k", "_g", "_t", "_e", *[f"z{i}" for i in range(p)]).persist()
    # unit information holds the coefficient of a constant at zero
    held = np.array([np.diag([float(constants and not r[f"s{i}"]) for i in range(p)]) for r in stats])
    ridge = n * penalizer
    search = _Search(keys, p)
    try:
        for step in range(1, MAX_HALVINGS * iterations):
            likelihood, gradient, hessian = _newton_sums(data, keys, search.trial, p, pick)
            likelihood = likelihood - ridge * (search.trial**2).sum(axis=1) / 2
            gradient = gradient - ridge[:, None] * search.trial
            hessian = hessian + ridge[:, None, None] * np.eye(p) + held
            search.judge(likelihood, gradient, hessian)
            if search.steps.max() > iterations:
                raise ValueError("Cox fit did not converge")
            if search.largest_move() < tolerance:
                break
        else:
            raise ValueError("Cox fit did not converge")
    finally:
        data.unpersist()
    beta, hessian = search.trial, search.hessian
    inverse = np.linalg.inv(hessian)
    variance = inverse / (sd[:, :, None] * sd[:, None, :])
    return CoxFit(covariates, keys, beta / sd, mean, sd, variance, step)


#: Halvings of one step before the fit counts as failed.
MAX_HALVINGS = 20


class _Search:
    """Newton search of every training set: last accepted point, its step, and the point to try next."""

    def __init__(self, keys: list, p: int):
        self.keys = keys
        self.point, self.move = np.zeros((len(keys), p)), np.zeros((len(keys), p))
        self.trial = np.zeros((len(keys), p))
        self.hessian = np.zeros((len(keys), p, p))
        self.likelihood = np.full(len(keys), -np.inf)
        self.halvings, self.steps = np.zeros(len(keys), int), np.zeros(len(keys), int)

    def judge(self, likelihood: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> None:
        """Accept each trial point that does not lower its likelihood, halve the step of the others."""
        for i, k in enumerate(self.keys):
            sums = np.r_[likelihood[i], gradient[i], hessian[i].ravel()]
            slack = 1e-10 * (1 + abs(self.likelihood[i])) if self.steps[i] else 0.0
            if np.isfinite(sums).all() and likelihood[i] >= self.likelihood[i] - slack:
                self.point[i], self.likelihood[i], self.hessian[i] = self.trial[i], likelihood[i], hessian[i]
                try:
                    self.move[i] = np.linalg.solve(hessian[i], gradient[i])
                except np.linalg.LinAlgError:
                    raise ValueError(f"Cox fit did not converge: singular information in training set {k}") from None
                if not np.isfinite(self.move[i]).all():
                    raise ValueError(f"non-finite Cox coefficients in training set {k}")
                self.halvings[i] = 0
                self.steps[i] += 1
            else:
                self.halvings[i] += 1
                if not self.steps[i] or self.halvings[i] > MAX_HALVINGS:
                    raise ValueError(f"Cox fit did not converge: no step of training set {k} raises its likelihood")
            self.trial[i] = self.point[i] + self.move[i] * 0.5 ** self.halvings[i]

    def largest_move(self) -> float:
        return np.inf if self.halvings.any() else float(np.abs(self.move).max(initial=0.0))


#: Events at one time up to which their terms are rows.
TIED_ROWS = 1024


def efron_sums(d: Column, risk: Column, tied: Column) -> dict[str, Column]:
    """Sums over l = 0 .. d-1 of log v, 1/v, s/v, 1/v^2, s/v^2 and s^2/v^2 with s = l/d and v = risk - s * tied, tied > 0.

    v = (tied / d) * (a - l) with a = d * risk / tied, so they are differences of the log gamma, digamma and trigamma
    functions, taken eight places on and by their asymptotic series there.
    """
    low = d * risk / tied - d + 1
    high = low + d
    y, z = low + 8, high + 8

    def tail(series: list[float], at: Column, power: int) -> Column:
        out = F.lit(0.0)
        for i, c in enumerate(series):
            out = out + F.lit(c) / F.pow(at, F.lit(power + 2.0 * i))
        return out

    psi = [-1 / 12, 1 / 120, -1 / 252, 1 / 240]
    digamma = F.log1p(d / y) - 0.5 / z + 0.5 / y + tail(psi, z, 2) - tail(psi, y, 2)
    tri = [1 / 6, -1 / 30, 1 / 42, -1 / 30]
    trigamma = d / (y * z) + 0.5 / (y * y) - 0.5 / (z * z) + tail(tri, y, 3) - tail(tri, z, 3)
    for i in range(8):
        digamma = digamma + 1 / (low + i) - 1 / (high + i)
        trigamma = trigamma + 1 / ((low + i) * (low + i)) - 1 / ((high + i) * (high + i))
    # the leading terms of log gamma are joined first, so that nothing large cancels
    log_gamma = (y - 0.5) * F.log1p(d / y) + d * F.log(z) - d + tail([1 / 12, -1 / 360, 1 / 1260], z, 1) \
        - tail([1 / 12, -1 / 360, 1 / 1260], y, 1)
    for i in range(8):
        log_gamma = log_gamma - F.log1p(d / (low + i))
    s0, t0 = d / tied * digamma, (d / tied) * (d / tied) * trigamma
    return {"_log": d * F.log(tied / d) + log_gamma, "_s0": s0, "_s1": (risk * s0 - d) / tied, "_t0": t0, "_t1": (risk * t0 - s0) / tied,
            "_t2": (risk * risk * t0 - 2 * risk * s0 + d) / (tied * tied)}


def _newton_sums(data: DataFrame, keys: list, beta: np.ndarray, p: int, pick):
    """Log likelihood, gradient and information of every training set at ``beta``."""
    zs = [F.col(f"z{i}") for i in range(p)]
    eta = None
    for i, z in enumerate(zs):
        term = z * pick(beta[:, i])
        eta = term if eta is None else eta + term
    base = data.withColumn("_w", F.exp(eta))
    w, e = F.col("_w"), F.col("_e")
    sums = {"s": w, **{f"s{i}": w * zs[i] for i in range(p)}, **{f"s{a}_{b}": w * zs[a] * zs[b] for a, b in _upper(p)}}
    steps = base.groupBy("k", "_g", "_t").agg(
        F.sum(e).alias("d"),
        *[F.sum(v).alias(name) for name, v in sums.items()],
        *[F.sum(F.when(e == 1, v).otherwise(0.0)).alias(f"e{name[1:]}") for name, v in sums.items()],
        *[F.sum(F.when(e == 1, zs[i]).otherwise(0.0)).alias(f"x{i}") for i in range(p)],
    )
    risk = running_totals(
        steps, ["k", "_g"], "_t", {f"r{name[1:]}": name for name in sums}, descending=True
    ).where("d > 0")
    x = [F.col(f"x{i}") for i in range(p)]
    r, e = (lambda *i, c=c: F.col(c + "_".join(map(str, i))) for c in "re")
    pairs = _upper(p)
    # Efron: the l-th of d tied events sees the risk set minus l/d of the tied sums
    few = risk.where(F.col("d") <= TIED_ROWS).withColumn("_l", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("d") - 1)))
    share = F.col("_l") / F.col("d")
    den = r() - share * e()
    first = {i: (r(i) - share * e(i)) / den for i in range(p)}
    second = {(a, b): (r(a, b) - share * e(a, b)) / den for a, b in pairs}
    shares = [x[i] * pick(beta[:, i]) for i in range(p)]
    of_events = reduce(lambda a, b: a + b, shares)
    few = few.select("k", (of_events / F.col("d") - F.log(den)).alias("ll"), *[(x[i] / F.col("d") - first[i]).alias(f"g{i}") for i in range(p)],
                     *[(second[a, b] - first[a] * first[b]).alias(f"h{a}_{b}") for a, b in pairs])
    # many events at one time: the same sums over l in closed form
    s0, s1, t0, t1, t2 = (F.col(c) for c in ("_s0", "_s1", "_t0", "_t1", "_t2"))
    many = risk.where(F.col("d") > TIED_ROWS).withColumns(efron_sums(F.col("d"), r(), e())).select(
        "k", (of_events - F.col("_log")).alias("ll"), *[(x[i] - (r(i) * s0 - e(i) * s1)).alias(f"g{i}") for i in range(p)],
        *[(r(a, b) * s0 - e(a, b) * s1 - (r(a) * r(b) * t0 - (r(a) * e(b) + r(b) * e(a)) * t1 + e(a) * e(b) * t2))
          .alias(f"h{a}_{b}") for a, b in pairs])
    names = ["ll", *(f"g{i}" for i in range(p)), *(f"h{a}_{b}" for a, b in pairs)]
    sums = few.unionByName(many).groupBy("k").agg(*[F.sum(c).alias(c) for c in names])
    found = {row["k"]: row for row in sums.collect()}
    if set(found) != set(keys):
        raise ValueError("Cox fit needs an event in every training set")
    likelihood = np.array([found[k]["ll"] for k in keys], float)
    gradient = np.array([[found[k][f"g{i}"] for i in range(p)] for k in keys], float)
    hessian = np.zeros((len(keys), p, p))
    for row, k in enumerate(keys):
        for a, b in _upper(p):
            hessian[row, a, b] = hessian[row, b, a] = found[k][f"h{a}_{b}"]
    return likelihood, gradient, hessian


def oof_risk(df: DataFrame, fitted: CoxFit, fold: str = "fold") -> DataFrame:
    """Log partial hazard of each test row under the fit that left its fold out."""
    return df.withColumn("risk", fitted.linear(F.col(fold)))


def pca_oof_risk(
    df: DataFrame, folds: Sequence[int], *, unit: str = "unit_id", components: int = 10, penalizer: float = 0.0
) -> DataFrame:
    """(unit, fold, duration, event, risk): the survival baseline over feature vectors.

    Per fold, on the rows outside it: scaling, at most ``components`` principal axes, Cox regression (ridge with
    ``penalizer``).  The risk of a test row is the log of its partial hazard, at least the log of the smallest normal
    number; without features it is 0.  All folds share one pass for the axes and one job per Newton step; training
    rows carry the scores of their fold's axes, not the features.  A component that a fold lacks (few rows, constant
    features) has score 0 there.  Rows without vector, duration or event raise an error.
    """
    rows = df.select(unit, "fold", F.col("duration").cast("double").alias("duration"), F.col("event").cast("int").alias("event"), "features")
    valid = F.col("features").isNotNull() & F.col("duration").isNotNull() & ~F.isnan("duration") & (F.col("duration") > 0) & F.col("event").isin(0, 1)
    shape = rows.agg(F.min(F.size("features")).alias("low"), F.max(F.size("features")).alias("high"),
                     F.count_if(~F.coalesce(valid, F.lit(False))).alias("bad")).first()
    if shape["bad"] or shape["low"] != shape["high"]:
        raise ValueError("survival rows need a positive duration, an event of 0 or 1 and vectors of one length")
    names = [unit, "fold", "duration", "event"]
    if not shape["high"]:
        return rows.select(*names, F.lit(0.0).alias("risk"))
    # an axis without variance carries only rounding noise
    axes = settle(pca(rows, folds, components).where("explained > 1e-12"))
    count = axes.agg(F.max("component")).first()[0]
    scores = [f"pc{i + 1}" for i in range(count)]

    def scored(frame: DataFrame, key: str) -> DataFrame:
        pcs = project(frame, axes, key, shape["high"])
        return pcs.select(*([key] if key != "fold" else []), *names, *[
            F.coalesce(F.get("pcs", F.lit(i)), F.lit(0.0)).alias(c) for i, c in enumerate(scores)])

    fitted = fit(settle(scored(training_rows(rows, folds), "k")), scores, penalizer=penalizer, constants=True)
    risk = oof_risk(scored(rows, "fold"), fitted)
    return risk.select(*names, F.greatest("risk", F.lit(math.log(np.finfo(float).tiny))).alias("risk"))


def baseline_hazard(
    rows: DataFrame, fitted: CoxFit, *, duration: str = "duration", event: str = "event", stratum: str | None = None
) -> DataFrame:
    """Breslow cumulative baseline hazard per (k, stratum, time)."""
    strata = (F.col(stratum).cast("string") if stratum else F.lit("")).alias("g")
    steps = rows.select("k", strata, F.col(duration).alias("time"), F.col(event).alias("e"), F.exp(fitted.linear(F.col("k"))).alias("w"))
    at = steps.groupBy("k", "g", "time").agg(F.sum("e").alias("d"), F.sum("w").alias("s"))
    risk = running_totals(at, ["k", "g"], "time", {"s0": "s"}, descending=True)
    jumps = risk.withColumn("_h", F.col("d") / F.col("s0"))
    return running_totals(jumps, ["k", "g"], "time", {"cumulative": "_h"}).select("k", "g", "time", "d", "cumulative")


def survival_at(
    df: DataFrame, fitted: CoxFit, hazard: DataFrame, horizons: Sequence[float], *, stratum: str | None = None
) -> DataFrame:
    """S(h | x) of each test row: exp(-H0(last step <= h) * exp(lp)), H0 of the row's own ``stratum``.

    A hazard with several strata needs the column that names them.
    """
    last = [F.max_by("cumulative", F.when(F.col("time") <= h, F.col("time"))).alias(f"_h{i}") for i, h in enumerate(horizons)]
    steps = hazard.groupBy(F.col("k").alias("fold"), F.col("g").alias("_g")).agg(*last)
    own = (F.col(stratum).cast("string") if stratum else F.lit("")).alias("_g")
    if not stratum and not hazard.where("g <> '' OR g IS NULL").isEmpty():
        raise ValueError("the hazard is stratified: name the stratum column")
    scored = join_null_safe(oof_risk(df, fitted).select("*", own), steps, ["fold", "_g"])
    return scored.withColumns({
        f"survival_{int(h)}": F.exp(-F.coalesce(F.col(f"_h{i}"), F.lit(0.0)) * F.exp("risk"))
        for i, h in enumerate(horizons)
    }).drop("_g", *[f"_h{i}" for i in range(len(horizons))])


def ph_test(
    rows: DataFrame, fitted: CoxFit, *, unit: str, duration: str = "duration", event: str = "event", stratum: str | None = None
) -> DataFrame:
    """Scaled Schoenfeld residuals against the rank of event time: statistic, p per covariate."""
    p = len(fitted.names)
    zs = [F.col(c) for c in fitted.names]
    g = (F.col(stratum).cast("string") if stratum else F.lit("")).alias("_g")
    base = settle(rows.select(
        "k", g, F.col(unit).alias("_u"), F.col(duration).cast("double").alias("_t"), F.col(event).alias("_e"),
        F.exp(fitted.linear(F.col("k"))).alias("_w"), *fitted.names,
    ))
    at = base.groupBy("k", "_g", "_t").agg(
        F.sum("_w").alias("s"), *[F.sum(F.col("_w") * z).alias(f"s{i}") for i, z in enumerate(zs)]
    )
    risk = running_totals(at, ["k", "_g"], "_t", {"r": "s", **{f"r{i}": f"s{i}" for i in range(p)}}, descending=True)
    events = base.where("_e = 1").join(risk.select("k", "_g", "_t", "r", *[f"r{i}" for i in range(p)]), ["k", "_g", "_t"])
    residuals = events.select("k", "_t", "_u", *[(z - F.col(f"r{i}") / F.col("r")).alias(f"q{i}") for i, z in enumerate(zs)])
    ranked = row_number(residuals, ["k"], "_t", ties=["_u"], out="g")
    # sums of g, g^2, q and g*q are enough for the statistic
    sums = ranked.groupBy("k").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("g").cast("double").alias("g1"),
        F.sum(F.col("g").cast("double") * F.col("g")).alias("g2"),
        *[F.sum(f"q{i}").alias(f"q{i}") for i in range(p)],
        *[F.sum(F.col("g") * F.col(f"q{i}")).alias(f"gq{i}") for i in range(p)],
    ).collect()
    out = []
    for row in sums:
        v = fitted.variance[fitted.keys.index(row["k"])]
        centred = np.array([row[f"gq{i}"] - row["g1"] / row["n"] * row[f"q{i}"] for i in range(p)])
        spread = row["g2"] - row["g1"] ** 2 / row["n"]
        scaled = row["n"] * centred @ v
        for i, name in enumerate(fitted.names):
            out.append((row["k"], name, float(scaled[i] ** 2 / (row["n"] * v[i, i] * spread))))
    kind = "int" if isinstance(fitted.keys[0], int) else "string"
    table = rows.sparkSession.createDataFrame(out, f"k {kind}, covariate string, statistic double")
    return table.withColumn("p_value", chi2_tail(F.col("statistic"), F.lit(1.0)))
