"""Known values and invariants of the other operator families."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortry.functions import formulas as fm
from cohortry.operators import (
    contracts as ct, cox as cx, disagreement as dg, features as ft, folds as fo, metrics_class as mc,
    prep as pp, resample as rb, textjson as tj,
)
from cohortry.operators.metrics_surv import ipcw_calibration
from cohortry.sources import sinks as sk


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_contracts(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("b", 2, 0)], "g string, fold int, outcome int")
    assert values(ct.unique_key(df, ["g"]), "key") == ["a"]
    assert values(ct.constant_within_group(df, ["g"], ["fold", "outcome"]), "detail") == ["outcome"]
    other = spark.createDataFrame([("b",), ("c",)], "g string")
    assert sorted(values(ct.id_set_equal(df, other, ["g"]), "detail")) == ["extra", "missing"]
    with pytest.raises(ct.ContractError):
        ct.enforce(ct.unique_key(df, ["g"]))
    leak = spark.createDataFrame([("x", 1), ("y", 1), ("x", 2), ("z", 2)], "group_id string, fold int")
    assert values(ct.group_leakage(leak), "key") == ["x"]
    nulls = spark.createDataFrame([("a", None), ("a", 1)], "g string, v int")
    assert ct.constant_within_group(nulls, ["g"], ["v"]).count() == 1


def test_group_folds(spark):
    rows = [(f"g{i}", i % 2) for i in range(20) for _ in range(2)]
    df = spark.createDataFrame(rows, "group_id string, outcome int")
    out = fo.stratified_group_folds(df).toPandas()
    assert out.group_id.is_unique and set(out.fold) == {1, 2, 3, 4, 5}
    joined = df.join(spark.createDataFrame(out), "group_id")
    assert ct.class_support(joined.select("group_id", "outcome", "fold"), []).count() == 0


def test_patient_folds_have_both_classes(spark):
    rows = [(f"p{i}", int(i < 5)) for i in range(25) for _ in range(2)]
    df = spark.createDataFrame(rows, "group_id string, outcome int")
    folded = df.join(fo.stratified_patient_folds(df), "group_id")
    assert ct.class_support(folded, []).count() == 0 and ct.group_leakage(folded).count() == 0


def test_names(spark):
    df = spark.createDataFrame([("Pre_P1",), ("Post_P1",), ("Post_P1_2",)], "n string")
    assert values(df.select(fo.canonical_group(F.col("n")).alias("c")), "c") == ["P1"] * 3


def test_group_aggregation(spark):
    df = spark.createDataFrame(
        [("A", 0, 0.1, 1), ("A", 0, 0.3, 1), ("B", 1, 0.7, 1), ("B", 1, 0.9, 1)],
        "group_id string, outcome int, score double, fold int",
    ).withColumn("m", F.lit(1))
    out = mc.by_unit(df, ["m"])
    assert sorted(values(out, "score")) == pytest.approx([0.2, 0.8])
    assert mc.ranking(out, ["m"]).first()["auroc"] == 1.0


def test_majority_tie_is_positive(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 0), ("b", 1)], "group_id string, call int")
    df = df.withColumns({"m": F.lit(1), "outcome": F.lit(1), "fold": F.lit(1), "score": F.lit(0.0)})
    assert {r.group_id: r.call for r in mc.by_unit(df, ["m"]).collect()} == {"a": 1, "b": 0}


def test_triplets(spark):
    df = spark.createDataFrame([("s", x) for x in ("ACDE", "FGHI", "AC*DE")], "sample_id string, seq string")
    freq = {r.triplet: r.frequency for r in ft.triplet_frequencies(df).collect()}
    assert freq == {"ACD": 0.25, "CDE": 0.25, "FGH": 0.25, "GHI": 0.25}
    qc = ft.repertoire_qc(df).first()
    assert (qc.eligible, qc.valid_windows, qc.invalid_windows) == (3, 4, 3)
    once = spark.createDataFrame([("s", "ACDEF")], "sample_id string, seq string")
    many = spark.createDataFrame([("s", "ACDEF")] * 20, "sample_id string, seq string")
    assert sorted(map(tuple, ft.triplet_frequencies(once).drop("count").collect())) == sorted(
        map(tuple, ft.triplet_frequencies(many).drop("count").collect())
    )
    vocabulary = ft.vocabulary(spark)
    assert vocabulary.count() == 8000 and vocabulary.orderBy("index").first()["triplet"] == "AAA"


def test_case_rules(spark):
    rows = [(0, "p3", 0.2), (0, "p1", 0.8), (0, "p2", 0.8), (1, "p6", 0.1), (1, "p4", 0.7), (1, "p5", 0.4)]
    df = spark.createDataFrame(rows, "y int, u string, v double")
    assert {r.y: r.u for r in dg.top_per_group(df, ["y"], "v", "u").collect()} == {0: "p1", 1: "p4"}
    ranges = spark.createDataFrame([(0, "p1", 0.1), (0, "p2", 0.3), (0, "p3", 0.2), (0, "p4", 0.9)], "y int, u string, v double")
    roles = {r.role: r.u for r in dg.max_and_lower_median(ranges, ["y"], "v", "u").collect()}
    assert roles == {"maximum range": "p4", "median range": "p3"}


def test_timepoints(spark):
    df = spark.createDataFrame([("BL", None), ("6W", None), ("6-8W", None), ("3M", None), ("TOX", 37.0), ("?", 1.0)], "l string, d double")
    got = values(df.select(dg.timepoint_day(F.col("l"), F.col("d")).alias("x")), "x")
    assert got == [0.0, 42.0, 49.0, 91.3125, 37.0, None]


def test_json_payload(spark):
    df = spark.createDataFrame([('Instruction\n{"a": 1}',), ("no payload",), ('x {y} {"a": {"b": "}"}} \n',)], "t string")
    assert values(df.select(tj.trailing_object(F.col("t")).alias("p")), "p") == ['{"a": 1}', None, '{"a": {"b": "}"}}']


def test_numeric_summary(spark):
    ok = '{"sample_id": "s", "evidence_balance": {"net": 1.5, "flag": true, "note": "7"}, "dominant_programs": [{"program": "p", "score": 2}]}'
    df = spark.createDataFrame([("s", ok)], "u string, j string")
    got = {r.feature: r.value for r in tj.flatten_numeric(df, "u", "j").collect()}
    leaves = {"evidence_balance.net": 1.5, "evidence_balance.flag": 1.0, "dominant_programs[p].score": 2.0}
    assert got == {**leaves, **{f"{k}.__present": 1.0 for k in leaves}}
    bad = spark.createDataFrame([("s", '{"evidence_balance": {"fold": 1}}')], "u string, j string")
    with pytest.raises(Exception, match="forbidden field"):
        tj.flatten_numeric(bad, "u", "j").collect()


def test_numeric_summary_at_any_depth(spark):
    def nested(depth, leaf):
        text = leaf
        for i in range(depth):
            text = '{"k%d": %s}' % (i, text) if i % 3 else '[{"program": "p%d", "in": %s}]' % (i, text)
        return '{"evidence_balance": {"top": %s}}' % text

    def path(depth):
        return "evidence_balance.top" + "".join(f".k{i}" if i % 3 else f"[p{i}].in" for i in reversed(range(depth)))

    payloads = [(str(d), nested(d, "2.5")) for d in (0, 1, 3, 6, 13)]
    payloads += [
        ("empty", '{"evidence_balance": {"a": {}, "b": [], "c": null, "d": [1, 2]}}'), ("none", "{}"),
        ("last", '{"evidence_balance": {"a": {"b": 1}, "a.b": 2, "z": [{"program": "p", "s": 3}, {"program": "p", "s": 4}]}}'),
    ]
    df = spark.createDataFrame(payloads, "u string, j string")
    got = {(r.u, r.feature): r.value for r in tj.flatten_numeric(df, "u", "j").collect()}
    want = {(str(d), path(d)): 2.5 for d in (0, 1, 3, 6, 13)}
    want |= {("last", "evidence_balance.a.b"): 2.0, ("last", "evidence_balance.z[p].s"): 4.0}
    assert got == {**want, **{(u, f"{f}.__present"): 1.0 for u, f in want}}
    with pytest.raises(ValueError, match="no numeric feature"):
        tj.flatten_numeric(df, "u", "j", require=True)
    for text, message in ((nested(9, '{"fold": 1}'), "forbidden field"), (nested(6, "1e999"), "not finite")):
        with pytest.raises(Exception, match=message):
            tj.flatten_numeric(spark.createDataFrame([("s", text)], "u string, j string"), "u", "j").collect()


def test_grade_dates(spark):
    df = spark.createDataFrame([("2;3", "1;-4"), ("2", "5;6"), ("1;3", "9"), (None, "4")], "g string, d string")
    got = values(df.select(tj.grade_date_events(F.col("g"), F.col("d")).alias("e")), "e")
    assert [[tuple(x) for x in row] for row in got] == [[(2, 1), (3, -4)], [(2, 5), (2, 6)], [(3, 9)], []]
    bad = spark.createDataFrame([("1;2;3", "4;5")], "g string, d string")
    with pytest.raises(Exception, match="cannot align"):
        bad.select(tj.grade_date_events(F.col("g"), F.col("d"))).collect()


def test_first_object_in_prose(spark):
    df = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('see {x} {"a": 2} then {"a": 3}',), ("[1]",), ("none",)], "t string")
    got = {r.t: r.parsed for r in tj.parse_response(df, "t").collect()}
    assert got['```json\n{"a": 1}\n```'] == '{"a": 1}'
    assert got['see {x} {"a": 2} then {"a": 3}'] == '{"a": 2}'
    assert got["[1]"] is None and got["none"] is None


def test_decisions(spark):
    df = spark.createDataFrame([(0.5, 0.45), (0.5, 0.47), (0.9, 0.1)], "s double, r double")
    out = fm.with_formulas(df, fm.margin_decision("s", "r", "0.04")).toPandas()
    assert out.prediction.tolist() == ["positive", "negative", "positive"]
    assert out.confidence.tolist() == [0.509, 0.509, 0.95]
    risk = spark.createDataFrame([(1.4,), (0.33,), (0.5,)], "s double")
    out = fm.with_formulas(risk, fm.risk_decision("s")).toPandas()
    assert out.risk_group.tolist() == ["high", "low", "intermediate"] and out.risk_score.tolist() == [1.0, 0.33, 0.5]


def test_bootstrap_of_identical_models_is_zero(spark):
    rows = [(m, f"u{i}", float(i + 1), 1, -float(i), i % 5 + 1) for m in ("a", "b") for i in range(30)]
    df = spark.createDataFrame(rows, "model string, unit_id string, duration double, event int, score double, fold int")
    weights = rb.draw_weights(df, [], "unit_id", 12)
    metric = rb.concordance_metric(["fold"], tied_censoring=True)
    draws = rb.replicate(df, weights, ["unit_id"], metric, ["model"])
    ci = rb.intervals(rb.paired_difference(draws, [], "model", "a"), ["model"], 12).first()
    assert (ci.ci_low, ci.ci_high, ci["mean"]) == (0.0, 0.0, 0.0)
    totals = weights.groupBy("rep").agg(F.sum("w").alias("n")).collect()
    assert {r.n for r in totals} == {30}


def test_train_only_transforms(spark):
    units = spark.createDataFrame([(str(i), i % 5 + 1) for i in range(40)], "unit_id string, fold int")
    rng = np.random.default_rng(0)
    cells = [(str(i), f"f{j}", float(rng.integers(1, 9))) for i in range(40) for j in range(4) if (i + j) % 3]
    long = spark.createDataFrame(cells, "unit_id string, feature string, value double")
    moved = long.withColumn("value", F.when(F.col("unit_id") == "0", 1000.0).otherwise(F.col("value")))
    pick = lambda d: sorted(map(tuple, pp.train_moments(d, units, [1, 2]).where("k = 1").select(
        "feature", F.round("mean", 9), F.round("variance", 6)).collect()))
    assert pick(long) == pick(moved)  # unit 0 is in fold 1
    dense = pd.DataFrame(cells, columns=["u", "f", "v"]).pivot(index="u", columns="f", values="v").reindex([str(i) for i in range(40)]).fillna(0)
    train = dense[[i % 5 + 1 != 1 for i in range(40)]]
    assert [r[1] for r in pick(long)] == pytest.approx(train.mean().tolist())
    assert [r[2] for r in pick(long)] == pytest.approx(train.var(ddof=0).tolist(), abs=1e-5)


def test_median_block(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 3.0), ("c", 1, None), ("t", 2, 1000.0)], "unit_id string, fold int, tmb double")
    fills = {r.k: r.fill for r in pp.impute_median(df, "tmb", [2]).collect()}
    assert fills == {2: 2.0}


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5))
    fold = np.arange(60) % 2 + 1
    df = spark.createDataFrame(
        [(str(i), int(fold[i]), [float(v) for v in x[i]]) for i in range(60)], "unit_id string, fold int, features array<double>"
    )
    scores = pp.pca_scores(df, pp.pca(df, [1, 2], components=3)).where("fold = 1").toPandas().set_index("unit_id").pcs
    train, test = x[fold != 1], x[fold == 1]
    z = (train - train.mean(0)) / train.std(0)
    _, _, axes = np.linalg.svd(z, full_matrices=False)
    want = (test - train.mean(0)) / train.std(0) @ axes[:3].T
    got = np.vstack([scores[str(i)] for i in np.flatnonzero(fold == 1)])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)


def efron(x, t, e, penalizer=0.0, steps=30):
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        w = np.exp(x @ beta)
        g, h = np.zeros_like(beta), np.zeros((len(beta), len(beta)))
        for s in np.unique(t[e == 1]):
            risk, dead = t >= s, (t == s) & (e == 1)
            d = dead.sum()
            g += x[dead].sum(0)
            for k in range(d):
                ww = w * risk - k / d * w * dead
                m = (ww[:, None] * x).sum(0) / ww.sum()
                g -= m
                h += (ww[:, None, None] * x[:, :, None] * x[:, None, :]).sum(0) / ww.sum() - np.outer(m, m)
        ridge = len(x) * penalizer
        beta = beta + np.linalg.solve(h + ridge * np.eye(len(beta)), g - ridge * beta)
    return beta


def test_cox_matches_direct_newton(spark):
    rng = np.random.default_rng(11)
    n = 90
    x = rng.normal(size=(n, 2))
    t = np.ceil(rng.exponential(np.exp(-x @ [0.8, -0.5])) * 6)
    e = rng.integers(0, 2, n)
    fold = np.arange(n) % 3 + 1
    pdf = pd.DataFrame({"unit_id": np.arange(n).astype(str), "fold": fold, "duration": t, "event": e, "a": x[:, 0], "b": x[:, 1]})
    df = spark.createDataFrame(pdf)
    fitted = cx.fit(cx.training_rows(df, [1, 2, 3]), ["a", "b"])
    for i, k in enumerate(fitted.keys):
        keep = fold != k
        assert fitted.beta[i] == pytest.approx(efron(x[keep], t[keep], e[keep]), abs=1e-6)
    rows = df.withColumn("k", F.lit(0))
    table = cx.ph_test(rows, cx.fit(rows, ["a", "b"]), unit="unit_id").toPandas()
    assert table.p_value.between(0, 1).all()
    curve = cx.survival_at(df, fitted, cx.baseline_hazard(cx.training_rows(df, [1, 2, 3]), fitted), [5.0]).toPandas()
    assert curve.survival_5.between(0, 1).all()


def test_efron_sums_equal_the_terms(spark):
    rows = [(d, tied * ratio, tied) for d in (1, 2, 7, 40, 5000) for ratio in (1.0, 1.3, 20.0, 900.0) for tied in (0.4, 3.0, 2e4)]
    df = spark.createDataFrame(rows, "d long, r double, e double")
    for row in df.withColumns(cx.efron_sums(F.col("d"), F.col("r"), F.col("e"))).collect():
        s = np.arange(row.d) / row.d
        v = row.r - s * row.e
        scale = row.d * np.array([1, 1, 1, 1, 1]) / np.array([row.r, row.r, row.r**2, row.r**2, row.r**2])
        want = np.array([(1 / v).sum(), (s / v).sum(), (v**-2.0).sum(), (s * v**-2.0).sum(), (s * s * v**-2.0).sum()])
        got = np.array([row._s0, row._s1, row._t0, row._t1, row._t2])
        assert abs(row._log - np.log(v).sum()) <= 1e-7 * max(1.0, np.abs(np.log(v)).sum())
        assert (np.abs(got - want) <= 1e-7 * np.maximum(want, scale)).all(), row


def test_cox_with_closed_tie_sums_and_separable_data(spark, monkeypatch):
    rng = np.random.default_rng(12)
    n = 120
    x = rng.normal(size=(n, 2))
    t = np.ceil(rng.exponential(np.exp(-x @ [0.8, -0.5])) * 2)  # many ties
    e = rng.integers(0, 2, n)
    df = spark.createDataFrame(pd.DataFrame({"k": 0, "duration": t, "event": e, "a": x[:, 0], "b": x[:, 1]}))
    want = efron(x, t, e)
    monkeypatch.setattr(cx, "TIED_ROWS", 1)
    assert cx.fit(df, ["a", "b"]).beta[0] == pytest.approx(want, abs=1e-6)
    apart = spark.createDataFrame([(0, float(i), 1, float(-i)) for i in range(1, 9)], "k int, duration double, event int, a double")
    with pytest.raises(ValueError, match="Cox"):
        cx.fit(apart, ["a"])


def test_cox_halves_a_step_that_overshoots(spark):
    """One far covariate value: the full Newton step lowers the likelihood or overflows."""
    rng = np.random.default_rng(3)
    n = 60
    x = rng.normal(size=n)
    x[:3] = [40.0, 60.0, -50.0]
    t = np.ceil(rng.exponential(np.exp(-np.clip(x, -3, 3) * 1.5)) * 1000) + np.arange(n) / n
    df = spark.createDataFrame(pd.DataFrame({"k": 0, "duration": t, "event": 1, "a": x}))
    fitted = cx.fit(df, ["a"])

    def likelihood(b):
        eta = b * x
        return sum(eta[i] - np.logaddexp.reduce(eta[t >= t[i]]) for i in range(n))

    assert len(set(t)) == n
    best = likelihood(fitted.beta[0, 0])
    assert all(best >= likelihood(fitted.beta[0, 0] + d) for d in (-0.5, -1e-3, 1e-3, 0.5))


def test_search_accepts_only_steps_that_raise_the_likelihood():
    """-log cosh has Newton steps that overshoot from far away; full steps diverge from 2."""
    search = cx._Search([0, 1], 1)
    search.trial = np.array([[2.0], [0.3]])
    seen = []
    for _ in range(60):
        b = search.trial[:, 0].copy()
        seen.append(search.halvings.max())
        search.judge(-np.log(np.cosh(b)), -np.tanh(b)[:, None], (1 / np.cosh(b) ** 2)[:, None, None])
        if search.largest_move() < 1e-9:
            break
    assert max(seen) > 0 and np.abs(search.trial).max() < 1e-6


def ridge_pca_risk(x, t, e, test, components, penalizer):
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd <= 1e-12, 1.0, sd)
    z = (x - mean) / sd
    axes = np.linalg.svd(z, full_matrices=False)[2][:components].T
    pcs = z @ axes
    scale = pcs.std(0, ddof=1)
    beta = efron(pcs / scale, t, e, penalizer) / scale
    return (test - mean) / sd @ axes @ beta


def test_ridge_survival_baseline_equals_fold_by_fold(spark):
    rng = np.random.default_rng(21)
    n = 150
    x = rng.normal(size=(n, 13)) @ rng.normal(size=(13, 13)) * 3 + 5
    x[:, 4] = 7.0  # a constant feature
    t = np.ceil(rng.exponential(np.exp(-(x[:, 0] - 5) / 9)) * 8)
    e, fold = rng.integers(0, 2, n), np.arange(n) % 3 + 1
    df = spark.createDataFrame(pd.DataFrame({
        "unit_id": np.arange(n).astype(str), "fold": fold, "duration": t, "event": e, "features": x.tolist(), "pcs": 1, "k": 2,
    }))
    got = cx.pca_oof_risk(df, [1, 2, 3], components=4, penalizer=0.1).toPandas().astype({"unit_id": int}).set_index("unit_id").sort_index()
    for k in (1, 2, 3):
        train = fold != k
        want = ridge_pca_risk(x[train], t[train], e[train], x[~train], 4, 0.1)
        assert got.risk.to_numpy()[~train] == pytest.approx(want, abs=1e-6)
    with pytest.raises(ValueError, match="survival rows"):
        cx.pca_oof_risk(df.withColumn("event", F.lit(None).cast("int")), [1, 2, 3])
    assert cx.pca_oof_risk(df.withColumn("features", F.array().cast("array<double>")), [1, 2, 3]).where("risk <> 0").isEmpty()


def test_survival_takes_the_hazard_of_its_stratum(spark):
    rows = [("s" if i % 2 else "t", float(i % 7 + 1) * (3 if i % 2 else 1), 1, i % 5 - 2.0, i % 3 + 1) for i in range(40)]
    df = spark.createDataFrame(rows, "stratum string, duration double, event int, a double, fold int")
    rows = cx.training_rows(df, [1, 2, 3])
    fitted = cx.fit(rows, ["a"], stratum="stratum")
    hazard = cx.baseline_hazard(rows, fitted, stratum="stratum")
    with pytest.raises(ValueError):
        cx.survival_at(df, fitted, hazard, [4.0])
    got = cx.survival_at(df, fitted, hazard, [4.0], stratum="stratum").toPandas()
    steps = hazard.toPandas()
    for r in got.itertuples():
        h = steps[(steps.k == r.fold) & (steps.g == r.stratum) & (steps.time <= 4)].cumulative
        assert r.survival_4 == pytest.approx(np.exp(-(h.max() if len(h) else 0.0) * np.exp(r.risk)))


def test_calibration_matches_direct_newton(spark):
    rng = np.random.default_rng(4)
    n = 300
    risk = rng.uniform(0.05, 0.95, n)
    y = (rng.random(n) < risk).astype(int)
    w = rng.uniform(0.5, 2, n)
    df = spark.createDataFrame(pd.DataFrame({"m": 1, "risk": risk, "is_case": y, "ipcw": w}))
    got = ipcw_calibration(df, ["m"], risk="risk").first()
    x = np.c_[np.ones(n), np.log(risk / (1 - risk))]
    b = np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x, x.T @ (w * (y - p)))
    assert (got.intercept, got.slope) == pytest.approx(tuple(b), abs=1e-6)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, p int, v string")
    path = str(tmp_path / "out")
    assert sk.publish_new(df, path) and not sk.publish_new(df, path)
    import hashlib

    assert sk.ordered_digest(df, ["k"], "p", F.col("v")).first()["digest"] == hashlib.sha256(b"x\ny").hexdigest()


def test_digest_tree_of_large_groups(spark):
    """Groups of every number of levels, rows in any order, repeated positions and a NULL key."""
    import hashlib

    sizes = {"a": 1, "b": 3, "c": 4, "d": 9, "e": 28, None: 100}
    rows = [(k, i // 2, f"v{(i * 7) % n}") for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k string, p int, v string").orderBy(F.xxhash64("k", "p", "v"))
    got = {r["k"]: r for r in sk.ordered_digest(df, ["k"], "p", F.col("v"), chunk_rows=3).collect()}

    def tree(values):
        hashes = [hashlib.sha256("\n".join(values[i:i + 3]).encode()).hexdigest() for i in range(0, len(values), 3)]
        return hashes[0] if len(hashes) == 1 else tree(hashes)

    assert set(got) == set(sizes)
    for k, n in sizes.items():
        values = [v for _, v in sorted((p, v) for key, p, v in rows if key == k)]
        assert (got[k]["digest"], got[k]["n"]) == (tree(values), n)


def test_motif_tags(spark):
    df = spark.createDataFrame([("FFF",), ("A*D",), ("",)], "m string")
    got = values(df.select(ft.motif_tags(F.col("m")).alias("t")), "t")
    assert got == [["aromatic", "repeat"], ["boundary", "acidic", "hydrophobic"], ["neutral"]]


def test_all_answer_shapes_are_flattened(spark):
    import json

    from cohortry.operators import decisions as dc
    from cohortry.plans.q_decisions import flat_answers

    body = json.dumps({"response_support_score": 0.9, "resistance_support_score": 0.1, "dominant_side": "response", "rationale": ["a", "b"]})
    contents = [body, f"```json\n{body}\n```", f"Note {{draft}}: {body} and {{\"x\": 1}}.", "no object here", None]
    usage = [{"prompt_tokens": k, "completion_tokens": 2, "total_tokens": None if k == 1 else k + 2} for k in range(5)]
    rows = [(k, "e", 0.0, json.dumps({"usage": usage[k], "choices": [{"message": {"content": c}}]})) for k, c in enumerate(contents)]
    flat = flat_answers(spark.createDataFrame(rows, "sample_id long, event_type string, thr double, raw string"))
    got = {r.sample_id: r for r in flat.collect()}
    assert sorted(got) == [0, 1, 2, 3, 4]
    for k in range(5):
        want = ("positive", 0.95, 0.8, "response", "a | b", 1) if k < 3 else (None,) * 6
        r = got[k]
        assert (r.prediction, r.confidence, r.score_margin, r.dominant_side, r.rationale, r.call) == want
        assert (r.prompt_tokens, r.completion_tokens, r.total_tokens) == (k, 2, None if k == 1 else k + 2)
    s = dc.dataset_summary(flat, ["event_type"]).first()
    assert (s.sample_count, s.positive_predictions, s.negative_predictions, s.mean_total_tokens) == (5, 3, 0, 4.25)
    assert s.mean_confidence == pytest.approx(0.95) and s.accuracy == pytest.approx(sum(got[k].true_label for k in range(3)) / 3)
