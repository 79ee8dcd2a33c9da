"""Ranks, running totals, exact quantiles and hash numbering on both code paths."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortry.operators import ordered, rankstats as rs
from cohortry.operators.metrics_class import ranking, within_fold_auroc
from cohortry.operators.metrics_surv import curve_median, km_curve


@pytest.fixture(params=["plain", "chunked"])
def path(request, monkeypatch):
    if request.param == "chunked":
        monkeypatch.setattr(ordered, "TASK_ROWS", 25)
    return request.param


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({
        "g": rng.choice(["a", "b"], 300, p=[0.9, 0.1]), "v": rng.integers(0, 90, 300) / 4,
        "outcome": rng.integers(0, 2, 300), "fold": rng.integers(1, 4, 300),
    })
    pdf.loc[::3, "v"] = 5.0  # one value holds a third of the rows
    return pdf


def test_average_rank(spark, data, path):
    out = ordered.with_average_rank(spark.createDataFrame(data), ["g"], "v", "r").toPandas()
    want = data.assign(r=data.groupby("g").v.rank(method="average"))
    assert sorted(zip(out.g, out.v, out.r)) == sorted(zip(want.g, want.v, want.r))


def test_running_minimum_descending(spark, data, path):
    base = data.drop_duplicates(["g", "v"])[["g", "v"]].assign(x=lambda d: (d.v * 7) % 5)
    out = ordered.running_totals(spark.createDataFrame(base), ["g"], "v", {"m": "x"}, descending=True, how="min")
    want = base.sort_values("v", ascending=False)
    want = want.assign(m=want.groupby("g").x.cummin())
    got = out.toPandas().sort_values(["g", "v"]).m.tolist()
    assert got == want.sort_values(["g", "v"]).m.tolist()


def test_exact_quantiles(spark, data, path):
    qs = {"lo": 0.025, "mid": 0.5, "hi": 0.7}
    out = ordered.exact_quantiles(spark.createDataFrame(data), ["g"], "v", qs).toPandas().set_index("g")
    for g, part in data.groupby("g"):
        assert out.loc[g, list(qs)].tolist() == pytest.approx(np.quantile(part.v, list(qs.values())).tolist())


def test_ordered_pair_sum(spark, data, path):
    base = data.groupby(["g", "v"], as_index=False).agg(a=("outcome", "sum"), b=("fold", "sum"))
    out = ordered.ordered_pair_sum(spark.createDataFrame(base), ["g"], "v", "a", "b", "s").toPandas().set_index("g").s
    for g, p in base.groupby("g"):
        want = sum(x * p.b[p.v > v].sum() for v, x in zip(p.v, p.a))
        assert out[g] == want


def test_auroc_and_auprc(spark, data, path):
    out = ranking(spark.createDataFrame(data), ["g"], score="v").toPandas().set_index("g")
    for g, p in data.groupby("g"):
        pos, neg = p.v[p.outcome == 1].to_numpy(), p.v[p.outcome == 0].to_numpy()
        credit = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
        assert out.loc[g, "auroc"] == pytest.approx(credit / (len(pos) * len(neg)))
        ap = last = 0.0
        for s in sorted(set(p.v), reverse=True):
            top = p[p.v >= s]
            recall = top.outcome.sum() / len(pos)
            ap, last = ap + (recall - last) * top.outcome.mean(), recall
        assert out.loc[g, "auprc"] == pytest.approx(ap)


def test_hash_row_number(spark):
    ids = [str(i) for i in range(200)]
    df = spark.createDataFrame([(i,) for i in ids], "u string")
    out = ordered.hash_row_number(df, [], "u", "42:").toPandas().set_index("u").rn
    want = {u: n for n, u in enumerate(sorted(ids, key=lambda u: hashlib.md5(f"42:{u}".encode()).hexdigest()), 1)}
    assert out.to_dict() == want


def test_midrank(spark, path):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (4.0,)], "v double").withColumn("g", F.lit(1))
    assert sorted(rs.midrank_percentile(df, ["g"], "v").toPandas().percentile) == [0.125, 0.5, 0.5, 0.875]


def test_bh(spark, path):
    df = spark.createDataFrame([("m", 0.01), ("m", 0.04), ("m", 0.03), ("m", None)], "m string, p double")
    out = rs.bh_adjust(df, ["m"], "p").orderBy("p").toPandas().p_adjusted.tolist()
    assert out[1:] == pytest.approx([0.03, 0.04, 0.04]) and pd.isna(out[0])


def test_kruskal_matches_formula(spark, path):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"m": "x", "s": rng.choice(list("abc"), 90), "v": rng.integers(0, 20, 90).astype(float)})
    row = rs.kruskal_wallis(spark.createDataFrame(pdf), ["m"], "s", "v").toPandas().iloc[0]
    r = pdf.v.rank()
    n = len(pdf)
    h = 12 / (n * (n + 1)) * sum(r[pdf.s == s].sum() ** 2 / (pdf.s == s).sum() for s in "abc") - 3 * (n + 1)
    h /= 1 - sum(c**3 - c for c in pdf.v.value_counts()) / (n**3 - n)
    assert row.h_statistic == pytest.approx(h)
    assert row.p_value == pytest.approx(np.exp(-h / 2))
    constant = spark.createDataFrame(pdf.assign(v=1.0))
    row = rs.kruskal_wallis(constant, ["m"], "s", "v").toPandas().iloc[0]
    assert (row.h_statistic, row.p_value) == (0.0, 1.0)


def test_fold_auroc_cases(spark, path):
    def auc(y, fold, score):
        df = spark.createDataFrame(pd.DataFrame({"m": 1, "outcome": y, "fold": fold, "score": [float(s) for s in score]}))
        return within_fold_auroc(ranking(df, ["m", "fold"]), ["m"]).toPandas().iloc[0]

    assert auc([0, 1, 0, 1], [1, 1, 2, 2], [0.9, 0.9, 0.1, 0.1]).auroc == 0.5
    assert auc([0, 1, 0, 1], [1, 1, 2, 2], [0, 1, 0, 1]).auroc == auc([0, 1, 0, 1], [1, 1, 2, 2], [100, 101, -1, 0]).auroc
    assert auc([0, 1, 1], [1, 1, 2], [0, 1, 2]).comparable_pairs == 1


def test_km_curve(spark, path):
    pdf = pd.DataFrame({"g": 1, "duration": [1.0, 2, 2, 3, 4, 5], "event": [1, 1, 0, 0, 1, 1]})
    out = km_curve(spark.createDataFrame(pdf), ["g"]).orderBy("time").toPandas()
    assert out.survival.tolist() == pytest.approx([5 / 6, 5 / 6 * 4 / 5, 5 / 6 * 4 / 5, 1 / 3, 0.0])
    assert out.before.tolist() == pytest.approx([1.0, *out.survival.tolist()[:-1]])
    assert curve_median(km_curve(spark.createDataFrame(pdf), ["g"]), ["g"], "m").first()["m"] == 4.0


@pytest.mark.parametrize("rows", [2_000_000, 40, 5])
def test_null_keys_and_undefined_values_at_any_size(spark, monkeypatch, rows):
    """The chunked paths give what the plain ones give: NULL and NaN included, a hot value besides."""
    from cohortry.operators import pairs

    data = [(k, float(i % 7), int(i % 3 > 0), s) for i in range(30) for k in ("a", None)
            for s in [None if i == 3 else float("nan") if i == 4 else 1.0 if i % 2 else float(i)]]
    df = spark.createDataFrame(data, "k string, t double, e int, s double")
    monkeypatch.setattr(ordered, "TASK_ROWS", rows)
    ranks = ordered.value_ranks(df, ["k"], "s").collect()
    for key in ("a", None):
        upto = {str(r.s): (r._upto, r._total) for r in ranks if r.k == key}
        assert upto["None"] == (1, 30) and upto["nan"] == (30, 30) and upto["1.0"] == (16, 30)
    median = {r.k: r.q for r in ordered.exact_quantiles(df.where("not isnan(s)"), ["k"], "s", {"q": 0.5}).collect()}
    assert median == {"a": 1.0, None: 1.0}
    got = {r.k: (r.pairs, r.concordant, r.tied) for r in pairs.concordance(df, ["k"], duration="t", event="e", risk="s").collect()}
    use = [(t, e, s) for k, t, e, s in data if k == "a" and s is not None and s == s]
    want = [0.0, 0.0, 0.0]
    for t, e, s in use:
        for t2, _, s2 in use:
            if e and t < t2:
                want[0] += 1
                want[1] += s > s2
                want[2] += s == s2
    assert got == {"a": tuple(want), None: tuple(want)}
