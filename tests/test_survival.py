"""Kaplan-Meier, log-rank and proportional hazards: hand-worked and direct answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kohorta.operators import cox as ph
from kohorta.operators import moments, screening
from kohorta.operators import survival as sv
from kohorta.operators.concordance import concordance

SIX = [("a", 1, 1), ("a", 2, 1), ("a", 2, 1), ("a", 3, 0), ("a", 4, 1), ("a", 5, 0)]


def frame(spark, data):
    return spark.createDataFrame(data, "g string, t_days int, event int")


def test_km_by_hand(spark):
    df = frame(spark, SIX + [("b", 1, 0), ("b", 2, 0), ("c", 0, 0), ("c", 3, 1), ("c", None, 1)])
    got = {(r.g, r.t): r for r in sv.kaplan_meier(df, ["g"]).collect()}
    a = [got["a", t] for t in range(1, 6)]
    assert [r.n_risk for r in a] == [6, 5, 3, 2, 1]
    assert [r.n_event for r in a] == [1, 2, 0, 1, 0]
    s = [5 / 6, 5 / 6 * 3 / 5, 0.5, 0.25, 0.25]
    assert [r.survival for r in a] == pytest.approx(s)
    green = 1 / 30 + 2 / 15 + 1 / 2
    assert a[3].std_err == pytest.approx(0.25 * math.sqrt(green))
    assert a[3].lower == pytest.approx(0.25 * math.exp(-sv.Z95 * math.sqrt(green)))
    assert a[3].upper == 1.0 or a[3].upper < 1.0
    assert [got["b", t].survival for t in (1, 2)] == [1.0, 1.0]
    assert got["c", 3].survival == 0.0 and got["c", 3].std_err is None  # curve ends at zero


def test_km_grid(spark):
    df = frame(spark, SIX)
    grid = sv.on_grid(sv.kaplan_meier(df, ["g"]), df, ["g"], [0, 2, 4, 9])
    got = {r.grid_day: (r.n_risk, round(r.survival, 6)) for r in grid.collect()}
    assert got == {0: (6, 1.0), 2: (5, 0.5), 4: (2, 0.25), 9: (0, 0.25)}


def test_km_properties(spark):
    rng = np.random.default_rng(3)
    data = [(str(g), int(t), int(e)) for g, t, e in zip(rng.integers(0, 3, 400), rng.integers(0, 60, 400), rng.integers(0, 2, 400))]
    rows = sv.kaplan_meier(frame(spark, data), ["g"]).orderBy("g", "t").collect()
    for a, b in zip(rows, rows[1:]):
        assert 0 <= a.survival <= 1
        if a.g == b.g:
            assert b.survival <= a.survival and b.n_risk < a.n_risk


def brute_logrank(data, levels):
    times = sorted({t for _, t, e in data if e})
    k = len(levels)
    o, x, v = np.zeros(k), np.zeros(k), np.zeros((k, k))
    for t in times:
        r = np.array([sum(g == lv and tt >= t for g, tt, _ in data) for lv in levels], float)
        d = np.array([sum(g == lv and tt == t and e for g, tt, e in data) for lv in levels], float)
        n, m = r.sum(), d.sum()
        o += d
        x += m * r / n
        if n > 1:
            v += m * (n - m) / (n - 1) * (np.diag(r / n) - np.outer(r / n, r / n))
    diff = (o - x)[:-1]
    return o, x, float(diff @ np.linalg.inv(v[:-1, :-1]) @ diff)


@pytest.mark.parametrize("k", [2, 3, 4])
def test_logrank_matches_the_definition(spark, k):
    rng = np.random.default_rng(k)
    data = [(f"g{g}", int(t) + 1, int(e)) for g, t, e in zip(rng.integers(0, k, 80), rng.exponential(9, 80), rng.integers(0, 2, 80))]
    levels = [f"g{i}" for i in range(k)]
    r = sv.logrank(frame(spark, data), "g", levels).first()
    o, x, chi = brute_logrank(data, levels)
    assert [r[f"observed{i}"] for i in range(k)] == list(o)
    assert [r[f"expected{i}"] for i in range(k)] == pytest.approx(list(x))
    assert r["chi_square"] == pytest.approx(chi)
    assert r["dof"] == k - 1


def test_logrank_empty_group_lowers_the_degrees(spark):
    r = sv.logrank(frame(spark, SIX + [("b", 2, 1), ("b", 3, 1)]), "g", ["a", "b", "none"]).first()
    assert r["dof"] == 1 and r["chi_square"] is not None


# ---- proportional hazards ---------------------------------------------------------


@pytest.mark.parametrize("d", [1, 7, 97, 500, 5000])
@pytest.mark.parametrize("share", [1.0, 0.3, 1e-6])
def test_tie_sums_against_addition(d, share):
    s0 = np.array([123.4])
    e0 = s0 * share
    u = s0[0] - np.arange(d) * e0[0] / d
    got = ph.tie_sums(s0, e0, np.array([float(d)]))
    want = [np.log(u).sum(), (1 / u).sum(), (1 / u**2).sum()]
    assert [g[0] for g in got] == pytest.approx(want, rel=1e-9)


def efron_loglik(beta, data):
    """Partial likelihood by its definition; data rows (t, e, x vector)."""
    x = np.array([r[2] for r in data], float)
    t = np.array([r[0] for r in data])
    e = np.array([r[1] for r in data])
    w = np.exp(x @ beta)
    out = 0.0
    for day in sorted(set(t[e == 1])):
        dead = (t == day) & (e == 1)
        s, q, d = w[t >= day].sum(), w[dead].sum(), dead.sum()
        out += (x[dead] @ beta).sum() - sum(math.log(s - k / d * q) for k in range(d))
    return out


def gradient(beta, data, h=1e-5):
    out = []
    for j in range(len(beta)):
        up, down = np.array(beta, float), np.array(beta, float)
        up[j] += h
        down[j] -= h
        out.append((efron_loglik(up, data) - efron_loglik(down, data)) / (2 * h))
    return np.array(out)


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(11)
    n = 300
    age, sex = np.round(rng.normal(60, 10, n), 1), rng.integers(0, 2, n)
    drug = rng.integers(0, 3, n)
    t = np.ceil(rng.exponential(60 * np.exp(-0.03 * (age - 60) - 0.4 * sex - 0.3 * (drug == 2)))).astype(int)
    e = (rng.random(n) < 0.7).astype(int)
    rows = [(i, float(a), "FM"[s], f"d{d}", int(tt), int(ee), "x" if i % 2 else "y") for i, (a, s, d, tt, ee) in enumerate(zip(age, sex, drug, t, e))]
    return rows, spark.createDataFrame(rows, "patientid long, age double, sex string, drug string, t_days int, event int, site string")


COVARIATES = [ph.Covariate("age"), ph.Covariate("sex", ["F", "M"]), ph.Covariate("drug", ["d0", "d1", "d2"])]


def vectors(rows):
    return [(r[4], r[5], (r[1] - 60, r[2] == "M", r[3] == "d1", r[3] == "d2")) for r in rows]


def test_cox_is_the_maximum(cohort):
    rows, df = cohort
    fit = {(r.term, r.level): r for r in ph.cox(df, COVARIATES).collect()}
    keys = [("age", ""), ("sex", "M"), ("drug", "d1"), ("drug", "d2")]
    beta = np.array([fit[k].coef for k in keys])
    data = vectors(rows)
    assert np.abs(gradient(beta, data)).max() < 1e-3
    assert fit[keys[0]].loglik == pytest.approx(efron_loglik(beta, data), rel=1e-10)
    assert fit[keys[0]].loglik_null == pytest.approx(efron_loglik(np.zeros(4), data), rel=1e-10)
    h = 1e-4
    info = -np.array([(gradient(beta + h * np.eye(4)[j], data) - gradient(beta - h * np.eye(4)[j], data)) / (2 * h) for j in range(4)])
    se = np.sqrt(np.diag(np.linalg.inv(info)))
    assert [fit[k].se for k in keys] == pytest.approx(list(se), rel=1e-3)
    m = fit[("sex", "M")]
    assert m.hr == pytest.approx(math.exp(m.coef)) and m.p == pytest.approx(math.erfc(abs(m.z) / math.sqrt(2)))


def test_cox_by_group_equals_separate_fits(cohort):
    _, df = cohort
    both = {(r.model, r.term): r.coef for r in ph.cox(df, COVARIATES[:2], by="site").collect()}
    for site in "xy":
        alone = {r.term: r.coef for r in ph.cox(df.where(F.col("site") == site), COVARIATES[:2]).collect()}
        assert {t: both[site, t] for t in alone} == pytest.approx(alone, abs=1e-9)


def test_cox_skips_incomplete_rows_and_flags_divergence(spark, cohort):
    _, df = cohort
    holed = df.withColumn("age", F.when(F.col("patientid") != 7, F.col("age")))
    got = ph.cox(holed, COVARIATES[:1]).first()
    want = ph.cox(df.where(F.col("patientid") != 7), COVARIATES[:1]).first()
    assert (got.n, got.coef) == (299, pytest.approx(want.coef, abs=1e-10))
    apart = spark.createDataFrame([("n", t, 0) for t in range(5, 15)] + [("y", t, 1) for t in range(1, 11)], "g string, t_days int, event int")
    r = ph.cox(apart, [ph.Covariate("g", ["y", "n"])]).first()
    assert r.hr is None and r.p is None


def test_cox_does_not_depend_on_the_unit(spark, cohort):
    _, df = cohort
    want = {r.term: r for r in ph.cox(df, COVARIATES[:2]).collect()}
    for unit in (1e-3, 1e4):
        got = {r.term: r for r in ph.cox(df.withColumn("age", F.col("age") * unit), COVARIATES[:2]).collect()}
        assert {r.status for r in got.values()} == {"converged"}
        assert {t: r.z for t, r in got.items()} == pytest.approx({t: r.z for t, r in want.items()}, rel=1e-7)
        assert got["age"].coef * unit == pytest.approx(want["age"].coef, rel=1e-7)
    apart = spark.createDataFrame([("n", t, 0) for t in range(5, 15)] + [("y", t, 1) for t in range(1, 11)], "g string, t_days int, event int")
    assert ph.cox(apart, [ph.Covariate("g", ["y", "n"])]).first().status == "separated"
    edge = apart.withColumn("g", F.when(F.col("g") == "y", 0.0).otherwise(1e-4))
    r = ph.cox(edge, [ph.Covariate("g")]).first()
    assert (r.status, r.hr) == ("separated", None)


def test_steep_and_slow_models_converge():
    def evaluate(betas):
        b = betas[0]
        with np.errstate(over="ignore"):
            tail = np.exp(b - 30)
        return {0: (float((b - tail)[0]), 1 - tail, np.diag(tail))}

    fit = ph.newton([0], 1, evaluate)[0]
    assert fit.status == "converged" and fit.beta == pytest.approx([30])


def test_breslow_differs_only_with_ties(spark):
    df = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("a", 3, 1), ("b", 4, 1), ("a", 5, 0)], "g string, t_days int, event int")
    cov = [ph.Covariate("g", ["a", "b"])]
    efron, breslow = ph.cox(df, cov).first().coef, ph.cox(df, cov, efron=False).first().coef
    assert efron == pytest.approx(breslow, abs=1e-9)


def test_screens_equal_single_fits(spark, cohort):
    rows, df = cohort
    rng = np.random.default_rng(4)
    pairs = [(i, f"C{c:02d}") for i in range(300) for c in range(4) if rng.random() < 0.1 * (c + 1)]
    exposure = spark.createDataFrame(pairs + [(999, "C00")], "patientid long, atc3 string")
    plain = {r.atc3: r for r in ph.screen(exposure, df).collect()}
    adjusted = {r.atc3: r for r in ph.screen_adjusted(exposure, df, COVARIATES[:2], sorted(plain)).collect()}
    for code in plain:
        have = {i for i, c in pairs if c == code}
        one = df.withColumn("x", F.when(F.col("patientid").isin(have), "Yes").otherwise("No"))
        x = ph.Covariate("x", ["No", "Yes"])
        alone = ph.cox(one, [x]).first()
        assert (plain[code].n, plain[code].coef) == (len(have), pytest.approx(alone.coef, abs=1e-8))
        assert plain[code].se == pytest.approx(alone.se, rel=1e-6)
        full = [r for r in ph.cox(one, [*COVARIATES[:2], x]).collect() if r.term == "x"][0]
        assert adjusted[code].coef == pytest.approx(full.coef, abs=1e-8)
        assert adjusted[code].n_event == sum(r[5] for r in rows if r[0] in have)


def test_screen_without_events_in_an_arm(spark):
    outcome = spark.createDataFrame([(1, 1, 1), (2, 2, 0), (3, 3, 1)], "patientid long, t_days int, event int")
    exposure = spark.createDataFrame([(2, "A"), (1, "B"), (3, "B")], "patientid long, atc3 string")
    got = {r.atc3: r.hr for r in ph.screen(exposure, outcome).collect()}
    assert got == {"A": None, "B": None}


def test_model_table_lists_reference_levels(cohort):
    _, df = cohort
    table = ph.model_table(df, COVARIATES, ph.cox(df, COVARIATES)).collect()
    got = {(r.term, r.level): r for r in table}
    assert set(got) == {("age", ""), ("sex", "F"), ("sex", "M"), ("drug", "d0"), ("drug", "d1"), ("drug", "d2")}
    assert got["sex", "F"].hr == 1.0 and got["sex", "F"].n + got["sex", "M"].n == 300 == got["age", ""].n
    assert got["age", ""].aic == pytest.approx(-2 * got["age", ""].loglik + 8)


# ---- multiplicity -------------------------------------------------------------------


def test_adjusted_p(spark):
    ps = [0.01, 0.02, 0.02, 0.5, 1.0, None, 0.04]
    df = spark.createDataFrame([(f"C{i}", p) for i, p in enumerate(ps)], "atc3 string, p double")
    got = {r.atc3: r for r in screening.adjust_p(df).collect()}
    known = sorted(p for p in ps if p is not None)
    m = len(known)
    for i, p in enumerate(ps):
        r = got[f"C{i}"]
        if p is None:
            assert r.fdr is None and r.bonferroni is None
            continue
        want = min(min(1.0, q * m / (j + 1)) for j, q in enumerate(known) if q >= p)
        assert r.fdr == pytest.approx(want)
        assert r.bonferroni == pytest.approx(min(1.0, p * m))
        assert r.fdr <= r.bonferroni + 1e-12


def test_publication_table(spark, rows):
    cols = "atc3 string, n long, hr double, lower double, upper double, p double, bonferroni double"
    one = spark.createDataFrame([("A07", 3, 1.5, 1.1, 2.0, 0.0, 0.00001), ("B01", 50, 0.001, 0.0, 1.0, 0.0, 0.01)], cols)
    two = spark.createDataFrame([("C03", 9, 2.0, 1.2, 3.0, 0.01, 0.04)], cols)
    names = spark.createDataFrame([("A07", "old name"), ("C03", "third")], "atc3 string, name string")
    kept = screening.significant(one)
    assert rows(screening.described(kept, names), "atc3", "name") == [("A07", "antidiarrheals, intestinal antiinflammatory")]
    table = screening.result_table(
        {"os": screening.printed(kept), "adt": screening.printed(two.where("false")), "inf": screening.printed(two)}, names)
    assert rows(table, "atc3", "name", "n_os", "hr_os", "p_os", "n_adt", "hr_inf") == [
        ("A07", "old name", "<5", "1.50 [1.10;2.00]", "<0.001", None, None),
        ("C03", "third", None, None, None, "9", "2.00 [1.20;3.00]"),
    ]


# ---- concordance and moment tables -----------------------------------------------


def test_concordance_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    for n, days, scores in ((400, 30, 12), (700, 500, 10**6)):
        rows = [(int(t), int(e), float(s)) for t, e, s in zip(rng.integers(0, days, n), rng.integers(0, 2, n), rng.integers(0, scores, n), strict=True)]
        less = more = same = 0
        for t, e, s in rows:
            for t2, e2, s2 in rows:
                if e == 1 and (t2 > t or t2 == t and e2 == 0):
                    less, more, same = less + (s2 < s), more + (s2 > s), same + (s2 == s)
        df = spark.createDataFrame([*rows, (None, 1, 2.0), (3, 1, None)], "t_days int, event int, s double").repartition(4)
        for ranges in (1, 7, 150):
            r = concordance(df, F.col("s"), ranges=ranges).first()
            assert (r.concordant, r.discordant, r.tied) == (less, more, same)
            assert r.concordance == pytest.approx((less + same / 2) / (less + more + same), rel=1e-12)
    assert concordance(df.where("event = 0"), F.col("s")).first().concordance is None
    assert concordance(df.where("t_days > 10000"), F.col("s")).first().concordance is None


@pytest.mark.parametrize("q", [0, 1, 2, 3])
def test_moment_table_sums_equal_direct_sums(q):
    rng = np.random.default_rng(q)
    n, p = 500, q + 2
    t, e, x, z = rng.integers(1, 9, n), rng.integers(0, 2, n), rng.integers(0, 2, (n, 2)).astype(float), rng.uniform(-1, 1, (n, q))
    anchor, b = rng.normal(size=q), np.empty(p)
    numeric = [2 * i for i in range(q)][: min(q, 2)] + ([p - 1] if q == 3 else [])
    step = rng.dirichlet(np.ones(q)) * 0.999 * moments.reach(q) if q else np.empty(0)
    b[numeric], b[[j for j in range(p) if j not in numeric]] = anchor + step, [0.4, -2.0]
    w0 = np.exp(z @ anchor)
    m = np.stack([w0 * np.prod(z ** np.array(a), axis=1) for a in moments.powers(q)], axis=1)
    table = moments.Table(t, e, x, np.ones(n), z, m, anchor, numeric)
    assert table.near(b) and (q == 0 or not table.near(b + 3))
    full = np.empty((n, p))
    full[:, numeric], full[:, [j for j in range(p) if j not in numeric]] = z, x
    w = np.exp(full @ b)
    got = table.sums(b)
    for k, day in enumerate(sorted(set(t.tolist()), reverse=True)):
        risk, dead = t >= day, (t == day) & (e == 1)
        for at, rows in ((0, risk), (3, dead)):
            assert got[at][k] == pytest.approx(w[rows].sum(), rel=1e-11)
            assert got[at + 1][k] == pytest.approx(w[rows] @ full[rows], rel=1e-10, abs=1e-10)
            assert got[at + 2][k] == pytest.approx(np.einsum("i,ij,ik->jk", w[rows], full[rows], full[rows]), rel=1e-10, abs=1e-10)
        assert (got[6][k], got[8][k]) == (dead.sum(), pytest.approx((full[dead] @ b).sum(), rel=1e-10, abs=1e-10))
        assert got[7][k] == pytest.approx(full[dead].sum(axis=0), rel=1e-10, abs=1e-10)


def test_estimate_does_not_move_with_the_unexposed_bulk():
    def fit(bulk):
        days = np.arange(1, 41)
        n1, d1 = np.where(days % 3 == 0, 1.0, 0.0), np.where(days % 6 == 0, 1.0, 0.0)
        return ph.binary_cox(days, n1, d1, days, n1 + bulk * (50 - days), d1 + bulk)

    small, large = fit(1e4), fit(1e10)
    assert small.status == large.status == "converged" and small.steps > 1
    assert large.beta == pytest.approx(small.beta, abs=2e-3) and large.cov == pytest.approx(small.cov, rel=2e-3)
    # where the bulk only scales, the estimate is that of the limit
    assert fit(1e9).beta == pytest.approx(large.beta, abs=1e-6)


def test_adjusted_screen_takes_tables_anew_beyond_their_reach(spark):
    rng = np.random.default_rng(6)
    n = 400
    exposed = rng.random(n) < 0.5
    x = np.where(exposed, 1.0, -1.0) * rng.uniform(0.7, 1, n)  # the class and the covariate go together
    t = np.ceil(rng.exponential(80 * np.exp(-2.5 * x + 4.5 * exposed))).astype(int)
    df = spark.createDataFrame([(i, int(a), int(rng.random() < 0.8), float(v)) for i, (a, v) in enumerate(zip(t, x, strict=True))], "patientid int, t_days int, event int, x double")
    exposure = spark.createDataFrame([(i, "C") for i in range(n) if exposed[i]], "patientid int, atc3 string")
    got = ph.screen_adjusted(exposure, df, [ph.Covariate("x")]).first()
    one = df.withColumn("c", F.col("patientid").isin([i for i in range(n) if exposed[i]]).cast("string"))
    want = [r for r in ph.cox(one, [ph.Covariate("x"), ph.Covariate("c", ["false", "true"])]).collect() if r.term == "c"][0]
    assert got.status == want.status == "converged"
    assert (got.coef, got.se) == (pytest.approx(want.coef, abs=1e-8), pytest.approx(want.se, rel=1e-7))


def test_two_and_three_numeric_covariates(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(250, 3))
    t = np.ceil(rng.exponential(50 * np.exp(-x @ np.array([0.5, -0.4, 0.2])))).astype(int)
    rows = [(int(a), int(rng.random() < 0.7), *map(float, v)) for a, v in zip(t, x, strict=True)]
    df = spark.createDataFrame(rows, "t_days int, event int, a double, b double, c double")
    for names in ("ab", "abc"):
        beta = np.array([r.coef for r in ph.cox(df, [ph.Covariate(v) for v in names]).collect()])
        assert np.abs(gradient(beta, [(r[0], r[1], r[2 : 2 + len(names)]) for r in rows])).max() < 1e-3


def test_too_many_distinct_times_are_an_error(spark, cohort, monkeypatch):
    monkeypatch.setattr(moments, "MAX_ROWS", 20)
    with pytest.raises(ValueError, match="round times to days"):
        ph.cox(cohort[1], COVARIATES[:1])
