"""Proportional-hazards models as Newton steps over per-day moment tables.

The cohort is read once for the centre and range of numeric covariates and once for the moment table of each model
(``moments``); both are map-side combined aggregates.  The table's size is bounded by the days of follow-up, so
a model is then fitted in one task, and the driver sees one row per model.  Only estimates that leave the reach of the
table's series ask for one more pass.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kohorta.functions.tails import normal_two_sided
from kohorta.operators import moments as mo
from kohorta.operators.survival import Z95
from kohorta.session import settle
from kohorta.sources.codes import small_frame

MAX_STEPS = 100  # Newton steps, without halvings
MAX_HALVINGS = 60  # of one step
DECREMENT = 1e-16  # squared length of a step in standard errors that ends a climb
SMALL = 1e-8  # below it a decrement that no longer falls is rounding
RUNAWAY = 0.1  # an estimate that still moves by more while the decrement is small is infinite


@dataclass(frozen=True)
class Covariate:
    """A numeric column, or a factor with its levels (the first is the reference)."""

    column: str
    levels: Sequence[str] | None = None

    def terms(self) -> list[tuple[str, str | None]]:
        return [(self.column, v) for v in self.levels[1:]] if self.levels else [(self.column, None)]


def _design(covariates: Sequence[Covariate]) -> list[Column]:
    cols = []
    for cov in covariates:
        x = F.col(cov.column)
        if cov.levels is None:
            cols.append(x.cast("double"))
        else:
            known = x.isin(list(cov.levels))
            cols += [F.when(known, (x == v).cast("double")) for v in cov.levels[1:]]
    return cols


# ---- per-day algebra ----------------------------------------------------------


def tie_sums(s0: np.ndarray, e0: np.ndarray, d: np.ndarray):
    """Per day: sums over ``l = 0..d-1`` of log u, 1/u and 1/u^2, ``u = s0 - l e0 / d``.

    Short runs are added up; a long run is added up over its last terms only, where u
    changes fast, and integrated with end corrections before them, so that a day with a
    billion events costs the same as one with a hundred.
    """
    c = e0 / d
    out = [np.zeros_like(s0) for _ in range(3)]

    def add(rows, u):
        out[0][rows] += np.log(u)
        out[1][rows] += 1.0 / u
        out[2][rows] += 1.0 / (u * u)

    short = np.flatnonzero(d <= 96)
    if short.size:
        for step in range(int(d[short].max())):
            rows = short[d[short] > step]
            add(rows, s0[rows] - step * c[rows])
    long = np.flatnonzero(d > 96)
    if long.size:
        for back in range(1, 65):
            add(long, s0[long] - (d[long] - back) * c[long])
        u0, k, last = s0[long], c[long], d[long] - 65
        y = k * last / u0
        u1 = u0 * (1.0 - y)
        out[0][long] += (
            last * np.log(u0)
            + u0 / k * (-(1.0 - y) * np.log1p(-y) - y)
            + (np.log(u0) + np.log(u1)) / 2
            + (k / u0 - k / u1) / 12
            + (2 * k**3 / u1**3 - 2 * k**3 / u0**3) / 720
        )
        out[1][long] += (
            -np.log1p(-y) / k
            + (1 / u0 + 1 / u1) / 2
            + k * (1 / u1**2 - 1 / u0**2) / 12
            - 6 * k**3 * (1 / u1**4 - 1 / u0**4) / 720
        )
        out[2][long] += (
            last / (u0 * u1)
            + (1 / u0**2 + 1 / u1**2) / 2
            + 2 * k * (1 / u1**3 - 1 / u0**3) / 12
            - 24 * k**3 * (1 / u1**5 - 1 / u0**5) / 720
        )
    return out


def likelihood(s0, s1, s2, e0, e1, e2, d, x_sum, eta_sum, efron: bool = True):
    """Log-likelihood, gradient and information from risk-set sums (``s``), sums over
    those failing that day (``e``), events ``d`` and plain event sums of x and of x'b."""
    if not efron:
        e0, e1, e2 = np.zeros_like(e0), np.zeros_like(e1), np.zeros_like(e2)
        mean = s1 / s0[:, None]
        ll = float(eta_sum.sum() - (d * np.log(s0)).sum())
        grad = (x_sum - d[:, None] * mean).sum(axis=0)
        info = np.einsum("i,ijk->jk", d / s0, s2) - np.einsum("i,ij,ik->jk", d, mean, mean)
        return ll, grad, info
    logs, one, two = tie_sums(s0, e0, d)
    b = e1 / e0[:, None]
    a = s1 - b * s0[:, None]
    b2 = e2 / e0[:, None, None]
    a2 = s2 - b2 * s0[:, None, None]
    ll = float(eta_sum.sum() - logs.sum())
    grad = (x_sum - a * one[:, None] - b * d[:, None]).sum(axis=0)
    cross = np.einsum("i,ij,ik->jk", one, a, b)
    info = (
        np.einsum("i,ijk->jk", one, a2)
        + np.einsum("i,ijk->jk", d, b2)
        - np.einsum("i,ij,ik->jk", two, a, a)
        - cross
        - cross.T
        - np.einsum("i,ij,ik->jk", d, b, b)
    )
    return ll, grad, info


@dataclass
class Fit:
    beta: np.ndarray
    cov: np.ndarray | None
    ll0: float
    ll: float
    steps: int
    converged: bool
    status: str  # converged, separated (infinite estimate), singular, stalled, steps (MAX_STEPS reached) or no data


def new_state(p: int) -> dict:
    """A climb that has not begun; plain values, so that it can go between driver and tasks."""
    return {"b": [0.0] * p, "from": None, "dir": None, "slope": None, "ll0": None, "size": None, "steps": 0, "halved": 0}


def climb(state: dict, evaluate: Callable, near: Callable = lambda b: True) -> Fit | None:
    """Newton steps until they end, or until an estimate lies where ``near`` is false (None: ``state`` can be taken up again).

    ``evaluate(b)`` gives (ll, gradient, information), with covariates scaled so that no value is further than 1 from the
    centre.  The stop rule is the Newton decrement ``g' I^-1 g``, the squared length of the next step in standard errors: it
    does not know the likelihood's size, so a huge unexposed bulk cannot hide an exposed few.  A decrement that no longer
    falls while it is small is rounding noise.  A step is halved while the slope along it at its end is
    below minus half of that at its start.  Where the decrement vanishes while an estimate still runs, the model is separated.
    """
    while True:
        b = np.array(state["b"])
        if not near(b):
            return None
        ll, grad, info = evaluate(b)
        if state["ll0"] is None:
            state["ll0"] = ll
        try:
            cov = np.linalg.inv(info) if np.all(np.isfinite(info)) else None
        except np.linalg.LinAlgError:
            cov = None
        bad = cov is None or not np.all(np.isfinite(cov)) or bool(np.any(np.diag(cov) <= 0))
        size = math.inf if bad else float(grad @ cov @ grad)
        small = size < SMALL and state["size"] is not None
        flat = size <= DECREMENT or small and size >= state["size"] / 4
        beyond = state["dir"] is not None and not flat
        if beyond and (not math.isfinite(ll) or float(grad @ np.array(state["dir"])) < -state["slope"] / 2):
            state["halved"] += 1
            if state["halved"] > MAX_HALVINGS:
                return Fit(np.array(state["from"]), None, state["ll0"], ll, state["steps"], False, "stalled")
            state["dir"] = [v / 2 for v in state["dir"]]
            state["slope"] /= 2
            state["b"] = [v + d for v, d in zip(state["from"], state["dir"], strict=True)]
            continue
        step = None if bad else cov @ grad
        away = not bad and size < SMALL and bool(np.any(np.abs(step) > RUNAWAY))
        if bad or flat or away or state["steps"] == MAX_STEPS:
            status = "singular" if bad else "separated" if away else "converged" if flat else "steps"
            ok = status == "converged"
            # the last step needs no evaluation any more
            return Fit(b + step if ok else b, cov if ok else None, state["ll0"], ll, state["steps"], ok, status)
        state |= {"from": state["b"], "dir": step.tolist(), "slope": size, "size": size, "halved": 0, "steps": state["steps"] + 1}
        state["b"] = (b + step).tolist()


def newton(models: Sequence, p: int, evaluate: Callable) -> dict:
    """Fit models one by one; ``evaluate({model: b})`` maps the model to (ll, gradient, information)."""
    return {m: climb(new_state(p), lambda b, m=m: evaluate({m: b})[m]) for m in models}


def _spread(centre: float, least: float, most: float) -> float:
    """Largest distance from the centre; 1 for a constant."""
    return max(most - centre, centre - least) or 1.0


def _fit_text(fit: Fit) -> dict:
    plain = lambda v: None if v is None else v.tolist()
    return {"beta": plain(fit.beta), "cov": plain(fit.cov), "rest": [fit.ll0, fit.ll, fit.steps, fit.converged, fit.status]}


def _fit_of(text: dict) -> Fit:
    cov = None if text["cov"] is None else np.array(text["cov"])
    return Fit(np.array(text["beta"]), cov, *text["rest"])


def _table_fit(table: mo.Table, state: dict, efron: bool) -> str:
    """One pass of a model over its table: the fit, or the state where the table ends."""
    def evaluate(b):
        s0, s1, s2, e0, e1, e2, d, x_sum, eta = table.sums(b)
        on = d > 0
        return likelihood(s0[on], s1[on], s2[on], e0[on], e1[on], e2[on], d[on], x_sum[on], eta[on], efron)

    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        fit = climb(state, evaluate, table.near)
    return json.dumps({"state": state} if fit is None else {"fit": _fit_text(fit)})


def _checked(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """The written table; an error where a model's rows are too many for a task, since then times are no days."""
    table = settle(table, "moments")
    most = table.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if most > mo.MAX_ROWS:
        raise ValueError(f"{most} distinct times and factor cells in one model, more than {mo.MAX_ROWS}: round times to days")
    return table


class _Scale:
    """Centre and largest distance of numeric covariates (``x{j}``), by model."""

    def __init__(self, head: dict, numeric: Sequence[int], p: int) -> None:
        self.numeric = list(numeric)
        self.centre = {m: [r[f"c{j}"] for j in numeric] for m, r in head.items()}
        self.width = {m: [_spread(r[f"c{j}"], r[f"least{j}"], r[f"most{j}"]) for j in numeric] for m, r in head.items()}
        self.full = {m: np.ones(p) for m in head}
        for m in head:
            self.full[m][self.numeric] = self.width[m]

    @staticmethod
    def aggregates(numeric: Sequence[int]) -> list[Column]:
        mean = lambda j: F.sum(F.col("m") * F.col(f"x{j}")) / F.sum("m")
        return [
            *(mean(j).alias(f"c{j}") for j in numeric),
            *(f(f"x{j}").alias(f"{n}{j}") for j in numeric for n, f in (("least", F.min), ("most", F.max))),
        ]

    def moments(self, rows: DataFrame, anchors: dict, cell: Sequence[str]) -> DataFrame:
        """Moment tables of the models in ``anchors`` (their numeric coefficients)."""
        q = range(len(self.numeric))
        names = ["model", *[f"{c}{i}" for c in "_c _r _a".split() for i in q]]
        known = [(m, *map(float, [*self.centre[m], *self.width[m], *a])) for m, a in anchors.items()]
        joined = rows.join(small_frame(rows.sparkSession, known, names, ["string", *["double"] * (len(names) - 1)]), "model")
        z = {f"z{i}": (F.col(f"x{j}") - F.col(f"_c{i}")) / F.col(f"_r{i}") for i, j in enumerate(self.numeric)}
        sums = mo.moment_sums([F.col(c) for c in z], [F.col(f"_a{i}") for i in q], F.col("m"))
        return mo.moment_table(joined.withColumns(z) if z else joined, ["model"], cell, sums)

    def back(self, m, fit: Fit) -> Fit:
        """The fit in the covariates' own units."""
        fit.beta = fit.beta / self.full[m]
        fit.cov = None if fit.cov is None else fit.cov / np.outer(self.full[m], self.full[m])
        return fit


def _fit_tables(tables: DataFrame, states: dict, cell: Sequence[str], numeric: Sequence[int], efron: bool) -> dict:
    """One pass of all models over their tables, each in one task; a row per model comes back."""
    anchors = {m: [s["b"][j] for j in numeric] for m, s in states.items()}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        table = mo.Table.from_pandas(pdf, cell, anchors[key[0]], numeric)
        return pd.DataFrame({"model": [key[0]], "found": [_table_fit(table, states[key[0]], efron)]})

    rows = tables.groupBy("model").applyInPandas(run, T.StructType([tables.schema["model"], T.StructField("found", T.StringType())]))
    return {r["model"]: json.loads(r["found"]) for r in rows.collect()}


# ---- models -------------------------------------------------------------------


def _fit_models(rows: DataFrame, scale: _Scale, p: int, efron: bool) -> tuple[dict, DataFrame | None, dict]:
    """Fits in scaled covariates of every model of ``scale``, with the last tables and their anchors; ``rows``: model, t, e,
    x0.., m."""
    cell = [f"x{j}" for j in range(p) if j not in scale.numeric]
    states = {m: new_state(p) for m in scale.centre}
    fits: dict = {}
    tables, anchors = None, {}
    while states:
        anchors = {m: [s["b"][j] for j in scale.numeric] for m, s in states.items()}
        tables = _checked(scale.moments(rows, anchors, cell), ["model"])
        found = _fit_tables(tables, states, cell, scale.numeric, efron)
        fits |= {m: _fit_of(f["fit"]) for m, f in found.items() if "fit" in f}
        states = {m: f["state"] for m, f in found.items() if "state" in f}
    return fits, tables, anchors


def cox(
    df: DataFrame,
    covariates: Sequence[Covariate],
    time: str = "t_days",
    event: str = "event",
    by: str | None = None,
    efron: bool = True,
) -> DataFrame:
    """One model, or one per value of ``by``, over complete rows; a row per model and term:
    ``model, term, level, n, n_event, coef, se, hr, lower, upper, z, p, loglik_null, loglik, status``.
    A model that does not converge has null estimates; ``status`` (see ``Fit``) says why.  A value outside a
    factor's levels makes a row incomplete."""
    terms = [t for c in covariates for t in c.terms()]
    p = len(terms)
    xs = [f"x{j}" for j in range(p)]
    numeric = [j for j, (_, level) in enumerate(terms) if level is None]
    model = F.col(by).cast("string") if by else F.lit("all")
    frame = df.select(
        model.alias("model"),
        F.col(time).alias("t"),
        F.col(event).cast("int").alias("e"),
        *[c.alias(x) for c, x in zip(_design(covariates), xs)],
    ).dropna()
    # numeric covariates: the narrow table is written as it is; factors alone: it is counted at once
    one = F.lit(1.0).alias("m")
    rows = frame.select("*", one) if numeric else frame.groupBy("model", "t", "e", *xs).agg(F.sum(F.lit(1.0)).alias("m"))
    rows = settle(rows, "cox")
    head = rows.groupBy("model").agg(
        F.sum("m").alias("n"),
        F.sum(F.col("m") * F.col("e")).alias("n_event"),
        *_Scale.aggregates(numeric),
        *[F.sum(F.col("m") * F.col(f"x{j}")).alias(f"k{j}") for j in range(p) if j not in numeric],
    ).collect()  # one row per model
    info = {r["model"]: r for r in head if r["n_event"] > 0}
    scale = _Scale(info, numeric, p)
    fits, _, _ = _fit_models(rows, scale, p, efron)
    out = []
    for m in sorted(info):
        fit = scale.back(m, fits[m])
        for j, (name, level) in enumerate(terms):
            n_level = info[m]["n"] if level is None else info[m][f"k{j}"]
            out.append(_term_row(m, name, level, n_level, info[m]["n_event"], fit, j))
    return small_frame(df.sparkSession, out, TERM_COLUMNS, TERM_TYPES)


TERM_COLUMNS = [
    "model", "term", "level", "n", "n_event", "coef", "se", "hr", "lower", "upper", "z", "p",
    "loglik_null", "loglik", "status",
]
TERM_TYPES = ["string", "string", "string", "long", "long", *["double"] * 9, "string"]


def _term_row(model, name, level, n, events, fit: Fit, j: int) -> tuple:
    if not fit.converged or fit.cov is None:
        numbers = (None,) * 7
    else:
        b, se = float(fit.beta[j]), math.sqrt(fit.cov[j, j])
        z = b / se
        numbers = (
            b, se, math.exp(b), math.exp(b - Z95 * se), math.exp(b + Z95 * se), z, normal_two_sided(z),
        )
    return (model, name, level or "", int(n), int(events), *numbers, fit.ll0, fit.ll, fit.status)


def model_table(df: DataFrame, covariates: Sequence[Covariate], fitted: DataFrame, time: str = "t_days", event: str = "event") -> DataFrame:
    """Numbers behind a forest plot: every level with its count, reference levels with
    hazard ratio 1, and the model's AIC, over the complete rows."""
    design = [F.col(c.column) for c in covariates] + [F.col(time), F.col(event)]
    complete = df
    for col in design:
        complete = complete.where(col.isNotNull())
    factors = [c for c in covariates if c.levels]
    pieces = [F.struct(F.lit(c.column).alias("term"), F.col(c.column).alias("level")) for c in factors]
    counts = complete.select(F.explode(F.array(*pieces)).alias("x")).groupBy("x.term", "x.level").agg(
        F.count(F.lit(1)).alias("n_level")
    )
    order = [(c.column, v, i) for c in factors for i, v in enumerate(c.levels)]
    frame = small_frame(df.sparkSession, order, ["term", "level", "place"]).join(
        counts, ["term", "level"], "left"
    )
    p = sum(len(c.terms()) for c in covariates)
    est = fitted.select("term", "level", "hr", "lower", "upper", "p", "loglik")
    rows = frame.join(est, ["term", "level"], "left").select(
        "term", "level", "place", F.coalesce("n_level", F.lit(0)).alias("n"),
        F.when(F.col("place") == 0, F.lit(1.0)).otherwise(F.col("hr")).alias("hr"), "lower", "upper", "p",
    )
    plain = est.where(F.col("level") == "").select(
        "term", "level", F.lit(0).cast("long").alias("place"),
        complete.agg(F.count(F.lit(1))).scalar().alias("n"), "hr", "lower", "upper", "p",
    )
    ll = fitted.agg(F.max("loglik")).scalar()
    return rows.unionByName(plain).withColumns({"loglik": ll, "aic": -2 * ll + 2 * p})


def linear_predictor(covariates: Sequence[Covariate], fitted: DataFrame) -> Column:
    """The score of a row under one fitted model; null where an estimate or a covariate is missing."""
    coef = {(r["term"], r["level"]): r["coef"] for r in fitted.select("term", "level", "coef").collect()}  # a row per term
    terms = [t for c in covariates for t in c.terms()]
    score = F.lit(0.0)
    for x, (name, level) in zip(_design(covariates), terms, strict=True):
        score = score + F.lit(coef[name, level or ""]).cast("double") * x
    return score


def hr_text(hr: Column, lower: Column, upper: Column) -> Column:
    """``HR 1.23 [1.05;1.44]``."""
    return F.format_string("HR %.2f [%.2f;%.2f]", hr, lower, upper)


# ---- screens over many exposure classes ---------------------------------------


def binary_cox(t, n1, d1, all_t, all_n, all_d, efron: bool = True):
    """Fit of exposed against unexposed from day counts."""
    at = {day: i for i, day in enumerate(all_t)}
    n1_all, d1_all = np.zeros(len(all_t)), np.zeros(len(all_t))
    for day, n, d in zip(t, n1, d1):
        n1_all[at[day]] = n
        d1_all[at[day]] = d
    order = np.argsort(all_t)[::-1]
    n, d = np.asarray(all_n, float)[order], np.asarray(all_d, float)[order]
    n1_all, d1_all = n1_all[order], d1_all[order]
    r1, r0 = n1_all.cumsum(), (n - n1_all).cumsum()
    on = d > 0
    r1, r0, d, d1 = r1[on], r0[on], d[on], d1_all[on]
    if d1.sum() in (0.0, d.sum()):  # no event in one arm: the estimate is infinite
        return Fit(np.zeros(1), None, math.nan, math.nan, 0, False, "separated")

    def evaluate(betas):
        b = betas[0][0]
        w = math.exp(b)
        s1, e1 = r1 * w, d1 * w
        got = likelihood(
            r0 + s1, s1[:, None], s1[:, None, None],
            (d - d1) + e1, e1[:, None], e1[:, None, None],
            d, d1[:, None], d1 * b, efron,
        )
        return {0: got}

    return newton([0], 1, evaluate)[0]


def screen(
    exposure: DataFrame,
    outcome: DataFrame,
    classes: Sequence[str] | None = None,
    key: str = "patientid",
    time: str = "t_days",
    event: str = "event",
    efron: bool = True,
) -> DataFrame:
    """One unadjusted model per exposure class, all in one job.

    The sums a model needs do not depend on the coefficient: counts of exposed per
    (class, day) and of all per day.  Both are bounded by the days of follow-up, so each
    class is one row holding two short arrays, and the fit runs on that row.
    """
    known = outcome.where(F.col(time).isNotNull() & F.col(event).isNotNull()).select(
        key, F.col(time).alias("t"), F.col(event).cast("int").alias("e")
    )
    exposed = exposure.select(key, "atc3").where(F.col("atc3").isNotNull())
    if classes is not None:
        exposed = exposed.where(F.col("atc3").isin(list(classes)))
    n, d = F.count(F.lit(1)).cast("double"), F.sum("e").cast("double")
    per_day = exposed.distinct().join(known, key).groupBy("atc3", "t").agg(n.alias("n"), d.alias("d"))
    cell = F.struct("t", "n", "d")
    total = known.groupBy("t").agg(n.alias("n"), d.alias("d")).agg(F.collect_list(cell)).scalar()
    rows = (
        per_day.groupBy("atc3")
        .agg(F.collect_list(cell).alias("exposed"), F.sum("n").cast("long").alias("n"), F.sum("d").cast("long").alias("n_event"))
        .withColumn("everyone", total)
    )
    schema = (
        "atc3 string, n long, n_event long, coef double, se double, hr double, lower double, "
        "upper double, z double, p double, status string"
    )

    def fit_rows(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                every = list(zip(*[(c["t"], c["n"], c["d"]) for c in r.everyone]))
                mine = list(zip(*[(c["t"], c["n"], c["d"]) for c in r.exposed]))
                fit = binary_cox(*mine, *every, efron)
                out.append((r.atc3, *_term_row("", "", "", r.n, r.n_event, fit, 0)[3:12], fit.status))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return rows.mapInPandas(fit_rows, schema)


def screen_adjusted(
    exposure: DataFrame,
    outcome: DataFrame,
    covariates: Sequence[Covariate],
    classes: Sequence[str] | None = None,
    key: str = "patientid",
    time: str = "t_days",
    event: str = "event",
    efron: bool = True,
) -> DataFrame:
    """One model per class, adjusted for covariates; the row of the class term.

    The model of the covariates alone is fitted first; the classes start at its estimate, on its last table.  Two moment tables hold
    the rest: everyone's, which goes to the tasks whole (at most ``MAX_ROWS`` rows), and that of the exposed per
    class, from one join.  A model is everyone as unexposed, its exposed as exposed, and its exposed as unexposed taken off; it
    is fitted in one task on tables whose size the cohort does not touch.  Subjects are never repeated per class.
    """
    spark = outcome.sparkSession
    terms = [t for c in covariates for t in c.terms()]
    p = len(terms)
    xs = [f"x{j}" for j in range(p)]
    numeric = [j for j, (_, level) in enumerate(terms) if level is None]
    cell = [x for j, x in enumerate(xs) if j not in numeric]
    known = outcome.select(
        key,
        F.col(time).alias("t"),
        F.col(event).cast("int").alias("e"),
        *[c.alias(x) for c, x in zip(_design(covariates), xs)],
    ).dropna()
    known = settle(known.select("*", F.lit("all").alias("model"), F.lit(1.0).alias("m")), "screen")
    head = known.groupBy("model").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("e")).alias("n_event"), *_Scale.aggregates(numeric))
    scale = _Scale({r["model"]: r for r in head.collect() if r["n_event"] > 0}, numeric, p)
    names = ["atc3", "n", "n_event", "coef", "se", "hr", "lower", "upper", "z", "p", "status"]
    kinds = ["string", "long", "long", *["double"] * 7, "string"]
    if not scale.centre:
        return small_frame(spark, [], names, kinds)
    base, tables, anchors = _fit_models(known, scale, p, efron)
    picked = exposure.select(key, F.col("atc3").alias("class")).where(F.col("atc3").isNotNull())
    picked = picked if classes is None else picked.where(F.col("atc3").isin(list(classes)))
    own_rows = picked.distinct().join(known, key)
    sizes: dict = {}
    fits: dict = {}

    def one_pass(everyone: DataFrame, anchor: list[float], states: dict, only: str | None = None) -> dict:
        """All classes, or one, with tables anchored at ``anchor``; the states of classes that leave the tables' reach."""
        table = mo.Table.from_pandas(everyone.drop("model").toPandas(), cell, anchor, numeric)
        shared = spark.sparkContext.broadcast(table)
        rows = own_rows if only is None else own_rows.where(F.col("class") == only)
        z = {f"z{i}": (F.col(f"x{j}") - float(scale.centre["all"][i])) / float(scale.width["all"][i]) for i, j in enumerate(numeric)}
        sums = mo.moment_sums([F.col(c) for c in z], [F.lit(a) for a in anchor], F.col("m"))
        own = mo.moment_table(rows.withColumns(z) if z else rows, ["class"], cell, sums)
        begin = np.array(base["all"].beta)
        if not (base["all"].converged and table.near(begin)):
            begin = np.zeros(p)
            begin[numeric] = anchor
        first = new_state(p + 1) | {"b": [*map(float, begin), 0.0]}

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            mine = mo.Table.from_pandas(pdf, cell, anchor, numeric)
            state = states.get(key[0]) or dict(first)
            found = _table_fit(shared.value.exposed(mine), state, efron)
            n, d = float(mine.n.sum()), float((mine.n * mine.e).sum())
            return pd.DataFrame({"class": [key[0]], "n": [n], "n_event": [d], "found": [found]})

        done = own.groupBy("class").applyInPandas(run, "class string, n double, n_event double, found string").collect()
        left = {}
        for r in done:  # one row per class
            sizes[r["class"]] = (r["n"], r["n_event"])
            found = json.loads(r["found"])
            if "fit" in found:
                fits[r["class"]] = _fit_of(found["fit"])
            else:
                left[r["class"]] = found["state"]
        return left

    left = one_pass(tables, anchors["all"], {})
    while left:  # a class that moves the covariates far from the shared anchor gets tables of its own
        name = min(left)
        state = left.pop(name)
        anchor = [float(state["b"][j]) for j in numeric]
        left |= one_pass(_checked(scale.moments(known, {"all": anchor}, cell), ["model"]), anchor, {name: state}, name)
    full = scale.full["all"]
    scale.full["all"] = np.append(full, 1.0)
    out = [(c, *_term_row("", "", "", *sizes[c], scale.back("all", fits[c]), p)[3:12], fits[c].status) for c in sorted(fits)]
    return small_frame(spark, out, names, kinds)
