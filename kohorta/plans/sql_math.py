"""SQL twins of the statistics: normal tail, log-rank and Newton steps as plain statements."""

from __future__ import annotations

from collections.abc import Sequence

STEPS = 10
Z95 = "1.959963984540054"


def normal_p_sql(z: str) -> str:
    """Two-sided normal p-value by Simpson's rule on 400 panels."""
    f = f"exp(-power(abs({z}) * i / 400.0, 2) / 2)"
    weight = "CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    area = f"list_sum(list_transform(range(0, 401), lambda i: {weight} * {f})) * abs({z}) / 1200.0"
    return f"greatest(0.0, 1 - sqrt(2 / pi()) * {area})"


def chi_square_p_sql(x: str, dof: int) -> str:
    if dof == 1:
        return normal_p_sql(f"sqrt({x})")
    if dof == 2:
        return f"exp(-({x}) / 2)"
    if dof == 3:
        return f"({normal_p_sql(f'sqrt({x})')} + sqrt(2 * ({x}) / pi()) * exp(-({x}) / 2))"
    raise ValueError("up to three degrees of freedom only")


def logrank_sql(source: str, group: str, levels: Sequence[str], by: str | None = None) -> str:
    """Log-rank test of two to four groups."""
    k = len(levels)
    b = f'{by} AS "{by}", ' if by else ""
    part = f"PARTITION BY {by} " if by else ""
    counts = ", ".join(
        f"CAST(count(*) FILTER (WHERE {group} = '{v}') AS DOUBLE) AS n{i}, "
        f"CAST(coalesce(sum(event) FILTER (WHERE {group} = '{v}'), 0) AS DOUBLE) AS d{i}"
        for i, v in enumerate(levels)
    )
    risk = ", ".join(f"sum(n{i}) OVER ({part}ORDER BY t DESC) AS r{i}" for i in range(k))
    d = " + ".join(f"d{i}" for i in range(k))
    n = " + ".join(f"r{i}" for i in range(k))
    sums = ", ".join(f"sum(d{i}) AS o{i}, sum(d * r{i} / n) AS x{i}" for i in range(k))
    spread = "CASE WHEN n > 1 THEN d * (n - d) / (n - 1) ELSE 0 END"
    var = ", ".join(
        f"sum({spread} * r{i} / n * ({1 if i == j else 0} - r{j} / n)) AS v{i}{j}"
        for i in range(k - 1)
        for j in range(i, k - 1)
    )
    det, inv = _inverse(k - 1, "v")
    stat = "(" + " + ".join(
        f"(o{i} - x{i}) * {inv[i, j]} * (o{j} - x{j})" for i in range(k - 1) for j in range(k - 1)
    ) + f") / {det}"
    out = ", ".join(f"o{i} AS observed{i}, round(x{i}, 6) AS expected{i}" for i in range(k))
    names = ", ".join(f"'{v}'" for v in levels)
    grouped = f"GROUP BY {by}" if by else ""
    by_col = f"{by}, " if by else ""
    return f"""
SELECT {by_col.replace(f"{by}", f'"{by}"') if by else ""}{out}, round(chi, 6) AS chi_square, CAST({k - 1} AS BIGINT) AS dof, round({chi_square_p_sql("chi", k - 1)}, 6) AS p
FROM (SELECT *, {stat} AS chi FROM (SELECT {b}{sums}, {var} FROM (SELECT *, {d} AS d, {n} AS n FROM (
  SELECT *, {risk} FROM (SELECT {by_col}t_days AS t, {counts} FROM {source} WHERE {group} IN ({names})
    GROUP BY {by_col}t_days))) WHERE d > 0 {grouped}))"""


def _minor(rows: list[int], cols: list[int], name: str) -> str:
    """Determinant of a part of a symmetric matrix ``name``, as text."""
    if not rows:
        return "1.0"
    out = []
    for at, c in enumerate(cols):
        sign = "-" if at % 2 else "+"
        i, j = sorted((rows[0], c))
        out.append(f"{sign} {name}{i}{j} * ({_minor(rows[1:], cols[:at] + cols[at + 1:], name)})")
    return "(" + " ".join(out).lstrip("+ ") + ")"


def _inverse(p: int, name: str = "i") -> tuple[str, dict[tuple[int, int], str]]:
    """Determinant and cofactors; the inverse is cofactor over determinant."""
    every = list(range(p))
    cells = {}
    for j in every:
        for k in every:
            sign = "-" if (j + k) % 2 else ""
            cells[j, k] = f"({sign}{_minor([r for r in every if r != k], [c for c in every if c != j], name)})"
    return _minor(every, every, name), cells


def cox_sql(frame: str, terms: Sequence[tuple[str, str]], steps: int = STEPS, digits: int = 4) -> str:
    """Efron proportional hazards for ``frame`` (model, t, e, x0..), Newton steps unrolled.

    One row per model and term with coefficient, standard error, ratio, limits, z and p,
    steps are cut to 1.5 against overshooting; to ``digits`` decimals (the two sides stop their iterations at different points).
    """
    p = len(terms)
    js = range(p)
    pairs = [(j, k) for j in js for k in range(j, p)]
    eta = " + ".join(f"b.b{j} * f.x{j}" for j in js)
    w_cols = ["sum(w) AS s", "sum(e * w) AS q", "CAST(sum(e) AS DOUBLE) AS d"]
    for j in js:
        w_cols += [f"sum(w * x{j}) AS s{j}", f"sum(e * w * x{j}) AS q{j}", f"sum(e * x{j}) AS z{j}"]
    for j, k in pairs:
        w_cols += [f"sum(w * x{j} * x{k}) AS s{j}{k}", f"sum(e * w * x{j} * x{k}) AS q{j}{k}"]
    running = ["s", *[f"s{j}" for j in js], *[f"s{j}{k}" for j, k in pairs]]
    fixed = ["q", "d", *[f"q{j}" for j in js], *[f"z{j}" for j in js], *[f"q{j}{k}" for j, k in pairs]]
    run = ", ".join(f"sum({c}) OVER (PARTITION BY model ORDER BY t DESC) AS {c}" for c in running)
    det, inv = _inverse(p)
    text = [f"f AS MATERIALIZED ({frame})", f"b0 AS (SELECT DISTINCT model, {', '.join(f'CAST(0 AS DOUBLE) AS b{j}' for j in js)} FROM f)"]
    for step in range(steps + 1):
        thin = ", ".join(f"{c} - l / d * {c.replace('s', 'q', 1)} AS {c}" for c in running)
        grad = ", ".join(f"sum(z{j} / d - s{j} / s) AS g{j}" for j in js)
        info = ", ".join(f"sum(s{j}{k} / s - s{j} * s{k} / (s * s)) AS i{j}{k}" for j, k in pairs)
        text.append(f"""g{step} AS MATERIALIZED (SELECT model, {grad}, {info} FROM (
  SELECT model, d, {", ".join(f"z{j}" for j in js)}, {thin} FROM (
    SELECT *, unnest(range(0, CAST(d AS BIGINT))) AS l FROM (
      SELECT model, t, {", ".join(fixed)}, {run} FROM (
        SELECT model, t, {", ".join(w_cols)} FROM (
          SELECT f.*, exp({eta}) AS w FROM f JOIN b{step} b ON b.model = f.model) GROUP BY model, t)) WHERE d > 0))
GROUP BY model)""")
        if step < steps:
            moved = ", ".join(
                f"b.b{j} + greatest(-1.5, least(1.5, ({' + '.join(f'{inv[j, k]} * g{k}' for k in js)}) / {det})) AS b{j}"
                for j in js
            )
            text.append(
                f"b{step + 1} AS MATERIALIZED (SELECT b.model, {moved} FROM b{step} b JOIN g{step} g ON g.model = b.model)"
            )
    rows = " UNION ALL ".join(
        f"SELECT b.model, '{name}' AS term, '{level}' AS level, b.b{j} AS coef, sqrt({inv[j, j]} / {det}) AS se "
        f"FROM b{steps} b JOIN g{steps} g ON g.model = b.model"
        for j, (name, level) in enumerate(terms)
    )
    return f"""WITH {", ".join(text)}
SELECT model, term, level, round(coef, {digits}) AS coef, round(se, {digits}) AS se, round(exp(coef), {digits}) AS hr,
  round(exp(coef - {Z95} * se), {digits}) AS lower, round(exp(coef + {Z95} * se), {digits}) AS upper, round(coef / se, {digits}) AS z,
  round({normal_p_sql("(coef / se)")}, {digits}) AS p FROM ({rows})"""
