"""Queries on index events, exposure, laboratory values, scores and registers."""

from __future__ import annotations

from pyspark.sql import functions as F

from kohorta.functions.bins import PROGNOSTIC_LEVELS, at_least
from kohorta.functions.text import small_cell
from kohorta.operators import exposure as ex
from kohorta.operators import keyed, registers, scores
from kohorta.operators.bitmaps import class_bitmaps, class_domain, subject_numbers, subjects_per_class
from kohorta.operators.index import first_diagnosis, index_table, label_by_codes
from kohorta.operators.nearest import nearest_values, own_or_nearest
from kohorta.operators.ordered import fill
from kohorta.plans.registry import query
from kohorta.plans.views import ANALYTES, DISEASES, HIERARCHY, ICD_GROUPS, ICD_WEIGHTS, INDEX_CODES, Clinic
from kohorta.session import scratch_path, settle
from kohorta.sources import codes, csv


@query("""
SELECT patientid, CAST(date_diagnosis AS VARCHAR) AS date_diagnosis, diagnosis, dx_id FROM idx""")
def first_diagnosis_(c: Clinic):
    return first_diagnosis(c.dx, INDEX_CODES, tie=["dx_id"])


@query("""
SELECT patientid, diagnosis, CASE WHEN diagnosis IN ('2-HIGH', '3-MEDIUM') THEN 'late'
  WHEN diagnosis = '1-URGENT' THEN 'early' END AS Disease FROM dx""")
def disease_label(c: Clinic):
    lists = {"early": ["1-URGENT", "2-HIGH"], "late": ["2-HIGH", "3-MEDIUM"]}
    return label_by_codes(c.dx, lists).select("patientid", "diagnosis", "Disease")


@query("""
SELECT o.patientid, o.Disease, CAST(o.date_diagnosis AS VARCHAR) AS date_diagnosis,
  round(o.t_days / 365.25, 6) AS time_dx_death, round(o.age, 6) AS "Age", g.IPI, g.PS
FROM outcome o LEFT JOIN prognosis g ON g.patientid = o.patientid AND g.Disease = o.Disease""")
def index_table_(c: Clinic):
    prognosis = c.prognosis.drop("sex")
    return index_table(c.index, DISEASES, c.subjects, prognosis).select(
        "patientid", "Disease", "date_diagnosis", "time_dx_death", "Age", "IPI", "PS"
    )


@query("""
SELECT atc, count(*) AS n FROM (SELECT CASE l_linenumber WHEN 5 THEN 'X' WHEN 6 THEN NULL ELSE atc END AS atc FROM rx)
WHERE atc IS NULL OR atc <> 'X' GROUP BY atc""")
def rx_clean(c: Clinic):
    line, atc = F.col("l_linenumber"), F.col("atc")
    dirty = (
        F.when(line == 1, F.concat(F.lit(":"), atc))
        .when(line == 2, F.concat(F.lit("XXX"), atc, F.lit("_")))
        .when(line == 3, F.concat(F.lit("Å"), atc, F.lit("ÅÅ")))
        .when(line == 5, F.lit("X"))
        .when(line == 6, F.lit(None))
        .otherwise(atc)
    )
    raw = c.rx.withColumn("atc", dirty)
    return ex.harmonise_dispensings(raw).groupBy("atc").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT p.patientid, coalesce(n.n, 0) AS n_rx FROM patient p LEFT JOIN (
  SELECT patientid, count(*) AS n FROM (SELECT DISTINCT patientid, date, atc FROM rx) GROUP BY patientid) n
ON n.patientid = p.patientid""")
def rx_per_patient(c: Clinic):
    distinct = c.rx.select("patientid", "date", "atc").distinct()
    counts = distinct.groupBy("patientid").agg(F.count(F.lit(1)).alias("n_rx"))
    return keyed.keep_cohort(c.patient.select("patientid"), counts, "patientid", zeros=["n_rx"])


@query("""
SELECT patientid, count(DISTINCT icd10) AS n_dx FROM icd GROUP BY patientid""")
def dx_distinct_per_patient(c: Clinic):
    return keyed.distinct_levels(c.icd, ["patientid"], "icd10", "n_dx")


@query("SELECT patientid, n_atc, polypharmacy FROM poly")
def polypharmacy(c: Clinic):
    return c.poly.select("patientid", "n_atc", "polypharmacy")


@query("""
SELECT i.patientid, coalesce(n.n, 0) AS n_atc, CASE WHEN coalesce(n.n, 0) < 5 THEN 'No' ELSE 'Yes' END AS polypharmacy
FROM idx i LEFT JOIN (SELECT patientid, count(DISTINCT atc) AS n FROM lookback WHERE days <= -30 GROUP BY patientid) n
ON n.patientid = i.patientid""")
def polypharmacy_gap30(c: Clinic):
    return ex.polypharmacy(c.index, c.rx, gap_days=30).select("patientid", "n_atc", "polypharmacy")


@query("""
SELECT atc_bin, polypharmacy, count(*) AS n, min(n_atc) AS low, max(n_atc) AS high FROM poly
WHERE date_diagnosis >= DATE '1996-01-01' AND date_diagnosis <= (SELECT max(date) FROM rx) GROUP BY ALL""")
def atc_bins(c: Clinic):
    inside = ex.study_period(c.index, "1996-01-01", ex.last_date(c.rx))
    counted = ex.with_drug_bins(ex.polypharmacy(inside, c.rx))
    return counted.groupBy("atc_bin", "polypharmacy").agg(
        F.count(F.lit(1)).alias("n"), F.min("n_atc").alias("low"), F.max("n_atc").alias("high")
    )


@query("SELECT patientid, atc3, n FROM exposure")
def class_exposure_long(c: Clinic):
    return ex.class_exposure(ex.lookback(c.index, c.rx))


@query("""
SELECT * FROM (PIVOT (SELECT i.patientid, e.atc3 FROM idx i LEFT JOIN exposure e ON e.patientid = i.patientid)
ON atc3 USING coalesce(max('Yes'), 'No') GROUP BY patientid)""")
def class_exposure_wide(c: Clinic):
    return ex.class_wide(c.index.select("patientid"), c.exposure, class_domain(c.exposure))


@query("""
SELECT atc3, count(*) AS n_patients, round(count(*) / (SELECT count(*) FROM idx), 6) AS freq
FROM exposure GROUP BY atc3""")
def class_prevalence(c: Clinic):
    size = c.index.agg(F.count_distinct("patientid")).scalar()
    return ex.class_prevalence(c.exposure, size)


@query("""
SELECT atc3, count(*) AS n FROM exposure WHERE atc3 IS NOT NULL GROUP BY atc3""")
def class_yes_counts(c: Clinic):
    return subjects_per_class(class_bitmaps(c.exposure, subject_numbers(c.index)))


@query("""
SELECT i.patientid, n.value, CAST(n.date AS VARCHAR) AS date FROM idx i LEFT JOIN (
  SELECT patientid, value, date FROM (SELECT l.*, row_number() OVER (PARTITION BY l.patientid
      ORDER BY abs(l.date - i.date_diagnosis), l.date, l.value) AS rn
    FROM labs l JOIN idx i ON i.patientid = l.patientid
    WHERE npu = 'AF' AND l.date BETWEEN i.date_diagnosis - 30 AND i.date_diagnosis + 30) WHERE rn = 1) n
ON n.patientid = i.patientid""")
def nearest_lab(c: Clinic):
    near = nearest_values(c.index, c.labs, {"af": ["AF"]}, with_dates=True)
    return near.select("patientid", F.col("af_value").alias("value"), F.col("date_af").alias("date"))


@query("""
SELECT patientid, coalesce(CASE WHEN patientid % 3 = 0 THEN 40.5 END, round(alb, 6)) AS alb,
  CASE WHEN b2m IS NULL THEN NULL WHEN b2m < 4.0 THEN '<4.0 mg/L' ELSE '>4.0 mg/L' END AS b2m_class FROM at_index""")
def lab_imputed(c: Clinic):
    own = c.at_index.withColumn("own", F.when(F.col("patientid") % 3 == 0, F.lit(40.5)))
    return own_or_nearest(own, {"own": "alb"}).select(
        "patientid", F.col("own").alias("alb"), at_least(F.col("b2m"), 4.0, "<4.0 mg/L", ">4.0 mg/L").alias("b2m_class")
    )


@query(f"""
SELECT patientid, {", ".join(f"round({a}, 6) AS {a}" for a in ANALYTES)} FROM at_index""")
def lab_nearest_multi(c: Clinic):
    return c.at_index.select("patientid", *ANALYTES)


@query("""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE cents / 100 END AS value2
FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem)""")
def lab_value_clean(c: Clinic):
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    number = F.concat(
        (F.expr("cents div 100")).cast("string"), F.lit(","), F.lpad((F.col("cents") % 100).cast("string"), 2, "0")
    )
    line = F.col("l_linenumber")
    text = (
        F.when(line == 1, F.concat(F.lit("<"), number))
        .when(line == 2, F.concat(F.lit("ca. "), number, F.lit(" mg")))
        .when(line == 3, F.regexp_replace(number, ",", "."))
        .when(line == 7, F.lit("not done"))
        .otherwise(number)
    )
    raw = c.table("lineitem", "l_orderkey", "l_linenumber", "l_extendedprice").withColumn("cents", cents)
    return registers.clean_lab_values(raw.withColumn("value", text)).select("l_orderkey", "l_linenumber", "value2")


@query("""
SELECT patientid, iss, ldh_high, fish, add_on, riss FROM mm_stage""")
def iss_riss(c: Clinic):
    items = c.at_index.withColumn("iss", scores.iss(F.col("iss_own"), F.col("alb"), F.col("b2m")))
    items = items.withColumns(
        {
            "ldh_high": scores.ldh_high(F.col("age"), F.col("ldh")),
            "fish": scores.any_yes(F.col("t4_14"), F.col("t14_16"), F.col("del17p")),
        }
    ).withColumn("add_on", scores.any_yes(F.col("ldh_high"), F.col("fish")))
    return items.withColumn("riss", scores.revised_iss(F.col("iss"), F.col("add_on"))).select(
        "patientid", "iss", "ldh_high", "fish", "add_on", "riss"
    )


@query("SELECT patientid, score, minus_b2m, minus_ighv, grp FROM cll_group")
def cll_ipi_override(c: Clinic):
    items = c.at_index.withColumn("ighv", F.coalesce("ighv", "ighv_lab"))
    scored = scores.point_score(items, scores.CLL_IPI, "score", without=["B2M", "IGHV"])
    named = scores.score_group(F.col("score"), [1, 3, 6], ["Low", "Intermediate", "High", "Very high"])
    return scored.select(
        "patientid",
        "score",
        F.col("score_minus_B2M").alias("minus_b2m"),
        F.col("score_minus_IGHV").alias("minus_ighv"),
        scores.override_cll(named, F.col("score_minus_B2M"), F.col("score_minus_IGHV")).alias("grp"),
    )


@query('SELECT patientid, sex, PS AS "PS", IPI AS "IPI", Disease AS "Disease" FROM prognosis')
def ipi_union(c: Clinic):
    scored = settle(c.scored.select("patientid", "sex", "PS", "Disease", "cll", "mm", "ripi"), "scored")
    by = lambda d, group: scored.where(F.col("Disease") == d).withColumn("IPI", F.col(group))
    parts = {"CLL": by("CLL", "cll"), "MM": by("MM", "mm"), "DLBCL": by("DLBCL", "ripi")}
    return scores.unify(parts, PROGNOSTIC_LEVELS)


@query("""
SELECT Disease AS "Disease", IPI AS "IPI2", CASE WHEN IPI IN ('Low', 'High') THEN IPI END AS "IPS",
  CASE WHEN IPI = 'Very high' THEN 'High' ELSE IPI END AS "IPI", count(*) AS n FROM prognosis GROUP BY ALL""")
def ipi_collapse(c: Clinic):
    return scores.collapse(c.prognosis).groupBy("Disease", "IPI2", "IPS", "IPI").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("""
SELECT patientid, CAST(malt AS BIGINT) AS malt, CASE WHEN malt <= 0 THEN 'Low' WHEN malt <= 1 THEN 'Intermediate' WHEN malt > 1 THEN 'High' END AS malt_group,
  CAST(ips AS BIGINT) AS ips, CASE WHEN ips <= 2 THEN 'Low' WHEN ips > 2 THEN 'High' END AS ips_group,
  CAST(wm AS BIGINT) AS wm, CASE WHEN wm IS NULL THEN NULL WHEN wm > 2 THEN 'High' WHEN wm = 2 OR age > 65 THEN 'Intermediate' ELSE 'Low' END AS wm_group,
  round(mipi, 6) AS mipi, CASE WHEN mipi < 5.7 THEN 'Low' WHEN mipi < 6.2 THEN 'Intermediate' WHEN mipi >= 6.2 THEN 'High' END AS mipi_group
FROM (SELECT patientid, age,
  CASE WHEN age >= 70 THEN 1 ELSE 0 END + CASE WHEN stage >= 3 THEN 1 ELSE 0 END
    + CASE WHEN ldh > 205 THEN 1 WHEN ldh <= 205 THEN 0 END AS malt,
  CASE WHEN alb < 40 THEN 1 WHEN alb >= 40 THEN 0 END + CASE WHEN hb < 105 THEN 1 WHEN hb >= 105 THEN 0 END
    + CASE WHEN sex = 'M' THEN 1 ELSE 0 END + CASE WHEN age >= 45 THEN 1 ELSE 0 END
    + CASE WHEN stage >= 4 THEN 1 ELSE 0 END + CASE WHEN wbc >= 15 THEN 1 WHEN wbc < 15 THEN 0 END
    + CASE WHEN alc < 0.6 THEN 1 WHEN alc >= 0.6 THEN 0 END AS ips,
  CASE WHEN age > 65 THEN 1 ELSE 0 END + CASE WHEN hb <= 115 THEN 1 WHEN hb > 115 THEN 0 END
    + CASE WHEN wbc * 10 <= 100 THEN 1 WHEN wbc * 10 > 100 THEN 0 END
    + CASE WHEN b2m > 3 THEN 1 WHEN b2m <= 3 THEN 0 END + CASE WHEN alc * 20 > 70 THEN 1 WHEN alc * 20 <= 70 THEN 0 END AS wm,
  0.03535 * age + CASE WHEN ps > 1 THEN 0.6978 WHEN ps <= 1 THEN 0 END + 1.367 * log10(ldh / 205)
    + 0.9393 * log10(wbc / 0.001) AS mipi FROM at_index)""")
def point_score(c: Clinic):
    items = c.at_index.withColumns(
        {"ldh_ratio": F.col("ldh") / 205, "plt": F.col("wbc") * 10, "igm": F.col("alc") * 20}
    )
    for name, table in (("malt", scores.MALT_IPI), ("ips", scores.IPS), ("wm", scores.IPSSWM), ("mipi", scores.MIPI)):
        items = scores.point_score(items, table, name)
    three = ["Low", "Intermediate", "High"]
    return items.select(
        "patientid",
        "malt",
        scores.score_group(F.col("malt"), [0, 1], three).alias("malt_group"),
        "ips",
        scores.score_group(F.col("ips"), [2], ["Low", "High"]).alias("ips_group"),
        "wm",
        scores.ipsswm_group(F.col("wm"), F.col("age")).alias("wm_group"),
        "mipi",
        scores.score_group(F.col("mipi"), [5.7, 6.2], three, right_closed=False).alias("mipi_group"),
    )


@query("SELECT * FROM comorbidity")
def charlson(c: Clinic):
    groups = scores.code_groups(ex.history(c.index, c.icd), ICD_WEIGHTS)
    return scores.weighted_score(
        c.index.select("patientid"), groups, ICD_GROUPS, hierarchy=HIERARCHY, always=[("Cancer_and_Hem", 2, 2)]
    )


# the 17 groups of the 1987 index as patterns, written out for the SQL side alone
_PATTERNS_1987 = {
    "CHF": (1, "I099|I110|I130|I132|I255|I420|I42[5-9]|I43|I50|P290"), "Dementia": (1, "F0[0-3]|F051|G30|G311"),
    "CPD": (1, "I27[89]|J4[0-7]|J6[0-7]|J684|J701|J703"), "Rheumatic": (1, "M05|M06|M315|M3[2-4]|M351|M353|M360"),
    "Liver_Mild": (1, "B18|K70[0-3]|K709|K71[345]|K717|K73|K74|K760|K76[234]|K768|K769|Z944"),
    "Hemiplegia": (2, "G041|G114|G80[12]|G8[12]|G83[0-4]|G839"),
    "Renal": (2, "I120|I131|N03[2-7]|N05[2-7]|N18|N19|N250|Z49[0-2]|Z940|Z992"),
    "DM_w_compl": (2, "E1[0-4][23457]"), "Cancer_and_Hem": (2, "C[01]|C2[0-6]|C3[0-4]|C3[789]|C4[0135-9]|C5[0-8]|C6|C7[0-6]|C8[1-58]|C9[0-7]"),
    "Liver_Severe": (3, "I850|I859|I864|I982|K704|K711|K721|K729|K76[567]"), "Cancer_Metastatic": (6, "C77|C78|C79|C80"),
    "AIDS": (6, "B2[0124]"), "MI": (1, "I21|I22|I252"), "PVD": (1, "I70|I71|I731|I73[89]|I771|I790|I792|K551|K55[89]|Z95[89]"),
    "CVD": (1, "G45|G46|H340|I6"), "PUD": (1, "K2[5-8]"), "DM": (1, "E1[0-4][01689]"),
}
_SEVERE_1987 = {"Liver_Mild": "Liver_Severe", "Cancer_and_Hem": "Cancer_Metastatic", "DM": "DM_w_compl"}


def _charlson_1987_sql() -> str:
    flags = ", ".join(f"max(regexp_matches(d.icd10, '^D({p})')::BIGINT) AS \"f_{g}\"" for g, (_, p) in _PATTERNS_1987.items())
    counted = []
    for g, (w, _) in _PATTERNS_1987.items():
        free = f" AND \"f_{_SEVERE_1987[g]}\" = 0" if g in _SEVERE_1987 else ""
        counted.append(f"CASE WHEN \"f_{g}\" = 1{free} THEN {w} ELSE 0 END::BIGINT AS \"{g}\"")
    total = " + ".join(f'"{g}"' for g in _PATTERNS_1987)
    return f"""
SELECT *, CAST({total} AS BIGINT) AS cci_1987 FROM (SELECT patientid, {", ".join(counted)} FROM (
  SELECT i.patientid, {flags} FROM idx i JOIN icd d ON d.patientid = i.patientid
    AND d.date <= i.date_diagnosis AND d.date > DATE '1993-06-30' GROUP BY i.patientid))"""


@query(_charlson_1987_sql())
def charlson_1987(c: Clinic):
    """Subjects with a history after the register's start only, the own disease not forced."""
    prefixes, weights = codes.charlson_1987("D")
    coded = ex.history(c.index, c.icd, after="1993-06-30")
    return scores.group_index(
        c.index.select("patientid"), coded, prefixes, weights, codes.CHARLSON_SEVERE, need_history=True, score="cci_1987"
    )


# a made index over diagnosis and drug prefixes together
INDEX_WEIGHTS = [
    ("heart", "DI", 3, 2), ("lung", "DJ4", 2, 1), ("kidney", "DN18", 4, 5), ("statin", "E0", 1, 1),
    ("statin", "L1", 1, 1), ("pain", "M13", 2, 3), ("sleep", "S20AA", 1, 2),
]


@query(f"""
SELECT i.patientid, CAST(coalesce(sum(w), 0) AS BIGINT) AS index_score, CAST(coalesce(sum(u), 0) AS BIGINT) AS index_update
FROM idx i LEFT JOIN (
  SELECT patientid, grp, max(w) AS w, max(u) AS u FROM (
    SELECT e.patientid, v.grp, v.w, v.u FROM (
      SELECT d.patientid, d.icd10 AS code FROM icd d JOIN idx i ON i.patientid = d.patientid AND d.date <= i.date_diagnosis
      UNION ALL SELECT patientid, atc FROM lookback) e
    JOIN (VALUES {", ".join(str(r) for r in INDEX_WEIGHTS)}) AS v(grp, prefix, w, u) ON starts_with(e.code, v.prefix))
  GROUP BY patientid, grp) g ON g.patientid = i.patientid GROUP BY i.patientid""")
def weighted_index(c: Clinic):
    codes = ex.history(c.index, c.icd).select("patientid", F.col("icd10").alias("code")).unionByName(
        ex.lookback(c.index, c.rx).select("patientid", F.col("atc").alias("code"))
    )
    groups = scores.code_groups(codes, INDEX_WEIGHTS, code="code")
    return scores.weighted_score(
        c.index.select("patientid"), groups, score="index_score", update="index_update"
    )


@query("""
SELECT patientid, min(hospital_id) AS hospital_id FROM (
  SELECT o_custkey AS patientid, o_orderkey % 25 AS hospital_id FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT o_custkey, o_orderkey % 7 FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderkey % 3 <> 0
  UNION ALL SELECT o_custkey, NULL FROM orders WHERE o_orderpriority = '5-LOW') GROUP BY patientid""")
def hospital_first(c: Clinic):
    orders = c.table("orders", "o_custkey", "o_orderkey", "o_orderpriority").withColumnRenamed("o_custkey", "patientid")
    key, kind = F.col("o_orderkey"), F.col("o_orderpriority")
    return registers.hospital_per_subject(
        [
            orders.where(kind == "1-URGENT").withColumn("hospital_id", key % 25),
            orders.where((kind == "2-HIGH") & (key % 3 != 0)).withColumn("hospital_id", key % 7),
            orders.where(kind == "5-LOW").withColumn("hospital_id", F.lit(None).cast("long")),
        ]
    )


ANALYSIS = [
    "patientid", "Disease", "sex", "n_atc", "polypharmacy", "atc_bin", "cci_score", "cci_update", "cci_bin",
    "IPI", "PS", "hospital_id", "t_days", "status",
]
_ANALYSIS_SQL = ", ".join(f'{n} AS "{n}"' for n in ANALYSIS)


@query(f"SELECT {_ANALYSIS_SQL}, round(age, 6) AS age FROM analysis")
def analysis_table(c: Clinic):
    return c.analysis.select(*ANALYSIS, "age")


@query(f"""
SELECT {_ANALYSIS_SQL} FROM analysis WHERE IPI IS NOT NULL AND PS IS NOT NULL AND age IS NOT NULL AND t_days IS NOT NULL""")
def complete_case(c: Clinic):
    return c.analysis.dropna(subset=["IPI", "PS", "age", "t_days"]).select(*ANALYSIS)


@query("""
SELECT o_orderkey AS dx_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date_diagnosis,
  CASE o_orderstatus WHEN 'F' THEN 'CR' WHEN 'O' THEN 'PR' END AS response,
  CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4
    WHEN '5-LOW' THEN 5 END AS BIGINT) AS grade, CAST(floor(o_totalprice) AS BIGINT) AS cost
FROM orders""")
def register_clean(c: Clinic):
    raw = c.table("orders").withColumns(
        {"grade_text": F.left("o_orderpriority", F.lit(1)), "cost_text": F.floor("o_totalprice").cast("string")}
    )
    spec = {
        "dx_id": registers.Field("o_orderkey"),
        "date_diagnosis": registers.Field("o_orderdate", "date"),
        "response": registers.Field("o_orderstatus", labels={"F": "CR", "O": "PR"}, void=["P"]),
        "grade": registers.Field("grade_text", "int"),
        "cost": registers.Field("cost_text", "long"),
    }
    return registers.clean_register(raw, spec)


@query("""
SELECT CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN NULL
  WHEN o_orderstatus = 'P' THEN 'death' WHEN o_orderstatus = 'F' THEN 'CR' ELSE 'PD' END AS response, count(*) AS n
FROM orders GROUP BY 1""")
def response_recode(c: Clinic):
    raw = (
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 2 == 0), "not_performed")
        .when(F.col("o_orderstatus") == "P", "mors")
        .when(F.col("o_orderstatus") == "F", "CMR with residual mass")
        .otherwise("PD")
    )
    return c.table("orders", "o_orderkey", "o_orderstatus").groupBy(
        registers.clean_response(raw).alias("response")
    ).agg(F.count(F.lit(1)).alias("n"))


_SECOND = """
SELECT patientid, min(date_diagnosis) AS date_second FROM (
  SELECT d.* FROM dx d JOIN idx i ON i.patientid = d.patientid AND d.date_diagnosis > i.date_diagnosis + 200
  WHERE d.diagnosis = '4-NOT SPECIFIED') GROUP BY patientid"""


@query(f"""
SELECT o.patientid, CASE WHEN o.age > 70 THEN '>70' ELSE '<70' END AS aged70,
  CAST(coalesce(s.date_second, o.date_death_fu) AS VARCHAR) AS date_treatment_2nd_line_death,
  round((coalesce(s.date_second, o.date_death_fu) - o.date_diagnosis) / 365.25, 6) AS time_treatment_2nd_line,
  CAST(s.date_second IS NOT NULL AS BIGINT) AS relapse
FROM outcome o LEFT JOIN ({_SECOND}) s ON s.patientid = o.patientid""")
def time_to_next_treatment(c: Clinic):
    return _second_line(c).select(
        "patientid", F.when(F.col("age") > 70, ">70").otherwise("<70").alias("aged70"),
        "date_treatment_2nd_line_death", "time_treatment_2nd_line",
        F.col("date_second").isNotNull().cast("int").alias("relapse"),
    )


def _second_line(c: Clinic):
    start = c.index.select("patientid", F.col("date_diagnosis").alias("t0"))
    second = (
        c.dx.where(F.col("diagnosis") == "4-NOT SPECIFIED")
        .join(start, "patientid")
        .where(F.col("date_diagnosis") > F.date_add("t0", 200))
        .groupBy("patientid")
        .agg(F.min("date_diagnosis").alias("date_second"))
    )
    return registers.time_to_next_treatment(
        c.outcome.join(second, "patientid", "left"), "date_diagnosis", "date_second"
    )


@query(f"""
SELECT o.patientid, round((coalesce(s.date_second, o.date_death_fu) - o.date_diagnosis) / 365.25, 6) AS time_treatment_2nd_line
FROM outcome o LEFT JOIN ({_SECOND}) s ON s.patientid = o.patientid
WHERE o.Disease = 'MM' AND o.t_days <= 2000""")
def time_to_next_treatment_early(c: Clinic):
    treated = (F.col("Disease") == "MM") & (F.col("t_days") <= 2000)
    return _second_line(c).where(treated).select("patientid", "time_treatment_2nd_line")


@query("""
SELECT patientid, CAST(date_death_fu2 AS VARCHAR) AS date_death_fu2, round((date_death_fu2 - date_diagnosis) / 365.25, 6) AS time,
  n_atc FROM (SELECT i.patientid, i.date_diagnosis, coalesce(n.n, 0) AS n_atc,
    CASE WHEN p.date_birth + 24000 < i.date_diagnosis THEN f.date_death_fu ELSE p.date_birth + 24000 END AS date_death_fu2
  FROM idx i JOIN patient p ON p.patientid = i.patientid JOIN follow_up f ON f.patientid = i.patientid
  LEFT JOIN (SELECT patientid, count(DISTINCT atc) AS n FROM lookback WHERE days <= -30 GROUP BY patientid) n
    ON n.patientid = i.patientid) WHERE date_death_fu2 >= date_diagnosis""")
def corrected_death(c: Clinic):
    early = c.patient.select("patientid", F.date_add("date_birth", 24000).alias("death"))
    rows = (
        ex.polypharmacy(c.index, c.rx, gap_days=30)
        .join(early, "patientid")
        .join(c.follow_up, "patientid")
    )
    fixed = rows.withColumn(
        "date_death_fu2", registers.corrected_death(rows, "date_diagnosis", "death", "date_death_fu")
    )
    years = F.date_diff("date_death_fu2", "date_diagnosis") / 365.25
    return fixed.where(years >= 0).select("patientid", "date_death_fu2", years.alias("time"), "n_atc")


@query("""
WITH members AS (
  SELECT 1 AS cohort, patientid FROM idx UNION ALL SELECT 2, patientid FROM analysis WHERE IPI IS NOT NULL
  UNION ALL SELECT 3, i.patientid FROM idx i JOIN admission_outcome o ON o.patientid = i.patientid
  UNION ALL SELECT 4, i.patientid FROM idx i JOIN infection_outcome o ON o.patientid = i.patientid)
SELECT CAST(cohort AS BIGINT) AS cohort, count(DISTINCT patientid) AS n FROM members GROUP BY cohort
UNION ALL SELECT 5, count(DISTINCT patientid) FROM members WHERE cohort > 1""")
def cohorts(c: Clinic):
    """All indexed, with a prognostic group, with admission follow-up, with infection follow-up, and the union of the last three."""
    one = c.index.select("patientid")
    two = settle(c.analysis.dropna(subset=["IPI"]).select("patientid"), "cohort")
    three, four = (settle(one.join(o, "patientid", "left_semi"), "cohort") for o in (c.admission_outcome, c.infection_outcome))
    five = keyed.union_ids([two, three, four])
    sizes = [
        df.agg(F.lit(i).alias("cohort"), F.count_distinct("patientid").alias("n"))
        for i, df in enumerate([one, two, three, four, five], 1)
    ]
    return keyed.union_all(sizes)


@query("""
SELECT patientid FROM analysis WHERE IPI IS NOT NULL AND PS IS NOT NULL AND Disease = 'CLL'
UNION SELECT patientid FROM analysis WHERE IPI IS NOT NULL AND Disease = 'MM'""")
def cohort_union(c: Clinic):
    whole = settle(c.analysis.select("patientid", "Disease", "IPI", "PS"), "analysis")
    a = whole.where(F.col("Disease") == "CLL").dropna(subset=["IPI", "PS"])
    b = whole.where(F.col("Disease") == "MM").dropna(subset=["IPI"])
    return keyed.union_ids([a, b])


@query("""
SELECT patientid, CAST(date_diagnosis AS VARCHAR) AS date_diagnosis FROM idx
WHERE patientid NOT IN (SELECT patientid FROM lookback)""")
def excluded_patients(c: Clinic):
    return c.index.join(ex.lookback(c.index, c.rx), "patientid", "left_anti").select("patientid", "date_diagnosis")


@query("""
SELECT patientid, dx_id, last_value(cost IGNORE NULLS) OVER (PARTITION BY patientid ORDER BY date_diagnosis, dx_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cost
FROM (SELECT d.*, CASE WHEN o.o_orderstatus = 'F' THEN o.o_totalprice END AS cost
  FROM dx d JOIN orders o ON o.o_orderkey = d.dx_id)""")
def fill_down(c: Clinic):
    return fill(_cost(c), ["patientid"], ["date_diagnosis", "dx_id"], F.col("date_diagnosis"), "cost").drop("date_diagnosis")


@query("""
SELECT patientid, dx_id, first_value(cost IGNORE NULLS) OVER (PARTITION BY patientid ORDER BY date_diagnosis, dx_id
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS cost
FROM (SELECT d.*, CASE WHEN o.o_orderstatus = 'F' THEN o.o_totalprice END AS cost
  FROM dx d JOIN orders o ON o.o_orderkey = d.dx_id)""")
def fill_up(c: Clinic):
    return fill(
        _cost(c), ["patientid"], ["date_diagnosis", "dx_id"], F.col("date_diagnosis"), "cost", up=True
    ).drop("date_diagnosis")


def _cost(c: Clinic):
    return c.table("orders", "o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice").select(
        F.col("o_custkey").alias("patientid"),
        F.to_date("o_orderdate").alias("date_diagnosis"),
        F.col("o_orderkey").alias("dx_id"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("cost"),
    )


@query("""
SELECT patientid, CAST(date AS VARCHAR) AS date, atc, CASE WHEN n < 5 THEN '<5' ELSE CAST(n AS VARCHAR) END AS cell, value
FROM (SELECT patientid, date, atc, count(*) AS n, min(l_linenumber) / 4.0 AS value FROM rx GROUP BY ALL)""")
def csv2_roundtrip(c: Clinic):
    rows = c.rx.groupBy("patientid", "date", "atc").agg(
        F.count(F.lit(1)).alias("n"), (F.min("l_linenumber") / 4.0).alias("value")
    ).select("patientid", "date", "atc", small_cell(F.col("n")).alias("cell"), "value")
    path = scratch_path(c.spark, "csv2")
    csv.write_csv2(rows, path)
    return csv.read_csv2(c.spark, path, rows.schema)


@query("SELECT patientid, CAST(date_diagnosis AS VARCHAR) AS date_diagnosis, diagnosis, dx_id FROM dx")
def csv_roundtrip(c: Clinic):
    path = scratch_path(c.spark, "csv")
    csv.write_csv(c.dx, path)
    return csv.read_csv(c.spark, path, c.dx.schema)


@query("SELECT patientid, n_atc, atc_bin FROM poly")
def checkpoint_roundtrip(c: Clinic):
    stages = csv.Stages(c.spark, scratch_path(c.spark, "stages"))
    stages.save("poly", c.poly.select("patientid", "n_atc", "atc_bin"))
    return stages.load("poly")
