"""Queries on scans, projections, predicates, joins, counts and scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from kohorta.functions.bins import DRUG_COUNT_CUTS, as_level, cut, level_rank, recode
from kohorta.functions.dates import diff_days_exact, diff_years, rate_per_year
from kohorta.functions.nulls import flag, if_na, is_in, later_of, not_in, presence, sum_strict, zero_if_null
from kohorta.functions.text import clean_code, decimal_comma, interval_parts, p_text, small_cell
from kohorta.operators import keyed
from kohorta.operators.exposure import last_date
from kohorta.operators.index import with_code
from kohorta.plans.registry import query
from kohorta.plans.views import Clinic
from kohorta.sources.tables import load_for_codes, load_for_cohort, stack_sources


@query("""
SELECT l.l_returnflag, l.l_linestatus, count(*) AS n_lines, count(DISTINCT o.o_custkey) AS n_patients,
  round(sum(l.l_extendedprice), 2) AS total
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY ALL""")
def scan_tables(c: Clinic):
    lines = c.table("lineitem", "l_orderkey", "l_returnflag", "l_linestatus", "l_extendedprice")
    orders = c.table("orders", "o_orderkey", "o_custkey")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            F.count_distinct("o_custkey").alias("n_patients"),
            F.round(F.sum("l_extendedprice"), 2).alias("total"),
        )
    )


@query("""
SELECT r.patientid, count(*) AS n_rx, CAST(min(r.date) AS VARCHAR) AS first_rx FROM rx r
WHERE r.patientid IN (SELECT patientid FROM idx WHERE diagnosis = '1-URGENT') GROUP BY r.patientid""")
def scan_cohort(c: Clinic):
    cohort = c.index.where(F.col("diagnosis") == "1-URGENT")
    return load_for_cohort(c.rx, cohort).groupBy("patientid").agg(
        F.count(F.lit(1)).alias("n_rx"), F.min("date").alias("first_rx")
    )


@query("""
SELECT npu, count(*) AS n, round(avg(value), 4) AS mean_value, min(value) AS low, max(value) AS high
FROM labs WHERE npu IN ('AF', 'AO', 'NF') GROUP BY npu""")
def scan_codes(c: Clinic):
    pieces = [("l_returnflag", 0, 1), ("l_linestatus", 1, 1)]
    return load_for_codes(c.lab_lines, ["AF", "AO", "NF", "NF"], "npu", pieces).groupBy("npu").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("value"), 4).alias("mean_value"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
    )


@query("""
SELECT p.patientid, n.n_name AS hospital, r.r_name AS region FROM patient p
LEFT JOIN nation n ON n.n_nationkey = p.hospital_id LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""")
def dim_lookup(c: Clinic):
    return (
        c.patient.join(c.table("nation"), F.col("hospital_id") == F.col("n_nationkey"), "left")
        .join(c.table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select("patientid", F.col("n_name").alias("hospital"), F.col("r_name").alias("region"))
    )


@query("""
SELECT o_custkey AS patientid, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date_dx,
  o_orderpriority AS diagnosis, round(o_totalprice / 1000, 6) AS cost FROM orders""")
def project_rename(c: Clinic):
    orders = c.table("orders")
    return (
        orders.select(
            F.col("o_custkey").alias("patientid"), F.to_date("o_orderdate").alias("date_diagnosis"),
            F.col("o_orderpriority").alias("diagnosis"), (F.col("o_totalprice") / 1000).alias("cost"), "o_orderkey",
        )
        .withColumnsRenamed({"date_diagnosis": "date_dx"})
        .drop("o_orderkey")
    )


@query("""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_discount, l_tax, l_extendedprice,
  CASE WHEN l_discount = 0 THEN 'No' ELSE 'Yes' END AS f_discount,
  CASE WHEN l_tax = 0 THEN 'No' ELSE 'Yes' END AS f_tax FROM lineitem""")
def columns_by_pattern(c: Clinic):
    lines = c.table("lineitem")
    named = keyed.columns_like(lines, "DISCOUNT", "tax")
    rest = keyed.columns_like(lines, "orderkey", "linenumber", "price")
    flags = {f"f_{n[2:]}": F.when(F.col(n) == 0, "No").otherwise("Yes") for n in named}
    return lines.select(*rest, *named).withColumns(flags)


@query("""
SELECT patientid, CAST(date AS VARCHAR) AS "date_AF", value AS "AF_value" FROM labs WHERE npu = 'AF'""")
def columns_computed(c: Clinic):
    from kohorta.operators.nearest import lab_extract

    return lab_extract(c.labs, ["AF"], "AF")


@query("""
SELECT patientid, round(b2m, 6) AS b2m, round(alb, 6) AS alb, CASE WHEN b2m IS NULL THEN NULL WHEN b2m >= 4.0 THEN 'high' ELSE 'low' END AS b2m_class,
  CASE WHEN b2m IS NULL AND alb >= 35 THEN NULL WHEN alb IS NULL AND b2m >= 3.5 THEN 'no'
    WHEN alb IS NULL OR (alb >= 35 AND b2m IS NULL) THEN NULL
    WHEN alb >= 35 AND b2m < 3.5 THEN 'yes' ELSE 'no' END AS stage_one FROM at_index""")
def ifelse_null(c: Clinic):
    alb, b2m = F.col("alb"), F.col("b2m")
    return c.at_index.select(
        "patientid",
        "b2m",
        "alb",
        if_na(b2m >= 4.0, "high", "low").alias("b2m_class"),
        if_na((alb >= 35) & (b2m < 3.5), "yes", "no").alias("stage_one"),
    )


@query("""
SELECT patientid, CAST(date_diagnosis AS VARCHAR) AS date_diagnosis, diagnosis FROM dx
WHERE date_diagnosis >= DATE '1998-01-01' AND date_diagnosis <= (SELECT max(date_diagnosis) - 365 FROM dx)
  AND diagnosis <> '5-LOW'""")
def filter_compare(c: Clinic):
    end = c.dx.agg(F.date_sub(F.max("date_diagnosis"), 365)).scalar()
    day = F.col("date_diagnosis")
    return c.dx.where(
        (day >= F.lit("1998-01-01").cast("date")) & (day <= end) & (F.col("diagnosis") != "5-LOW")
    ).drop("dx_id")


@query("""
SELECT count(*) FILTER (WHERE ighv IN ('Mutated')) AS n_in,
  count(*) FILTER (WHERE ighv IS NULL OR ighv NOT IN ('Mutated')) AS n_not_in,
  count(*) FILTER (WHERE ighv NOT IN ('Mutated')) AS n_plain_not_in FROM clinic_index""")
def filter_in_null_safe(c: Clinic):
    ighv = F.col("ighv")
    return c.clinic_index.agg(
        F.count(F.when(is_in(ighv, ["Mutated"]), 1)).alias("n_in"),
        F.count(F.when(not_in(ighv, ["Mutated"]), 1)).alias("n_not_in"),
        F.count(F.when(~ighv.isin("Mutated"), 1)).alias("n_plain_not_in"),
    )


@query("""
SELECT p_partkey, p_name, p_type FROM part
WHERE contains(p_name, 'widget') AND NOT contains(p_name, 'cold') AND regexp_matches(p_type, '^(ECONOMY|STANDARD)')""")
def filter_text(c: Clinic):
    part = c.table("part", "p_partkey", "p_name", "p_type")
    kept = with_code(part, "p_name", ["widget"], match="contains")
    return kept.where(~F.col("p_name").contains("cold") & F.col("p_type").rlike("^(ECONOMY|STANDARD)"))


@query("""
SELECT diagnosis, CAST(CASE diagnosis WHEN '3-MEDIUM' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '1-URGENT' THEN 3 END AS BIGINT) AS place,
  CASE WHEN diagnosis IN ('3-MEDIUM', '2-HIGH', '1-URGENT') THEN diagnosis END AS level, count(*) AS n
FROM dx GROUP BY ALL""")
def level_order(c: Clinic):
    levels = ["3-MEDIUM", "2-HIGH", "1-URGENT"]
    col = F.col("diagnosis")
    return c.dx.groupBy(
        "diagnosis", level_rank(col, levels).alias("place"), as_level(col, levels).alias("level")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT p.patientid, p.sex, f.status, CAST(f.date_death_fu AS VARCHAR) AS date_death_fu
FROM patient p LEFT JOIN follow_up f ON f.patientid = p.patientid""")
def join_left(c: Clinic):
    return c.patient.select("patientid", "sex").join(c.follow_up, "patientid", "left")


@query("""
SELECT i.patientid, i.diagnosis, g.IPI FROM (SELECT *, CASE diagnosis WHEN '1-URGENT' THEN 'CLL'
  WHEN '2-HIGH' THEN 'MM' ELSE 'DLBCL' END AS Disease FROM idx) i
LEFT JOIN prognosis g ON g.patientid = i.patientid AND g.Disease = i.Disease""")
def join_two_keys(c: Clinic):
    from kohorta.operators.index import label_by_codes
    from kohorta.plans.views import DISEASES

    labelled = label_by_codes(c.index, DISEASES)
    return labelled.join(c.prognosis, ["patientid", "Disease"], "left").select("patientid", "diagnosis", "IPI")


@query("""
SELECT a.patientid, a.ighv, b.n AS n_same FROM clinic_index a
LEFT JOIN (SELECT ighv, sex, count(*) AS n FROM clinic_index GROUP BY ALL) b
  ON a.ighv IS NOT DISTINCT FROM b.ighv AND a.sex = b.sex""")
def join_null_key(c: Clinic):
    rows = c.clinic_index.select("patientid", "ighv", "sex")
    sizes = rows.groupBy("ighv", "sex").agg(F.count(F.lit(1)).alias("n_same"))
    return keyed.join_null_safe(rows, sizes, ["ighv", "sex"]).select("patientid", "ighv", "n_same")


@query("""
SELECT p.patientid, coalesce(n.n, 0) AS n_dx FROM patient p LEFT JOIN (
  SELECT patientid, count(*) AS n FROM dx WHERE diagnosis = '1-URGENT' GROUP BY patientid) n
ON n.patientid = p.patientid""")
def join_keep_cohort(c: Clinic):
    per_key = c.dx.where(F.col("diagnosis") == "1-URGENT").groupBy("patientid").agg(
        F.count(F.lit(1)).alias("n_dx")
    )
    return keyed.keep_cohort(c.patient.select("patientid"), per_key, "patientid", zeros=["n_dx"])


@query("""
SELECT same, count(*) AS n FROM (SELECT l.patientid, i.date_diagnosis + CAST(l.days AS INTEGER) = l.date AS same
FROM lookback l JOIN idx i ON i.patientid = l.patientid) GROUP BY same""")
def join_consistency(c: Clinic):
    from kohorta.operators.exposure import lookback

    again = c.index.select("patientid", "date_diagnosis")
    same = F.date_add(F.col("date_diagnosis"), F.col("days")) == F.col("date")
    return (
        lookback(c.index, c.rx).join(again, "patientid").groupBy(same.alias("same")).agg(F.count(F.lit(1)).alias("n"))
    )


@query("SELECT count(DISTINCT patientid) AS n_patients FROM rx")
def count_patients(c: Clinic):
    return keyed.rows_and_subjects(c.rx).select("n_patients")


@query("SELECT count(*) AS n_rows, count(DISTINCT patientid) AS n_patients FROM dx")
def rows_and_patients(c: Clinic):
    return keyed.rows_and_subjects(c.dx)


@query("SELECT CAST(max(date) AS VARCHAR) AS date_max FROM rx")
def max_date(c: Clinic):
    return c.spark.range(1).select(last_date(c.rx).alias("date_max"))


@query("""
SELECT o_custkey AS patientid, count(*) AS n_dx, round(sum(o_totalprice), 2) AS cost,
  CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'P') = 0 THEN round(sum(o_totalprice), 2) END AS cost_strict
FROM orders GROUP BY o_custkey""")
def count_and_sum(c: Clinic):
    known = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return c.table("orders", "o_custkey", "o_totalprice", "o_orderstatus").groupBy(
        F.col("o_custkey").alias("patientid")
    ).agg(
        F.count(F.lit(1)).alias("n_dx"),
        F.round(F.sum("o_totalprice"), 2).alias("cost"),
        F.round(sum_strict(known), 2).alias("cost_strict"),
    )


@query("""
SELECT DISTINCT patientid FROM lookback UNION SELECT patientid FROM dx WHERE diagnosis = '5-LOW'""")
def id_list(c: Clinic):
    from kohorta.operators.exposure import lookback

    return keyed.union_ids([lookback(c.index, c.rx), c.dx.where(F.col("diagnosis") == "5-LOW")])


@query("""
SELECT patientid, CAST(CAST(time AS DATE) AS VARCHAR) AS day, event,
  row_number() OVER (PARTITION BY patientid ORDER BY time, seq) AS place FROM adt""")
def sort_multi(c: Clinic):
    from kohorta.operators.events import adt_events
    from kohorta.operators.ordered import Carry, carry
    from kohorta.plans.views import ADT_KINDS

    events = adt_events(c.adt_raw, ADT_KINDS)
    numbered = carry(
        events, ["patientid"], ["time", "seq"], F.date_trunc("day", F.col("time")), {"place": Carry("number")}
    )
    return numbered.select("patientid", F.to_date("time").alias("day"), "event", "place").orderBy(
        F.col("patientid").asc_nulls_last(), "place"
    )


@query("""
SELECT atc3, n, mean_days FROM (SELECT substr(atc, 1, 3) AS atc3, count(*) AS n,
  round(avg(CASE WHEN days <= -30 THEN days END), 6) AS mean_days FROM lookback GROUP BY 1)
ORDER BY mean_days DESC NULLS LAST, atc3""")
def sort_desc_nulls(c: Clinic):
    from kohorta.operators.exposure import lookback

    per_class = lookback(c.index, c.rx).groupBy(F.left("atc", F.lit(3)).alias("atc3")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.when(F.col("days") <= -30, F.col("days"))), 6).alias("mean_days"),
    )
    return per_class.orderBy(F.col("mean_days").desc_nulls_last(), "atc3")


@query("""
SELECT patientid, CAST(date_diagnosis AS VARCHAR) AS date_diagnosis, diagnosis, dx_id FROM dx
ORDER BY date_diagnosis, dx_id LIMIT 10""")
def top_rows(c: Clinic):
    return c.dx.orderBy("date_diagnosis", "dx_id").limit(10)


@query("""
SELECT patientid, min(diagnosis) AS diagnosis, arg_min(dx_id, (diagnosis, dx_id)) AS dx_id FROM dx GROUP BY patientid""")
def first_any(c: Clinic):
    return keyed.first_per_key(c.dx, ["patientid"], ["diagnosis", "dx_id"]).select("patientid", "diagnosis", "dx_id")


@query("""
SELECT p_partkey, substr(p_brand, 1, 3) AS head, replace(replace(p_brand, 'Brand#', ''), '#', '') AS number,
  p_type || ' ' || p_brand AS label, CAST(lo AS DOUBLE) AS lower, CAST(hi AS DOUBLE) AS upper,
  CASE WHEN p_size < 5 THEN '<5' ELSE CAST(p_size AS VARCHAR) END AS cell,
  CASE WHEN p_size < 4 THEN '<0.001' ELSE '0.' || lpad(CAST(p_size AS VARCHAR), 3, '0') END AS p_value
FROM (SELECT *, CAST(p_size AS VARCHAR) || '.5' AS lo, CAST(p_size + 2 AS VARCHAR) || '.25' AS hi FROM part)""")
def string_scalars(c: Clinic):
    size = F.col("p_size").cast("string")
    bounds = F.concat(F.lit("["), size, F.lit(".5;"), (F.col("p_size") + 2).cast("string"), F.lit(".25]"))
    lower, upper = interval_parts(bounds)
    tiny = F.when(F.col("p_size") < 4, F.lit(0.0001)).otherwise(F.col("p_size") / 1000)
    return c.table("part").select(
        "p_partkey",
        F.left("p_brand", F.lit(3)).alias("head"),
        clean_code(F.col("p_brand"), ["Brand", "#"]).alias("number"),
        F.concat_ws(" ", "p_type", "p_brand").alias("label"),
        lower.alias("lower"),
        upper.alias("upper"),
        small_cell(F.col("p_size")).alias("cell"),
        p_text(tiny).alias("p_value"),
    )


@query("""
SELECT o.patientid, o.t_days, round(o.t_days / 365.25, 6) AS years, round(o.age, 6) AS age,
  CAST(CASE WHEN o.date_diagnosis < g.start THEN g.start
    WHEN g.start IS NOT NULL THEN o.date_diagnosis END AS VARCHAR) AS date_start,
  year(o.date_diagnosis) AS year_dx
FROM outcome o LEFT JOIN (SELECT hospital_id, date_golive - 9000 + CAST(hospital_id * 40 AS INTEGER) AS start FROM golive) g
  ON g.hospital_id = o.hospital_id""")
def date_scalars(c: Clinic):
    start = c.go_live.select(
        "hospital_id", F.date_add(F.date_sub("date_golive", 9000), (F.col("hospital_id") * 40).cast("int")).alias("start")
    )
    return c.outcome.join(start, "hospital_id", "left").select(
        "patientid",
        "t_days",
        diff_years(F.col("date_diagnosis"), F.col("date_death_fu")).alias("years"),
        "age",
        later_of(F.col("date_diagnosis"), F.col("start")).alias("date_start"),
        F.year("date_diagnosis").alias("year_dx"),
    )


@query("""
SELECT patientid, n_atc, round(n_atc / nullif(t_days / 365.25, 0), 6) AS per_year,
  CAST(ceil(n_atc / 2.0) AS BIGINT) AS pair,
  CAST(CASE atc_bin WHEN '0-3' THEN 1 WHEN '4-7' THEN 2 WHEN '8-11' THEN 3 ELSE 4 END AS BIGINT) AS bin_code FROM outcome""")
def rate_scalars(c: Clinic):
    years = diff_years(F.col("date_diagnosis"), F.col("date_death_fu"))
    return c.outcome.select(
        "patientid",
        "n_atc",
        rate_per_year(F.col("n_atc"), years).alias("per_year"),
        F.ceil(F.col("n_atc") / 2).cast("long").alias("pair"),
        level_rank(F.col("atc_bin"), DRUG_COUNT_CUTS[1]).alias("bin_code"),
    )


@query("""
SELECT patientid, coalesce(riss, 0) AS riss, CASE WHEN riss IS NULL THEN 'No' ELSE 'Yes' END AS known,
  CAST(riss IS NOT NULL AS BIGINT) AS known_flag, coalesce(iss, 0) AS iss,
  CASE riss WHEN 1 THEN 'Low' WHEN 2 THEN 'Intermediate' WHEN 3 THEN 'High' END AS grp
FROM mm_stage""")
def null_scalars(c: Clinic):
    from kohorta.operators import scores

    add_on = scores.any_yes(
        scores.ldh_high(F.col("age"), F.col("ldh")),
        scores.any_yes(F.col("t4_14"), F.col("t14_16"), F.col("del17p")),
    )
    staged = c.at_index.withColumn("iss", scores.iss(F.col("iss_own"), F.col("alb"), F.col("b2m"))).withColumn(
        "riss", scores.revised_iss(F.col("iss"), add_on)
    )
    riss = F.col("riss")
    return staged.select(
        "patientid",
        zero_if_null(riss).alias("riss"),
        presence(riss).alias("known"),
        flag(riss).alias("known_flag"),
        zero_if_null(F.col("iss")).alias("iss"),
        recode(riss.cast("string"), {"1": "Low", "2": "Intermediate", "3": "High"}).alias("grp"),
    )


@query("""
SELECT source, count(*) AS n, count(DISTINCT patientid) AS n_patients FROM (
  SELECT patientid, CASE WHEN l_returnflag = 'R' THEN 'hospital' ELSE 'pharmacy' END AS source FROM rx) GROUP BY source""")
def stacked_sources(c: Clinic):
    both = stack_sources(
        {
            "hospital": c.rx.where(F.col("l_returnflag") == "R").select("patientid", "date", "atc"),
            "pharmacy": c.rx.where(F.col("l_returnflag") != "R").select("patientid", "date", "atc"),
        }
    )
    return both.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("patientid").alias("n_patients")
    )


@query("""
SELECT p_partkey, CASE WHEN p_size <= 3 THEN '0-3' WHEN p_size <= 7 THEN '4-7' WHEN p_size <= 11 THEN '8-11'
  ELSE '>11' END AS size_bin, p_retailprice AS price FROM part""")
def cut_bins(c: Clinic):
    price = F.regexp_replace(F.col("p_retailprice").cast("string"), r"\.", ",")
    return c.table("part", "p_partkey", "p_size", "p_retailprice").select(
        "p_partkey", cut(F.col("p_size"), *DRUG_COUNT_CUTS).alias("size_bin"), decimal_comma(price).alias("price")
    )


@query("""
SELECT patientid, CAST(date_admission AS VARCHAR) AS date_admission, round(days, 6) AS days
FROM (SELECT patientid, date_trunc('second', date_admission) AS date_admission, days FROM stay_pairs)""")
def exact_days(c: Clinic):
    from kohorta.operators.events import adt_events, inside_follow_up, stays
    from kohorta.plans.views import ADT_KINDS

    found = stays(inside_follow_up(adt_events(c.adt_raw, ADT_KINDS), c.event_index))
    return found.select(
        "patientid",
        F.date_trunc("second", "date_admission").cast("timestamp_ntz").alias("date_admission"),
        diff_days_exact(F.col("date_admission"), F.col("date_discharge")).alias("days"),
    )
