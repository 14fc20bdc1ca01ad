"""The whole study on made registers: invariants across stages."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kohorta.plans.study import Config, Study
from kohorta.session import scratch_path

D = lambda n: dt.date(2015, 1, 1) + dt.timedelta(days=n)
CODES = {"cHL": ["DC81"], "DLBCL": ["DC833"], "FL": ["DC82"], "MZL": ["DC884"], "MCL": ["DC831"], "CLL": ["DC911"], "LPL": ["DC880"], "MM": ["DC900"]}
SUBTYPE = {"LPL": "WM"}


@pytest.fixture(scope="module")
def registers(spark):
    rnd = random.Random(7)
    some = lambda v, p=0.8: v if rnd.random() < p else None
    patient, dx, dx_all, rx, labs, cll, ighv, mm, ly, adt, adm = ([] for _ in range(11))
    for k in range(400):
        day0 = rnd.randrange(0, 1500)
        frail = rnd.random()
        end = day0 + int(rnd.expovariate(1 / (1200 * (1.3 - frail)))) + 1
        patient.append((k, rnd.choice("FM"), D(-365 * rnd.randrange(30, 80)), D(min(end, 2500) if k else day0 - 5), int(end < 2500)))
        disease = rnd.choice(list(CODES))
        dx.append((k, CODES[disease][0], D(day0)))
        dx.append((k, CODES["MM"][0], D(day0 + 300)))
        for _ in range(rnd.randrange(0, 6)):
            dx_all.append((k, rnd.choice(["DI500", "DJ44", "DK746", "DN189", "DC780", "DB180", "DI850", "DZ00", None]), D(day0 + rnd.randrange(-900, 100))))
        for _ in range(int(18 * frail)):
            rx.append((k, D(day0 - rnd.randrange(-60, 500)), rnd.choice(["A02BC", "C07AB", "N02AA", "B01AC", "J01CA", "H02AB", "R03AC", "C10AA"]) + f"{rnd.randrange(1, 9):02d}" + rnd.choice(["", "", ":", "_"])))
        for npu in ("ALB", "B2M", "LDH", "HGB", "LEU", "LYM", "IGM"):
            if rnd.random() < 0.7:
                value = {"ALB": 38, "B2M": 4, "LDH": 210, "HGB": 110, "LEU": 9, "LYM": 1.2, "IGM": 30}[npu] * rnd.uniform(0.6, 1.5)
                labs.append((k, npu, dt.datetime(2015, 1, 1) + dt.timedelta(days=day0 + rnd.randrange(-40, 40)), f"{value:.1f}".replace(".", ",")))
        hospital, age, ps = rnd.choice(["RH", "HER", "XX", None]), float(rnd.randrange(30, 85)), some(rnd.randrange(5))
        if disease == "CLL":
            cll.append((k, D(day0), "F", ps, age, rnd.randrange(4), some("No"), some("Mutated", 0.5), some(3.0, 0.3), hospital))
            ighv.append((k, "Unmutated"))
        elif disease == "MM":
            mm.append((k, D(day0), "DC900", "M", ps, age, some(rnd.randrange(1, 4), 0.3), some(36.0, 0.3), some(3.0, 0.3), some(200.0, 0.3), some("No", 0.9), "No", some("Yes", 0.1) or "No", hospital))
        else:
            ly.append((k, D(day0), SUBTYPE.get(disease, disease), "M", ps, age, rnd.randrange(1, 5), *[None] * 4, 35.0, 150.0, 3.5, None, rnd.choice(["Low", "High"]), rnd.choice(["Low", "Intermediate"]), hospital))
        t = day0 + 3
        while t < min(end, 2400) and rnd.random() < 0.4 + frail / 2:
            t += rnd.randrange(20, 300)
            stay = rnd.choice([0, 1, 3, 9])
            adt += [(k, dt.datetime(2015, 1, 1, 8) + dt.timedelta(days=t), "INDLÆGGELSE"), (k, dt.datetime(2015, 1, 1, 9) + dt.timedelta(days=t + stay), "UDSKRIVNING")]
            adm += [(k, D(t + i), "J01CR05", "IV") for i in range(stay)]
            t += stay
    f = spark.createDataFrame
    return {
        "patient": f(patient, "patientid long, sex string, date_birth date, date_death_fu date, status int"),
        "diagnoses": f(dx, "patientid long, diagnosis string, date_diagnosis date"),
        "diagnoses_all": f(dx_all, "patientid long, diagnosis string, date_diagnosis date"),
        "dispensings": {"one": f(rx[::2], "patientid long, eksd date, atc string"), "two": f(rx[1::2], "patientid long, eksd date, atc string")},
        "labs": f(labs, "patientid long, npu string, samplingdate timestamp_ntz, value string"),
        "register_cll": f(cll, "patientid long, date_diagnosis date, sex string, PS int, age double, stage int, tp53 string, ighv string, b2m double, hospital_id string"),
        "ighv_lab": f(ighv, "patientid long, ighv string"),
        "register_myeloma": f(mm, "patientid long, date_diagnosis date, subtype string, sex string, PS int, age double, iss int, alb double, b2m double, ldh double, fish_t4_14 string, fish_t14_16 string, fish_del17p string, hospital_id string"),
        "register_lymphoma": f(ly, "patientid long, date_diagnosis date, subtype string, sex string, PS int, age double, stage int, hb double, wbc double, alc double, ldh double, alb double, plt double, b2m double, igm double, ripi string, flipi2 string, hospital_id string"),
        "adt_events": f(adt, "patientid long, effective_time timestamp_ntz, event_type_name string"),
        "administrations": f(adm, "patientid long, date date, atc string, route string"),
        "go_live": f([("RH", D(200)), ("HER", D(500))], "hospital_id string, date_golive date"),
        "atc_names": f([(c, f"drug {c}") for c in ("A02", "C07", "N02", "B01", "J01", "H02", "R03")], "atc3 string, name string"),
    }


@pytest.fixture(scope="module")
def study(spark, registers):
    config = Config(
        entities=CODES,
        analytes={"alb": ["ALB"], "b2m": ["B2M"], "ldh": ["LDH"], "hb": ["HGB"], "wbc": ["LEU"], "alc": ["LYM"], "igm": ["IGM"]},
        antimicrobials=[("J01", "ANTIBACTERIAL"), ("J05", "ANTIVIRAL")],
        study_start="2015-02-01",
        cutoff="2021-01-01",
        hospitals=["RH", "HER"],
        alpha=0.9,
        buckets=4,
    )
    s = Study(spark, registers, config, scratch_path(spark, "study"))
    s.export = scratch_path(spark, "export")
    s.run(export=s.export)
    return s


def test_all_checks_hold(study):
    report = {r["check"]: r["ok"] for r in study.stage("checks").collect()}
    assert len(report) == 6 and all(report.values())


def test_cohort_shrinks_step_by_step(study):
    rows = study.stage("flow").orderBy("step_no").collect()
    counts = [r.n_patients for r in rows]
    assert counts[0] == 399  # the one who died before the diagnosis is out
    assert counts == sorted(counts, reverse=True) and all(r.n_rows == r.n_patients for r in rows)


def test_every_disease_has_scores(study):
    got = {r.Disease: r.n for r in study.stage("prognosis").where("IPI is not null").groupBy("Disease").agg(F.count("*").alias("n")).collect()}
    assert set(got) == set(CODES)


def test_sensitivity_count_is_not_larger(study):
    assert study.stage("analysis").where("n_atc_gap > n_atc").count() == 0


def test_outcomes_are_timed_inside_follow_up(study):
    for name in ("admissions", "infections"):
        rows = study.stage(name)
        assert rows.count() == rows.select("patientid").distinct().count() > 50
        assert rows.where("t_days < 0 or event not in (0, 1)").count() == 0
    assert study.stage("infections").where("event = 1").count() > 10


def test_results_are_there(study, spark):
    curves = study.stage("curves")
    assert {r.outcome for r in curves.select("outcome").distinct().collect()} == {"os", "adt", "inf"}
    assert curves.where("survival < 0 or survival > 1").count() == 0
    bins = study.stage("models_atc_bin").where("outcome = 'os' and term = 'atc_bin'").collect()
    assert [r.level for r in sorted(bins, key=lambda r: r.coef)][-1] in ("8-11", ">11")  # frail patients die earlier
    for name in ("table_unadjusted", "table_adjusted"):
        table = study.stage(name)
        assert table.columns[:2] == ["atc3", "name"] and table.count() > 0
    assert spark.read.text(f"{study.export}/baseline_Disease").count() > 20


def test_a_later_run_starts_from_the_stages(study, registers):
    later = Study(study.spark, registers, study.config, study.stages.root)
    before = study.stage("curves").count()
    assert later.curves().count() == before
