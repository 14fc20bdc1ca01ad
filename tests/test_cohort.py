"""Index events, exposure, nearest values, scores, registers, episodes and follow-up."""

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kohorta.operators import events as ev
from kohorta.operators import exposure as ex
from kohorta.operators import keyed, registers, scores
from kohorta.operators.index import first_diagnosis, index_table, label_by_codes, prefix_groups, with_code
from kohorta.operators.nearest import nearest_values
from kohorta.operators.prefixes import PrefixRanges
from kohorta.sources.codes import charlson_1987, charlson_weights, expand_codes

D = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)


# ---- index --------------------------------------------------------------------


def test_first_diagnosis_ties_nulls_and_match(spark, rows):
    df = spark.createDataFrame(
        [(1, "DC911", D(5)), (1, "DC831", D(5)), (1, "DX", D(0)), (2, None, D(0)), (3, "DC9", D(1)), (1, "DC911", D(9))],
        "patientid long, diagnosis string, date_diagnosis date",
    )
    assert rows(first_diagnosis(df, ["DC911", "DC831"]), "patientid", "diagnosis", "date_diagnosis") == [(1, "DC831", D(5))]
    prefix = first_diagnosis(df, ["DC9"], match="prefix")
    assert rows(prefix, "patientid", "diagnosis") == [(1, "DC911"), (3, "DC9")]
    assert with_code(df, "diagnosis", ["83"], "contains").count() == 1


def test_labels_last_list_wins(spark, rows):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "diagnosis string")
    got = rows(label_by_codes(df, {"one": ["a", "b"], "two": ["b"]}))
    assert got == sorted([("a", "one"), ("b", "two"), ("c", None), (None, None)], key=repr)


def test_index_table_drops_death_before_diagnosis(spark, rows):
    first = spark.createDataFrame([(1, "a", D(10)), (2, "a", D(10))], "patientid long, diagnosis string, date_diagnosis date")
    subjects = spark.createDataFrame([(1, D(0), D(375)), (2, D(0), D(9))], "patientid long, date_birth date, date_death_fu date")
    out = index_table(first, {"x": ["a"]}, subjects)
    assert rows(out, "patientid", "Disease", "time_dx_death") == [(1, "x", 365 / 365.25)]


# ---- exposure -------------------------------------------------------------------


def test_polypharmacy_window_edges(spark):
    index = spark.createDataFrame([(1, D(0)), (2, D(0))], "patientid long, date_diagnosis date")
    rx = spark.createDataFrame(
        [(1, D(d), a) for d, a in [(0, "A"), (-1, "B"), (-30, "C"), (-31, "D"), (-365, "E"), (-366, "F"), (1, "G"), (-5, "B")]],
        "patientid long, date date, atc string",
    )
    full = {r.patientid: (r.n_atc, r.polypharmacy) for r in ex.polypharmacy(index, rx).collect()}
    assert full == {1: (5, "Yes"), 2: (0, "No")}
    gap = {r.patientid: r.n_atc for r in ex.polypharmacy(index, rx, gap_days=30).collect()}
    assert gap == {1: 3, 2: 0}


def test_drug_count_grows_with_the_window(spark):
    rnd = random.Random(1)
    index = spark.createDataFrame([(k, D(0)) for k in range(20)], "patientid long, date_diagnosis date")
    rx = spark.createDataFrame(
        [(rnd.randrange(20), D(-rnd.randrange(800)), f"A{rnd.randrange(30)}") for _ in range(600)],
        "patientid long, date date, atc string",
    )
    counts = []
    for window in (30, 365.25, 700):
        got = {r.patientid: r.n_atc for r in ex.polypharmacy(index, rx, window_days=window).collect()}
        counts.append([got[k] for k in range(20)])
    assert all(a <= b <= c for a, b, c in zip(*counts))


def test_dispensings_cleaned_and_void_dropped(spark, rows):
    rx = spark.createDataFrame([("A:1",), ("N/A",), ("NUL",), ("",), ("X",), ("XXX",), (None,), ("B_2",)], "atc string")
    assert rows(ex.harmonise_dispensings(rx)) == sorted([("A1",), ("B2",), (None,)], key=repr)


def test_class_tables(spark, rows):
    cohort = spark.createDataFrame([(1,), (2,), (3,)], "patientid long")
    rx = spark.createDataFrame([(1, "A01X"), (1, "A01Y"), (1, "B02"), (2, "B02")], "patientid long, atc string")
    long = ex.class_exposure(rx)
    assert rows(long) == [(1, "A01", 2), (1, "B02", 1), (2, "B02", 1)]
    wide = ex.class_wide(cohort, long, ["A01", "B02"])
    assert rows(wide) == [(1, "Yes", "Yes"), (2, "No", "Yes"), (3, "No", "No")]
    assert rows(ex.yes_counts(wide, ["A01", "B02"])) == [("A01", 1), ("B02", 2)]
    size = cohort.agg(F.count("*")).scalar()
    assert rows(ex.class_prevalence(long, size)) == [("A01", 1, pytest.approx(1 / 3)), ("B02", 2, pytest.approx(2 / 3))]


# ---- nearest value ----------------------------------------------------------------


def test_nearest_value_ties_and_tolerance(spark):
    index = spark.createDataFrame([(1, D(100)), (2, D(100)), (3, D(100))], "patientid long, date_diagnosis date")
    labs = spark.createDataFrame(
        [(1, D(69), "A", 1.0), (1, D(131), "A", 2.0), (1, D(70), "B", 3.0), (1, D(130), "B", 4.0),
         (2, D(98), "A", 5.0), (2, D(102), "A", 6.0), (2, D(98), "A", 4.5), (2, D(100), "A", None)],
        "patientid long, date date, npu string, value double",
    )
    got = {r.patientid: (r.a_value, r.b_value, r.date_b) for r in nearest_values(
        index, labs, {"a": ["A"], "b": ["B"]}, with_dates=True).collect()}
    assert got == {1: (None, 3.0, D(70)), 2: (4.5, None, None), 3: (None, None, None)}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-40, 40), st.integers(0, 5)), max_size=30), st.integers(0, 35))
def test_nearest_value_matches_a_search(spark, draws, width):
    index = spark.createDataFrame([(k, D(0)) for k in range(3)], "patientid long, date_diagnosis date")
    labs = spark.createDataFrame([(k, D(d), "A", float(v)) for k, d, v in draws], "patientid long, date date, npu string, value double")
    got = {r.patientid: r.a_value for r in nearest_values(index, labs, {"a": ["A"]}, window=(-width, width)).collect()}
    for k in range(3):
        near = sorted((abs(d), d, v) for kk, d, v in draws if kk == k and abs(d) <= width)
        assert got[k] == (float(near[0][2]) if near else None)


# ---- scores ------------------------------------------------------------------------


def test_code_ranges():
    assert expand_codes("I60-I62 G45 K700-K702") == ["I60", "I61", "I62", "G45", "K700", "K701", "K702"]
    assert len({g for g, *_ in charlson_weights()}) == 12
    assert ("CHF", "DI50", 1, 2) in charlson_weights("D")


def test_prefix_join_matches_startswith(spark, rows):
    codes = ["DI500", "DI5", "DN18", "DN180", "X", None, "DC77"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "patientid long, icd10 string")
    table = [("DI50", "heart"), ("DN18", "kidney"), ("DC", "cancer")]
    got = rows(prefix_groups(df, "icd10", table, ["_p", "grp"]), "patientid", "grp")
    want = sorted((i, g) for i, c in enumerate(codes) if c for p, g in table if c.startswith(p))
    assert got == want


def test_weighted_score_hierarchy_and_forced_group(spark, rows):
    cohort = spark.createDataFrame([(1,), (2,), (3,)], "patientid long")
    events = spark.createDataFrame(
        [(1, "B18"), (1, "B18"), (1, "I85"), (1, "H1"), (2, "B18"), (2, "C5")], "patientid long, icd10 string")
    weights = [("mild", "B18", 1, 2), ("severe", "I85", 3, 4), ("heart", "H", 1, 1), ("cancer", "C", 2, 2)]
    groups = scores.code_groups(events, weights)
    out = scores.weighted_score(
        cohort, groups, ["mild", "cancer"], hierarchy={"severe": "mild"}, always=[("cancer", 2, 2)])
    assert rows(out) == [(1, 6, 7, 1, 1), (2, 3, 4, 1, 1), (3, 2, 2, 0, 1)]
    plain = scores.weighted_score(cohort, groups)
    assert rows(plain) == [(1, 5, 7), (2, 3, 4), (3, 0, 0)]


def brute_riss(iss, add):
    out = None
    if iss is None:
        return None
    if iss == 3 and add == "Yes":
        out = 3
    if iss == 1 and add == "No":
        out = 1
    if iss == 3 and add == "No":
        out = 2
    if iss == 1 and add == "Yes":
        out = 2
    return 2 if iss == 2 else out


def test_stage_ladders(spark):
    cases = [(own, alb, b2m) for own in (None, 1) for alb in (None, 30.0, 35.0) for b2m in (None, 3.0, 3.5, 5.5)]
    df = spark.createDataFrame(cases, "own int, alb double, b2m double")
    got = {tuple(r)[:3]: r.s for r in df.withColumn("s", scores.iss(F.col("own"), F.col("alb"), F.col("b2m"))).collect()}
    for own, alb, b2m in cases:
        if b2m is None:
            want = None
        elif b2m >= 5.5:
            want = 3
        elif b2m >= 3.5:
            want = 2
        else:
            want = None if alb is None else (1 if alb >= 35 else 2)
        assert got[own, alb, b2m] == (own if own is not None else want)
    pairs = [(i, a) for i in (None, 1, 2, 3) for a in (None, "Yes", "No")]
    df = spark.createDataFrame(pairs, "iss int, a string")
    got = {(r.iss, r.a): r.s for r in df.withColumn("s", scores.revised_iss(F.col("iss"), F.col("a"))).collect()}
    assert got == {p: brute_riss(*p) for p in pairs}


@pytest.mark.parametrize("age,ldh,want", [(69, 205, "No"), (69, 206, "Yes"), (70, 255, "No"), (70, 256, "Yes"), (None, 100, None), (70, None, None)])
def test_ldh_limits(spark, age, ldh, want):
    df = spark.createDataFrame([(age, ldh)], "age int, ldh int")
    assert df.select(scores.ldh_high(F.col("age"), F.col("ldh")).alias("x")).first().x == want


def test_override_order_and_unknown(spark):
    df = spark.createDataFrame([("Low", 7, 3), ("Low", 7, 4), ("Low", 3, 3), ("Low", None, 3), ("Low", 4, None)], "g string, b int, i int")
    got = [r.x for r in df.select(scores.override_cll(F.col("g"), F.col("b"), F.col("i")).alias("x")).collect()]
    assert got == ["Very high", "High", "Low", None, None]


def test_point_score_unknown_item(spark):
    df = spark.createDataFrame([(71.0, 3, 1.5), (60.0, 1, None)], "age double, stage int, ldh_ratio double")
    out = scores.point_score(df, scores.MALT_IPI, "s", without=["ldh"]).collect()
    assert [(r.s, r.s_minus_ldh) for r in out] == [(3, 2), (None, 0)]


def test_collapse_and_levels(spark, rows):
    df = spark.createDataFrame([(1, "F", 0, "Very high"), (2, "M", 1, "other")], "patientid long, sex string, PS int, IPI string")
    out = scores.collapse(scores.unify({"CLL": df}, ["Low", "Intermediate", "High", "Very high"]))
    assert rows(out, "patientid", "Disease", "IPI", "IPI2", "IPS") == [(1, "CLL", "High", "Very high", None), (2, "CLL", None, None, None)]


# ---- registers ----------------------------------------------------------------------


def test_response_labels(spark):
    raw = ["CMR with residual mass", "Cru", "CMR and CR", "PR", "SD", "PD", "mors", "UNK", "not_performed", None]
    df = spark.createDataFrame([(r,) for r in raw], "x string")
    got = [r.y for r in df.select(registers.clean_response(F.col("x")).alias("y")).collect()]
    assert got == ["CR", "CR", "CR", "PR", "SD", "PD", "death", None, None, None]


def test_hospital_prefers_a_known_one(spark, rows):
    a = spark.createDataFrame([(1, None), (2, "RH")], "patientid long, hospital_id string")
    b = spark.createDataFrame([(1, "ROS"), (2, "HER"), (3, None)], "patientid long, hospital_id string")
    assert rows(registers.hospital_per_subject([a, b])) == [(1, "ROS"), (2, "HER"), (3, None)]


def test_null_keys_join(spark, rows):
    a = spark.createDataFrame([(1, None), (2, "x")], "i long, k string")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, v int")
    assert rows(keyed.join_null_safe(a, b, ["k"]), "i", "v") == [(1, 10), (2, 20)]
    assert rows(keyed.distinct_levels(a.withColumn("z", F.lit(0)), ["z"], "k", "n"), "n") == [(2,)]


# ---- episodes and follow-up ------------------------------------------------------------


def brute_episodes(days, gap):
    out = []
    for d in sorted(set(days)):
        if out and d - out[-1][-1] <= gap:
            out[-1].append(d)
        else:
            out.append([d])
    return [(e[0], e[-1], len(e)) for e in out]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 40)), min_size=1, max_size=50), st.integers(1, 5))
def test_episodes_match_a_walk(spark, draws, gap):
    df = spark.createDataFrame([(k, D(d)) for k, d in draws], "patientid long, date date")
    got = {}
    for r in ev.infection_episodes(df, max_gap_days=gap).collect():
        got.setdefault(r.patientid, []).append((r.date_infection, r.date_last, r.n_days_iv))
        assert r.n_inf == len(brute_episodes([d for k, d in draws if k == r.patientid], gap))
    for k in {k for k, _ in draws}:
        want = [(D(a), D(b), n) for a, b, n in brute_episodes([d for kk, d in draws if kk == k], gap)]
        assert sorted(got[k]) == want


def test_longest_prefix_names_the_drug(spark, rows):
    df = spark.createDataFrame([("J01AA",), ("J05AB",), ("J02",), (None,)], "atc string")
    found = ev.classify_antimicrobials(df, [("J01", "bacterial"), ("J05", "viral"), ("J05AB", "special")])
    assert rows(found) == [("J01AA", "bacterial"), ("J05AB", "special")]


def test_truncation_cutoff_day_counts(spark, rows):
    df = spark.createDataFrame(
        [(1, D(0), D(10), D(50)), (2, D(0), D(11), D(50)), (3, D(0), None, D(5)), (4, D(0), None, D(50))],
        "patientid long, s date, e date, date_death_fu date")
    out = ev.truncate(df, "e", "s", str(D(10)))
    got = {r.patientid: (r.date_end, r.event) for r in out.collect()}
    assert got == {1: (D(10), 1), 2: (D(10), 0), 3: (D(5), 0), 4: (D(10), 0)}


def follow_up_inputs(spark):
    index = spark.createDataFrame(
        [(1, D(0), D(100), "H"), (2, D(0), D(100), "H"), (3, D(0), D(5), "H"), (4, D(0), D(100), None), (5, D(30), D(100), "H")],
        "patientid long, date_diagnosis date, date_death_fu date, hospital_id string")
    go_live = spark.createDataFrame([("H", D(10))], "hospital_id string, date_golive date")
    return index, go_live


def test_admission_follow_up(spark):
    index, go_live = follow_up_inputs(spark)
    stay = spark.createDataFrame(
        [(1, dt.datetime(2020, 1, 5), 2.0, 2, 5.0), (1, dt.datetime(2020, 2, 5), 3.0, 2, 5.0), (2, dt.datetime(2020, 1, 3), 2.0, 1, 2.0)],
        "patientid long, date_admission timestamp_ntz, days double, n_contacts long, days_in_hospital double")
    got = {r.patientid: (r.date_start, r.date_stop, r.admitted, r.n_contacts)
           for r in ev.admission_follow_up(index, stay, go_live).collect()}
    assert got == {
        1: (D(10), dt.date(2020, 2, 5), 1, 2),
        2: (D(10), D(100), 0, 0),  # its only stay lies before go-live: kept, censored
        5: (D(30), D(100), 0, 0),
    }
    strict = ev.admission_follow_up(index, stay, go_live, drop_early=True)
    assert {r.patientid for r in strict.collect()} == {1, 5}


def test_infection_follow_up_voids_early_episodes(spark):
    index, go_live = follow_up_inputs(spark)
    episodes = spark.createDataFrame(
        [(1, D(3), 4, 2), (1, D(20), 5, 2), (2, D(4), 6, 1)], "patientid long, date_infection date, n_days_iv long, n_inf long")
    run = lambda **k: {r.patientid: (r.date_infection, r.n_days_iv_sum, r.event) for r in ev.infection_follow_up(
        index, episodes, go_live, str(D(60)), **k).collect()}
    assert run() == {1: (D(20), 5, 1), 2: (None, 0, 0), 5: (None, 0, 0)}
    assert run(sum_voided=True)[1] == (D(20), 9, 1)


# ---- prefix ranges and the group index ----------------------------------------------


def test_prefix_ranges_equal_startswith():
    rng = random.Random(1)
    entries = [("".join(rng.choices("AB1", k=rng.randint(1, 4))), f"g{rng.randint(0, 9)}") for _ in range(40)] + [("", "all")]
    ranges = PrefixRanges(entries)
    for _ in range(500):
        code = "".join(rng.choices("AB12", k=rng.randint(0, 6)))
        want = [(len(p), g) for p, g in entries if code.startswith(p)]
        got = ranges.labels(code)
        assert set(got) == {g for _, g in want} and len(got) == len(set(got))
        assert got[0] in {g for n, g in want if n == max(want)[0]}
    assert ranges.labels(None) == [] and PrefixRanges([("A", "a")]).labels("B") == []


def test_group_index_suppression_forced_group_and_history(spark, rows):
    prefixes = [("B18", "mild"), ("B1", "other"), ("I85", "severe"), ("X", "worst"), ("C", "cancer")]
    weights = {"mild": 1, "other": 2, "severe": 3, "worst": 6, "cancer": 2}
    graph = {"mild": ["severe"], "severe": ["worst"]}
    cohort = spark.createDataFrame([(i,) for i in range(1, 7)], "patientid long")
    events = [(1, "B181"), (1, "B18"), (2, "B18"), (2, "I85"), (3, "B18"), (3, "X"), (4, "C1"), (5, None), (5, "Z")]
    coded = spark.createDataFrame(events, "patientid long, icd10 string")
    plain = scores.group_index(cohort, coded, prefixes, weights, graph)
    # subject 3 has no severe group, but the worst one suppresses along the path
    assert rows(plain) == [(1, 3, 1, 2, 0, 0, 0), (2, 5, 0, 2, 3, 0, 0), (3, 8, 0, 2, 0, 6, 0), (4, 2, 0, 0, 0, 0, 2), (5, 0, 0, 0, 0, 0, 0), (6, 0, 0, 0, 0, 0, 0)]
    own = scores.group_index(cohort, coded, prefixes, weights, {**graph, "cancer": ["worst"]}, forced=["cancer"], need_history=True)
    assert rows(own, "patientid", "score", "cancer") == [(1, 5, 2), (2, 7, 2), (3, 10, 2), (4, 2, 2), (5, 2, 2)]


def test_longest_prefix_wins(spark, rows):
    df = spark.createDataFrame([(1, "J01A"), (2, "J01"), (3, "J"), (4, "K"), (5, None)], "patientid long, atc string")
    got = ev.classify_antimicrobials(df, [("J", "any"), ("J01", "one"), ("J01A", "two")])
    assert rows(got, "patientid", "ab_class") == [(1, "two"), (2, "one"), (3, "any")]


def test_1987_index_has_17_groups():
    prefixes, weights = charlson_1987("D")
    assert len(weights) == 17 == len({g for _, g in prefixes})
    ranges = PrefixRanges(prefixes)
    assert [ranges.labels(c) for c in ("DI214", "DE119", "DE112", "DK26", "DI69", "DZ958", "DQ00")] == [["MI"], ["DM"], ["DM_w_compl"], ["PUD"], ["CVD"], ["PVD"], []]
