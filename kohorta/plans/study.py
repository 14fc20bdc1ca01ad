"""The whole study over register tables: stage by stage, each written before the next.

A later run can start from any written stage.  Registers come as a dict of frames:

``patient``           patientid, sex, date_birth, date_death_fu, status
``diagnoses``         patientid, diagnosis, date_diagnosis
``diagnoses_all``     patientid, diagnosis, date_diagnosis
``dispensings``       dict source -> patientid, eksd, atc
``labs``              patientid, npu, samplingdate, value (text)
``register_cll``      patientid, date_diagnosis, sex, PS, age, stage, tp53, ighv, b2m, hospital_id
``ighv_lab``          patientid, ighv
``register_myeloma``  patientid, date_diagnosis, subtype, sex, PS, age, iss, alb, b2m, ldh,
                      fish_t4_14, fish_t14_16, fish_del17p, hospital_id
``register_lymphoma`` patientid, date_diagnosis, subtype, sex, PS, age, stage, hb, wbc, alc, ldh,
                      alb, plt, b2m, igm, ripi, flipi2, hospital_id
``adt_events``        patientid, effective_time, event_type_name
``administrations``   patientid, date, atc, route
``go_live``           hospital_id, date_golive
``atc_names``         atc3, name
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kohorta.functions.bins import COMORBIDITY_CUTS, DRUG_COUNT_CUTS, PROGNOSTIC_LEVELS, as_level, cut
from kohorta.functions.dates import DAYS_PER_YEAR, diff_days
from kohorta.operators import cox as ph
from kohorta.operators import events as ev
from kohorta.operators import exposure as ex
from kohorta.operators import keyed, quality, registers, scores, screening, survival, tables
from kohorta.operators.index import first_diagnosis, index_table
from kohorta.operators.nearest import nearest_values, own_or_nearest
from kohorta.session import configure
from kohorta.sources.codes import charlson_weights
from kohorta.sources.csv import Stages, write_csv2
from kohorta.sources.tables import stack_sources


@dataclass(frozen=True)
class Config:
    """Code lists, windows and dates of a study."""

    entities: Mapping[str, Sequence[str]]
    analytes: Mapping[str, Sequence[str]]
    antimicrobials: Sequence[tuple[str, str]]
    study_start: str
    cutoff: str
    hospitals: Sequence[str]
    lab_window: tuple[int, int] = (-30, 30)
    window_days: float = DAYS_PER_YEAR
    sensitivity_gap_days: int = 30
    max_gap_days: int = 2
    min_days: int = 1
    icd_weights: Sequence[Sequence] = field(default_factory=lambda: charlson_weights("D"))
    own_group: tuple = ("Cancer_and_Hem", 2, 2)
    hierarchy: Mapping[str, str] | None = field(
        default_factory=lambda: {"Liver_Severe": "Liver_Mild", "Cancer_Metastatic": "Cancer_and_Hem"}
    )
    ldh_limit: float = 205.0
    myeloma_subtype: str = "DC900"
    # entity of a lymphoma subtype
    lymphomas: Mapping[str, str] = field(
        default_factory=lambda: {"DLBCL": "DLBCL", "FL": "FL", "MCL": "MCL", "WM": "LPL", "MZL": "MZL", "cHL": "cHL"}
    )
    alpha: float = 0.05
    # write the large event stages and the index in buckets of the subject, so that their
    # joins need no exchange; leave out where single subjects own much of the data, as a
    # bucket cannot be split
    buckets: int | None = None


class Study:
    """Runs the stages in order; ``stage(name)`` is a written table."""

    def __init__(self, spark: SparkSession, tables_in: Mapping, config: Config, root: str):
        self.spark = configure(spark)
        self.src = tables_in
        self.config = config
        self.stages = Stages(spark, root)
        self.done: dict[str, DataFrame] = {}

    def stage(self, name: str) -> DataFrame:
        if name not in self.done:
            self.done[name] = self.stages.load(name)
        return self.done[name]

    def _save(self, name: str, df: DataFrame, bucketed: bool = False) -> DataFrame:
        if bucketed and self.config.buckets:
            self.done[name] = self.stages.save_bucketed(name, df, "patientid", self.config.buckets)
        else:
            self.done[name] = self.stages.save(name, df)
        return self.done[name]

    # -- stages -------------------------------------------------------------------
    def prognosis(self) -> DataFrame:
        """Disease-specific prognostic group, own items filled from the nearest laboratory value."""
        c = self.config
        labs = registers.clean_lab_values(self.src["labs"]).select(
            "patientid", "npu", F.to_date("samplingdate").alias("date"), F.col("value2").alias("value")
        )

        def filled(df: DataFrame, names: Sequence[str]) -> DataFrame:
            near = nearest_values(df, labs, {n: c.analytes[n] for n in names}, window=c.lab_window)
            return own_or_nearest(near, {n: f"{n}_value" for n in names})

        ighv = self.src["ighv_lab"].select("patientid", F.col("ighv").alias("ighv_value"))
        cll = own_or_nearest(self.src["register_cll"].join(ighv, "patientid", "left"), {"ighv": "ighv_value"})
        cll = scores.point_score(filled(cll, ["b2m"]), scores.CLL_IPI, "score", without=["B2M", "IGHV"])
        named = scores.score_group(F.col("score"), [1, 3, 6], PROGNOSTIC_LEVELS)
        cll = cll.withColumn(
            "IPI", scores.override_cll(named, F.col("score_minus_B2M"), F.col("score_minus_IGHV"))
        )

        mm = self.src["register_myeloma"].where(F.col("subtype") == c.myeloma_subtype)
        mm = filled(mm, ["alb", "b2m", "ldh"])
        add_on = scores.any_yes(
            scores.ldh_high(F.col("age"), F.col("ldh")),
            scores.any_yes(F.col("fish_t4_14"), F.col("fish_t14_16"), F.col("fish_del17p")),
        )
        stage = scores.revised_iss(scores.iss(F.col("iss"), F.col("alb"), F.col("b2m")), add_on)
        mm = mm.withColumn("IPI", F.when(stage == 1, "Low").when(stage == 2, "Intermediate").when(stage == 3, "High"))

        ly = filled(self.src["register_lymphoma"], ["hb", "wbc", "alc", "ldh", "igm"])
        ly = ly.withColumns({"ldh_ratio": F.col("ldh") / c.ldh_limit, "ps": F.col("PS")})
        for name, items in (("mipi", scores.MIPI), ("wm", scores.IPSSWM), ("malt", scores.MALT_IPI), ("ips", scores.IPS)):
            ly = scores.point_score(ly, items, name)
        three = PROGNOSTIC_LEVELS[:3]
        own = {
            "DLBCL": F.col("ripi"),
            "FL": F.col("flipi2"),
            "MCL": scores.score_group(F.col("mipi"), [5.7, 6.2], three, right_closed=False),
            "WM": scores.ipsswm_group(F.col("wm"), F.col("age")),
            "MZL": scores.score_group(F.col("malt"), [0, 1], three),
            "cHL": scores.score_group(F.col("ips"), [2], ["Low", "High"]),
        }
        group = scores.group_by_disease(own, PROGNOSTIC_LEVELS, disease="subtype")
        entity = F.when(F.lit(False), F.lit(None).cast("string"))
        for subtype, label in c.lymphomas.items():
            entity = entity.when(F.col("subtype") == subtype, F.lit(label))
        ly = ly.select("patientid", "sex", "PS", group.alias("IPI"), entity.alias("Disease")).where(
            F.col("Disease").isNotNull()
        )
        table = scores.unify({"CLL": cll, "MM": mm}, PROGNOSTIC_LEVELS).unionByName(ly)
        # one score per subject and disease: the better known, then the higher group
        rank = F.array_position(F.array(*[F.lit(v) for v in PROGNOSTIC_LEVELS]), F.col("IPI"))
        return self._save(
            "prognosis",
            keyed.first_per_key(table, ["patientid", "Disease"], [-rank, "PS", "sex"]).drop("sex"),
        )

    def entities(self) -> DataFrame:
        c = self.config
        codes = [code for listed in c.entities.values() for code in listed]
        first = first_diagnosis(self.src["diagnoses"].select("patientid", "diagnosis", "date_diagnosis"), codes)
        return self._save("entities", index_table(first, c.entities, self.src["patient"], self.stage("prognosis")))

    def dispensings(self) -> DataFrame:
        parts = {
            name: df.select("patientid", F.col("eksd").alias("date"), "atc")
            for name, df in self.src["dispensings"].items()
        }
        stacked = stack_sources(parts).join(self.stage("entities").select("patientid"), "patientid", "left_semi")
        return self._save("dispensings", ex.harmonise_dispensings(stacked), bucketed=True)

    def index(self) -> DataFrame:
        """Index rows inside the study period: from its start to the last dispensing."""
        last = ex.last_date(self.stage("dispensings"))
        inside = ex.study_period(self.stage("entities"), self.config.study_start, last)
        return self._save("index", inside, bucketed=True)

    def window(self) -> DataFrame:
        """Dispensings in the look-back window."""
        found = ex.lookback(self.stage("index"), self.stage("dispensings"), window_days=self.config.window_days)
        return self._save("window", found.select("patientid", "date", "atc", "days"))

    def comorbidity(self) -> DataFrame:
        c = self.config
        events = self.src["diagnoses_all"].select(
            "patientid", F.col("date_diagnosis").alias("date"), F.col("diagnosis").alias("icd10")
        )
        groups = scores.code_groups(ex.history(self.stage("index"), events), c.icd_weights)
        names = list(dict.fromkeys(g for g, *_ in c.icd_weights))
        table = scores.weighted_score(
            self.stage("index").select("patientid"), groups, names, hierarchy=c.hierarchy, always=[c.own_group]
        )
        return self._save("comorbidity", table)

    def analysis(self) -> DataFrame:
        c = self.config
        rx = self.stage("window")
        full = ex.polypharmacy(self.stage("index"), rx, c.window_days)
        gap = ex.polypharmacy(
            self.stage("index").select("patientid", "date_diagnosis"), rx, c.window_days, c.sensitivity_gap_days
        ).select("patientid", F.col("n_atc").alias("n_atc_gap"), F.col("polypharmacy").alias("polypharmacy_gap"))
        hospitals = registers.hospital_per_subject(
            [self.src[r] for r in ("register_cll", "register_lymphoma", "register_myeloma")]
        )
        table = scores.collapse(full).join(gap, "patientid").join(self.stage("comorbidity"), "patientid")
        table = ex.with_drug_bins(table.join(hospitals, "patientid", "left")).withColumns(
            {
                "cci_bin": cut(F.col("cci_score"), *COMORBIDITY_CUTS),
                "sex": as_level(F.col("sex"), ["F", "M"]),
                "t_days": diff_days(F.col("date_diagnosis"), F.col("date_death_fu")),
                "event": F.col("status"),
            }
        )
        return self._save("analysis", table)

    def admissions(self) -> DataFrame:
        """Time to the first stay of more than a day, one row per subject."""
        c = self.config
        cohort = self.stage("analysis").drop("t_days", "event")
        found = ev.stays(ev.inside_follow_up(ev.adt_events(self.src["adt_events"]), cohort))
        rows = ev.admission_follow_up(cohort, ev.long_stays(found), self.src["go_live"], hospitals=c.hospitals)
        first = ev.first_event(rows, ["time_to_admission", "date_admission"])
        return self._save(
            "admissions",
            first.withColumns(
                {"t_days": diff_days(F.col("date_start"), F.col("date_stop")), "event": F.col("admitted")}
            ),
        )

    def infections(self) -> DataFrame:
        c = self.config
        episodes = ev.infection_episodes(
            ev.classify_antimicrobials(self.src["administrations"], c.antimicrobials), c.max_gap_days, c.min_days
        )
        cohort = self.stage("analysis").drop("t_days", "event").join(
            self.stage("admissions").select("patientid"), "patientid", "left_semi"
        )
        rows = ev.infection_follow_up(cohort, episodes, self.src["go_live"], c.cutoff)
        return self._save("infections", rows.withColumn("t_days", diff_days(F.col("date_start"), F.col("date_end"))))

    # -- results ------------------------------------------------------------------
    OUTCOMES = {"os": "analysis", "adt": "admissions", "inf": "infections"}

    def curves(self) -> DataFrame:
        """Kaplan-Meier per drug-count bin, all diseases together and each one, per outcome."""
        parts = []
        for name, table in self.OUTCOMES.items():
            rows = self.stage(table).select("Disease", "atc_bin", "t_days", "event")
            both = rows.withColumn("Disease", F.explode(F.array("Disease", F.lit("All"))))
            parts.append(
                survival.kaplan_meier(both, ["Disease", "atc_bin"]).select(F.lit(name).alias("outcome"), "*")
            )
        return self._save("curves", keyed.union_all(parts))

    def models(self, exposure: str = "atc_bin") -> DataFrame:
        """Adjusted hazard ratios per outcome; ``exposure`` is the drug count or its label."""
        levels = DRUG_COUNT_CUTS[1] if exposure == "atc_bin" else ["No", "Yes"]
        covariates = [
            ph.Covariate("Age"),
            ph.Covariate("sex", ["F", "M"]),
            ph.Covariate("IPI", PROGNOSTIC_LEVELS[:3]),
            ph.Covariate(exposure, levels),
            ph.Covariate("cci_update"),
        ]
        parts = [
            ph.cox(self.stage(table), covariates).withColumn("outcome", F.lit(name))
            for name, table in self.OUTCOMES.items()
        ]
        return self._save(f"models_{exposure}", keyed.union_all(parts))

    def class_tables(self) -> dict[str, DataFrame]:
        """Unadjusted screen of all drug classes per outcome, then the adjusted refit of
        the classes that pass; both as publication tables."""
        c, names = self.config, self.src["atc_names"]
        exposure = self._save("exposure", ex.class_exposure(self.stage("window")))
        plain, adjusted = {}, {}
        for outcome, table in self.OUTCOMES.items():
            rows = self.stage(table)
            fits = self._save(f"screen_{outcome}", screening.adjust_p(ph.screen(exposure, rows)))
            passed = screening.significant(fits, c.alpha, drop_degenerate=False)
            plain[outcome] = screening.printed(passed)
            classes = [r["atc3"] for r in passed.select("atc3").collect()]  # one row per class
            again = ph.screen_adjusted(exposure, rows, [ph.Covariate("Age"), ph.Covariate("sex", ["F", "M"])], classes)
            again = screening.adjust_p(screening.described(again, names, require_name=True))
            adjusted[outcome] = screening.printed(screening.significant(again, c.alpha))
        return {
            "table_unadjusted": self._save("table_unadjusted", screening.result_table(plain, names)),
            "table_adjusted": self._save("table_adjusted", screening.result_table(adjusted, names)),
        }

    def characteristics(self, by: str) -> DataFrame:
        """Baseline table by disease or by drug-count bin."""
        factors = [f for f in ("sex", "IPI", "atc_bin", "cci_bin") if f != by]
        table = tables.baseline_table(self.stage("analysis"), by, ["Age", "n_atc", "cci_update"], (), factors)
        return self._save(f"baseline_{by}", table)

    def flow(self) -> DataFrame:
        whole = self.stage("analysis")
        complete = whole.dropna(subset=["Age", "sex", "IPI", "polypharmacy", "cci_update", "t_days"])
        steps = {"entities": self.stage("entities"), "study period": whole, "complete": complete, "admissions": self.stage("admissions")}
        return self._save("flow", tables.cohort_flow({n: df.select("patientid") for n, df in steps.items()}))

    def checks(self) -> DataFrame:
        index, whole = self.stage("index"), self.stage("analysis")
        none = index.join(self.stage("window"), "patientid", "left_anti").agg(F.count(F.lit(1)).alias("n"))
        zero = whole.where(F.col("n_atc") == 0).agg(F.count(F.lit(1)).alias("n"))
        again = whole.select("patientid", "date_diagnosis").join(
            index.select("patientid", F.col("date_diagnosis").alias("again")), "patientid"
        )
        return self._save(
            "checks",
            quality.report(
                [
                    quality.expect_unique(index, "patientid", "one index row per subject"),
                    quality.expect_unique(whole, "patientid", "one analysis row per subject"),
                    quality.expect_same_ids(index, whole, "patientid", "analysis keeps the cohort"),
                    quality.expect_all_true(again, F.col("date_diagnosis") == F.col("again"), "same index date"),
                    quality.expect_equal(none, zero, "subjects without dispensings"),
                    quality.expect_values(self.stage("comorbidity"), self.config.own_group[0], [1], "own group counted"),
                ]
            ),
        )

    def run(self, export: str | None = None) -> dict[str, DataFrame]:
        """All stages in order; the publication tables also as European CSV below ``export``."""
        for step in (
            self.prognosis, self.entities, self.dispensings, self.index, self.window, self.comorbidity,
            self.analysis, self.admissions, self.infections, self.curves,
        ):
            step()
        self.models("atc_bin")
        self.models("polypharmacy")
        published = self.class_tables()
        published["baseline_Disease"] = self.characteristics("Disease")
        published["baseline_atc_bin"] = self.characteristics("atc_bin")
        published["flow"] = self.flow()
        self.checks()
        if export:
            for name, df in published.items():
                write_csv2(df, f"{export}/{name}", mode="overwrite")
        return dict(self.done)
