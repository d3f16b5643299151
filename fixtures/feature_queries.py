"""Features and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixtures import need as N
from fixtures.catalog import DATES, LOOKBACK, SPINE, Query
from fixtures.cohort_queries import COHORT
from fixtures.linkage_queries import HASH, NUMBER, PATIENT
from hindcast.operators import cohorts as C
from hindcast.operators import features as X
from hindcast.operators import linkage as L
from hindcast.operators import profiles as P
from hindcast.operators import signals as S
from hindcast.presets import CALL_ISSUES, DURATION_INTERVALS, ENCOUNTER_PATTERN, FEATURE_INTERVALS, NEED_EXCLUSION, NEED_PATTERN

BOOKINGS = X.FeatureGroup("bkgs", (X.Aggregate("prior", ("count",)),), tuple(FEATURE_INTERVALS))
SCREENS = X.FeatureGroup("screen", (X.Aggregate("flag", ("max",), "screen_flag"),), ("5 years",))
KNOWN = X.FeatureGroup("cnt_bookings", (X.Aggregate("prior", ("count",)),), ("all",))
STAYS = X.FeatureGroup(
    "stay", (X.Aggregate("days", ("count", "min", "max", "avg", "last"), "days"),), tuple(DURATION_INTERVALS)
)


def bookings(t):
    return L.linked_events(t.bail, t.crosswalk, NUMBER, "person_number", "arranged_ts")


def stay_events(t):
    days = F.datediff("end_ts", "start_ts").alias("days")
    return t.stays.select("entity_id", F.col("start_ts").alias("knowledge_date"), "stay_id", "screen_flag", days)


def cohort(t):
    return C.cohort_last_stay_closed(t.stays, DATES, LOOKBACK)


def _booking_counts(t):
    return X.feature_intervals(bookings(t), DATES, BOOKINGS)


BOOKED = """
    booked as (select x.entity_id, arranged_ts as kd from bail b join crosswalk x
               on x.source = 'PERSON.NUMBER' and cast(x.source_key as bigint) = b.person_number),
    counts as (
      select entity_id, as_of_date, count(*) filter (kd >= as_of_date - interval '1' year) as bkgs_1y_prior_count,
             count(*) filter (kd >= as_of_date - interval '5' year) as bkgs_5y_prior_count,
             count(*) as bkgs_all_prior_count
      from booked join spine on kd < as_of_date group by all)"""


def _stats_sql(label: str, rule: str) -> str:
    inside = f"filter ({rule})"
    return f"""
        count(days) {inside} as stay_{label}_days_count, min(days) {inside} as stay_{label}_days_min,
        max(days) {inside} as stay_{label}_days_max, avg(days) {inside} as stay_{label}_days_avg,
        any_value(last_days) filter (last_kd = kd and {rule}) as stay_{label}_days_last"""


RECENT = """
    recent as (select entity_id, as_of_date, max(ts) as last_ts, max(sign) as sign, bool_or(signal = 'screen') as based
               from log join spine on ts <= as_of_date group by all),
    ever as (select entity_id, max(ts) as last_ts, max(sign) as sign, bool_or(signal = 'screen') as based
             from log group by all)"""


def _attachments(t):
    answered = P.inventory_by_person(t.cases, t.inventory, "case_no", "entity_id", ["a1", "a2", "a3"], ["a2"], "inventory_sign")
    asked = P.flagged_by_person(t.name_index, t.pretrial, "urno", "person_number", "mh_flag", "pretrial_sign", dedupe=True)
    hashed = P.matched_by_hash(
        t.raw_incidents, t.incidents, "id", "hash_key", ["primary_txt", "secondary_txt"], NEED_PATTERN, NEED_EXCLUSION,
        "incident_sign",
    )
    screened = t.stays.filter("screen_flag is not null").groupBy("entity_id").agg(F.max("screen_flag").alias("screen_sign"))
    matched = t.encounters.filter(F.col("program").rlike(ENCOUNTER_PATTERN))

    def one(df, key, name):
        return df.select(F.col(key).cast("bigint").alias(key)).distinct().withColumn(name, F.lit(1))

    return {
        "inmate": P.Attachment(NUMBER, one(t.stays, "entity_id", "inmate"), "entity_id"),
        "screen": P.Attachment(NUMBER, screened, "entity_id"),
        "inventory": P.Attachment(NUMBER, answered, "entity_id"),
        "pretrial": P.Attachment(NUMBER, asked, "person_number"),
        "incident": P.Attachment(HASH, hashed, "hash_key", "hash_key"),
        "client": P.Attachment(PATIENT, one(t.admissions, "patid", "client"), "patid"),
        "caller": P.Attachment(PATIENT, S.signal_issue_calls(t.calls, "patid", "issue", CALL_ISSUES).drop("n_calls"), "patid"),
        "scores": P.Attachment(PATIENT, X.feature_score_extrema(t.outcomes, "patid", ["score_a", "score_b"]), "patid"),
        "service": P.Attachment(PATIENT, one(t.services, "patid", "service"), "patid"),
        "encounter": P.Attachment(PATIENT, one(matched, "patient_no", "encounter_sign"), "patient_no"),
    }


def _profile_with_target(t):
    found = _attachments(t)
    people = X.feature_demographics(t.people, "person_number", "age", ["sex", "race", "marital_status"])
    found["people"] = P.Attachment(
        NUMBER, people.withColumnsRenamed({"sex": "sex_a", "race": "race_a"}).withColumn("avg_age", F.round("avg_age", 6)), "person_number"
    )
    found["repeat"] = P.Attachment(NUMBER, C.repeat_event_flag(t.stays), "entity_id")
    found["frequency"] = P.Attachment(HASH, X.feature_source_frequency(t.crosswalk, HASH), "entity_id", "entity_id")
    found["demographics"] = P.Attachment(PATIENT, t.demographics.withColumnsRenamed({"sex": "sex_b", "race": "race_b"}), "patid")
    found.pop("scores")
    return P.profile_with_target(
        t.crosswalk, list(found.values()), "repeated", SIGNS, {"sex": ("sex_a", "sex_b"), "race": ("race_a", "race_b")}
    )


SIGNS = ["screen_sign", "inventory_sign", "pretrial_sign", "incident_sign", "client", "has_call", "service", "encounter_sign"]

PROFILE_VIEWS = (
    "crosswalk", "stays", "cases", "inventory", "name_index", "pretrial", "raw_incidents", "incidents", "admissions",
    "calls", "outcomes", "services", "encounters",
)
PROFILE = f"""
    ids as (select distinct entity_id, source, try_cast(source_key as bigint) as source_key, hash_key from crosswalk),
    inmates as (select entity_id as k, 1 as inmate, max(screen_flag) as screen_sign from stays group by 1),
    answered as (
      select c.entity_id as k, max(case when list_contains([a1, a2, a3], 1) or a2 = 0 then 1 else 0 end) as inventory_sign
      from cases c join inventory i using (case_no) where coalesce(a1, a2, a3) is not null group by 1),
    asked as (
      select cast(person_number as bigint) as k, max(cast(mh_flag = 'Y' as int)) as pretrial_sign
      from name_index join pretrial using (urno) where mh_flag in ('Y', 'N') group by 1),
    hit as (
      select r.hash_key as h, 1 as incident_sign from raw_incidents r join incidents i using (id)
      where regexp_matches(primary_txt || '#' || secondary_txt,
                           '{NEED_PATTERN}')
        and not contains(primary_txt || '#' || secondary_txt, '{NEED_EXCLUSION}')),
    clients as (select distinct patid as k, 1 as client from admissions),
    callers as (select distinct patid as k, 1 as has_call from calls where issue in {tuple(CALL_ISSUES)}),
    scores as (select patid as k, max(score_a) as max_score_a, min(score_a) as min_score_a,
                      max(score_b) as max_score_b, min(score_b) as min_score_b from outcomes group by 1),
    served as (select distinct patid as k, 1 as service from services),
    met as (select distinct cast(patient_no as bigint) as k, 1 as encounter_sign from encounters
            where contains(program, '{ENCOUNTER_PATTERN}')),
    profile as (
      select ids.*, inmate, screen_sign, inventory_sign, pretrial_sign, incident_sign, client, has_call,
             max_score_a, min_score_a, max_score_b, min_score_b, service, encounter_sign
      from ids
      left join inmates on inmates.k = source_key and source = 'PERSON.NUMBER'
      left join answered on answered.k = source_key and source = 'PERSON.NUMBER'
      left join asked on asked.k = source_key and source = 'PERSON.NUMBER'
      left join hit on hit.h = hash_key and source = 'INCIDENT.HASH'
      left join clients on clients.k = source_key and source = 'PATIENT.ID'
      left join callers on callers.k = source_key and source = 'PATIENT.ID'
      left join scores on scores.k = source_key and source = 'PATIENT.ID'
      left join served on served.k = source_key and source = 'PATIENT.ID'
      left join met on met.k = source_key and source = 'PATIENT.ID')"""

QUERIES = {
    "feature_interval_count": Query(
        _booking_counts,
        f"with {SPINE}, {BOOKED} select * from counts",
        ("crosswalk", "bail"),
    ),
    "feature_interval_max": Query(
        lambda t: X.feature_intervals(stay_events(t), DATES, SCREENS),
        f"""with {SPINE}
            select entity_id, as_of_date, max(screen_flag) as screen_5y_flag_max
            from stays join spine on start_ts < as_of_date and start_ts >= as_of_date - interval '5' year group by all""",
        ("stays",),
    ),
    "feature_asof_count": Query(
        lambda t: X.feature_intervals(stay_events(t), DATES, KNOWN),
        f"""with {SPINE}
            select entity_id, as_of_date, count(*) as cnt_bookings_all_prior_count
            from stays join spine on start_ts < as_of_date group by all""",
        ("stays",),
    ),
    "feature_interval_stats": Query(
        lambda t: X.feature_intervals(stay_events(t), DATES, STAYS, tiebreak=["stay_id"]),
        f"""with {SPINE},
            e as (select entity_id, start_ts as kd, stay_id, date_diff('day', start_ts, end_ts) as d from stays),
            seen as (
              select e.entity_id, as_of_date, kd, cast(d as int) as days,
                     first_value(cast(d as int)) over w as last_days, first_value(kd) over w as last_kd
              from e join spine on kd < as_of_date
              window w as (partition by entity_id, as_of_date order by kd desc, stay_id desc))
            select entity_id, as_of_date, {_stats_sql("1y", "kd >= as_of_date - interval '1' year")},
                   {_stats_sql("3y", "kd >= as_of_date - interval '3' year")}, {_stats_sql("all", "true")}
            from seen group by all""",
        ("stays",),
    ),
    "impute_constant": Query(
        lambda t: X.impute_constant(cohort(t), _booking_counts(t), BOOKINGS.names()),
        f"""with {SPINE}, {COHORT}, {BOOKED}
            select c.entity_id, c.as_of_date, ifnull(bkgs_1y_prior_count, 0) as bkgs_1y_prior_count,
                   ifnull(bkgs_5y_prior_count, 0) as bkgs_5y_prior_count,
                   ifnull(bkgs_all_prior_count, 0) as bkgs_all_prior_count,
                   cast(bkgs_1y_prior_count is null as int) as bkgs_1y_prior_count_imp,
                   cast(bkgs_5y_prior_count is null as int) as bkgs_5y_prior_count_imp,
                   cast(bkgs_all_prior_count is null as int) as bkgs_all_prior_count_imp
            from cohort c left join counts using (entity_id, as_of_date)""",
        ("crosswalk", "stays", "bail"),
    ),
    "feature_time_since_last": Query(
        lambda t: X.feature_time_since_last(t.stays, cohort(t), "start_ts", "since_last_stay", DATES),
        f"""with {SPINE}, {COHORT}
            select c.entity_id, c.as_of_date,
                   date_diff('second', max(s.start_ts), cast(c.as_of_date as timestamp)) as since_last_stay
            from cohort c join stays s on s.entity_id = c.entity_id and s.start_ts <= c.as_of_date
            group by c.entity_id, c.as_of_date""",
        ("stays",),
    ),
    "feature_time_since_last_as_written": Query(
        lambda t: X.feature_time_since_last(t.stays, cohort(t), "start_ts", "since_last_stay"),
        f"""with {SPINE}, {COHORT}
            select c.entity_id, c.as_of_date,
                   date_diff('second', max(s.start_ts), cast(c.as_of_date as timestamp)) as since_last_stay
            from cohort c join stays s on s.entity_id = c.entity_id
            group by c.entity_id, c.as_of_date having max(s.start_ts) <= c.as_of_date""",
        ("stays",),
    ),
    "feature_time_since_any": Query(
        lambda t: X.feature_time_since_any(N.need_log(t), cohort(t), "screen", "since_last_need", DATES),
        f"""with {SPINE}, {N.LOG}, {COHORT}, {RECENT}
            select c.entity_id, c.as_of_date,
                   date_diff('second', last_ts, cast(c.as_of_date as timestamp)) as since_last_need
            from cohort c join recent using (entity_id, as_of_date) where sign = 1 and based""",
        N.LOG_VIEWS,
    ),
    "feature_time_since_any_as_written": Query(
        lambda t: X.feature_time_since_any(N.need_log(t), cohort(t), "screen", "since_last_need"),
        f"""with {SPINE}, {N.LOG}, {COHORT}, {RECENT}
            select c.entity_id, c.as_of_date,
                   date_diff('second', last_ts, cast(c.as_of_date as timestamp)) as since_last_need
            from cohort c join ever using (entity_id) where sign = 1 and based and last_ts <= c.as_of_date""",
        N.LOG_VIEWS,
    ),
    "feature_demographics": Query(
        lambda t: X.feature_demographics(t.people, "person_number", "age", ["sex", "race", "marital_status"]).withColumn(
            "avg_age", F.round("avg_age", 6)
        ),
        """select person_number, round(avg(age), 6) as avg_age, max(sex) as sex, max(race) as race,
                  max(marital_status) as marital_status from people group by person_number""",
        ("people",),
    ),
    "feature_score_extrema": Query(
        lambda t: X.feature_score_extrema(t.outcomes, "patid", ["score_a", "score_b"]),
        """select patid, max(score_a) as max_score_a, min(score_a) as min_score_a, max(score_b) as max_score_b,
                  min(score_b) as min_score_b from outcomes group by patid""",
        ("outcomes",),
    ),
    "feature_distinct_dates": Query(
        lambda t: X.feature_distinct_dates(t.admissions, "patid", "admit_ts"),
        "select patid, count(distinct admit_ts) as n_dates from admissions group by patid",
        ("admissions",),
    ),
    "feature_most_common": Query(
        lambda t: X.feature_most_common(t.insurance, "patid", "payor"),
        """select distinct on (patid) patid, payor
           from (select patid, payor, count(*) as n from insurance group by all) order by patid, n desc, payor""",
        ("insurance",),
    ),
    "feature_source_frequency": Query(
        lambda t: X.feature_source_frequency(t.crosswalk, HASH),
        "select entity_id, count(hash_key) as source_freq from crosswalk where source = 'INCIDENT.HASH' group by entity_id",
        ("crosswalk",),
    ),
    "profile_patient": Query(
        lambda t: P.profile_patient(
            S.signal_issue_calls(t.calls, "patid", "issue", CALL_ISSUES).drop("has_call"),
            X.feature_distinct_dates(t.diagnoses, "patid", "dx_ts"),
            X.feature_most_common(t.insurance, "patid", "payor"),
            X.feature_score_extrema(t.outcomes, "patid", ["score_a", "score_b"]),
            L.distinct_entities(t.crosswalk, PATIENT),
            L.distinct_entities(t.crosswalk),
            "patid",
        ),
        f"""with ac as (select patid, count(distinct dx_ts) as n_dates from diagnoses group by patid),
                mhc as (select patid, count(*) as n_calls from calls where issue in {tuple(CALL_ISSUES)} group by patid),
                pays as (select distinct on (patid) patid, payor
                         from (select patid, payor, count(*) as n from insurance group by all) order by patid, n desc, payor),
                marks as (select patid, max(score_a) as max_score_a, min(score_a) as min_score_a,
                                 max(score_b) as max_score_b, min(score_b) as min_score_b from outcomes group by patid),
                ids as (select distinct entity_id, try_cast(source_key as bigint) as k
                        from crosswalk where source = 'PATIENT.ID'),
                everyone as (select distinct entity_id from crosswalk)
           select ac.patid, n_calls, n_dates, payor, max_score_a, min_score_a, max_score_b, min_score_b, everyone.entity_id
           from ac full join mhc on mhc.patid = ac.patid full join pays on pays.patid = ac.patid
           full join marks on marks.patid = ac.patid full join ids on ids.k = ac.patid
           full join everyone on everyone.entity_id = ids.entity_id""",
        ("crosswalk", "diagnoses", "calls", "insurance", "outcomes"),
    ),
    "profile_by_source": Query(
        lambda t: P.profile_by_source(t.crosswalk, list(_attachments(t).values())),
        f"with {PROFILE} select * from profile",
        PROFILE_VIEWS,
    ),
    "profile_with_target": Query(
        _profile_with_target,
        f"""with {PROFILE},
            twice as (select entity_id as k, 1 as repeated from stays group by 1 having count(start_ts) > 1),
            person as (select person_number as k, round(avg(age), 6) as avg_age, max(sex) as sex, max(race) as race,
                              max(marital_status) as marital_status from people group by 1),
            often as (select entity_id as k, count(hash_key) as source_freq from crosswalk
                      where source = 'INCIDENT.HASH' group by 1)
            select p.entity_id, p.source, source_key, p.hash_key, inmate, screen_sign, inventory_sign, pretrial_sign,
                   incident_sign, client, has_call, service, encounter_sign, avg_age, marital_status, repeated, source_freq,
                   coalesce(person.sex, d.sex) as sex, coalesce(person.race, d.race) as race,
                   case when repeated = 1 and greatest(screen_sign, inventory_sign, pretrial_sign, incident_sign, client,
                                                       has_call, service, encounter_sign) = 1 then 1 else 0 end as target
            from profile p
            left join twice on twice.k = source_key and source = 'PERSON.NUMBER'
            left join person on person.k = source_key and source = 'PERSON.NUMBER'
            left join often on often.k = p.entity_id and source = 'INCIDENT.HASH'
            left join demographics d on d.patid = source_key and source = 'PATIENT.ID'""",
        (*PROFILE_VIEWS, "people", "demographics"),
    ),
    "label_composite_target": Query(
        lambda t: _profile_with_target(t).select("entity_id", "source", "source_key", "hash_key", "repeated", *SIGNS, "target"),
        f"""with {PROFILE},
            twice as (select entity_id as k, 1 as repeated from stays group by 1 having count(start_ts) > 1)
            select entity_id, source, source_key, hash_key, repeated, {', '.join(SIGNS)},
                   case when repeated = 1 and greatest({', '.join(SIGNS)}) = 1 then 1 else 0 end as target
            from profile left join twice on twice.k = source_key and source = 'PERSON.NUMBER'""",
        PROFILE_VIEWS,
    ),
}
