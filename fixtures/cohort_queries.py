"""Cohorts, status and base rates."""

from __future__ import annotations

from fixtures.catalog import DATES, LOOKBACK, SPINE, Query
from fixtures.need import LOG, LOG_VIEWS, need_log
from hindcast.operators import cohorts as C
from hindcast.operators.linkage import distinct_entities
from hindcast.operators.signals import signs_at
from hindcast.presets import BASE_RATE_SIGNALS

T0, T1, T2 = "1998-07-01", "2000-07-01", "2001-01-01"
NOW = "2002-01-01"

COHORT = """
    latest as (
      select entity_id, as_of_date, start_ts, end_ts,
             rank() over (partition by entity_id, as_of_date order by start_ts desc) as place
      from stays join spine on start_ts between lo and as_of_date),
    cohort as (
      select entity_id, as_of_date from latest where place = 1 and end_ts < as_of_date group by all)"""

NEED = f"""{SPINE}, {LOG}, {COHORT},
    members as (
      select c.entity_id, c.as_of_date from cohort c join spine a using (as_of_date)
      join log g on g.entity_id = c.entity_id and g.ts between a.lo and a.as_of_date
      group by all having bool_or(g.sign = 1))"""

OPEN = "start_ts < date '2000-07-01' and coalesce(end_ts, timestamp '9999-01-01 00:00:00') > date '2000-07-01'"
LONG = "ifnull(end_ts, timestamp '2099-01-01 00:00:00') > start_ts + interval '14' day"

REPORT = f"""
    running as (
      select entity_id, start_ts, end_ts,
             row_number() over (partition by entity_id order by start_ts, stay_id) as place
      from stays where {OPEN}),
    report as (
      select s.entity_id, s.stay_id, case when r.entity_id is null then 0 else 1 end as in_stay,
             r.start_ts as current_start, r.end_ts as current_end,
             date_diff('second', r.start_ts, ifnull(r.end_ts, timestamp '2002-01-01 00:00:00')) as duration_s
      from stays s left join running r on r.entity_id = s.entity_id and r.place = 1)"""

FLAGS = f"""
    counted as (
      select entity_id,
             count(*) filter (start_ts > date '1998-07-01' and start_ts < date '2000-07-01' and {LONG}) as before,
             count(*) filter (start_ts > date '2000-07-01' and start_ts < date '2001-01-01' and {LONG}) as after,
             count(*) filter ({OPEN}) as running
      from stays group by entity_id),
    shown as (
      select entity_id,
             max(sign) filter (ts between date '1998-07-01' and date '2000-07-01') as h,
             max(sign) filter (ts between date '2000-07-01' and date '2001-01-01') as o
      from log where signal in {tuple(BASE_RATE_SIGNALS)} group by entity_id),
    flags as (
      select u.entity_id, ifnull(before, 0) as stays_before, ifnull(after, 0) as stays_after,
             cast(ifnull(running, 0) > 0 as int) as in_stay, ifnull(h, 0) as sign_history, ifnull(o, 0) as sign_outcome,
             cast(ifnull(before, 0) > 0 and ifnull(running, 0) = 0 as int) as cohort,
             cast(ifnull(before, 0) > 0 and ifnull(running, 0) = 0 and ifnull(after, 0) > 0
                  and (ifnull(h, 0) = 1 or ifnull(o, 0) = 1) as int) as outcome,
             cast(ifnull(before, 0) > 0 as int) as stayed_before, cast(ifnull(after, 0) > 0 as int) as stayed_after
      from (select distinct entity_id from crosswalk) u
      left join counted using (entity_id) left join shown using (entity_id))"""


def _flags(t):
    log = need_log(t, BASE_RATE_SIGNALS)
    return C.base_rate_flags(distinct_entities(t.crosswalk), t.stays, log, T0, T1, T2)


QUERIES = {
    "cohort_last_stay_closed": Query(
        lambda t: C.cohort_last_stay_closed(t.stays, DATES, LOOKBACK),
        f"with {SPINE}, {COHORT} select entity_id, as_of_date from cohort",
        ("stays",),
    ),
    "cohort_last_long_stay_closed": Query(
        lambda t: C.cohort_last_long_stay_closed(t.stays, DATES, LOOKBACK),
        f"""with {SPINE},
            latest as (
              select entity_id, as_of_date, max(start_ts) as start_ts
              from stays join spine on start_ts between lo and as_of_date where {LONG} group by all)
            select distinct l.entity_id, l.as_of_date
            from latest l join stays s on s.entity_id = l.entity_id and s.start_ts = l.start_ts
            where s.end_ts < l.as_of_date""",
        ("stays",),
    ),
    "cohort_any_closed_stay": Query(
        lambda t: C.cohort_any_closed_stay(t.stays, T0, T1),
        """select entity_id from stays
           where start_ts > date '1998-07-01' and end_ts < date '2000-07-01' group by entity_id""",
        ("stays",),
    ),
    "cohort_with_signal": Query(
        lambda t: C.cohort_with_signal(
            C.cohort_last_stay_closed(t.stays, DATES, LOOKBACK), signs_at(need_log(t), DATES, LOOKBACK)
        ),
        f"with {NEED} select entity_id, as_of_date from members",
        LOG_VIEWS,
    ),
    "stay_count_window": Query(
        lambda t: C.stay_count_window(t.stays, {"n_before": (T0, T1), "n_after": (T1, T2)}),
        f"""with w as (
              select entity_id,
                     count(*) filter (start_ts > date '1998-07-01' and start_ts < date '2000-07-01') as n_before,
                     count(*) filter (start_ts > date '2000-07-01' and start_ts < date '2001-01-01') as n_after
              from stays where {LONG} group by entity_id)
            select * from w where n_before + n_after > 0""",
        ("stays",),
    ),
    "stay_count_before": Query(
        lambda t: C.stay_count_before(t.stays, T1),
        f"""select e.entity_id, count(s.stay_id) as n_stays
            from (select distinct entity_id from stays) e
            left join stays s on s.entity_id = e.entity_id and s.start_ts < date '2000-07-01' and {LONG}
            group by e.entity_id""",
        ("stays",),
    ),
    "status_as_of": Query(
        lambda t: C.status_as_of(t.stays, T1),
        f"select distinct entity_id, 1 as in_stay from stays where {OPEN}",
        ("stays",),
    ),
    "status_report": Query(
        lambda t: C.status_report(t.stays, T1, NOW), f"with {REPORT} select * from report", ("stays",)
    ),
    "status_summary": Query(
        lambda t: C.status_summary(C.status_report(t.stays, T1, NOW)),
        f"with {REPORT} select in_stay, count(entity_id) as n_rows from report group by in_stay",
        ("stays",),
    ),
    "base_rate_flags": Query(_flags, f"with {LOG}, {FLAGS} select * from flags", LOG_VIEWS),
    "base_rate_summary": Query(
        lambda t: C.base_rate_summary(_flags(t)),
        f"""with {LOG}, {FLAGS}
            select count(*) as n_entities, cast(sum(cohort) as bigint) as n_cohort,
                   cast(sum(outcome) as bigint) as n_outcome, cast(sum(sign_history) as bigint) as n_sign_history,
                   cast(sum(sign_outcome) as bigint) as n_sign_outcome,
                   cast(sum(stayed_before) as bigint) as n_stayed_before,
                   cast(sum(stayed_after) as bigint) as n_stayed_after
            from flags""",
        LOG_VIEWS,
    ),
    "repeat_event_flag": Query(
        lambda t: C.repeat_event_flag(t.stays),
        "select entity_id, 1 as repeated from stays group by entity_id having count(start_ts) > 1",
        ("stays",),
    ),
    "cohort_table": Query(
        lambda t: C.cohort_table(t.stays, DATES, LOOKBACK),
        f"""with {SPINE}, {COHORT}
            select l.entity_id, l.as_of_date, bool_or(c.entity_id is not null) as active
            from latest l left join cohort c using (entity_id, as_of_date) group by all""",
        ("stays",),
    ),
}
