"""Labels."""

from __future__ import annotations

from fixtures import need as N
from fixtures.catalog import DATES, HORIZON, LOOKBACK, SPINE, TIMESPANS, Query
from fixtures.cohort_queries import LONG, NEED
from hindcast.operators import cohorts as C
from hindcast.operators import labels as L
from hindcast.operators import signals as S
from hindcast.plans.study import labelled_cohort, labelled_grid

GRID = f"""{NEED},
    spans as (select as_of_date, '6 months' as label_timespan, hi as until from spine
              union all select as_of_date, '1yr', hi_year from spine),
    grid as (
      select m.entity_id, m.as_of_date, label_timespan,
             max(case when s.start_ts between m.as_of_date and until and {LONG} then 1 else 0 end) as label
      from members m join spans using (as_of_date) join stays s using (entity_id) group by all)"""


def grid(t):
    return labelled_grid(t.stays, N.need_log(t), DATES, LOOKBACK, TIMESPANS)


def in_need(t):
    signs = S.signs_at(N.need_log(t), DATES, LOOKBACK)
    return C.cohort_with_signal(C.cohort_last_stay_closed(t.stays, DATES, LOOKBACK), signs)


LABELS = f"""{NEED},
    labels as (
      select m.entity_id, m.as_of_date,
             max(case when s.start_ts between m.as_of_date and a.hi and {LONG} then 1 else 0 end) as label
      from members m join spine a using (as_of_date) join stays s using (entity_id) group by all)"""


def _simplified(t):
    log = S.signal_log(N.screen(t), N.pretrial(t, source=None))
    seen = C.cohort_table(t.stays, DATES, LOOKBACK)
    return L.label_simplified(t.stays, S.signs_at(log, DATES, LOOKBACK), seen, DATES, HORIZON)


QUERIES = {
    "label_reevent_long": Query(
        lambda t: labelled_cohort(t.stays, N.need_log(t), DATES, LOOKBACK, HORIZON),
        f"with {LABELS} select * from labels",
        N.LOG_VIEWS,
    ),
    "label_reevent_long_composed": Query(
        lambda t: L.label_reevent_long(t.stays, in_need(t), DATES, HORIZON),
        f"with {LABELS} select * from labels",
        N.LOG_VIEWS,
    ),
    "label_reevent_any": Query(
        lambda t: L.label_reevent_any(t.stays, in_need(t), DATES, HORIZON),
        f"""with {NEED}
            select m.entity_id, m.as_of_date,
                   max(case when s.start_ts is null then null
                            when s.start_ts between m.as_of_date and a.hi then 1 else 0 end) as label
            from members m join spine a using (as_of_date) left join stays s using (entity_id) group by all""",
        N.LOG_VIEWS,
    ),
    "label_positive_only": Query(
        lambda t: L.label_positive_only(t.stays, DATES, HORIZON),
        f"""with {SPINE}
            select distinct entity_id, as_of_date, 1 as label
            from stays join spine on start_ts between as_of_date and hi where {LONG}""",
        ("stays",),
    ),
    "label_simplified": Query(
        _simplified,
        f"""with {SPINE},
            seen as (select entity_id, as_of_date, max(screen_flag) as screen
                     from stays join spine on start_ts between lo and as_of_date group by all),
            asked as (select x.entity_id, as_of_date, bool_or(mh_flag = 'Y') as yes
                      from pretrial join name_index n using (urno) join crosswalk x on x.source_key = n.person_number
                      join spine on created_ts between lo and as_of_date group by all)
            select e.entity_id, e.as_of_date,
                   max(case when s.start_ts between e.as_of_date and a.hi and {LONG} then 1 else 0 end) as label
            from seen e left join asked q on q.entity_id = e.entity_id and q.as_of_date = e.as_of_date
            join spine a on a.as_of_date = e.as_of_date join stays s on s.entity_id = e.entity_id
            where e.screen = 1 or q.yes group by all""",
        ("crosswalk", "stays", "name_index", "pretrial"),
    ),
    "label_grid": Query(grid, f"with {GRID} select * from grid", N.LOG_VIEWS),
    "label_grid_composed": Query(
        lambda t: L.label_grid(t.stays, in_need(t), DATES, TIMESPANS), f"with {GRID} select * from grid", N.LOG_VIEWS
    ),
    "label_positive_count": Query(
        lambda t: L.label_positive_count(grid(t)),
        f"with {GRID} select count(*) filter (label = 1) as n_positive from grid",
        N.LOG_VIEWS,
    ),
}
