"""Need signals, one source at a time and combined."""

from __future__ import annotations

from fixtures import need as N
from fixtures.catalog import DATES, LOOKBACK, SPINE, Query
from fixtures.cohort_queries import COHORT, T0, T1, T2
from fixtures.linkage_queries import PATIENT
from hindcast.operators import cohorts as C
from hindcast.operators import signals as S
from hindcast.operators.linkage import link_entity
from hindcast.presets import BASE_RATE_SIGNALS, CALL_ISSUES

PERIODS = {"sign_history": (T0, T1), "sign_outcome": (T1, T2)}
MEMBERS = """
    members as (select distinct entity_id from stays
                where start_ts > date '1998-07-01' and end_ts < date '2000-07-01')"""
BY_PERIOD = """
    max(sign) filter (ts between date '1998-07-01' and date '2000-07-01') as sign_history,
    max(sign) filter (ts between date '2000-07-01' and date '2001-01-01') as sign_outcome"""
WIDE_COLUMNS = ", ".join(f"max(sign) filter (signal = '{s}') as {s}" for s in N.SIGNALS)


def _one(log, signal: str) -> Query:
    return Query(
        lambda t: S.signs_at(log(t), DATES, LOOKBACK),
        f"""with {SPINE}, {N.LOG}
            select entity_id, as_of_date, max(sign) as sign from log join spine on ts between lo and as_of_date
            where signal = '{signal}' group by all""",
        N.LOG_VIEWS,
    )


def _clients(t):
    return link_entity(t.admissions, t.crosswalk, PATIENT, "patid")


def _wide(t):
    cohort = C.cohort_last_stay_closed(t.stays, DATES, LOOKBACK)
    return S.signals_wide(N.need_log(t), N.SIGNALS, DATES, LOOKBACK, cohort)


WIDE = f"""{SPINE}, {N.LOG}, {COHORT},
    wide as (
      select c.entity_id, c.as_of_date, {WIDE_COLUMNS}
      from cohort c join spine a using (as_of_date)
      left join log g on g.entity_id = c.entity_id and g.ts between a.lo and a.as_of_date
      group by all)"""

QUERIES = {
    "signal_max_flag": _one(N.screen, "screen"),
    "signal_any_of": _one(N.inventory, "inventory"),
    "signal_yes_no": _one(N.pretrial, "pretrial"),
    "signal_regex": _one(N.encounter, "encounter"),
    "signal_regex_exclude": _one(N.incident, "incident"),
    "signal_in_list": _one(N.admission, "admission"),
    "signal_ilike_any": _one(N.call, "call"),
    "signal_ilike_any_as_written": Query(
        lambda t: S.signs_at(N.call(t, as_written=True), DATES, LOOKBACK),
        f"""with {SPINE}, {N.LOG}
            select distinct o.entity_id, as_of_date, 1 as sign
            from calls join owner o on k = patid
            join spine on (call_ts between lo and as_of_date and risk_txt ilike '%homicid%') or risk_txt ilike '%violence%'""",
        N.LOG_VIEWS,
    ),
    "signal_presence": Query(
        lambda t: S.signal_presence(
            {"inmate": (t.bail, "person_number"), "client": (t.admissions, "patid"), "service": (t.services, "patid"),
             "caller": (t.calls, "patid")}
        ),
        """select person_number as source_id, 'inmate' as signal, 1 as sign from bail group by all
           union all select patid, 'client', 1 from admissions group by all
           union all select patid, 'service', 1 from services group by all
           union all select patid, 'caller', 1 from calls group by all""",
        ("bail", "admissions", "services", "calls"),
    ),
    "signal_presence_window": Query(
        lambda t: S.signs_at(S.presence_log(_clients(t), "client", "admit_ts"), DATES, LOOKBACK),
        f"""with {SPINE}, {N.LOG}
            select distinct o.entity_id, as_of_date, 1 as sign
            from admissions join owner o on k = patid join spine on admit_ts between lo and as_of_date""",
        N.LOG_VIEWS,
    ),
    "signal_issue_calls": Query(
        lambda t: S.signal_issue_calls(t.calls, "patid", "issue", CALL_ISSUES),
        """select patid, count(*) as n_calls, 1 as has_call from calls
           where list_contains(%s, issue) group by patid""" % CALL_ISSUES,
        ("calls",),
    ),
    "signals_wide": Query(_wide, f"with {WIDE} select * from wide", N.LOG_VIEWS),
    "signal_combine_greatest": Query(
        lambda t: S.signal_combine_greatest(_wide(t), N.SIGNALS),
        f"with {WIDE} select entity_id, as_of_date, greatest({', '.join(N.SIGNALS)}) as sign from wide",
        N.LOG_VIEWS,
    ),
    "signal_combine_zero_filled": Query(
        lambda t: S.signal_combine_zero_filled(N.need_log(t, BASE_RATE_SIGNALS), PERIODS),
        f"""with {N.LOG},
            history as (select entity_id, max(sign) as h from log where signal in {tuple(BASE_RATE_SIGNALS)}
                        and ts between date '1998-07-01' and date '2000-07-01' group by entity_id),
            outcome as (select entity_id, max(sign) as o from log where signal in {tuple(BASE_RATE_SIGNALS)}
                        and ts between date '2000-07-01' and date '2001-01-01' group by entity_id)
            select entity_id, ifnull(h, 0) as sign_history, ifnull(o, 0) as sign_outcome
            from history full join outcome using (entity_id)""",
        N.LOG_VIEWS,
    ),
    "signal_two_periods": Query(
        lambda t: S.signal_two_periods(N.need_log(t), PERIODS, C.cohort_any_closed_stay(t.stays, T0, T1)),
        f"""with {N.LOG}, {MEMBERS}
            select m.entity_id, {BY_PERIOD} from members m left join log using (entity_id) group by m.entity_id""",
        N.LOG_VIEWS,
    ),
}
