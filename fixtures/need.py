"""The seven need sources of the test tables as one signal log, and the same log as SQL."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame

from fixtures.adapters import Tables
from fixtures.linkage_queries import HASH, NUMBER, PATIENT
from hindcast.operators import linkage as L
from hindcast.operators import signals as S
from hindcast.presets import (
    ADMISSION_PROGRAMS,
    CALL_RISK_PATTERNS,
    ENCOUNTER_PATTERN,
    NEED_EXCLUSION,
    NEED_PATTERN,
)

SIGNALS = ["screen", "inventory", "pretrial", "encounter", "incident", "admission", "call"]
# What the log of a signal reads of its linked events besides the entity and the timestamp; keys of the linking are not among it.
READS = {
    "screen": ["screen_flag"], "inventory": ["a1", "a2", "a3"], "pretrial": ["mh_flag"], "encounter": ["program"],
    "incident": ["primary_txt", "secondary_txt"], "admission": ["program_description"], "call": ["risk_txt"],
}


def linked(t: Tables, name: str, source: str | None = NUMBER) -> tuple[DataFrame, str]:
    """The linked events of a signal's source, and their timestamp."""
    if name == "screen":
        return t.stays, "start_ts"
    if name == "inventory":
        return L.link_via(t.inventory, t.cases, "case_no"), "assessed_ts"
    if name == "pretrial":
        return L.link_two_hop(t.pretrial, t.name_index, "urno", "person_number", t.crosswalk, source), "created_ts"
    if name == "encounter":
        return L.link_entity(t.encounters, t.crosswalk, PATIENT, "patient_no"), "encounter_ts"
    if name == "incident":
        return L.link_hashed(t.raw_incidents, t.incidents, "id", "hash_key", t.crosswalk, HASH), "incident_ts"
    if name == "admission":
        return L.link_entity(t.admissions, t.crosswalk, PATIENT, "patid"), "admit_ts"
    return L.link_entity(t.calls, t.crosswalk, PATIENT, "patid"), "call_ts"


def log_of(name: str, events: DataFrame, ts: str, as_written: bool = False) -> DataFrame:
    """The log of a signal from the linked events of its source."""
    if name == "screen":
        return S.flag_log(events, name, ts, "screen_flag")
    if name == "inventory":
        return S.answers_log(events, name, ts, ["a1", "a2", "a3"], ["a2"])
    if name == "pretrial":
        return S.yes_no_log(events, name, ts, "mh_flag")
    if name == "encounter":
        return S.regex_log(events, name, ts, "program", ENCOUNTER_PATTERN)
    if name == "incident":
        return S.regex_exclude_log(events, name, ts, ["primary_txt", "secondary_txt"], NEED_PATTERN, NEED_EXCLUSION)
    if name == "admission":
        return S.in_list_log(events, name, ts, "program_description", ADMISSION_PROGRAMS)
    return S.ilike_log(events, name, ts, "risk_txt", CALL_RISK_PATTERNS, as_written)


def screen(t: Tables) -> DataFrame:
    return log_of("screen", *linked(t, "screen"))


def inventory(t: Tables) -> DataFrame:
    return log_of("inventory", *linked(t, "inventory"))


def pretrial(t: Tables, source: str | None = NUMBER) -> DataFrame:
    return log_of("pretrial", *linked(t, "pretrial", source))


def encounter(t: Tables) -> DataFrame:
    return log_of("encounter", *linked(t, "encounter"))


def incident(t: Tables) -> DataFrame:
    return log_of("incident", *linked(t, "incident"))


def admission(t: Tables) -> DataFrame:
    return log_of("admission", *linked(t, "admission"))


def call(t: Tables, as_written: bool = False) -> DataFrame:
    return log_of("call", *linked(t, "call"), as_written)


def need_log(t: Tables, names: list[str] = SIGNALS, store: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """The log of all sources; `store` keeps what the log reads of each one's linked events, four side by side, and gives it back as stored."""
    sources = [(name, *linked(t, name)) for name in names]
    if store:
        sources = [(name, events.select("entity_id", ts, *READS[name]), ts) for name, events, ts in sources]
        with ThreadPoolExecutor(4) as pool:
            sources = list(pool.map(lambda source: (source[0], store(*source[1:]), source[2]), sources))
    return S.signal_log(*[log_of(*source) for source in sources])


LOG_VIEWS = (
    "crosswalk", "stays", "cases", "inventory", "name_index", "pretrial", "encounters", "raw_incidents", "incidents",
    "admissions", "calls",
)

CALLED = "(" + " or ".join(f"risk_txt ilike '{p}'" for p in CALL_RISK_PATTERNS) + ")"
LOG = f"""
    owner as (select try_cast(source_key as bigint) as k, min(entity_id) as entity_id
              from crosswalk where source = 'PATIENT.ID' group by 1),
    log as (
      select entity_id, start_ts as ts, 'screen' as signal, screen_flag as sign from stays
      union all
      select c.entity_id, assessed_ts, 'inventory',
             case when list_contains([a1, a2, a3], 1) or a2 = 0 then 1 when coalesce(a1, a2, a3) is not null then 0 end
      from inventory join cases c using (case_no)
      union all
      select x.entity_id, created_ts, 'pretrial', case mh_flag when 'Y' then 1 when 'N' then 0 end
      from pretrial join name_index n using (urno)
      join crosswalk x on x.source = 'PERSON.NUMBER' and x.source_key = n.person_number
      union all
      select o.entity_id, encounter_ts, 'encounter', 1 from encounters join owner o on k = cast(patient_no as bigint)
      where contains(program, '{ENCOUNTER_PATTERN}')
      union all
      select x.entity_id, incident_ts, 'incident', 1
      from incidents join raw_incidents r using (id)
      join crosswalk x on x.hash_key = r.hash_key and x.source = 'INCIDENT.HASH'
      where regexp_matches(primary_txt || '#' || secondary_txt,
                           '{NEED_PATTERN}')
        and not contains(primary_txt || '#' || secondary_txt, '{NEED_EXCLUSION}')
      union all
      select o.entity_id, admit_ts, 'admission', 1 from admissions join owner o on k = patid
      where list_contains({ADMISSION_PROGRAMS}, program_description)
      union all
      select o.entity_id, call_ts, 'call', 1 from calls join owner o on k = patid
      where {CALLED})"""
