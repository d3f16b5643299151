"""Sources, cleaning and linkage."""

from __future__ import annotations

from fixtures.adapters import SCHEMAS
from fixtures.catalog import Query
from hindcast.operators import linkage as L
from hindcast.presets import MISSING_END_TIME, MISSING_START_TIME
from hindcast.sources.tables import load_source

NUMBER, PATIENT, HASH = "PERSON.NUMBER", "PATIENT.ID", "INCIDENT.HASH"

# One smallest entity per key of a tag, as SQL.
ONE_PER_PATIENT = """
    keys as (select try_cast(source_key as bigint) as k, min(entity_id) as entity_id
             from crosswalk where source = 'PATIENT.ID' group by 1)"""


def _composed(t):
    starts = L.compose_timestamp(t.raw_stays, "start_date", "start_time", MISSING_START_TIME, "start_ts")
    both = L.compose_timestamp(starts, "end_date", "end_time", MISSING_END_TIME, "end_ts")
    return both.select("event_id", "user_id", "start_ts", "end_ts")


def _linked_calls(t):
    return L.link_entity(t.calls, t.crosswalk, PATIENT, "patid")


def _extract(view: str, source: str, key: str, columns: list[str], kind: str = "number") -> Query:
    """A source table beside its crosswalk slice."""
    listed = ", ".join(f"s.{c}" for c in [key, *columns])
    id_key = {"number": "try_cast(source_key as bigint)", "text": "source_key", "hash": "hash_key"}[kind]
    own_key = f"try_cast(s.{key} as bigint)" if kind == "number" else f"s.{key}"
    return Query(
        lambda t: L.linked_extract(getattr(t, view), t.crosswalk, source, key, columns, kind),
        f"""select {listed}, ids.entity_id from {view} s full join
              (select entity_id, {id_key} as k from crosswalk where source = '{source}') ids on ids.k = {own_key}""",
        ("crosswalk", view),
    )


EXTRACTS = {
    "linked_extract": _extract("admissions", PATIENT, "patid", ["admit_ts", "program_description"]),
    "linked_extract_encounters": _extract("encounters", PATIENT, "patient_no", ["encounter_ts", "program"]),
    "linked_extract_calls": _extract("calls", PATIENT, "patid", ["call_ts", "issue", "risk_txt"]),
    "linked_extract_demographics": _extract("demographics", PATIENT, "patid", ["sex", "race"]),
    "linked_extract_diagnoses": _extract("diagnoses", PATIENT, "patid", ["dx_ts", "dx_code", "description"]),
    "linked_extract_discharges": _extract("discharges", PATIENT, "patid", ["admit_ts", "discharged_ts", "reason"]),
    "linked_extract_income": _extract("income", PATIENT, "patid", ["income", "effect_ts"]),
    "linked_extract_insurance": _extract("insurance", PATIENT, "patid", ["payor", "effect_ts"]),
    "linked_extract_outcomes": _extract("outcomes", PATIENT, "patid", ["score_a", "score_b"]),
    "linked_extract_services": _extract("services", PATIENT, "patid", ["service_desc"]),
    "linked_extract_vocational": _extract("vocational", PATIENT, "patid", ["status", "status_ts"]),
    "linked_extract_bail": _extract("bail", NUMBER, "person_number", ["bail_no", "arranged_ts"]),
    "linked_extract_cases": _extract("case_data", NUMBER, "person_number", ["case_no", "case_status", "opened_ts"]),
    "linked_extract_hashed": _extract("raw_incidents", HASH, "hash_key", ["id"], "hash"),
    "linked_extract_arrests": _extract(
        "arrests", "LEGACY.CODE", "name_identifier", ["charge", "agency", "arrested_ts"], "text"
    ),
}

QUERIES = {
    **EXTRACTS,
    "load_source": Query(
        lambda t: load_source(t.spark, "orders", t.sf_dir, schema=SCHEMAS["orders"]),
        "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders",
    ),
    "compose_timestamp": Query(
        _composed,
        """select event_id, user_id,
                  cast(cast(start_date as varchar) || ' ' || ifnull(start_time, '00:00:01') as timestamp) as start_ts,
                  cast(cast(end_date as varchar) || ' ' || ifnull(end_time, '23:59:59') as timestamp) as end_ts
           from raw_stays""",
        ("raw_stays",),
    ),
    "link_entity": Query(
        lambda t: _linked_calls(t).select("patid", "call_ts", "issue", "entity_id"),
        f"""with {ONE_PER_PATIENT}
            select patid, call_ts, issue, entity_id from calls left join keys on k = patid""",
        ("crosswalk", "calls"),
    ),
    "link_entity_transitive": Query(
        lambda t: L.link_via(t.inventory, t.cases, "case_no").select("case_no", "inventory_no", "assessed_ts", "entity_id"),
        """with owner as (select case_no, min(entity_id) as entity_id from cases group by case_no)
           select case_no, inventory_no, assessed_ts, entity_id from inventory left join owner using (case_no)""",
        ("cases", "inventory"),
    ),
    "link_entity_twohop": Query(
        lambda t: L.link_two_hop(t.pretrial, t.name_index, "urno", "person_number", t.crosswalk, NUMBER).select(
            "urno", "created_ts", "mh_flag", "entity_id"
        ),
        """select p.urno, created_ts, mh_flag, c.entity_id
           from pretrial p left join name_index n on n.urno = p.urno
           left join crosswalk c on c.source = 'PERSON.NUMBER' and c.source_key = n.person_number""",
        ("crosswalk", "name_index", "pretrial"),
    ),
    "link_entity_hashed": Query(
        lambda t: L.link_hashed(t.raw_incidents, t.incidents, "id", "hash_key", t.crosswalk, HASH).select(
            "id", "hash_key", "entity_id", "incident_ts", "primary_txt"
        ),
        """select r.id, r.hash_key, c.entity_id, incident_ts, primary_txt
           from raw_incidents r left join incidents i on i.id = r.id
           left join crosswalk c on c.hash_key = r.hash_key and c.source = 'INCIDENT.HASH'""",
        ("crosswalk", "raw_incidents", "incidents"),
    ),
    "linked_events": Query(
        lambda t: L.linked_events(t.encounters, t.crosswalk, PATIENT, "patient_no", "encounter_ts", ["program"]),
        """select c.entity_id, e.encounter_ts as knowledge_date, e.program
           from crosswalk c join encounters e
             on c.source = 'PATIENT.ID' and try_cast(c.source_key as bigint) = try_cast(e.patient_no as bigint)""",
        ("crosswalk", "encounters"),
    ),
    "typed_crosswalk": Query(
        lambda t: L.typed_crosswalk(t.crosswalk),
        """select entity_id, source, try_cast(source_key as bigint) as source_key, hash_key
           from crosswalk group by all""",
        ("crosswalk",),
    ),
    "distinct_entities": Query(
        lambda t: L.distinct_entities(t.crosswalk),
        "select entity_id from crosswalk group by entity_id",
        ("crosswalk",),
    ),
    "distinct_entities_of_source": Query(
        lambda t: L.distinct_entities(t.crosswalk, PATIENT),
        """select entity_id, try_cast(source_key as bigint) as source_key
           from crosswalk where source = 'PATIENT.ID' group by all""",
        ("crosswalk",),
    ),
    "link_coverage": Query(
        lambda t: L.link_coverage(_linked_calls(t)),
        f"""with {ONE_PER_PATIENT}
            select count(*) filter (entity_id is null) as n_unlinked, count(*) as n_rows
            from calls left join keys on k = patid""",
        ("crosswalk", "calls"),
    ),
    "multiplicity_histogram": Query(
        lambda t: L.multiplicity_histogram(t.crosswalk),
        """select id_count, count(*) as freq
           from (select count(entity_id) as id_count from crosswalk group by entity_id) group by id_count""",
        ("crosswalk",),
    ),
    "join_fanout_histogram": Query(
        lambda t: L.join_fanout_histogram(t.bail, t.bail_info, "bail_no"),
        """select rows_per_key, count(*) as freq
           from (select count(b.bail_no) as rows_per_key
                 from bail b left join bail_info i on i.bail_no = b.bail_no group by b.bail_no)
           group by rows_per_key""",
        ("bail", "bail_info"),
    ),
    "charges_per_entity_histogram": Query(
        lambda t: L.facts_per_entity_histogram(t.charges, t.stays, "stay_id", "entity_id"),
        """select cast(fact_count as bigint) as fact_count, count(*) as freq
           from (select count(s.entity_id) as fact_count from charges c join stays s using (stay_id) group by s.entity_id)
           group by fact_count""",
        ("charges", "stays"),
    ),
    "fact_dimension_extract": Query(
        lambda t: L.fact_dimension_extract(
            t.charges, t.stays, "stay_id", ["charge_no", "charge_type", "status"], ["entity_id", "start_ts"]
        ),
        """select c.stay_id, charge_no, charge_type, status, entity_id, start_ts
           from charges c, stays s where c.stay_id = s.stay_id""",
        ("charges", "stays"),
    ),
    "assessment_case_extract": Query(
        lambda t: L.assessment_case_extract(
            t.inventory, t.cases, "case_no", ["assessed_ts", "inventory_no"], ["entity_id"]
        ),
        """select i.case_no, assessed_ts, inventory_no, c.entity_id
           from inventory i full join cases c on c.case_no = i.case_no""",
        ("inventory", "cases"),
    ),
}
