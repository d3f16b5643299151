"""Counts known beforehand for the label query over a second set of adapters (two-year lookback, six months)."""

import os

import pytest

from fixtures.adapters import Tables
from hindcast.operators import cohorts as C
from hindcast.operators import linkage as L
from hindcast.operators import signals as S
from hindcast.plans.study import labelled_cohort
from tests.conftest import tuples

FOLDER = "/root/testdata/sf0.01"
DATES = ["1999-01-01", "2000-07-01", "2001-01-01"]

STAYS = """
  select o_custkey entity_id, o_orderkey stay_id, o_orderdate start_ts,
    case when o_orderkey % 11 = 0 then null else o_orderdate + cast(o_orderkey % 45 as int) * interval '1' day end end_ts,
    case when o_orderpriority = '1-URGENT' then 1 when o_orderpriority = '5-LOW' then null else 0 end screen_flag
  from {orders}"""
INVENTORY = """
  select o_custkey entity_id, l_shipdate ts,
    case when l_returnflag = 'N' then null else cast(l_quantity as int) end a1,
    case when l_returnflag = 'N' then null else cast(round(l_discount * 100) as int) end a2,
    case when l_returnflag = 'N' then null else 1 + cast(round(l_tax * 100) as int) * 7 end a3
  from {lineitem} join {orders} on l_orderkey = o_orderkey where l_linenumber = 7"""
PRETRIAL = """
  select o_custkey entity_id, l_shipdate ts, case when l_returnflag = 'R' then 'Y' when l_returnflag = 'N' then 'N' end f
  from {lineitem} join {orders} on l_orderkey = o_orderkey where l_linenumber = 1 and l_quantity <= 5"""
INCIDENTS = """
  select md5(cast(o_custkey as string)) hash_key, l_shipdate ts, upper(p_name) primary_txt,
    case when p_size % 9 = 0 then null else p_type end secondary_txt
  from {lineitem} join {orders} on l_orderkey = o_orderkey join {part} on l_partkey = p_partkey where l_linenumber = 2"""
ADMISSIONS = """
  select o_custkey entity_id, o_orderdate ts, c_mktsegment program
  from {orders} join {customer} on o_custkey = c_custkey where o_orderstatus = 'F' and o_orderkey % 7 = 0"""
ENCOUNTERS = "select cast(user_id as string) k, ts - interval '24' year ts, event_type program, value from {events}"
CALLS = """
  select user_id entity_id, ts - interval '24' year ts, concat('Risk: ', event_type) risk_txt from {events} where value > 100"""
CROSSWALK = """
  select c_custkey entity_id, 'ITEM' source, cast(null as string) source_key, md5(cast(c_custkey as string)) hash_key
  from {customer} where c_custkey % 10 <> 3
  union all select c_custkey, 'EVENT', cast(c_custkey as string), cast(null as string) from {customer} where c_custkey % 7 <> 0"""

# (as-of date): cohort, in need by two signals, positives, in need by seven signals, positives
KNOWN = {
    "1999-01-01": (1153, 678, 284, 843, 355),
    "2000-07-01": (1180, 688, 293, 879, 369),
    "2001-01-01": (1169, 648, 259, 879, 360),
}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")
def test_label_query_counts(spark):
    t = Tables(spark, FOLDER)
    names = ["orders", "lineitem", "part", "customer", "events"]
    view = lambda text: spark.sql(text, **{n: getattr(t, n) for n in names if "{%s}" % n in text})
    stays, crosswalk = view(STAYS), view(CROSSWALK)
    incidents = L.link_entity(view(INCIDENTS), crosswalk, "ITEM", "hash_key", "hash")
    encounters = L.link_entity(view(ENCOUNTERS), crosswalk, "EVENT", "k")
    two = S.signal_log(
        S.flag_log(stays, "screen", "start_ts", "screen_flag"),
        S.answers_log(view(INVENTORY), "inventory", "ts", ["a1", "a2", "a3"], ["a2"]),
    )
    seven = S.signal_log(
        two,
        S.yes_no_log(view(PRETRIAL), "pretrial", "ts", "f"),
        S.regex_log(encounters.filter("value > 20"), "encounter", "ts", "program", "err"),
        _incident_log(incidents),
        S.in_list_log(view(ADMISSIONS), "admission", "ts", "program", ["BUILDING", "MACHINERY"]),
        S.ilike_log(view(CALLS), "call", "ts", "risk_txt", ["%ERR%", "%sign%"]),
    )
    cohort = dict(tuples(C.cohort_last_stay_closed(stays, DATES, "2 years").groupBy("as_of_date").count()))
    found = []
    for log in (two, seven):
        labels = labelled_cohort(stays, log, DATES, "2 years", "6 months")
        counted = labels.groupBy("as_of_date").agg({"entity_id": "count", "label": "sum"})
        found.append({r[0]: r[1:] for r in tuples(counted, "as_of_date", "count(entity_id)", "sum(label)")})
    assert {d: (cohort[d], *found[0][d], *found[1][d]) for d in DATES} == KNOWN


def _incident_log(incidents):
    hit = "(primary_txt rlike 'RING|BOLT' or secondary_txt rlike 'RING|PROMO')"
    clean = "not primary_txt rlike 'RED' and not secondary_txt rlike 'ECONOMY'"
    return S.presence_log(incidents.filter(f"{hit} and {clean}"), "incident", "ts")
