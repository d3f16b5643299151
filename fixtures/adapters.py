"""Source-shaped views over the test tables.

One portable SQL text per view; `{name}` stands for a base table or an earlier view. Spark fills in frames,
the check fills in names and puts the texts in a WITH clause. Every view reads its whole tables. Events are
moved back 24 years so that they overlap the order dates.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from hindcast.sources.tables import load_source

SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

VIEWS = {
    # One numeric tag for all, a hashed tag and a partial tag, one tag with non-numeric keys; some keys of the
    # partial tag belong to two entities.
    "crosswalk": """
        select c_custkey as entity_id, 'PERSON.NUMBER' as source, cast(c_custkey as string) as source_key,
               cast(null as string) as hash_key from {customer}
        union all
        select c_custkey, 'INCIDENT.HASH', cast(null as string), md5(cast(c_custkey as string))
        from {customer} where c_acctbal >= 0
        union all
        select c_custkey, 'PATIENT.ID', cast(c_custkey as string), cast(null as string)
        from {customer} where c_mktsegment <> 'HOUSEHOLD'
        union all
        select s_suppkey + 1, 'PATIENT.ID', cast(s_suppkey as string), cast(null as string) from {supplier}
        union all
        select c_custkey, 'LEGACY.CODE', concat('x', cast(c_custkey as string)), cast(null as string)
        from {customer} where c_nationkey < 3""",
    "stays": """
        select o_custkey as entity_id, o_orderkey as stay_id, o_orderdate as start_ts,
               case when o_orderstatus = 'O' and o_orderpriority = '5-LOW' then null
                    else o_orderdate + cast(floor(o_totalprice / 10000) as int) * interval '1' day end as end_ts,
               case when o_orderpriority = '1-URGENT' and o_orderstatus = 'F' then 1
                    when o_orderpriority = '5-LOW' then null else 0 end as screen_flag
        from {orders}""",
    "raw_stays": """
        select event_id, user_id,
               case when event_type = 'purchase' and value > 100 then null else cast(ts as date) end as start_date,
               case when event_type = 'view' then null else substring(cast(ts as string), 12, 8) end as start_time,
               case when event_type = 'error' then null
                    else cast(ts + cast(floor(value) as int) * interval '1' day as date) end as end_date,
               case when event_type = 'click' then null else '12:30:00' end as end_time
        from {events}""",
    "cases": "select o_orderkey as case_no, o_custkey as entity_id from {orders}",
    "inventory": """
        select l_orderkey as case_no, l_shipdate as assessed_ts, l_linenumber as inventory_no,
               case when l_returnflag = 'N' then null else cast(l_quantity as int) end as a1,
               case when l_returnflag = 'N' then null else 50 - cast(l_quantity as int) end as a2,
               case when l_returnflag = 'N' then null
                    else 1 + cast(round(l_tax * 100) as int) + cast(round(l_discount * 100) as int) end as a3
        from {lineitem}""",
    "name_index": "select o_orderkey as urno, cast(o_custkey as string) as person_number from {orders}",
    "pretrial": """
        select l_orderkey as urno, l_shipdate as created_ts,
               case when l_returnflag = 'R' and l_linestatus = 'F' and l_quantity > 40 then 'Y'
                    when l_returnflag = 'N' and l_quantity > 10 then 'N'
                    when l_returnflag = 'A' then 'U' end as mh_flag
        from {lineitem}""",
    "raw_incidents": "select o_orderkey as id, md5(cast(o_custkey as string)) as hash_key from {orders}",
    "incidents": """
        select l_orderkey as id, l_shipdate as incident_ts, p_brand as disposition,
               case p_name when 'hot ring' then 'ANXIETY ATTACK' when 'cold bolt' then 'BEHAVIORAL EMERGENCY'
                    when 'red gear' then 'CONCUSSION' when 'old widget' then 'EMOTIONAL CRISIS, CONCUSSION'
                    else upper(p_name) end as primary_txt,
               case when p_size > 45 then null when p_type = 'PROMO' and p_size < 5 then 'ALTERED CONSCIOUSNESS'
                    when p_type = 'SMALL' and p_size < 10 then 'CONCUSSION' else p_type end as secondary_txt
        from {lineitem} join {part} on l_partkey = p_partkey""",
    "encounters": """
        select cast(user_id as string) as patient_no, ts - interval '24' year as encounter_ts,
               case when event_type = 'error' and value > 150 then 'ADULT MENTAL HEALTH'
                    else upper(event_type) end as program, event_id as encounter_no
        from {events}""",
    "admissions": """
        select o_custkey as patid, o_orderdate as admit_ts,
               case when o_orderstatus = 'F' and o_orderpriority = '2-HIGH' and c_mktsegment = 'BUILDING'
                         then 'ADULT MH PROGRAM'
                    when o_orderstatus = 'P' and c_mktsegment = 'MACHINERY' then 'EMERGENCY SERVICES'
                    else c_mktsegment end as program_description
        from {orders} join {customer} on o_custkey = c_custkey""",
    "calls": """
        select user_id as patid, ts - interval '24' year as call_ts,
               case when event_type = 'error' and value > 150 then 'Risk of Violence'
                    when event_type = 'signup' and value > 200 then 'HOMICIDAL ideation'
                    else concat('none: ', event_type) end as risk_txt,
               case event_type when 'error' then 'ANXIETY' when 'signup' then 'DEPRESSION'
                    else upper(event_type) end as issue
        from {events}""",
    "charges": """
        select l_orderkey as stay_id, l_linenumber as charge_no, l_returnflag as charge_type,
               l_linestatus as status from {lineitem}""",
    "bail": "select o_orderkey as bail_no, o_custkey as person_number, o_orderdate as arranged_ts from {orders}",
    # Some keys are shifted, so that they match no bail.
    "bail_info": """
        select case when l_returnflag = 'A' then l_orderkey else -l_orderkey end as bail_no, l_extendedprice as amount
        from {lineitem}""",
    "insurance": "select o_custkey as patid, o_orderpriority as payor, o_orderdate as effect_ts from {orders}",
    "outcomes": """
        select o_custkey as patid, o_totalprice as score_a,
               case when o_orderstatus = 'P' then null else cast(floor(o_totalprice / 100) as bigint) end as score_b from {orders}""",
    "diagnoses": """
        select user_id as patid, ts - interval '24' year as dx_ts, event_type as dx_code, props as description from {events}""",
    "discharges": """
        select o_custkey as patid, o_orderdate as admit_ts, o_orderstatus as reason,
               o_orderdate + cast(floor(o_totalprice / 10000) as int) * interval '1' day as discharged_ts from {orders}""",
    "income": "select o_custkey as patid, o_totalprice as income, o_orderdate as effect_ts from {orders}",
    "vocational": "select o_custkey as patid, o_orderpriority as status, o_orderdate as status_ts from {orders}",
    "case_data": """
        select o_custkey as person_number, o_orderkey as case_no, o_orderstatus as case_status, o_orderdate as opened_ts
        from {orders}""",
    "arrests": """
        select concat('x', cast(l_suppkey as string)) as name_identifier, l_returnflag as charge, l_linestatus as agency,
               l_shipdate as arrested_ts from {lineitem}""",
    "services": "select o_custkey as patid, o_orderpriority as service_desc from {orders}",
    "people": """
        select o_custkey as person_number, c_acctbal as age, c_mktsegment as sex, n_name as race,
               o_orderpriority as marital_status
        from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey""",
    "demographics": "select c_custkey as patid, c_mktsegment as sex, c_name as race from {customer}",
    "runs": """
        select md5(cast(event_id as string)) as run_hash, ts as start_time, concat('u', cast(user_id as string)) as os_user,
               case event_type when 'purchase' then 'completed' when 'error' then 'failed' else 'started' end
                   as current_status, value as batch_run_time,
               concat('cohort_', cast(event_id as string)) as cohort_table_name,
               concat('labels_', cast(event_id as string)) as labels_table_name
        from {events}""",
    "experiments": """
        select md5(cast(event_id as string)) as experiment_hash, cast(floor(value) as bigint) as time_splits,
               user_id as total_features, event_id as models_needed, length(props) as as_of_times,
               concat('{{"config_version":"v8","temporal_config":{{"test_durations":"0day","label_end_time":"',
                      cast(cast(ts as date) as string), '","model_update_frequency":"',
                      cast(user_id as string), 'month"}},"inner":', props, '}}') as config
        from {events}""",
    "experiment_models": """
        select md5(cast(l_orderkey as string)) as experiment_hash, md5(concat('m', cast(l_partkey as string))) as model_hash
        from {lineitem}""",
    "models": """
        select md5(concat('m', cast(p_partkey as string))) as model_hash, p_partkey as model_id,
               concat('library.', lower(p_type), '.', replace(p_name, ' ', '')) as model_type,
               concat('{{"size": ', cast(p_size as string), '}}') as hyperparameters
        from {part}""",
    "evaluations": """
        select l_partkey as model_id, l_shipdate as evaluation_end_time,
               case l_returnflag when 'R' then 'recall@' else 'precision@' end as metric,
               case l_linestatus when 'F' then '100_abs' else '1_pct' end as parameter,
               l_discount * 5 + l_tax as best_value, l_discount as worst_value, l_discount + l_tax as stochastic_value,
               l_tax as standard_deviation
        from {lineitem}""",
    # Whole-number scores with heavy ties, some unknown labels.
    "predictions": """
        select case when o_orderpriority < '3' then 1 else 2 end as model_id,
               case when o_orderdate < timestamp '2000-01-01 00:00:00' then 'train' else 'test' end as role,
               cast(date_trunc('year', o_orderdate) as date) as as_of_date, o_orderkey as entity_id,
               cast(floor(o_totalprice / 5000) as double) as score,
               case when o_orderstatus = 'P' and o_orderpriority = '5-LOW' then null
                    when o_orderstatus = 'F' then 1 else 0 end as label
        from {orders}""",
    "prediction_groups": """
        select o_orderkey as entity_id, c_mktsegment as segment from {orders} join {customer} on o_custkey = c_custkey""",
}


def needs(text: str) -> list[str]:
    return re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text)


class Tables:
    """Base tables and views of one test folder, read when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._found: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in SCHEMAS and name not in VIEWS):
            raise AttributeError(name)
        if name not in self._found:
            if name in SCHEMAS:
                self._found[name] = load_source(self.spark, name, self.sf_dir, schema=SCHEMAS[name])
            else:
                text = VIEWS[name]
                self._found[name] = self.spark.sql(text, **{n: getattr(self, n) for n in needs(text)})
        return self._found[name]


def with_views(names: list[str], query: str) -> str:
    """The query behind a WITH clause of the views it uses."""
    parts = [f"{n} as ({VIEWS[n].format(**{m: m for m in needs(VIEWS[n])})})" for n in names]
    body = query.strip()
    if body.lower().startswith("with "):
        return "with " + ",\n".join(parts) + ",\n" + body[5:] if parts else body
    return "with " + ",\n".join(parts) + "\n" + body if parts else body
