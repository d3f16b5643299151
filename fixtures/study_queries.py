"""Spine, matrices, models, evaluation, reports and sinks."""

from __future__ import annotations

import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from fixtures import need as N
from fixtures.catalog import DATES, HORIZON, LOOKBACK, SPINE, Query
from fixtures.cohort_queries import COHORT, NOW, REPORT, T0, T1, T2
from fixtures.cohort_queries import QUERIES as COHORT_QUERIES
from fixtures.feature_queries import BOOKED, BOOKINGS, bookings, cohort
from fixtures.label_queries import GRID, LABELS, grid
from fixtures.signal_queries import WIDE as WIDE_SIGNS
from hindcast.operators import cohorts as C
from hindcast.operators import evaluation as E
from hindcast.operators import features as X
from hindcast.operators import matrix as M
from hindcast.operators import models as Z
from hindcast.operators import ranking as K
from hindcast.operators import reports as R
from hindcast.operators import signals as S
from hindcast.operators import spine as T
from hindcast.operators.linkage import distinct_entities
from hindcast.plans.runs import latest_evaluations, run_study
from hindcast.plans.study import EventFeatures, Study, evaluation_table, held_out_precision, labelled_cohort
from hindcast.presets import BASE_RATE_SIGNALS, RANDOM_SEED
from hindcast.sources import sinks

TEMPORAL = T.TemporalConfig(
    model_update_frequency="18month",
    training_label_timespan="6month",
    test_label_timespan="6month",
    training_frequency="6month",
    test_frequency="1month",
    max_training_history="1year",
)
COUNTS = X.FeatureGroup("stays", (X.Aggregate("prior", ("count",)),), ("1 year", "5 years", "all"))
FLAGS = X.FeatureGroup("screen", (X.Aggregate("flag", ("max",), "screen_flag"),), ("5 years",))
STUDY = Study(TEMPORAL, LOOKBACK, (COUNTS, FLAGS))
KEYS = ["model_id", "as_of_date"]
SLICES = 8  # parts of a month of stored events


def _spine(t):
    return T.asof_spine(T.label_bounds(t.stays, "start_ts"), TEMPORAL)


def _matrices(t):
    return STUDY.matrices(t.stays, N.need_log(t), T.label_bounds(t.stays, "start_ts"))


# Three more sources: linked bookings, any need, and a stored table of times since the last stay.
WIDE = Study(
    TEMPORAL,
    LOOKBACK,
    (COUNTS, FLAGS),
    sources={
        "bookings": EventFeatures((X.FeatureGroup("bkgs", (X.Aggregate("prior", ("count",)),), ("1 year", "all")),), "since_last_booking"),
        "need": EventFeatures(recency="since_last_need"),
        "gaps": EventFeatures((X.FeatureGroup("gap", (X.Aggregate("since", ("max",), "since"),), ("all",)),)),
    },
)
BOOKED_AT = """
    booked as (select x.entity_id, arranged_ts as kd from bail b join crosswalk x
               on x.source = 'PERSON.NUMBER' and cast(x.source_key as bigint) = b.person_number)"""


def _settings_matrices(t):
    """Matrices of four settings: two training label timespans by two training histories."""
    return SETTINGS.matrices(t.stays, N.need_log(t), T.label_bounds(t.stays, "start_ts"))


def _wide_matrices(t):
    bounds = T.label_bounds(t.stays, "start_ts")
    spine = WIDE.spine(bounds).select("as_of_date").distinct()
    # As a list the dates fold each entity's stays; as a frame every slot would be placed on all later dates.
    days = [r["as_of_date"] for r in spine.collect()] or spine
    gaps = X.time_since_known(t.stays, "start_ts", "since", days)
    gaps = _written(
        gaps, lambda df, path: sinks.materialize_feature(df, path, "since"), "entity_id bigint, since bigint, knowledge_date date"
    )
    # Labels and features both read the log: its sources are linked once.
    log = sinks.through_storage(N.need_log(t), "need-log")
    events = {"bookings": bookings(t), "need": log.withColumnRenamed("event_ts", "knowledge_date"), "gaps": gaps}
    return WIDE.matrices(t.stays, log, bounds, events)


def _stored(t):
    return sinks.through_storage(_matrices(t), "matrices", ("split_id", "role"))


RULES = [K.RankRule("bkgs_1y_prior_count"), K.RankRule("bkgs_all_prior_count", low_value_high_score=True)]
RANKERS = [
    Z.ModelSpec(
        101,
        "rank_multi_feature",
        {"rules": [{"feature": "stays_1y_prior_count"}, {"feature": STUDY.recency, "low_value_high_score": True}]},
    ),
    Z.ModelSpec(102, "rank_multi_feature", {"rules": [{"feature": "stays_all_prior_count"}]}),
]
SPECS = Z.expand_grid(Z.GRID)


def _specs(kind: str):
    return [s for s in SPECS + RANKERS if kind in ("all", s.kind)]


def _grid(t, kind: str):
    """Scores of every split of the spine, with what can be known of them beforehand.

    `scored`: the score is a probability. `told`: a forest's score is the mean share of the leaves that its trees, told
    as conditions, lead the row to. `fits`: for the single trees, which see every training row once, the score is the
    mean label of the training rows that share it.
    """
    matrices, splits = _stored(t), Z.split_ids(_spine(t))
    fitted = Z.fit_grid(matrices, STUDY.feature_names(), _specs(kind), splits)
    found = Z.model_grid(matrices, STUDY.feature_names(), _specs(kind), splits, fitted=fitted, told=Z.nodes_of(fitted))
    found = sinks.through_storage(found, "predictions", ("model_id", "split_id"))
    trees = [s.model_id for s in SPECS if s.kind == "decision_tree"]
    leaf = ["model_id", "split_id", "score"]
    leaves = found.filter(F.col("model_id").isin(trees) & F.expr("role = 'train' and label is not null"))
    # One row per leaf; stored, its size is known before all predictions are dealt out to meet it.
    means = sinks.through_storage(leaves.groupBy(*leaf).agg(F.avg("label").alias("mean_label")), "leaf-means")
    close = F.abs(F.col("mean_label") - F.col("score")) < 1e-6
    rows = ["model_id", "split_id", "role", "entity_id", "as_of_date"]
    forests = [s.model_id for s in SPECS if s.kind in ("decision_tree", "random_forest")]
    same = F.coalesce(F.abs(F.col("told") - F.col("score")) < 1e-9, ~F.col("model_id").isin(forests))
    return found.join(means, leaf, "left").select(
        *rows, "label",
        F.col("score").between(0, 1).alias("scored"),
        same.alias("told"),
        (~F.col("model_id").isin(trees) | F.col("mean_label").isNull() | close).alias("fits"),
    )


def _importance(t):
    """Weights of every model and split by feature.

    `agrees`: importances of trees are those that the gains of their told nodes give. `whole`: they are shares of 1,
    unless no tree has a split. Weights of the linear model are its coefficients; `agrees` is their optimality.
    """
    matrices, names, parts, splits = _stored(t), STUDY.feature_names(), [], Z.split_ids(_spine(t))
    fitted = Z.fit_grid(matrices, names, SPECS, splits)
    specs, told = {s.model_id: s for s in SPECS}, Z.nodes_of(fitted)
    for (model_id, split), model in fitted.items():
        weights = Z.feature_importance(model, names)
        if hasattr(model.stages[-1], "trees"):
            nodes = told[model_id, split]
            gains = Z.gain_importance(nodes, names).withColumnRenamed("importance", "gained")
            split_up = model.stages[-1].totalNumNodes == model.stages[-1].getNumTrees
            total = weights.agg(F.round(F.sum("importance"), 6)).scalar()
            found = weights.join(gains, "feature").select(
                "feature", (F.abs(F.col("importance") - F.col("gained")) < 1e-9).alias("agrees"), (total == (0.0 if split_up else 1.0)).alias("whole")
            )
        else:
            train = M.training_rows(matrices).filter(F.col("split_id") == split)
            held = Z.optimality(model, train, names, specs[model_id]).select("feature", "coefficient", "holds")
            found = weights.join(held, "feature").select("feature", (F.col("holds") & (F.col("coefficient") == F.col("importance"))).alias("agrees"), F.lit(True).alias("whole"))
        parts.append(found.select(F.lit(model_id).alias("model_id"), F.lit(split).alias("split_id"), "*"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _optimality(t):
    """Every coefficient of the penalised model, and its intercept, on every split: at the optimum or not."""
    matrices, names, splits = _stored(t), STUDY.feature_names(), Z.split_ids(_spine(t))
    specs = {s.model_id: s for s in _specs("scaled_logistic")}
    parts = []
    for (model_id, split), model in Z.fit_grid(matrices, names, list(specs.values()), splits).items():
        held = Z.optimality(model, M.training_rows(matrices).filter(F.col("split_id") == split), names, specs[model_id])
        parts.append(held.select(F.lit(model_id).alias("model_id"), F.lit(split).alias("split_id"), "feature", "holds"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _grid_evaluation(t):
    """Precision in the top 100 of every model of the grid beside the same by SQL over the stored predictions."""
    matrices, names, splits = _stored(t), STUDY.feature_names(), Z.split_ids(_spine(t))
    found = sinks.through_storage(Z.model_grid(matrices, names, SPECS + RANKERS, splits), "predictions", ("model_id", "split_id"))
    evaluated = evaluation_table(found).filter("metric = 'precision@'")
    by_sql = found.sparkSession.sql(
        """with scored as (
             select model_id, split_id, as_of_date, score, count(*) as n, sum(label) as p from {found}
             where role = 'test' and label is not null group by all),
           placed as (
             select *, coalesce(sum(n) over w, 0) as ahead from scored
             window w as (partition by model_id, split_id, as_of_date order by score desc rows between unbounded preceding and 1 preceding))
           select model_id, split_id, as_of_date as evaluation_end_time,
                  sum(p * greatest(0, least(n, 100 - ahead)) / n) / least(100, sum(n)) as by_sql
           from placed group by all""",
        found=found,
    )
    ranked = [s.model_id for s in RANKERS]
    return evaluated.join(by_sql, ["model_id", "split_id", "evaluation_end_time"]).select(
        "model_id", "split_id", "evaluation_end_time", "k",
        (F.abs(F.col("stochastic_value") - F.col("by_sql")) < 1e-9).alias("agrees"),
        F.when(F.col("model_id").isin(ranked), F.round("stochastic_value", 9)).alias("ranked_value"),
    )


def _ranked(t):
    """Predictions of the rankers over the stored matrices, saved as a run saves them."""
    matrices = _stored(t)
    found = STUDY.predictions(matrices, RANKERS, Z.split_ids(_spine(t)))
    return sinks.through_storage(found, "predictions", ("model_id",))


def _grid_sql(kind: str) -> str:
    ids = ", ".join(f"({s.model_id})" for s in _specs(kind))
    return f"""with {MATRIX}
        select cast(m.id as int) as model_id, split_id, role, entity_id, as_of_date, label, true as scored, true as told, true as fits
        from matrix, (values {ids}) m(id)"""


def _grid_days(span: str = "6' month", history: str = "1' year", text: str = "6month") -> str:
    """The spine of TEMPORAL with another training label timespan (`text` names it) or training history."""
    return f"""
    bounds as (select cast(min(start_ts) as date) as a, cast(cast(max(start_ts) as date) + 1 as date) as b from stays),
    cuts as (
      select k + 1 as split_id, a, cast(cast(b - interval '6' month as date) - interval (18 * k) month as date) as s
      from bounds, (select unnest(range(0, 400)) as k)
      where cast(b - interval '6' month as date) - interval (18 * k) month >= a + interval '{span}),
    grid_days as (
      select cast(split_id as int) as split_id, 'test' as role, s as as_of_date, '6month' as label_timespan from cuts
      union all
      select cast(split_id as int), 'train', cast(cast(s - interval '{span} as date) - interval (6 * k) month as date), '{text}'
      from cuts, (select unnest(range(0, 400)) as k)
      where cast(s - interval '{span} as date) - interval (6 * k) month
            >= greatest(cast(s - interval '{span} as date) - interval '{history}, a))"""


GRID_DAYS = _grid_days()
LISTS = replace(TEMPORAL, feature_start="1996-01-01", training_label_timespan=("6month", "1year"), max_training_history=("1year", "2year"))
LATE_BAIL = "from (select * from bail where arranged_ts >= date '1996-01-01') b"
LISTS_SQL = " union all ".join(
    f"select {i} as setting_id, * from (with {_grid_days(span, history, text)} select * from grid_days)"
    for i, (span, text, history) in enumerate(
        [(s, t, h) for s, t in (("6' month", "6month"), ("1' year", "1year")) for h in ("1' year", "2' year")], 1
    )
)

def _matrix_sql(days: str, leading: str = "split_id, role", label: str = "label") -> str:
    return f"""{days},
    spine as (select distinct as_of_date, as_of_date - interval '2' year as lo, as_of_date + interval '6' month as hi
              from grid_days),
    {N.LOG}, {COHORT},
    members as (
      select c.entity_id, c.as_of_date, lo, hi from cohort c join spine a using (as_of_date)
      join log g on g.entity_id = c.entity_id and g.ts between a.lo and a.as_of_date
      group by all having max(g.sign) = 1),
    facts as (
      select m.entity_id, m.as_of_date,
             max(case when start_ts between m.as_of_date and hi
                       and ifnull(end_ts, timestamp '2099-01-01 00:00:00') > start_ts + interval '14' day
                      then 1 else 0 end) as label,
             max(case when start_ts between m.as_of_date and m.as_of_date + interval '1' year
                       and ifnull(end_ts, timestamp '2099-01-01 00:00:00') > start_ts + interval '14' day
                      then 1 else 0 end) as label_year,
             count(*) filter (start_ts < m.as_of_date and start_ts >= m.as_of_date - interval '1' year) as c1,
             count(*) filter (start_ts < m.as_of_date and start_ts >= m.as_of_date - interval '5' year) as c5,
             count(*) filter (start_ts < m.as_of_date) as ca,
             max(screen_flag) filter (start_ts < m.as_of_date and start_ts >= m.as_of_date - interval '5' year) as f5,
             date_diff('second', max(start_ts) filter (start_ts <= m.as_of_date), cast(m.as_of_date as timestamp)) as since
      from members m join stays using (entity_id) group by m.entity_id, m.as_of_date),
    matrix as (
      select {leading}, entity_id, as_of_date, {label},
             case when ca = 0 then 0 else c1 end as stays_1y_prior_count,
             case when ca = 0 then 0 else c5 end as stays_5y_prior_count, ca as stays_all_prior_count,
             ifnull(f5, 0) as screen_5y_flag_max, ifnull(since, 0) as since_last_stay,
             cast(ca = 0 as int) as stays_1y_prior_count_imp, cast(ca = 0 as int) as stays_5y_prior_count_imp,
             cast(ca = 0 as int) as stays_all_prior_count_imp, cast(f5 is null as int) as screen_5y_flag_max_imp,
             cast(since is null as int) as since_last_stay_imp
      from facts join grid_days using (as_of_date))"""


MATRIX = _matrix_sql(GRID_DAYS)
SETTINGS = Study(replace(LISTS, feature_start=None), LOOKBACK, (COUNTS, FLAGS))
SETTINGS_MATRIX = _matrix_sql(
    f"grid_days as ({LISTS_SQL})", "setting_id, split_id, role", "case label_timespan when '1year' then label_year else label end as label"
)


def _evaluation_sql(keys: str, cuts: str, metrics: tuple[str, ...]) -> str:
    """Top-k metrics by row position in the best, worst and mean order of ties."""
    parts = []
    for metric in metrics:
        base = "k" if metric == "precision@" else "total_p"
        parts.append(f"""
          select {keys}, '{metric}' as metric, parameter, k,
                 (before_p + least(p, m)) / nullif({base}, 0) as best_value,
                 (before_p + greatest(0, m - (n - p))) / nullif({base}, 0) as worst_value,
                 (before_p + m * p / n) / nullif({base}, 0) as stochastic_value,
                 sqrt(m * (p / n) * (1 - p / n) * (n - m) / greatest(n - 1, 1)) / nullif({base}, 0) as standard_deviation
          from cut""")
    return f"""
        scored as (select {keys}, score, count(*) as n, cast(sum(label) as bigint) as p from predictions
                   where label is not null group by all),
        ranked as (
          select *, cast(ifnull(sum(n) over w, 0) as bigint) as before_n, cast(ifnull(sum(p) over w, 0) as bigint) as before_p
          from scored
          window w as (partition by {keys} order by score desc rows between unbounded preceding and 1 preceding)),
        totals as (select {keys}, cast(sum(n) as bigint) as total_n, cast(sum(p) as bigint) as total_p from scored group by all),
        wanted as ({cuts}),
        sized as (
          select {keys}, parameter, total_p, case when pct is null then least(top, total_n) else total_n * pct // 100 end as k
          from totals, wanted),
        cut as (
          select s.*, r.n, r.p, before_p, s.k - before_n as m
          from sized s left join ranked r
            on {' and '.join(f's.{c} = r.{c}' for c in keys.split(', '))} and s.k > before_n and s.k <= before_n + r.n),
        results as ({' union all '.join(parts)})"""


ABS = "select n || '_abs' as parameter, cast(n as bigint) as top, null::bigint as pct from (values (100), (200), (500), (1000)) v(n)"
PCT = "select n || '_pct' as parameter, null::bigint as top, cast(n as bigint) as pct from range(1, 101) v(n)"


def _rounded(df):
    names = ["best_value", "worst_value", "stochastic_value", "standard_deviation"]
    return df.withColumns({n: F.round(n, 9) for n in names})


# The rankers by SQL: dense ranks by their rules, 1 - (rank - 1) / greatest rank as the score.
def _ranked_sql(matrix: str, keys: str = "split_id, as_of_date") -> str:
    return f"""{matrix},
    ranks as (
      select 101 as model_id, *, dense_rank() over (partition by {keys}
             order by stays_1y_prior_count desc, since_last_stay) as place from matrix
      union all
      select 102, *, dense_rank() over (partition by {keys} order by stays_all_prior_count desc) from matrix),
    predictions as (
      select model_id, {keys}, role, entity_id, label,
             1.0::double - (place - 1) / max(place) over (partition by model_id, {keys}) as score
      from ranks qualify role = 'test')"""


RANKED = _ranked_sql(MATRIX)
RUN_KEYS = "setting_id, split_id, as_of_date"


def _run_report(t):
    """The tables a run leaves behind, models and evaluations, joined into its report."""
    splits = Z.split_ids(_spine(t))
    models = Z.model_table(RANKERS, splits, "run")
    found = evaluation_table(_ranked(t)).filter("metric = 'precision@'")
    return found.join(models, ["model_id", "split_id"]).select(
        "metric", "parameter", "evaluation_end_time", "model_id", "split_id",
        R.model_short_name("model_type").alias("model_type_short"), F.round("stochastic_value", 9).alias("stochastic_value"),
    )


def _run_tables(t):
    """A run over four settings that leaves its tables behind; its report from what is read back."""
    path = f"{sinks.shared_folder(t.spark)}/{uuid.uuid4().hex}"
    run_study(path, SETTINGS, RANKERS, t.stays, N.need_log(t), T.label_bounds(t.stays, "start_ts"))
    return latest_evaluations(t.spark, path).select(
        "setting_id", "split_id", F.col("spec_id").alias("model_id"), "model_type_short", "evaluation_end_time", "parameter",
        F.round("best_value", 9).alias("best_value"), F.round("worst_value", 9).alias("worst_value"),
        F.round("stochastic_value", 9).alias("stochastic_value"), "time_splits", "as_of_times", "total_features", "models_needed",
    )


def _evaluated(cuts, metrics, keys="model_id, as_of_date", abs_or_pct=ABS):
    return Query(
        lambda t: _rounded(E.evaluate(t.predictions, keys.split(", "), cuts, metrics)),
        f"""with {_evaluation_sql(keys, abs_or_pct, metrics)}
            select {keys}, metric, parameter, k, round(best_value, 9) as best_value, round(worst_value, 9) as worst_value,
                   round(stochastic_value, 9) as stochastic_value, round(standard_deviation, 9) as standard_deviation
            from results""",
        ("predictions",),
    )


TOP_N = E.Cuts(percents=())
TOP_PCT = E.Cuts(top_n=())

LATEST = """
    latest as (select * from runs where current_status = 'completed' order by start_time desc, run_hash desc limit 1)"""


def _written(df, write, columns: str):
    path = f"{sinks.shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    write(df, path)
    return df.sparkSession.read.schema(columns).parquet(path)


def _event_store(events, ts: str):
    """Linked events as they are kept for every later step: written once by month, read back. A month is spread over tasks."""
    path = f"{sinks.shared_folder(events.sparkSession)}/{uuid.uuid4().hex}"
    sinks.store_events(events, path, ts, SLICES)
    return sinks.read_events(events.sparkSession, path, events)


def _stored_wide(t):
    with sinks.shuffles_freed(t.stays.sparkSession):
        log = N.need_log(t, store=_event_store)
    return S.signals_wide(log, N.SIGNALS, DATES, LOOKBACK, C.cohort_last_stay_closed(t.stays, DATES, LOOKBACK))


def _stored_base_rates(t):
    """Base rates from stored stays, with the day of their end, and stored sources of need."""
    path = f"{sinks.shared_folder(t.stays.sparkSession)}/{uuid.uuid4().hex}"
    with sinks.shuffles_freed(t.stays.sparkSession):
        sinks.store_events(t.stays, path, "start_ts", SLICES, end="end_ts")
        log = N.need_log(t, BASE_RATE_SIGNALS, _event_store)
    stays = sinks.read_events(t.stays.sparkSession, path, t.stays, ended=True)
    return C.base_rate_summary(C.base_rate_flags(distinct_entities(t.crosswalk), stays, log, T0, T1, T2))


def _feature_store(t):
    since = X.feature_time_since_last(t.stays, cohort(t), "start_ts", "since_last_stay", DATES)
    return _written(
        since,
        lambda df, path: sinks.materialize_feature(df, path, "since_last_stay"),
        "entity_id bigint, since_last_stay bigint, knowledge_date date",
    )


def _prediction_store(t):
    return _written(
        t.predictions, sinks.save_predictions,
        "role string, entity_id bigint, score double, label int, model_id int, as_of_date date",
    )


QUERIES = {
    "asof_spine": Query(_spine, f"with {GRID_DAYS} select * from grid_days", ("stays",)),
    "asof_spine_lists": Query(
        lambda t: T.asof_spines(T.label_bounds(t.stays, "start_ts"), LISTS), LISTS_SQL, ("stays",)
    ),
    "feature_bounded_start": Query(
        lambda t: X.feature_intervals(T.known_from(bookings(t), LISTS), DATES, BOOKINGS),
        f"with {SPINE}, {BOOKED.replace('from bail b', LATE_BAIL)} select * from counts",
        ("crosswalk", "bail"),
    ),
    "split_spans": Query(
        lambda t: T.split_spans(_spine(t), TEMPORAL),
        f"""with {GRID_DAYS}
            select *, cast(as_of_date + interval '6' month as date) as label_end,
                   min(as_of_date) over box as box_start, cast(max(as_of_date + interval '6' month) over box as date) as box_end
            from grid_days window box as (partition by split_id, role) order by split_id, role, as_of_date""",
        ("stays",),
    ),
    "label_reevent_long_stored": Query(
        lambda t: labelled_cohort(
            _event_store(t.stays, "start_ts"), _event_store(N.need_log(t).drop("undated"), "event_ts").withColumn("undated", F.lit(False)),
            DATES, LOOKBACK, HORIZON,
        ),
        f"with {LABELS} select * from labels",
        N.LOG_VIEWS,
    ),
    "signals_wide_stored": Query(_stored_wide, f"with {WIDE_SIGNS} select * from wide", N.LOG_VIEWS),
    "base_rate_summary_stored": Query(_stored_base_rates, COHORT_QUERIES["base_rate_summary"].sql, N.LOG_VIEWS),
    "feature_interval_count_stored": Query(
        lambda t: X.feature_intervals(_event_store(bookings(t), "knowledge_date"), DATES, BOOKINGS),
        f"with {SPINE}, {BOOKED} select * from counts",
        ("crosswalk", "bail"),
    ),
    "matrix_build_sources": Query(
        _wide_matrices,
        f"""with {MATRIX}, {BOOKED_AT},
            arranged as (
              select m.entity_id, m.as_of_date,
                     count(*) filter (kd < m.as_of_date and kd >= m.as_of_date - interval '1' year) as c1,
                     count(*) filter (kd < m.as_of_date) as ca,
                     date_diff('second', max(kd) filter (kd <= m.as_of_date), cast(m.as_of_date as timestamp)) as since
              from members m join booked using (entity_id) group by m.entity_id, m.as_of_date),
            needed as (
              select m.entity_id, m.as_of_date, date_diff('second', max(ts), cast(m.as_of_date as timestamp)) as since
              from members m join log using (entity_id) where ts <= m.as_of_date group by m.entity_id, m.as_of_date),
            stored as (
              select m.entity_id, m.as_of_date, max(date_diff('second', s.start_ts, cast(p.as_of_date as timestamp))) as most
              from members m join (select distinct as_of_date from grid_days) p on p.as_of_date < m.as_of_date
              join (select entity_id, d.as_of_date, max(start_ts) as start_ts from stays, (select distinct as_of_date from grid_days) d
                    where start_ts <= d.as_of_date group by all) s on s.entity_id = m.entity_id and s.as_of_date = p.as_of_date
              group by m.entity_id, m.as_of_date)
            select x.*, ifnull(case when b.ca > 0 then b.c1 end, 0) as bkgs_1y_prior_count, ifnull(nullif(b.ca, 0), 0) as bkgs_all_prior_count,
                   ifnull(b.since, 0) as since_last_booking, ifnull(n.since, 0) as since_last_need, ifnull(k.most, 0) as gap_all_since_max,
                   cast(ifnull(b.ca, 0) = 0 as int) as bkgs_1y_prior_count_imp, cast(ifnull(b.ca, 0) = 0 as int) as bkgs_all_prior_count_imp,
                   cast(b.since is null as int) as since_last_booking_imp, cast(n.since is null as int) as since_last_need_imp,
                   cast(k.most is null as int) as gap_all_since_max_imp
            from matrix x left join arranged b using (entity_id, as_of_date) left join needed n using (entity_id, as_of_date)
            left join stored k using (entity_id, as_of_date)""",
        (*N.LOG_VIEWS, "bail"),
    ),
    "matrix_build_settings": Query(_settings_matrices, f"with {SETTINGS_MATRIX} select * from matrix", N.LOG_VIEWS),
    "matrix_build": Query(_matrices, f"with {MATRIX} select * from matrix", N.LOG_VIEWS),
    "model_random_forest": Query(lambda t: _grid(t, "random_forest"), _grid_sql("random_forest"), N.LOG_VIEWS),
    "model_decision_tree": Query(lambda t: _grid(t, "decision_tree"), _grid_sql("decision_tree"), N.LOG_VIEWS),
    "model_scaled_logistic": Query(lambda t: _grid(t, "scaled_logistic"), _grid_sql("scaled_logistic"), N.LOG_VIEWS),
    "model_grid": Query(lambda t: _grid(t, "all"), _grid_sql("all"), N.LOG_VIEWS),
    "feature_importance": Query(
        _importance,
        f"""with {GRID_DAYS}
            select cast(m.id as int) as model_id, s.split_id, f.feature, true as agrees, true as whole
            from (values {', '.join(f'({s.model_id})' for s in SPECS)}) m(id),
                 (select distinct split_id from grid_days) s, (select unnest({STUDY.feature_names()}) as feature) f""",
        ("stays",),
    ),
    "model_optimality": Query(
        _optimality,
        f"""with {GRID_DAYS}
            select cast(m.id as int) as model_id, s.split_id, f.feature, true as holds
            from (values {', '.join(f'({s.model_id})' for s in SPECS if s.kind == 'scaled_logistic')}) m(id),
                 (select distinct split_id from grid_days) s, (select unnest({['(intercept)', *STUDY.feature_names()]}) as feature) f""",
        ("stays",),
    ),
    "study_grid_evaluation": Query(
        _grid_evaluation,
        f"""with {RANKED}, {_evaluation_sql("model_id, split_id, as_of_date", ABS, ("precision@",))},
            asked as (
              select cast(m.id as int) as model_id, split_id, as_of_date, count(label) as n
              from matrix, (values {', '.join(f'({s.model_id})' for s in SPECS + RANKERS)}) m(id) where role = 'test' group by all)
            select a.model_id, a.split_id, a.as_of_date as evaluation_end_time, least(100, n) as k, true as agrees,
                   round(stochastic_value, 9) as ranked_value
            from asked a left join results r
              on r.model_id = a.model_id and r.split_id = a.split_id and r.as_of_date = a.as_of_date and parameter = '100_abs'""",
        N.LOG_VIEWS,
    ),
    "study_ranked_evaluation": Query(
        lambda t: held_out_precision(_ranked(t)).withColumns({n: F.round(n, 9) for n in ("top_k", "base_rate", "gain")}),
        f"""with {RANKED}, {_evaluation_sql("model_id, split_id, as_of_date", ABS, ("precision@",))},
            base as (select model_id, split_id, as_of_date, avg(label) as rate from predictions group by all)
            select model_id, split_id, as_of_date, round(stochastic_value, 9) as top_k, round(rate, 9) as base_rate,
                   round(stochastic_value - rate, 9) as gain
            from results join base using (model_id, split_id, as_of_date) where parameter = '100_abs'""",
        N.LOG_VIEWS,
    ),
    "study_run_report": Query(
        _run_report,
        f"""with {RANKED}, {_evaluation_sql("model_id, split_id, as_of_date", ABS, ("precision@",))}
            select 'precision@' as metric, '100_abs' as parameter, as_of_date as evaluation_end_time, model_id, split_id,
                   'rank_multi_feature' as model_type_short, round(stochastic_value, 9) as stochastic_value
            from results where parameter = '100_abs'""",
        N.LOG_VIEWS,
    ),
    "study_run_tables": Query(
        _run_tables,
        f"""with {_ranked_sql(SETTINGS_MATRIX, RUN_KEYS)}, {_evaluation_sql(f"model_id, {RUN_KEYS}", ABS, ("precision@",))},
            grid as (select count(distinct (setting_id, split_id)) as n, count(distinct as_of_date) as d from grid_days)
            select setting_id, split_id, model_id, 'rank_multi_feature' as model_type_short, as_of_date as evaluation_end_time,
                   parameter, round(best_value, 9) as best_value, round(worst_value, 9) as worst_value,
                   round(stochastic_value, 9) as stochastic_value, cast(n as int) as time_splits, cast(d as int) as as_of_times,
                   5 as total_features, cast(2 * n as int) as models_needed
            from results, grid where parameter = '100_abs'""",
        N.LOG_VIEWS,
    ),
    "rank_multi_feature": Query(
        lambda t: K.rank_multi_feature(
            X.impute_constant(cohort(t), X.feature_intervals(bookings(t), DATES, BOOKINGS), BOOKINGS.names()), RULES
        ).select("entity_id", "as_of_date", "rank", F.round("score", 9).alias("score")),
        f"""with {SPINE}, {COHORT}, {BOOKED},
            ranked as (
              select c.entity_id, c.as_of_date,
                     dense_rank() over (partition by c.as_of_date
                                        order by ifnull(bkgs_1y_prior_count, 0) desc, ifnull(bkgs_all_prior_count, 0)) as rank
              from cohort c left join counts using (entity_id, as_of_date))
            select entity_id, as_of_date, rank,
                   round(1.0::double - (rank - 1) / max(rank) over (partition by as_of_date), 9) as score from ranked""",
        ("crosswalk", "stays", "bail"),
    ),
    "predictions_save": Query(_prediction_store, "select * from predictions", ("predictions",)),
    "precision_at_n": _evaluated(TOP_N, ("precision@",)),
    "precision_at_pct": _evaluated(TOP_PCT, ("precision@",), abs_or_pct=PCT),
    "recall_at_n": _evaluated(TOP_N, ("recall@",)),
    "recall_at_pct": _evaluated(TOP_PCT, ("recall@",), abs_or_pct=PCT),
    "evaluation_ties": _evaluated(E.Cuts(), E.METRICS, abs_or_pct=f"{ABS} union all {PCT}"),
    "train_and_test_scoring": _evaluated(E.Cuts(), E.METRICS, "model_id, role", f"{ABS} union all {PCT}"),
    "evaluations_of_latest_run": Query(
        lambda t: R.evaluations_of_latest_run(t.runs, t.experiments, t.experiment_models, t.models, t.evaluations),
        f"""with {LATEST}
            select metric, parameter, evaluation_end_time, m.model_id, model_type,
                   string_split(model_type, '.')[-1] as model_type_short, hyperparameters, best_value, worst_value,
                   stochastic_value, standard_deviation, time_splits, cast(as_of_times as int) as as_of_times, total_features,
                   models_needed, os_user, batch_run_time
            from latest join experiments e on e.experiment_hash = run_hash
            join experiment_models em on em.experiment_hash = run_hash
            join models m on m.model_hash = em.model_hash join evaluations v on v.model_id = m.model_id
            where metric = 'precision@' and parameter = '100_abs'""",
        ("runs", "experiments", "experiment_models", "models", "evaluations"),
    ),
    "latest_run": Query(
        lambda t: R.latest_run(t.runs), f"with {LATEST} select * from latest", ("runs",)
    ),
    "latest_run_any_status": Query(
        lambda t: R.latest_run(t.runs, only_completed=False),
        "select * from runs order by start_time desc, run_hash desc limit 1",
        ("runs",),
    ),
    "run_config_lookup": Query(
        lambda t: R.run_config_lookup(t.experiments, R.latest_run(t.runs)),
        f"""with {LATEST},
           pairs as (
             select experiment_hash, json_extract(config, '$.temporal_config') as c from experiments
             where experiment_hash in (select run_hash from latest)),
           named as (select experiment_hash, c, unnest(json_keys(c)) as key from pairs)
           select experiment_hash, key, json_extract_string(c, '$.' || key) as value from named""",
        ("runs", "experiments"),
    ),
    "run_config_lookup_completed": Query(
        lambda t: R.run_config_lookup(t.experiments, t.runs.filter("current_status = 'completed'")),
        """with pairs as (
             select experiment_hash, json_extract(config, '$.temporal_config') as c from experiments
             where experiment_hash in (select run_hash from runs where current_status = 'completed')),
           named as (select experiment_hash, c, unnest(json_keys(c)) as key from pairs)
           select experiment_hash, key, json_extract_string(c, '$.' || key) as value from named""",
        ("runs", "experiments"),
    ),
    "cohort_summary": Query(
        lambda t: R.cohort_summary(C.cohort_table(t.stays, DATES, LOOKBACK)),
        f"""with {SPINE}, {COHORT},
            listed as (select l.entity_id, l.as_of_date, bool_or(c.entity_id is not null) as active
                       from latest l left join cohort c using (entity_id, as_of_date) group by all)
            select as_of_date, count(entity_id) as total_rows, count(distinct entity_id) as n_entities,
                   count(*) filter (active) as active_rows, count(*) filter (not active) as inactive_rows
            from listed group by as_of_date""",
        ("stays",),
    ),
    "label_summary": Query(
        lambda t: R.label_summary(grid(t)),
        f"""with {GRID}
            select as_of_date, label_timespan, cast(sum(label) as bigint) as n_positive,
                   cast(count(entity_id) - sum(label) as bigint) as n_negative,
                   count(*) filter (label is null) as n_null, count(label) as n_labelled,
                   cast(100 * sum(label) // count(entity_id) as bigint) as pct_positive,
                   cast(100 * (count(entity_id) - sum(label)) // count(entity_id) as bigint) as pct_negative
            from grid group by all""",
        N.LOG_VIEWS,
    ),
    "label_summary_predictions": Query(
        lambda t: R.label_summary(t.predictions, KEYS),
        """select model_id, as_of_date, cast(sum(label) as bigint) as n_positive,
                  cast(count(entity_id) - sum(label) as bigint) as n_negative,
                  count(*) filter (label is null) as n_null, count(label) as n_labelled,
                  cast(100 * sum(label) // count(entity_id) as bigint) as pct_positive,
                  cast(100 * (count(entity_id) - sum(label)) // count(entity_id) as bigint) as pct_negative
           from predictions group by all""",
        ("predictions",),
    ),
    "label_summary_basic": Query(
        lambda t: R.label_summary_basic(grid(t)),
        f"""with {GRID}
            select as_of_date, label_timespan, count(entity_id) as n_rows, count(distinct entity_id) as n_entities,
                   cast(sum(label) as bigint) as n_positive, cast(100 * sum(label) // count(entity_id) as bigint) as pct_positive
            from grid group by all""",
        N.LOG_VIEWS,
    ),
    "label_pull_comparison": Query(
        lambda t: R.label_pull_comparison(grid(t)),
        f"""with {GRID}
            select as_of_date, label_timespan, count(*) as n_rows, count(distinct entity_id) as n_entities,
                   count(*) filter (label = 1) as n_ones, count(*) filter (label = 0) as n_zeros,
                   count(*) filter (label is null) as n_null
            from grid group by all""",
        N.LOG_VIEWS,
    ),
    "model_short_name": Query(
        lambda t: t.models.select("model_id", "model_type", R.model_short_name("model_type").alias("model_type_short")),
        "select model_id, model_type, string_split(model_type, '.')[-1] as model_type_short from models",
        ("models",),
    ),
    "top_k_vs_random": Query(
        lambda t: E.top_k_vs_random(t.predictions, KEYS).withColumns(
            {n: F.round(n, 9) for n in ("top_k", "base_rate", "gain")}
        ),
        f"""with {_evaluation_sql("model_id, as_of_date", ABS, ("precision@",))},
            base as (select model_id, as_of_date, avg(label) as rate from predictions group by all)
            select model_id, as_of_date, round(stochastic_value, 9) as top_k, round(rate, 9) as base_rate,
                   round(stochastic_value - rate, 9) as gain
            from results join base using (model_id, as_of_date) where parameter = '100_abs'""",
        ("predictions",),
    ),
    "top_k_equity": Query(
        lambda t: E.top_k_equity(t.predictions, t.prediction_groups, "segment", KEYS).withColumns(
            {n: F.round(n, 6) for n in ("n_top", "share_of_cohort", "share_of_top")}
        ),
        """with ties as (
             select model_id, as_of_date, score, count(*) as n from predictions group by all),
           placed as (
             select *, n + 0.0::double as nd, ifnull(sum(n) over (partition by model_id, as_of_date order by score desc
                       rows between unbounded preceding and 1 preceding), 0) as before from ties),
           per as (
             select p.model_id, p.as_of_date, g.segment, count(*) as n_cohort,
                    sum(greatest(0.0::double, least(1.0::double, (100 - before) / nd))) as n_top
             from predictions p join placed using (model_id, as_of_date, score) left join prediction_groups g using (entity_id)
             group by all)
           select model_id, as_of_date, segment, n_cohort, round(n_top, 6) as n_top,
                  round(n_cohort / sum(n_cohort) over w, 6) as share_of_cohort,
                  round(n_top / sum(n_top) over w, 6) as share_of_top
           from per window w as (partition by model_id, as_of_date)""",
        ("predictions", "prediction_groups"),
    ),
    "resample_groups": Query(
        lambda t: M.resample_groups(t.predictions.filter("label is not null"), "label", "entity_id", RANDOM_SEED),
        """with known as (select * from predictions where label is not null),
                sizes as (select label, count(*) as n from known group by label)
           select known.* from known join sizes using (label)
           where ('0x' || substr(md5('23895478:' || entity_id), 1, 8))::bigint::double / 4294967296.0::double
                 < (select min(n) from sizes) / n""",
        ("predictions",),
    ),
    "materialize_feature": Query(
        _feature_store,
        f"""with {SPINE}, {COHORT}
            select c.entity_id, c.as_of_date as knowledge_date,
                   date_diff('second', max(s.start_ts), cast(c.as_of_date as timestamp)) as since_last_stay
            from cohort c join stays s on s.entity_id = c.entity_id and s.start_ts <= c.as_of_date
            group by c.entity_id, c.as_of_date""",
        ("stays",),
    ),
    "sorted_report": Query(
        lambda t: sinks.sorted_report(
            C.status_report(t.stays, T1, NOW), F.desc("in_stay"), F.desc_nulls_first("duration_s"), "entity_id", "stay_id"
        ),
        f"with {REPORT} select * from report order by in_stay desc, duration_s desc nulls first, entity_id, stay_id",
        ("stays",),
    ),
}
