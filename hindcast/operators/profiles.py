"""Wide profiles: one row per patient, or one per crosswalk record, with the flags of every source."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.functions.tristate import any_answer, matches_without
from hindcast.operators.joins import full_outer
from hindcast.operators.linkage import typed_crosswalk


@dataclass(frozen=True)
class Attachment:
    """Columns of `frame`, keyed by `key`, for crosswalk rows of one source tag.

    `match` names the crosswalk column the key equals: source_key, hash_key or entity_id.
    """

    source: str
    frame: DataFrame
    key: str
    match: str = "source_key"

    def columns(self) -> list[str]:
        return [c for c in self.frame.columns if c != self.key]


def inventory_by_person(
    cases: DataFrame,
    inventory: DataFrame,
    on: str,
    person: str,
    answers: Sequence[str],
    reversed_answers: Sequence[str],
    out: str,
) -> DataFrame:
    """Strongest questionnaire sign per person number, through the person's cases."""
    sign = inventory.select(on, any_answer(answers, reversed_answers).alias(out)).filter(F.col(out).isNotNull())
    per_case = sign.groupBy(on).agg(F.max(out).alias(out))
    return cases.select(on, person).join(per_case, on).groupBy(person).agg(F.max(out).alias(out))


def flagged_by_person(
    index: DataFrame, records: DataFrame, on: str, person: str, flag: str, out: str, dedupe: bool = False
) -> DataFrame:
    """One row per answered record of a person number, 1 for 'Y' and 0 for 'N'; `dedupe` keeps the strongest."""
    answered = records.filter(F.col(flag).isin("Y", "N")).select(on, (F.col(flag) == "Y").cast("int").alias(out))
    number = F.col(person).try_cast("bigint").alias(person)
    rows = index.select(on, number).join(answered, on).select(person, out)
    return rows.groupBy(person).agg(F.max(out).alias(out)) if dedupe else rows


def matched_by_hash(
    raw: DataFrame,
    cleaned: DataFrame,
    on: str,
    hash_col: str,
    texts: Sequence[str],
    pattern: str,
    exclusion: str,
    out: str,
    dedupe: bool = False,
) -> DataFrame:
    """One row per matching record of a hashed id; `dedupe` keeps one per id."""
    hits = cleaned.filter(matches_without(texts, pattern, exclusion)).select(on)
    rows = raw.select(on, hash_col).join(hits, on).select(hash_col, F.lit(1).alias(out))
    return rows.groupBy(hash_col).agg(F.max(out).alias(out)) if dedupe else rows


def profile_by_source(crosswalk: DataFrame, attachments: Sequence[Attachment]) -> DataFrame:
    """One row per distinct crosswalk row; each source's columns appear only on rows of its own tag.

    The crosswalk is cut by tag first. A tag's slice meets only its own sources, and the many rows with
    another kind of key never pile up as NULL keys in a join they cannot match.
    """
    typed = typed_crosswalk(crosswalk)
    tags = sorted({a.source for a in attachments})
    parts = [typed.filter(F.col("source").isNull() | ~F.col("source").isin(*tags))]
    for tag in tags:
        part = typed.filter(F.col("source") == tag)
        for a in (a for a in attachments if a.source == tag):
            part = part.join(a.frame.withColumnRenamed(a.key, a.match), a.match, "left")
        parts.append(part)
    names = list(typed.columns)
    for a in attachments:
        names += [c for c in a.columns() if c not in names]
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts).select(*names)


def label_composite_target(profile: DataFrame, repeated: str, signs: Sequence[str]) -> DataFrame:
    """Target 1 for a repeat event together with any sign of 1."""
    any_sign = F.coalesce(F.greatest(*[F.col(s) for s in signs]) == 1, F.lit(False))
    both = F.coalesce(F.col(repeated) == 1, F.lit(False)) & any_sign
    return profile.withColumn("target", both.cast("int"))


def profile_with_target(
    crosswalk: DataFrame,
    attachments: Sequence[Attachment],
    repeated: str,
    signs: Sequence[str],
    filled: dict[str, tuple[str, str]],
) -> DataFrame:
    """Profile by source with categories filled from a second source and the composite target.

    `filled` maps an output column to the (first, second) columns it is taken from.
    """
    profile = label_composite_target(profile_by_source(crosswalk, attachments), repeated, signs)
    dropped = [c for pair in filled.values() for c in pair]
    return profile.withColumns({out: F.coalesce(*pair) for out, pair in filled.items()}).drop(*dropped)


def profile_patient(
    calls: DataFrame,
    admissions: DataFrame,
    payors: DataFrame,
    scores: DataFrame,
    ids: DataFrame,
    universe: DataFrame,
    key: str,
    coalesce_key: bool = False,
) -> DataFrame:
    """Call counts, admissions, payor, scores, ids and universe in one full-outer profile.

    Each input but `ids` has one row per `key`. They meet on the admissions' key: without admissions each of
    them stays a row of its own with a NULL key. `coalesce_key` puts them on one row with the key instead.
    The inputs travel as rows of one log and meet in one aggregation.
    """
    inputs = {"_call": calls, "_adm": admissions, "_pay": payors, "_score": scores}
    tagged = [df.filter(F.col(key).isNotNull()).withColumn(tag, F.lit(1)) for tag, df in inputs.items()]
    values = {tag: [c for c in df.columns if c != key] for tag, df in inputs.items()}
    names = [c for group in values.values() for c in group]
    log = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), tagged)
    merged = log.groupBy(key).agg(*[F.max(c).alias(c) for c in [*names, *inputs]])
    if coalesce_key:
        rows = merged.select(F.col(key).alias("link_key"), key, *names)
    else:
        types = dict(merged.dtypes)

        def alone(tag: str):
            kept = [F.col(c) if c in values[tag] else F.lit(None).cast(types[c]).alias(c) for c in names]
            return F.when(F.col(tag) == 1, F.struct(F.lit(None).cast(types[key]).alias(key), *kept))

        together = F.struct(F.col(key), *[F.col(c) for c in names])
        pieces = F.when(F.col("_adm") == 1, F.array(together)).otherwise(
            F.array_compact(F.array(*[alone(tag) for tag in inputs if tag != "_adm"]))
        )
        rows = merged.select(F.explode(pieces).alias("piece")).select("piece.*").withColumn("link_key", F.col(key))
    # Only these rows have a link key, and every entity of `ids` is in the linked rows: no need to derive either from them.
    keyed = reduce(DataFrame.unionByName, [df.select(key) for df in inputs.values()]) if coalesce_key else admissions
    numbered = ids.select(F.col("source_key").alias("link_key"), "entity_id")
    linked = full_outer(rows, numbered, "link_key", keyed.select(F.col(key).alias("link_key")))
    return full_outer(linked.drop("link_key"), universe.select("entity_id"), "entity_id", ids)
