"""From names to entities: aliases, a cascade of sources, corrections, and the ranking in force at debut."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import MIN_GAP_WEEKS, REFRESH_GAP_NULL_AFTER, REFRESH_RANKED_AFTER
from ..functions.scalars import date_lit, if_else, weeks_between
from .profiling import duplicate_keys
from .sequence import arg_max_rows
from .skew import AUTO, join_back, lookup_join

MAX_LITERAL_ROWS = 100_000   # literal tables up to this size are broadcast

# ---- people ----------------------------------------------------------------


def attach_person(df: DataFrame, people: DataFrame, key: str, person_key: str, prefix: str,
                  cols: Sequence[str] | None = None, heavy: DataFrame | None | str = AUTO) -> DataFrame:
    """Left join of one person row per key, its columns prefixed with the role.

    Without a hint: a small dimension is broadcast by its size, a large one is joined by shuffle.
    """
    cols = [c for c in (cols or people.columns) if c != person_key]
    side = people.select(F.col(person_key).alias("_person"), *[F.col(c).alias(f"{prefix}{c}") for c in cols])
    return lookup_join(df, side, {key: "_person"}, heavy=heavy).drop("_person")


def enrich(summary: DataFrame, agg: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Adds the columns of a fresh aggregate to an existing summary."""
    return summary.join(agg, [on] if isinstance(on, str) else list(on), "left")


# ---- aliases ---------------------------------------------------------------


def _literal(df: DataFrame, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    table = df.sparkSession.createDataFrame(list(rows), schema)
    return F.broadcast(table) if len(rows) <= MAX_LITERAL_ROWS else table


def apply_aliases(df: DataFrame, aliases: Mapping[str, str] | DataFrame, col: str, out: str | None = None,
                  heavy: DataFrame | None | str = AUTO) -> DataFrame:
    """Whole-name replacement. ``aliases`` is a mapping or a table ``(name, canonical_name)``."""
    small = not isinstance(aliases, DataFrame) and len(aliases) <= MAX_LITERAL_ROWS
    if isinstance(aliases, DataFrame):
        table = aliases.groupBy(F.col("name").alias("_alias")).agg(F.min("canonical_name").alias("_canonical"))
    else:
        schema = T.StructType([T.StructField("_alias", T.StringType()), T.StructField("_canonical", T.StringType())])
        table = _literal(df, list(aliases.items()), schema)
    return (lookup_join(df, table, {col: "_alias"}, heavy=None if small else heavy)
            .withColumn(out or col, F.coalesce(F.col("_canonical"), F.col(col))).drop("_alias", "_canonical"))


# ---- the cascade -----------------------------------------------------------


@dataclass(frozen=True)
class Step:
    """One source of entities: a table with a name and an ID column, perhaps filtered.

    ``aliased`` steps look up the alias-corrected name; they come after the steps that use the name as given.
    """

    people: DataFrame
    name: str
    id: str
    where: Column | None = None
    aliased: bool = False


def resolve_step(df: DataFrame, people: DataFrame, name: str, id: str, person_name: str, person_id: str,
                 where: Column | None = None, heavy: DataFrame | None | str = AUTO) -> DataFrame:
    """Left join on the name, then fill missing IDs. Names with several IDs give several rows."""
    side = (people if where is None else people.filter(where)).select(
        F.col(person_name).alias("_name"), F.col(person_id).alias("_id")).distinct()
    return (lookup_join(df, side, {name: "_name"}, heavy=heavy, where=F.col(id).isNull(), unique=False)
            .withColumn(id, F.coalesce(F.col(id), F.col("_id"))).drop("_name", "_id"))


def _candidates(steps: Sequence[tuple[int, Step]], on_ambiguous: str) -> DataFrame:
    """IDs per name from the first source that knows the name."""
    parts = []
    for priority, s in steps:
        src = s.people if s.where is None else s.people.filter(s.where)
        parts.append(src.select(F.col(s.name).alias("_name"), F.col(s.id).alias("_id"), F.lit(priority).alias("_step"))
                     .filter(F.col("_name").isNotNull() & F.col("_id").isNotNull()))
    every = reduce(DataFrame.unionByName, parts)
    if on_ambiguous == "first":
        return every.groupBy("_name").agg(F.min(F.struct("_step", "_id")).alias("_best")).select(
            "_name", F.col("_best._id").alias("_id"), F.col("_best._step").alias("_step"))
    every = every.groupBy("_name", "_id").agg(F.min("_step").alias("_step"))
    first = every.groupBy("_name").agg(F.min("_step").alias("_step"))
    return every.join(first, ["_name", "_step"], "left_semi")


def resolve_cascade(df: DataFrame, steps: Sequence[Step], *, name: str, id: str,
                    aliases: Mapping[str, str] | DataFrame | None = None, step_out: str = "resolved_by",
                    on_ambiguous: str = "all", heavy: DataFrame | None | str = AUTO) -> DataFrame:
    """Fills missing IDs from an ordered list of sources; the first one that knows a name decides.

    Step 0 is an ID that was given. All sources that share a name form are merged first, so the list is joined
    once per form and not once per source. A name with several IDs in its source keeps all of them as candidate
    rows (``on_ambiguous='all'``) or the smallest (``'first'``). ``resolved_by`` is NULL for unresolved rows.
    Names that only an alias step resolves are written in their corrected form. ``heavy=None`` says that no name is
    listed often enough to matter.
    """
    if on_ambiguous not in ("all", "first"):
        raise ValueError("on_ambiguous must be 'all' or 'first'")
    numbered = list(enumerate(steps, 1))
    raw = [(i, s) for i, s in numbered if not s.aliased]
    corrected = [(i, s) for i, s in numbered if s.aliased]
    if raw and corrected and max(i for i, _ in raw) > min(i for i, _ in corrected):
        raise ValueError("aliased steps come last")
    out = df.withColumn(step_out, F.when(F.col(id).isNotNull(), F.lit(0)))
    if raw:
        out = _fill(out, _candidates(raw, on_ambiguous), name, id, step_out, on_ambiguous == "first", heavy)
    if corrected:
        fixed = out.withColumn("_fixed", F.col(name)) if aliases is None else apply_aliases(out, aliases, name, "_fixed", heavy)
        fixed = fixed.withColumn(name, F.when(F.col(id).isNull(), F.col("_fixed")).otherwise(F.col(name))).drop("_fixed")
        out = _fill(fixed, _candidates(corrected, on_ambiguous), name, id, step_out, on_ambiguous == "first",
                    heavy if heavy is None else AUTO)   # names have changed
    return out


def candidate_sets(steps: Sequence[tuple[int, Step]]) -> DataFrame:
    """Every ID that any source has for a name: name, id, step (the source's priority) and ``decides``, whether it is the first
    source that knows the name."""
    parts = []
    for priority, s in steps:
        src = s.people if s.where is None else s.people.filter(s.where)
        parts.append(src.select(F.col(s.name).alias("name"), F.col(s.id).alias("id"), F.lit(priority).alias("step"))
                     .filter(F.col("name").isNotNull() & F.col("id").isNotNull()))
    every = reduce(DataFrame.unionByName, parts).distinct()
    first = every.groupBy("name").agg(F.min("step").alias("_first"))
    return join_back(every, first, ["name"], heavy=None).withColumn("decides", F.col("step") == F.col("_first")).drop("_first")


def cascade_review(df: DataFrame, steps: Sequence[Step], *, name: str, id: str, aliases: Mapping[str, str] | DataFrame | None = None,
                   heavy: DataFrame | None | str = AUTO) -> DataFrame:
    """What to look at by hand after ``resolve_cascade``: the names for which the source that decides has several IDs.

    One row per name and name form (given or corrected): form, name, resolved_by, n_candidates, candidates (sorted),
    other_sources (IDs that later sources have besides), n_rows (rows of ``df`` that the name fills) and extra_rows, by which
    the result has more rows than ``df``. Rows of the result are the rows of ``df`` and all extra rows.
    """
    numbered = list(enumerate(steps, 1))
    reviews = []
    open_rows = df.filter(F.col(id).isNull()).groupBy(F.col(name).alias("_listed")).agg(F.count(F.lit(1)).alias("n_rows"))
    for form, chosen in (("given", [(i, s) for i, s in numbered if not s.aliased]), ("corrected", [(i, s) for i, s in numbered if s.aliased])):
        if not chosen:
            continue
        if form == "corrected" and aliases is not None:
            fixed = apply_aliases(open_rows, aliases, "_listed", heavy=None)     # one row per name
            open_rows = fixed.groupBy("_listed").agg(F.sum("n_rows").alias("n_rows"))
        sets = candidate_sets(chosen)
        found = sets.groupBy("name").agg(
            F.min("step").alias("resolved_by"), F.sort_array(F.collect_set(F.when(F.col("decides"), F.col("id")))).alias("candidates"),
            F.sort_array(F.collect_set(F.when(~F.col("decides"), F.col("id")))).alias("_later"))
        several = duplicate_keys(sets.filter("decides"), ["name"]).select(F.col("name").alias("_name"), F.col("n").alias("n_candidates"))
        listed = found.join(several, F.col("name") == F.col("_name")).join(open_rows, F.col("name") == F.col("_listed"))
        reviews.append(listed.select(
            F.lit(form).alias("form"), "name", "resolved_by", "n_candidates", "candidates",
            F.array_except("_later", "candidates").alias("other_sources"), "n_rows", ((F.col("n_candidates") - 1) * F.col("n_rows")).alias("extra_rows")))
        open_rows = open_rows.join(found.select("name"), F.col("_listed") == F.col("name"), "left_anti")
    return reduce(DataFrame.unionByName, reviews)


def _fill(df: DataFrame, found: DataFrame, name: str, id: str, step_out: str, unique: bool,
          heavy: DataFrame | None | str) -> DataFrame:
    side = found.withColumnRenamed("_step", "_by")
    return (lookup_join(df, side, {name: "_name"}, heavy=heavy, where=F.col(id).isNull(), unique=unique)
            .withColumns({id: F.coalesce(F.col(id), F.col("_id")), step_out: F.coalesce(F.col(step_out), F.col("_by"))})
            .drop("_name", "_id", "_by"))


# ---- corrections -----------------------------------------------------------


@dataclass(frozen=True)
class Correction:
    """Rule for rows that equal every given ``match`` value: new values, values set to null, or removal."""

    match: Mapping[str, object]
    set: Mapping[str, object | None] | None = None
    drop_row: bool = False


def apply_corrections(df: DataFrame, rules: Sequence[Correction]) -> DataFrame:
    """First matching rule wins; rows without a rule stay as they are.

    Rules that test the same columns form one literal table joined by equality, so thousands of rules cost a few
    broadcast joins and the rows are never split and appended again.
    """
    patterns: dict[tuple, list[tuple[int, Correction]]] = {}
    for priority, r in enumerate(rules):
        patterns.setdefault(tuple(sorted(r.match)), []).append((priority, r))
    targets = sorted({c for r in rules for c in (r.set or {})})
    fields = [T.StructField("priority", T.IntegerType()), T.StructField("drop_row", T.BooleanType())]
    for c in targets:
        fields += [T.StructField(f"has_{c}", T.BooleanType()), T.StructField(f"new_{c}", df.schema[c].dataType)]
    verdict = T.StructType(fields)
    out, hits = df, []
    for p, (cols, members) in enumerate(patterns.items()):
        first: dict[tuple, tuple] = {}
        for priority, r in members:
            key = tuple(r.match[c] for c in cols)
            changes = [v for c in targets for v in (c in (r.set or {}), (r.set or {}).get(c))]
            first.setdefault(key, (priority, r.drop_row, *changes))
        schema = T.StructType([T.StructField(f"_k{p}_{c}", df.schema[c].dataType) for c in cols]
                              + [T.StructField(f"_v{p}", verdict)])
        table = _literal(df, [(*k, v) for k, v in first.items()], schema)
        cond = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_k{p}_{c}") for c in cols])
        out = out.join(table, cond, "left").drop(*[f"_k{p}_{c}" for c in cols])
        hits.append(F.col(f"_v{p}"))
    if not hits:
        return df
    best = F.least(*hits) if len(hits) > 1 else hits[0]
    out = out.withColumn("_rule", best).filter(~F.coalesce(F.col("_rule.drop_row"), F.lit(False)))
    return out.select(*[
        F.when(F.col(f"_rule.has_{c}"), F.col(f"_rule.new_{c}")).otherwise(F.col(c)).alias(c) if c in targets else F.col(c)
        for c in df.columns])


# ---- rankings --------------------------------------------------------------


def rank_gap(df: DataFrame, ranked: str, debut: str, out: str = "gap_wks") -> DataFrame:
    """Weeks from debut to ranking; positive when ranked after the debut."""
    return df.withColumn(out, weeks_between(ranked, debut))


def latest_ranking(rankings: DataFrame, entity: str, gap: str, min_gap: float = MIN_GAP_WEEKS,
                   heavy: DataFrame | None | str = AUTO) -> DataFrame:
    """The ranking in force at debut: the row with the largest gap, unless the entity fell off the list before."""
    last = arg_max_rows(rankings.filter(F.col(entity).isNotNull()), entity, gap, heavy=heavy)
    return last.filter(F.col(gap) > min_gap)


def attach_ranking(df: DataFrame, latest: DataFrame, key: str, entity: str, rank: str) -> DataFrame:
    """Rank in force at debut, NULL for entities that were not ranked."""
    side = latest.select(F.col(entity).alias("_entity"), F.col(rank).alias(rank))
    return df.join(side, F.col(key) == F.col("_entity"), "left").drop("_entity")   # one row per entity on both sides


def refresh_ids(rankings: DataFrame, update: DataFrame, *, name: str, id: str, year: str, debut: str, gap: str,
                update_name: str, update_id: str, update_debut: str, ranked_after: str = REFRESH_RANKED_AFTER,
                gap_null_after: str = REFRESH_GAP_NULL_AFTER, exclude: Sequence[str] = (),
                heavy: DataFrame | None | str = AUTO) -> DataFrame:
    """Fills IDs and debuts of names that were still unresolved from a later release of the people table.

    ``exclude`` lists names too ambiguous to use. The gap is computed again and has no value for debuts after
    the last ranking list.
    """
    open_names = (rankings.filter(F.col(id).isNull() & (F.col(year) > date_lit(ranked_after)))
                  .select(F.col(name).alias("_name")).distinct())
    side = (update.filter(F.col(update_id).isNotNull() & ~F.col(update_name).isin(list(exclude)))
            .select(F.col(update_name).alias("_name"), F.col(update_id).alias("_id"), F.col(update_debut).alias("_debut"))
            .join(open_names, "_name", "left_semi"))
    filled = (lookup_join(rankings, side, {name: "_name"}, heavy=heavy, unique=False)
              .withColumns({id: F.coalesce(F.col(id), F.col("_id")), debut: F.coalesce(F.col(debut), F.col("_debut"))})
              .drop("_name", "_id", "_debut"))
    late = F.col(debut) > date_lit(gap_null_after)
    weeks = weeks_between(year, debut)
    return filled.withColumn(gap, if_else(late, F.lit(None).cast("double"), weeks))
