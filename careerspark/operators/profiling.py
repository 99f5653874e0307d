"""Looking at data before trusting it: profiles, ranges, duplicates, keys that do not resolve."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import prefix, ratio
from ..sources.stages import session_stages
from .skew import join_back, oversized_of
from .stats import quantiles_of_counts

QUANTILES = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p100": 1.0}


SKETCH_SIZE = 2_000         # of the quantile sketches; their rank error is 0.14 % with 99 % confidence
RANK_ERROR = 0.005          # stated error of a quantile's rank: over three times that
DISTINCT_BITS = 12          # of the sketches of distinct values, whose standard error is 1.04 / 2 ^ 6
DISTINCT_ERROR = 0.05       # stated error of a number of distinct values: over three standard errors
SHOWN = ("column", "type", "n_rows", "n_missing", "complete_rate", "n_distinct", "min_text", "max_text", "min_length", "max_length",
         "n_empty", "mean", "sd", *QUANTILES)


def profile(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = False) -> DataFrame:
    """One row per column: type, rows, missing and distinct values; lengths and extremes of text; mean, standard
    deviation and quantiles of numbers; first and last date.

    Everything comes from one pass. Distinct counts and quantiles come from sketches, with the errors that ``sketches``
    states; ``exact`` counts all values of all columns in one shuffle instead (``value_table``).
    """
    cols = list(cols or df.columns)
    return _exact_profile(df, cols) if exact else profile_of(sketches(df, cols))


def value_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Every value of every column with its number of rows ``_k``: ``_col`` (position of the column), ``_v`` (text, no number's),
    ``_x`` (numbers as double) and ``_i`` (whole numbers). One scan and one shuffle of counts, however many columns."""
    entries = []
    for i, c in enumerate(cols):
        kind, dtype, col = _kind(df.schema[c].dataType), df.schema[c].dataType, F.col(f"`{c}`")
        whole = isinstance(dtype, T.IntegralType)
        real = kind == "number" and not whole
        entries.append(F.struct(
            F.lit(i).alias("_col"), (F.lit(None) if kind == "number" and not isinstance(dtype, T.DecimalType) else col).cast("string").alias("_v"),
            (col.cast("double") + F.lit(0.0) if real else F.lit(None).cast("double")).alias("_x"),
            (col if whole else F.lit(None)).cast("long").alias("_i")))
    return df.select(F.inline(F.array(*entries))).groupBy("_col", "_v", "_x", "_i").agg(F.count(F.lit(1)).alias("_k"))


def _exact_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    counts = session_stages(df.sparkSession).keep(value_table(df, cols), "values")      # read for text, numbers and sizes
    numbers = [i for i, c in enumerate(cols) if _kind(df.schema[c].dataType) == "number"]
    number = F.coalesce(F.col("_x"), F.col("_i").cast("double"))
    known = F.coalesce(F.col("_v"), F.col("_x").cast("string"), F.col("_i").cast("string")).isNotNull()
    length = F.length("_v")
    basics = counts.groupBy("_col").agg(
        F.sum("_k").alias("n_rows"), F.coalesce(F.sum(F.when(~known, F.col("_k"))), F.lit(0)).alias("n_missing"), F.count_if(known).alias("n_distinct"),
        F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.min(length).alias("_short"), F.max(length).alias("_long"),
        F.coalesce(F.sum(F.when(F.col("_v") == "", F.col("_k"))), F.lit(0)).alias("_empty"))
    values = counts.filter(F.col("_col").isin(numbers) & known).select("_col", number.alias("_x"), "_k").groupBy("_col", "_x").agg(F.sum("_k").alias("_k"))
    sizes = basics.filter(F.col("_col").isin(numbers)).select("_col", "n_distinct")
    heavy = oversized_of(sizes, "_col", "n_distinct")
    quartiles = quantiles_of_counts(values, QUANTILES, ["_col"], heavy)
    sums = values.groupBy("_col").agg(F.sum("_k").alias("_n"), (F.sum(F.col("_x") * F.col("_k")) / F.sum("_k")).alias("mean"))
    spread = (join_back(values, sums, ["_col"], heavy=None).groupBy("_col", "_n", "mean")
              .agg(F.sum((F.col("_x") - F.col("mean")) * (F.col("_x") - F.col("mean")) * F.col("_k")).alias("_squares"))
              .select("_col", "mean", F.sqrt(F.try_divide(F.col("_squares"), F.col("_n").cast("double") - 1.0)).alias("sd")))
    stats = spread.join(quartiles, "_col")
    about = [F.struct(F.lit(i).alias("_col"), F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("type"), F.lit(_kind(df.schema[c].dataType)).alias("_kind"))
             for i, c in enumerate(cols)]
    named = df.sparkSession.range(1).select(F.inline(F.array(*about)))
    text, plain = F.col("_kind") == "text", F.col("_kind") != "number"
    out = named.join(basics, "_col", "left").join(stats, "_col", "left").withColumns({
        "n_rows": F.coalesce("n_rows", F.lit(0)), "n_missing": F.coalesce("n_missing", F.lit(0)), "n_distinct": F.coalesce("n_distinct", F.lit(0))})
    return out.withColumns({
        "complete_rate": ratio(F.col("n_rows") - F.col("n_missing"), "n_rows"), "min_text": F.when(plain, F.col("_min")), "max_text": F.when(plain, F.col("_max")),
        "min_length": F.when(text, F.col("_short")).cast("long"), "max_length": F.when(text, F.col("_long")).cast("long"),
        "n_empty": F.when(text, F.coalesce("_empty", F.lit(0)))}).select(*SHOWN)


def sketches(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One row per column (and group ``by``) of what adds up over parts of a table: counts, extremes, sums, and sketches of
    distinct values and of quantiles. ``merged`` adds rows of several parts, days or runs; ``profile_of`` reads them."""
    cols = list(cols or df.columns)
    kind = {c: _kind(df.schema[c].dataType) for c in cols}
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        col = F.col(f"`{c}`")
        aggs += [F.count(col).alias(f"_n{i}"), F.min(col).alias(f"_min{i}"), F.max(col).alias(f"_max{i}"),
                 F.hll_sketch_agg(F.when(col.isNotNull(), F.xxhash64(col)), DISTINCT_BITS).alias(f"_d{i}")]
        if kind[c] == "number":
            value = col.cast("double")
            aggs += [F.sum(value).alias(f"_s{i}"), F.var_pop(value).alias(f"_v{i}"), F.kll_sketch_agg_double(value, SKETCH_SIZE).alias(f"_q{i}")]
        if kind[c] == "text":
            aggs += [F.min(F.length(col)).alias(f"_short{i}"), F.max(F.length(col)).alias(f"_long{i}"), F.count_if(col == "").alias(f"_empty{i}")]
    null = {t: F.lit(None).cast(t) for t in ("double", "long", "string", "binary")}
    rows = []
    for i, c in enumerate(cols):
        number, text = kind[c] == "number", kind[c] == "text"
        rows.append(F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("type"), F.col("_rows").alias("n_rows"), F.col(f"_n{i}").alias("n_known"),
            (null["string"] if number else F.col(f"_min{i}").cast("string")).alias("min_text"),
            (null["string"] if number else F.col(f"_max{i}").cast("string")).alias("max_text"),
            *[(F.col(f"_{a}{i}").cast("long") if text else null["long"]).alias(b) for a, b in (("short", "min_length"), ("long", "max_length"), ("empty", "n_empty"))],
            *[(F.col(f"_{a}{i}") if number else null["double"]).alias(b) for a, b in (("s", "total"), ("v", "variance"))],
            *[(F.col(f"_{a}{i}").cast("double") if number else null["double"]).alias(b) for a, b in (("min", "least"), ("max", "greatest"))],
            F.col(f"_d{i}").alias("distinct"), (F.col(f"_q{i}") if number else null["binary"]).alias("quantiles")))
    return df.groupBy(*by).agg(*aggs).select(*by, F.inline(F.array(*rows)))


def merged(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of several parts of a table as those of the whole (per group ``by``)."""
    mean = F.try_divide(F.col("total"), F.col("n_known").cast("double"))
    squares = F.col("n_known") * (F.coalesce("variance", F.lit(0.0)) + F.coalesce(mean * mean, F.lit(0.0)))
    known = F.sum("n_known").cast("double")
    total_mean = F.try_divide(F.sum("total"), known)
    return parts.groupBy(*by, "position", "column", "type").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_known").alias("n_known"), F.min("min_text").alias("min_text"), F.max("max_text").alias("max_text"),
        F.min("min_length").alias("min_length"), F.max("max_length").alias("max_length"), F.sum("n_empty").alias("n_empty"), F.sum("total").alias("total"),
        F.when(F.count("quantiles") > 0, F.greatest(F.try_divide(F.sum(squares), known) - total_mean * total_mean, F.lit(0.0))).alias("variance"),
        F.min("least").alias("least"), F.max("greatest").alias("greatest"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles", SKETCH_SIZE).alias("_merged"), F.count("quantiles").alias("_q")).withColumn(
            "quantiles", F.when(F.col("_q") > 0, F.col("_merged"))).drop("_merged", "_q")


def profile_of(found: DataFrame, by: Sequence[str] = (), errors: bool = False) -> DataFrame:
    """The profile that sketches give. With ``errors``, also the stated errors: distinct_error, a share of n_distinct, and
    rank_error, a share of the known rows."""
    known, number = F.col("n_known"), F.col("quantiles").isNotNull() & (F.col("n_known") > 0)

    def quantile(p: float):
        inner = F.col("least") if p == 0 else F.col("greatest") if p == 1 else F.kll_sketch_get_quantile_double("quantiles", F.lit(p))
        return F.when(number, inner)

    shown = found.select(
        *by, "column", "type", "n_rows", (F.col("n_rows") - known).alias("n_missing"), ratio(known, "n_rows").alias("complete_rate"),
        F.round(F.hll_sketch_estimate("distinct")).cast("long").alias("n_distinct"), "min_text", "max_text", "min_length", "max_length", "n_empty",
        F.try_divide(F.col("total"), known.cast("double")).alias("mean"),
        F.sqrt(F.try_divide(F.col("variance") * known, known.cast("double") - 1.0)).alias("sd"),
        *[quantile(p).alias(q) for q, p in QUANTILES.items()],
        F.lit(DISTINCT_ERROR).alias("distinct_error"), F.when(number, F.lit(RANK_ERROR)).alias("rank_error"))
    return shown if errors else shown.drop("distinct_error", "rank_error")


def errors_held(df: DataFrame, approximate: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Checks ``profile_of(.., errors=True)`` against all values: column, n_rows, n_missing, distinct_within and
    quantiles_within (missing for other columns than numbers)."""
    counts = value_table(df, list(cols))
    number = F.coalesce(F.col("_x"), F.col("_i").cast("double"))
    known = F.coalesce(F.col("_v"), F.col("_x").cast("string"), F.col("_i").cast("string")).isNotNull()
    met = counts.select("_col", number.alias("_x"), known.alias("_known"), "_k").join(
        F.broadcast(approximate.join(df.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(i).alias("_col"), F.lit(c).alias("column")) for i, c in enumerate(cols)]))), "column")), "_col")
    sums = [F.coalesce(F.sum(F.when(cond, F.col("_k"))), F.lit(0)).alias(f"_{side}_{q}") for q in QUANTILES for side, cond in (
        ("below", F.col("_x") < F.col(q)), ("upto", F.col("_x") <= F.col(q)))]
    kept = ["column", "n_rows", "n_missing", "n_distinct", "distinct_error", "rank_error"]
    out = met.groupBy(*kept).agg(F.count_if("_known").alias("_distinct"), *sums)
    rows = (F.col("n_rows") - F.col("n_missing")).cast("double")
    inside = F.lit(True)
    for q, p in QUANTILES.items():
        inside &= (F.col(f"_below_{q}") <= (p + F.col("rank_error")) * rows) & (F.col(f"_upto_{q}") >= (p - F.col("rank_error")) * rows)
    return out.select("column", "n_rows", "n_missing", (F.abs(F.col("n_distinct") - F.col("_distinct")) <= F.col("distinct_error") * F.col("_distinct")).alias("distinct_within"),
                      F.when(F.col("rank_error").isNotNull(), inside).alias("quantiles_within"))


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "number"
    return "text" if isinstance(dtype, T.StringType) else "other"


def schema_listing(df: DataFrame) -> DataFrame:
    """One row per column: position (from 1), name, type, whether missing values are allowed, and whether there are any."""
    missing = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_m{i}") for i, c in enumerate(df.columns)])
    return missing.select(F.inline(F.array(*[F.struct(
        F.lit(i + 1).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
        F.lit(f.nullable).alias("nullable"), (F.coalesce(F.col(f"_m{i}"), F.lit(0)) > 0).alias("has_missing")) for i, f in enumerate(df.schema)])))


def violations(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows with impossible values."""
    return df.filter(predicate)


def ranges(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """``min_<col>`` and ``max_<col>``, over all rows or per code."""
    aggs = [f(c).alias(f"{name}_{c}") for c in cols for name, f in (("min", F.min), ("max", F.max))]
    return (df if where is None else df.filter(where)).groupBy(*by).agg(*aggs)


def range_violations(observed: DataFrame, allowed: DataFrame, on: Sequence[str], low: str, high: str,
                     allowed_low: str = "allowed_low", allowed_high: str = "allowed_high") -> DataFrame:
    """Codes whose observed range leaves the allowed one."""
    return observed.join(allowed, list(on)).filter((F.col(low) < F.col(allowed_low)) | (F.col(high) > F.col(allowed_high)))


def prefix_counts(df: DataFrame, text: str, n: int, by: Sequence[str] = (), where: Column | None = None,
                  out: str = "prefix") -> DataFrame:
    """How often each text prefix occurs with each code."""
    return (df if where is None else df.filter(where)).groupBy(prefix(text, n).alias(out), *by).agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def duplicate_keys(df: DataFrame, keys: Sequence[str], min_count: int = 2) -> DataFrame:
    """Business keys that occur several times."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def unresolved(df: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """Names without an ID, with their number of rows."""
    return df.filter(F.col(id_col).isNull()).groupBy(name_col).agg(F.count(F.lit(1)).alias("n"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows equal in every column: each once, with its number of copies."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n_copies")).filter(F.col("n_copies") > 1)


def oversized_groups(df: DataFrame, by: Sequence[str], limit: int, out: str = "group_size") -> DataFrame:
    """All rows of the groups with more than ``limit`` rows. Adaptive execution splits the partition of a large group."""
    return join_back(df, df.groupBy(*by).agg(F.count(F.lit(1)).alias(out)).filter(F.col(out) > limit), list(by), heavy=None)


def ambiguous_keys(df: DataFrame, key: str, attr: str, out: str = "n_values") -> DataFrame:
    """Keys that occur with several attribute values, one row per value."""
    pairs = df.select(key, attr).distinct()
    return join_back(pairs, pairs.groupBy(key).agg(F.count(F.lit(1)).alias(out)).filter(F.col(out) > 1), [key], heavy=None)


def inspect(df: DataFrame, entity: str, value, cols: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Every row of one entity."""
    one = df.filter(F.col(entity) == value)
    return (one.orderBy(*[F.col(c).asc_nulls_last() for c in order]) if order else one).select(*cols)


def gap_outliers(df: DataFrame, gap: str, lo: float, hi: float) -> DataFrame:
    """Rows whose time gap lies outside the plausible range."""
    return df.filter(~F.col(gap).between(lo, hi))
