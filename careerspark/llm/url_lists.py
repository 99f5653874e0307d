"""URL filters over time: dated list entries as validity intervals, joined as of the time of each capture.

An entry says what holds for a host, or for all hosts below a domain, from its date on, until the next entry of the same
name. A capture is judged by the entry active at its fetch time; of several names (its host and the domains above it)
the most specific one with an active entry decides.

Captures are first reduced to distinct (host, fetch time); decisions are joined back on both, so a host with a third of all
captures is spread over its times. Only names that a list has are followed further: hosts are tried against them once
each, so a domain such as ``com`` gathers nothing unless it is listed. The join itself is a sorted union: the entries and
distinct times of a name stand in one order, and each time takes the last entry before it, so n times and m entries cost n + m
rows, however many hosts lie below the name. The times of a name are cut into periods (``PERIOD`` seconds, or days), each opened by the entry that is active
when it begins, so no task needs all times of a name.
Times are compared as they are given: dates as days, timestamps as instants; a date beside timestamps is its midnight.

Results of odd rows: a capture without a host or time gets the action ``none``; entries with a null name, time or action
are ignored; of entries of one name and time the action first in the order of ``STRICTEST`` counts, others after these
in their order; repeated captures are judged one by one. Hosts may be IPv6 addresses in brackets, which have no domains above
them. Names of entries are written as hosts are: lower case, without white space around them and final dots. A URL of any length
is read whole. Columns other than the url, the time and ``keep`` are not read; ``keep`` must not name a result column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRICTEST = ("block", "review", "allow")
RESULTS = ("host", "matched_name", "action", "since")
PERIOD = 86_400             # seconds


def _written(name: Column) -> Column:
    return F.nullif(F.regexp_replace(F.lower(F.trim(name)), r"\.+$", ""), F.lit(""))


def host(url: str) -> Column:
    """The host of an absolute URL in lower case, without user, port and final dot; null if there is none."""
    found = F.regexp_extract(F.trim(F.col(url)), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@]+)", 1)
    return _written(found)


def names(name: str) -> Column:
    """The host and the domains above it, most labels first; an address in brackets is one name."""
    parts = F.split(F.col(name), r"\.")
    n = F.size(parts)
    above = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))
    return F.when(F.col(name).startswith("["), F.array(F.col(name))).otherwise(F.array_distinct(F.concat(F.array(F.col(name)), above)))


def time_type(*columns: tuple[DataFrame, str]) -> str:
    """The type in which times of these columns are compared: dates if all are dates, else timestamps as given."""
    kinds = {df.select(c).dtypes[0][1] for df, c in columns}
    return kinds.pop() if len(kinds) == 1 and kinds <= {"date", "timestamp", "timestamp_ntz"} else "timestamp"


def intervals(entries: DataFrame, kind: str) -> DataFrame:
    """``entries`` has name, dated and action. Returns name, action and the time ``since`` which it holds, until the next one of
    the name; one row per name and time."""
    order = F.coalesce(*[F.when(F.col("action") == a, F.lit(k)) for k, a in enumerate(STRICTEST)], F.lit(len(STRICTEST)))
    return (entries.select(_written(F.col("name")).alias("name"), F.col("dated").cast(kind).alias("since"), "action").dropna()
            .groupBy("name", "since").agg(F.min_by("action", F.struct(order, "action")).alias("action")))


def judge(captures: DataFrame, entries: DataFrame, url: str, fetched: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each capture, with host, matched_name, action and since."""
    clash = [c for c in keep if c in RESULTS]
    if clash:
        raise ValueError(f"keep names result columns: {', '.join(clash)}")
    kind = time_type((captures, fetched), (entries, "dated"))
    own = captures.select(*[F.col(c).alias(f"_keep{k}") for k, c in enumerate(keep)], host(url).alias("_host"),
                          F.col(fetched).cast(kind).alias("_time"))
    visits = own.select(F.col("_host").alias("host"), F.col("_time").alias("time")).dropna().distinct()
    valid = intervals(entries, kind)
    listed = valid.select(F.col("name").alias("_listed")).distinct()
    followed = (visits.select("host").distinct().select(F.col("host").alias("_of"), F.explode(names("host")).alias("_name"))
                .join(listed, F.col("_name") == F.col("_listed"), "left_semi"))
    tried = visits.join(followed, F.col("host") == F.col("_of")).select(F.col("_name").alias("name"), "host", "time")
    asked = tried.select("name", "time", _period("time", kind).alias("period")).distinct()       # whatever the number of hosts
    # Each period of a name that has times is opened by the entry active then; entries inside a period follow in order.
    periods = asked.select("name", "period").distinct()
    begun = periods.unionByName(valid.select("name", _period("since", kind).alias("period"))).distinct()
    last = Window.partitionBy("name").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    closing = valid.groupBy("name", _period("since", kind).alias("period")).agg(F.max_by(F.struct("since", "action"), "since").alias("_last"))
    opened = (begun.join(closing, ["name", "period"], "left").withColumn("e", F.last("_last", ignorenulls=True).over(last))
              .join(periods.withColumnsRenamed({"name": "_n", "period": "_p"}), (F.col("name") == F.col("_n")) & (F.col("period") == F.col("_p")), "left_semi"))
    rows = (opened.filter("e is not null").select("name", "period", F.lit(0).alias("kind"), F.col("e.since").alias("at"), "e")
            .unionByName(valid.select("name", _period("since", kind).alias("period"), F.lit(0).alias("kind"), F.col("since").alias("at"), F.struct("since", "action").alias("e")))
            .unionByName(asked.select("name", "period", F.lit(1).alias("kind"), F.col("time").alias("at"), F.lit(None).cast(opened.schema["e"].dataType).alias("e"))))
    upto = Window.partitionBy("name", "period").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    active = (rows.withColumn("e", F.last("e", ignorenulls=True).over(upto)).filter("kind = 1 and e is not null")
              .select(F.col("name").alias("_n"), F.col("at").alias("_t"), "e"))
    decided = (tried.join(active, (F.col("name") == F.col("_n")) & (F.col("time") == F.col("_t"))).groupBy("host", "time")
               .agg(F.max_by(F.struct("name", "e.action", "e.since"), F.length("name")).alias("d")))
    found = own.join(decided, (F.col("_host") == F.col("host")) & (F.col("_time") == F.col("time")), "left")
    return found.select(*[F.col(f"_keep{k}").alias(c) for k, c in enumerate(keep)], F.col("_host").alias("host"),
                        F.col("d.name").alias("matched_name"), F.coalesce("d.action", F.lit("none")).alias("action"),
                        F.col("d.since").alias("since"))


def _period(time: str, kind: str) -> Column:
    seconds = F.unix_date(time) * 86_400 if kind == "date" else F.unix_seconds(F.col(time).cast("timestamp"))
    return F.floor(seconds / PERIOD).cast("long")
