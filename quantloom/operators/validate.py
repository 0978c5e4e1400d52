"""Temporal splits, walk-forward tables and audits. Audits return the rows (or counts) that break a rule."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.windows import average_rank, scorr
from . import metrics


@dataclass(frozen=True)
class Split:
    """Lengths in trading days. purge: between train and test; embargo: after test. expanding: train starts at the first day."""

    train: int
    test: int
    step: int | None = None
    purge: int = 0
    embargo: int = 0
    expanding: bool = False


def split_spans(n_days: int, s: Split) -> list[tuple[int, str, int, int]]:
    """(split, part, first, last) in ordinals of days, both ends included; only whole test spans."""
    out, k, at = [], 0, 0
    while at + s.train + s.purge + s.test <= n_days:
        test = at + s.train + s.purge
        out.append((k, "train", 0 if s.expanding else at, at + s.train - 1))
        if s.purge:
            out.append((k, "purge", at + s.train, test - 1))
        out.append((k, "test", test, test + s.test - 1))
        if s.embargo and test + s.test < n_days:
            out.append((k, "embargo", test + s.test, min(n_days - 1, test + s.test + s.embargo - 1)))
        at, k = at + (s.step or s.test), k + 1
    return out


def splits(days: DataFrame, s: Split) -> DataFrame:
    """split, part, first_day, last_day, n_days of a calendar days(date, ordinal): a small table, made on the driver."""
    spark: SparkSession = days.sparkSession
    n = days.count()
    spans = spark.createDataFrame(split_spans(n, s), "split int, part string, lo int, hi int")
    first, last = days.select(F.col("ordinal").alias("lo"), F.col("date").alias("first_day")), days.select(F.col("ordinal").alias("hi"), F.col("date").alias("last_day"))
    return spans.join(first, "lo").join(last, "hi").select("split", "part", "first_day", "last_day", (F.col("hi") - F.col("lo") + 1).alias("n_days"))


def labelled(days: DataFrame, table: DataFrame) -> DataFrame:
    """split, part, date of every day of every split."""
    return table.join(days.select("date"), F.col("date").between(F.col("first_day"), F.col("last_day"))).select("split", "part", "date")


def walk_forward(signals: DataFrame, parts: DataFrame, least: int = 5) -> DataFrame:
    """split, part, ic_mean, ic_ir, n_days: each day's rank correlation once, then joined to all splits that have the day."""
    daily = metrics.ic(signals, ranks=True, least=least).where("ic IS NOT NULL")
    c = F.col("ic")
    return parts.where(F.col("part").isin("train", "test")).join(daily, "date").groupBy("split", "part").agg(F.avg(c).alias("ic_mean"), F.try_divide(F.avg(c), F.nullif(F.stddev_samp(c), F.lit(0.0))).alias("ic_ir"), F.count(c).alias("n_days"))


def walk_forward_days(signals: DataFrame, s: Split, x: str = "signal", y: str = "fwd", least: int = 5) -> DataFrame:
    """split, part, ic_mean, ic_ir, n_days as walk_forward gives them, from one pass: the days of the signals are the calendar.

    Splits are worked out on the daily table, a row a day, so nothing is read or counted beforehand.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    ranks = signals.where("date IS NOT NULL").select("date", average_rank(F.when(both, F.col(x)), "date").alias("a"), average_rank(F.when(both, F.col(y)), "date").alias("b"))
    daily = ranks.groupBy("date").agg(F.when(F.count("a") >= least, F.round(scorr(F.col("a"), F.col("b")), 12)).alias("ic"))
    o, n, step = F.col("o"), F.col("n"), s.step or s.test
    days = daily.withColumns({"o": F.row_number().over(Window.orderBy("date")) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy())})  # a row a day
    last = F.floor((n - s.train - s.purge - s.test) / step)
    split = days.where(last >= 0).withColumn("split", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    at = F.col("split") * step
    test = at + s.train + s.purge
    part = F.when((o >= (F.lit(0) if s.expanding else at)) & (o < at + s.train), "train").when((o >= test) & (o < test + s.test), "test")
    c = F.col("ic")
    return split.withColumn("part", part).where("part IS NOT NULL AND ic IS NOT NULL").groupBy("split", "part").agg(F.avg(c).alias("ic_mean"), F.try_divide(F.avg(c), F.nullif(F.stddev_samp(c), F.lit(0.0))).alias("ic_ir"), F.count(c).alias("n_days"))


def with_splits(rows: DataFrame, days: DataFrame, s: Split, parts: Sequence[str] = ("train", "test")) -> DataFrame:
    """rows(date, ...) once for each split and part that has their date, with columns split and part.

    Days are numbered in days(date, ordinal), a row a date; the splits of an ordinal follow from arithmetic, so that there is no join of ranges.
    """
    n = days.agg(F.count(F.lit(1)).alias("n")).first().n
    spans = [x for x in split_spans(n, s) if x[1] in parts]
    step, o = s.step or s.test, F.col("ordinal")
    last = max((k for k, *_ in spans), default=-1)
    if last < 0:
        return rows.select(F.lit(0).alias("split"), F.lit("").alias("part"), *rows.columns).where("false")
    # the splits whose span holds the ordinal are those from the first that reaches it to the last that begins before it
    reach = s.train + s.purge + s.test + s.embargo
    first = F.lit(0) if s.expanding else F.greatest(F.lit(0), F.ceil((o - (reach - 1)) / step)).cast("int")
    upto = F.least(F.lit(last), F.floor(o / step) if not s.expanding else F.lit(last)).cast("int")
    named = days.select("date", o, F.explode(F.when(first <= upto, F.sequence(first, upto))).alias("split"))
    at = F.col("split") * step
    test = at + s.train + s.purge
    inside = {"train": (F.lit(0) if s.expanding else at, at + s.train), "purge": (at + s.train, test), "test": (test, test + s.test), "embargo": (test + s.test, test + s.test + s.embargo)}
    part = None
    for p in parts:
        lo, hi = inside[p]
        hit = (o >= lo) & (o < hi)
        part = F.when(hit, p) if part is None else part.when(hit, p)
    marked = named.withColumn("part", part).where("part IS NOT NULL").select("date", "split", "part")
    return rows.join(marked, "date").select("split", "part", *rows.columns)


def walk_forward_with(rows: DataFrame, columns: Sequence[str], fit: Callable[[np.ndarray], np.ndarray], finish: Callable[[np.ndarray], np.ndarray], score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """rows(split, part, ...) of the test parts with `prediction`, by a model of the user's that is fitted to each split's train part.

    fit(x) gives the sums that a batch x of rows (its columns, as doubles, null as NaN) adds; sums of all batches of a split are added up by a shuffle and finish(sums) makes the
    model from them; score(x, model) gives a batch's predictions. So a split's rows are never in one place, however many. Models (one small array a split) go to
    the tasks; a split without a model gives null.
    """
    names, split_at = list(columns), rows.columns.index("split")
    kept = [c for c in rows.columns if c != "prediction"]

    def matrix(b: pa.RecordBatch) -> np.ndarray:
        return np.column_stack([np.asarray(b.column(b.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False)) for c in names])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            split, x = b.column(0).to_numpy(zero_copy_only=False), matrix(b)
            for k in np.unique(split):
                more = np.asarray(fit(x[split == k]), np.float64)
                total[int(k)] = total[int(k)] + more if int(k) in total else more
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.ravel() for v in total.values()], pa.list_(pa.float64()))], names=["split", "sums"])

    places = F.posexplode("sums").alias("at", "v")
    sums = rows.where("part = 'train'").select("split", *names).mapInArrow(partial, "split int, sums array<double>").select("split", places).groupBy("split", "at").agg(F.sum("v").alias("v"))
    found = sums.groupBy("split").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("sums")).collect()  # an array a split
    models = rows.sparkSession.sparkContext.broadcast({r["split"]: np.asarray(finish(np.array(r["sums"]))) for r in found})

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split, x = b.column(split_at).to_numpy(zero_copy_only=False), matrix(b)
            out = np.full(b.num_rows, np.nan)
            for k in np.unique(split):
                if k in models.value:
                    out[split == k] = score(x[split == k], models.value[k])
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in kept], pa.array(out, mask=np.isnan(out))], names=[*kept, "prediction"])

    kind = StructType([*[rows.schema[c] for c in kept], StructField("prediction", DoubleType())])
    return rows.where("part = 'test'").mapInArrow(predicted, kind)


def walk_forward_summary(wf: DataFrame, least: float = 0.0) -> DataFrame:
    """One row: splits, mean, median and deviation of the test parts, share that pass, and how train differs from test."""
    wide = wf.groupBy("split").agg(F.max(F.when(F.col("part") == "train", F.col("ic_mean"))).alias("train"), F.max(F.when(F.col("part") == "test", F.col("ic_mean"))).alias("test"))
    n = F.count("test")
    return wide.agg(n.alias("n_splits"), F.avg("test").alias("test_mean"), F.percentile("test", 0.5).alias("test_median"), F.stddev_samp("test").alias("test_std"), F.try_divide(F.count_if(F.col("test") > least), n).alias("pass_rate"), F.avg(F.col("train") - F.col("test")).alias("decay"))


def out_of_sample(signals: DataFrame, since: date | str, least: float = 0.0) -> DataFrame:
    """One row: mean rank correlation before a day and from it on, and if both are above `least`."""
    daily = metrics.ic(signals, ranks=True)
    new = F.col("date") >= F.lit(since).cast("date")
    out = daily.agg(F.avg(F.when(~new, F.col("ic"))).alias("ic_in"), F.avg(F.when(new, F.col("ic"))).alias("ic_out"), F.count_if(new & F.col("ic").isNotNull()).alias("days_out"))
    return out.withColumn("passed", F.coalesce((F.col("ic_in") > least) & (F.col("ic_out") > least), F.lit(False)))


def look_ahead(df: DataFrame, signal: str = "signal_date", entry: str = "entry_date", exit: str = "exit_date", known: str = "available_date") -> DataFrame:
    """check, violations: known after the signal, entry not after the signal, exit not after entry, unknown dates."""
    checks = {
        "known_after_signal": F.col(known) > F.col(signal), "entry_not_after_signal": F.col(entry) <= F.col(signal), "exit_not_after_entry": F.col(exit) <= F.col(entry),
        "no_known_date": F.col(known).isNull(), "no_entry": F.col(entry).isNull(),
    }
    row = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()])
    return row.unpivot([], list(checks), "check", "violations")


#: Checks that only warn: by themselves they prove no look-ahead.
WARNINGS = ("same_day_entry", "no_known_date")


def look_ahead_report(df: DataFrame, needed: Sequence[str] = ("date", "code"), lookback: int | None = None, shift: int | None = None) -> DataFrame:
    """check, severity (violation or warning), count, passed: every check that the table's columns allow, in one pass.

    Columns by name: date, code, available_date, signal_date, entry_date, exit_date, forward_return. A needed column that is missing is a violation of its own; the others
    leave out the checks that need them. Checks: rows without a key, repeated keys, facts known after the signal (without a signal_date: after the date), facts
    without a known date, signals after their date, entries before or on the signal's day, exits not after entries, returns of such a window; a negative look-back or
    shift of the signal's recipe.
    """
    have = set(df.columns)
    c = F.col
    missing = {f"missing_{n}": F.lit(1) for n in needed if n not in have}
    rules: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
        "no_key": (("date", "code"), lambda: F.count_if(c("date").isNull() | c("code").isNull())),
        "repeated_key": (("date", "code"), lambda: F.count(F.struct("date", "code")) - F.count_distinct(F.struct("date", "code"))),
        "known_after_signal": (("available_date", "signal_date" if "signal_date" in have else "date"), lambda: F.count_if(c("available_date") > c("signal_date" if "signal_date" in have else "date"))),
        "no_known_date": (("available_date",), lambda: F.count_if(c("available_date").isNull())),
        "signal_after_date": (("signal_date", "date"), lambda: F.count_if(c("signal_date") > c("date"))),
        "entry_before_signal": (("entry_date", "signal_date"), lambda: F.count_if(c("entry_date") < c("signal_date"))),
        "same_day_entry": (("entry_date", "signal_date"), lambda: F.count_if(c("entry_date") == c("signal_date"))),
        "exit_not_after_entry": (("exit_date", "entry_date"), lambda: F.count_if(c("exit_date") <= c("entry_date"))),
        "return_of_no_window": (("forward_return", "exit_date", "entry_date"), lambda: F.count_if((c("exit_date") <= c("entry_date")) & c("forward_return").isNotNull())),
    }
    found = missing | {k: count() for k, (names, count) in rules.items() if have >= set(names)}
    found |= {k: F.lit(int(v < 0)) for k, v in (("negative_lookback", lookback), ("negative_shift", shift)) if v is not None}
    row = df.agg(*[n.cast("long").alias(k) for k, n in found.items()])
    long = row.unpivot([], list(found), "check", "count")
    return long.select("check", F.when(F.col("check").isin(*WARNINGS), "warning").otherwise("violation").alias("severity"), "count", (F.col("count") == 0).alias("passed"))


def temporal(df: DataFrame, key: str = "code", on: str = "date", seq: str = "seq") -> DataFrame:
    """key, n, backward, repeated: rows that step back in time in the order of `seq`, and repeated times; keys with either."""
    before = F.lag(on).over(Window.partitionBy(key).orderBy(seq))
    marked = df.select(key, on, (F.col(on) < before).alias("back"))
    by = marked.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("back", F.lit(False))).alias("backward"), (F.count(on) - F.count_distinct(on)).alias("repeated"))
    return by.where("backward > 0 OR repeated > 0")


def split_overlaps(table: DataFrame) -> DataFrame:
    """split, a, b, days: parts of a split that share days; the table has a few rows a split."""
    a = table.select("split", F.col("part").alias("a"), F.col("first_day").alias("fa"), F.col("last_day").alias("la"))
    b = table.select("split", F.col("part").alias("b"), F.col("first_day").alias("fb"), F.col("last_day").alias("lb"))
    both = a.join(b, "split").where("a < b AND fa <= lb AND fb <= la")
    return both.select("split", "a", "b", (F.datediff(F.least("la", "lb"), F.greatest("fa", "fb")) + 1).alias("days"))


def data_quality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, n, missing, zeros, negative: one pass over all columns."""
    aggs = []
    for c in columns:
        v = F.col(c)
        aggs += [F.count_if(v.isNull()).alias(f"{c}__missing"), F.count_if(F.coalesce(v == 0, F.lit(False))).alias(f"{c}__zeros"), F.count_if(F.coalesce(v < 0, F.lit(False))).alias(f"{c}__negative")]
    row = df.agg(F.count(F.lit(1)).alias("n"), *aggs)
    parts = [F.struct(F.lit(c).alias("column"), F.col("n"), *[F.col(f"{c}__{k}").alias(k) for k in ("missing", "zeros", "negative")]) for c in columns]
    return row.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def leakage(df: DataFrame, signal: str = "signal_date", known: str = "available_date", target: str = "target_date", features: Sequence[str] = (), labels: Sequence[str] = ()) -> DataFrame:
    """check, violations: what was known after the signal, labels of the signal's day or before, unknown dates, columns that are feature and
    label, and features that equal a label in all of its known rows (two or more of different values)."""
    checks = {
        "known_after_signal": F.col(known) > F.col(signal), "target_not_after_signal": F.col(target) <= F.col(signal), "no_signal_date": F.col(signal).isNull(),
        "no_known_date": F.col(known).isNull(),
    }
    aggs = [F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()]
    pairs = [(f, y) for f in features for y in labels if f != y]
    for i, (f, y) in enumerate(pairs):
        apart, there = ~F.col(f).eqNullSafe(F.col(y)) & F.col(y).isNotNull(), F.count_distinct(y) > 1
        aggs.append(F.when((F.count_if(apart) == 0) & there, 1).otherwise(0).cast("long").alias(f"__{i}"))
    row = df.agg(*aggs)
    same = sum((F.col(f"__{i}") for i in range(len(pairs))), F.lit(0).cast("long"))
    row = row.select(*checks, F.lit(len(set(features) & set(labels))).cast("long").alias("feature_is_label"), same.alias("feature_equals_label"))
    return row.unpivot([], row.columns, "check", "violations")


def split_audit(table: DataFrame, gap: int = 0) -> DataFrame:
    """split, check, violations of split(split, part, first_day, last_day, last_label): parts train, validation, test in this order, each
    beginning more than `gap` days after the one before ends and after its last label day; and parts that end before they begin."""
    place = F.when(F.col("part") == "train", 0).when(F.col("part") == "validation", 1).otherwise(2)
    w = Window.partitionBy("split").orderBy("place")
    t = table.withColumn("place", place)
    t = t.select("split", "first_day", "last_day", F.lag("first_day").over(w).alias("before"), F.lag("last_day").over(w).alias("end"), F.lag("last_label").over(w).alias("label"))
    checks = {
        "out_of_order": F.col("first_day") <= F.col("before"), "overlap": F.col("first_day") <= F.col("end"), "short_gap": F.datediff("first_day", "end") <= gap,
        "label_reaches_in": F.col("label") >= F.col("first_day"), "ends_before_it_begins": F.col("last_day") < F.col("first_day"),
    }
    by = t.groupBy("split").agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()])
    return by.unpivot(["split"], list(checks), "check", "violations")


def gate(*audits: DataFrame, warn_only: Sequence[str] = ()) -> DataFrame:
    """One row of audits(check, violations): checks, failed (their names in order), warned, passed (nothing failed)."""
    rows = None
    for a in audits:
        own = a.select("check", "violations")
        rows = own if rows is None else rows.unionAll(own)
    bad = rows.groupBy("check").agg(F.sum("violations").alias("n")).withColumn("warn", F.col("check").isin(*warn_only) if warn_only else F.lit(False))
    names = lambda keep: F.array_join(F.sort_array(F.collect_list(F.when(keep & (F.col("n") > 0), F.col("check")))), ",")
    out = bad.agg(F.count(F.lit(1)).alias("checks"), names(~F.col("warn")).alias("failed"), names(F.col("warn")).alias("warned"))
    return out.withColumn("passed", F.col("failed") == "")
