"""Search for signals: batches of expressions measured in one job each, deduplicated, ranked and evolved."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import col
from ..functions.windows import average_rank, scorr
from ..operators import fitness, metrics
from . import expr


def measure(panel: DataFrame, signals: Mapping[str, expr.Node], y: str = "fwd", least: int = 5) -> DataFrame:
    """signal, ic_mean, ic_ir, positive, n_days of each signal: rank correlations by date, all in one job.

    Signals are columns of one plan (one exchange by date), then rows.
    """
    names = list(signals)
    wide = expr.evaluate(panel.where(col(y).isNotNull()), signals)
    long = wide.select("date", "code", y, F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), F.col(n).alias("x")) for n in names])).alias("s")).select("date", y, "s.signal", "s.x").where("x IS NOT NULL")
    ranked = long.select("signal", "date", average_rank("x", "signal", "date").alias("rx"), average_rank(y, "signal", "date").alias("ry"))
    daily = ranked.groupBy("signal", "date").agg(F.when(F.count(F.lit(1)) >= least, F.round(scorr(F.col("rx"), F.col("ry")), 12)).alias("ic"))
    c = F.col("ic")
    return daily.groupBy("signal").agg(F.avg(c).alias("ic_mean"), F.try_divide(F.avg(c), F.nullif(F.stddev_samp(c), F.lit(0.0))).alias("ic_ir"), F.try_divide(F.count_if(c > 0), F.count(c)).alias("positive"), F.count(c).alias("n_days"))


def measure_all(panel: DataFrame, signals: Mapping[str, expr.Node], y: str = "fwd", since: str | None = None, least: int = 5, tail: float = 0.2, batch: int = 32) -> DataFrame:
    """signal, ic, icir, hit_rate, quantile_spread, oos_ic, oos_icir, n_days, complexity of each signal, in the terms that fitness and gates go by.

    ic: mean rank correlation by date, before `since` (all dates without it); oos_ic: from `since` on. quantile_spread: mean of what follows the highest share `tail` of a
    date's ranks less that of the lowest. A batch of signals is one branch of the plan, with one exchange by date; all batches are one job.
    """
    names, c, spread = list(signals), F.col("ic"), F.col("spread")
    before = F.col("date") < F.lit(since).cast("date") if since else F.lit(True)
    daily = None
    for at in range(0, len(names), batch):
        part = names[at : at + batch]
        wide = expr.evaluate(panel.where(col(y).isNotNull()), {n: signals[n] for n in part})
        rows = F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), F.col(n).alias("x")) for n in part])).alias("s")
        long = wide.select("date", "code", y, rows).select("date", y, "s.signal", "s.x").where("x IS NOT NULL")
        ranks = long.select("signal", "date", y, average_rank("x", "signal", "date").alias("rx"), average_rank(y, "signal", "date").alias("ry"), F.count(F.lit(1)).over(Window.partitionBy("signal", "date")).alias("n"))
        high, low = F.col("rx") > F.col("n") * (1 - tail), F.col("rx") <= F.col("n") * tail
        enough = F.count(F.lit(1)) >= least
        one = ranks.groupBy("signal", "date").agg(
            F.when(enough, F.round(scorr(F.col("rx"), F.col("ry")), 12)).alias("ic"), F.when(enough, F.avg(F.when(high, col(y))) - F.avg(F.when(low, col(y)))).alias("spread")
        )
        daily = one if daily is None else daily.unionAll(one)
    inside, after = F.when(before, c), F.when(~before, c)

    def ratio(x: Column) -> Column:
        return F.try_divide(F.avg(x), F.nullif(F.stddev_samp(x), F.lit(0.0)))

    found = daily.groupBy("signal").agg(
        F.avg(inside).alias("ic"), ratio(inside).alias("icir"), F.try_divide(F.count_if(inside > 0), F.count(inside)).alias("hit_rate"), F.avg(F.when(before, spread)).alias("quantile_spread"),
        F.avg(after).alias("oos_ic"), ratio(after).alias("oos_icir"), F.count(inside).alias("n_days"),
    )
    known = panel.sparkSession.createDataFrame([(n, float(expr.complexity(signals[n]))) for n in names], "signal string, complexity double")
    return known.join(found, "signal", "left").select("signal", "ic", "icir", "hit_rate", "quantile_spread", "oos_ic", "oos_icir", F.coalesce("n_days", F.lit(0)).alias("n_days"), "complexity")


#: What a candidate must reach, and what it must not exceed.
LEAST, MOST = {"ic": 0.0, "n_days": 20}, {"complexity": 25.0}


def graded(panel: DataFrame, signals: Mapping[str, expr.Node], y: str = "fwd", since: str | None = None, least: Mapping[str, float] = LEAST, most: Mapping[str, float] = MOST) -> DataFrame:
    """`measure_all` with score, penalty, fitness, failures, accepted and place: among the accepted by falling fitness, then by name; null for the others."""
    rated = fitness.gates(fitness.fitness(measure_all(panel, signals, y, since)), least, most, positive_oos=since is not None)
    ok = F.col("accepted") & F.col("fitness").isNotNull()
    order = Window.partitionBy(ok).orderBy(F.desc("fitness"), "signal")  # a row a candidate
    return rated.withColumn("place", F.when(ok, F.row_number().over(order)))


@dataclass
class Candidate:
    name: str
    node: expr.Node
    ic: float
    ir: float
    score: float


def score(ic: float, ir: float, node: expr.Node, weight: float = 0.001) -> float:
    return abs(ic) + 0.1 * abs(ir) - weight * expr.complexity(node)


def distinct(nodes: Sequence[expr.Node]) -> list[expr.Node]:
    return list({expr.fingerprint(n): n for n in reversed(nodes)}.values())[::-1]


def ranked(panel: DataFrame, nodes: Sequence[expr.Node], y: str = "fwd", batch: int = 32, since: str | None = None) -> list[Candidate]:
    """Candidates by falling score, a row a signal. With `since` only those that pass the gates, by fitness, in one job; else by the short score, a batch a job."""
    out = []
    if since is not None:
        signals = {f"s{i}": n for i, n in enumerate(nodes)}
        for r in graded(panel, signals, y, since).where("place IS NOT NULL").collect() if signals else []:
            out.append(Candidate(r.signal, signals[r.signal], r.ic, r.icir or 0.0, r.fitness))
    else:
        for at in range(0, len(nodes), batch):
            part = {f"s{at + i}": n for i, n in enumerate(nodes[at : at + batch])}
            for r in measure(panel, part, y).collect():
                if r.ic_mean is not None:
                    out.append(Candidate(r.signal, part[r.signal], r.ic_mean, r.ic_ir or 0.0, score(r.ic_mean, r.ic_ir or 0.0, part[r.signal])))
    return sorted(out, key=lambda c: (-c.score, expr.canonical(c.node)))


def uncorrelated(panel: DataFrame, found: Sequence[Candidate], most: float = 0.9, least: int = 30) -> list[Candidate]:
    """Those that, in order, correlate with none kept before by `most` or more; pairs known together on fewer than `least` rows count as apart.

    Correlations of all pairs come from one pass of blocked sums.
    """
    if len(found) < 2:
        return list(found)
    wide = expr.evaluate(panel, {c.name: c.node for c in found})
    return greedy(found, metrics.gram_correlations(wide, [c.name for c in found], least), most)


def greedy(found: Sequence[Candidate], pairs: DataFrame, most: float) -> list[Candidate]:
    """Candidates kept in order, by pairs(a, b, corr) of their names: only the pairs at `most` or above are read."""
    near = {frozenset((r.a, r.b)) for r in pairs.where(F.abs("corr") >= most).select("a", "b").collect()}
    kept: list[Candidate] = []
    for c in found:
        if all(frozenset((c.name, k.name)) not in near for k in kept):
            kept.append(c)
    return kept


def search(panel: DataFrame, names: Sequence[str], n: int = 64, top: int = 10, seed: int = 0, y: str = "fwd", since: str | None = None) -> list[Candidate]:
    """The best of n random expressions, without copies and near copies; with `since` those that pass the gates, by fitness."""
    rng = random.Random(seed)
    nodes = distinct([expr.random_tree(rng, names) for _ in range(n)])
    return uncorrelated(panel, ranked(panel, [x for x in nodes if expr.features(x)], y, since=since)[: 3 * top])[:top]


def evolve(panel: DataFrame, names: Sequence[str], generations: int = 5, size: int = 32, elites: int = 4, seed: int = 0, patience: int = 3, y: str = "fwd", tournament: int = 0, since: str | None = None) -> list[Candidate]:
    """The last generation by score. Parents are drawn by linear rank or, with tournament, as the best of so many drawn; each generation is
    measured in one go; ends early without gain. With `since` only those that pass the gates breed, by fitness."""
    rng = random.Random(seed)
    people = distinct([expr.random_tree(rng, names) for _ in range(size)])
    best, stale, found = -1.0, 0, []
    for _ in range(generations):
        found = ranked(panel, [x for x in people if expr.features(x)], y, since=since)
        if not found:
            break
        stale = 0 if found[0].score > best + 1e-9 else stale + 1
        best = max(best, found[0].score)
        if stale >= patience:
            break
        weights = list(range(len(found), 0, -1))
        young = [c.node for c in found[:elites]]
        tries = 0
        while len(young) < size and tries < 20 * size:
            tries += 1
            # found is by falling score, so the least place wins
            a, b = (found[min(rng.choices(range(len(found)), k=tournament))] for _ in range(2)) if tournament else rng.choices(found, weights, k=2)
            luck = rng.random()
            child = expr.crossed(a.node, b.node, rng) if luck < 0.5 else expr.crossed_at_root(a.node, b.node, rng) if luck < 0.6 else expr.mutated(a.node, rng, names)
            try:
                expr.check(child)
            except ValueError:
                continue
            young = distinct([*young, child])
        people = young
    return found


def library_rows(found: Sequence[Candidate]) -> list[tuple]:
    """(fingerprint, expression as JSON, ic, ir, score) for a library table."""
    return [(expr.fingerprint(c.node), expr.to_json(c.node), c.ic, c.ir, c.score) for c in found]
