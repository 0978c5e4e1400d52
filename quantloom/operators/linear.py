"""Linear systems over periods: the covariance of a period's codes, inverted without a period's rows in one place.

A date of a period is one row, the array of its codes' returns. Few codes: tasks add up products into one matrix a period, which is small. Many codes: conjugate gradients, of
which each round multiplies all rows with the current direction (a number a code and period, sent to the tasks) and adds up what comes back; the matrix
is never made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import dropped, written

#: Codes of a period up to which its matrix is made.
DENSE = 256
#: Share of the right side that may be left over, and the most rounds for each code.
LEFT, ROUNDS = 1e-12, 3


def summed_arrays(parts: DataFrame, *keys: str, groups: int = 64) -> DataFrame:
    """keys and `sums`, arrays of one length a key added up element by element; parts(keys, sums) are summed in at most `groups` groups first."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)

    def added(rows: pa.Table) -> pa.Table:
        total = np.stack(rows.column("sums").to_numpy()).sum(axis=0)
        return pa.table({**{k: rows.column(k)[:1] for k in keys}, "sums": pa.array([total], pa.list_(pa.float64()))})

    some = parts.select(*keys, "sums", (F.monotonically_increasing_id() % groups).alias("__g"))
    return some.groupBy(*keys, "__g").applyInArrow(added, kinds).groupBy(*keys).applyInArrow(added, kinds)


@dataclass
class Periods:
    """rows: (key, x) of each complete date; codes, number of dates and means of each period."""

    rows: DataFrame
    key: str
    codes: dict
    dates: dict
    means: dict

    def sums(self, fn: Callable[[object, np.ndarray], np.ndarray]) -> dict:
        """Of each period the sum over its rows of fn(period, matrix of rows)."""
        kind = self.rows.schema[self.key].dataType.simpleString()

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict = {}
            for b in batches:
                keys, lists = b.column(0).to_pylist(), b.column(1)
                at: dict = {}
                for i, k in enumerate(keys):
                    at.setdefault(k, []).append(i)
                for k, rows in at.items():
                    own = lists.take(pa.array(rows))
                    more = fn(k, np.asarray(own.flatten(), np.float64).reshape(len(rows), -1)).ravel()
                    total[k] = total[k] + more if k in total else more
            yield pa.RecordBatch.from_arrays([pa.array(list(total), b_type), pa.array(list(total.values()), pa.list_(pa.float64()))], names=[self_key, "sums"])

        self_key, b_type = self.key, _arrow(self.rows.schema[self.key].dataType)
        parts = self.rows.select(self.key, "x").mapInArrow(partial, f"`{self.key}` {kind}, sums array<double>")
        return {r[0]: np.array(r[1]) for r in summed_arrays(parts, self.key).collect()}  # an array a period


def _arrow(kind) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "date": pa.date32()}[kind.simpleString()]


def periods(rets: DataFrame, key: str) -> Periods:
    """Of rets(key, date, code, ret): a period's codes are those with a return in it, its dates those that have all of them; repeated rows are averaged."""
    known = rets.where(F.col("ret").isNotNull()).groupBy(key, "date", "code").agg(F.avg("ret").alias("ret"))
    codes = {r[0]: r[1] for r in known.groupBy(key).agg(F.sort_array(F.collect_set("code"))).collect()}  # a name a code and period
    size = F.broadcast(rets.sparkSession.createDataFrame([(k, len(c)) for k, c in codes.items()], f"`{key}` {rets.schema[key].dataType.simpleString()}, __n int"))  # a row a period
    dates = known.groupBy(key, "date").agg(F.transform(F.sort_array(F.collect_list(F.struct("code", "ret"))), lambda v: v["ret"]).alias("x"))
    rows = written(dates.join(size, key).where(F.size("x") == F.col("__n")).select(key, "x"))
    found = Periods(rows, key, codes, {}, {})
    for k, s in found.sums(lambda _, x: np.r_[len(x), x.sum(axis=0)]).items():
        found.dates[k], found.means[k] = int(s[0]), s[1:] / s[0]
    return found


def solved(p: Periods, right: Mapping[object, np.ndarray], ridge: float, dense: int = DENSE) -> dict:
    """Of each period with two dates or more the vector w with (covariance + ridge * identity) w = right."""
    means, use = p.means, [k for k, n in p.dates.items() if n > 1 and k in right]
    small = {k for k in use if len(p.codes[k]) <= dense}
    out: dict = {}
    if small:
        for k, s in p.sums(lambda k, x: (x - means[k]).T @ (x - means[k]) if k in small else np.zeros(1)).items():
            if k in small:
                n = len(p.codes[k])
                out[k] = np.linalg.solve(s.reshape(n, n) / (p.dates[k] - 1) + ridge * np.eye(n), right[k])
    x = {k: np.zeros(len(right[k])) for k in use if k not in small}
    r = {k: np.array(right[k], float) for k in x}
    d = {k: v.copy() for k, v in r.items()}
    aim = {k: LEFT**2 * (v @ v) for k, v in r.items()}
    left = {k for k in x if r[k] @ r[k] > aim[k]}
    for _ in range(ROUNDS * max((len(right[k]) for k in left), default=0)):
        if not left:
            break
        now = {k: d[k] for k in left}
        products = p.sums(lambda k, m: (m - means[k]).T @ ((m - means[k]) @ now[k]) if k in now else np.zeros(1))
        for k in list(left):
            q = products[k] / (p.dates[k] - 1) + ridge * d[k]
            before = r[k] @ r[k]
            step = before / (d[k] @ q)
            x[k], r[k] = x[k] + step * d[k], r[k] - step * q
            d[k] = r[k] + (r[k] @ r[k]) / before * d[k]
            if r[k] @ r[k] <= aim[k]:
                left.discard(k)
    return out | x


def weights_table(rets: DataFrame, p: Periods, weights: Mapping[object, np.ndarray]) -> DataFrame:
    """key, code, weight as a table: a row a code and period."""
    rows = [(k, c, float(w)) for k, v in weights.items() for c, w in zip(p.codes[k], v, strict=True)]
    kind = rets.schema[p.key].dataType.simpleString()
    dropped(p.rows)
    return rets.sparkSession.createDataFrame(rows, f"`{p.key}` {kind}, code string, weight double")
