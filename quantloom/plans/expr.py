"""A small expression language of signals, compiled to columns.

Trees are immutable tuples in effect: Feature, Constant, Op. Equal trees have equal canonical text. Functions across a date (rank,
zscore, winsorize) need their argument as a column, since windows can't hold windows, so the compiler puts each such argument into a
stage of its own; equal subtrees are compiled once for a whole batch of signals.
"""

from __future__ import annotations

import hashlib
import json
import random
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.num import clip, safe_log, sdiv
from ..functions.windows import rank_pct
from ..operators.transforms import winsorize_quantile, zscore

MAX_DEPTH, MAX_NODES = 12, 64


@dataclass(frozen=True)
class Feature:
    name: str


@dataclass(frozen=True)
class Constant:
    value: float


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


Node = Feature | Constant | Op

SCALARS: dict[str, tuple[int, Callable[..., Column]]] = {
    "add": (2, lambda a, b: a + b),
    "sub": (2, lambda a, b: a - b),
    "mul": (2, lambda a, b: a * b),
    "div": (2, lambda a, b: sdiv(a, b, 1e-12)),
    "neg": (1, lambda a: -a),
    "abs": (1, F.abs),
    "sign": (1, F.signum),
    "log": (1, safe_log),
    "sqrt": (1, lambda a: F.sqrt(F.abs(a))),
    "inv": (1, lambda a: sdiv(F.lit(1.0), a, 1e-12)),
    "clip": (1, lambda a: clip(a, -5.0, 5.0)),
}
DATED: dict[str, Callable[[Column], Column]] = {"rank": rank_pct, "zscore": zscore, "winsorize": lambda a: winsorize_quantile(a, 0.05)}
COMMUTATIVE = {"add", "mul"}


def arity(name: str) -> int:
    return 1 if name in DATED else SCALARS[name][0]


def walk(n: Node) -> Iterator[Node]:
    yield n
    if isinstance(n, Op):
        for a in n.args:
            yield from walk(a)


def depth(n: Node) -> int:
    return 1 + max((depth(a) for a in n.args), default=0) if isinstance(n, Op) else 1


def size(n: Node) -> int:
    return sum(1 for _ in walk(n))


def features(n: Node) -> set[str]:
    return {x.name for x in walk(n) if isinstance(x, Feature)}


def complexity(n: Node) -> float:
    """Nodes, half the depth and a quarter of the operators."""
    return size(n) + 0.5 * depth(n) + 0.25 * sum(isinstance(x, Op) for x in walk(n))


def check(n: Node) -> None:
    """Raises ValueError on unknown operators, wrong arity, or a tree too deep or too large."""
    for x in walk(n):
        if isinstance(x, Op):
            if x.name not in SCALARS and x.name not in DATED:
                raise ValueError(f"unknown operator {x.name}")
            if len(x.args) != arity(x.name):
                raise ValueError(f"{x.name} takes {arity(x.name)} arguments")
    if depth(n) > MAX_DEPTH or size(n) > MAX_NODES:
        raise ValueError("the expression is too deep or too large")


def canonical(n: Node) -> str:
    """The tree as text, arguments of commutative operators in order."""
    if isinstance(n, Feature):
        return n.name
    if isinstance(n, Constant):
        return repr(float(n.value))
    args = [canonical(a) for a in n.args]
    return f"{n.name}({','.join(sorted(args) if n.name in COMMUTATIVE else args)})"


def fingerprint(n: Node) -> str:
    return hashlib.sha256(canonical(n).encode()).hexdigest()


def to_json(n: Node) -> str:
    def plain(x: Node):
        if isinstance(x, Feature):
            return {"feature": x.name}
        if isinstance(x, Constant):
            return {"constant": x.value}
        return {"op": x.name, "args": [plain(a) for a in x.args]}

    return json.dumps(plain(n), sort_keys=True)


def from_json(text: str) -> Node:
    def tree(x: Mapping) -> Node:
        if "feature" in x:
            return Feature(x["feature"])
        if "constant" in x:
            return Constant(float(x["constant"]))
        return Op(x["op"], tuple(tree(a) for a in x["args"]))

    return tree(json.loads(text))


def evaluate(panel: DataFrame, signals: Mapping[str, Node]) -> DataFrame:
    """panel with a column for each signal.

    Stages follow the nesting of dated functions; each stage is one projection, and all windows of a stage go by date, so a batch of
    signals takes one exchange whatever their number.
    """
    for n in signals.values():
        check(n)
    levels: dict[str, int] = {}

    def level(n: Node) -> int:
        """How many dated functions a path down the tree has at most."""
        key = canonical(n)
        if key not in levels:
            own = max((level(a) for a in n.args), default=0) if isinstance(n, Op) else 0
            levels[key] = own + (isinstance(n, Op) and n.name in DATED)
        return levels[key]

    dated = {canonical(x): x for n in signals.values() for x in walk(n) if isinstance(x, Op) and x.name in DATED}
    names = {k: f"__d{i}" for i, k in enumerate(sorted(dated))}

    def scalar(n: Node) -> Column:
        if isinstance(n, Feature):
            return F.col(n.name).cast("double")
        if isinstance(n, Constant):
            return F.lit(float(n.value))
        if n.name in DATED:
            return F.col(names[canonical(n)])
        return SCALARS[n.name][1](*[scalar(a) for a in n.args])

    out = panel
    for stage in range(1, max((level(x) for x in dated.values()), default=0) + 1):
        here = {k: x for k, x in dated.items() if level(x) == stage}
        out = out.withColumns({f"{names[k]}_arg": scalar(x.args[0]) for k, x in here.items()})
        out = out.withColumns({names[k]: DATED[x.name](F.col(f"{names[k]}_arg")) for k, x in here.items()})
    out = out.withColumns({k: scalar(n) for k, n in signals.items()})
    return out.drop(*names.values(), *[f"{v}_arg" for v in names.values()])


def random_tree(rng: random.Random, names: Sequence[str], most_depth: int = 4, constant: float = 0.1, leaf: float = 0.35) -> Node:
    if most_depth <= 1 or rng.random() < leaf:
        return Constant(round(rng.uniform(-2, 2), 3)) if rng.random() < constant else Feature(rng.choice(list(names)))
    op = rng.choice([*SCALARS, *DATED])
    return Op(op, tuple(random_tree(rng, names, most_depth - 1, constant, leaf) for _ in range(arity(op))))


def paths(n: Node, at: tuple[int, ...] = ()) -> Iterator[tuple[tuple[int, ...], Node]]:
    yield at, n
    if isinstance(n, Op):
        for i, a in enumerate(n.args):
            yield from paths(a, (*at, i))


def replaced(n: Node, at: tuple[int, ...], new: Node) -> Node:
    if not at:
        return new
    return Op(n.name, tuple(replaced(a, at[1:], new) if i == at[0] else a for i, a in enumerate(n.args)))


def mutated(n: Node, rng: random.Random, names: Sequence[str]) -> Node:
    """One change: another feature, constant or operator of like arity, a new subtree, a unary operator put in or taken out, or a subtree in place of the whole."""
    kind = rng.choices(["feature", "constant", "operator", "subtree", "insert", "remove", "hoist"], [20, 10, 15, 25, 15, 10, 5])[0]
    places = list(paths(n))
    rng.shuffle(places)
    for at, x in places:
        if kind == "feature" and isinstance(x, Feature):
            return replaced(n, at, Feature(rng.choice(list(names))))
        if kind == "constant" and isinstance(x, Constant):
            return replaced(n, at, Constant(round(x.value + rng.gauss(0, 0.5), 3)))
        if kind == "operator" and isinstance(x, Op):
            return replaced(n, at, Op(rng.choice([o for o in (*SCALARS, *DATED) if arity(o) == len(x.args)]), x.args))
        if kind == "hoist" and at and isinstance(x, Op):
            return x
        if kind == "remove" and isinstance(x, Op) and len(x.args) == 1:
            return replaced(n, at, x.args[0])
        if kind == "insert":
            return replaced(n, at, Op(rng.choice([o for o in (*SCALARS, *DATED) if arity(o) == 1]), (x,)))
    at, _ = places[0]
    return replaced(n, at, random_tree(rng, names, 3))


def crossed(a: Node, b: Node, rng: random.Random) -> Node:
    """a with a subtree of b in place of one of its own."""
    at, _ = rng.choice(list(paths(a)))
    _, part = rng.choice(list(paths(b)))
    return replaced(a, at, part)


def crossed_at_root(a: Node, b: Node, rng: random.Random) -> Node:
    """Both whole trees under one operator of two arguments; where that is too deep or too large, a with a subtree of b."""
    made = Op(rng.choice([o for o in (*SCALARS, *DATED) if arity(o) == 2]), (a, b))
    return made if depth(made) <= MAX_DEPTH and size(made) <= MAX_NODES else crossed(a, b, rng)
