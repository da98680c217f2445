"""Stored classifiers as plain values, and their scores as column expressions.

A linear model is a dot product and a sigmoid (softmax for more than two classes), a tree is one nested CASE that ends in a
leaf number, a forest is the mean of its trees' class shares.  As expressions they run inside whole-stage code generation,
without vectors and without a Python worker; :func:`to_sql` writes the same model as SQL text.  :func:`portable` reads a
fitted Spark ML model; its expressions give what ``transform`` gives.

A model of more than ``MOST_NODES`` tree nodes is not compiled (one expression of that size would outgrow the code
generator): callers then use ``transform``, which gives the same results.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_NODES = 2000


@dataclass(frozen=True)
class Linear:
    """Coefficients and intercepts: one row for two classes, one row a class for more."""

    coefficients: tuple[tuple[float, ...], ...]
    intercepts: tuple[float, ...]
    threshold: float = 0.5

    @property
    def n_classes(self) -> int:
        return max(2, len(self.intercepts))

    @property
    def nodes(self) -> int:
        return 0


@dataclass(frozen=True)
class Tree:
    """Nodes in preorder: (feature, threshold, right child) of a split, whose left child follows it; class weights of a leaf.

    A value no larger than the threshold goes to the left."""

    splits: tuple[tuple[int, float, int] | None, ...]
    leaves: tuple[tuple[float, ...] | None, ...]

    @property
    def n_classes(self) -> int:
        return len(next(x for x in self.leaves if x is not None))

    @property
    def nodes(self) -> int:
        return len(self.splits)


@dataclass(frozen=True)
class Forest:
    trees: tuple[Tree, ...]

    @property
    def n_classes(self) -> int:
        return self.trees[0].n_classes

    @property
    def nodes(self) -> int:
        return sum(t.nodes for t in self.trees)


Model = Linear | Tree | Forest


def leaf(*weights: float) -> tuple:
    return tuple(float(w) for w in weights)


def split(feature: int, threshold: float, left, right) -> tuple:
    """A split of a nested description; see :func:`tree`."""
    return (feature, float(threshold), left, right)


def tree(root) -> Tree:
    """A tree from nested :func:`split` and :func:`leaf` descriptions."""
    splits: list = []
    leaves: list = []
    # without recursion: trees may be deeper than Python's stack
    todo: list = [(root, None)]
    while todo:
        node, parent = todo.pop()
        if parent is not None:
            f, t, _ = splits[parent]
            splits[parent] = (f, t, len(splits))
        if len(node) == 4 and isinstance(node[2], tuple):
            splits.append((node[0], node[1], -1))
            leaves.append(None)
            todo += [(node[3], len(splits) - 1), (node[2], None)]
        else:
            splits.append(None)
            leaves.append(node)
    return Tree(tuple(splits), tuple(leaves))


# --- from fitted models -------------------------------------------------------------------


def _fitted_tree(root) -> Tree:
    splits: list = []
    leaves: list = []
    todo: list = [(root, None)]
    while todo:
        node, parent = todo.pop()
        if parent is not None:
            f, t, _ = splits[parent]
            splits[parent] = (f, t, len(splits))
        if node.getClass().getSimpleName() == "InternalNode":
            rule = node.split()
            if rule.getClass().getSimpleName() != "ContinuousSplit":
                raise ValueError("splits on category sets are not supported")
            splits.append((rule.featureIndex(), rule.threshold(), -1))
            leaves.append(None)
            todo += [(node.rightChild(), len(splits) - 1), (node.leftChild(), None)]
        else:
            splits.append(None)
            leaves.append(tuple(node.impurityStats().stats()))
    return Tree(tuple(splits), tuple(leaves))


def portable(model, most_nodes: int = MOST_NODES) -> Model | None:
    """A fitted logistic, tree or forest model as plain values; None if it is of another kind or has too many nodes."""
    if isinstance(model, Linear | Tree | Forest):
        return model
    kind = type(model).__name__
    if kind == "LogisticRegressionModel":
        rows = model.coefficientMatrix.toArray().tolist()
        return Linear(tuple(map(tuple, rows)), tuple(model.interceptVector.toArray().tolist()), float(model.getThreshold() if len(rows) == 1 else 0.5))
    if kind == "DecisionTreeClassificationModel" and model.numNodes <= most_nodes:
        return _fitted_tree(model._java_obj.rootNode())
    if kind == "RandomForestClassificationModel" and model.totalNumNodes <= most_nodes:
        return Forest(tuple(_fitted_tree(t._java_obj.rootNode()) for t in model.trees))
    return None


def to_dict(model: Model) -> dict:
    return {"kind": type(model).__name__, **asdict(model)}


def from_dict(d: dict) -> Model:
    frozen = lambda x: tuple(frozen(y) for y in x) if isinstance(x, list | tuple) else x
    d = dict(d)
    kind = d.pop("kind")
    if kind == "Linear":
        return Linear(frozen(d["coefficients"]), frozen(d["intercepts"]), d["threshold"])
    if kind == "Tree":
        return Tree(frozen(d["splits"]), frozen(d["leaves"]))
    return Forest(tuple(from_dict({"kind": "Tree", **t}) for t in d["trees"]))


# --- expressions ----------------------------------------------------------------------------


class _Columns:
    """Builds Spark columns."""

    number = staticmethod(lambda x: F.lit(float(x)))
    add = staticmethod(lambda x, y: x + y)
    times = staticmethod(lambda x, y: x * y)
    over = staticmethod(lambda x, y: x / y)
    exp = staticmethod(F.exp)
    greatest = staticmethod(lambda xs: F.greatest(*xs) if len(xs) > 1 else xs[0])
    minus = staticmethod(lambda x, y: x - y)
    at_most = staticmethod(lambda x, y: x <= y)
    more = staticmethod(lambda x, y: x > y)
    choose = staticmethod(lambda cond, x, y: F.when(cond, x).otherwise(y))
    integer = staticmethod(lambda x: F.lit(int(x)))
    pick = staticmethod(lambda values, i: F.element_at(F.array(*[F.lit(float(v)) for v in values]), i))


def sql_number(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


class _Text:
    """Builds SQL text."""

    number = staticmethod(sql_number)
    add = staticmethod(lambda x, y: f"({x} + {y})")
    times = staticmethod(lambda x, y: f"({x} * {y})")
    over = staticmethod(lambda x, y: f"({x} / {y})")
    exp = staticmethod(lambda x: f"exp({x})")
    greatest = staticmethod(lambda xs: f"greatest({', '.join(xs)})" if len(xs) > 1 else xs[0])
    minus = staticmethod(lambda x, y: f"({x} - {y})")
    at_most = staticmethod(lambda x, y: f"{x} <= {y}")
    more = staticmethod(lambda x, y: f"{x} > {y}")
    choose = staticmethod(lambda cond, x, y: f"CASE WHEN {cond} THEN {x} ELSE {y} END")
    integer = staticmethod(str)
    pick = staticmethod(lambda values, i: f"([{', '.join(_Text.number(v) for v in values)}])[{i}]")


def _leaf_number(model: Tree, features: list, b):
    """The place (from 1) among the leaves of the leaf a row falls into: children are built before their parents."""
    built: list = [None] * len(model.splits)
    numbers = {i: k for k, i in enumerate((i for i, x in enumerate(model.leaves) if x is not None), 1)}
    for i in range(len(model.splits) - 1, -1, -1):
        if model.splits[i] is None:
            built[i] = b.integer(numbers[i])
        else:
            feature, threshold, right = model.splits[i]
            built[i] = b.choose(b.at_most(features[feature], b.number(threshold)), built[i + 1], built[right])
    return built[0]


def _shares(weights: tuple[float, ...]) -> list[float]:
    total = math.fsum(weights)
    return [w / total if total else 0.0 for w in weights]


def _build(model: Model, features: list, b) -> tuple[list, Callable]:
    """The class probabilities, and a function from their (named) values to the predicted class."""

    def largest(p):
        best = b.integer(0)
        # of equal ones the first: later classes must be larger than all before
        for k in range(1, model.n_classes):
            best = b.choose(b.more(p[k], b.greatest(p[:k])), b.integer(k), best)
        return best

    if isinstance(model, Linear):
        margins = []
        for row, intercept in zip(model.coefficients, model.intercepts):
            m = b.number(0.0)
            for w, x in zip(row, features):
                if w:
                    m = b.add(m, b.times(b.number(w), x))
            margins.append(b.add(m, b.number(intercept)))
        if len(margins) == 1:
            yes = b.over(b.number(1.0), b.add(b.number(1.0), b.exp(b.times(b.number(-1.0), margins[0]))))
            return [b.minus(b.number(1.0), yes), yes], lambda p: b.choose(b.more(p[1], b.number(model.threshold)), b.integer(1), b.integer(0))
        top = b.greatest(margins)
        powers = [b.exp(b.minus(m, top)) for m in margins]
        total = powers[0]
        for x in powers[1:]:
            total = b.add(total, x)
        return [b.over(x, total) for x in powers], largest
    trees = model.trees if isinstance(model, Forest) else (model,)
    sums: list = [None] * model.n_classes
    for t in trees:
        number = _leaf_number(t, features, b)
        shares = [_shares(w) for w in t.leaves if w is not None]
        for k in range(model.n_classes):
            p = b.pick([s[k] for s in shares], number)
            sums[k] = p if sums[k] is None else b.add(sums[k], p)
    return ([b.over(s, b.number(len(trees))) for s in sums] if len(trees) > 1 else sums), largest


def class_probabilities(model: Model, features: list[Column]) -> list[Column]:
    """P(class k) for each class, from the (scaled) feature columns in the model's order."""
    return _build(model, features, _Columns)[0]


def predicted_class(model: Model, probabilities: list[Column]) -> Column:
    """The class (INT) that the model's rule picks from the probabilities, which should be named columns."""
    return _build(model, [F.lit(0.0)] * _width(model), _Columns)[1](probabilities).cast("int")


def _width(model: Model) -> int:
    if isinstance(model, Linear):
        return len(model.coefficients[0])
    trees = model.trees if isinstance(model, Forest) else (model,)
    return 1 + max((s[0] for t in trees for s in t.splits if s is not None), default=0)


def to_sql(model: Model, features: list[str]) -> tuple[list[str], Callable[[list[str]], str]]:
    """SQL text of the class probabilities, and a function from their column names to the text of the predicted class."""
    return _build(model, features, _Text)
