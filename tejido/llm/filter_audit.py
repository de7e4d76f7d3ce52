"""How filters interact: what each removes, under every order in which they can be applied, by decision diagrams.

A document's failure mask has a bit for each filter that it fails. Spark reduces all documents to counts of masks in each
part (all documents, labelled good, labelled toxic); of k filters there are at most 2^k masks, however many documents. From
there each part has a diagram: a level for each filter in the order of applying, a node's two branches lead to the masks that
pass and that fail it, and leaves hold counts, so that a node's weight is what lies below it. Branches without documents are
left out (a level that nothing fails has no node), equal nodes are one. All orders are visited by swaps of adjacent levels,
each of which relabels the nodes of two levels in place; then the path on which all filters pass gives the order's steps: the
failing branch of a node on it is what the step removes, the weight of the passing one what it keeps.

A filter's failures are what it removes as the first, its unique failures what it removes as the last; its Shapley sum is
what it removes over all orders.

Null text: as the empty text. Null source: the part "" (as an empty source). A text is a repeat if a row with a smaller doc_id
has the same (equal by SHA-256); rows of one id aren't repeats of each other, and a row without an id is neither a repeat
nor makes one. A document with several labels is good (toxic) if any says so. Repeated rows count each. An empty table gives no rows. Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
#: Orders grow with the factorial; eight filters have 40,320.
MOST = 8
Weight = tuple[int, int, int]
NOTHING: Weight = (0, 0, 0)


class Diagram:
    """A zero-suppressed decision diagram of failure masks whose leaves are weights (documents, good, toxic)."""

    def __init__(self, masks: dict[int, Weight], k: int) -> None:
        self.order = list(range(k))
        self.nodes: dict[int, tuple[int, int, int]] = {}  # (filter, passing, failing)
        self.unique: dict[tuple[int, int, int], int] = {}
        self.weights: list[Weight] = [NOTHING]
        self.leaves = {NOTHING: 0}
        self.root = self._built(0, masks)

    def _built(self, level: int, masks: dict[int, Weight]) -> int:
        if not masks:
            return 0
        if level == len(self.order):
            (weight,) = masks.values()
            if weight not in self.leaves:
                self.leaves[weight] = self._named(weight)
            return self.leaves[weight]
        bit = 1 << self.order[level]
        passing, failing = ({m: w for m, w in masks.items() if bool(m & bit) == side} for side in (False, True))
        return self._node(self.order[level], self._built(level + 1, passing), self._built(level + 1, failing))

    def _named(self, weight: Weight) -> int:
        self.weights.append(weight)
        return len(self.weights) - 1

    def _node(self, name: int, passing: int, failing: int) -> int:
        if not failing:
            return passing
        key = (name, passing, failing)
        if key not in self.unique:
            a, b = self.weights[passing], self.weights[failing]
            self.unique[key] = self._named((a[0] + b[0], a[1] + b[1], a[2] + b[2]))
            self.nodes[self.unique[key]] = key
        return self.unique[key]

    def _branches(self, node: int, name: int) -> tuple[int, int]:
        found = self.nodes.get(node)
        return (found[1], found[2]) if found and found[0] == name else (node, 0)

    def swap(self, level: int) -> None:
        """Exchanges a level with the next. Nodes above and below stay; a node of the upper one keeps its number and meaning."""
        upper, lower = self.order[level : level + 2]
        for node, key in list(self.nodes.items()):
            if key[0] != upper:
                continue
            (pp, pf), (fp, ff) = self._branches(key[1], lower), self._branches(key[2], lower)
            if not (pf or ff):
                continue
            del self.unique[key]
            new = (lower, self._node(upper, pp, fp), self._node(upper, pf, ff))
            self.nodes[node] = self.unique[new] = new
            self.unique[new] = node
        self.order[level : level + 2] = lower, upper
        self._sweep()

    def _sweep(self) -> None:
        live, todo = set(), [self.root]
        while todo:
            node = todo.pop()
            if node in self.nodes and node not in live:
                live.add(node)
                todo += self.nodes[node][1:]
        for node in self.nodes.keys() - live:
            del self.unique[self.nodes.pop(node)]

    def steps(self) -> list[tuple[int, int, Weight]]:
        """(filter, kept, removed weight) of each step of the present order, along the path on which all pass."""
        out, node = [], self.root
        for name in self.order:
            node, failing = self._branches(node, name)
            out.append((name, self.weights[node][0], self.weights[failing]))
        return out


def swaps(k: int) -> Iterator[int]:
    """Levels to swap with the next, one after the other, so that all orders of k are met (the first without a swap)."""
    if k < 2:
        return
    inner, down = swaps(k - 1), True
    while True:
        yield from range(k - 2, -1, -1) if down else range(k - 1)
        found = next(inner, None)
        if found is None:
            return
        yield found + down  # the last filter stands first or last now
        down = not down


def orders(masks: dict[int, Weight], names: str) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique failures, good lost, toxic lost, Shapley sum) for all orders."""
    k = len(names)
    diagram = Diagram(masks, k)
    found = [diagram.steps()]
    for level in swaps(k):
        diagram.swap(level)
        found.append(diagram.steps())
    fails = {steps[0][0]: steps[0][2][0] for steps in found}
    alone = {steps[-1][0]: steps[-1][2][0] for steps in found}
    shapley = dict.fromkeys(range(k), 0)
    for steps in found:
        for name, _, removed in steps:
            shapley[name] += removed[0]
    return [
        ("".join(names[s[0]] for s in steps), at, kept, removed[0], fails[name] - removed[0], alone[name], removed[1], removed[2], shapley[name])
        for steps in found
        for at, (name, kept, removed) in enumerate(steps, 1)
    ]


def audit(masks: DataFrame, names: str) -> DataFrame:
    """SCHEMA from masks (part, mask, n, good, toxic), one row for each part and mask; names: a letter for each bit."""
    if not 1 <= len(names) <= MOST:
        raise ValueError(f"between 1 and {MOST} filters have their orders listed")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = orders({int(r.mask): (int(r.n), int(r.good), int(r.toxic)) for r in rows.itertuples()}, names)
        out = pd.DataFrame(found, columns=["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])
        out.insert(0, "part", rows["part"].iloc[0])
        return out

    return masks.groupBy("part").applyInPandas(run, SCHEMA)


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """The filters on a text alone: few words, few different words, many capitals, special signs."""
    n = F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {"A": n < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * n, "C": 100 * capitals > 2 * F.length(text), "D": text.rlike("[#$%&*|]")}


def failure_masks(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, str]:
    """(part, mask, n, good, toxic) and the filters' letters: those of text_failures, and last the repeated text.

    Rows shrink to ids and digests before the first shuffle. Equal rows are counted together before they meet their labels,
    and copies before their smallest id is sought, so that a group of copies comes as a row for each part, label and task.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    worded = text.withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    tests = text_failures(F.col("text"), F.col("words"))
    own = sum((c.cast("int") * (1 << i) for i, c in enumerate(tests.values())), F.lit(0))
    rows = worded.select("doc_id", "part", own.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")).groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))

    said = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    rated = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(said("quality"), said("toxic")).where("quality or toxic")
    # Written, so that both sides of the join come straight from their shuffles and Spark can split an id that many rows share.
    labelled = rows.join(written(rated, "audit-labels"), "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("quality", "toxic")})

    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    loose = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    kinds = labelled.groupBy("digest", "part", "mask", "quality", "toxic").agg(F.sum("n").alias("n"), first.alias("first"), loose.alias("loose"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    fresh = kinds.withColumn("fresh", F.col("loose") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0))
    names = "".join(tests) + "E"
    both = F.explode(F.array(F.struct("mask", F.col("fresh").alias("n")), F.struct((F.col("mask") + (1 << len(tests))).alias("mask"), (F.col("n") - F.col("fresh")).alias("n"))))
    split = fresh.select("part", "quality", "toxic", both.alias("kind")).select("part", "quality", "toxic", "kind.*").where("n > 0")
    of = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("quality").alias("good"), of("toxic").alias("toxic")), names
