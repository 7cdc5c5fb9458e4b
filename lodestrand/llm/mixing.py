"""Mixing sources to target weights by hierarchical budgeting.

The leaves of a tree domain - language - source get token budgets: a node's budget is divided among its children by
weight. A child can give no more than its tokens times max_epochs; what it falls short of goes to its siblings by
weight, and only what no sibling can take goes up, to the siblings of the parent. Each leaf then takes the prefix of
its seeded epochs, in each of which its documents come once in an order of their own, up to its budget of tokens.

The prefix is found without sorting a leaf as a whole: tokens are first summed by leaf and slice of the order (its
first hex digits), and only the slice where the budget ends is sorted. A leaf of any size spreads over all tasks.

Defined results: a document that would exceed the budget ends the prefix, so a leaf never has more than its budget, and
less by under one doc_id (of any type): rows of one doc_id are taken or left together in an epoch. Null lang, source and domain are leaves of their own, named ''. Documents without tokens
(null, empty or blank) are never chosen. Weights not given are 1; weights below 0 count as 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import BROADCAST_BYTES, drop_written, written
from .packing import count_tokens

Path = tuple[str, ...]
_P = "__lodestrand_"
#: Name of the column with the epoch; names with this prefix are reserved.
EPOCH = _P + "epoch"
#: Bytes of a row about a leaf.
_ROW_BYTES = 400


@dataclass(frozen=True)
class Params:
    #: Weight of a node among its siblings, by path: ('d0',), ('d0', 'en'), ('d0', 'en', 'src3'). 1 where none is given.
    weights: dict[Path, float] = field(default_factory=dict)
    #: Budget of the root, as a share of all tokens.
    share: float = 1.0
    max_epochs: int = 4
    seed: int = 17
    slices_hex: int = 3


def domain(source: Column) -> Column:
    """The domain of the sources src<N>: N modulo 4. Others have domain ''."""
    return F.coalesce(F.concat(F.lit("d"), (F.regexp_extract(source, r"^src(\d{1,9})$", 1).try_cast("long") % 4).cast("string")), F.lit(""))


#: Weights of the production run: domains count unequally, languages other than English are raised.
WEIGHTS: dict[Path, float] = {("d0",): 4.0, ("d1",): 3.0, ("d2",): 2.0, ("d3",): 1.0} | {(d, x): w for d in ("d0", "d1", "d2", "d3") for x, w in (("en", 3.0), ("de", 2.0), ("fr", 2.0), ("es", 2.0))}


def fill(want: float, children: list[tuple[float, int]]) -> list[float]:
    """Divides want by weight among children (weight, capacity): none gets more than its capacity, shortages go to the others."""
    got = [0.0] * len(children)
    open_ = [i for i, (w, c) in enumerate(children) if w > 0 and c > 0]
    left = min(want, float(sum(children[i][1] for i in open_)))
    while open_ and left > 1e-9:
        total = sum(children[i][0] for i in open_)
        over = [i for i in open_ if left * children[i][0] / total >= children[i][1]]
        if not over:
            for i in open_:
                got[i] = left * children[i][0] / total
            break
        for i in over:
            got[i] = float(children[i][1])
        left -= sum(children[i][1] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return got


def budgets(tokens: dict[Path, int], p: Params) -> dict[Path, int]:
    """Budget of each leaf. Capacities go up the tree first, so a shortage is made good as near to it as can be."""
    cap: dict[Path, int] = {}
    for leaf, n in tokens.items():
        for k in range(len(leaf) + 1):
            cap[leaf[:k]] = cap.get(leaf[:k], 0)
    for leaf, n in tokens.items():
        live = all(p.weights.get(leaf[:k], 1.0) > 0 for k in range(1, len(leaf) + 1))
        for k in range(len(leaf) + 1):
            cap[leaf[:k]] += n * p.max_epochs * live
    kids: dict[Path, list[Path]] = {}
    for node in sorted(cap):
        if node:
            kids.setdefault(node[:-1], []).append(node)
    out: dict[Path, int] = {}

    def down(node: Path, want: float) -> None:
        if node not in kids:
            out[node] = int(want + 1e-6)
            return
        for child, b in zip(kids[node], fill(want, [(max(0.0, p.weights.get(c, 1.0)), cap[c]) for c in kids[node]])):
            down(child, b)

    if cap:
        down((), p.share * sum(tokens.values()))
    return out


def order_key(epoch: Column, doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def mix(docs: DataFrame, p: Params = Params(weights=WEIGHTS), leaf: tuple[Column, ...] | None = None, tokens: Column | None = None) -> DataFrame:
    """The chosen rows of docs with all their columns, and the epoch (from 0) each is chosen for, as the last column EPOCH.

    Two passes: tokens by document, from which the budgets and the end of each leaf's prefix follow; then a pass that
    picks the rows as it reads them, without a shuffle.
    """
    names = [_P + x for x in ("domain", "lang", "source")]
    n, ident, key, cum, head, whole, rest, cut, room, bound = (_P + x for x in ("tokens", "id", "key", "cum", "head", "whole", "rest", "cut", "room", "bound"))
    cols = [F.coalesce(c.cast("string"), F.lit("")).alias(x) for c, x in zip(leaf or (domain(F.col("source")), F.col("lang"), F.col("source")), names)]
    sizes = written(docs.select(*cols, (count_tokens(F.col("text")) if tokens is None else tokens).cast("long").alias(n), F.col("doc_id").alias(ident)).where(F.col(n) > 0))
    # one row for each leaf of the tree goes to the driver, which divides the budgets
    totals = {tuple(r[x] for x in names): r["t"] for r in sizes.groupBy(names).agg(F.sum(n).alias("t")).collect()}
    budget = {k: b for k, b in budgets(totals, p).items() if b > 0}
    if not budget:
        drop_written(sizes)
        return docs.limit(0).withColumn(EPOCH, F.lit(0))

    def plan(rows: list[tuple], more: str) -> DataFrame:
        got = docs.sparkSession.createDataFrame(rows, ", ".join(f"{x} string" for x in names) + ", " + more)
        return F.broadcast(got) if len(rows) * _ROW_BYTES <= BROADCAST_BYTES else got

    shape = {k: (b // totals[k], b % totals[k]) for k, b in sorted(budget.items())}
    part = sizes.join(plan([(*k, *x) for k, x in shape.items() if x[1]], f"{whole} long, {rest} long"), names).withColumn(key, order_key(F.col(whole), F.col(ident), p.seed)).withColumn(head, F.substring(key, 1, p.slices_hex))
    by = part.groupBy(*names, rest, head).agg(F.sum(n).alias("t")).withColumn(cum, F.sum("t").over(Window.partitionBy(names).orderBy(head)))
    cuts = [(*[r[x] for x in names], r[head], r[rest] - r[cum] + r["t"]) for r in by.where((F.col(cum) > F.col(rest)) & (F.col(cum) - F.col("t") <= F.col(rest))).collect()]
    ends: dict[Path, str | None] = {}
    if cuts:
        edge = part.join(plan(cuts, f"{cut} string, {room} long"), names).where(F.col(head) == F.col(cut)).withColumn(cum, F.sum(n).over(Window.partitionBy(names).orderBy(key)))
        ends = {tuple(r[x] for x in names): r["k"] for r in edge.where(F.col(cum) <= F.col(room)).groupBy(names).agg(F.max(key).alias("k")).collect()}
    first = {r[:3]: r[3] for r in cuts}
    rows = [(*k, w, first.get(k) or "", ends.get(k) or first.get(k) or "") for k, (w, _) in shape.items()]
    drop_written(sizes)
    has = F.col("text").rlike(r"\S") if tokens is None else tokens > 0
    at = docs.select("*", *[c.alias(x) for c, x in zip(cols, names)]).where(has).join(plan(rows, f"{whole} long, {cut} string, {bound} string"), names)
    k = order_key(F.col(whole), F.col("doc_id"), p.seed)
    # before the cut, or in its slice up to the bound; without a cut nothing of a further epoch
    times = F.col(whole) + F.when((F.col(cut) != "") & (k <= F.col(bound)), 1).otherwise(0)
    return at.where(times > 0).select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(0), (times - 1).cast("int"))).alias(EPOCH))


def mixed_ids(docs: DataFrame, p: Params = Params(weights=WEIGHTS)) -> DataFrame:
    """(doc_id, epoch) of every chosen row."""
    slim = docs.select("doc_id", "lang", "source", "text")
    return mix(slim, p).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(EPOCH).alias("epoch"))
