"""Mixing sources to target weights by hierarchical budgets, in DataFrame functions alone.

The columns ``levels`` (say domain, language, source) make a tree. A leaf can
give its tokens ``epochs`` times. The budget flows down from the root: at each
node it is split by the children's weights, but no child gets more than its
subtree can give, and what it can't take goes to its siblings by weight. As a
node's own budget is limited by its subtree before, a shortage is made up by
siblings first, then by the siblings of the parent, and so on.

Splits are exact integers: with the saturated children taken out, each other
child gets ``floor(weight * rest / weights)``, and the tokens left over go one each
to the first children by name.

A leaf with ``supply`` tokens and budget ``t`` gives ``t div supply`` whole epochs, and
from the next epoch a prefix of ``t mod supply`` tokens. An epoch's order is the
md5 of seed, epoch and id. The prefix is found in two steps, so a leaf that
holds a third of all rows isn't sorted in one task: tokens per leaf and order
bucket first, then row by row in the one bucket where the prefix ends.

Null levels are branches of their own. Texts without tokens give nothing. Rows
that repeat a ``doc_id`` are ordered by tokens and text. Weights of 0 and below
give nothing. Other columns pass through; input columns named as a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.components import written

#: Hex digits of the order that make a bucket.
DIGITS = 3
BIG = "decimal(38,0)"


def _same(a: str, b: str, names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return out


def fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``children(parent..., name, weight, cap, pot)`` with ``budget``: the pot (the parent's
    budget) split by weight, no child over its cap. Rows are tree nodes, few per parent."""
    cap, weight, pot = (F.col(c).cast(BIG) for c in ("cap", "weight", "pot"))
    ratio = F.col("cap") / F.col("weight")
    order = Window.partitionBy(*parent).orderBy(ratio, F.col(name).asc_nulls_first())
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    family = Window.partitionBy(*parent)
    by_name = Window.partitionBy(*parent, "full").orderBy(F.col(name).asc_nulls_first())
    zero = F.lit(0).cast(BIG)
    step = (children
            .withColumn("before", F.coalesce(F.sum(cap).over(past), zero).cast(BIG))
            .withColumn("weights", F.sum(weight).over(rest).cast(BIG))
            .withColumn("full", cap * F.col("weights") <= weight * (pot - F.col("before")))
            .withColumn("left", (pot - F.sum(F.when(F.col("full"), cap).otherwise(zero)).over(family)).cast(BIG))
            .withColumn("open", F.sum(F.when(F.col("full"), zero).otherwise(weight)).over(family).cast(BIG))
            .withColumn("part", F.when(F.col("full"), cap).otherwise(
                F.floor(weight * F.col("left") / F.when(F.col("open") > 0, F.col("open")))).cast("long")))
    # Division of decimals may round up at its last digit: mend it exactly.
    step = step.withColumn("part", F.when(F.col("full"), F.col("part")).when(
        F.col("part").cast(BIG) * F.col("open") > weight * F.col("left"), F.col("part") - 1).otherwise(F.col("part")))
    step = step.withColumn("spare", F.col("left") - F.sum(F.when(F.col("full"), zero).otherwise(F.col("part").cast(BIG))).over(family))
    extra = (~F.col("full")) & (F.row_number().over(by_name) <= F.col("spare"))
    return step.select(*parent, name, "cap", (F.col("part") + extra.cast("long")).alias("budget"))


def budgets(docs: DataFrame, levels: list[str], weights: list[Column], budget: Column, epochs: int) -> DataFrame:
    """(levels..., supply, cap, budget) of every leaf; ``budget`` may use ``total``, the corpus's tokens."""
    marks = [f"_w{i}" for i in range(len(levels))]
    leaves = written(docs.where("n_tokens > 0").withColumns(dict(zip(marks, weights)))
                     .groupBy(*levels, *marks).agg(F.sum("n_tokens").alias("supply"))
                     .where(" AND ".join(f"{m} > 0" for m in marks)))
    cap = F.sum(F.col("supply") * epochs)
    pots = leaves.agg(F.sum("supply").alias("total"), cap.alias("cap")).where("total IS NOT NULL").select(
        F.lit(0).alias("_root"), F.least(budget.cast("long"), F.col("cap")).alias("budget"))
    have: list[str] = ["_root"]
    for i, level in enumerate(levels):
        path = [*have, level]
        nodes = (leaves.withColumn("_root", F.lit(0)).groupBy(*path, F.col(marks[i]).alias("weight")).agg(cap.alias("cap")))
        joined = nodes.alias("n").join(pots.alias("p"), _same("n", "p", have)).select(
            *[f"n.{c}" for c in path], "weight", "n.cap", F.col("p.budget").alias("pot"))
        pots = fill(joined, have, level)
        have = path
    return (leaves.alias("l").join(pots.alias("p"), _same("l", "p", levels))
            .select(*[f"l.{c}" for c in levels], "supply", "budget"))


def mix(docs: DataFrame, levels: list[str], weights: list[Column], budget: Column, epochs: int = 4,
        seed: int = 0) -> DataFrame:
    """``docs`` with ``n_epochs`` (whole epochs), ``n_prefix`` (tokens of the cut epoch) and ``n_taken``.

    ``docs`` holds ``doc_id``, ``text``, ``n_tokens`` (not null, 0 or more) and the levels;
    ``weights`` gives each level's weight as an integer column, a function of the levels.
    """
    leaves = written(budgets(docs, levels, weights, budget, epochs)
                     .withColumn("_epochs", F.expr("budget div supply")).withColumn("_rest", F.expr("budget % supply"))
                     .select(*levels, "_epochs", "_rest"))
    columns = [F.col(f"d.`{c}`") for c in docs.columns if c not in ("n_epochs", "n_prefix", "n_taken")]
    placed = docs.alias("d").join(leaves.alias("l"), _same("d", "l", levels), "left").select(
        *columns, "l._epochs", "l._rest",
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("l._epochs").cast("string"), F.col("d.doc_id").cast("string"))).alias("_order"))
    placed = placed.withColumn("_bucket", F.substring("_order", 1, DIGITS))
    held = placed.where("_rest > 0").groupBy(*levels, "_rest", "_bucket").agg(F.sum("n_tokens").alias("tokens"))
    run = Window.partitionBy(*levels).orderBy("_bucket")
    edge = (held.withColumn("through", F.sum("tokens").over(run)).where("through >= _rest")
            .groupBy(*levels).agg(F.min(F.struct("_bucket", (F.col("through") - F.col("tokens")).alias("base"))).alias("e"))
            .select(*levels, F.col("e._bucket").alias("_last"), F.col("e.base").alias("_base")))
    edge = written(edge)
    known = placed.alias("d").join(edge.alias("e"), _same("d", "e", levels), "left").select("d.*", "e._last", "e._base")
    inside = F.coalesce(F.col("_bucket") == F.col("_last"), F.lit(False))
    whole = known.where(~inside).withColumn("n_prefix", F.when(F.col("_bucket") < F.col("_last"), F.col("n_tokens")).otherwise(0).cast("long"))
    within = Window.partitionBy(*levels).orderBy("_order", "n_tokens", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, -1)
    cut = known.where(inside).withColumn("n_prefix", F.least(F.col("n_tokens"), F.greatest(F.lit(0), (
        F.col("_rest") - F.col("_base") - F.coalesce(F.sum("n_tokens").over(within), F.lit(0))))).cast("long"))
    both = whole.unionByName(cut)
    passes = F.when(F.col("n_tokens") > 0, F.coalesce("_epochs", F.lit(0))).otherwise(0).cast("long")
    return both.withColumn("n_epochs", passes).withColumn(
        "n_taken", F.col("n_epochs") * F.col("n_tokens") + F.col("n_prefix")).drop("_epochs", "_rest", "_order", "_bucket", "_last", "_base")


def token_count(text: str = "text") -> Column:
    """Words of a text (runs outside the six ASCII spaces); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
