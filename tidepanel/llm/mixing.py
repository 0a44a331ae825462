"""Mixing sources to target weights by hierarchical budgets.

Documents belong to the leaves of a tree (domain, language, source). A total of tokens is shared out from
the root by weights; a child that has less than its share takes all it has, and what it leaves goes to its
siblings first. Only when a whole branch runs short does its parent's level see the shortage, because a
branch's capacity is what its leaves can give. A leaf then takes documents in a seeded order of its own,
epoch after epoch, up to its budget.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import WORD, free_name, settle, whole_text

#: The seeded order of a leaf is cut into runs by the first three hex digits of the md5.
RUN_DIGITS = 3
OTHER = "other"


def tokens(text: str | Column = "text") -> Column:
    """Words of a text; null has none."""
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def _weight(level: str, weights: Mapping[str, Mapping[str, float]]) -> Column:
    """The weight of a node by its level and name; names not listed weigh 1."""
    given = weights.get(level, {})
    if not given:
        return F.lit(1.0)
    table = F.create_map(*[F.lit(x) for kv in given.items() for x in kv])
    return F.coalesce(F.element_at(table, F.col(level)), F.lit(1.0))


def budgets(
    leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, float]], target: float
) -> DataFrame:
    """``leaves`` (levels and capacity) with a column ``budget`` each.

    At each level, children are ordered by capacity per weight. A child is full while its capacity is below
    its share of what the children before it have left; the others split the rest by weight. All numbers
    are of nodes, never of documents. Nodes of weight 0 get nothing; a target above all capacity is cut to it.
    """
    nodes = {0: leaves.agg(F.sum("capacity").alias("capacity"))}
    for depth in range(1, len(levels) + 1):
        nodes[depth] = leaves.groupBy(*levels[:depth]).agg(F.sum("capacity").alias("capacity"))
    given = nodes[0].select(F.least(F.lit(float(target)), F.coalesce("capacity", F.lit(0))).alias("budget"))
    for depth in range(1, len(levels) + 1):
        parents, level = list(levels[: depth - 1]), levels[depth - 1]
        child = nodes[depth].withColumn("weight", _weight(level, weights).cast("double"))
        parent = given.withColumnRenamed("budget", "parent_budget")
        child = child.join(parent, parents) if parents else child.join(F.broadcast(parent))
        child = child.withColumn("ratio", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")))
        turn = Window.partitionBy(*parents).orderBy(F.col("ratio").asc_nulls_last(), level)
        earlier = turn.rowsBetween(Window.unboundedPreceding, -1)
        onward = turn.rowsBetween(0, Window.unboundedFollowing)
        child = child.withColumn("used", F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("capacity"))).over(earlier), F.lit(0)))
        child = child.withColumn("weights_left", F.sum("weight").over(onward))
        share = (F.col("parent_budget") - F.col("used")) / F.col("weights_left")
        child = child.withColumn("level_line", F.when(F.col("ratio") > share, share))
        # The line of the first child that is not full holds for all after it.
        line = F.first("level_line", ignorenulls=True).over(Window.partitionBy(*parents).orderBy(
            F.col("ratio").asc_nulls_last(), level).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        child = child.withColumn("line", line)
        budget = F.when(F.col("weight") <= 0, 0.0).when(
            F.col("line").isNull() | (F.col("ratio") <= F.col("line")), F.col("capacity").cast("double")
        ).otherwise(F.greatest(F.lit(0.0), F.col("line") * F.col("weight")))
        given = child.withColumn("budget", budget).select(*levels[:depth], "budget")
    return leaves.join(given, list(levels)).withColumn("budget", F.floor(F.col("budget") + F.lit(1e-6)).cast("long"))


def choose(
    docs: DataFrame,
    levels: Mapping[str, str],
    weights: Mapping[str, Mapping[str, float]],
    fraction: float,
    epochs: int = 1,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document taken: id_col, the levels, epoch, n_tokens, start (the tokens its leaf took before it).

    ``levels`` names the levels of the tree from the root, with SQL for a document's node at each. The
    target is ``fraction`` of all tokens. A leaf can give its tokens ``epochs`` times. In each epoch its
    order is that of md5("seed:epoch:id"), and it takes the longest prefix that does not pass its budget.
    Null names of a level count as "other", documents without a word cost nothing and are taken with the
    prefix they stand in. A null id stands as "null". Rows that repeat an id are documents of their own, in an
    order between them that does not matter, as they are told apart by their tokens only; an empty table
    gives an empty result. Other columns are not looked at.
    """
    names = list(levels)
    rows, leaves = _planned(docs, levels, weights, fraction, epochs, id_col, text_col)
    taken = _prefixes(rows, leaves, list(levels), epochs, seed)
    return taken.drop("order").withColumnRenamed("id", id_col)


def _node(sql: str) -> Column:
    return F.coalesce(F.expr(sql).cast("string"), F.lit(OTHER))


def _planned(docs, levels, weights, fraction, epochs, id_col, text_col) -> tuple[DataFrame, DataFrame]:
    """(id, levels, n_tokens) per document, and the leaves with their budgets, both settled."""
    names = list(levels)
    rows = docs.select(
        F.col(id_col).alias("id"), *[_node(e).alias(n) for n, e in levels.items()], tokens(text_col).alias("n_tokens")
    )
    rows = settle(rows, "mix-rows")
    leaves = rows.groupBy(*names).agg(F.sum("n_tokens").alias("supply"), F.count("*").alias("n_docs"))
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    leaves = leaves.withColumn("capacity", F.col("supply") * epochs)
    return rows, settle(budgets(leaves, names, weights, fraction * total), "mix-leaves")


def _order(seed: int, epoch: Column, row_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(row_id.cast("string"), F.lit("null"))))


def _prefixes(rows: DataFrame, leaves: DataFrame, names: list[str], epochs: int, seed: int) -> DataFrame:
    """Documents before each leaf's budget, without ordering a whole leaf in one task: tokens are added up
    by runs of the order first, and only within a run by document."""
    epoch = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))) if epochs > 1 else rows.withColumn("epoch", F.lit(0))
    keyed = epoch.withColumn("order", _order(seed, F.col("epoch"), F.col("id"))).withColumn("run", F.substring("order", 1, RUN_DIGITS))
    runs = keyed.groupBy(*names, "epoch", "run").agg(F.sum("n_tokens").alias("run_tokens"))
    upto = Window.partitionBy(*names).orderBy("epoch", "run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("run_tokens").over(upto), F.lit(0)))
    runs = settle(runs.join(leaves.select(*names, "budget"), names).where("before <= budget"), "mix-runs")
    near = keyed.join(runs, [*names, "epoch", "run"])
    within = Window.partitionBy(*names, "epoch", "run").orderBy("order", "n_tokens")
    start = F.col("before") + F.coalesce(F.sum("n_tokens").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = near.withColumn("start", start).where(F.col("start") + F.col("n_tokens") <= F.col("budget"))
    return taken.select("id", *names, "epoch", "n_tokens", "start", "order")


def mix(docs: DataFrame, levels: Mapping[str, str], weights: Mapping[str, Mapping[str, float]], fraction: float,
        seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`choose` takes in one epoch, with all their columns.

    What a leaf takes is a prefix of its order, so the last place taken of each leaf decides over a row where it
    is: only the table of leaves is sent to the rows, which are not moved by their ids.
    """
    rows, leaves = _planned(docs, levels, weights, fraction, 1, id_col, text_col)
    place = F.struct("order", "n_tokens")
    last = _prefixes(rows, leaves, list(levels), 1, seed).groupBy(*levels).agg(F.max(place).alias("last"))
    names = [free_name(docs, f"leaf_{n}") for n in levels]
    cut = free_name(docs, "last_taken")
    last = settle(last.select(*[F.col(n).alias(m) for n, m in zip(levels, names)], F.col("last").alias(cut)), "mix-last")
    at_leaf = [_node(e).eqNullSafe(last[m]) for e, m in zip(levels.values(), names)]
    order = F.struct(_order(seed, F.lit(0), F.col(id_col)).alias("order"), tokens(text_col).alias("n_tokens"))
    joined = docs.join(last, at_leaf).where(order <= F.col(cut))
    return joined.select(*[docs[c] for c in docs.columns])
