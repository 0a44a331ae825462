"""What each filter takes away, alone and behind others: every order of the filters from one table of ids each.

Each filter leaves a relation of the ids that fail it. All documents are sent through these relations one
after another, by a left-semi join (who fails) and a left-anti join (who passes), so that every prefix of
every order is a set of the cells that result: its survivors are the cell of those that passed all its
filters, the removals of a step the cells that passed the earlier filters and fail this one, and the
redundant ones those that fail this one and any earlier. Good and toxic labels are two more relations of
ids. Prefixes share cells, so ``2 * (filters + labels)`` joins serve all orders; beyond them there are only
counts per part and cell.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import WORD, discard, settle, whole_text

#: A text with more than one in so many of all rows is joined by its own: there are at most so many of them.
HOT_SHARE = 1000

#: Filters that look at a text alone, as conditions on ``_t`` (the text) and ``_w`` (its words).
TEXT_FILTERS: dict[str, str] = {
    "A": "size(_w) < 100",
    "B": "100L * size(array_distinct(_w)) < 80L * size(_w)",
    "C": "100L * length(regexp_replace(_t, '[^A-Z]', '')) > 10L * length(_t)",
    "D": "_t rlike '[#$%&*|]'",
}
#: The filter of texts that a smaller id has as well.
COPY_FILTER = "E"


def failing(docs: DataFrame, text_filters: Mapping[str, str] = TEXT_FILTERS, copies: str | None = COPY_FILTER):
    """(rows, relations): ``rows`` has id, digest, part and one row per document; for each filter there is a
    relation of the (id, digest) that fail it. All are settled."""
    seen = docs.select(
        F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("part"), whole_text("text").alias("_t")
    )
    seen = seen.withColumn("_w", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))
    fails = [F.coalesce(F.expr(sql), F.lit(False)).alias(f"fails_{name}") for name, sql in text_filters.items()]
    rows = settle(seen.select("id", "part", F.unhex(F.sha2(F.encode("_t", "UTF-8"), 256)).alias("digest"), *fails), "audit-rows")
    tables = {
        name: settle(rows.where(f"fails_{name}").select("id", "digest").distinct(), f"audit-{name}") for name in text_filters
    }
    if copies:
        tables[copies] = settle(_later_copies(rows.select("id", "digest")), f"audit-{copies}")
    return rows.select("id", "digest", "part"), tables


def _later_copies(rows: DataFrame) -> DataFrame:
    """(id, digest) of the rows whose text a smaller id has. Copies are counted before they move; the few
    texts that many rows share are looked up where the rows are, the others are joined by digest."""
    groups = settle(
        rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
        .where("last > first"),
        "audit-copies",
    )
    total = rows.count()
    hot = F.broadcast(groups.where(F.col("n") * HOT_SHARE > total).select("digest", "first"))  # fewer than HOT_SHARE rows
    rest = groups.where(F.col("n") * HOT_SHARE <= total).select("digest", "first")
    later = F.col("id") > F.col("first")
    found = rows.join(hot, "digest").where(later).unionByName(
        rows.join(hot, "digest", "left_anti").join(rest, "digest").where(later)
    )
    return found.select("id", "digest").distinct()


def cells(rows: DataFrame, relations: Mapping[str, DataFrame]) -> DataFrame:
    """``rows`` with an array ``cell`` of the relations that hold them, by semi and anti joins in turn."""
    now = rows.withColumn("cell", F.array().cast("array<string>"))
    for k, (name, ids) in enumerate(relations.items()):
        held = [c for c in ("id", "digest") if c in ids.columns]
        mine = ids.select(*[F.col(c).alias(f"_{c}") for c in held])
        same = F.lit(True)
        for c in held:
            same = same & now[c].eqNullSafe(mine[f"_{c}"])
        inside = now.join(mine, same, "left_semi").withColumn("cell", F.array_append("cell", F.lit(name)))
        before, now = now, settle(inside.unionByName(now.join(mine, same, "left_anti")), f"audit-cells-{name}")
        if k:
            discard(before)
    return now


def audit(
    docs: DataFrame,
    labels: DataFrame,
    text_filters: Mapping[str, str] = TEXT_FILTERS,
    copies: str | None = COPY_FILTER,
) -> DataFrame:
    """Per part (``lang``; null is the empty string), order of the filters and step: kept, removed,
    redundant, unique_fails, good_lost, toxic_lost and shapley, in rows of ``docs``.

    Null texts are empty; an empty text fails only what the conditions say of no words. Of copies all but
    those with the smallest id fail the copy filter; a null id is no smaller one and never fails it. Rows
    that repeat count each. Labels are looked up by id (null ids have none); of several labels of an id any
    that says good or toxic counts. Parts without a failure have rows of zeros; an empty table has no rows.
    Other columns are not looked at.
    """
    rows, tables = failing(docs, text_filters, copies)
    for name, column in (("good", "quality"), ("toxic", "toxic")):
        marked = labels.where(F.col(column) == 1).select(F.col("doc_id").alias("id")).where("id is not null").distinct()
        tables[name] = marked
    sorted_rows = cells(rows, tables)
    counts = settle(sorted_rows.groupBy("part", "cell").agg(F.count("*").alias("n")), "audit-counts")
    for done in (sorted_rows, rows, *[tables[f] for f in (*text_filters, *([copies] if copies else []))]):
        discard(done)
    return steps(counts, [*text_filters, *([copies] if copies else [])])


def steps(counts: DataFrame, filters: Sequence[str]) -> DataFrame:
    """The audit of every order from (part, cell, n); there are at most 2^(filters + 2) cells a part."""
    orders = ["".join(o) for o in permutations(filters)] if all(len(f) == 1 for f in filters) else None
    if orders is None:
        raise ValueError("filters are named by one letter each")
    listed = F.array(*[F.lit(o) for o in orders])
    step = F.explode(F.sequence(F.lit(1), F.lit(len(filters))))
    wide = counts.withColumn("filter_order", F.explode(listed)).withColumn("step", step)
    wide = wide.withColumn("filter", F.expr("substring(filter_order, step, 1)"))
    earlier = F.expr("split(substring(filter_order, 1, step - 1), '')")
    fails = F.array_contains("cell", F.col("filter"))
    gone = F.arrays_overlap("cell", earlier)
    only = F.size(F.array_intersect("cell", F.array(*[F.lit(f) for f in filters]))) == 1
    here = ~gone & fails
    sums = {
        "kept": ~gone & ~fails,
        "removed": here,
        "redundant": gone & fails,
        "unique_fails": fails & only,
        "good_lost": here & F.array_contains("cell", "good"),
        "toxic_lost": here & F.array_contains("cell", "toxic"),
    }
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    out = wide.groupBy("part", "filter_order", "step", "filter").agg(*[total(c).alias(n) for n, c in sums.items()])
    taken = out.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return out.join(taken, ["part", "filter"]).select("part", "filter_order", "step", *sums, "shapley")
