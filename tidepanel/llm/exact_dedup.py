"""Exact de-duplication by recipes of content-defined chunks.

A text, its white space runs turned into single spaces, is cut into chunks at places that its own
characters name. Chunks are de-duplicated to identifiers: the 64-bit hash of a chunk, once all texts
that share the hash have been compared and found the same; where two chunks differ under one hash,
their identifier is the chunk itself. A document is then the ordered list of its identifiers (its
recipe), and only recipes are compared: whole texts move at most once, a chunk per task and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import SPACE_RUN, by_mark, free_name, settle, whole_text

#: Shortest and longest chunk, in characters; between them a chunk ends after a word whose last two
#: characters fall into this class, about one word in fifteen of prose.
MIN_CHUNK, MAX_CHUNK = 512, 4096
BOUNDARY = r"(?<=[aeiou][dhnrs]) "


def normalise(text: str | Column = "text") -> Column:
    """Each run of white space as one space; null is empty."""
    return F.regexp_replace(whole_text(text), SPACE_RUN, " ")


def chunks(normalised: Column) -> Column:
    """The text cut into pieces which join to it again; no piece for the empty text."""
    cut = f"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 1}}}?{BOUNDARY}|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(normalised, F.lit(cut), F.lit(0))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_sha256, recipe) per row of ``docs``, settled; equal recipes mean equal texts."""
    cut = docs.select(F.col(id_col).alias("id"), normalise(text_col).alias("body"))
    cut = cut.withColumn("pieces", chunks(F.col("body")))
    hashed = settle(
        cut.select(
            "id",
            F.sha2(F.encode("body", "UTF-8"), 256).alias("text_sha256"),
            F.transform("pieces", lambda c: F.xxhash64(c)).alias("recipe"),
        ),
        "recipes",
    )
    clashes = settle(_clashes(cut), "chunk-clashes")
    if clashes.isEmpty():  # two different chunks of one hash: about one in 2^64 pairs
        return hashed.withColumn("verbatim", F.lit(None).cast("string"))
    return _with_verbatim(cut, hashed, clashes)


def _clashes(cut: DataFrame) -> DataFrame:
    """Hashes under which chunks differ. Equal chunks meet in their task first, so a chunk of many
    documents is sent once by each task, and only hashes are counted after that."""
    pieces = cut.select(F.explode("pieces").alias("chunk")).select(F.xxhash64("chunk").alias("h"), "chunk")
    return pieces.distinct().groupBy("h").count().where("count > 1").select("h")


def _with_verbatim(cut: DataFrame, hashed: DataFrame, clashes: DataFrame) -> DataFrame:
    """For rows with a clashing chunk the whole text stands beside the recipe, and tells them apart."""
    named = (
        cut.select(F.explode("pieces").alias("chunk"), "id", "body")
        .withColumn("h", F.xxhash64("chunk"))
        .join(clashes, "h", "left_semi")
        .select("id", F.col("body").alias("verbatim"), F.sha2(F.encode("body", "UTF-8"), 256).alias("text_sha256"))
        .distinct()
    )
    return hashed.join(named, ["id", "text_sha256"], "left")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after :func:`normalise`. Of equal texts the row with the smallest id
    stays; a null id counts as larger than any other. Rows that repeat both id and text count each in
    ``group_size``, and one of them is kept. Null and empty texts are one group, texts of white space
    another (one space). An empty table gives an empty table. Columns of other names are not looked at.
    """
    rows = recipes(docs, id_col, text_col)
    key = ["recipe", "verbatim"]
    rows = settle(rows.groupBy(*key, "id", "text_sha256").agg(F.count("*").alias("copies")), "recipe-rows")
    groups = settle(
        rows.groupBy(*key).agg(F.min("id").alias("keep_id"), F.sum("copies").alias("group_size")), "recipe-groups"
    )
    same = F.col("g.verbatim").eqNullSafe(F.col("r.verbatim")) & (F.col("g.recipe") == F.col("r.recipe"))
    joined = rows.alias("r").join(groups.alias("g"), same)
    out = joined.select(
        F.col("r.id").alias("id"), "keep_id", "group_size", "text_sha256",
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    )
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, with all their columns.

    Rows are passed on where they are unless a bit table of fixed size marks their id as one to drop, or one
    that is repeated; those few are told apart by a join. Where rows of one id and text are repeated, the one
    kept has the smallest values in the other columns.
    """
    verdicts = exact_duplicates(docs, id_col, text_col).where("group_size > 1")
    verdicts = verdicts.groupBy(F.col(id_col).alias("id"), "text_sha256").agg(
        F.max("kept").alias("any"), F.count("*").alias("n")
    )
    verdicts = settle(verdicts.where("not any or n > 1"), "recipe-verdicts")
    stay, open_ = by_mark(docs, id_col, verdicts.select("id"))
    rest = open_.join(*_marked(verdicts.where("not any"), open_, id_col, text_col), "left_anti")
    again = verdicts.where("any and n > 1")
    if again.isEmpty():
        return stay.unionByName(rest)
    mark = _marked(again, rest, id_col, text_col)
    row = free_name(docs, "row")
    twice = rest.join(*mark, "left_semi")
    one = twice.groupBy(id_col, normalise(text_col)).agg(F.min(F.struct(*docs.columns)).alias(row)).select(f"{row}.*")
    return stay.unionByName(rest.join(*mark, "left_anti")).unionByName(one)


def _marked(verdicts: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column]:
    """The ids of ``verdicts`` with their digests, and when a row of ``docs`` is one of them. Digests
    are looked at where ids agree only, so that no text of another row is normalised."""
    name = free_name(docs, "digest")
    marked = verdicts.groupBy(F.col("id").alias(f"{name}_id")).agg(F.collect_set("text_sha256").alias(name))
    digest = F.sha2(F.encode(normalise(text_col), "UTF-8"), 256)
    return marked, docs[id_col].eqNullSafe(marked[f"{name}_id"]) & F.array_contains(marked[name], digest)
