"""Main text of web pages by wrapper induction.

Every page becomes a tree in which like siblings are one node, and all text that is shown stays in it. The
trees of a host's pages are aligned by simple tree matching with the host's most frequent tree, its wrapper.
Counted over all pages of the host, a text that stands at the same wrapper node on most of them is template,
and what varies fills a content slot. Menus, footers, adverts and so on vary from page to page as well, so
names (see ``page_tree.choose``) choose among what varies, and are not asked about the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import page_tree
from tidepanel.llm.common import settle

#: A text is template when it stands at its node on this share of the host's different pages, on all of them
#: where these are fewer than MANY_PAGES. A host of fewer than MIN_PAGES has none.
CONSTANT, MIN_PAGES, MANY_PAGES = 0.6, 2, 5

BLOCK = "struct<text:string,grade:int,level:int>"
PARSED = f"id long, url string, tree string, content long, nodes array<int>, blocks array<{BLOCK}>"
_BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("grade", pa.int32()), ("level", pa.int32())]))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        trees, contents, nodes, blocks = [], [], [], []
        for html in batch.column(2).to_pylist():
            page = page_tree.parse(html or "")
            trees.append(page_tree.spell(page.nodes))
            told = "\0".join(page.content).encode("utf-8", "surrogatepass")
            contents.append(int.from_bytes(blake2b(told, digest_size=8).digest(), "big", signed=True))
            nodes.append([n for n, _, _, _ in page.texts])
            blocks.append([{"text": t, "grade": g, "level": v} for _, t, g, v in page.texts])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array(trees, pa.string()), pa.array(contents, pa.int64()),
                pa.array(nodes, pa.list_(pa.int32())), pa.array(blocks, _BLOCKS),
            ],
            names=["id", "url", "tree", "content", "nodes", "blocks"],
        )


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for blocks, drop, few in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
            texts = [(0, b["text"], b["grade"], b["level"]) for b in blocks]
            out.append(" ".join(texts[i][1] for i in page_tree.choose(texts, set(drop or ()), bool(few))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["id", "url", "text"])


@lru_cache(maxsize=4096)
def _aligned(tree: str, wrapper: str) -> list[int]:
    return page_tree.match(page_tree.unspell(tree), page_tree.unspell(wrapper))


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_aligned(t, w) for t, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["host", "shape", "slots"]
        )


def host_of(url: str = "url"):
    """Host of an address in lower case, empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: id_col, url_col, text, n_chars.

    Character references are decoded, white space in a block is one space, blocks are joined in page order by
    one space. A null or empty page has the empty text. A page without a host, or of a host with fewer than
    MIN_PAGES different pages, has no template text; pages of the same main text are not different. A page all of
    whose text would be template keeps it. Rows that repeat an id are pages each; an empty table gives an empty
    table. Other columns are not looked at.
    """
    given = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")
    )
    parsed = given.mapInArrow(_parse, PARSED).withColumn("host", host_of())
    parsed = parsed.withColumn("shape", F.xxhash64("tree")).withColumn("row", F.monotonically_increasing_id())
    parsed = settle(parsed, "page-blocks")
    drops = settle(_template(parsed), "page-template")
    out = parsed.select("row", "id", "url", "blocks").join(drops, "row", "left").select("id", "url", "blocks", "drop", "few")
    out = out.mapInArrow(_choose, "id long, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))


def _template(parsed: DataFrame) -> DataFrame:
    """(row, drop, few): the numbers of a page's blocks that are template of its host, and whether it has few pages."""
    hosted = parsed.where("host <> ''")
    shapes = hosted.groupBy("host", "shape").agg(F.count("*").alias("n"), F.first("tree").alias("tree"))
    shapes = settle(shapes, "page-shapes")
    wrappers = shapes.groupBy("host").agg(F.max_by("tree", F.struct("n", "shape")).alias("wrapper"))
    pairs = shapes.select("host", "shape", "tree").join(wrappers, "host")
    slots = settle(pairs.mapInArrow(_align, "host string, shape long, slots array<int>"), "page-slots")
    hashes = F.transform("blocks", lambda b: F.xxhash64(b["text"])).alias("hashes")
    rows = hosted.select("row", "host", "shape", "content", "nodes", hashes).join(slots, ["host", "shape"])
    placed = F.transform("nodes", lambda n: F.get("slots", n)).alias("placed")
    rows = settle(rows.select("row", "host", "content", placed, "hashes"), "page-slotted")
    blocks = rows.select("row", "host", "content", F.posexplode(F.arrays_zip("placed", "hashes")).alias("at", "b"))
    blocks = blocks.select("row", "host", "content", "at", F.col("b.placed").alias("slot"), F.col("b.hashes").alias("h")).where("slot >= 0")
    sizes = rows.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    sizes = sizes.where(F.col("pages") >= MIN_PAGES)
    few = F.col("pages") < MANY_PAGES
    texts = blocks.select("host", "slot", "h", "content").distinct().groupBy("host", "slot", "h").agg(F.count("*").alias("n"))
    constant = texts.join(sizes, "host").where(F.col("n") >= F.when(few, F.col("pages")).otherwise(CONSTANT * F.col("pages")))
    constant = settle(constant.select("host", "slot", "h", few.alias("few")), "page-constant")
    found = blocks.join(constant, ["host", "slot", "h"])
    return found.groupBy("row").agg(F.sort_array(F.collect_set("at")).alias("drop"), F.first("few").alias("few"))
