"""Queries of the filter audit, the license scan and the clustering of vectors, with their SQL."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import centroids, filter_audit, license_scan
from tidepanel.llm.common import table

CENTROIDS, ROUNDS = 40, 5


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(c, ",")
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", text("base_labels").alias("base_labels"),
        text("labels").alias("labels"), "score",
    )


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), CENTROIDS, ROUNDS).drop("scans")


_FLAGS = r"""
d as (select doc_id, coalesce(text, '') as text, coalesce(lang, '') as part,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
f as (select doc_id, part, len(words) < 100 as a, 100 * len(list_distinct(words)) < 80 * len(words) as b,
             100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text) as c,
             regexp_matches(text, '[#$%&*|]') as d, coalesce(doc_id > min(doc_id) over (partition by text), false) as e from d),
m as (select part, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int as mask, count(*) as n,
             count(*) filter (where doc_id in (select doc_id from labels where quality = 1)) as good,
             count(*) filter (where doc_id in (select doc_id from labels where toxic = 1)) as toxic from f group by 1, 2)
"""


def _orders_sql() -> str:
    rows = [
        f"('{''.join(o)}', {k + 1}, {1 << 'ABCDE'.index(o[k])}, {sum(1 << 'ABCDE'.index(x) for x in o[:k])})"
        for o in permutations("ABCDE")
        for k in range(5)
    ]
    return f"o(filter_order, step, bit, earlier) as (values {', '.join(rows)})"


OP11_SQL = f"""
with {_FLAGS}, {_orders_sql()},
r as (select part, filter_order, step, bit,
             sum(case when mask & (bit | earlier) = 0 then n else 0 end) as kept,
             sum(case when mask & earlier = 0 and mask & bit > 0 then n else 0 end) as removed,
             sum(case when mask & earlier > 0 and mask & bit > 0 then n else 0 end) as redundant,
             sum(case when mask = bit then n else 0 end) as unique_fails,
             sum(case when mask & earlier = 0 and mask & bit > 0 then good else 0 end) as good_lost,
             sum(case when mask & earlier = 0 and mask & bit > 0 then toxic else 0 end) as toxic_lost
      from m, o group by 1, 2, 3, 4)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
       unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
       cast(sum(removed) over (partition by part, bit) as bigint) as shapley from r
"""


def _rounds_sql() -> str:
    """Assignment and centroids turn by turn; the smaller number wins ties as distances are whole numbers."""
    steps = []
    for t in range(ROUNDS + 1):
        steps.append(
            f"""a{t} as (select vec_id, row, min(dist * {CENTROIDS} + cid) as code
                 from (select vec_id, row, cid, list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as dist
                       from v, c{t} c) group by 1, 2)"""
        )
        if t == ROUNDS:
            break
        steps.append(
            f"""s{t} as (select cid, i, sum(x)::bigint as s, count(*) as n
                 from (select code % {CENTROIDS} as cid, unnest(range(1, 65)) as i, unnest(v.v) as x from a{t} join v using (vec_id, row))
                 group by 1, 2),
            m{t} as (select cid, list((s - ((s % n) + n) % n) // n order by i) as v from s{t} group by 1),
            c{t + 1} as (select c.cid, coalesce(m.v, c.v) as v from c{t} c left join m{t} m using (cid))"""
        )
    return ",\n".join(steps)


OP13_SQL = f"""
with e as (select vec_id, embedding, row_number() over () as row from embeddings
           where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
v as (select vec_id, row, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from e),
c0 as (select cast(row_number() over (order by h, v) - 1 as bigint) as cid, v
       from (select sha256('2:' || vec_id) as h, v from v order by h, v limit {CENTROIDS})),
{_rounds_sql()},
r as (select vec_id, code % {CENTROIDS} as cid, code // {CENTROIDS} as distance from a{ROUNDS})
select vec_id, cast(r.cid as int) as cluster, cast(distance as bigint) as distance,
       cast(sum(distance) over (partition by r.cid) as bigint) as cluster_inertia, cast(sum(distance) over () as bigint) as inertia,
       sha256(array_to_string(c.v, ',')) as centroid_sha256
from r join c{ROUNDS} c on c.cid = r.cid
"""

QUERIES = {
    "op11_filter_audit": op11_filter_audit,
    "op12_license_scan": op12_license_scan,
    "op13_centroid_clustering": op13_centroid_clustering,
}
ORACLES = {"op11_filter_audit": OP11_SQL, "op13_centroid_clustering": OP13_SQL}
