"""Queries of the operators that need DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import exact_dedup, mixing, quality, shard
from tidepanel.llm.common import table

SHARDS = 24

#: A domain is named by the source: the digits of ``src7`` modulo 3.
DOMAIN = "concat('d', pmod(try_cast(regexp_extract(source, '^src([0-9]+)$', 1) as int), 3))"
LEVELS = {"domain": DOMAIN, "language": "lang", "origin": "source"}
#: Target weights of the production mix; what is not named weighs 1.
WEIGHTS = {
    "domain": {"d0": 1.0, "d1": 2.0, "d2": 1.0},
    "language": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0},
    "origin": {"src0": 2.0, "src10": 3.0},
}
FRACTION, EPOCHS, SEED = 0.6, 2, 17


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    first = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select(*first, "p_good")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.choose(docs, LEVELS, WEIGHTS, FRACTION, EPOCHS, SEED)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shard.assign(table(spark, sf_dir, "documents"), SHARDS)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


_CLEAN = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')"

OP4_SQL = f"""
with d as (select doc_id, {_CLEAN} as body from documents),
     r as (select *, min(doc_id) over (partition by body) as keep_id, count(*) over (partition by body) as group_size,
                  row_number() over (partition by body, doc_id) as copy from d)
select doc_id, keep_id, group_size, doc_id = keep_id and copy = 1 as kept, sha256(body) as text_sha256 from r
"""

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


def _weight_sql(level: str) -> str:
    named = " ".join(f"when '{k}' then cast({v} as double)" for k, v in WEIGHTS[level].items())
    return f"case {level} {named} else cast(1 as double) end"


def _level_sql(depth: int) -> str:
    """Shares of the nodes at a depth: full ones first, by capacity per weight, the rest by weight."""
    names = list(LEVELS)[:depth]
    parents, level = names[:-1], names[-1]
    by = f"partition by {', '.join(parents)} " if parents else ""
    order = f"{by}order by ratio, {level}"
    join = f"join g{depth - 1} using ({', '.join(parents)})" if parents else "cross join g0"
    keys = ", ".join(names)
    return f"""
n{depth} as (select {keys}, sum(capacity) as cap from leaves group by {keys}),
c{depth} as (select n.*, budget as given, {_weight_sql(level)} as w, cap / {_weight_sql(level)} as ratio from n{depth} n {join}),
s{depth} as (select *, (given - coalesce(sum(cap) over ({order} rows between unbounded preceding and 1 preceding), 0))
                      / sum(w) over ({order} rows between current row and unbounded following) as share from c{depth}),
l{depth} as (select *, first_value(case when ratio > share then share end ignore nulls)
                      over ({order} rows between unbounded preceding and unbounded following) as line from s{depth}),
g{depth} as (select {keys}, case when line is null or ratio <= line then cap else greatest(0, line * w) end as budget from l{depth}),"""


OP8_SQL = f"""
with d as (select doc_id,
                  coalesce('d' || (try_cast(regexp_extract(source, '^src([0-9]+)$', 1) as int) % 3), 'other') as domain,
                  coalesce(lang, 'other') as language, coalesce(source, 'other') as origin,
                  cast(len({_WORDS}) as bigint) as n_tokens from documents),
leaves as (select domain, language, origin, cast(sum(n_tokens) * {EPOCHS} as double) as capacity from d group by 1, 2, 3),
g0 as (select least(cast({FRACTION} as double) * (select sum(n_tokens) from d), (select sum(capacity) from leaves)) as budget),
{_level_sql(1)}{_level_sql(2)}{_level_sql(3)}
e as (select d.*, epoch, md5('{SEED}:' || epoch || ':' || doc_id) as place from d, (select unnest(range(0, {EPOCHS})) as epoch)),
t as (select e.*, floor(budget + 0.000001) as budget,
             coalesce(sum(n_tokens) over (partition by domain, language, origin order by epoch, place, n_tokens
                      rows between unbounded preceding and 1 preceding), 0) as start
      from e join g3 using (domain, language, origin))
select doc_id, domain, language, origin, cast(epoch as int) as epoch, n_tokens, cast(start as bigint) as start
from t where start + n_tokens <= budget
"""

QUERIES = {
    "op4_exact_dedup": op4_exact_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op8_mixing": op8_mixing,
    "op10_sharding": op10_sharding,
}
ORACLES = {"op4_exact_dedup": OP4_SQL, "op8_mixing": OP8_SQL}
