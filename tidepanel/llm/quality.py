"""Quality rules by weak supervision.

Rules look at counts of a text and vote good, bad or abstain. Expectation-maximisation over the votes of
all documents estimates how often each rule's votes are right, without labels, and a document is kept by
its posterior probability of being good. The estimation needs only how many documents cast each
combination of votes, so Spark counts those and the rounds run over that small histogram.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import SPACES, free_name, settle, whole_text

SYMBOLS = "#*$%&|<>"
ENDS = ".!?"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

GOOD, BAD, ABSTAIN = 1, 0, 2


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds, else abstains."""

    name: str
    bad: str
    good: str


#: Over the columns of :func:`counts`. Every signal has a cut below which it speaks for a text and another beyond
#: which it speaks against it, and is silent between: how much any of that says is for the estimation to find out.
RULES = (
    Rule("symbols", "n_symbols > 0.08 * word_chars", "n_symbols <= 0.002 * word_chars"),
    Rule("symbol_words", "n_symbols > 0.4 * n_words", "n_symbols <= 0.02 * n_words"),
    Rule("repeats", "n_repeat_words > 0.1 * n_words", "n_repeat_words <= 0.01 * n_words"),
    Rule("lines", "n_dup_lines > 0.25 * n_lines", "n_dup_lines <= 0.05 * n_lines"),
    Rule("variety", "n_unique < 0.5 * n_words and n_words <= 400", "n_unique >= 0.62 * n_words"),
    Rule("word_length", "word_chars > 7.0 * n_words or word_chars < 3.0 * n_words",
         "word_chars >= 4.0 * n_words and word_chars <= 6.2 * n_words"),
    Rule("sentences", "n_ends < 0.02 * n_words", "n_ends >= 0.04 * n_words and n_ends <= 0.3 * n_words"),
    Rule("line_ends", "n_ends < 0.5 * n_lines", "n_ends >= n_lines"),
)

ROUNDS = 50
#: Where the rounds start: most documents are good, and a vote is more often right than wrong.
#: Probabilities of the votes bad, good and abstain for a good and for a bad document.
START_GOOD = 0.8
START_VOTES = ((0.05, 0.75, 0.2), (0.35, 0.35, 0.3))
#: Counted to each vote's odds, so that no probability is 0 or 1.
SMOOTH = 1.0
THRESHOLD = 0.5


#: A run of WINDOW words of a text with single spaces, of which the first is then passed over; nothing is tried inside
#: a word, so that a long one is not read again from each of its characters.
_RUN = f"(?<![^ ])(?=([^ ]++(?: [^ ]++){{{WINDOW - 1}}}))[^ ]++"


def _placed(windows: Column) -> Column:
    """(hash of the window, place), sorted, where windows occur more than once, else NULL."""
    some = F.transform(windows, lambda w, i: F.struct(F.xxhash64(w).alias("w"), i.alias("i")))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(some))


def _repeats(placed: str) -> Column:
    """Places, ascending, of the windows that are equal to a neighbour."""
    hash_at = lambda i: F.get(F.col(placed), i)["w"]
    same = F.filter(placed, lambda p, i: F.coalesce((p["w"] == hash_at(i - 1)) | (p["w"] == hash_at(i + 1)), F.lit(False)))
    return F.sort_array(F.transform(same, lambda p: p["i"]))


def _covered(places: str) -> Column:
    """Words that windows at ``places`` cover: each those before the next begins."""
    ahead = F.slice(places, F.lit(2), F.size(places))
    gaps = F.zip_with(places, ahead, lambda a, b: F.coalesce(b - a, F.lit(WINDOW)))
    return F.coalesce(F.aggregate(gaps, F.lit(0), lambda s, g: s + F.least(g, F.lit(WINDOW))), F.lit(0))


def _without(text: str, marks: str) -> Column:
    out = F.col(text)
    for mark in marks:
        out = F.replace(out, F.lit(mark), F.lit(""))
    return out


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_unique, n_ends
    (marks that end a sentence)."""
    body = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("body"))
    plain = F.regexp_replace("body", r"[\x09-\x0D]", " ")  # one-character patterns are split at without a regex
    split = body.select(
        "id",
        F.length(F.regexp_replace("body", f"[^{SYMBOLS}]+", "")).alias("n_symbols"),
        (F.octet_length("body") - F.octet_length(_without("body", ENDS))).alias("n_ends"),
        F.filter(F.split("body", "\n"), lambda x: F.ltrim(x, F.lit(SPACES)) != "").alias("lines"),
        F.array_remove(F.split(plain, " "), "").alias("words"),
    )
    joined = split.select(
        "id", "n_symbols", "n_ends",
        F.size("words").alias("n_words"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size(F.array_distinct("words")).alias("n_unique"),
        F.array_join("words", " ").alias("joined"),
    )
    hashed = joined.select(
        "id", "n_symbols", "n_ends", "n_words", "n_lines", "n_dup_lines", "n_unique",
        (F.length("joined") - F.greatest(F.col("n_words") - 1, F.lit(0))).alias("word_chars"),
        F.regexp_extract_all("joined", F.lit(_RUN), F.lit(1)).alias("windows"),
    )
    # Columns that are used more than once are steps of their own, as nothing else keeps them from being made again.
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_unique", "n_ends"]
    placed = hashed.select("id", *names, _placed(F.col("windows")).alias("placed"))
    places = placed.select("id", *names, _repeats("placed").alias("places"))
    out = places.select("id", *names, _covered("places").alias("n_repeat_words"))
    return out.select(F.col("id").alias(id_col), *[F.col(c).cast("long").alias(c) for c in [*names, "n_repeat_words"]])


def base_failed() -> Column:
    few = F.col("n_words") < MIN_WORDS
    return few | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def vote(rule: Rule) -> Column:
    return F.when(F.expr(rule.bad), BAD).when(F.expr(rule.good), GOOD).otherwise(ABSTAIN)


@dataclass(frozen=True)
class Model:
    """Probability that a document is good, and by rule the probability of each vote for a good and
    for a bad document."""

    good: float
    votes: tuple[tuple[tuple[float, float, float], tuple[float, float, float]], ...]

    def log_odds(self, pattern: Sequence[int]) -> float:
        start = math.log(self.good / (1 - self.good))
        return start + sum(math.log(g[v] / b[v]) for (g, b), v in zip(self.votes, pattern))


def estimate(histogram: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over {votes of all rules: documents}, at most 3 to the power of the rules.

    An abstention is an outcome like the votes: a signal between its cuts is rare among good documents, and a
    document that no rule votes against may go for several of them.
    A rule that is right less often than by chance for a class would be read the wrong way round, so votes
    keep the side they were written for: a vote good is never evidence against a document, nor bad for one.
    """
    n_rules = len(next(iter(histogram), ()))
    model = Model(START_GOOD, (START_VOTES,) * n_rules)
    total = sum(histogram.values())
    for _ in range(rounds if total else 0):
        sums = [[[SMOOTH] * 3, [SMOOTH] * 3] for _ in range(n_rules)]
        good = SMOOTH
        for pattern, n in histogram.items():
            p = n / (1 + math.exp(-max(-700.0, min(700.0, model.log_odds(pattern)))))
            good += p
            for s, v in zip(sums, pattern):
                s[0][v] += p
                s[1][v] += n - p
        votes = []
        for g, b in sums:
            g, b = [x / sum(g) for x in g], [x / sum(b) for x in b]
            g[GOOD], b[GOOD] = max(g[GOOD], b[GOOD]), min(g[GOOD], b[GOOD])
            g[BAD], b[BAD] = min(g[BAD], b[BAD]), max(g[BAD], b[BAD])
            votes.append((tuple(g), tuple(b)))
        model = Model(good / (total + 2 * SMOOTH), tuple(votes))
    return model


def posterior(model: Model, rules: Sequence[Rule] = RULES) -> Column:
    """Probability that a row of :func:`counts` is good."""
    odds = F.lit(math.log(model.good / (1 - model.good)))
    for rule, (g, b) in zip(rules, model.votes):
        odds = odds + F.when(F.expr(rule.bad), F.lit(math.log(g[BAD] / b[BAD]))).when(
            F.expr(rule.good), F.lit(math.log(g[GOOD] / b[GOOD]))
        ).otherwise(F.lit(math.log(g[ABSTAIN] / b[ABSTAIN])))
    return 1 / (1 + F.exp(-odds))


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES
) -> DataFrame:
    """Per row of ``docs``: the columns of :func:`counts`, base_failed, p_good, kept.

    ``kept`` is false where the base rules fail, else ``p_good >= THRESHOLD``. A null or empty text has no
    words and fails. Rows that repeat an id are judged each. An empty table gives an empty table.
    """
    counted = settle(counts(docs, id_col, text_col), "quality-counts")
    cast = counted.groupBy(*[vote(r).alias(f"v{i}") for i, r in enumerate(rules)]).count().collect()
    model = estimate({tuple(r[:-1]): r[-1] for r in cast})
    if not cast:
        model = Model(START_GOOD, (START_VOTES,) * len(rules))
    judged = counted.withColumn("base_failed", base_failed()).withColumn("p_good", posterior(model, rules))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= THRESHOLD))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all their columns. Rows are written once beside their
    counts, as counting costs far more than that: the verdict needs the counts of all rows first."""
    whole = free_name(docs, "whole")
    counted = settle(_beside(docs.withColumn(whole, F.struct(*docs.columns)), whole, text_col), "quality-rows")
    cast = counted.groupBy(*[vote(r).alias(f"v{i}") for i, r in enumerate(RULES)]).count().collect()
    if not cast:
        return docs
    model = estimate({tuple(r[:-1]): r[-1] for r in cast})
    return counted.where(~base_failed() & (posterior(model) >= THRESHOLD)).select(f"{whole}.*")


def _beside(docs: DataFrame, carried: str, text_col: str) -> DataFrame:
    """:func:`counts` with the struct column ``carried`` in the place of the id."""
    return counts(docs.select(F.col(carried), F.col(text_col).alias("body_")), carried, "body_")
