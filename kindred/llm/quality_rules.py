"""Quality rules combined by weak supervision, with DataFrame functions only.

Every rule votes good (1), bad (-1) or abstains (0) on a document.  The rules
are taken to err independently given the true quality; expectation
maximisation estimates how often each is right on good and on bad documents
when it votes, and the share of good documents.  A document is kept if its posterior probability of being good
reaches ``threshold`` and it passes the base checks.

All that the estimation needs is the number of documents per pattern of votes.
There are at most 3 ** 8 patterns whatever the size of the input, so all rounds
are one expression over a small array, and the model comes back as literals.

Nulls: a null text has no words; a document without words fails the base
checks.  Repeated rows give repeated results.  An empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.sources.scratch import Scratch

# White space between words, symbols, base limits.
WHITE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Frequent short words of the four languages of the corpus.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "with", "be", "by", "on",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist",
    "de", "la", "le", "et", "les", "des", "un", "du", "que", "est", "pour", "qui",
    "el", "en", "y", "los", "se", "del", "las", "por", "con", "no", "una",
)

ROUNDS = 12
THRESHOLD = 0.5
# Bounds that keep a rule better than chance and short of infallible.
LEAST_GOOD, LEAST_BAD, MOST_ACCURACY, MARGIN = 0.6, 0.05, 0.995, 0.01
# First guess: rules seldom blame good documents, and overlook half of the bad ones.
FIRST_ACCURACIES, FIRST_GOOD = (0.95, 0.5), 0.8


def _count(text: Column, of: str) -> Column:
    """Characters of ``text`` that are in ``of``."""
    return F.length(text) - F.length(F.translate(text, of, ""))


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with word and line statistics, each over the whole text.

    Windows of three words are compared by a 64-bit hash within one document.
    """
    held = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    held = held.withColumn("_words", F.filter(F.split("_text", WHITE, -1), lambda w: w != ""))
    held = held.withColumn("n_words", F.size("_words").cast("long"))
    held = held.withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda line: line.rlike(WORD)))
    held = held.withColumn(
        "_windows",
        F.when(
            F.col("n_words") >= 3,
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.col("n_words").cast("int") - 3, F.lit(0))),
                lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    # Positions of windows that have an equal one: neighbours in hash order.
    ordered = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    held = held.withColumn(
        "_ordered",
        F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), ordered),
    )
    held = held.withColumn(
        "_starts",
        F.sort_array(
            F.transform(
                F.filter(
                    "_ordered",
                    lambda w, k: F.coalesce(F.get("_ordered", k + 1)["h"] == w["h"], F.lit(False))
                    | F.coalesce(F.get("_ordered", k - 1)["h"] == w["h"], F.lit(False)),
                ),
                lambda w: w["i"],
            )
        ),
    )
    repeated = F.aggregate(
        "_starts",
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, s: F.struct((a["n"] + F.least(F.lit(3), s - a["last"])).alias("n"), s.alias("last")),
        lambda a: a["n"],
    )
    return (
        held.withColumn("word_chars", F.length(F.regexp_replace("_text", WHITE, "")).cast("long"))
        .withColumn("n_symbols", _count(F.col("_text"), SYMBOLS).cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0)).cast("long"))
        .withColumn("n_upper", F.length(F.regexp_replace("_text", "[^A-Z]+", "")).cast("long"))
        .withColumn("n_stop", F.size(F.filter("_words", lambda w: w.isin(*STOP_WORDS))).cast("long"))
        .withColumn("n_marked", F.size(F.filter("_words", lambda w: w.rlike("[!?#*$%&|<>]$"))).cast("long"))
        .drop("_text", "_words", "_lines", "_windows", "_ordered", "_starts")
    )


def _votes() -> dict[str, Column]:
    """Rule name to its vote, from the columns of :func:`base_statistics`."""

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    c = F.col
    words = F.greatest(c("n_words"), F.lit(1))
    mean = c("word_chars") / words
    return {
        "length": vote(c("n_words") >= 100, c("n_words") < MIN_WORDS),
        "word_length": vote(mean.between(3, 9), ~mean.between(2.5, 14)),
        "symbols": vote(c("n_symbols") * 50 <= words, c("n_symbols") * 8 > words),
        "marks": vote(c("n_marked") * 20 <= words, c("n_marked") * 4 > words),
        "capitals": vote(c("n_upper") * 8 <= c("word_chars"), c("n_upper") * 3 > c("word_chars")),
        "stop_words": vote(c("n_stop") * 12 >= words, c("n_stop") * 50 < words),
        "repeats": vote(c("n_repeat_words") * 10 <= words, c("n_repeat_words") * 3 > words),
        "lines": vote((c("n_lines") >= 3) & (c("n_dup_lines") == 0), c("n_dup_lines") * 3 > c("n_lines")),
    }


RULES = ("length", "word_length", "symbols", "marks", "capitals", "stop_words", "repeats", "lines")


def _log_odds(model: dict) -> Column:
    """Log odds that a document with the votes of its row is good."""

    def evidence(rule: str) -> Column:
        right_good, right_bad = model[rule]
        vote = F.col(f"vote_{rule}")
        return (
            F.when(vote > 0, math.log(right_good / (1 - right_bad)))
            .when(vote < 0, math.log((1 - right_good) / right_bad))
            .otherwise(0.0)
        )

    return reduce(lambda a, b: a + b, map(evidence, RULES), F.lit(math.log(model["good"] / (1 - model["good"]))))


def posterior(model: dict) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_log_odds(model)))


def _clamped(value: Column, least: Column | float, most: float) -> Column:
    return F.least(F.greatest(value, least if isinstance(least, Column) else F.lit(least)), F.lit(most))


def _round(patterns: Column, model: Column) -> Column:
    """The model after one round over the array of patterns ``votes, n``.

    Posterior-weighted right votes over posterior-weighted votes, by rule.
    """
    zeros = F.array_repeat(F.lit(0.0), len(RULES))

    def weighed(pattern: Column) -> Column:
        def evidence(i: int) -> Column:
            vote, right_good, right_bad = (F.get(x, F.lit(i)) for x in (pattern["votes"], model["right_good"], model["right_bad"]))
            return (
                F.when(vote > 0, F.log(right_good / (1 - right_bad)))
                .when(vote < 0, F.log((1 - right_good) / right_bad))
                .otherwise(0.0)
            )

        odds = reduce(lambda x, y: x + y, map(evidence, range(len(RULES))), F.log(model["good"] / (1 - model["good"])))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))
        return F.struct(pattern["votes"].alias("votes"), pattern["n"].alias("n"), p.alias("p"))

    def added(sums: Column, pattern: Column) -> Column:
        good, bad = pattern["n"] * pattern["p"], pattern["n"] * (1 - pattern["p"])

        def by_rule(name: str, weight: Column, counts: Callable[[Column], Column]) -> Column:
            plus = F.zip_with(sums[name], pattern["votes"], lambda x, vote: x + F.when(counts(vote), weight).otherwise(0.0))
            return plus.alias(name)

        return F.struct(
            (sums["n"] + pattern["n"]).alias("n"),
            (sums["good"] + good).alias("good"),
            by_rule("right_good", good, lambda vote: vote > 0),
            by_rule("voted_good", good, lambda vote: vote != 0),
            by_rule("right_bad", bad, lambda vote: vote < 0),
            by_rule("voted_bad", bad, lambda vote: vote != 0),
        )

    def updated(sums: Column) -> Column:
        def share(kind: str, first: float) -> Column:
            return F.zip_with(sums[f"right_{kind}"], sums[f"voted_{kind}"], lambda right, voted: (right + first) / (voted + 1))

        good, bad = share("good", FIRST_ACCURACIES[0]), share("bad", FIRST_ACCURACIES[1])
        good = F.transform(good, lambda x: _clamped(x, LEAST_GOOD, MOST_ACCURACY))
        bad = F.zip_with(bad, good, lambda x, y: _clamped(x, F.greatest(F.lit(LEAST_BAD), 1 + MARGIN - y), MOST_ACCURACY))
        return F.struct(
            _clamped((sums["good"] + 1) / (sums["n"] + 2), 0.01, 0.99).alias("good"),
            good.alias("right_good"),
            bad.alias("right_bad"),
        )

    none = F.struct(
        F.lit(0).cast("bigint").alias("n"),
        F.lit(0.0).alias("good"),
        *[zeros.alias(name) for name in ("right_good", "voted_good", "right_bad", "voted_bad")],
    )
    return F.aggregate(F.transform(patterns, weighed), none, added, updated)


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> dict:
    """Accuracies per rule and the share of good documents, from ``vote_*, n``.

    A rule has two accuracies: how often its vote is right on good documents
    and how often on bad ones.  The patterns (3 ** 8 at most) are gathered in
    one array, in a fixed order, and all rounds are one expression over it:
    one plan whatever the number of rounds.  With no documents the first guess
    stays.
    """
    first = F.struct(
        F.lit(FIRST_GOOD).alias("good"),
        *[F.array_repeat(F.lit(x), len(RULES)).alias(n) for n, x in zip(("right_good", "right_bad"), FIRST_ACCURACIES)],
    )
    pattern = F.struct(F.array(*[f"vote_{rule}" for rule in RULES]).alias("votes"), F.col("n").cast("bigint").alias("n"))
    gathered = patterns.agg(F.sort_array(F.collect_list(pattern)).alias("patterns"))
    done = F.slice(F.sequence(F.lit(0), F.lit(rounds)), 2, rounds)
    done = F.when(F.size("patterns") > 0, done).otherwise(F.slice(done, 1, 0))
    found = gathered.select(F.aggregate(done, first, lambda model, _: _round(F.col("patterns"), model)).alias("m")).first()["m"]
    accuracies = zip(found["right_good"], found["right_bad"])
    return dict(zip(RULES, accuracies)) | {"good": found["good"]}


def _judged(docs: DataFrame, scratch: Scratch, row: Column, text: str, rounds: int, threshold: float) -> DataFrame:
    """``row`` with statistics, votes, ``posterior`` and verdict.

    The voted rows are written once: they are read for the patterns and again
    for the verdicts, and nothing is shuffled but the patterns.
    """
    stats = base_statistics(docs.select(row.alias("row"), F.col(text).alias("text"))).drop("text")
    voted = scratch.keep(stats.withColumns({f"vote_{rule}": v.cast("int") for rule, v in _votes().items()}), "votes")
    votes = [f"vote_{rule}" for rule in RULES]
    model = estimate(voted.groupBy(*votes).agg(F.count("*").alias("n")), rounds)
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return (
        voted.withColumn("posterior", posterior(model))
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    )


def quality_rules(
    docs: DataFrame,
    scratch: Scratch,
    doc_id: str = "doc_id",
    text: str = "text",
    rounds: int = ROUNDS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``doc_id``, statistics, votes, ``posterior`` and verdict of every document."""
    judged = _judged(docs, scratch, F.struct(F.col(doc_id).alias("id")), text, rounds, threshold)
    return judged.select(F.col("row.id").alias("doc_id"), *[c for c in judged.columns if c != "row"])


def good_documents(
    docs: DataFrame, scratch: Scratch, text: str = "text", rounds: int = ROUNDS, threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    return _judged(docs, scratch, F.struct("*"), text, rounds, threshold).where("kept").select("row.*")
