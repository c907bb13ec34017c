"""Quality rules as weak supervision: rules vote or abstain, and a fitted posterior replaces all-must-pass filtering."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.words import whole_row, word_array
from runlens.session import materialize

WINDOW = 5
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\f\r"
LOWER = "abcdefghijklmnopqrstuvwxyz"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, although the body uses it many times."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text.

    Windows are 64-bit hashes of their words. Only texts with equal hashes sort them with their places; the covered words
    are then counted from one repeated place to the next.
    """
    hashes = F.transform(
        F.sequence(F.lit(1), F.size(words) - WINDOW + 1),
        lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(WINDOW)]),
    )

    def covered(sorted_places: Column) -> Column:
        same = lambda p, i, j: F.coalesce(F.get(sorted_places, j)["h"] == p["h"], F.lit(False))
        repeated = F.filter(sorted_places, lambda p, i: same(p, i, i - 1) | same(p, i, i + 1))
        return _let(F.sort_array(F.transform(repeated, lambda p: p["at"])), lambda at: F.aggregate(
            F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)))),
            F.lit(0), lambda total, n: total + n,
        ))

    def counted(found: Column) -> Column:
        places = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(_let(places, covered))

    return F.when(F.size(words) < WINDOW + 1, F.lit(0)).otherwise(_let(hashes, counted))


def measures(text: Column) -> Column:
    """A struct of the measures of a text (long). A null text measures like an empty one."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, WHITE, "")) > 0)
    without = lambda value, letters: F.length(value) - F.length(F.translate(value, letters, ""))

    def of(rest: Column) -> Column:
        """``rest`` is the text without lower-case ASCII letters: short, but with all that is counted by character."""
        return F.struct(
            (F.length(text) - without(rest, WHITE)).alias("word_chars"), without(rest, SYMBOLS).alias("n_symbols"),
            without(rest, LOWER.upper()).alias("n_upper"), without(rest, "!?").alias("n_shouts"),
        )

    by_words = _let(word_array(text), lambda ws: F.struct(F.size(ws).alias("n_words"), _repeat_words(ws).alias("n_repeat_words")))
    by_lines = _let(lines, lambda ls: F.struct(F.size(ls).alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("n_dup_lines")))
    parts = F.struct(_let(F.translate(text, LOWER, ""), of).alias("c"), by_words.alias("w"), by_lines.alias("l"))
    home = {"n_words": "w", "n_repeat_words": "w", "n_lines": "l", "n_dup_lines": "l"}
    return _let(parts, lambda p: F.struct(*[p[home.get(m, "c")][m].cast("long").alias(m) for m in MEASURES]))


@dataclass(frozen=True)
class Rule:
    """Votes bad where a share lies above ``bad``, good where it is at most ``good``, else abstains."""

    name: str
    share: str
    good: float
    bad: float

    def vote(self) -> Column:
        value = F.expr(self.share)
        return F.when(F.col("n_words") == 0, 0).when(value > self.bad, -1).when(value <= self.good, 1).otherwise(0)


RULES = (
    Rule("length", "1.0 / n_words", 0.02, 0.1),
    Rule("symbols", "n_symbols / n_words", 0.02, 0.1),
    Rule("symbol_share", "n_symbols / greatest(word_chars, 1)", 0.005, 0.03),
    Rule("repeated_words", "n_repeat_words / n_words", 0.05, 0.2),
    Rule("repeated_lines", "n_dup_lines / greatest(n_lines, 1)", 0.05, 0.3),
    Rule("word_length", "abs(word_chars / n_words - 6)", 2.0, 4.0),
    Rule("capitals", "n_upper / greatest(word_chars, 1)", 0.1, 0.3),
    Rule("shouts", "n_shouts / n_words", 0.02, 0.1),
)


@dataclass(frozen=True)
class Fitted:
    """Log odds for 'good': a start value, and per rule the evidence of each vote."""

    start: float
    evidence: list[dict[int, float]]

    def posterior(self, votes: list[Column]) -> Column:
        odds = F.lit(self.start)
        for vote, found in zip(votes, self.evidence, strict=True):
            odds += F.when(vote == 1, found[1]).when(vote == -1, found[-1]).otherwise(found[0])
        return 1 / (1 + F.exp(-odds))


def fit(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = 100, weight: float = 2.0) -> Fitted:
    """Expectation-maximisation over vote patterns and their counts.

    For each class and rule it estimates how often the rule is right where it votes. Abstaining says nothing about the
    class. A bad document usually fails few of the rules, a good one hardly any: that is the start; ``weight``
    pseudo-votes keep rules without votes in place and alone decide where there is no pattern. Rules are written to spare
    good text, so a good document is held to fail each with a chance of at most 1 in 100. Without that bound the classes can
    turn into two kinds of bad text.
    """
    start, prior = (0.2, 0.99), 0.8  # bad, good
    least = (1e-4, 0.99)
    right = [[start[0]] * rules, [start[1]] * rules]
    for _ in range(rounds):
        hits = [[start[0] * weight] * rules, [start[1] * weight] * rules]
        seen = [[weight] * rules, [weight] * rules]
        good = n = 0.0
        for votes, count in patterns:
            odds = math.log(prior / (1 - prior))
            for j, v in enumerate(votes):
                if v:
                    odds += math.log(right[1][j] / (1 - right[0][j])) if v > 0 else math.log((1 - right[1][j]) / right[0][j])
            p = 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))
            good += p * count
            n += count
            for j, v in enumerate(votes):
                if v:
                    seen[1][j] += p * count
                    seen[0][j] += (1 - p) * count
                    hits[1][j] += p * count * (v > 0)
                    hits[0][j] += (1 - p) * count * (v < 0)
        prior = min(0.999, max(0.001, (good + 0.8 * weight) / (n + weight)))
        right = [[min(0.9999, max(least[c], h / s)) for h, s in zip(hits[c], seen[c], strict=True)] for c in (0, 1)]
    evidence = [
        {1: math.log(right[1][j] / (1 - right[0][j])), -1: math.log((1 - right[1][j]) / right[0][j]), 0: 0.0}
        for j in range(rules)
    ]
    return Fitted(math.log(prior / (1 - prior)), evidence)


def fit_rules(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> Fitted:
    """Fits all documents' votes. At most 3 ** rules patterns, with their counts, reach the driver."""
    votes = measured.select(*[r.vote().alias(r.name) for r in rules]).groupBy(*[r.name for r in rules]).count()
    rows = sorted(votes.collect())
    return fit([(tuple(r)[: len(rules)], r["count"]) for r in rows], len(rules))


def _base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rate_documents(docs: DataFrame, *, threshold: float = 0.5, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: doc_id, the measures, a vote per rule, posterior, base_failed and kept.

    ``kept`` is false where a base limit fails (under 10 words, or over a fifth of the words in repeated windows), else
    whether the posterior of good quality reaches the threshold. A null text counts as empty: no rule votes, the base
    limit fails. Rows with null or repeated ids are rated like others; an empty table gives no rows.
    """
    measured = materialize(docs.select("doc_id", measures(F.col("text")).alias("m")).select("doc_id", "m.*"))
    fitted = fit_rules(measured, rules)
    voted = measured.withColumns({f"vote_{r.name}": r.vote() for r in rules} | {"base_failed": _base_failed()})
    posterior = fitted.posterior([F.col(f"vote_{r.name}") for r in rules])
    return voted.withColumn("posterior", posterior).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def keep_documents(docs: DataFrame, *, threshold: float = 0.5, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that ``rate_documents`` keeps, with all their columns.

    Measures are stored once for the fit and computed again beside the texts, so no text is shuffled.
    """
    fitted = fit_rules(materialize(docs.select(measures(F.col("text")).alias("m")).select("m.*")), rules)
    rated = docs.select(whole_row(docs).alias("row"), measures(docs["text"]).alias("m")).select("row", "m.*")
    good = fitted.posterior([r.vote() for r in rules]) >= threshold
    return rated.where(~_base_failed() & good).select("row.*")
