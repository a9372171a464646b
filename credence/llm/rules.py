"""Quality rules that vote, weighed by expectation-maximisation (weak supervision).

Every rule looks at one statistic of a text and votes good (1), bad (-1) or abstains
(0). Nobody says which documents are good: latent kinds of document, a good one and at most one bad one per
rule, are fitted to the vote patterns, with the rates at which each rule votes and abstains about each kind, and a document is
kept when the posterior probability of the good kind is at least a half. A rule's accuracy is free between a half and one: a
bad vote of a rule whose bad votes come alone and seldom is taken as its error and overruled, and several bad
votes that each might be errors are not.

Only the counts of distinct vote patterns reach the driver: at most 3 to the number
of rules, whatever the number of documents.

Defined cases: a null text has no words and fails the base check; so does an empty
one. Repeated rows get equal results. An empty table gives an empty result. Columns
of the input other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm.common import let, text_or_empty
from credence.session import stage

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
MIN_WORDS = 50
MAX_REPEATED = 0.5
#: Share of the documents that a kind of bad document must hold to be one.
LEAST_KIND = 0.005
#: Share of good documents on which a rule is believed to vote bad.
USUAL_ERROR = 0.003
#: Rounds before kinds that hold less are given up, and in all.
SETTLE, ROUNDS = 20, 120


@dataclass(frozen=True)
class Rule:
    """``value`` up to ``good`` is a good sign, from ``bad`` on a bad one."""

    name: str
    value: str
    good: float
    bad: float


#: Shares of the words or characters of a text; each is low in ordinary prose.
RULES = (
    Rule("symbols", "n_symbols / n_words", 0.03, 0.15),
    Rule("capitals", "n_capitals / word_chars", 0.25, 0.5),
    Rule("repeated_words", "n_repeat_words / n_words", 0.15, 0.4),
    Rule("repeated_lines", "n_dup_lines / n_lines", 0.15, 0.4),
    Rule("other_signs", "1 - n_letters / word_chars", 0.2, 0.4),
    Rule("long_words", "word_chars / n_words / 20", 0.6, 1.0),
    Rule("few_forms", "1 - n_forms / n_words", 0.75, 0.9),
)


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _repeat_words(words: Column) -> Column:
    """Words inside a three-word window that the text holds twice or more."""

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            twin = lambda e, j: F.coalesce(e["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(
                e["h"] == F.get(s, j + 1)["h"], F.lit(False)
            )
            return F.sort_array(F.transform(F.filter(s, twin), lambda e: e["i"]))

        return F.aggregate(
            let(ordered, repeated),
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last")),
            lambda a: a["n"],
        )

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        )

    none_twice = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))
    return F.when(F.size(words) < 3, 0).otherwise(let(windows(words), none_twice))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with the counts the rules look at; row-local, no shuffle."""
    text = text_or_empty(text_col)

    def counts(t: Column) -> Column:
        def of_words(w: Column) -> Column:
            return F.struct(
                F.size(w).alias("n_words"),
                F.size(F.array_distinct(w)).alias("n_forms"),
                _repeat_words(w).alias("n_repeat_words"),
            )

        def of_lines(lines: Column) -> Column:
            return F.struct(
                F.size(lines).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines")
            )

        whole = F.length(t)
        return F.struct(
            let(F.array_remove(F.split(t, SPACE), ""), of_words).alias("w"),
            let(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), of_lines).alias("l"),
            _without(t, SPACES).alias("word_chars"),
            (whole - _without(t, SYMBOLS)).alias("n_symbols"),
            F.length(F.regexp_replace(t, r"[^\p{L}]+", "")).alias("n_letters"),
            F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).alias("n_capitals"),
        )

    found = docs.select(F.col(id_col).alias("doc_id"), let(text, counts).alias("s"))
    names = {
        "n_words": "s.w.n_words", "word_chars": "s.word_chars", "n_symbols": "s.n_symbols",
        "n_dup_lines": "s.l.n_dup_lines", "n_repeat_words": "s.w.n_repeat_words", "n_lines": "s.l.n_lines",
        "n_forms": "s.w.n_forms", "n_letters": "s.n_letters", "n_capitals": "s.n_capitals",
    }
    return found.select("doc_id", *[F.col(path).cast("long").alias(name) for name, path in names.items()])


def votes(stats: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``_votes``, one character a rule: ``+`` good, ``-`` bad, ``0`` abstains."""

    def vote(rule: Rule) -> Column:
        value = F.expr(_guarded(rule.value))
        return F.when(value <= rule.good, "+").when(value >= rule.bad, "-").otherwise("0")

    return stats.withColumn("_votes", F.concat(*[vote(rule) for rule in rules]))


def _guarded(formula: str) -> str:
    """Divisions by an empty text's zero counts give null, hence an abstention."""
    parts = formula.split(" / ")
    return " / ".join([parts[0], *[f"nullif({x}, 0)" if x.isidentifier() else x for x in parts[1:]]])


@dataclass
class VoteModel:
    """Latent kinds of document: kind 0 is good, kind r + 1 is bad as rule r sees it (prior 0 where there is none)."""

    priors: list[float]
    alarm: list[list[float]]  # per kind and rule: probability that a vote is bad

    def kinds(self, pattern: str) -> list[float]:
        """Probability of each kind given the votes; an abstention says nothing."""
        logs = []
        for prior, alarm in zip(self.priors, self.alarm, strict=True):
            seen = [math.log(a if v == "-" else 1 - a) for v, a in zip(pattern, alarm, strict=True) if v != "0"]
            logs.append(math.log(prior) + sum(seen) if prior else -math.inf)
        top = max(logs)
        weights = [math.exp(x - top) for x in logs]
        return [w / sum(weights) for w in weights]

    def posterior(self, pattern: str) -> float:
        return self.kinds(pattern)[0]


def fit_votes(patterns: dict[str, int], n_rules: int, rounds: int = ROUNDS) -> VoteModel:
    """Expectation-maximisation over the counted patterns.

    Bad documents are bad in different ways, so there may be a latent kind of bad document for each rule; a rule's accuracies
    are its rates of right votes about the good kind and about its own, each free between a half and one, which keeps
    the kinds from changing places. Votes that fall together tell kinds apart; lone ones could be either a kind or errors, so
    it is believed, with the weight of the corpus, that a rule errs about ``USUAL_ERROR`` of the good documents. All other
    pseudo-counts stand for ten documents. After ``SETTLE`` rounds a kind that
    holds less than ``LEAST_KIND`` of the documents is given up: the bad votes it was made of are then explained by
    the other kinds, or as errors of the rule.
    """
    kinds = range(n_rules + 1)

    def guess(k: int, r: int) -> float:
        return USUAL_ERROR if k == 0 else 0.9 if k == r + 1 else 0.1

    start = [0.85, *[0.15 / n_rules] * n_rules]
    model = VoteModel(start, [[guess(k, r) for r in range(n_rules)] for k in kinds])
    total = sum(patterns.values())
    for step in range(rounds if total else 0):
        share = {p: model.kinds(p) for p in patterns}
        mass = [sum(n * share[p][k] for p, n in patterns.items()) for k in kinds]
        alive = [k == 0 or (model.priors[k] > 0 and (step < SETTLE or mass[k] >= LEAST_KIND * total)) for k in kinds]
        weight = [(mass[k] + 10 * start[k]) * alive[k] for k in kinds]
        alarm = []
        for k in kinds:
            rates = []
            for r in range(n_rules):
                cast = sum(n * share[p][k] for p, n in patterns.items() if p[r] != "0")
                bad = sum(n * share[p][k] for p, n in patterns.items() if p[r] == "-")
                belief = total if k == 0 else 10
                rate = (bad + belief * guess(k, r)) / (cast + belief)
                low, high = (1e-4, 0.5) if k == 0 else (0.5, 1 - 1e-4) if k == r + 1 else (1e-4, 1 - 1e-4)
                rates.append(min(high, max(low, rate)))
            alarm.append(rates)
        model = VoteModel([w / sum(weight) for w in weight], alarm)
    return model


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """Statistics, base check, posterior probability and verdict of every document."""
    voted = stage(votes(statistics(docs, id_col, text_col), rules), "rule-votes")
    counted = {r["_votes"]: r["n"] for r in voted.groupBy("_votes").agg(F.count("*").alias("n")).collect()}
    model = fit_votes(counted, len(rules))
    posteriors = {p: model.posterior(p) for p in counted}
    # bounded by the number of patterns, not by the documents
    known = docs.sparkSession.createDataFrame(list(posteriors.items()), "_p string, posterior double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 100 * MAX_REPEATED * F.col("n_words"))
    judged = voted.join(F.broadcast(known), voted["_votes"] == known["_p"], "left")
    return judged.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)
    ).drop("_p", "_votes")
