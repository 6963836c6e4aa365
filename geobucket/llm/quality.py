"""Quality rules as a short-circuit cascade, with built-in functions only.

Each rule is a feature of the text and a condition on it that rejects a
document. On a sample, the CPU time of every rule is measured from the raw text
on, and its rejections counted; rules are then tried in the order of rejections
per cost. The features are nested: each is computed only for documents that all
earlier rules let pass, so a document that a cheap rule rejects costs no more
than that rule. The order changes the work, never the verdict: a document is
rejected if any rule rejects it.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, spread, stored

WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Rows, in the mean, of the sample on which costs and selectivities are estimated, and how often each is timed.
SAMPLE_ROWS, RUNS = 1000, 4
#: CPU seconds for the sample below which costs are noise and count as equal.
NOISE = 1 / 16
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it and wherever the optimiser moves it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text; an empty array for null and for white space only."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def content_lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(content_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of every run of WINDOW words, in time linear in their number: a slice copies its whole array, so there is one for each place in a run."""
    runs = F.size(words) - (WINDOW - 1)
    zipped = F.arrays_zip(*[F.slice(words, k + 1, runs) for k in range(WINDOW)])
    return F.when(runs > 0, F.transform(zipped, lambda x: F.xxhash64(x))).otherwise(F.array().cast("array<bigint>"))


def repeated_words(words: Column) -> Column:
    """Words that lie in windows found twice or more.

    Only texts with a repeated window sort their hashes; sorted positions
    p, q, ... of such windows cover 8 + min(8, q - p) + ... words.
    """
    pair = lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])).otherwise(F.array().cast("array<int>"))

    def covered(windows: Column) -> Column:
        order = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # neighbours with equal hashes give both positions; the last one meets null, which equals nothing
        twice = let(order, lambda o: F.flatten(F.zip_with(o, F.slice(o, 2, F.size(o)), pair)))
        none = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n"), i.alias("last"))
        return F.aggregate(F.array_sort(F.array_distinct(twice)), none, step, lambda s: s["n"])

    return let(window_hashes(words), lambda w: F.when(F.size(w) == F.size(F.array_distinct(w)), 0).otherwise(covered(w))).cast("long")


@dataclass(frozen=True)
class Rule:
    """Rejects where the condition on its feature holds; null counts as false.

    `feature` computes a value from a text and its words.
    """

    name: str
    feature: Callable[[Column, Column], Column]
    rejects: Callable[[Column, Column, Column], Column]


def _chars(words: Column) -> Column:
    return F.char_length(F.array_join(words, "")).cast("long")


def _count(words: Column) -> Column:
    return F.size(words).cast("long")


def default_rules() -> list[Rule]:
    """Lenient rules: junk goes, prose, lists and tables stay. A condition takes the feature, the text and its words."""
    some = lambda w: F.greatest(_count(w), F.lit(1))
    return [
        Rule("few_words", lambda t, w: _count(w), lambda x, t, w: x < LEAST_WORDS),
        Rule("repeated_windows", lambda t, w: repeated_words(w), lambda x, t, w: 100 * x > MOST_REPEATED * _count(w)),
        Rule("word_length", lambda t, w: _chars(w) / some(w), lambda x, t, w: ~x.between(2, 25)),
        Rule("symbols", lambda t, w: F.regexp_count(t, F.lit(SYMBOLS)), lambda x, t, w: x > some(w)),
        Rule("duplicate_lines", lambda t, w: duplicate_lines(t), lambda x, t, w: 2 * x > F.size(F.split(t, "\n"))),
        Rule("few_letters", lambda t, w: 2 * F.char_length(F.regexp_replace(t, r"[^\p{L}]+", "")) - _chars(w), lambda x, t, w: x < 0),
        Rule("replacement_chars", lambda t, w: 100 * (F.char_length(t) - F.char_length(F.regexp_replace(t, "\ufffd+", ""))) - F.char_length(t), lambda x, t, w: x > 0),
    ]


class Cascade:
    """Rules in the order in which they are tried."""

    def __init__(self, rules: Sequence[Rule], estimates: dict[str, tuple[float, float]] | None = None):
        self.rules, self.estimates = list(rules), estimates or {}

    @classmethod
    def fit(cls, docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> Cascade:
        """Orders rules by rejected share per CPU second, measured on a random sample of about sample_rows rows of docs.

        The sample is written by the tasks that read it, without a shuffle. A
        rule's cost is the least executor CPU time of RUNS jobs that apply it
        to the sample, less that of jobs that only find the words, which all
        rules share. It is rounded to a power of two, NOISE at least, so that
        noise hardly changes the order; equal rates keep the given order.
        """
        rules = default_rules() if rules is None else list(rules)
        spark = docs.sparkSession
        n = docs.count()
        sample = stored(docs.select("text").sample(min(1.0, sample_rows / max(1, n)), seed=5), "sample")
        size, text = max(1, sample.count()), F.coalesce("text", F.lit(""))

        def cpu(rejects: Column) -> tuple[int, float]:
            group, before = f"quality-{uuid.uuid4().hex}", spark.sparkContext.getLocalProperty("spark.jobGroup.id")
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", group)
            try:
                bad = sample.agg(F.count_if(rejects)).first()[0]
            finally:
                spark.sparkContext.setLocalProperty("spark.jobGroup.id", before)
            return bad, _cpu_seconds(spark, group)

        tried = [let(words_of(text), lambda w: F.size(w) < 0), *[Cascade([r]).rejected_by(text).isNotNull() for r in rules]]
        runs = [[cpu(x) for x in tried] for _ in range(RUNS)]  # the first of them also compile
        idle, *least = [min(r[k][1] for r in runs) for k in range(len(tried))]
        estimates = {r.name: (runs[0][k + 1][0] / size, 2.0 ** round(math.log2(max(least[k] - idle, NOISE)))) for k, r in enumerate(rules)}
        dropped(spark, sample.scratch)
        return cls(sorted(rules, key=lambda r: -(estimates[r.name][0] + 1e-6) / estimates[r.name][1]), estimates)

    def verdict(self, text: Column, words: Column) -> Column:
        """The first rule that rejects, null if none does; a later rule's feature is computed only if no earlier rule holds."""
        out: Column | None = None
        for rule in self.rules:
            bad = rule.rejects(rule.feature(text, words), text, words)
            out = F.when(bad, rule.name) if out is None else out.when(bad, rule.name)
        return F.lit(None).cast("string") if out is None else out

    def rejected_by(self, text: Column) -> Column:
        """The verdict on a text that is not null; its words are found once."""
        return let(words_of(text), lambda w: self.verdict(text, w))


def _cpu_seconds(spark: SparkSession, group: str) -> float:
    """CPU time of all stages of a job group, as Spark's status store has it."""
    context, total = spark.sparkContext, 0
    context._jsc.sc().listenerBus().waitUntilEmpty()
    for job in context.statusTracker().getJobIdsForGroup(group):
        for stage in context.statusTracker().getJobInfo(job).stageIds:
            total += context._jsc.sc().statusStore().lastStageAttempt(stage).executorCpuTime()
    return total / 1e9


def quality_documents(docs: DataFrame, cascade: Cascade | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    The base columns are owed for every row; rules on them use them as they
    are, the others are computed only where the base holds and no earlier rule
    rejects. Null and empty texts have no words and fail the base; repeated
    rows are judged alike; other columns are ignored. An empty table gives no
    rows.
    """
    docs = spread(docs)
    cascade = cascade or Cascade.fit(docs)
    # __words is used by several expressions, so Spark computes it once
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("__text"), words_of(docs["text"]).alias("__words"))
    text, words = F.col("__text"), F.col("__words")
    rows = rows.select("doc_id", "__text", "__words", _count(words).alias("n_words"), _chars(words).alias("word_chars"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), duplicate_lines(text).alias("n_dup_lines"), repeated_words(words).alias("n_repeat_words"))
    had = {"few_words": F.col("n_words"), "repeated_windows": F.col("n_repeat_words"), "symbols": F.col("n_symbols"), "duplicate_lines": F.col("n_dup_lines")}
    rules = [Rule(r.name, (lambda t, w, x=had[r.name]: x) if r.name in had else r.feature, r.rejects) for r in cascade.rules]
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    kept = F.when(failed, False).otherwise(Cascade(rules).verdict(text, words).isNull())
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept"))


def good_documents(docs: DataFrame, cascade: Cascade | None = None) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns, whatever the names of these.

    Null and empty texts are rejected; repeated rows stay or go together. Only
    the features that the cascade reaches are computed.
    """
    cascade = cascade or Cascade.fit(docs)
    return docs.filter(cascade.rejected_by(F.coalesce(docs["text"], F.lit(""))).isNull())
