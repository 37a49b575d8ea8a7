"""Quality rules whose limits follow the host: failures per host, shrunk, joined back.

Rules look at one document. Their failures are counted per host, and each host's rate is shrunk
towards the rate of all hosts by a beta prior whose weight is estimated from the spread between
hosts, so that a host with three documents is not judged by three documents. The shrunk rate
gives the host's verdict, and the verdict says which limits its documents have to keep:

* ``trusted``: only the wide limits;
* ``strict``: the tight limits;
* ``blocked``: none of its documents is kept.

Everything is built-in column functions; the counts of a document are taken in one scan of the
texts and written once, a few dozen bytes a document, so that texts are never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.scratch import written
from .common import pick

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
WINDOW = 8  # words
FEW_WORDS = 20
REPEATED = 30  # percent of words


@dataclass(frozen=True)
class Rule:
    """A document fails if ``100 * amount > limit * of``, or below ``least`` if that is given."""

    amount: str
    of: str
    tight: int
    wide: int
    least: tuple[int, int] | None = None  # (tight, wide)

    def fails(self, limit: int) -> Column:
        """``limit`` 0 is the tight one, 1 the wide one."""
        share = 100 * F.col(self.amount)
        found = share > (self.tight, self.wide)[limit] * F.col(self.of)
        if self.least:
            found = found | (share < self.least[limit] * F.col(self.of))
        return found


RULES = (
    Rule("n_symbols", "n_words", 10, 50),
    Rule("n_dup_lines", "n_lines", 30, 60),
    Rule("word_chars", "n_words", 1000, 1500, (300, 200)),
)
STRICT, BLOCKED = 0.25, 0.5  # shrunk failure rates from which a host is held to that verdict


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _paired(parts: Column, width: int) -> Column:
    """The hash of each element with the one ``width`` places on; the last have none."""
    later = F.slice(parts, width + 1, F.greatest(F.size(parts) - width, F.lit(0)))
    return F.zip_with(parts, later, lambda a, b: F.xxhash64(a, b))


def _repeated_words(words: Column) -> Column:
    """Words that lie in a window found twice or more; the first finding counts as well.

    Windows are compared by 64-bit hashes, those of 2, 4 and 8 words built from one another.
    Only texts with a repeated window sort them.
    """
    windows = _let(_let(_paired(words, 1), lambda w: _paired(w, 2)), lambda w: _paired(w, 4))
    windows = F.slice(windows, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(
            F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
        )

        def places(s: Column) -> Column:
            twice = lambda x, i: (
                (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
            )
            return F.sort_array(F.transform(F.filter(s, twice), lambda x: x["at"]))

        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(
            _let(placed, places),
            start,
            lambda acc, at: F.struct(
                at.alias("last"),
                (acc["n"] + F.least(F.lit(WINDOW), at - acc["last"])).cast("bigint").alias("n"),
            ),
            lambda acc: acc["n"],
        )

    return _let(
        windows,
        lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(
            F.lit(0).cast("bigint")
        ),
    )


def measured(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source"
) -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words).

    One row per row of ``docs``; a null text counts as empty, all its counts are 0. ``n_lines``
    are the lines with a word.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        pick(docs, doc_id=id_col, text=text_col, host=host_col)
        .withColumn("text", text)
        .select(
            "doc_id",
            "host",
            F.array_remove(F.split("text", SPACE), "").alias("words"),
            lines.alias("lines"),
            (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).alias("symbols"),
        )
        .select(
            "doc_id",
            "host",
            F.size("words").cast("bigint").alias("n_words"),
            F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
            F.col("symbols").cast("bigint").alias("n_symbols"),
            F.size("lines").cast("bigint").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines")))
            .cast("bigint")
            .alias("n_dup_lines"),
            _repeated_words(F.col("words")).alias("n_repeat_words"),
        )
    )


def with_failures(counts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``base_failed``, ``fails_tight`` and ``fails_wide``."""
    base = (F.col("n_words") < FEW_WORDS) | (
        100 * F.col("n_repeat_words") > REPEATED * F.col("n_words")
    )
    any_of = lambda limit: F.array_max(F.array(F.lit(False), *[r.fails(limit) for r in rules]))
    return counts.withColumns(
        {"base_failed": base, "fails_tight": any_of(0), "fails_wide": any_of(1)}
    )


def host_verdicts(
    failures: DataFrame, strict: float = STRICT, blocked: float = BLOCKED
) -> DataFrame:
    """(host, n_docs, n_failed, rate, verdict), one row per host.

    ``rate`` is the posterior mean under a beta prior with the mean of all hosts; the prior's
    weight comes from the moments of the hosts' rates. Where the hosts differ no more than
    chance makes them, or there is one host, the prior weighs as much as all documents. A
    document fails if it breaks the base rules or a tight limit. Documents without a host are no
    host: they get the mean of all, see ``judged``. An empty table gives no rows.
    """
    failed = F.col("base_failed") | F.col("fails_tight")
    hosts = failures.groupBy("host").agg(
        F.count("*").alias("n_docs"), F.count_if(failed).alias("n_failed")
    )
    n, f = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    sums = hosts.agg(
        F.sum("n_docs").cast("double").alias("_n"),
        F.sum("n_failed").cast("double").alias("_f"),
        F.sum(F.col("n_docs").cast("decimal(19,0)") * F.col("n_docs")).cast("double").alias("_nn"),
        F.sum(f * f / n).alias("_ffn"),
        F.count_if(F.col("host").isNotNull()).alias("_hosts"),
    ).select(
        F.col("_n"),
        (F.col("_f") / F.col("_n")).alias("_p"),
        F.col("_nn"),
        (F.col("_ffn") - F.col("_f") * F.col("_f") / F.col("_n")).alias("_spread"),
        F.col("_hosts"),
    )
    p, many = F.col("_p"), F.col("_hosts") - 1.0
    chance = p * (1 - p)
    # Share of the variance of a document's failure that lies between hosts
    between = F.try_divide(
        F.col("_spread") - chance * many,
        chance * (F.col("_n") - F.col("_nn") / F.col("_n") - many),
    )
    weight = F.when(between > 0, F.least(F.greatest(1 / between - 1, F.lit(0.0)), F.col("_n")))
    prior = sums.select(p.alias("_p"), F.coalesce(weight, F.col("_n")).alias("_weight"))
    rate = F.when(F.col("host").isNull(), F.col("_p")).otherwise(
        (F.col("n_failed") + F.col("_p") * F.col("_weight")) / (F.col("n_docs") + F.col("_weight"))
    )
    verdict = (
        F.when(F.col("rate") >= blocked, "blocked")
        .when(F.col("rate") >= strict, "strict")
        .otherwise("trusted")
    )
    # The prior is one row
    return (
        hosts.join(F.broadcast(prior))
        .select("host", "n_docs", "n_failed", rate.alias("rate"))
        .withColumn("verdict", verdict)
    )


def judged(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    rules: tuple[Rule, ...] = RULES,
    strict: float = STRICT,
    blocked: float = BLOCKED,
) -> DataFrame:
    """Each row's counts, ``base_failed``, its host's ``host_rate`` and ``host_verdict``, ``kept``.

    One row per row of ``docs``, repeated rows and rows with a null id included; other columns
    are not looked at. A null text counts as empty and fails the base rules. Rows with a null
    host share the rate of the whole table, so they are never all tied to one host's fate. An
    empty table gives no rows.
    """
    counts = with_failures(
        written(measured(docs, id_col, text_col, host_col), "host_counts"), rules
    )
    hosts = written(host_verdicts(counts, strict, blocked), "host_verdicts")
    found = hosts.select(
        F.col("host").alias("_host"), F.col("rate").alias("host_rate"),
        F.col("verdict").alias("host_verdict"),
    )
    # A hot host is split by the skew handling of the join, if the hosts are too many to be sent
    joined = counts.join(found, F.col("host").eqNullSafe(F.col("_host")), "left")
    kept = (
        ~F.col("base_failed")
        & ~F.col("fails_wide")
        & (F.col("host_verdict") != "blocked")
        & ~((F.col("host_verdict") == "strict") & F.col("fails_tight"))
    )
    return joined.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
        "n_repeat_words", "base_failed", "host_rate", "host_verdict", kept.alias("kept"),
    )
