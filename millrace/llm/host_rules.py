"""Quality rules with verdicts per host, in built-in functions only.

Every text is measured by itself. A host's rate of failures of each rule is shrunk towards all
hosts' mean by a beta prior. Its mean is the share of all documents that fail; its strength
comes from how much more the hosts' rates differ than draws of their sizes from one common rate
would (moments of the beta-binomial distribution, hosts weighted by documents). So hosts of one
document each, which tell nothing about differences between hosts, are shrunk altogether. A host
is refused if a shrunk rate exceeds that rule's
limit, and its verdict is joined back to its documents. Hosts are summed before anything is
shuffled, so one that holds a third of all rows costs no more than another. The measures are
written once, without texts, and read by both the sums and the join; Spark broadcasts the hosts
only if they are below its own size limit, and otherwise splits a frequent host's rows.

Defined results: a null or empty text has no words and fails the base rule; rows without a
source form a host of their own; repeated rows count each; an empty table gives no rows; other
columns are ignored, or kept if named in `keep`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: Least words, and the percentage of words in repeated 3-word windows above which a text fails.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Rule: (its condition on the measures, the limit of a host's shrunk rate).
RULES = {
    "base": ("base_failed", 0.8),
    "word_length": ("n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 12 * n_words)", 0.6),
    "symbols": ("10 * n_symbols > n_words", 0.6),
    "lines": ("10 * n_dup_lines > 3 * n_lines AND n_lines > 0", 0.6),
}


#: The least and the largest strength of the prior, in documents.
WEAKEST, STRONGEST = 0.001, 1_000_000.0

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(docs: DataFrame, *keep: str) -> DataFrame:
    """The named columns of docs(text, source, ...), its host and line count, and MEASURES.

    Words in repeated 3-word windows: the windows of a text are sorted with their places, so that
    equal ones lie side by side; the places of those with an equal neighbour, and the two places
    after each, are counted once each. Texts whose windows all have different hashes skip that.
    """
    text = F.coalesce("text", F.lit(""))
    split = docs.select(
        *keep,
        F.coalesce("source", F.lit("")).alias("host"),
        F.expr(rf"filter(split(coalesce(text, ''), r'{SPACE}+'), w -> w != '')").alias("words"),
        F.expr(rf"filter(split(coalesce(text, ''), '\n'), x -> x RLIKE r'{WORD}')").alias("lines"),
        F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    ).withColumn("n_words", F.size("words").cast("long"))
    hashed = split.withColumn(
        "hashes",
        F.expr(
            "transform(slice(words, 1, greatest(size(words) - 2, 0)),"
            " (x, i) -> xxhash64(x, words[i + 1], words[i + 2]))"
        ),
    )
    ordered = hashed.withColumn(
        "windows",
        F.expr(
            "CASE WHEN size(array_distinct(hashes)) < size(hashes) THEN"
            " sort_array(transform(hashes, (x, i) -> struct("
            "words[i] AS a, words[i + 1] AS b, words[i + 2] AS c, i AS place))) END"
        ),
    )
    alike = "windows[{0}].a = x.a AND windows[{0}].b = x.b AND windows[{0}].c = x.c"
    places = ordered.withColumn(
        "places",
        F.expr(
            "filter(transform(windows, (x, j) -> CASE"
            f" WHEN j > 0 AND {alike.format('greatest(j - 1, 0)')} THEN x.place"
            f" WHEN j < size(windows) - 1 AND {alike.format('least(j + 1, size(windows) - 1)')}"
            " THEN x.place END), i -> i IS NOT NULL)"
        ),
    )
    return places.select(
        *keep,
        "host",
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "CAST(coalesce(size(array_distinct(flatten("
            "transform(places, i -> array(i, i + 1, i + 2))))), 0) AS BIGINT)"
        ).alias("n_repeat_words"),
    )


def beta_prior(hosts: int, n: int, squares: float, failed: int, failed_squares: float) -> tuple[float, float]:
    """Mean and strength, in documents. squares: of the hosts' sizes; failed_squares: each host's
    failures squared over its size."""
    mean = failed / n if n else 0.0
    room = n - hosts - squares / n + 1 if n else 0.0
    if not 0 < mean < 1 or room <= 0:
        return mean, STRONGEST
    # What the rates' spread has beyond chance, as a share of the most it could have.
    share = ((failed_squares - mean * mean * n) / (mean * (1 - mean)) - (hosts - 1)) / room
    return mean, min(max(1 / share - 1, WEAKEST), STRONGEST) if share > 0 else STRONGEST


def with_verdicts(docs: DataFrame, *keep: str) -> DataFrame:
    """The named columns of docs(text, source, ...), MEASURES, base_failed and kept."""
    measured = (
        measures(docs, *keep)
        .withColumn(
            "base_failed",
            F.expr(f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words"),
        )
        .checkpoint()
    )
    failures = {name: F.count_if(F.expr(rule)) for name, (rule, _) in RULES.items()}
    hosts = measured.groupBy("host").agg(
        F.count("*").alias("n"), *[count.alias(name) for name, count in failures.items()]
    )
    n = F.col("n").cast("double")
    # Three numbers and two for each rule; the only thing that the driver sees.
    sums = hosts.agg(
        F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum(n * n).alias("squares"),
        *[F.sum(name).alias(name) for name in RULES],
        *[F.sum(F.col(name).cast("double") * F.col(name) / n).alias(f"{name}_squares") for name in RULES],
    ).first()
    refused = F.lit(False)
    for name, (_, limit) in RULES.items():
        mean, strength = beta_prior(
            sums["hosts"], sums["n"] or 0, sums["squares"] or 0.0, sums[name] or 0, sums[f"{name}_squares"] or 0.0
        )
        shrunk = (F.col(name) + mean * strength) / (F.col("n") + strength)
        refused = refused | (shrunk > limit)
    return (
        measured.join(hosts.select("host", refused.alias("refused")), "host")
        .withColumn("kept", ~F.col("base_failed") & ~F.col("refused"))
        .select(*keep, *MEASURES, "base_failed", "kept")
    )
