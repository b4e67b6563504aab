"""Quality rules with verdicts by host, in DataFrame functions alone.

Each document is held against five rules. For each rule, the failures of the hosts are taken as draws from one beta-binomial distribution; a host's own
rate is shrunk towards it, the more the fewer documents the host has; and a host whose rate stands out by more than chance is rejected as a whole."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SYMBOLS = "#*$%&|<>"
#: A document fails with fewer words, or with more than so many hundredths of its words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 10, 20
WINDOW = 5
#: Bounds of the prior's strength, in documents.
STRENGTH = (1.0, 1000.0)
#: A host's rate is rejected above the prior's mean and so many standard deviations, but not below the first and always above the second of these
#: limits; and only if the rate is above by so many standard deviations of its own (one-sided 95 %).
SPREAD, LIMITS, SURE = 2.0, (0.3, 0.6), 1.645


def rules() -> dict[str, Column]:
    """The failures that are counted by host, from the figures of `features`; the first two are the base ones."""
    n = F.col("n_words")
    return {
        "short": n < LEAST_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MOST_REPEATED * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "lengths": (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 10 * n),
    }


def features(docs: DataFrame, host: str) -> DataFrame:
    """doc_id, host and the figures of each row of docs: n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed.

    Words lie between ASCII white space; a null text has none. Windows of five words are compared by a 64-bit hash of their words; a text's hashes
    are sorted only if some are equal. All is within a row: nothing is shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.col(host).cast("string").alias("host"), text.alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(C.SPACE_WORD))
    rows = rows.select("doc_id", "host", "t", C.words(F.col("t"), C.SPACE_WORD).alias("w"), lines.alias("l"))
    length = lambda removed: F.length(F.translate("t", removed, ""))
    grams = F.transform(C.positions(F.size("w") - (WINDOW - 1)), lambda i: F.xxhash64(*[C.at(F.col("w"), i + j) for j in range(WINDOW)]))
    figures = {
        "n_words": F.size("w"),
        "word_chars": length(C.SPACES),
        "n_symbols": F.length("t") - length(SYMBOLS),
        "n_dup_lines": F.size("l") - F.size(F.array_distinct("l")),
        "n_lines": F.size("l"),
    }
    rows = rows.select("doc_id", "host", *[c.cast("long").alias(n) for n, c in figures.items()], grams.alias("g"))
    keep = ["doc_id", "host", *figures]
    repeated = F.size(F.array_distinct("g")) < F.size("g")
    rows = rows.select(*keep, F.when(repeated, F.array_sort(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))).alias("o"))
    same = lambda x, i: F.coalesce(C.at(F.col("o"), i)["h"] == x["h"], F.lit(False))
    twice = F.filter("o", lambda x, i: same(x, i - 1) | same(x, i + 1))
    rows = rows.select(*keep, F.sort_array(F.transform(twice, lambda x: x["p"])).alias("p"))
    gaps = F.transform("p", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(C.at(F.col("p"), i + 1) - x, F.lit(WINDOW))))
    rows = rows.select(*keep, F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"))
    return rows.withColumn("base_failed", rules()["short"] | rules()["repeats"])


@dataclass
class Prior:
    """A beta distribution by its mean and strength (alpha + beta), and the limit of a host's rate."""

    mean: float
    strength: float
    limit: float


def prior(hosts: int, docs: float, failed: float, squares: float, spread: float) -> Prior:
    """The beta-binomial distribution that fits hosts' failures by moments, weighted by their documents. squares: the sum of n * n over the hosts;
    spread: that of failed * failed / n.

    The spread of the rates beyond what chance gives within hosts tells the strength. Where it cannot be told (one host, or hosts of one document
    each), and where rates vary no more than by chance, the strength is the highest: then hosts are not told apart by few documents."""
    if not docs:
        return Prior(0.5, STRENGTH[0], LIMITS[1])
    mean = min(max(failed / docs, 1e-6), 1 - 1e-6)
    told = docs - squares / docs - (hosts - 1)
    share = ((spread - failed * failed / docs) / (mean * (1 - mean)) - (hosts - 1)) / told if told > 1e-9 * docs else 0.0
    share = min(max(share, 1 / (1 + STRENGTH[1])), 1 / (1 + STRENGTH[0]))
    limit = mean + SPREAD * (mean * (1 - mean) * share) ** 0.5
    return Prior(mean, 1 / share - 1, min(LIMITS[1], max(LIMITS[0], limit)))


def priors(hosts: DataFrame) -> dict[str, Prior]:
    """The prior of each rule from hosts(n, <rule>...); one row of sums comes to the driver."""
    n = F.col("n").cast("double")
    sums = [F.count("*").alias("hosts"), F.sum(n).alias("docs"), F.sum(n * n).alias("squares")]
    for name in rules():
        k = F.col(name).cast("double")
        sums += [F.sum(k).alias(f"{name}_failed"), F.sum(k * k / n).alias(f"{name}_spread")]
    row = hosts.agg(*sums).first()
    return {name: prior(row["hosts"], row["docs"] or 0.0, row[f"{name}_failed"] or 0.0, row["squares"] or 0.0, row[f"{name}_spread"] or 0.0) for name in rules()}


def verdicts(hosts: DataFrame) -> DataFrame:
    """(host, rates, host_rejected) of hosts(host, n, <rule>...). rates: a struct with the posterior mean of each rule's rate."""
    rates, rejected = [], F.lit(False)
    for name, p in priors(hosts).items():
        size = F.col("n") + F.lit(p.strength)
        rate = (F.col(name) + F.lit(p.mean * p.strength)) / size
        rejected = rejected | (rate - F.lit(SURE) * F.sqrt(rate * (1 - rate) / (size + 1)) > F.lit(p.limit))
        rates.append(rate.alias(name))
    return hosts.select("host", F.struct(*rates).alias("rates"), rejected.alias("host_rejected"))


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """The features of each row of docs(doc_id, text, <host>), with host_rejected and kept.

    A host is rejected if, for one of `rules`, its shrunk rate of documents that fail is above the limit by more than chance. kept is false for
    documents that fail and for all documents of a rejected host. A null host is a host. Null and empty texts have no words and fail. Repeated rows
    each count and stay. An empty table gives no rows. Other columns are not read.

    Texts are read once; figures of some 80 bytes a document are kept for the join with the hosts, which are broadcast while they are few. Failures
    are summed up by host in each task, so that a hot host costs what any other does."""
    rows = C.materialize(features(docs, host))
    counts = [F.sum(c.cast("long")).alias(name) for name, c in rules().items()]
    hosts = C.materialize(rows.groupBy("host").agg(F.count("*").alias("n"), *counts))
    judged = C.materialize(verdicts(hosts)).select(F.col("host").alias("h"), "host_rejected")
    kept = ~F.col("base_failed") & ~F.col("host_rejected")
    rows = rows.join(C.sized(judged), F.col("host").eqNullSafe(F.col("h")))
    return rows.select(*[c for c in rows.columns if c not in ("host", "h", "n_lines", "host_rejected")], "host_rejected", kept.alias("kept"))
