"""Quality rules judged by document and by host.

A document fails the base rules if it has fewer than 50 words, or if more than half of
its words stand in 3-word windows that occur twice or more in it. Hosts (the `source`
column) are judged by the share of their documents that fail each rule: counts of
failures are totalled by host, their rates are shrunk towards the mean of all hosts by a
beta prior fitted to the hosts themselves, and a host is rejected if a shrunk rate,
less two standard deviations of its posterior, is above HOST_LIMIT. A small or unlucky
host is therefore never rejected, and clean documents of ordinary hosts stay.

Built of column functions only. Null and empty texts have no words and fail; a null
source is a host of its own; repeated rows count as often as they occur; an empty table
gives an empty result. Columns that are not used may have any name: they travel in a
struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from thresher.llm.registry import query, table
from thresher.operators.ordering import join_small
from thresher.session import pinned

LEAST_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS_PERCENT = 10
DUP_LINES_PERCENT = 30
HOST_LIMIT = 0.5
BLANKS = " \t\n\x0b\f\r"
RULES = ("base", "symbols", "dup_lines")


def words(text):
    """The words of a text; none for a null or a blank one."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def window_hashes(ws):
    """The hash of each 3-word window, in order."""
    at = lambda i, k: F.get(ws, i + k)
    return F.when(F.size(ws) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2))))


def repeated_starts(placed):
    """Where windows begin that occur again, given (hash, start) sorted by hash."""
    again = lambda k: (F.get(placed, k)["h"] == F.get(placed, k - 1)["h"]) | (F.get(placed, k)["h"] == F.get(placed, k + 1)["h"])
    spots = F.filter(F.sequence(F.lit(0), F.size(placed) - 1), lambda k: F.coalesce(again(k), F.lit(False)))
    return F.sort_array(F.transform(spots, lambda k: F.get(placed, k)["i"]))


def measured(documents: DataFrame, keep=()) -> DataFrame:
    """The base figures of each document; `keep` columns travel in the struct `row`.

    Each step is a projection of its own that later ones use more than once, so Spark
    evaluates it once.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None).cast("string")
    whole = documents.select("doc_id", F.col("source").alias("host"), F.col("text"), row.alias("row"))
    split = whole.withColumn("ws", words(F.col("text")))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    figures = split.select(
        "doc_id", "host", "row", window_hashes(F.col("ws")).alias("hashes"), F.size("ws").cast("long").alias("n_words"),
        F.length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count("text", F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"), lines.alias("lines"))
    counted = figures.withColumns({
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        # Only texts in which a window occurs twice are looked at more closely.
        "placed": F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(
            F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))}).drop("hashes", "lines")
    starts = counted.withColumn("starts", F.when(F.col("placed").isNotNull(), repeated_starts(F.col("placed")))).drop("placed")
    gaps = F.transform("starts", lambda p, j: F.least(F.lit(3), p - F.coalesce(F.get("starts", j - 1), F.lit(-3))))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, g: a + g), F.lit(0)).cast("long")
    return starts.withColumn("n_repeat_words", covered).drop("starts").withColumn("base_failed", base_failed())


def base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def host_failures(figures: DataFrame) -> DataFrame:
    """(host, n, one column per rule): how many of a host's n documents fail it."""
    fails = {"base": F.col("base_failed"), "symbols": 100 * F.col("n_symbols") > SYMBOLS_PERCENT * F.col("word_chars"),
             "dup_lines": 100 * F.col("n_dup_lines") > DUP_LINES_PERCENT * F.col("n_lines")}
    return figures.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(fails[r].cast("long")).alias(r) for r in RULES])


def host_verdicts(hosts: DataFrame) -> DataFrame:
    """(host, n, rejected): failures by rule and host of n documents, shrunk by a beta prior.

    The prior has the mean m and the spread v of the hosts' rates: its two parameters add
    up to m (1 - m) / v - 1. With one host, or equal rates, it is the strongest allowed.
    """
    rates = hosts.agg(*[f(F.col(r) / F.col("n")).alias(f"{r}_{name}") for r in RULES for name, f in (("mean", F.avg), ("spread", F.var_pop))])
    prior = rates.select(F.struct(*rates.columns).alias("prior"))
    judged = hosts.withColumn("prior", prior.scalar())
    bad = F.lit(False)
    for r in RULES:
        m, v = F.col(f"prior.{r}_mean"), F.col(f"prior.{r}_spread")
        strength = F.least(F.lit(1000.0), F.greatest(F.lit(1.0), m * (1 - m) / F.greatest(v, F.lit(1e-9)) - 1))
        total = F.col("n") + strength
        rate = (F.col(r) + m * strength) / total
        bad = bad | (rate - 2 * F.sqrt(rate * (1 - rate) / (total + 1)) > HOST_LIMIT)
    return judged.select("host", "n", bad.alias("rejected"))


def with_verdicts(figures: DataFrame, hosts: DataFrame) -> DataFrame:
    """Adds whether a document is kept. Rows of hot hosts are not moved for that, nor any as long as the verdicts are few."""
    rows = join_small(figures, host_verdicts(hosts), ["host"], "n", "left")
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False)))


def judged(documents: DataFrame) -> DataFrame:
    """The figures of each document and whether it is kept.

    The figures are written once: hosts are totalled from them and joined back to them.
    """
    figures = pinned(measured(documents))
    return with_verdicts(figures, host_failures(figures))


def kept_documents(documents: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns only.

    No text is written on the way: the counts of failures by host are, and the base rules are applied again to the texts
    as they are read.
    """
    hosts = pinned(host_failures(measured(documents)))
    # Said to be nondeterministic, or the filter would go down through the steps and repeat them inside it.
    failed = F.when(F.monotonically_increasing_id() >= 0, F.col("base_failed"))
    rows = measured(documents, documents.columns).select("host", "row", failed.alias("base_failed"))
    return with_verdicts(rows, hosts).filter("kept").select("row.*")


SQL = """
WITH words AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
lined AS (
  SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM words),
spots AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM words),
windows AS (
  SELECT doc_id, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM spots WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w1, w2) AS n FROM windows WHERE w2 IS NOT NULL),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM counted, (VALUES (0), (1), (2)) AS t(k) WHERE n > 1 GROUP BY doc_id),
figures AS (
  SELECT doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM lined LEFT JOIN covered c USING (doc_id)),
failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100 * n_symbols > 10 * word_chars AS symbols,
    100 * n_dup_lines > 30 * n_lines AS dup_lines FROM figures),
hosts AS (
  SELECT host, count(*) AS n, sum(base_failed::INT) AS f1, sum(symbols::INT) AS f2, sum(dup_lines::INT) AS f3 FROM failed GROUP BY host),
rates AS (
  SELECT host, n, unnest([f1, f2, f3]) AS f, unnest([1, 2, 3]) AS r FROM hosts),
priors AS (
  SELECT r, avg(f / n) AS m, var_pop(f / n) AS v FROM rates GROUP BY r),
shrunk AS (
  SELECT host, n + s AS total, (f + m * s) / (n + s) AS rate
  FROM rates JOIN (SELECT *, least(1000.0, greatest(1.0, m * (1 - m) / greatest(v, 1e-9) - 1)) AS s FROM priors) USING (r)),
verdicts AS (SELECT host, bool_or(rate - 2 * sqrt(rate * (1 - rate) / (total + 1)) > 0.5) AS rejected FROM shrunk GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM failed f JOIN verdicts v ON f.host IS NOT DISTINCT FROM v.host
"""


@query(SQL)
def op5_host_rules(spark, sf_dir):
    """The figures of every document and the verdict on it."""
    return judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
