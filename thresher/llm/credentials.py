"""Secrets in texts, and the weaker parts of credentials that only count together.

Three kinds are found by themselves: assignments, access identifiers and runs of hex
digits. Three others are too common to report alone: account names (`id`), runs of forty
and more mixed letters and digits (`key`) and addresses (`endpoint`). A weak part is reported
only if its scope, SCOPE code points to either side, holds what completes it:

* an `id`: an assignment or hex run, or a `key` and an `endpoint`;
* a `key`: an access identifier, or an `id` and an `endpoint`;
* an `endpoint`: an identifier and a secret, one of them found by itself.

Parts and scopes are intervals. They are joined by the bins of WIDTH code points they touch,
so what meets under one document and bin is bounded by the width, however many secrets a
document has. A weak part that overlaps one found by itself is that part again and is left out.

Built of column functions only. Spans count code points, the end exclusive. A null or empty
text has no spans; documents without an id, and repeated rows, are rows of their own; ties in
the start of a span go in the order of KINDS; an empty table gives an empty result. Long texts are
searched whole. Only the two named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from thresher.llm.registry import query, table
from thresher.session import pinned

SCOPE = 200
WIDTH = 256
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
STRONG = KINDS[:3]
IDENTIFIERS, SECRETS = ("access", "id"), ("assign", "hex", "key")
# The words that name a secret or an account, and the least lengths of what they are given.
SECRET_WORDS = "password|passwd|secret|token|api_?key"
ACCOUNT_WORDS = "access_?key_?id|client_?id|account|username|user|login"
LEAST_ASSIGNED, LEAST_NAMED = 6, 3


def either_case(words):
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


ASSIGNED = r"""["']?\x20*[:=]\x20*["']?"""
PATTERNS = {
    "assign": f"({either_case(SECRET_WORDS)}){ASSIGNED}([A-Za-z0-9+/_.=-]+)",
    # Runs are taken whole, so a least length in the pattern finds the same ones as a test of all runs.
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "[0-9a-f]{24,}",
    "id": f"({either_case(ACCOUNT_WORDS)}){ASSIGNED}([A-Za-z0-9@._+-]+)",
    "key": "[A-Za-z0-9+/]{40,}",
    "endpoint": f"({either_case('https?|s3|ftp')})://[A-Za-z0-9._~:/?#@%&=+-]+",
}


def fits(kind, match):
    """What a match must have besides its pattern."""
    if kind in ("assign", "id"):
        return F.length(F.regexp_extract(match, PATTERNS[kind], 2)) >= (LEAST_ASSIGNED if kind == "assign" else LEAST_NAMED)
    if kind == "key":
        return match.rlike("[a-z]") & match.rlike("[A-Z]") & match.rlike("[0-9]")
    return F.lit(True)


def matches(documents: DataFrame, text, keep) -> DataFrame:
    """`keep`, a row number, and for each kind the matches in order: what lies before each, its length, whether it fits.

    The table is written: it has no texts in it, and its row numbers must not change.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    found = documents.select(F.col(keep), whole.alias("text"), *[F.regexp_extract_all(whole, F.lit(p), F.lit(0)).alias(k) for k, p in PATTERNS.items()])

    def measured(kind):
        between = F.split("text", PATTERNS[kind], -1)  # what lies before, between and behind the matches
        steps = F.zip_with(F.slice(between, 1, F.size(kind)), F.col(kind), lambda before, match: F.struct(
            F.length(before).cast("long").alias("before"), F.length(match).cast("long").alias("length"), fits(kind, match).alias("fits")))
        return F.when(F.size(kind) > 0, steps).alias(kind)

    return pinned(found.select(keep, F.monotonically_increasing_id().alias("row"), *[measured(k) for k in KINDS]))


def spans(found: DataFrame) -> DataFrame:
    """(row, kind, start, end) of the matches that fit; `kind` is a place in KINDS."""
    some = found.filter(F.coalesce(*[F.col(k)["length"] for k in KINDS]).isNotNull())
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(k).alias("steps")) for i, k in enumerate(KINDS)]))
    steps = some.select("row", one.alias("one")).select("row", "one.kind", F.posexplode("one.steps").alias("place", "step"))
    upto = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    ended = steps.withColumn("end", F.sum(F.col("step.before") + F.col("step.length")).over(upto))
    return ended.filter("step.fits").select("row", "kind", (F.col("end") - F.col("step.length")).alias("start"), "end")


def bins(low, high):
    """The bins that [low, high) touches, one row each."""
    at = lambda spot: F.floor(spot / WIDTH).cast("long")
    return F.explode(F.sequence(at(F.greatest(low, F.lit(0).cast("long"))), at(high - 1)))


def completed(found: DataFrame) -> DataFrame:
    """The weak spans whose scopes hold what completes them."""
    place = {k: i for i, k in enumerate(KINDS)}
    weak = found.filter(F.col("kind") >= len(STRONG)).select(
        "row", "kind", "start", "end", bins(F.col("start") - SCOPE, F.col("end") + SCOPE).alias("bin"))
    parts = found.select(F.col("row").alias("of"), F.col("kind").alias("part"), F.col("start").alias("low"), F.col("end").alias("high"),
                         bins(F.col("start"), F.col("end")).alias("in_bin"))
    near = (F.col("low") < F.col("end") + SCOPE) & (F.col("high") > F.col("start") - SCOPE)
    met = weak.join(parts, (F.col("row") == F.col("of")) & (F.col("bin") == F.col("in_bin")) & near)
    holds = lambda kinds: F.max(F.col("part").isin([place[k] for k in kinds]))
    again = F.max((F.col("part") < len(STRONG)) & (F.col("low") < F.col("end")) & (F.col("high") > F.col("start")))
    seen = met.groupBy("row", "kind", "start", "end").agg(
        again.alias("again"), holds(["access"]).alias("access"), holds(["assign", "hex"]).alias("secret"), *[holds([k]).alias(k) for k in ("id", "key", "endpoint")])
    c = F.col
    complete = F.when(c("kind") == place["id"], c("secret") | (c("key") & c("endpoint"))).when(c("kind") == place["key"], c("access") | (c("id") & c("endpoint"))).otherwise(
        (c("access") & (c("secret") | c("key"))) | (c("id") & c("secret")))
    return seen.filter(~c("again") & complete).select("row", "kind", "start", "end")


def credentials(documents: DataFrame, text="text", keep="doc_id") -> DataFrame:
    """(`keep`, base, found) of every document: arrays of (start, kind, end) of what is found by itself, and of all that is reported."""
    found = matches(documents, text, keep)
    every = pinned(spans(found))
    reported = every.filter(F.col("kind") < len(STRONG)).unionByName(completed(every))
    by_row = reported.groupBy(F.col("row").alias("of")).agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    joined = found.select(keep, "row").join(by_row, F.col("row") == F.col("of"), "left").select(keep, F.coalesce("found", none).alias("found"))
    return joined.select(keep, F.filter("found", lambda s: s["kind"] < len(STRONG)).alias("base"), "found")


def listed(found):
    """`kind:start:end`, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def located_sql(kind):
    """SQL for the spans of a kind that fit."""
    pattern = PATTERNS[kind].replace("'", "''")
    rule = {"assign": f"length(regexp_extract(m, '{pattern}', 2)) >= {LEAST_ASSIGNED}", "id": f"length(regexp_extract(m, '{pattern}', 2)) >= {LEAST_NAMED}",
            "key": "regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]')"}.get(kind, "true")
    return f"""
  SELECT r, {KINDS.index(kind)} AS kind, (e - length(m))::BIGINT AS s, e::BIGINT AS e FROM (
    SELECT r, m, sum(length(b) + length(m)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM (
      SELECT r, unnest(ms) AS m, generate_subscripts(ms, 1) AS i, unnest(bs[1:len(ms)]) AS b FROM (
        SELECT r, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS bs FROM docs))) WHERE {rule}"""


def listed_sql(condition):
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return f"coalesce(string_agg([{kinds}][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER ({condition}), '')"


SQL = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
spans AS ({' UNION ALL '.join(located_sql(k) for k in KINDS)}),
near AS (
  SELECT w.r, w.kind, w.s, w.e, p.kind AS part, p.kind < 3 AND p.s < w.e AND p.e > w.s AS again
  FROM spans w JOIN spans p ON p.r = w.r AND w.kind >= 3 AND p.s < w.e + {SCOPE} AND p.e > w.s - {SCOPE}),
seen AS (
  SELECT r, kind, s, e, bool_or(again) AS again, bool_or(part = 1) AS access, bool_or(part IN (0, 2)) AS secret,
    bool_or(part = 3) AS id, bool_or(part = 4) AS key, bool_or(part = 5) AS endpoint FROM near GROUP BY ALL),
reported AS (
  SELECT r, kind, s, e FROM spans WHERE kind < 3
  UNION ALL SELECT r, kind, s, e FROM seen WHERE NOT again AND CASE kind WHEN 3 THEN secret OR (key AND endpoint) WHEN 4 THEN access OR (id AND endpoint)
    ELSE (access AND (secret OR key)) OR (id AND secret) END)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256({listed_sql('kind < 3')}) AS base_sha256, {listed_sql('kind >= 0')} AS spans
FROM docs d LEFT JOIN reported USING (r) GROUP BY r, doc_id
"""


@query(SQL)
def op13_linked_credentials(spark, sf_dir):
    """The secrets of every document and the weak parts they complete."""
    found = credentials(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[number(k) for k in STRONG], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
