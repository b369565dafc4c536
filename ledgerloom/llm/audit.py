"""Filter interaction audit by path counting over the lattice of filter subsets.

Each document has a set of filters that it fails. An order of the filters is a path through the lattice of subsets, from none
applied to all; the edge from state S by filter f removes the documents that fail f and nothing in S. Forward counts say
how many orders reach a state, backward counts how many ways lead on from it; their product weighs an edge's removals,
and a filter's weighted sum is its Shapley value (times the number of orders). The steps of each single order are read from the
same edges, so no order is ever run over the documents.

Spark reads texts once, in a scan whose checkpoint has each row's failures and a digest of the text, and shuffles no text. The
filter for repeated texts compares each row's id with the smallest id of its digest, found by an aggregate that combines within
tasks and joined only where a digest has several rows (a join that adaptive execution may split, as one side has each digest
once). All that is left are counts for each part and set of failures, at most
32 rows a part, and the lattice is array expressions over one row a part.

Null text is the empty text. A null id is no smaller id and has none, so such rows never count as repeats, nor as labelled; rows with one
id and text are no repeats of each other. A null part is the empty string. Labels of one id over several rows hold if any row says
so; null labels don't. Empty documents give an empty result. Texts of any length are read whole. Only the named columns are
read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, scan, table

FILTERS = "ABCDE"
WORDS_LEAST = 200
#: Least share of distinct words, and most capital letters, in hundredths.
DISTINCT_LEAST, CAPITALS_MOST = 50, 2
SYMBOLS = b"#$%&*|"
_CAPITALS = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))


def failures(text: bytes) -> int:
    """Bits 0 to 3: what the text fails of filters A to D."""
    words = text.split()
    few = len(words) < WORDS_LEAST
    repetitive = 100 * len(set(words)) < DISTINCT_LEAST * len(words)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    shouting = 100 * capitals > CAPITALS_MOST * len(text.translate(None, _CONTINUED))
    symbols = len(text.translate(None, SYMBOLS)) < len(text)
    return few | repetitive << 1 | shouting << 2 | symbols << 3


def failed_sets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bits, one for each filter), n, good, toxic: counts of documents. docs: doc_id, text, source; labels:
    doc_id, quality, toxic."""

    def factory() -> Callable:
        return lambda doc_id, part, text: (doc_id, part, failures(text or b""), hashlib.sha256(text or b"").digest())

    texts = docs.select(
        docs["doc_id"].cast("long").alias("id"),
        F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"),
        docs["text"].cast("binary").alias("text"),
    )
    rows = checkpointed(scan(texts, "id bigint, part string, fails int, digest binary", factory))
    marks = labels.where(labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].cast("long").alias("id")).agg(
        F.max((F.coalesce(labels["quality"], F.lit(0)) == 1).cast("long")).alias("good"),
        F.max((F.coalesce(labels["toxic"], F.lit(0)) == 1).cast("long")).alias("toxic"),
    )
    # digests of several rows; the others need no partner
    first = rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select(F.col("digest").alias("its"), "first")
    repeat = F.coalesce(F.col("id") > F.col("first"), F.lit(False)).cast("int")
    return (
        rows.join(marks, "id", "left")
        .join(first, F.col("digest") == F.col("its"), "left")
        .groupBy("part", F.col("fails").bitwiseOR(repeat * 16).alias("fails"))
        .agg(
            F.count("*").alias("n"),
            F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
            F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"),
        )
    )


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """For each state, a set of filters as bits: how many orders reach it, and how many ways lead on from it to the full set."""
    states = range(1 << n)
    reach, leave = [1] + [0] * (len(states) - 1), [0] * (len(states) - 1) + [1]
    for s in states:
        reach[s] += sum(reach[s ^ 1 << f] for f in range(n) if s >> f & 1)
    for s in reversed(states):
        leave[s] += sum(leave[s | 1 << f] for f in range(n) if not s >> f & 1)
    return reach, leave


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. counts: as failed_sets
    gives them, with a bit in fails for each letter of filters."""
    n = len(filters)
    reach, leave = path_counts(n)
    edges = [(s, f) for s in range(1 << n) for f in range(n) if not s >> f & 1]
    at = {e: i for i, e in enumerate(edges)}
    dense = counts.groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct("fails", F.struct("n", "good", "toxic")))).alias("cell"),
        F.sum("n").alias("total"),
    )

    def summed(field: str, chosen: Column) -> Column:
        """The field over the cells whose failures meet a condition on the lambda's key."""
        return F.aggregate(chosen, F.lit(0).cast("long"), lambda acc, k: acc + F.coalesce(F.col("cell")[k][field], F.lit(0).cast("long")))

    keys = F.map_keys("cell")
    edge = F.array(*(F.struct(F.lit(s).alias("state"), F.lit(1 << f).alias("bit")) for s, f in edges))

    def over_edges(field: str) -> Column:
        return F.transform(
            edge,
            lambda e: summed(field, F.filter(keys, lambda k: (k.bitwiseAND(e["bit"]) != 0) & (k.bitwiseAND(e["state"]) == 0))),
        )

    bits = F.array(*(F.lit(1 << f) for f in range(n)))
    weights = [reach[s] * leave[s | 1 << f] for s, f in edges]
    lattice = dense.select(
        "part",
        "total",
        over_edges("n").alias("removals"),
        over_edges("good").alias("good_removals"),
        over_edges("toxic").alias("toxic_removals"),
        F.transform(bits, lambda b: summed("n", F.filter(keys, lambda k: k.bitwiseAND(b) != 0))).alias("failing"),
        F.transform(bits, lambda b: summed("n", F.filter(keys, lambda k: k == b))).alias("unique"),
    ).withColumn(
        "shares",
        F.array(
            *(
                sum((F.col("removals")[i] * F.lit(weights[i]) for i, (_, g) in enumerate(edges) if g == f), F.lit(0).cast("long"))
                for f in range(n)
            ),
        ),
    )
    steps = []
    for order in permutations(range(n)):
        state, name, path = 0, "".join(filters[f] for f in order), []
        for step, f in enumerate(order, 1):
            path.append(at[state, f])
            steps.append({"o": name, "s": step, "f": f, "l": filters[f], "p": list(path)})
            state |= 1 << f
    fixed = F.from_json(F.lit(json.dumps(steps)), "array<struct<o:string,s:int,f:int,l:string,p:array<int>>>")
    each = lattice.withColumn("x", F.explode(fixed))
    here = F.element_at("x.p", -1)
    gone = F.aggregate("x.p", F.lit(0).cast("long"), lambda acc, e: acc + F.get("removals", e))
    return each.select(
        "part",
        F.col("x.o").alias("filter_order"),
        F.col("x.s").alias("step"),
        F.col("x.l").alias("filter"),
        (F.col("total") - gone).alias("kept"),
        F.get("removals", here).alias("removed"),
        (F.get("failing", F.col("x.f")) - F.get("removals", here)).alias("redundant"),
        F.get("unique", F.col("x.f")).alias("unique_fails"),
        F.get("good_removals", here).alias("good_lost"),
        F.get("toxic_removals", here).alias("toxic_lost"),
        F.get("shares", F.col("x.f")).alias("shapley"),
    )


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions(failed_sets(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))).drop("filter")


QUERIES = {"op13_audit": op13_audit}

ORACLE_SQL = {
    "op13_audit": r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
          regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM d LEFT JOIN marks ON d.doc_id = marks.doc_id),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 3, 4, 5]) AS i),
perms AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o, [a.i, b.i, c.i, d.i, e.i] AS p FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
steps AS (SELECT o, p, unnest([1, 2, 3, 4, 5]) AS step FROM perms),
here AS (
  SELECT part, o, step, p[step] AS k, n, good, toxic, fails[p[step]] AS failing,
         len(list_filter(p[1:step - 1], lambda j: fails[j])) > 0 AS before, len(list_filter(fails, lambda v: v)) = 1 AS single
  FROM cells, steps),
sums AS (
  SELECT part, o AS filter_order, step, any_value(k) AS k,
         CAST(sum(CASE WHEN NOT failing AND NOT before THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN failing AND NOT before THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN failing AND before THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN failing AND single THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN failing AND NOT before THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN failing AND NOT before THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM here GROUP BY part, o, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, k) AS BIGINT) AS shapley
FROM sums"""
}
