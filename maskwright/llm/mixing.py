"""Mixing overlapping sources to target weights by min-cost flow over membership patterns.

Documents are summed by the set of sources they belong to. Token capacity flows from every pattern to the quotas
of its sources; a pattern's second and third pass over its documents cost more than the first, so repeats are
taken last and evenly. The flow then fixes how many words each pattern gives, and seeded documents fill it.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.session import materialize

#: Weights of the sources in order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
SEED = 17
#: Seeded documents are placed in this many narrow ranges of a hash, and again inside the range that is cut.
RANGES = 4096
MOST_PATTERNS = 100_000
#: Keys of repeated rows (8 bytes each) up to which they are broadcast.
BROADCAST_KEYS = 500_000


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS) -> list[float]:
    """Words due to each source: the whole shared by weight, none above `most_repeats` times its own size, the excess shared again."""
    total, due = float(sum(sizes)), [0.0] * len(sizes)
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    full: set[int] = set()
    while len(full) < len(sizes):
        left = total - sum(due[k] for k in full)
        share = sum(weight[k] for k in range(len(sizes)) if k not in full)
        for k in range(len(sizes)):
            if k not in full:
                due[k] = left * weight[k] / share
        over = [k for k in range(len(sizes)) if k not in full and due[k] > most_repeats * sizes[k]]
        if not over:
            break
        for k in over:
            due[k] = float(most_repeats * sizes[k])
            full.add(k)
    return due


def min_cost_flow(capacity: list[float], members: list[list[int]], due: list[float], most_repeats: int = MOST_REPEATS) -> np.ndarray:
    """Words from each pattern to each of its sources, as a matrix.

    Every pattern offers its words `most_repeats` times, the k-th pass at cost k - 1 (convex). Quotas are filled by
    shortest augmenting paths, so cheap passes go first and a quota that only one pattern can serve is not starved.
    """
    patterns, sources = len(capacity), len(due)
    flow = np.zeros((patterns, sources))
    used, got = np.zeros(patterns), np.zeros(sources)
    by_source = [[p for p in range(patterns) if s in members[p]] for s in range(sources)]
    small = 1e-9 * max(1.0, sum(capacity))
    for tier in range(1, most_repeats + 1):  # costs of the tiers differ, so each is a maximum flow on what is left
        open_to = [tier * c for c in capacity]
        for s in range(sources):
            while due[s] - got[s] > small:
                # breadth first from the quota back to a pattern with words left, moving other quotas' flow aside
                came: dict[tuple[str, int], tuple[str, int] | None] = {("s", s): None}
                queue, end = deque([("s", s)]), None
                while queue and end is None:
                    kind, k = queue.popleft()
                    if kind == "s":
                        for p in by_source[k]:
                            if ("p", p) not in came:
                                came[("p", p)] = (kind, k)
                                if open_to[p] - used[p] > small:
                                    end = ("p", p)
                                    break
                                queue.append(("p", p))
                    else:
                        for t in members[k]:
                            if ("s", t) not in came and flow[k, t] > small:
                                came[("s", t)] = (kind, k)
                                queue.append(("s", t))
                if end is None:
                    break
                path = [end]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                amount = min(due[s] - got[s], open_to[end[1]] - used[end[1]])
                for a, b in zip(path[1::2], path[2::2]):
                    amount = min(amount, flow[b[1], a[1]])
                for a, b in zip(path[0::2], path[1::2]):
                    flow[a[1], b[1]] += amount
                for a, b in zip(path[1::2], path[2::2]):
                    flow[b[1], a[1]] -= amount
                used[end[1]] += amount
                got[s] += amount
    return flow


def word_count(text: Column) -> Column:
    """Number of runs of anything but white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def mix_documents(
    docs: DataFrame, members_col: str, size_col: str, order: list[str | None],
    weights: tuple[float, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS, seed: int = SEED,
) -> DataFrame:
    """Adds `repeats` (times a document is taken, 0 to `most_repeats`) to `docs` (row_key, an array of sources, a size).

    `order` names the sources in the order of their weights. Every pattern gives what the flow asks: its documents
    whole as often as all of them fit, and once more for the first ones in a seeded order, then for smaller ones
    behind the first that does not fit, until none fits any more; at last the smallest one left, where that comes nearer.
    The same rows give the same mix. Patterns are summed before they reach the driver.
    """
    spark = docs.sparkSession
    # a source without a name is none of those with one, whatever their names
    source = lambda s: F.struct(s.isNull().alias("none"), F.coalesce(s, F.lit("")).alias("name"))
    rows = docs.withColumn("pattern", F.array_sort(F.array_distinct(F.transform(F.coalesce(members_col, F.array().cast("array<string>")), source))))
    sums = rows.groupBy("pattern").agg(F.sum(size_col).alias("words")).limit(MOST_PATTERNS + 1).collect()
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns of sources")
    sums = sorted(sums, key=lambda r: [tuple(x) for x in r["pattern"]])
    place = {(s is None, s or ""): k for k, s in enumerate(order)}
    members = [[place[tuple(x)] for x in r["pattern"]] for r in sums]
    words = [int(r["words"]) for r in sums]
    of_source = [sum(w for w, m in zip(words, members) if k in m) for k in range(len(order))]
    flow = min_cost_flow([float(w) for w in words], members, targets(of_source, weights, most_repeats), most_repeats)
    given = flow.sum(1).tolist()
    whole = [min(most_repeats, int(g // w)) if w else 0 for w, g in zip(words, given)]
    plan = spark.createDataFrame([(r["pattern"], k, n) for k, (r, n) in enumerate(zip(sums, whole))], "pattern array<struct<none:boolean,name:string>>, pid int, whole int")
    room = {k: g - w * n for k, (w, g, n) in enumerate(zip(words, given, whole)) if n < most_repeats}

    # the seeded order is that of a hash
    spot = F.xxhash64(F.lit(seed), F.col("row_key"))
    part = F.shiftrightunsigned(spot, 64 - int(np.log2(RANGES))).cast("int")
    numbered = rows.join(F.broadcast(plan), "pattern").drop("pattern")
    waiting, _ = materialize(numbered.where(F.col(size_col) > 0).select("row_key", "pid", spot.alias("spot"), part.alias("part"), F.col(size_col).cast("long").alias("words")))
    picked, every = None, waiting
    while True:
        taken, n_taken = materialize(_first_that_fit(waiting, room).withColumn("one", F.lit(True)), "one")
        if n_taken == 0:
            break
        picked = taken if picked is None else picked.unionByName(taken)
        for r in taken.groupBy("pid").agg(F.sum("words").alias("n")).collect():
            room[r["pid"]] -= r["n"]
        # what is left is less than the document that did not fit; smaller ones behind it go on
        waiting, _ = materialize(_fitting(waiting, room).join(taken.select("row_key"), "row_key", "left_anti"))
    # one document more, the smallest that is left, where the sum is nearer with it than without
    left = spark.createDataFrame([(k, float(v)) for k, v in room.items() if v > 0], "pid int, rest double")
    unpicked = every if picked is None else every.join(picked.select("row_key"), "row_key", "left_anti")
    smallest = unpicked.groupBy("pid").agg(F.min(F.struct("words", "part", "spot", "row_key")).alias("d")).select("pid", "d.row_key", "d.words")
    nearer = smallest.join(F.broadcast(left), "pid").where(F.col("words") < 2 * F.col("rest")).select("row_key", "pid", "words")
    picked = nearer if picked is None else picked.unionByName(nearer)
    once = picked.select("row_key", F.lit(1).alias("once"))
    return numbered.join(once, "row_key", "left").withColumn("repeats", F.col("whole") + F.coalesce("once", F.lit(0))).drop("pid", "whole", "once")


def _fitting(rows: DataFrame, room: dict[int, float]) -> DataFrame:
    """The rows whose words fit what is left for their pattern."""
    left = rows.sparkSession.createDataFrame([(k, float(v)) for k, v in room.items() if v >= 1], "pid int, rest double")
    return rows.join(F.broadcast(left), "pid").where(F.col("words") <= F.col("rest")).drop("rest")


def _first_that_fit(waiting: DataFrame, room: dict[int, float]) -> DataFrame:
    """(row_key, pid, words): the rows of every pattern from the first one in the seeded order on, as far as all fit.

    Narrow ranges of the order are summed first; only the range in which the room runs out is put in order.
    """
    left = waiting.sparkSession.createDataFrame([(k, float(v)) for k, v in room.items() if v >= 1], "pid int, rest double")
    fitting = _fitting(waiting, room)
    before = Window.partitionBy("pid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = fitting.groupBy("pid", "part").agg(F.sum("words").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(left), "pid")
    ranges, _ = materialize(ranges.where("ahead < rest"))
    placed = fitting.join(F.broadcast(ranges), ["pid", "part"])
    upto = F.col("ahead") + F.sum("words").over(Window.partitionBy("pid", "part").orderBy("spot", "row_key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = placed.where("ahead + n <= rest").select("row_key", "pid", "words")
    return inside.unionByName(placed.where("ahead + n > rest").withColumn("upto", upto).where("upto <= rest").select("row_key", "pid", "words"))


def _free(name: str, taken: list[str]) -> str:
    """`name`, made longer until no column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def _content(id_col: str, text_col: str, source_col: str) -> Column:
    """Hash of id, source and text, nulls apart from everything else."""
    columns = [F.col(c) for c in (id_col, source_col, text_col)]
    return F.xxhash64(*columns, *[c.isNull() for c in columns])


def _told_apart(rows: DataFrame, key: str) -> DataFrame:
    """`rows` whose `key` becomes another one for every further row that has it.

    Equal keys are numbered inside pieces of the table, which are shifted by each other's counts, so that no key is
    gathered. Which of the rows gets which number makes no difference to those who made the key.
    """
    piece, n, number = (_free(c, rows.columns) for c in ("piece", "rows", "number"))
    again, n_again = materialize(rows.groupBy(key).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1).select(key).withColumn("one", F.lit(True)), "one")
    if n_again == 0:
        return rows
    again = F.broadcast(again) if n_again <= BROADCAST_KEYS else again
    # stored, as the pieces must be the same for the counts and for the numbers
    repeated, _ = materialize(rows.join(again, key, "left_semi").withColumn(piece, F.spark_partition_id()))
    earlier = Window.partitionBy(key).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    shift = repeated.groupBy(key, piece).agg(F.count(F.lit(1)).alias(n)).withColumn(n, F.coalesce(F.sum(n).over(earlier), F.lit(0)))
    placed = repeated.withColumn(number, F.row_number().over(Window.partitionBy(key, piece).orderBy(F.lit(1)))).join(shift, [key, piece])
    told = F.col(n) + F.col(number)
    own = placed.withColumn(key, F.when(told == 1, F.col(key)).otherwise(F.xxhash64(key, told))).select(*rows.columns)
    return rows.join(again, key, "left_anti").select(*rows.columns).unionByName(own)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken, repeats, row_key) of every document, each in its one source.

    Size is the number of words. Sources by code point, null last, have the weights 5, 2, 1, repeating; together
    they are due all words, none more than three times its own. `taken` is size times `repeats`.

    Null and blank texts have size 0 and take nothing. Null sources are a source of their own. Every row is decided by
    itself, rows that repeat an id too. Extra columns are ignored; an empty table gives no rows.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    sized, _ = materialize(chosen.select("doc_id", "source", word_count(F.col("text")).alias("size"), _content("doc_id", "text", "source").alias("row_key")))
    sized = _told_apart(sized, "row_key")
    totals = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_PATTERNS + 1).collect()
    order = sorted((r["source"] for r in totals), key=lambda s: (s is None, s or ""))
    by_source = {r["source"]: int(r["n"]) for r in totals}
    due = targets([by_source[s] for s in order])
    facts = docs.sparkSession.createDataFrame([(s, by_source[s], d) for s, d in zip(order, due)], "known_source string, source_size long, target double")
    mixed = mix_documents(sized.withColumn("members", F.array("source")), "members", "size", order, seed=seed)
    return mixed.join(F.broadcast(facts), F.col("source").eqNullSafe(F.col("known_source"))).select(
        "doc_id", "size", "source", "source_size", "target", (F.col("size") * F.col("repeats")).cast("long").alias("taken"), F.col("repeats").cast("int").alias("repeats"), "row_key"
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The rows of `docs` that the mix of their sources takes, with how often (`repeats`, or `repeats_` where `docs` has such a column)."""
    key, repeats = _free("row_key", docs.columns), "repeats"
    mixed = mix_sources(docs, id_col, text_col, source_col, seed).where("repeats > 0 AND size > 0").select(F.col("row_key").alias(key), F.col("repeats").alias(_free(repeats, docs.columns)))
    rows = docs.withColumn(id_col, F.col(id_col).cast("long"))
    return _told_apart(rows.withColumn(key, _content(id_col, text_col, source_col)), key).join(mixed, key).drop(key)
