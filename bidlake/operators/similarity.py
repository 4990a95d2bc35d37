"""The k most similar campaigns of each campaign, without comparing all pairs (D3).

A campaign is a sparse vector of non-negative weights (of households, sites, parts ...); likeness
is the cosine. Where the campaigns of a dimension are few, on average at most ``DIRECT`` over the
weights, all that meet are compared at once. Otherwise every step is a join on a shared dimension,
but not of all dimensions with all:

1. *Floor.* Dimensions that at most ``RARE`` campaigns share are joined with themselves, which makes
   at most ``RARE`` - 1 rows per weight. As weights aren't negative, their part of a cosine is a lower
   bound of it, and the k-th greatest of a campaign's is a floor under its k-th best cosine.
2. *Prefix.* A campaign's dimensions are taken rarest first. Once the length of what is left (as a
   share of the vector's length) is below the floor, a campaign that shares only those can't be
   among the k best (Cauchy-Schwarz). So only the dimensions before, the prefix, look for partners,
   and dimensions that everyone has are mostly left to the rest.
3. *Bound.* A partner's cosine is at most its part over the prefix and the length of the rest. Those
   below the floor go.
4. *Exact.* For the partners left, the rest's part is added, and k rows per campaign are kept.

Campaigns that meet are never shuffled pair by pair: a dimension's campaigns are staged as arrays of
at most about ``PART``, which go to the tasks of each campaign that has it, and the pairs are made,
added up and ranked there. So the exchange takes the other's id and weight per meeting, and its length
unless the lengths are small enough to be broadcast; nothing else grows with the meetings.
The number of tasks follows the meetings (``MEETINGS`` each), so their tables fit into memory.

Nor does the disk grow with the meetings: campaigns take turns, and a round makes the meetings of some,
about ``PER_WEIGHT`` per weight (``ROUND`` at least), keeps their k rows and frees its exchange before
the next one begins. So the exchange on disk follows the weights, however often they meet.

Lengths of the rests are running totals over range partitions, so a campaign with very many
dimensions is no single task's window. Ties go to the smaller campaign. A campaign that shares
nothing with k others has fewer rows; repeated weights add up; null and zero weights are none.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..session import stage_path
from ..sources.files import freed_shuffles, stage, write_parquet
from .broadcast import maybe_broadcast
from .sequence import running_totals

#: Campaigns that share a rare dimension, at most.
RARE = 32
#: Campaigns met per weight up to which floors cost more than they save.
DIRECT = 2 * RARE
#: Campaigns in an array, about.
PART = 1024
#: Meetings in a task, about.
MEETINGS = 2_000_000
#: Meetings in a round, at least, and per weight.
ROUND = 50_000_000
PER_WEIGHT = 3
#: Rounding errors can't lose a partner by this much.
SLACK = 1e-9


def _staged(df: DataFrame, name: str) -> DataFrame:
    with freed_shuffles(df.sparkSession):
        return stage(df, name)


def _weights(weights: DataFrame, campaign: str, dimension: str, weight: str) -> DataFrame:
    """(c, d, w): the weights, one row a campaign and dimension."""
    return _staged(weights.where(F.col(weight) > 0).where(
        F.col(campaign).isNotNull() & F.col(dimension).isNotNull()).groupBy(
        F.col(campaign).alias("c"), F.col(dimension).alias("d")).agg(
        F.sum(F.col(weight).cast("double")).alias("w")), "weights")


def _lengths(w: DataFrame) -> DataFrame:
    """(c, len2): the squared length of a vector."""
    return w.groupBy("c").agg(F.sum(F.col("w") * F.col("w")).alias("len2"))


def _shares(w: DataFrame) -> DataFrame:
    """(d, shared): how many campaigns share the dimension."""
    return w.groupBy("d").agg(F.count("*").alias("shared"))


def _entries(w: DataFrame, lengths: DataFrame) -> DataFrame:
    """(c, d, w, len2, shared): a weight, the squared length of its vector and how many campaigns
    share the dimension."""
    return w.join(lengths, "c").join(_shares(w), "d").select("c", "d", "w", "len2", "shared")


def _ordered(entries: DataFrame) -> DataFrame:
    """The entries with ``sq`` and ``before``, the squares of the campaign's rarer dimensions."""
    whole = entries.withColumn("sq", F.col("w") * F.col("w"))
    totals = running_totals(whole, ["shared", "d"], ["sq"], ["c"])
    return _staged(totals.withColumn("before", F.col("sq_cum") - F.col("sq")).drop("sq_cum"),
                   "vectors")


def _vectors(weights: DataFrame, campaign: str, dimension: str, weight: str) -> DataFrame:
    """(c, d, w, sq, len2, shared, before): see ``_entries`` and ``_ordered``."""
    w = _weights(weights, campaign, dimension, weight)
    return _ordered(_entries(w, _lengths(w)))


def _others(v: DataFrame) -> DataFrame:
    return v.select("d", F.col("c").alias("o"), F.col("w").alias("ow"),
                    F.col("len2").alias("olen2"))


def _tasks(v: DataFrame, rows: int) -> int:
    return max(int(v.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(rows / MEETINGS))


def _arrays(v: DataFrame, lengths: DataFrame, fields: list[str], seen: Row) -> DataFrame:
    """(d, parts, part, o_*): the campaigns of a dimension as arrays, one a part. What is needed
    besides the weights is joined to them, where ``v`` lacks it."""
    if "len2" in fields and "len2" not in v.columns:
        v = v.join(lengths, "c")
    keys = ["d"]
    if seen["most"] > PART:
        if "shared" not in v.columns:
            v = v.join(_shares(v), "d")
        keys = ["d", "parts", "part"]
        v = v.withColumn("parts", F.ceil(F.col("shared") / PART)).withColumn(
            "part", F.pmod(F.xxhash64("c"), F.col("parts")))
    arrays = v.repartition(_tasks(v, seen["weights"]), *[x for x in keys if x != "parts"]).groupBy(
        *keys).agg(F.collect_list(F.struct(*fields)).alias("m"))
    return _staged(arrays.select(*keys, *[F.col(f"m.{x}").alias(f"o_{x}") for x in fields]),
                   "arrays")


def _met(arrays: DataFrame, lengths: DataFrame | None, tasks: int, asks: Column,
         kept: Sequence[str]) -> DataFrame:
    """(c, o, dot, len2, olen2, *kept): the campaigns that share one of the dimensions in the
    entries that ask, with their part of the product. The rows of a campaign lie in one partition;
    ``kept`` are its own columns, ``lengths`` are given where they aren't in the arrays."""
    known = lengths is not None
    others = ["o_c", "o_w"] if known else ["o_c", "o_w", "o_len2"]
    facts = ["w", *kept] if known else ["w", "len2", *kept]
    keys = [x for x in ("d", "parts") if x in arrays.columns]
    own = arrays.select("*", F.posexplode("o_c").alias("at", "c")).where(asks).select(
        *keys, "c", *[F.col(f"o_{x}")[F.col("at")].alias(x) for x in facts], *others)
    if known:
        own = own.join(lengths, "c")
        facts = [*facts, "len2"]
    sent = own.select("c", *facts, *others)
    if "parts" in keys:
        alone = own.where(F.col("parts") == 1).select("c", *facts, *others)
        asked = own.where(F.col("parts") > 1).select("d", "c", *facts, F.explode(F.sequence(
            F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
        answers = arrays.where(F.col("parts") > 1).select("d", "part", *others)
        sent = alone.unionByName(asked.repartition(tasks, "d", "part").join(
            answers.repartition(tasks, "d", "part"), ["d", "part"]).select("c", *facts, *others))
    pairs = sent.repartition(tasks, "c").select(
        "*", F.posexplode("o_c").alias("at", "o")).where(F.col("c") != F.col("o"))
    sums = [F.sum(F.col("w") * F.col("o_w")[F.col("at")]).alias("dot"),
            *[F.max(x).alias(x) for x in facts if x != "w"]]
    if known:
        return pairs.groupBy("c", "o").agg(*sums).join(
            lengths.select(F.col("c").alias("o"), F.col("len2").alias("olen2")), "o")
    return pairs.groupBy("c", "o").agg(*sums, F.max(F.col("o_len2")[F.col("at")]).alias("olen2"))


def _in_rounds(v: DataFrame, lengths: DataFrame, seen: Row,
               reduced: Callable[[DataFrame, Column], DataFrame], prefix: bool = False,
               kept: Sequence[str] = ()) -> DataFrame:
    """``reduced`` of what ``_met`` makes of the entries, for some campaigns at a time; its second
    argument says for which. With ``prefix`` only the prefixes ask. ``seen``: see ``_seen``."""
    spark = v.sparkSession
    lengths, known = maybe_broadcast(lengths)
    fields = ["c", "w", *([] if known else ["len2"]), *(["prefix"] if prefix else []), *kept]
    arrays = _arrays(v, lengths, fields, seen)
    rounds = max(1, ceil(seen["meetings"] / max(ROUND, PER_WEIGHT * seen["weights"])))
    tasks = _tasks(v, ceil(seen["meetings"] / rounds))
    asks = F.col("o_prefix")[F.col("at")] if prefix else F.lit(True)

    def made(whose: Column) -> DataFrame:
        return reduced(_met(arrays, lengths if known else None, tasks, asks & whose, kept), whose)

    if rounds == 1:
        return made(F.lit(True))
    path = stage_path(spark, "rounds")
    for r in range(rounds):
        some = made(F.pmod(F.xxhash64("c"), F.lit(rounds)) == r)
        with freed_shuffles(spark):
            write_parquet(some, path, mode="append")
    return spark.read.parquet(path)


def _seen(v: DataFrame, asks: Column) -> Row:
    """How many weights there are, how many meetings of those that ask, and the most campaigns of
    a dimension."""
    return v.agg(F.count("*").alias("weights"), F.coalesce(
        F.sum(F.when(asks, F.col("shared"))), F.lit(0)).alias("meetings"), F.coalesce(
        F.max("shared"), F.lit(0)).alias("most")).first()


def _cosine(dot: Column) -> Column:
    return dot / F.sqrt(F.col("len2") * F.col("olen2"))


def _floors(v: DataFrame, k: int) -> DataFrame:
    """(c, floor): the k-th greatest part of a cosine over rare dimensions, where there is one."""
    rare = v.where((F.col("shared") <= RARE) & (F.col("shared") > 1))
    turn = Window.partitionBy("c").orderBy(F.desc("part"))

    def kth(met: DataFrame, _: Column) -> DataFrame:
        parts = met.select("c", _cosine(F.col("dot")).alias("part"))
        return parts.withColumn("turn", F.row_number().over(turn)).where(
            F.col("turn") <= k).where(F.col("turn") == k).select("c", F.col("part").alias("floor"))

    return _in_rounds(rare, _own_lengths(rare), _seen(rare, F.lit(True)), kth)


def _own_lengths(v: DataFrame) -> DataFrame:
    """(c, len2) of entries that may be a part of their vectors."""
    return _staged(v.groupBy("c").agg(F.max("len2").alias("len2")), "lengths")


def _split(v: DataFrame, k: int) -> DataFrame:
    """``v`` with the campaign's floor and whether the weight belongs to the prefix."""
    floors = _staged(_floors(v, k), "floors")
    floor = F.coalesce(F.col("floor"), F.lit(0.0))
    left = F.sqrt(F.greatest(F.lit(0.0), F.col("len2") - F.col("before")) / F.col("len2"))
    return _staged(v.join(floors, "c", "left").withColumn("floor", floor).withColumn(
        "prefix", left + SLACK >= floor), "prefixes")


def _partners(split: DataFrame, reduced: Callable[[DataFrame, Column], DataFrame]) -> DataFrame:
    """``reduced`` of (c, o, dot, len2, olen2): who may be among the k best, with the prefix's
    part."""
    rest = split.where(~F.col("prefix")).groupBy("c").agg(F.sum("sq").alias("rest2"))
    most = _cosine(F.col("dot")) + F.sqrt(F.coalesce("rest2", F.lit(0.0)) / F.col("len2"))

    def bounded(met: DataFrame, whose: Column) -> DataFrame:
        return reduced(met.join(rest, "c", "left").where(most + SLACK >= F.col("floor")).select(
            "c", "o", "dot", "len2", "olen2"), whose)

    return _in_rounds(split, _own_lengths(split), _seen(split, F.col("prefix")), bounded,
                      prefix=True, kept=["floor"])


def partners(split: DataFrame, v: DataFrame) -> DataFrame:
    """(c, o, dot, len2, olen2): who may be among the k best, with the prefix's part."""
    return _partners(split, lambda found, _: found)


def _is_sparse(seen: Row) -> bool:
    return seen["meetings"] <= DIRECT * seen["weights"]


def _best(exact: DataFrame, k: int) -> DataFrame:
    """(c, rank, o, similarity): the ``k`` best of each campaign's."""
    turn = Window.partitionBy("c").orderBy(F.desc("similarity"), "o")
    return exact.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= k).select(
        "c", "rank", "o", "similarity")


def _by_floors(v: DataFrame, k: int) -> DataFrame:
    """``_best`` of the exact cosines of the pairs that the bounds leave."""
    split = _split(v, k)
    late = split.where(~F.col("prefix")).select("c", "d", "w")
    path = stage_path(v.sparkSession, "partners")

    def exact(left: DataFrame, whose: Column) -> DataFrame:
        with freed_shuffles(v.sparkSession):
            write_parquet(left, path, mode="overwrite")  # the last round's are no longer needed
        found = v.sparkSession.read.parquet(path)
        more = found.select("c", "o").join(late.where(whose), "c").join(
            _others(v), ["d", "o"]).groupBy("c", "o").agg(
            F.sum(F.col("w") * F.col("ow")).alias("more"))
        return _best(found.join(more, ["c", "o"], "left").select("c", "o", _cosine(
            F.col("dot") + F.coalesce("more", F.lit(0.0))).alias("similarity")), k)

    return _partners(split, exact)


def top_similar(weights: DataFrame, k: int, campaign: str = "campaign",
                dimension: str = "dimension", weight: str = "weight") -> DataFrame:
    """(campaign, rank, other, similarity): the ``k`` campaigns of greatest positive cosine."""
    if k < 1:
        raise ValueError("k must be at least 1")
    w = _weights(weights, campaign, dimension, weight)
    lengths = _staged(_lengths(w), "lengths")
    shared = F.col("shared")
    with freed_shuffles(w.sparkSession):
        seen = _shares(w).agg(F.coalesce(F.sum(shared), F.lit(0)).alias("weights"), F.coalesce(
            F.sum(shared * shared), F.lit(0)).alias("meetings"), F.coalesce(
            F.max(shared), F.lit(0)).alias("most")).first()
    if _is_sparse(seen):
        best = _in_rounds(w, lengths, seen, lambda met, _: _best(met.select(
            "c", "o", _cosine(F.col("dot")).alias("similarity")), k))
    else:
        best = _by_floors(_ordered(_entries(w, lengths)), k)
    return best.select(F.col("c").alias(campaign), "rank", F.col("o").alias("other"), "similarity")
