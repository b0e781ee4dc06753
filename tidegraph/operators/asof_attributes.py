"""Attributes as known at event time, by dyadic decomposition of validity intervals.

A validity interval [start, end) is cut into maximal aligned dyadic nodes ``(level, index)``, each
covering ``[index * 2**level, (index + 1) * 2**level)``; there are at most two per level. An event
has exactly one enclosing node per level, so interval containment becomes an equi-join on
``(entity, level, index)`` that Spark hashes. Only event times can match, so intervals - open ones
too - are first clipped to the events' own first and last time, whatever these are, and levels
count from that first time. Events are expanded only to the levels that a fact of their entity
uses. Entities with a large share of the events are counted first and spread over salts.

With a finest level above 0 the nodes at the two ends are rounded outwards, and the exact half-open
test after the join removes what the rounding added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegraph.operators.skew import SALT, SALTS, fair_join, frequent_keys
from tidegraph.session import Scratch, broadcast_if_small

#: Finest level where matches are tested exactly: nodes of about 18 hours.
LOW = 16
NODES = "array<struct<level:int,node:bigint>>"


def dyadic_nodes(start: Column, end: Column, low: int, high: int) -> Column:
    """Array of ``struct(level, node)`` covering [start, end), both ends not negative and below 2**high.

    An empty interval has no nodes. Computed level by level: at level l the interval in units of
    2**l is [a, b); an odd a gives node a, an odd b gives node b - 1, and the rest goes up a level.
    """
    a, b = F.shiftright(start, low), F.shiftright(end + F.lit((1 << low) - 1), low)
    start_acc = F.struct(a.alias("a"), b.alias("b"), F.array().cast(NODES).alias("nodes"))

    def step(acc, level):
        odd_a = (acc["a"] < acc["b"]) & (acc["a"].bitwiseAND(F.lit(1)) == 1)
        a1 = F.when(odd_a, acc["a"] + 1).otherwise(acc["a"])
        odd_b = (a1 < acc["b"]) & (acc["b"].bitwiseAND(F.lit(1)) == 1)
        b1 = F.when(odd_b, acc["b"] - 1).otherwise(acc["b"])
        one = lambda hit, at: F.when(hit, F.array(F.struct(level.alias("level"), at.alias("node")))).otherwise(
            F.array().cast(NODES)
        )
        nodes = F.concat(acc["nodes"], one(odd_a, acc["a"]), one(odd_b, acc["b"] - 1))
        return F.struct(F.shiftright(a1, 1).alias("a"), F.shiftright(b1, 1).alias("b"), nodes.alias("nodes"))

    walked = F.aggregate(F.sequence(F.lit(low), F.lit(high)), start_acc, step, lambda acc: acc["nodes"])
    return F.when(start < end, walked).otherwise(F.array().cast(NODES))


def enclosing_nodes(at: Column, levels: Column, low: int, high: int) -> Column:
    """Array of the ``struct(level, node)`` that contain time ``at``, one for each level from ``low`` to ``high`` whose bit is set."""
    used = F.filter(F.sequence(F.lit(low), F.lit(high)), lambda level: F.call_function("shiftright", levels, level).bitwiseAND(F.lit(1)) == 1)
    return F.transform(used, lambda level: F.struct(level.alias("level"), F.call_function("shiftright", at, level).alias("node")))


def _span(events: DataFrame, time: str) -> tuple[int, int]:
    """The events' first time and the level of one node that covers them all."""
    r = events.agg(F.min(time).alias("a"), F.max(time).alias("b")).first()
    if r["a"] is None:
        return 0, 0
    return int(r["a"]), (int(r["b"]) - int(r["a"]) + 1).bit_length()


def _clipped_nodes(facts: DataFrame, valid_from: str, valid_to: str, origin: int, high: int, low: int) -> Column:
    """The nodes of a fact's interval, times counted from ``origin`` and clipped to ``[0, 2**high)``."""
    inside = lambda c: F.least(F.greatest(c, F.lit(origin)), F.lit(origin + (1 << high))) - F.lit(origin)
    return dyadic_nodes(inside(F.col(valid_from).cast("bigint")), inside(F.coalesce(F.col(valid_to).cast("bigint"), F.lit(origin + (1 << high)))), low, high)


def _heap(node: Column, high: int) -> Column:
    """A node as one number, as in a heap: the one of level ``high`` is 1, its halves are 2 and 3."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.lit(high) - node["level"]) + node["node"]


def _of_entities(events: DataFrame, entities: DataFrame, time: str) -> DataFrame:
    """Events of the distinct entities ``__e``; beyond a counted size the entities are not broadcast."""
    small = broadcast_if_small(entities)
    if small is not entities:
        return events.join(small, "__e", "left_semi")
    counts = Scratch(events.sparkSession, "asof").table(events.groupBy("__e").agg(F.count(F.lit(1)).alias("n")), "counts")
    return fair_join(events, entities, "__e", F.col(time), frequent_keys(counts, "__e"))


def _meet(few: DataFrame, nodes: DataFrame, time: str, origin: int, low: int, high: int) -> DataFrame:
    """Events ``(__e, ...)``, a written table, joined with nodes ``(__e, __x, ...)`` on entity and enclosing node."""
    hot = frequent_keys(few.groupBy("__e").agg(F.count(F.lit(1)).alias("n")), "__e")
    on = ["__e"]
    if hot is not None:
        on = ["__e", SALT]
        salts = F.coalesce(SALTS, F.lit(1))
        few = few.join(F.broadcast(hot), "__e", "left").withColumn(SALT, F.pmod(F.xxhash64(time), salts).cast("int")).drop(SALTS)
        nodes = nodes.join(F.broadcast(hot), "__e", "left").withColumn(SALT, F.explode(F.sequence(F.lit(0), salts - 1))).drop(SALTS)
    levels = nodes.groupBy(*on).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("__x.level"))).alias("__levels"))
    placed = few.join(levels, on).withColumn("__node", F.explode(enclosing_nodes(F.col(time).cast("bigint") - origin, F.col("__levels"), low, high)))
    seen = placed.select(*few.columns, _heap(F.col("__node"), high).alias("__node"))
    return seen.join(nodes.withColumn("__node", _heap(F.col("__x"), high)).drop("__x"), [*on, "__node"]).drop(SALT, "__node")


def asof_matches(events: DataFrame, facts: DataFrame, entity: str, event_time: str, valid_from: str, valid_to: str, *, low: int = LOW) -> DataFrame:
    """Every (event, fact) with equal entity and ``valid_from <= event_time < valid_to``.

    NULL ``valid_to`` means still valid. Events with a NULL entity or time and facts with a NULL
    entity or start match nothing. Times are any integers. The result has all columns of both; a
    facts' column that the events have, too, is named ``fact_<column>``. Both tables are read
    several times and should be written ones. No event or no fact: empty result.
    """
    clash = {c: f"fact_{c}" for c in facts.columns if c != entity and c in events.columns}
    facts = facts.withColumnsRenamed(clash)
    valid_from, valid_to = clash.get(valid_from, valid_from), clash.get(valid_to, valid_to)
    asked = events.filter(F.col(entity).isNotNull() & F.col(event_time).isNotNull()).withColumnRenamed(entity, "__e")
    origin, high = _span(asked, event_time)
    keyed = facts.filter(F.col(entity).isNotNull() & F.col(valid_from).isNotNull()).withColumnRenamed(entity, "__e")
    low = min(low, high)
    spread = keyed.withColumn("__x", F.explode(_clipped_nodes(keyed, valid_from, valid_to, origin, high, low)))
    few = Scratch(events.sparkSession, "asof").table(_of_entities(asked, keyed.select("__e").distinct(), event_time), "few")
    hit = _meet(few, spread, event_time, origin, low, high)
    inside = (F.col(event_time) >= F.col(valid_from)) & (F.col(valid_to).isNull() | (F.col(event_time) < F.col(valid_to)))
    return hit.filter(inside).withColumnRenamed("__e", entity).select(*events.columns, *(c for c in facts.columns if c != entity))


def asof_totals(events: DataFrame, facts: DataFrame, entity: str, event_time: str, valid_from: str, valid_to: str, latest: str) -> DataFrame:
    """``(entity, event_time, n_valid, latest)`` per distinct entity and time of the events.

    The number of facts valid at that time and the largest ``latest`` among them; only times with a
    valid fact have a row. Intervals are decomposed exactly (finest node one second) and facts are
    added up per node before the join, so an entity with a large share of events and facts makes
    no pairs: an event meets at most one row per level. Times are any integers; both tables are
    read several times and should be written ones.
    """
    asked = events.filter(F.col(entity).isNotNull() & F.col(event_time).isNotNull()).select(F.col(entity).alias("__e"), F.col(event_time).alias("t"))
    origin, high = _span(asked, "t")
    keyed = facts.filter(F.col(entity).isNotNull() & F.col(valid_from).isNotNull()).withColumnRenamed(entity, "__e")
    nodes = keyed.select("__e", F.col(latest).alias("l"), F.explode(_clipped_nodes(keyed, valid_from, valid_to, origin, high, 0)).alias("__x"))
    summed = nodes.groupBy("__e", "__x").agg(F.count(F.lit(1)).alias("n"), F.max("l").alias("l"))
    few = Scratch(events.sparkSession, "asof").table(_of_entities(asked, keyed.select("__e").distinct(), "t").distinct(), "few")
    return _meet(few, summed, "t", origin, 0, high).groupBy(F.col("__e").alias(entity), F.col("t").alias(event_time)).agg(F.sum("n").alias("n_valid"), F.max("l").alias(latest))


def validity_of_versions(facts: DataFrame, key: str, known_at: str, tie: str, *, bucket: int = 86_400) -> DataFrame:
    """Adds ``valid_from`` and ``valid_to``: a version holds from when it is known until the next is.

    Precedence among versions of one ``key`` known at the same time is the largest ``tie``; the
    others get an empty interval. Versions with a NULL key or time are left out. Exact repeats
    (same key, time and tie) are one version. The next version is looked up inside a time bucket
    of the key, and beyond it in the first of the key's next bucket, so that a key with very many
    versions is spread over its buckets.
    """
    rows = facts.filter(F.col(key).isNotNull() & F.col(known_at).isNotNull()).dropDuplicates([key, known_at, tie])
    placed = rows.withColumn("__bucket", F.floor(F.col(known_at) / F.lit(bucket)).cast("bigint"))
    firsts = placed.groupBy(key, "__bucket").agg(F.min(known_at).alias("__first"))
    following = firsts.select(key, "__bucket", F.lead("__first").over(Window.partitionBy(key).orderBy("__bucket")).alias("__next"))
    inside = F.lead(known_at).over(Window.partitionBy(key, "__bucket").orderBy(known_at, tie))
    joined = placed.withColumn("valid_to", inside).join(following, [key, "__bucket"])
    return joined.select(*rows.columns, F.col(known_at).alias("valid_from"), F.coalesce("valid_to", "__next").alias("valid_to"))
