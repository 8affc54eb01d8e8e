"""Many exact-key lookups of one request table in a fact table, in one join.

Joining requests to all units of their parcel would emit every pair inside a large parcel.  Here the
fact table is first aggregated to one row per key (a few kinds of keys per fact row), so a lookup
never fans out.  Facts meet the list of asked parcels by (pnu, salt), where only a parcel that is too
large for one task has more than one salt: the large ones and their sizes come from a top-k sketch.
Behind that, Spark puts an exchange on the full key between the partial aggregate and the final one.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows of one parcel that a task may get, and the most parcels that can be split.  The sketch tracks ten
#: times as many; a parcel it misses has less than that share of all rows.
ROWS_PER_TASK = 200_000
MOST_SPLIT = 10_000


def split_parcels(facts: DataFrame) -> DataFrame:
    """(pnu, splits): parcels with more than ``ROWS_PER_TASK`` rows and the tasks each one needs; at most ``MOST_SPLIT`` rows.

    The sketch is merged from all partitions and never undercounts by more than its error bound, so a
    parcel gets at most a few splits too many or too few; results do not depend on them.
    """
    top = facts.agg(F.call_function("approx_top_k", F.col("pnu"), F.lit(MOST_SPLIT), F.lit(10 * MOST_SPLIT)).alias("top"))
    listed = top.select(F.explode("top").alias("x")).select(F.col("x.item").alias("pnu"), F.col("x.count").alias("n"))
    return listed.where(F.col("n") > ROWS_PER_TASK).select("pnu", F.ceil(F.col("n") / ROWS_PER_TASK).cast("int").alias("_splits"))


def of_parcels(facts: DataFrame, parcels: DataFrame) -> DataFrame:
    """Facts of the listed parcels (unique ``pnu``), with the other columns of ``parcels``.

    The salt comes from the labels of a unit, so it is the same when a lost task runs again; copies of one
    unit share a salt.
    """
    large = F.broadcast(split_parcels(facts))  # bounded by MOST_SPLIT
    splits = F.coalesce("_splits", F.lit(1))
    salted = facts.join(large, "pnu", "left").withColumn("_salt", F.pmod(F.xxhash64("dong", "floor", "ho"), splits).cast("int")).drop("_splits")
    wanted = parcels.join(large, "pnu", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), splits - 1))).drop("_splits")
    return salted.join(wanted, ["pnu", "_salt"]).drop("_salt")


@dataclass(frozen=True)
class Key:
    """One kind of key: its parts, and the rows it applies to (null: all)."""

    kind: str | Column
    first: Column
    second: Column
    when: Column | None = None

    def struct(self, slot: str | None = None) -> Column:
        kind = F.lit(self.kind) if isinstance(self.kind, str) else self.kind
        fields = [kind.alias("kind"), self.first.alias("k1"), self.second.alias("k2")]
        if slot is not None:
            fields.insert(0, F.lit(slot).alias("slot"))
        value = F.struct(*fields)
        return value if self.when is None else F.when(self.when, value)


def aggregate_by_keys(facts: DataFrame, keys: list[Key], unit: Column, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """(pnu, kind, k1, k2) -> ``n``, the smallest ``unit`` struct and extra aggregates."""
    exploded = facts.select(
        "pnu", F.explode(F.array_compact(F.array(*[k.struct() for k in keys]))).alias("key"), unit.alias("unit"),
        *[value.alias(f"_{name}") for name, value in (extra or {}).items()],
    )
    return exploded.groupBy("pnu", "key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("unit").alias("unit"),
        *[F.max(f"_{name}").alias(name) for name in (extra or {})],
    )


def count_by_keys(facts: DataFrame, keys: list[Key], identity: Column) -> DataFrame:
    """(pnu, kind, k1, k2) -> ``n`` and the smallest ``identity``, a bigint: plain columns and counters, aggregated by hash.

    Where ``n`` is 1 the identity names the one fact; rows stay narrow however many kinds of keys there are.
    """
    exploded = facts.select("pnu", identity.alias("id"), F.explode(F.array_compact(F.array(*[k.struct() for k in keys]))).alias("key"))
    return exploded.select("pnu", "key.*", "id").groupBy("pnu", "kind", "k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))


def count_lookup(requests: DataFrame, slots: Mapping[str, Key], table: DataFrame, request: str = "request_id") -> DataFrame:
    """Per request (unique ``request``) and slot, ``<slot>_n`` (0 without a row) and ``<slot>_id`` of its key's row in ``count_by_keys``.

    Only the request's name and its keys travel; the caller joins the result to what else a request holds.
    """
    keyed = requests.select(request, "pnu", F.explode(F.array_compact(F.array(*[k.struct(s) for s, k in slots.items()]))).alias("key")).select(request, "pnu", "key.*")
    found = keyed.join(table, ["pnu", "kind", "k1", "k2"])
    each = [F.max(F.when(F.col("slot") == s, F.col(c))).alias(f"{s}_{c}") for s in slots for c in ("n", "id")]
    return found.groupBy(request).agg(*each).withColumns({f"{s}_n": F.coalesce(f"{s}_n", F.lit(0).cast("bigint")) for s in slots})


def lookup(requests: DataFrame, slots: Mapping[str, Key], table: DataFrame) -> DataFrame:
    """Add one struct column per slot with the table row of its key (null when there is none).

    Request rows must be distinct; each comes back exactly once.
    """
    columns = requests.columns
    payload = [c for c in table.columns if c not in ("pnu", "key")]
    keyed = requests.select(*columns, F.explode(F.array_compact(F.array(*[k.struct(s) for s, k in slots.items()]))).alias("_wanted"))
    keyed = keyed.select(*columns, F.col("_wanted.slot").alias("_slot"), F.struct("_wanted.kind", "_wanted.k1", "_wanted.k2").alias("key"))
    found = keyed.join(table, ["pnu", "key"], "left")
    return found.groupBy(*columns).agg(
        *[
            F.max(F.when((F.col("_slot") == slot) & F.col("n").isNotNull(), F.struct(*payload))).alias(slot)
            for slot in slots
        ]
    )
