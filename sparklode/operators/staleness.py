"""Which rows' fingerprints an edit has changed, found by rebuilding the text as it was before.

An item's fingerprint is taken over its fields and parts in order, in the form in which texts are compared, so an edit that only
changes case or spacing doesn't count, and neither does one of a field outside the fingerprint. A journal says what some fields
and parts held before: overlaid on the present values it gives the old text. No dates are compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklode.functions import text as T

#: The fields of the fingerprint, in order; parts follow, by number.
FIELDS = ("title", "statement")
PART = "part"


def slots(items: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, slot, value): every field and part of the fingerprint of items (id, title, statement) and parts (id, part, value)."""
    named = F.explode(F.array(*[F.struct(F.lit(f"{k}").alias("slot"), F.coalesce(F.col(f), F.lit("")).alias("value")) for k, f in enumerate(FIELDS)])).alias("x")
    return items.select("id", named).select("id", "x.slot", "x.value").unionByName(parts.select("id", _part_slot().alias("slot"), F.coalesce("value", F.lit("")).alias("value")))


def _part_slot():
    return F.concat(F.lit(f"{PART}-"), F.lpad(F.col("part").cast("string"), 9, "0"))


def overrides(journal: DataFrame) -> DataFrame:
    """(id, slot, old) of a journal (seq, id, field, part, old): of several entries on one place the last one holds; entries on
    other fields fall away."""
    place = F.when(F.col("field") == PART, _part_slot())
    for k, f in enumerate(FIELDS):
        place = place.when(F.col("field") == f, F.lit(f"{k}"))
    named = journal.withColumn("slot", place).where("slot is not null")
    return named.groupBy("id", "slot").agg(F.coalesce(F.max_by("old", "seq"), F.lit("")).alias("old"))


def touched(present: DataFrame, journal: DataFrame) -> DataFrame:
    """(id, stale) of the items of which a journal holds another value than the present one: stale where the fingerprint of the
    text as it was differs. present: as `slots` gives it. Journal entries on items or parts that are gone are passed over.

    Only touched items are rebuilt; an item's places come together, never more."""
    changed = overrides(journal).join(present, ["id", "slot"]).where("old <> value").select("id", "slot", "old")
    rows = present.join(changed.select("id").distinct(), "id", "left_semi").join(changed, ["id", "slot"], "left")
    digest = lambda c: F.sha1(T.collapse(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", c.alias("v")))), lambda s: s["v"]), " \n ")))
    both = rows.groupBy("id").agg(digest(F.col("value")).alias("now"), digest(F.coalesce("old", "value")).alias("before"))
    return both.select("id", (F.col("now") != F.col("before")).alias("stale"))


def audit(present: DataFrame, journals: dict[str, DataFrame]) -> DataFrame:
    """(journal, entries, touched, stale), one row per journal, then `union` and `intersection` of the stale items."""
    found = None
    for name, journal in journals.items():
        part = touched(present, journal).withColumn("journal", F.lit(name))
        found = part if found is None else found.unionByName(part)
    sizes = None
    for name, journal in journals.items():
        one = journal.groupBy().agg(F.count("*").alias("entries")).withColumn("journal", F.lit(name))
        sizes = one if sizes is None else sizes.unionByName(one)
    counted = found.groupBy("journal").agg(F.count("*").alias("touched"), F.count_if("stale").alias("stale"))
    own = sizes.join(counted, "journal", "left").select("journal", "entries", F.coalesce("touched", F.lit(0)).alias("touched"), F.coalesce("stale", F.lit(0)).alias("stale"))
    by_id = found.where("stale").groupBy("id").agg(F.count("*").alias("n"))
    both = by_id.agg(F.count("*").alias("any"), F.count_if(F.col("n") == len(journals)).alias("all"))
    rows = F.explode(F.array(F.struct(F.lit("union").alias("journal"), F.col("any").alias("stale")), F.struct(F.lit("intersection").alias("journal"), F.col("all").alias("stale")))).alias("x")
    none = F.lit(None).cast("long")
    return own.unionByName(both.select(rows).select("x.journal", none.alias("entries"), none.alias("touched"), "x.stale"))
