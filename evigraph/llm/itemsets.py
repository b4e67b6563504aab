"""Closed itemsets of baskets and their rules, by level-wise closing.

A generator is an itemset that no proper subset of it matches in support. Level k holds the generators of k items. A pass over the baskets meets, for
each generator, all baskets that hold it: an aggregate counts the items beside it, so that the generator's support and its closure (the items that all
of its baskets share, their intersection) come out of one pass, and with them the support of every set of one item more. A set of k + 1 items is a
candidate of the next level only if each of its k-subsets is a generator of more support, that is, if none has the added item in its closure. So no
infrequent set and no set that a closure already gives is ever looked up in the baskets. The distinct closures are the closed itemsets.

Everything is a table: baskets, generators, candidates and counts meet in joins and aggregates, and none is collected or broadcast by hand. Baskets that
hold uncommonly many frequent items (fewer of them than half the least support) nominate nothing, as what only they hold is infrequent; what others
nominate is then counted in them by joins on items. So no basket is expanded into all its pairs, whatever share of the rows it has."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Fixed values of the query contract: least support, one basket in so many, and the least confidence of a rule in percent.
LEAST, ONE_IN, CONFIDENCE = 8, 5000, 10
#: Baskets of up to this many frequent items are never set aside.
ORDINARY = 16


@dataclass
class Mined:
    """What was mined: the number of baskets, (item, support) of frequent items, (gen, support, items) of generators and their closures, and
    (items, support) of closed itemsets; gen and items are ascending arrays."""

    baskets: int
    items: DataFrame
    generators: DataFrame
    closed: DataFrame


def _stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet to the shared folder and read again, and where it lies: executors that are lost take nothing with them."""
    path = C.fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def least_support(baskets: int, least: int = LEAST, one_in: int = ONE_IN) -> int:
    """The smallest support that is at least `least` and one basket in `one_in`."""
    return max(least, -(-baskets // one_in))


def widest(sizes: dict[int, int], support: int) -> int:
    """The size up to which baskets are ordinary, of {k: number of baskets of up to 2^k items}: as small as may be, with less than half of `support`
    baskets beyond it."""
    beyond = 0
    for k in sorted(sizes, reverse=True):
        if 2**k <= ORDINARY or 2 * (beyond + sizes[k]) >= support:
            return max(ORDINARY, 2**k)
        beyond += sizes[k]
    return ORDINARY


def _united(gen: Column, item: Column) -> Column:
    return F.array_sort(F.array_union(gen, F.array(item)))


def _singles(held: DataFrame, bound: int) -> DataFrame:
    """(gen, items): each item of each ordinary basket as a generator of one item."""
    ordinary = held.where(F.size("items") <= bound)
    return ordinary.select("items", F.explode("items").alias("one")).select(F.array("one").alias("gen"), "items")


def _beside(occurrences: DataFrame) -> DataFrame:
    """(gen, item, n) of occurrences(gen, items), a row for each generator and basket: in how many of the generator's baskets each other item is, and
    for its own first item in how many it is itself."""
    others = F.filter("items", lambda x: ~F.array_contains("gen", x) | (x == F.get("gen", F.lit(0))))
    return occurrences.select("gen", F.explode(others).alias("item")).groupBy("gen", "item").agg(F.count("*").alias("n"))


def _with_wide(counts: DataFrame, wide: DataFrame) -> DataFrame:
    """counts(gen, item, n) with the baskets of wide(basket, item) counted too: those that hold the generator and the item."""
    sets = counts.select("gen", "item", _united(F.col("gen"), F.col("item")).alias("all"))
    held = sets.select("gen", "item", F.size("all").alias("size"), F.explode("all").alias("one"))
    held = held.join(wide.withColumnRenamed("item", "one"), "one").groupBy("gen", "item", "size", "basket").agg(F.count("*").alias("k"))
    more = held.where("k = size").groupBy("gen", "item").agg(F.count("*").alias("more"))
    return counts.join(more, ["gen", "item"], "left").select("gen", "item", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))


def _closures(found: DataFrame) -> DataFrame:
    """(gen, support, items) of found(gen, item, n): a generator's closure has the items that are in all of its baskets."""
    own = found.where(F.col("item") == F.get("gen", F.lit(0))).select("gen", F.col("n").alias("support"))
    shared = found.join(own, "gen").where("n = support").groupBy("gen", "support").agg(F.collect_list("item").alias("with"))
    return shared.select("gen", "support", F.array_sort(F.array_union("gen", "with")).alias("items"))


def _candidates(found: DataFrame, generators: DataFrame, size: int) -> DataFrame:
    """(gen, item) of the sets of size + 1 items whose every subset of `size` items is a generator that does not have the rest in its closure: gen is all
    but the largest item, which is `item`."""
    rows = found.join(generators.select("gen", "support"), "gen").where((F.col("n") < F.col("support")) & ~F.array_contains("gen", F.col("item")))
    whole = rows.select(_united(F.col("gen"), F.col("item")).alias("all")).groupBy("all").agg(F.count("*").alias("k"))
    return whole.where(F.col("k") == size + 1).select(F.slice("all", 1, size).alias("gen"), F.element_at("all", -1).alias("item"))


def mine(rows: DataFrame, basket: str = "sale_id", item: str = "item_id", least: int = LEAST, one_in: int = ONE_IN) -> Mined:
    """The closed itemsets of rows(basket, item) with a support of at least `least` and of one basket in `one_in`.

    Rows with a null basket or item are passed over; a basket holds an item once, however often it is repeated. An empty table, or one where no item is
    frequent, gives no itemset. Other columns are not read. Items are whole numbers. The result's tables lie in the shared folder."""
    pairs = rows.select(F.col(basket).cast("long").alias("basket"), F.col(item).cast("long").alias("item")).where("basket IS NOT NULL AND item IS NOT NULL")
    pairs, all_pairs = _stored(pairs.distinct(), "baskets")
    number = pairs.agg(F.count_distinct("basket")).first()[0]
    support = least_support(number, least, one_in)
    items, _ = _stored(pairs.groupBy("item").agg(F.count("*").alias("support")).where(F.col("support") >= support), "items")
    held = pairs.join(items.select("item"), "item").groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("items"))
    held, all_held = _stored(held, "held")
    C.remove(rows.sparkSession, all_pairs)
    sizes = {r["k"]: r["n"] for r in held.groupBy(F.ceil(F.log2(F.size("items"))).alias("k")).agg(F.count("*").alias("n")).collect()}
    bound = widest(sizes, support)
    beyond = sum(n for k, n in sizes.items() if 2**k > bound)
    wide = held.where(F.size("items") > bound).select("basket", F.explode("items").alias("item"))

    occurrences, at = _singles(held, bound), None
    levels, size = [], 1
    while True:
        counts = _beside(occurrences).where(F.col("n") >= support - beyond)
        if beyond:
            counts = _with_wide(counts, wide).where(F.col("n") >= support)
        found, all_found = _stored(counts, "beside")
        generators, _ = _stored(_closures(found), "generators")
        levels.append(generators)
        candidates, all_candidates = _stored(_candidates(found, generators, size), "candidates")
        C.remove(rows.sparkSession, all_found)
        if candidates.isEmpty():
            break
        longer = occurrences.select("gen", "items", F.explode(F.filter("items", lambda x: x > F.element_at("gen", -1))).alias("item"))
        longer = longer.join(candidates, ["gen", "item"]).select(F.concat("gen", F.array("item")).alias("gen"), "items")
        before, (occurrences, at) = at, _stored(longer, "occurrences")
        for path in filter(None, (before, all_candidates)):
            C.remove(rows.sparkSession, path)
        size += 1
    for path in filter(None, (at, all_held)):
        C.remove(rows.sparkSession, path)
    generators = reduce(DataFrame.unionByName, levels)
    closed, _ = _stored(generators.select("items", "support").distinct(), "closed")
    return Mined(number, items, generators, closed)


def _supports(sets: DataFrame, mined: Mined) -> DataFrame:
    """(part, a) for each distinct set in sets(part), subsets of closed itemsets: its support.

    Generators and closed itemsets are looked up as they are. Any other set has the support of its closure, the largest one of all closed itemsets
    around it; they are found through the set's item that the fewest closed itemsets have."""
    known = mined.generators.select(F.col("gen").alias("part"), "support").union(mined.closed.select("items", "support")).distinct()
    looked = sets.distinct().join(known, "part", "left")
    looked, _ = _stored(looked, "supports")
    rest = looked.where("support IS NULL").select("part")
    each = mined.closed.select(F.explode("items").alias("item"), "items", "support")
    often = each.groupBy("item").agg(F.count("*").alias("k"))
    probes = rest.select("part", F.explode("part").alias("item")).join(often, "item").groupBy("part").agg(F.min(F.struct("k", "item")).alias("m"))
    around = probes.select("part", F.col("m.item").alias("item")).join(each, "item").where(F.size(F.array_except("part", "items")) == 0)
    found = around.groupBy("part").agg(F.max("support").alias("a"))
    return looked.where("support IS NOT NULL").select("part", F.col("support").alias("a")).unionByName(found)


def rules(mined: Mined, confidence: int = CONFIDENCE) -> DataFrame:
    """(items, support, item, a, s): for closed itemsets of two or more items, the rules that their other items (of support a) lead to `item` (of support
    s), with a confidence of at least so many percent and a lift above 1."""
    parts = mined.closed.where(F.size("items") > 1).select("items", "support", F.explode("items").alias("item"))
    parts = parts.withColumn("part", F.array_except("items", F.array("item")))
    supports = mined.items.select("item", F.col("support").alias("s"))
    told = parts.join(_supports(parts.select("part"), mined), "part").join(supports, "item")
    sure = (100 * F.col("support") >= confidence * F.col("a")) & (F.col("support") * F.lit(mined.baskets) > F.col("a") * F.col("s"))
    return told.where(sure).select("items", "support", "item", "a", "s")


def report(mined: Mined, confidence: int = CONFIDENCE) -> DataFrame:
    """items, n_items, support, n_rules, best_item and rules_sha256 of each closed itemset: see the query's contract."""
    text = F.concat_ws(":", "item", "a", "s")
    per = rules(mined, confidence).groupBy("items").agg(
        F.count("*").alias("n_rules"),
        F.min_by("item", F.struct("a", "item")).alias("best_item"),
        F.transform(F.array_sort(F.collect_list(F.struct("item", text.alias("text")))), lambda x: x["text"]).alias("texts"),
    )
    rows = mined.closed.join(per, "items", "left")
    return rows.select(
        F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"),
        F.size("items").cast("long").alias("n_items"),
        "support",
        F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"),
        "best_item",
        F.sha2(F.coalesce(F.array_join("texts", ";"), F.lit("")), 256).alias("rules_sha256"),
    )
