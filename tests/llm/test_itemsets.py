import hashlib
import itertools
import random

from evigraph.llm import itemsets
from pyspark.sql import functions as F


def brute(rows, least, one_in, confidence=10):
    """Every closed itemset by trying all sets that a basket holds, and its rules."""
    baskets = {}
    for basket, item in rows:
        if basket is not None and item is not None:
            baskets.setdefault(basket, set()).add(item)
    count = {}
    support = max(least, -(-len(baskets) // one_in))
    often = {i for i in set().union(*baskets.values(), set()) if sum(i in b for b in baskets.values()) >= support}
    for b in baskets.values():
        kept = sorted(b & often)
        for k in range(1, len(kept) + 1):
            for x in itertools.combinations(kept, k):
                count[x] = count.get(x, 0) + 1
    frequent = {x: n for x, n in count.items() if n >= support}
    closed = {x: n for x, n in frequent.items() if not any(set(x) < set(y) and n == m for y, m in frequent.items())}
    out = {}
    for x, n in closed.items():
        found = []
        for c in x if len(x) > 1 else ():
            a, s = frequent[tuple(i for i in x if i != c)], frequent[(c,)]
            if 100 * n >= confidence * a and n * len(baskets) > a * s:
                found.append((c, a, s))
        best = min(((a, c) for c, a, _ in found), default=(None, None))[1]
        text = ";".join(f"{c}:{a}:{s}" for c, a, s in found)
        out[",".join(map(str, x))] = (len(x), n, len(found), best, hashlib.sha256(text.encode()).hexdigest())
    return out


def mined(frame, **options):
    rows = itemsets.report(itemsets.mine(frame, **options)).collect()
    assert len({r["items"] for r in rows}) == len(rows)
    return {r["items"]: (r["n_items"], r["support"], r["n_rules"], r["best_item"], r["rules_sha256"]) for r in rows}


def planted(seed, n, wide=0):
    """Baskets of a few of 14 items, some items always together, repeated rows, nulls, and `wide` baskets that hold nearly all items."""
    rng = random.Random(seed)
    rows = []
    for b in range(n):
        items = {min(int(rng.expovariate(0.35)), 13) for _ in range(rng.randint(1, 5))}
        if 3 in items:
            items.add(11)
        if {1, 2} <= items:
            items.add(12)
        rows += [(b, i) for i in items]
    rows += [(n + k, i) for k in range(wide) for i in range(14) if rng.random() < 0.9]
    rows += rng.choices(rows, k=20) + [(None, 1), (5, None), (None, None)]
    rng.shuffle(rows)
    return rows


def test_closed_itemsets_and_rules_match_brute_force(spark):
    rows = planted(1, 160)
    frame = spark.createDataFrame(rows, "sale_id long, item_id long").withColumns({c: F.lit("x") for c in ("basket", "item", "gen", "n", "support", "items")})
    expected = brute(rows, 4, 5000)
    assert mined(frame, least=4) == expected
    assert any(v[0] >= 3 for v in expected.values()) and any(v[2] for v in expected.values())


def test_wide_baskets_are_counted_without_being_expanded(spark, monkeypatch):
    monkeypatch.setattr(itemsets, "ORDINARY", 4)
    rows = planted(2, 90, wide=2)
    assert itemsets.widest({1: 30, 2: 40, 3: 20, 4: 2}, 5) == 8
    assert mined(spark.createDataFrame(rows, "sale_id long, item_id long"), least=5) == brute(rows, 5, 5000)


def test_one_basket_in_so_many(spark):
    rows = planted(3, 120)
    frame = spark.createDataFrame(rows, "sale_id long, item_id long")
    assert mined(frame, least=2, one_in=10) == brute(rows, 2, 10)


def test_supports_of_sets_that_are_neither_closed_nor_generators(spark):
    """1, 2 and 3 are always together, and so 2,3,4 without 1 is no generator and not closed."""
    rows = [(b, i) for b in range(6) for i in (1, 2, 3, 4)] + [(b, i) for b in range(6, 15) for i in (1, 2, 3)] + [(b, 4) for b in range(15, 24)] + [(b, 9) for b in range(24, 80)]
    assert mined(spark.createDataFrame(rows, "sale_id long, item_id long"), least=3) == brute(rows, 3, 5000)


def test_widest():
    assert itemsets.widest({}, 8) == 16
    assert itemsets.widest({0: 1000, 3: 50, 9: 3}, 8) == 16
    assert itemsets.widest({0: 1000, 6: 3, 9: 3}, 8) == 64
    assert itemsets.widest({9: 4}, 8) == 512


def test_tables_without_a_frequent_item(spark):
    assert mined(spark.createDataFrame([], "sale_id long, item_id long")) == {}
    assert mined(spark.createDataFrame([(1, 1), (1, 2), (2, None), (None, 3)], "sale_id long, item_id long")) == {}
