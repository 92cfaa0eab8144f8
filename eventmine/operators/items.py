"""Items: top-k, item pairs, frequent itemsets, recommendations."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sizing import bounded_broadcast
from .ordered import global_positions


def top_k(df: DataFrame, group: list[str] | str, metric: str, k: int, ties: str = "break",
          tiebreak: list[str] | None = None, ascending: bool = False, out: str = "rank"
          ) -> DataFrame:
    """P20. The best ``k`` rows per group by ``metric`` (largest first unless
    ``ascending``). ``ties='break'``: exactly k rows, ties ordered by
    ``tiebreak`` (make it unique for a reproducible answer); ``'keep'``: every
    row whose value is among the top k distinct values (``dense_rank``).

    ``rank-function <= k`` lets Catalyst insert a partial window-group limit
    before the shuffle, so each map task sends at most k rows (k distinct
    values for 'keep') per group — a hot group does not move whole."""
    group = [group] if isinstance(group, str) else list(group)
    m = F.col(metric).asc() if ascending else F.col(metric).desc()
    order = [m] + [F.col(c).asc() for c in (tiebreak or [])]
    w = Window.partitionBy(*group).orderBy(*order)
    fn = {"break": F.row_number(), "keep": F.dense_rank()}[ties]
    return df.withColumn(out, fn.over(w)).where(F.col(out) <= k)


def basket_items(lineitem: DataFrame, part: DataFrame, item_col: str = "p_brand") -> DataFrame:
    """(basket, item) for each order line, item taken from ``part``."""
    return (lineitem.select(F.col("l_orderkey").alias("basket"), "l_partkey")
            .join(part.select(F.col("p_partkey").alias("l_partkey"), F.col(item_col).alias("item")),
                  "l_partkey")
            .select("basket", "item"))


def pair_rules(basket_items_df: DataFrame, min_count: int, basket: str = "basket",
               item: str = "item", block: int = 1000) -> DataFrame:
    """P21. For item pairs (a < b) in at least ``min_count`` baskets: count,
    support, confidence both ways and lift.

    Items below ``min_count`` cannot be in such a pair and are dropped first
    (a join against the frequent items). The ``k = min_count - 1`` largest
    baskets are never expanded: a pair in ``min_count`` baskets must be in
    another one as well, so pairs come from the others, and each then gets the
    number of set-aside baskets holding both items: every item has a bitset
    over the set-aside baskets, and the bits that two have in common are
    counted, one row a candidate. That is exact whatever the sizes, and it is
    always done. The set-aside baskets are k rows, a parameter; they are
    broadcast if they are few.

    The other baskets' pairs come from an equi-join per (basket, block pair),
    ``block`` items to a block: no basket is gathered into one row, a large
    one is many join keys, and pair counts are partially aggregated before
    their shuffle.

    The distinct (basket, item) table feeds several branches and is
    checkpointed once to the shared checkpoint folder."""
    from ..session import checkpoint_dir

    bi = basket_items_df.select(F.col(basket).alias("_b"), F.col(item).alias("_i")).distinct()
    checkpoint_dir(bi.sparkSession)
    bi = bi.checkpoint(eager=True)
    n_baskets = bi.select("_b").distinct().agg(F.count(F.lit(1)))
    item_n = bi.groupBy("_i").agg(F.count(F.lit(1)).alias("_n"))
    frequent = item_n.where(F.col("_n") >= min_count)
    fb = bi.join(frequent.select("_i"), "_i", "left_semi")
    sizes = fb.groupBy("_b").agg(F.count(F.lit(1)).alias("_m"))
    # one partition of at most k rows: the numbers count up from 0
    numbered = (sizes.orderBy(F.col("_m").desc(), F.col("_b")).limit(max(min_count - 1, 0)).select("_b")
                .coalesce(1).withColumn("_no", F.monotonically_increasing_id()).checkpoint(eager=True))
    numbered = bounded_broadcast(numbered)
    aside = numbered.select("_b")
    others = fb.join(aside, "_b", "left_anti").join(
        sizes.select("_b", F.ceil(F.col("_m") / block).cast("int").alias("_blocks")), "_b")
    mine = F.pmod(F.xxhash64("_i"), F.col("_blocks")).cast("int")
    others = (others.withColumn("_mine", mine)
              .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
              .select("_b", "_i", "_mine", F.least("_mine", "_other").alias("_lo"), F.greatest("_mine", "_other").alias("_hi")))
    x = others.where("_mine = _lo").select("_b", "_lo", "_hi", F.col("_i").alias("_x"))
    y = others.where("_mine = _hi").select("_b", "_lo", "_hi", F.col("_i").alias("_y"))
    cand = (x.join(y, ["_b", "_lo", "_hi"]).where((F.col("_x") < F.col("_y")) | ((F.col("_lo") < F.col("_hi")) & (F.col("_x") > F.col("_y"))))
             .groupBy(F.least("_x", "_y").alias("item_a"), F.greatest("_x", "_y").alias("item_b"))
             .agg(F.count(F.lit(1)).alias("_n_norm")))
    # per item, which of the set-aside baskets hold it: a bitset of at most k bits
    words = fb.join(numbered, "_b").groupBy("_i", F.shiftright("_no", 6).cast("int").alias("_w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(_no & 63 AS int))")).alias("_bits"))
    bits = words.groupBy("_i").agg(F.map_from_entries(F.collect_list(F.struct("_w", "_bits"))).alias("_bits")).checkpoint(eager=True)

    def of(side: str) -> DataFrame:
        return bits.select(F.col("_i").alias(f"item_{side}"), F.col("_bits").alias(f"_{side}"))

    both = F.aggregate(F.map_keys("_a"), F.lit(0).cast("bigint"), lambda n, w: n + F.bit_count(
        F.col("_a")[w].bitwiseAND(F.coalesce(F.try_element_at("_b", w), F.lit(0).cast("bigint")))))
    in_hot = (cand.select("item_a", "item_b").join(of("a"), "item_a").join(of("b"), "item_b")
                  .select("item_a", "item_b", both.alias("_n_hot")))
    cand = (cand.join(in_hot, ["item_a", "item_b"], "left")
                .withColumn("_n_norm", F.col("_n_norm") + F.coalesce(F.col("_n_hot"), F.lit(0))))
    pairs = (cand.select("item_a", "item_b", F.col("_n_norm").alias("n_ab"))
                 .where(F.col("n_ab") >= min_count))
    na = frequent.select(F.col("_i").alias("item_a"), F.col("_n").alias("n_a"))
    nb = frequent.select(F.col("_i").alias("item_b"), F.col("_n").alias("n_b"))
    total = n_baskets.scalar()
    j = pairs.join(na, "item_a").join(nb, "item_b")
    return j.select(
        "item_a", "item_b", "n_ab", "n_a", "n_b",
        F.round(F.col("n_ab") / total, 9).alias("support"),
        F.round(F.col("n_ab") / F.col("n_a"), 9).alias("conf_ab"),
        F.round(F.col("n_ab") / F.col("n_b"), 9).alias("conf_ba"),
        F.round(F.col("n_ab") * total / (F.col("n_a") * F.col("n_b")), 9).alias("lift"))


def frequent_itemsets(basket_items_df: DataFrame, min_support: float, basket: str = "basket",
                      item: str = "item", block: int = 16_384) -> DataFrame:
    """P22. Itemsets of every size in at least ``min_support`` of the baskets
    (null items don't count, a basket without others does). ``items`` is
    sorted; size-2 rows equal ``pair_rules`` at the same count threshold.

    Vertical layout: baskets are numbered and cut into blocks of ``block``;
    per frequent item and block, a bitmap says which baskets hold it (64 to a
    word). Itemsets grow by one item a level: two of a level with the same
    beginning are joined on (block, beginning), the words are ANDed and the
    bits counted, so only counts are shuffled. What reaches the threshold is
    ANDed once more and becomes the next level's bitmaps.

    No basket is one row anywhere: it is a bit, whatever its size, and a block
    has a row per frequent itemset of the level at most. There are at most
    (mean basket size) / ``min_support`` frequent items."""
    from ..session import checkpoint_dir

    checkpoint_dir(basket_items_df.sparkSession)
    given = basket_items_df.select(F.col(basket).alias("_b"), F.col(item).alias("_i")).distinct().checkpoint(eager=True)
    baskets = given.select("_b").distinct()
    least = max(1, math.ceil(min_support * baskets.count()))
    counts = given.where(F.col("_i").isNotNull()).groupBy("_i").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= least)
    numbered = global_positions(baskets, "_b", [], out="_no").select(F.col("_b").alias("_of"), (F.col("_no") - 1).alias("_no"))
    placed = given.join(counts, "_i", "left_semi")
    placed = placed.join(numbered, placed["_b"].eqNullSafe(numbered["_of"])).select(
        F.array("_i").alias("items"), F.expr(f"_no div {block}").alias("_block"), F.expr(f"cast(_no % {block} AS int)").alias("_bit"))
    words = placed.groupBy("items", "_block", F.shiftright("_bit", 6).alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, _bit & 63)")).alias("_bits"))
    by_word = words.groupBy("items", "_block").agg(F.map_from_entries(F.collect_list(F.struct("_w", "_bits"))).alias("_m"))
    bitmap = F.transform(F.sequence(F.lit(0), F.lit((block - 1) // 64)), lambda w: F.coalesce(F.try_element_at("_m", w), F.lit(0).cast("bigint")))
    level = by_word.select("items", "_block", bitmap.alias("_bits")).checkpoint(eager=True)
    out = counts.select(F.array("_i").alias("items"), F.lit(1).alias("size"), "freq")
    size = 1
    while True:
        head, last = F.slice("items", 1, size - 1), F.element_at("items", -1)
        sides = [level.select("_block", head.alias("_head"), F.col("items").alias(f"_{c}"), last.alias(f"_last{c}"), F.col("_bits").alias(f"_bits{c}")) for c in "xy"]
        pairs = sides[0].join(sides[1], ["_block", "_head"]).where(F.col("_lastx") < F.col("_lasty")).select(
            F.concat("_x", F.array("_lasty")).alias("items"), "_block", F.zip_with("_bitsx", "_bitsy", lambda x, y: x.bitwiseAND(y)).alias("_bits"))
        n = F.aggregate("_bits", F.lit(0).cast("bigint"), lambda a, w: a + F.bit_count(w))
        size += 1
        found = pairs.select("items", n.alias("n")).groupBy("items").agg(F.sum("n").alias("freq")).where(F.col("freq") >= least)
        found = found.select("items", F.lit(size).alias("size"), "freq").checkpoint(eager=True)
        if found.isEmpty():
            return out
        out = out.unionAll(found)
        level = pairs.join(bounded_broadcast(found.select("items")), "items", "left_semi").checkpoint(eager=True)


def _numbered(ids: DataFrame, column: str, out: str) -> DataFrame:
    """The distinct values of ``column`` (not null) with numbers from 0 on."""
    distinct = ids.select(column).where(F.col(column).isNotNull()).distinct()
    return global_positions(distinct, column, [], out=out).withColumn(out, (F.col(out) - 1).cast("int")).checkpoint(eager=True)


def als_factors(interactions: DataFrame, user: str = "user_id", item: str = "item", weight: str = "n", rank: int = 8,
                max_iter: int = 8, reg: float = 0.1, alpha: float = 1.0, seed: int = 42, blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Factors of users (``user``, ``features``) and of items (``item``,
    ``features``) from implicit counts with ALS (``implicitPrefs=True``). Users
    and items are of any type that has an order; the numbers that ALS needs are
    their ranks, worked out by Spark (at most 2**31 of each). Rows without a
    user or an item are left out. ``blocks`` (of users and of items) defaults
    to the cluster's default parallelism."""
    from pyspark.ml.recommendation import ALS

    from ..session import checkpoint_dir

    spark = interactions.sparkSession
    checkpoint_dir(spark)
    # numbering and every ALS pass read the interactions: compute them once
    given = interactions.select(F.col(user).alias("_user"), F.col(item).alias("_item"), F.col(weight).cast("float").alias("_w")).where(
        F.col("_user").isNotNull() & F.col("_item").isNotNull()).checkpoint(eager=True)
    users, items = _numbered(given, "_user", "_u"), _numbered(given, "_item", "_i")
    data = given.join(items, "_item").join(users, "_user").select("_u", "_i", "_w").checkpoint(eager=True)
    blocks = blocks or spark.sparkContext.defaultParallelism
    model = ALS(userCol="_u", itemCol="_i", ratingCol="_w", implicitPrefs=True, rank=rank, maxIter=max_iter, regParam=reg, alpha=alpha,
                seed=seed, numUserBlocks=blocks, numItemBlocks=blocks, coldStartStrategy="drop", checkpointInterval=4).fit(data)
    return tuple(factors.join(names, factors["id"] == names[no]).select(F.col(c).alias(to), "features").checkpoint(eager=True) for factors, names, no, c, to in (
        (model.userFactors, users, "_u", "_user", user), (model.itemFactors, items, "_i", "_item", item)))


def top_by_product(users: DataFrame, items: DataFrame, k: int, user: str = "user_id", item: str = "item",
                   first: int = 1024, most: int = 65_536) -> DataFrame:
    """The ``k`` items of largest inner product with each user, exactly:
    (user, item, rank, score), ties by the item's place (larger norm, then
    smaller item).

    Items are ordered by norm and taken block by block, largest norms first
    (``first`` items, then twice as many each time up to ``most``, so a block
    is a bounded broadcast). A product is at most the product of the norms:
    users whose k-th score is above their norm times the next block's largest
    norm are done and take no part in further rounds. Each round is one pass
    over the users left, written to the shared checkpoint folder."""
    from ..session import checkpoint_dir

    checkpoint_dir(users.sparkSession)
    norm = F.sqrt(F.aggregate("features", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    placed = global_positions(items.select(F.col(item).alias("_item"), "features").withColumn("_norm", norm), "_norm", ["_item"],
                              out="_pos", descending=True).checkpoint(eager=True)
    n_items = placed.count()
    kind = users.schema[user].dataType
    state = T.StructType([T.StructField("_user", kind), T.StructField("features", T.ArrayType(T.FloatType())), T.StructField("_at", T.ArrayType(T.LongType())),
                          T.StructField("_scores", T.ArrayType(T.DoubleType())), T.StructField("_done", T.BooleanType())])
    active = users.select(F.col(user).alias("_user"), "features", F.array().cast("array<bigint>").alias("_at"), F.array().cast("array<double>").alias("_scores"))
    finished, at, size = None, 0, first
    while at < n_items:
        rows = placed.where(F.col("_pos").between(at + 1, at + size + 1)).orderBy("_pos").select("features", "_norm").collect()
        block = np.array([r["features"] for r in rows[:size]], np.float64)
        bound = rows[size]["_norm"] if len(rows) > size else -1.0
        looked = active.mapInArrow(_looked_at(block, at, bound, k), state).checkpoint(eager=True)
        done = looked.where("_done")
        finished = done if finished is None else finished.unionAll(done)
        active = looked.where("NOT _done").drop("_done")
        at, size = at + size, min(2 * size, most)
        if active.isEmpty():
            break
    if finished is None:
        finished = active.withColumn("_done", F.lit(True))
    best = finished.select("_user", F.posexplode(F.arrays_zip("_at", "_scores")).alias("_nth", "_best"))
    best = best.select("_user", (F.col("_nth") + 1).alias("rank"), F.col("_best._at").alias("_pos"), F.round("_best._scores", 6).alias("score"))
    names = bounded_broadcast(placed.select("_pos", "_item"))
    return best.join(names, "_pos").select(F.col("_user").alias(user), F.col("_item").alias(item), "rank", "score")


def _looked_at(block: np.ndarray, at: int, bound: float, k: int):
    """Users' best after a block of items that stands from place ``at`` on;
    ``bound``: the largest norm behind it (below zero: none)."""
    def work(batches):
        for b in batches:
            vectors = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, -1)
            places, scores, done = [], [], []
            for x, old_at, old in zip(vectors, b.column(2).to_pylist(), b.column(3).to_pylist()):
                product = (block * x).sum(axis=1)  # the same sum for an item in whatever block
                near = np.argpartition(-product, k - 1)[:k] if len(product) > k else np.arange(len(product))
                near = np.flatnonzero(product >= product[near].min())  # with all that tie
                score, place = np.concatenate([old, product[near]]), np.concatenate([np.array(old_at, np.int64), near + at + 1])
                order = np.lexsort((place, -score))[:k]
                places.append(place[order].tolist())
                scores.append(score[order].tolist())
                reach = np.sqrt((x * x).sum()) * bound * (1 + 1e-9)
                done.append(bool(bound < 0 or (len(order) == k and score[order[-1]] > reach)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(places, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64())),
                                              pa.array(done, pa.bool_())], names=["_user", "features", "_at", "_scores", "_done"])
    return work


def recommend(interactions: DataFrame, k: int, user: str = "user_id", item: str = "item", weight: str = "n", **options) -> DataFrame:
    """P23. Top-``k`` items per user from implicit counts: (user, item, rank,
    score) by the products of :func:`als_factors` (``options``)."""
    users, items = als_factors(interactions, user, item, weight, **options)
    return top_by_product(users, items, k, user, item)
