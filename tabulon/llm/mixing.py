"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Only DataFrame functions are used; no Python runs on the executors.

* Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share
  all words. A target stops at ``most`` times its source's words; what is above is
  shared again by weight until no target is above.
* Blocks: a document's hash (of its id; of its text where it has no id) gives it one of ``blocks``
  blocks of its source, so their order is already a random permutation; equal rows go on to the
  next blocks, so that no block holds many. A source is taken whole as often as its target
  allows; for the rest, blocks are drawn in order, leaving those that would pass the
  target, and one more if that comes nearer.
* Splitting tree: a source's quota counts its blocks taken, repeats included. From the
  root down, each node's quotas are split between its two children by a multivariate
  hypergeometric draw (one hypergeometric draw per source, given those before it),
  until there are 2 ** ``depth`` output shards. A source's taken blocks, in order, go
  to the shards by these exact quotas, so shards hold disjoint blocks.
* Rows are then dealt by shard and sorted by a hash inside it: the local shuffle.

Sizes are counts of words; null text has none. A source of no words has target 0 and
nothing taken. Null ids and sources are values like others; repeated rows count as
often as they come. An empty table gives an empty result. All draws follow from hashes
of the id and the seed, so reruns agree.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulon.llm.common import kept, numbered, small_or_plain, unit_hash, word_count

SEED = 20_240_613
BLOCKS = 1024
DEPTH = 4
MOST = 3
#: Rows of a shard's part, about.
ROWS_PER_PART = 20_000


def hash32(key: Column, salt: str) -> Column:
    """32 bits of the MD5 of a salted key, which any SQL engine can compute too."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f"/{salt}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, source: str = "source", size: str = "size", most: int = MOST) -> DataFrame:
    """number, source, source_size and target of each source.

    Filling up by weight stops first where ``most`` x size / weight is least. With the
    sources in that order, the first ones stop as long as an equal share of what is
    left would pass their limit; the others share the remainder by weight.
    """
    per = sizes.groupBy(source).agg(F.sum(size).alias("source_size"))
    by_name = Window.orderBy(F.col(source).asc_nulls_last())
    per = per.withColumn("number", F.row_number().over(by_name))
    per = per.withColumn("weight", F.pmod(F.col("number") - 1, F.lit(3)) + 1)
    limit = F.col("source_size") * most
    by_limit = Window.orderBy((limit / F.col("weight")), "number")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    per = per.withColumns({
        "all_words": F.sum("source_size").over(everything),
        "left_words": F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0)),
        "left_weight": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    stops = limit * F.col("left_weight") <= F.col("left_words") * F.col("weight")
    per = per.withColumn("stops", stops)
    # once one doesn't stop, none after it does
    free = F.min(F.when(~F.col("stops"), F.struct((limit / F.col("weight")).alias("l"), "number", "left_words",
                                                  "left_weight"))).over(everything)
    per = per.withColumn("free", free)
    first = F.struct((limit / F.col("weight")).alias("l"), "number")
    shares = F.col("free").isNotNull() & (first >= F.struct(F.col("free.l"), F.col("free.number")))
    share = F.col("free.left_words").cast("double") * F.col("weight") / F.col("free.left_weight")
    return per.select(
        "number", F.col(source).alias("source"), "source_size",
        F.when(shares, share).otherwise(limit.cast("double")).alias("target"),
    )


def drawn_blocks(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """goals with: full (times a source is taken whole) and drawn (its blocks that are taken
    once more, in order).

    Blocks are drawn in order; one that would pass the target is left. Then one more is
    taken if that comes nearer. A source has a bounded number of blocks, so they fit a row.
    """
    per_block = sizes.groupBy("source", "block").agg(F.sum("size").alias("words")).where("words > 0")
    per_source = per_block.groupBy(F.col("source").alias("of")).agg(F.array_sort(F.collect_list(F.struct("block", "words"))).alias("all"))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.join(per_source, F.col("source").eqNullSafe(F.col("of")), "left").drop("of").withColumn("full", full)
    goals = goals.withColumns({
        "rest": F.col("target") - F.col("full") * F.col("source_size"),
        "all": F.coalesce("all", F.array().cast("array<struct<block:int,words:bigint>>")),
    })

    def draw(state, x):
        fits = state["words"] + x["words"] <= state["rest"]
        return F.struct(F.when(fits, state["words"] + x["words"]).otherwise(state["words"]).alias("words"), state["rest"].alias("rest"),
                        F.when(fits, F.concat(state["drawn"], F.array(x["block"]))).otherwise(state["drawn"]).alias("drawn"))

    start = F.struct(F.lit(0).cast("long").alias("words"), F.col("rest"), F.array().cast("array<int>").alias("drawn"))
    goals = goals.withColumn("first", F.aggregate("all", start, draw))
    gap = F.col("rest") - F.col("first.words")
    others = F.filter("all", lambda x: ~F.array_contains(F.col("first.drawn"), x["block"]) & (x["words"] < 2 * gap))
    nearest = F.array_min(F.transform(others, lambda x: F.struct(F.abs(gap - x["words"]).alias("off"), x["block"].alias("block"))))["block"]
    drawn = F.array_sort(F.concat("first.drawn", F.when(nearest.isNotNull(), F.array(nearest)).otherwise(F.array().cast("array<int>"))))
    return goals.select("number", "source", "source_size", "target", "full", drawn.alias("drawn"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series after lifting n by 8, right to about 1e-12."""
    def of(n):
        x = n + 9.0
        series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) \
            + 1 / (1260 * F.pow(x, 5))
        return series - F.log(reduce(lambda a, k: a * (n + k), range(2, 9), n + 1.0))

    return let(n.cast("double"), of)


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """Number of good ones among ``drawn`` of ``total``, by inverting the distribution at ``u``.

    The sum runs over 12 standard deviations round the mean; what is outside has a
    probability below 1e-30.
    """
    def choose(a, b):
        return _log_factorial(a) - _log_factorial(b) - _log_factorial(a - b)

    def between(s):
        total, good, drawn, u = (s[c] for c in ("total", "good", "drawn", "u"))
        low = F.greatest(F.lit(0).cast("long"), good + drawn - total, F.floor(s["mean"] - s["spread"]).cast("long"))
        return F.struct(total, good, drawn, u, low.alias("low"),
                        F.least(good, drawn, F.ceil(s["mean"] + s["spread"]).cast("long")).alias("high"))

    def invert(s):
        total, good, drawn, u, low, high = (s[c] for c in ("total", "good", "drawn", "u", "low", "high"))

        def step(state, k):
            # from k to k + 1 by the ratio of neighbouring probabilities
            ratio = (good - k) * (drawn - k).cast("double") / ((k + 1) * (total - good - drawn + k + 1).cast("double"))
            summed = state["sum"] + state["mass"]
            return F.struct((state["mass"] * ratio).alias("mass"), summed.alias("sum"),
                            F.when(summed <= u, F.least(k + 1, high)).otherwise(state["at"]).alias("at"))

        first = F.exp(choose(good, low) + choose(total - good, drawn - low) - choose(total, drawn))
        start = F.struct(first.alias("mass"), F.lit(0.0).alias("sum"), low.alias("at"))
        return F.aggregate(F.sequence(low, F.greatest(low, high)), start, step, lambda a: a["at"])

    share = F.when(total > 0, good / total).otherwise(0.0)
    spread = F.sqrt(F.greatest(drawn * share * (1 - share), F.lit(0.0))) * 12 + 12
    given = F.struct(total.alias("total"), good.alias("good"), drawn.alias("drawn"), u.alias("u"),
                     (drawn * share).alias("mean"), spread.alias("spread"))
    return let(let(given, between), invert)


def shard_quotas(quotas: DataFrame, depth: int = DEPTH, seed: int = SEED) -> DataFrame:
    """number, shard, from, to: which of a source's taken blocks (by order) a shard gets.

    ``quotas`` has a row per source: number and quota. A level turns every node into
    two; in a node, each source's draw depends on those before it, whose sums come from
    one array of the node's quotas.
    """
    nodes = quotas.groupBy().agg(F.lit(0).alias("shard"), F.array_sort(F.collect_list(F.struct("number", "quota"))).alias("all"))
    for level in range(depth):
        total = F.aggregate("all", F.lit(0).cast("long"), lambda s, x: s + x["quota"])

        node = F.xxhash64(F.col("shard"), F.lit(level), F.lit(seed))

        def split(state, x):
            left = hypergeometric(state["total"], x["quota"], state["drawn"], unit_hash(x["number"], state["node"], seed=seed))
            return let(left, lambda left: F.struct(
                (state["total"] - x["quota"]).alias("total"), (state["drawn"] - left).alias("drawn"),
                F.concat(state["left"], F.array(F.struct(x["number"].alias("number"), left.alias("quota")))).alias("left"),
                state["node"].alias("node"),
            ))

        # an odd block goes left or right in turn
        drawn = F.floor((F.col("total") + F.pmod("shard", F.lit(2))) / 2).cast("long")
        nodes = nodes.withColumn("total", total)
        start = F.struct(F.col("total"), drawn.alias("drawn"), F.slice("all", 1, 0).alias("left"), node.alias("node"))
        nodes = nodes.withColumn("left", F.aggregate("all", start, split, lambda s: s["left"]))
        right = F.zip_with("all", "left", lambda a, b: F.struct(a["number"].alias("number"),
                                                                (a["quota"] - b["quota"]).alias("quota")))
        nodes = nodes.select(F.explode(F.array(
            F.struct((F.col("shard") * 2).alias("shard"), F.col("left").alias("all")),
            F.struct((F.col("shard") * 2 + 1).alias("shard"), right.alias("all")),
        )).alias("n")).select("n.shard", "n.all")
    dealt = nodes.select("shard", F.explode("all").alias("x")).select("shard", "x.number", "x.quota")
    up_to = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    dealt = dealt.withColumn("to", F.sum("quota").over(up_to))
    return dealt.select("number", "shard", (F.col("to") - F.col("quota")).alias("from"), "to")


def block_of(key: Column, copy: Column, blocks: int, seed: int) -> Column:
    """The block of a document's hash; equal rows go to the blocks after it, one by one."""
    return F.pmod(hash32(key, f"b{seed}") + copy, F.lit(blocks)).cast("int")


def block_key(id_: Column, text: Column) -> Column:
    """What a block follows from: the id, or without one the text."""
    return F.coalesce(id_.cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, blocks: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Narrow rows, one per document that occurs and block that its equal rows reach (doc, source,
    size, key, same: how many equal rows there are, block, rows: how many of them are in it),
    computed once, and what is drawn of each source."""
    size = word_count(F.col(text_col))
    narrow = docs.select(
        F.col(id_col).alias("doc"), F.col(source_col).alias("source"), size.alias("size"),
        block_key(F.col(id_col), F.col(text_col)).alias("key"))
    # counted on the map side, so a row that comes a billion times travels once a task
    groups = narrow.groupBy("doc", "source", "size", "key").agg(F.count(F.lit(1)).alias("same"))
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("same"), F.lit(blocks)) - 1))
    sizes = groups.select("*", step.alias("copy"))
    sizes = kept(sizes.select(
        "doc", "source", "size", "key", "same", block_of(F.col("key"), F.col("copy"), blocks, seed).alias("block"),
        F.floor((F.col("same") - 1 - F.col("copy")) / blocks + 1).cast("long").alias("rows")))
    weighed = sizes.withColumn("size", F.col("size") * F.col("rows"))
    return sizes, kept(drawn_blocks(weighed, targets(weighed)))


def dealt(plan: DataFrame, blocks: int, depth: int, seed: int) -> DataFrame:
    """The plan with the ranges of taken blocks that the splitting tree gives each shard."""
    quota = F.when(F.col("source_size") > 0, F.col("full") * blocks + F.size("drawn")).otherwise(0).cast("long")
    ranges = shard_quotas(plan.select("number", quota.alias("quota")), depth, seed).groupBy("number").agg(
        F.array_sort(F.collect_list(F.struct("shard", "from", "to"))).alias("ranges"))
    return kept(plan.join(ranges, "number"))


def copy_places(block: Column, full: Column, drawn: Column, blocks: int) -> Column:
    """Places of a block's copies among its source's taken blocks: whole copies hold all blocks
    in order, the last one only those drawn."""
    whole = F.when(full > 0, F.transform(F.sequence(F.lit(0).cast("long"), full - 1), lambda c: c * blocks + block))
    once_more = F.when(F.array_contains(drawn, block), F.array(full * blocks + F.array_position(drawn, block) - 1))
    none = F.array().cast("array<bigint>")
    return F.concat(F.coalesce(whole, none), F.coalesce(once_more, none))


def shards_of(places: Column, ranges: Column) -> Column:
    """The shard of each copy; a copy that no shard's quota holds is not taken."""
    def shard(place):
        return F.get(F.filter(ranges, lambda r: (r["from"] <= place) & (place < r["to"])), F.lit(0))["shard"]

    return F.filter(F.transform(places, shard), lambda s: s.isNotNull())


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               blocks: int = BLOCKS, depth: int = DEPTH, seed: int = SEED) -> DataFrame:
    """Every document with its size, its source's size and target, and the words that all shards
    of the mix together take of it."""
    sizes, plan = planned(docs, id_col, text_col, source_col, blocks, seed)
    plan = dealt(plan, blocks, depth, seed).withColumnRenamed("source", "plan_source")
    plan = small_or_plain(plan, 200 + 4 * blocks + 40 * 2 ** depth)
    joined = sizes.join(plan, F.col("source").eqNullSafe(F.col("plan_source")))
    places = copy_places(F.col("block").cast("long"), F.col("full"), F.col("drawn"), blocks)
    taken = F.size(shards_of(places, F.col("ranges"))).cast("long")
    rows = joined.select("doc", "size", "source_size", "target", (taken * F.col("size")).alias("taken"), "rows")
    # as many rows as the table has
    again = rows.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return again.select(F.col("doc").alias(id_col), "size", "source_size", "target", "taken")


def equal_rows(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """row and copy (0, 1, ...) of the rows (key, source, size, row) that come more than once.
    They are sorted and numbered by range, so that no group of them meets in one task."""
    again = kept(sizes.where("same > 1").select(F.col("key").alias("k"), F.col("source").alias("s"), F.col("size").alias("z")).distinct())
    same = (F.col("key") == F.col("k")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    found = rows.join(small_or_plain(again, 128), same).select("key", "source", "size", "row")
    placed = numbered(found.orderBy("key", "source", "size", "row"), "place")
    first = kept(placed.groupBy(F.col("key").alias("k"), F.col("source").alias("s"), F.col("size").alias("z")).agg(F.min("place").alias("first")))
    return kept(placed.join(small_or_plain(first, 128), same).select("row", (F.col("place") - F.col("first")).alias("copy")))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          blocks: int = BLOCKS, depth: int = DEPTH, seed: int = SEED, places: bool = False) -> DataFrame:
    """The mix itself: rows as often as they are taken, dealt by shard and sorted by a
    hash inside it. Columns: those of ``docs``, and with ``places`` mix_shard and mix_copy."""
    sizes, plan = planned(docs, id_col, text_col, source_col, blocks, seed)
    mark = "__"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    plan = dealt(plan, blocks, depth, seed)
    plan = plan.select(*[F.col(c).alias(f"{mark}{c}") for c in ("source", "full", "drawn", "ranges")])
    plan = small_or_plain(plan, 200 + 4 * blocks + 40 * 2 ** depth)
    own = {n: F.col(f"{mark}{n}") for n in ("key", "block", "full", "drawn", "ranges", "copy", "shard", "order")}
    rows = docs.withColumns({f"{mark}key": block_key(F.col(id_col), F.col(text_col)), f"{mark}row": F.monotonically_increasing_id()})
    nth = equal_rows(rows.select(
        own["key"].alias("key"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.col(f"{mark}row").alias("row")), sizes)
    nth = nth.select(F.col("row").alias(f"{mark}of"), F.col("copy").alias(f"{mark}nth"))
    rows = rows.join(small_or_plain(nth, 32), F.col(f"{mark}row") == F.col(f"{mark}of"), "left")
    rows = rows.withColumn(f"{mark}block", block_of(own["key"], F.coalesce(F.col(f"{mark}nth"), F.lit(0)), blocks, seed))
    rows = rows.join(plan, F.col(source_col).eqNullSafe(F.col(f"{mark}source")))
    shards = shards_of(copy_places(own["block"].cast("long"), own["full"], own["drawn"], blocks), own["ranges"])
    rows = rows.select("*", F.posexplode(shards).alias(f"{mark}copy", f"{mark}shard"))
    rows = rows.withColumn(f"{mark}order", F.xxhash64(own["key"], own["copy"], F.lit(seed)))
    # a shard's rows go to as many parts as they need
    parts = max(16, math.ceil(sizes.count() / (2 ** depth * ROWS_PER_PART)))
    spread = rows.repartition(own["shard"], F.pmod(own["order"], F.lit(parts))).sortWithinPartitions(own["shard"], own["order"])
    more = [own["shard"].alias("mix_shard"), own["copy"].alias("mix_copy")] if places else []
    return spread.select(*[F.col(f"`{c}`") for c in docs.columns], *more)
