"""Mixing sources to target weights, in native expressions only.

Each source's documents are hashed into blocks of about ``BLOCK_WORDS`` words. A source gives whole passes over all its
blocks and part of one more, in a permuted order, until its target is met; that makes its quota, an exact number of blocks.
A splitting tree deals the quotas of all sources to output shards: at each node the left half's share is a multivariate
hypergeometric draw, so that shards are like random hands of one urn and every block is dealt once. A shard's share of a
source is a range of the source's permuted blocks, disjoint from all others; its rows are shuffled within the shard.
All draws come from hashes of (seed, what is drawn): a repeated run gives the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitegauge.llm.common import materialised
from sitegauge.operators.ranking import null_safe_join

WORDS = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 1 << 16
SHARD_BLOCKS = 64
CHUNK = 4096
SALTS = 64
MOST = 3


def size_of(text: Column) -> Column:
    """Words between ASCII white space; none in null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def uniform(*what: Column) -> Column:
    """A number above 0 and below 1 that depends on nothing but ``what``."""
    return (F.pmod(F.xxhash64(*what), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def source_targets(sized: DataFrame, weights: list[float], most: int = MOST) -> DataFrame:
    """(source, nr, source_size, target): how many words the mix takes of each source.

    Sources in order of their code points, null last, weigh ``weights``, repeating. All words are shared by weight; no target
    is above ``most`` times its source's size, and what that leaves over is shared again among the others. A source is held
    down exactly if its size is small for its weight, so one pass over the sources in that order finds the level of the rest.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    nr = F.row_number().over(by_name) - 1
    weighed = sums.select("source", "source_size", nr.cast("long").alias("nr")).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nr") % len(weights) + 1).cast("int"))
    )
    cap = (F.lit(most) * F.col("source_size")).cast("double")
    by_ratio = W.orderBy("ratio", "nr")
    before, onward = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    ranked = weighed.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight")).withColumns(
        {
            "left": F.sum("source_size").over(W.partitionBy()).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "of": F.sum("weight").over(onward),
        }
    )
    level = F.max(F.when(F.col("ratio") > F.col("left") / F.col("of"), F.col("left") / F.col("of"))).over(W.partitionBy())
    target = F.when(F.col("ratio") > F.col("level"), F.col("level") * F.col("weight")).otherwise(F.col("cap"))
    return ranked.withColumn("level", level).select("source", "nr", "source_size", F.coalesce(target, F.col("cap")).alias("target"))


def log_factorial(n: str) -> str:
    """SQL for ln n!, by Stirling's series where the product is too large."""
    x = f"({n} + 1D)"
    series = f"({x} - 0.5D) * ln({x}) - {x} + 0.9189385332046727D + 1 / (12 * {x}) - 1 / (360 * pow({x}, 3)) + 1 / (1260 * pow({x}, 5))"
    return f"if({n} <= 20, ln(CAST(factorial(CAST(least({n}, 20) AS INT)) AS DOUBLE)), {series})"


def _let(name: str, value: str, use: str) -> str:
    """SQL for ``use`` with ``name`` for a value that is worked out once, inside expressions over arrays too."""
    return f"transform(array({value}), {name} -> {use})[0]"


def hypergeometric(good: str, bad: str, draws: str, u: str) -> str:
    """SQL for how many of ``draws`` from an urn are good: the quantile of ``u`` when outcomes are ordered by their distance from
    the mode.

    The likelihoods follow from the mode's, step by step both ways, for as long as they can be told from none.
    """
    choose = lambda n, k: f"{log_factorial(n)} - {log_factorial(k)} - {log_factorial(f'({n} - {k})')}"
    total, low, high = f"({good} + {bad})", f"greatest({draws} - {bad}, 0)", f"least({good}, {draws})"
    peak = f"CAST(floor(({draws} + 1D) * ({good} + 1) / ({total} + 2)) AS BIGINT)"
    at_mode = f"exp({choose(good, 'mode')} + {choose(bad, f'({draws} - mode)')} - ({choose(total, draws)}))"
    deviation = f"sqrt(1D * {draws} * {good} * {bad}) / greatest({total}, 1)"
    steps = f"least(greatest({high} - mode, mode - {low}), CAST(ceil(9 * {deviation}) AS BIGINT) + 40)"
    more = f"s.more * ({good} - mode - i + 1) * ({draws} - mode - i + 1) / (1D * (mode + i) * ({bad} - {draws} + mode + i))"
    fewer = f"s.fewer * (mode - i + 1) * ({bad} - {draws} + mode - i + 1) / (1D * ({good} - mode + i) * ({draws} - mode + i))"
    got = "CASE WHEN s.got >= 0 THEN s.got WHEN s.left < p.more THEN mode + i WHEN s.left < p.more + p.fewer THEN mode - i ELSE -1L END"
    step = _let("p", f"struct({more} AS more, {fewer} AS fewer)", f"struct(s.left - p.more - p.fewer AS left, p.more AS more, p.fewer AS fewer, {got} AS got)")
    start = _let("p", at_mode, f"struct({u} - p AS left, p AS more, p AS fewer, if({u} < p, mode, -1L) AS got)")
    walk = f"if({steps} > 0, sequence(1L, {steps}), CAST(array() AS ARRAY<BIGINT>))"
    found = f"aggregate({walk}, {start}, (s, i) -> {step}, s -> if(s.got < 0, mode, s.got))"
    return _let("mode", f"least(greatest({peak}, {low}), {high})", found)


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, nr, first, blocks): which of a source's permuted blocks a shard gets, from (nr, quota) for nr 0, 1, 2, ...

    A node of the tree is a row with a range of shards, and for each source how many blocks it has and where they begin. Rooms
    differ by one block at most. Quotas of all sources stand in one row, the weights' table in other words; nodes don't meet.
    """
    urn = quotas.agg(F.array_sort(F.collect_list(F.struct("nr", "quota"))).alias("all")).where(F.size("all") > 0)
    nodes = urn.select(
        F.lit(0).cast("long").alias("lo"),
        F.lit(shards).cast("long").alias("hi"),
        F.transform("all", lambda s: s["quota"]).alias("quota"),
        F.transform("all", lambda s: F.lit(0).cast("long")).alias("first"),
        F.aggregate("all", F.lit(0).cast("long"), lambda n, s: n + s["quota"]).alias("total"),
    )
    half = "CAST(floor((lo + hi) / 2) AS BIGINT)"
    room = lambda shard: f"CAST(floor(total * {shard} / {shards}) AS BIGINT)"
    u = f"(pmod(xxhash64({seed}, lo, hi, q.nr), {1 << 52}) + 0.5D) / {float(1 << 52)!r}D"
    rest = "(at.rest - q.quota)"
    drawn_one = _let(
        "k", hypergeometric("q.quota", rest, "at.draws", u), f"struct({rest} AS rest, at.draws - k AS draws, concat(at.left, array(k)) AS left)"
    )
    left = f"""aggregate(transform(quota, (x, nr) -> struct(x AS quota, nr AS nr)),
        struct(aggregate(quota, 0L, (n, x) -> n + x) AS rest, {room(half)} - {room("lo")} AS draws, CAST(array() AS ARRAY<BIGINT>) AS left),
        (at, q) -> {drawn_one}, at -> at.left)"""
    drawn = {"mid": F.expr(half), "left": F.when(F.col("hi") - F.col("lo") > 1, F.expr(left))}
    pair = F.array(
        F.struct("lo", F.col("mid").alias("hi"), F.col("left").alias("quota"), F.col("first")),
        F.struct(
            F.col("mid").alias("lo"), "hi",
            F.zip_with("quota", "left", lambda a, b: a - b).alias("quota"),
            F.zip_with("first", "left", lambda a, b: a + b).alias("first"),
        ),
    )
    whole = F.array(F.struct("lo", "hi", "quota", "first"))
    children = F.inline(F.when(F.col("left").isNull(), whole).otherwise(pair))
    for level in range(max(shards - 1, 0).bit_length()):
        if level and level % 4 == 0:
            nodes = materialised(nodes.repartition(1 << level, "lo"), "mixing-tree")
        nodes = nodes.withColumns(drawn).select("total", children)
    each = nodes.select(F.col("lo").alias("shard"), F.posexplode(F.arrays_zip("quota", "first")).alias("nr", "own"))
    return each.select("shard", F.col("nr").cast("long").alias("nr"), F.col("own.first").alias("first"), F.col("own.quota").alias("blocks"))


def assigned(
    docs: DataFrame,
    weights: list[float],
    seed: int = 13,
    most: int = MOST,
    block_words: int = BLOCK_WORDS,
    shard_blocks: int = SHARD_BLOCKS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, tie, source, size, source_size, target, copies, taken, shards: what the mix takes of each row, 0 copies included.

    ``tie`` is a hash of the text, ``shards`` has the output shard of each copy. Whole passes come first; the last, partial one
    ends within one block, which gives the documents that still fit, in hashed order and, past the first that doesn't, again
    those that fit the rest; so a source misses its target by less than one of its documents. Nulls: a null text has no words, a
    null source is a source, a null id a value like any other. Rows equal in id, text and source are treated alike and share a
    block. Other columns are ignored, whatever their names; no rows give none.
    """
    text = F.col(f"`{text_col}`")
    sized = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        size_of(text).alias("size"),
        F.xxhash64(text).alias("tie"),
    )
    sized = materialised(sized, "mixing-sizes")
    sources = source_targets(sized, weights, most)
    counts = sized.groupBy("source").agg(F.count("*").alias("docs"))
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0)
    sources = null_safe_join(sources, counts, ["source"]).select(
        "source", "nr", "source_size", "target",
        passes.cast("long").alias("passes"),
        F.ceil((F.col("source_size") + F.col("docs")) / block_words).alias("n_blocks"),
    )
    sources = materialised(sources, "mixing-sources")
    # A hot source meets its row of the sources' table in many places.
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    key = F.xxhash64(F.lit(seed), "doc_id", "tie")
    rows = null_safe_join(sized.withColumn("salt", F.pmod(key, F.lit(SALTS)).cast("int")), salted, ["source", "salt"]).drop("salt")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "tie"), F.col("n_blocks")))

    blocks = _ordered_blocks(rows, seed)
    quotas = blocks.groupBy("nr").agg((F.first("passes") * F.first("there") + F.count_if(F.col("before") < F.col("rest"))).alias("quota"))
    quotas = materialised(quotas, "mixing-quotas")
    in_all = quotas.agg(F.sum("quota")).first()[0] or 0
    dealt = split_quotas(quotas, max(1, -(-in_all // shard_blocks)), seed).where("blocks > 0")
    dealt = dealt.select("nr", "shard", F.explode(F.expr("sequence(first, first + blocks - 1)")).alias("place"))
    turned = F.pmod(F.col("pos") + F.pmod(F.xxhash64(F.lit(seed), "nr", "pass"), F.col("there")), F.col("there"))
    drawn = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), "passes"))).where("pass < passes or before < rest")
    place = F.col("pass") * F.col("there") + F.when(F.col("pass") < F.col("passes"), turned).otherwise(F.col("pos"))
    drawn = drawn.select("nr", "block", "pass", place.alias("place")).join(dealt, ["nr", "place"])
    shards = drawn.groupBy("nr", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("dealt"))
    shards = shards.select("nr", "block", F.transform("dealt", lambda d: d["shard"]).alias("shards"))
    budgets = blocks.select("nr", "block", (F.col("rest") - F.col("before")).alias("budget")).join(shards, ["nr", "block"], "left")

    inside = W.partitionBy("nr", "block").orderBy("turn", "tie", "doc_id")
    whole = W.partitionBy("nr", "block")
    rows = rows.join(budgets, ["nr", "block"]).withColumn("turn", key)
    rows = rows.withColumn("fits", F.sum("size").over(inside) <= F.col("budget"))
    gap = F.col("budget") - F.coalesce(F.sum(F.when(F.col("fits"), F.col("size"))).over(whole), F.lit(0))
    rows = rows.withColumn("gap", gap).withColumn("late", ~F.col("fits") & (F.col("size") <= F.col("gap")))
    late = F.col("late") & (F.sum(F.when(F.col("late"), F.col("size"))).over(inside) <= F.col("gap"))
    copies = F.col("passes") + F.when(F.col("fits") | late, 1).otherwise(0)
    copies = F.when(F.col("size") > 0, copies).otherwise(0).cast("int")
    rows = rows.withColumn("copies", copies)
    given = F.when(F.col("copies") > 0, F.slice("shards", F.lit(1), F.col("copies"))).otherwise(F.array().cast("array<long>"))
    return rows.select(
        "doc_id", "tie", "source", "size", "source_size", "target", "copies",
        (F.col("size") * F.col("copies")).alias("taken"), given.alias("shards"),
    )


def _ordered_blocks(rows: DataFrame, seed: int) -> DataFrame:
    """Blocks in permuted order: their place ``pos`` among ``there`` of the source, the words ``before`` them, and the ``rest``
    that the partial pass takes.

    The order is that of a hash; chunks of it are ranked on their own, then their totals are added up.
    """
    blocks = rows.groupBy("nr", "block").agg(
        F.sum("size").alias("words"), *[F.first(c).alias(c) for c in ("passes", "n_blocks", "source_size", "target")]
    )
    blocks = blocks.withColumn("turn", uniform(F.lit(seed), "nr", "block"))
    blocks = materialised(blocks.withColumn("chunk", F.floor(F.col("turn") * F.ceil(F.col("n_blocks") / CHUNK))), "mixing-blocks")
    chunks = blocks.groupBy("nr", "chunk").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    ahead = W.partitionBy("nr").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.select(
        "nr", "chunk",
        F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n"),
        F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("w"),
        F.sum("n").over(W.partitionBy("nr")).alias("there"),
    )
    inside = W.partitionBy("nr", "chunk").orderBy("turn", "block").rowsBetween(W.unboundedPreceding, -1)
    ordered = blocks.join(chunks, ["nr", "chunk"]).select(
        "nr", "block", "passes", "there",
        (F.col("target") - F.col("passes") * F.col("source_size")).alias("rest"),
        (F.col("n") + F.count("*").over(inside)).alias("pos"),
        (F.col("w") + F.coalesce(F.sum("words").over(inside), F.lit(0))).alias("before"),
    )
    return materialised(ordered, "mixing-order")


def mixture(docs: DataFrame, plan: DataFrame, seed: int = 13, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` once for each copy, with ``shard``; the rows of a shard are in one partition, in random order.

    Columns named ``shard`` in ``docs`` are replaced.
    """
    docs = docs.drop("shard")
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"),
        F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("tie"), F.col(f"`{source_col}`").cast("string").alias("source"),
    )
    own = plan.where("copies > 0").select("doc_id", "tie", "source", "shards").dropDuplicates(["doc_id", "tie", "source"])
    copies = null_safe_join(keyed, own, ["doc_id", "tie", "source"]).select("row", "doc_id", "tie", F.posexplode("shards").alias("copy", "shard"))
    turn = F.xxhash64(F.lit(seed + 2), "shard", "doc_id", "tie", "copy")
    placed = copies.repartition("shard").sortWithinPartitions("shard", turn)
    return placed.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)], "shard")
