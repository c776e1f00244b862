"""Mixing sources to target weights by a splitting tree over block quotas.

A source's documents are dealt into blocks of about `block_words` words by a hash, anew for each
pass over the source, so the block numbers are a random permutation of the source. The mix takes
whole passes while the target holds them, then the first blocks of one more pass, and from the block
at the boundary the documents that still fit. Documents larger than the room are no part of that pass.
Room that stays because nothing else of the boundary block fits goes on to the blocks behind it, in
rounds, until it is smaller than a mean document (or `ROUNDS` are over; only the target is then missed
by more). That gives each source an exact quota of block draws.

The quotas are split among equal output shards along a binary tree: a node's left half receives a
multivariate hypergeometric draw of the node's quotas, which is what cutting one uniform permutation
of all draws would give. A shard owns a run of each source's draws, disjoint from all others, and
orders its documents by a hash. Everything is built-in functions over DataFrames; the random numbers
are hashes, so reruns agree.

Nothing here is larger than a block (documents at the boundary) or one row per source, shard and
block; a source with a third of all rows simply has more blocks. Running sums over blocks go through
sums of `SPAN` blocks first, so none runs over all blocks of a large source at once.

Defined results: a null text has size 0; a null source is a source, the last in order; sources
without words have target 0; rows equal in `doc_id` and text are drawn together; an empty table
gives an empty mix. Extra columns stay.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import KEY, WORD, document_key
from shelfmark.sources.tables import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEATS = 2
BLOCK_WORDS = 1 << 16
SHARD_WORDS = 1 << 24
SPAN = 4096
ROUNDS = 16
PIECE_WORDS = 1 << 21  # of a file: a shard is several files, so that readers of the mix share its work
MAX_PIECES = 200_000


@dataclass(frozen=True)
class Mix:
    """A finished plan.

    `sources`: one row per source (source, sid, source_size, target, passes, n_blocks, rounds,
    edge_keys), with the rounds of its last pass: documents of up to `room` words in the blocks between
    `after` and `edge` are taken, and those of `edge_keys` in the block `edge`; `deal`: which shard has draw number `draw` of source `sid`; `shards` of about `words`.
    """

    sources: DataFrame
    deal: DataFrame
    seed: int
    shards: int
    words: float


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _block(seed: int, epoch: Column, n_blocks: Column) -> Column:
    return F.floor(_unit(F.lit(seed), epoch, F.col(KEY)) * n_blocks).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Add `sid` and `target` to (source, source_size), one row per source.

    A target is min(most * size, level * weight): in the order of size over weight, the sources that
    reach their cap are a prefix, and the level is what the others share by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    behind = fill.rowsBetween(0, Window.unboundedFollowing)
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    numbered = sizes.withColumn("sid", F.row_number().over(by_name) - 1).withColumns(
        {
            "weight": F.element_at(cycle, (F.col("sid") % len(weights) + 1).cast("int")),
            "cap": F.col("source_size") * F.lit(float(most)),
            "all": F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)),
        }
    )
    rest = F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = numbered.withColumn("level", rest / F.sum("weight").over(behind)).withColumn(
        "open", F.col("level") * F.col("weight") <= F.col("cap")
    )
    # The first source in this order that stays below its cap fixes the level for all behind it.
    first_open = F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "sid", "level"))
    chosen = level.withColumn("chosen", F.min(first_open).over(Window.partitionBy()))
    target = F.coalesce(F.least("cap", F.col("chosen.level") * F.col("weight")), F.col("cap"))
    return chosen.select("source", "sid", "source_size", target.alias("target"))


def _edges(sized: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Per source, the rounds of its last pass and the documents they take from boundary blocks."""
    last_pass = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).select(
        "sid", "size", KEY, _block(seed, F.col("passes"), F.col("n_blocks")).alias("block"),
    )
    state = sources.where("left > 0").select(
        "sid", "n_blocks", F.lit(-1).cast("long").alias("after"), F.col("left").alias("room")
    )
    rounds = []
    for _ in range(ROUNDS):
        done = materialize(_round(last_pass, state, seed), "mix-round")
        rounds.append(done)
        # What is left goes on behind the boundary while a mean document of this round would fit.
        state = done.where("edge < n_blocks AND rest >= mean").select(
            "sid", "n_blocks", F.col("edge").alias("after"), F.col("rest").alias("room")
        )
        if state.isEmpty():
            break
    everything = rounds[0]
    for done in rounds[1:]:
        everything = everything.unionByName(done)
    return everything.groupBy("sid").agg(
        F.sort_array(F.collect_list(F.struct("after", "edge", "room"))).alias("rounds"),
        F.flatten(F.collect_list("taken")).alias("edge_keys"),
    )


def _round(last_pass: DataFrame, state: DataFrame, seed: int) -> DataFrame:
    """(sid, n_blocks, after, room, mean, edge, rest, taken): one round for each source of `state`.

    `edge` is the block behind `after` that the room does not hold any more (n_blocks: it holds all),
    `taken` what still fits of it, `rest` the room that stays. Only documents of up to `room` words
    count; those without words always fit and are not listed.
    """
    fitting = last_pass.join(state, "sid").where("block > after AND size > 0 AND size <= room")
    blocks = fitting.groupBy("sid", "block").agg(
        F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")
    )
    blocks = materialize(blocks, "mix-blocks")
    span = F.floor(F.col("block") / SPAN)
    spans = blocks.groupBy("sid", span.alias("span")).agg(F.sum("words").alias("words"))
    ahead = Window.partitionBy("sid").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("sid", "span", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("sid", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        blocks.withColumn("span", span)
        .join(spans, ["sid", "span"])
        .withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("words").over(within), F.lit(0)))
        .join(state.select("sid", "room"), "sid")
        .where("ahead <= room AND room < ahead + words")
        .select("sid", F.col("block").alias("edge"), (F.col("room") - F.col("ahead")).alias("free"))
    )
    edge = materialize(edge, "mix-edges")
    # One block per source: bounded by its words, whatever the source's size.
    units = (
        fitting.join(edge, "sid").where("block = edge")
        .groupBy("sid", "edge", "free", KEY)
        .agg(F.sum("size").alias("size"))
        .groupBy("sid", "edge", "free")
        .agg(F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(seed), KEY).alias("h"), KEY, "size"))).alias("units"))
    )
    none = F.array().cast("array<bigint>")
    fit = F.aggregate(
        "units",
        F.struct(F.col("free").alias("rest"), none.alias("taken")),
        lambda state, unit: F.when(
            unit["size"] <= state["rest"],
            F.struct(
                (state["rest"] - unit["size"]).alias("rest"),
                F.array_append(state["taken"], unit[KEY]).alias("taken"),
            ),
        ).otherwise(state),
    )
    taken = units.select("sid", "edge", fit.alias("fit"))
    means = blocks.groupBy("sid").agg((F.sum("words") / F.sum("docs")).alias("mean"))
    return (
        state.join(means, "sid", "left")
        .join(taken, "sid", "left")
        .select(
            "sid", "n_blocks", "after", "room", "mean",
            F.coalesce("edge", "n_blocks").alias("edge"),
            F.col("fit.rest").alias("rest"),
            F.coalesce("fit.taken", none).alias("taken"),
        )
    )


# ln(x!) by Stirling's series five places further on; good to ten digits from x = 0.
_LN_FACTORIAL = (
    "(({x}) + 5.5D) * ln(({x}) + 5D) - (({x}) + 5D) + 0.9189385332046727D"
    " + 1D / (12D * (({x}) + 5D)) - 1D / (360D * pow(({x}) + 5D, 3)) + 1D / (1260D * pow(({x}) + 5D, 5))"
    " - ln((({x}) + 1D) * (({x}) + 2D) * (({x}) + 3D) * (({x}) + 4D) * (({x}) + 5D))"
)


def _hypergeometric(c: str, rest: str, need: str, uniform: str) -> str:
    """SQL: how many of `c` marked among `rest` are in `need` draws, from a uniform number.

    Inversion over all values within nine standard deviations of the mean.
    """
    spread = (
        f"9D * sqrt({need} * ({c} / {rest}) * (1D - {c} / {rest}) * ({rest} - {need}) / greatest({rest} - 1, 1)) + 2D"
    )
    low = f"greatest(0L, {need} - ({rest} - {c}), bigint(floor({need} * ({c} / {rest}) - ({spread}))))"
    high = f"least({c}, {need}, bigint(ceil({need} * ({c} / {rest}) + ({spread}))))"
    log_mass = " ".join(
        f"- ({_LN_FACTORIAL.format(x=x)})"
        for x in ("v", f"{c} - v", f"{need} - v", f"{rest} - {c} - {need} + v")
    )
    masses = f"transform(sequence({low}, {high}), v -> struct(v AS v, {log_mass} AS m))"
    # Arrays of one element bind what is used again, so nothing is computed once per value.
    scaled = (
        f"transform(array({masses}), p -> transform(array(array_max(transform(p, z -> z.m))), top ->"
        " transform(p, q -> struct(q.v AS v, exp(q.m - top) AS m)))[0])[0]"
    )
    return (
        f"transform(array({scaled}), p -> aggregate(p, struct({uniform} * aggregate(p, 0D, (s, q) -> s + q.m) AS left,"
        " bigint(-1) AS v), (s, q) -> IF(s.left < 0, s, struct(s.left - q.m AS left, q.v AS v)), s -> s.v))[0]"
    )


def split_quotas(spark, sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """(sid, shard, count): the quotas of all sources split among the shards."""
    nodes = sources.agg(
        F.lit(0).cast("long").alias("first"),
        F.lit(shards).cast("long").alias("width"),
        F.sort_array(F.collect_list(F.struct("sid", "quota"))).alias("q"),
    ).select("first", "width", F.col("q.quota").alias("counts"))
    draw = _hypergeometric(
        "c", "s.rest", "s.need",
        f"(shiftrightunsigned(xxhash64({seed}, first, width, size(s.left)), 11) / {float(1 << 53)!r}D)",
    )
    left = f"""
        aggregate(
            counts,
            struct(aggregate(counts, 0L, (s, c) -> s + c) AS rest,
                   bigint(round(aggregate(counts, 0L, (s, c) -> s + c) * (width DIV 2) / width)) AS need,
                   CAST(array() AS array<bigint>) AS left),
            (s, c) -> transform(array(IF(s.rest = 0 OR c = 0, 0L, {draw})), x ->
                struct(s.rest - c AS rest, s.need - x AS need, array_append(s.left, x) AS left))[0],
            s -> s.left)
    """
    for _ in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        halves = nodes.withColumn("left", F.expr(f"IF(width > 1, {left}, counts)"))
        nodes = materialize(
            halves.select(
                F.expr(
                    """explode(IF(width = 1, array(struct(first, width, counts)), array(
                        struct(first, width DIV 2 AS width, left AS counts),
                        struct(first + width DIV 2 AS first, width - width DIV 2 AS width,
                               zip_with(counts, left, (c, l) -> c - l) AS counts))))"""
                ).alias("n")
            ).select("n.*"),
            "mix-tree",
        )
    return nodes.select(
        F.col("first").alias("shard"), F.posexplode("counts").alias("sid", "count")
    ).where("count > 0")


def plan_mix(
    sized: DataFrame,
    seed: int = 1,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    max_repeats: float = MAX_REPEATS,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
) -> Mix:
    """Targets, block quotas and their split, from (source, size, KEY) rows."""
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    base = targets(materialize(totals, "mix-sizes"), weights, share, max_repeats)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    base = base.withColumns(
        {
            "passes": passes.cast("long"),
            "n_blocks": F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long"),
        }
    ).withColumn("left", F.col("target") - F.col("passes") * F.col("source_size"))
    base = materialize(base, "mix-targets")
    edges = _edges(sized, base, seed)
    quota = F.col("passes") * F.col("n_blocks") + F.coalesce(
        F.least(F.array_max("rounds.edge") + 1, "n_blocks"), F.lit(0)
    )
    sources = base.join(edges, "sid", "left").withColumn(
        "quota", F.when(F.col("source_size") > 0, quota).otherwise(0).cast("long")
    )
    sources = materialize(sources, "mix-sources")
    words = sources.agg(F.sum("target")).first()[0] or 0
    shards = max(1, math.ceil(words / shard_words))
    counts = split_quotas(spark, sources, shards, seed)
    ahead = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("count").over(ahead), F.lit(0))
    runs = counts.select("sid", "shard", "count", start.alias("start"))
    deal = runs.select(
        "sid", "shard", F.explode(F.sequence("start", F.col("start") + F.col("count") - 1)).alias("draw")
    )
    return Mix(sources, materialize(deal, "mix-deal"), seed, shards, words / shards)


def drawn(docs: DataFrame, mix: Mix) -> DataFrame:
    """`docs` (with `source`, `size` and KEY) with their source's numbers and `draws`: one per copy."""
    s = mix.sources.select(
        F.col("source").alias("__source"), "sid", "source_size", "target", "passes", "n_blocks", "rounds", "edge_keys",
    )
    joined = docs.join(s, docs["source"].eqNullSafe(s["__source"]))
    last = F.col("__last")
    joined = joined.withColumn("__last", _block(mix.seed, F.col("passes"), F.col("n_blocks")))
    whole = F.exists(
        "rounds", lambda r: (last > r["after"]) & (last < r["edge"]) & (F.col("size") <= r["room"])
    )
    at_edge = F.exists("rounds", lambda r: last == r["edge"])
    partly = whole | (at_edge & ((F.col("size") == 0) | F.array_contains("edge_keys", F.col(KEY))))
    copies = F.when(F.col("source_size") > 0, F.col("passes") + F.coalesce(partly, F.lit(False)).cast("long")).otherwise(0)
    none = F.array().cast("array<bigint>")
    epochs = F.when(copies > 0, F.sequence(F.lit(0).cast("long"), copies - 1)).otherwise(none)
    return joined.withColumn(
        "draws",
        F.transform(epochs, lambda e: e * F.col("n_blocks") + _block(mix.seed, e, F.col("n_blocks"))),
    )


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, shards (one per copy)."""
    measured = document_key(docs).select(
        "doc_id", "source", KEY, word_count(F.col("text")).alias("size"),
        F.monotonically_increasing_id().alias("row"),
    )
    sized = materialize(measured, "mix-sized")
    mix = plan_mix(sized, **options)
    copies = drawn(sized, mix).select(
        "row", "doc_id", "size", "source_size", "target", "sid", F.explode_outer("draws").alias("draw")
    )
    placed = copies.join(mix.deal, ["sid", "draw"], "left")
    return (
        placed.groupBy("row", "doc_id", "size", "source_size", "target")
        .agg(
            F.coalesce(F.sum(F.when(F.col("shard").isNotNull(), F.col("size"))), F.lit(0)).alias("taken"),
            F.sort_array(F.collect_list("shard")).alias("shards"),
        )
        .drop("row")
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row per copy in the columns of `docs`, shard by shard, shuffled within."""
    keyed = document_key(docs)
    sized = materialize(
        keyed.select("source", KEY, word_count(F.col("text")).alias("size")), "mix-sized"
    )
    mix = plan_mix(sized, **options)
    names = [f"c{i}" for i in range(len(docs.columns))]
    whole = F.struct(*(F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)))
    packed = keyed.select("source", KEY, word_count(F.col("text")).alias("size"), whole.alias("__doc"))
    copies = drawn(packed, mix).select("__doc", KEY, "sid", F.explode("draws").alias("draw"))
    placed = copies.join(mix.deal, ["sid", "draw"])
    # A shard's order is a hash, and its pieces are equal ranges of that hash.
    order = F.shiftrightunsigned(F.xxhash64(F.lit(mix.seed), "shard", "draw", KEY), 1)
    pieces = max(1, min(math.ceil(mix.words / PIECE_WORDS), MAX_PIECES // mix.shards))
    piece = F.floor(F.col("__order") / F.lit(2.0**63) * pieces)
    place = (F.col("shard") * pieces + F.least(piece, F.lit(pieces - 1))) % MAX_PIECES
    return (
        placed.withColumn("__order", order)
        .repartitionById(min(mix.shards * pieces, MAX_PIECES), place.cast("int"))
        .sortWithinPartitions("shard", "__order")
        .select(*(F.col(f"__doc.{n}").alias(c) for c, n in zip(docs.columns, names, strict=True)))
    )
