"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

Weights are the sources' token shares to the power a, normalised. The exponent is bisected between 0 (all sources
alike) and 1 (as they are): to a target entropy, and up again if a source would then be repeated too often. A source
gets its weight's part of the token budget as whole epochs and one partial epoch. Its documents are dealt into blocks
by a hash; each epoch is a permutation of the blocks, and the partial epoch takes blocks in that order while the
budget lasts, and of the block on its edge the documents in hash order while they fit. No task ranks a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, forget, keep, small

#: Blocks of a source at most, and documents a block is made for.
BLOCKS, BLOCK_DOCS = 4096, 256
#: Exponents tried in one pass of the bisection.
SECTIONS = 16
#: Rows of the table of blocks that may be broadcast.
BROADCAST_ROWS = 500_000


def tokens(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _at(totals: DataFrame, exponents: list[float], budget: float) -> dict[float, tuple[float, float]]:
    """For each exponent the entropy of the weights and the largest repetition of a source, by one aggregation."""
    tried = totals.withColumn("a", F.explode(F.array(*(F.lit(float(a)) for a in exponents)))).withColumn("u", F.pow("share", "a"))
    got = tried.groupBy("a").agg(F.sum("u").alias("z"), F.sum(F.col("u") * F.log("u")).alias("ulog"), F.max(F.col("u") / F.col("tokens")).alias("most"))
    return {r["a"]: (_entropy(r["z"], r["ulog"]), budget * r["most"] / r["z"]) for r in got.collect()}  # a row for each exponent


def _entropy(z: float, ulog: float) -> float:
    from math import log

    return log(z) - ulog / z


def exponent(totals: DataFrame, budget: float, *, entropy: float | None, repeats: float | None, tolerance: float = 1e-7) -> float:
    """The least exponent whose weights have at most the entropy asked for and repeat no source too often.

    totals: source, tokens and share of each source that has tokens. Entropy falls and the largest repetition falls as
    the exponent grows to 1; a budget above ``repeats`` times all tokens cannot be met and raises ValueError.
    """

    def fits(x: tuple[float, float]) -> bool:
        return (entropy is None or x[0] <= entropy + 1e-12) and (repeats is None or x[1] <= repeats * (1 + 1e-12))

    low, high = 0.0, 1.0
    ends = _at(totals, [low, high], budget)
    if repeats is not None and ends and ends[1.0][1] > repeats * (1 + 1e-9):
        raise ValueError("the token budget is larger than the repetition limit allows")
    if not ends or fits(ends[0.0]):
        return low if ends else high
    while high - low > tolerance:
        grid = [low + (high - low) * i / SECTIONS for i in range(1, SECTIONS)]
        got = _at(totals, grid, budget)
        ok = [a for a in sorted(got) if fits(got[a])]
        bad = [a for a in sorted(got) if not fits(got[a])]
        low, high = max([low, *bad]), min([high, *ok])
    return high


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", flatten: float = 0.5, repeats: float | None = 4.0, budget: int | None = None, seed: int = 17) -> DataFrame:
    """Deal documents out so that sources reach temperature weights: the rows of docs, some of them repeated or left out.

    ``flatten`` sets the entropy to reach: that part of the way from the sources' own entropy to that of equal
    weights. ``budget`` counts words (all words of docs, if None). New columns: ``epoch`` (from 0), ``place`` (0 to 1,
    the position in the mix; sort by it) and ``repeat_rate`` of the source; they replace any of the same names.

    A null source is a source of its own. Documents without words, or null texts, go with whole epochs only and fit
    everywhere; a source without any words has no weight and is left out. Repeated rows are dealt with each; of rows
    with equal hashes all or none are taken at the edge. An empty table gives an empty table. The words taken of a
    source never exceed its part of the budget, and fall short by less than the largest document of one block.
    """
    taken = ("epoch", "place", "repeat_rate")
    base = docs.drop(*taken)
    own_ = "mix_"
    while any(c.lower().startswith(own_) for c in base.columns):  # helper columns are named apart from all of docs
        own_ = f"_{own_}"
    src, dealt = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null")), F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed))
    counted = base.select(src.alias(f"{own_}s"), dealt.alias(f"{own_}h"), tokens(F.col(text_col)).alias(f"{own_}n"))
    per_hash = keep(counted.groupBy(f"{own_}s", F.pmod(f"{own_}h", F.lit(BLOCKS)).alias(f"{own_}b")).agg(F.sum(f"{own_}n").alias("n"), F.count("*").alias("c")), "mix-cells")
    per_source = per_hash.groupBy(f"{own_}s").agg(F.sum("n").alias("tokens"), F.sum("c").alias("docs")).filter("tokens > 0")
    whole = per_source.agg(F.sum("tokens")).first()[0]
    wanted = float(whole or 0) if budget is None else float(budget)
    totals = keep(per_source.withColumn("share", F.col("tokens") / F.lit(float(whole or 1))), "mix-sources")
    size, own = totals.agg(F.count("*"), F.sum(-F.col("share") * F.log("share"))).first()
    from math import log

    a = exponent(totals, wanted, entropy=own + flatten * (log(size) - own) if size else None, repeats=repeats) if size else 1.0
    z = totals.agg(F.sum(F.pow("share", F.lit(a)))).first()[0] or 1.0
    plan = totals.withColumn("repeat_rate", F.pow("share", F.lit(a)) / F.lit(z) * F.lit(wanted) / F.col("tokens"))
    plan = plan.withColumn("full", F.floor(F.col("repeat_rate") + 1e-9).cast("int")).withColumn("rest", F.greatest(F.lit(0.0), (F.col("repeat_rate") - F.col("full")) * F.col("tokens")))
    plan = plan.withColumn("blocks", F.least(F.lit(BLOCKS), F.ceil(F.col("docs") / BLOCK_DOCS)).cast("int"))

    # Blocks of a source, in the order of its partial epoch, with the words before them. Cells are the finest blocks.
    cells = per_hash.join(plan, f"{own_}s").withColumn("block", F.pmod(f"{own_}b", F.col("blocks")))
    blocks = cells.groupBy(f"{own_}s", "block").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("full", "rest", "blocks", "repeat_rate")))
    order = Window.partitionBy(f"{own_}s").orderBy(F.xxhash64("block", "full", F.lit(seed)), "block")
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("before", F.coalesce(before, F.lit(0)))
    blocks = blocks.withColumn("part", F.when(F.col("before") + F.col("n") <= F.col("rest"), "all").when(F.col("before") < F.col("rest"), "edge").otherwise("none"))
    blocks = keep(blocks, "mix-blocks")
    forget(per_hash)

    rows = base.withColumn(f"{own_}s", src).withColumn(f"{own_}h", dealt)
    rows = rows.join(small(plan.select(f"{own_}s", F.col("blocks").alias(f"{own_}k")), BROADCAST_ROWS), f"{own_}s").withColumn(f"{own_}b", F.pmod(F.pmod(f"{own_}h", F.lit(BLOCKS)), F.col(f"{own_}k"))).drop(f"{own_}k")
    named = blocks.select(f"{own_}s", F.col("block").alias(f"{own_}b"), "repeat_rate", *(F.col(c).alias(f"{own_}{c}") for c in ("full", "rest", "before", "part")))
    rows = rows.join(small(named, BROADCAST_ROWS), [f"{own_}s", f"{own_}b"])
    last = F.col(f"{own_}full") - F.when(F.col(f"{own_}part") == "all", 0).otherwise(1)
    complete = rows.filter(last >= 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
    running = Window.partitionBy(f"{own_}s", f"{own_}b").orderBy(f"{own_}h")
    edge = rows.filter(F.col(f"{own_}part") == "edge").withColumn(f"{own_}used", F.sum(tokens(F.col(text_col))).over(running))
    edge = edge.filter(F.col(f"{own_}before") + F.col(f"{own_}used") <= F.col(f"{own_}rest")).withColumn("epoch", F.col(f"{own_}full")).drop(f"{own_}used")
    out = complete.unionByName(edge)
    turn = F.pmod(F.xxhash64(f"{own_}b", "epoch", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    place = F.least(F.lit(1.0), (F.col("epoch") + turn) / F.greatest(F.col("repeat_rate"), F.col("epoch") + F.lit(1e-9)))
    return out.withColumn("place", place).select(*base.columns, *taken)
