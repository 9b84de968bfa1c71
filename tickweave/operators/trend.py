"""Rule-based trend outlook: a technical baseline, adjustments of its probabilities, and a rating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HORIZONS = ("1d", "1w", "1m", "long")
#: Fixed values of the baseline: what each horizon adds to the score; the tops of its rising, flat and falling ranges
#: (rising from 0, flat either way, falling to 0), in percent.
ADD_ON = {"1d": 0.0, "1w": 0.2, "1m": 0.3, "long": 0.0}
RANGES = {"1d": (5.0, 2.0, -5.0), "1w": (10.0, 3.0, -10.0), "1m": (20.0, 5.0, -20.0), "long": (50.0, 10.0, -40.0)}
#: Probabilities up, flat and down of a score of at least 2, of at most -2, and between.
BULL, BEAR, PLAIN = (0.6, 0.25, 0.15), (0.2, 0.3, 0.5), (0.4, 0.3, 0.3)
#: Fixed values of the adjustments: k, scale, weights by horizon, dead band.
FACTORS = {
    "fundamental": (0.10, 2.0, (0.3, 0.5, 0.8, 1.0), 0.0),
    "research": (0.08, 2.0, (0.3, 0.6, 0.9, 1.0), 0.25),
    "filing": (0.07, 2.0, (0.9, 0.8, 0.6, 0.3), 0.25),
    "sentiment": (0.10, 2.0, (1.0, 0.8, 0.5, 0.3), 0.2),
    "news": (0.06, 1.5, (0.9, 0.7, 0.4, 0.2), 0.2),
}


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def baseline(df: DataFrame, *, change: str = "pct_chg", rsi: str = "rsi", volume_ratio: str = "volume_ratio") -> DataFrame:
    """A score from change, RSI and volume ratio, and a row for each horizon: its probabilities (struct ``probs``) and expected move.

    A change beyond 0.5 % counts one, beyond 3 % two, in its direction; an RSI above 70 takes half a point, one under 30
    gives it; a volume ratio above 1.5 gives half a point, one under 0.7 takes it. Nulls, and zeros, which sources write
    for missing values, count as no change, 50 and 1. The expected move weighs the middles of the horizon's ranges.
    """
    known = lambda c, instead: F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(0.0)), F.lit(instead))
    c, r, v = known(change, 0.0), known(rsi, 50.0), known(volume_ratio, 1.0)
    steps = F.when(F.abs(c) > 3, 2.0).when(F.abs(c) > 0.5, 1.0).otherwise(0.0) * F.signum(c)
    score = steps + F.when(r > 70, -0.5).when(r < 30, 0.5).otherwise(0.0) + F.when(v > 1.5, 0.5).when(v < 0.7, -0.5).otherwise(0.0)
    rows = F.array(*(F.struct(F.lit(h).alias("horizon"), F.lit(i).alias("horizon_no"), F.lit(ADD_ON[h]).alias("add"), F.lit(RANGES[h][0] / 2).alias("rise"), F.lit(RANGES[h][2] / 2).alias("fall")) for i, h in enumerate(HORIZONS)))
    out = df.withColumn("score", score).withColumn("h", F.explode(rows)).select("*", "h.*").drop("h")
    three = lambda p: F.struct(F.lit(p[0]).alias("up"), F.lit(p[2]).alias("down"), F.lit(p[1]).alias("flat"))
    at = F.col("score") + F.col("add")
    out = out.withColumn("probs", F.when(at >= 2, three(BULL)).when(at <= -2, three(BEAR)).otherwise(three(PLAIN)))
    return out.withColumn("expected_move", F.col("probs.up") * F.col("rise") + F.col("probs.down") * F.col("fall")).drop("add", "rise", "fall")


def adjust(df: DataFrame, factor: str, score: str) -> DataFrame:
    """Move the struct ``probs`` by a factor's score: d = k * score / scale * weight of the horizon; nothing inside the dead band.

    Up and down are clipped to .05 and .9 and scaled to a sum of .95 at most; flat is the rest, at least .05, and then
    all three are brought to a sum of 1. A null score changes nothing. The steps are lambdas over one struct, so a
    chain of adjustments grows by one expression each.
    """
    k, scale, weights, band = FACTORS[factor]
    w = F.element_at(F.array(*map(F.lit, weights)), F.col("horizon_no") + 1)
    s = F.coalesce(F.col(score).cast("double"), F.lit(0.0))
    still, d = (s == 0) | (F.abs(s) < band), k * s / scale * w
    three = lambda up, down, flat: F.named_struct(F.lit("up"), up, F.lit("down"), down, F.lit("flat"), flat)
    steps = (
        lambda p: three(clip(p["up"] + d, 0.05, 0.9), clip(p["down"] - d, 0.05, 0.9), p["flat"]),
        lambda p: three(p["up"] / (F.greatest(p["up"] + p["down"], F.lit(0.95)) / 0.95), p["down"] / (F.greatest(p["up"] + p["down"], F.lit(0.95)) / 0.95), p["flat"]),
        lambda p: three(p["up"], p["down"], F.greatest(1 - p["up"] - p["down"], F.lit(0.05))),
        lambda p: three(*(p[x] / (p["up"] + p["down"] + p["flat"]) for x in ("up", "down", "flat"))),
    )
    moved = F.array("probs")
    for step in steps:
        moved = F.transform(moved, step)
    return df.withColumn("probs", F.when(still, F.col("probs")).otherwise(moved[0]))


def spread(df: DataFrame) -> DataFrame:
    """The struct ``probs`` as columns prob_up, prob_down and prob_flat."""
    return df.withColumns({f"prob_{x}": F.col(f"probs.{x}") for x in ("up", "down", "flat")}).drop("probs")


def fundamental_score(pe: Column, pb: Column, revenue: Column, profit: Column) -> Column:
    """From valuation and growth in percent, clipped to 2 either way; nulls add nothing."""
    price = F.when(pe < 10, 1.0).when(pe < 20, 0.5).when(pe > 60, -1.0).when(pe > 40, -0.5).otherwise(0.0)
    book = F.when(pb < 1, 0.5).when(pb > 5, -0.5).otherwise(0.0)
    growth = [F.when(g > 10, 0.5).when(g < 0, -0.5).otherwise(0.0) for g in (revenue, profit)]
    return clip(price + book + growth[0] + growth[1], -2.0, 2.0)


def rating(expected: Column) -> Column:
    """A rating from the long horizon's expectation in percent."""
    return F.when(expected >= 30, "strong buy").when(expected >= 15, "buy").when(expected >= 5, "accumulate").when(expected > -5, "hold").when(expected > -15, "reduce").when(expected.isNotNull(), "sell")
