"""Series cut into blocks, so that the history of one symbol may span many tasks.

A window over a whole symbol sorts all its rows in one task. Here rows are grouped by symbol and a block of time; what a
row needs of earlier rows is found within its block, and what a block needs of earlier blocks over a table of block ends,
one row a block, which is joined back. The rows are shuffled once, by symbol and block.
"""

from __future__ import annotations

from math import ceil, log
from tempfile import mkdtemp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a block, for a time that is a date or timestamp.
BLOCK_DAYS = 365
#: Rows of a chunk of a block in which weights are powers of one factor, and the weight that is nothing to a double.
CHUNK, NOTHING = 256, 1e-20


def block(time: str | Column, days: int = BLOCK_DAYS) -> Column:
    """The number of the block of a date or timestamp; a null time is before all others."""
    at = F.col(time) if isinstance(time, str) else time
    return F.coalesce(F.floor(F.unix_seconds(at.cast("timestamp")) / (86_400 * days)), F.lit(-(1 << 62)))


def carried(df: DataFrame, values: dict[str, Column], *, keys: list[str], order: list[str], days: int = BLOCK_DAYS, forward: bool = True) -> DataFrame:
    """For each name the last value up to a row that is not null; or the next from the row on, if not ``forward``.

    ``order`` starts with the time and leaves no ties. Blocks are joined by key null-safely, so null keys are a series.
    """
    names, block_keys = list(values), [*keys, "__block"]
    df = df.withColumn("__block", block(order[0], days)).withColumns({f"__v{i}": v for i, v in enumerate(values.values())})
    within = Window.partitionBy(*block_keys).orderBy(*order)
    within = within.rowsBetween(Window.unboundedPreceding, 0) if forward else within.rowsBetween(0, Window.unboundedFollowing)
    last = F.last if forward else F.first
    place = F.struct(*order)
    ends = [(F.max_by if forward else F.min_by)(F.col(f"__v{i}"), F.when(F.col(f"__v{i}").isNotNull(), place)).alias(f"__e{i}") for i in range(len(names))]
    of_block = df.groupBy(*block_keys).agg(*ends)
    over = Window.partitionBy(*keys).orderBy("__block")
    over = over.rowsBetween(Window.unboundedPreceding, -1) if forward else over.rowsBetween(1, Window.unboundedFollowing)
    of_block = of_block.select(*(F.col(k).alias(f"__k{j}") for j, k in enumerate(block_keys)), *(last(f"__e{i}", ignorenulls=True).over(over).alias(f"__c{i}") for i in range(len(names))))
    rows = df.withColumns({f"__l{i}": last(f"__v{i}", ignorenulls=True).over(within) for i in range(len(names))})
    same = [F.col(k).eqNullSafe(F.col(f"__k{j}")) for j, k in enumerate(block_keys)]
    out = rows.join(of_block, same, "left").withColumns({n: F.coalesce(f"__l{i}", f"__c{i}") for i, n in enumerate(names)})
    return out.drop("__block", *(f"__{k}{i}" for k in "vlc" for i in range(len(names))), *(f"__k{j}" for j in range(len(block_keys))))


def carried_lag(df: DataFrame, value: str, *, symbol: str, time: str, out: str, days: int = BLOCK_DAYS) -> DataFrame:
    """The value of the symbol's row before, in blocks; null for the first row."""
    df = df.withColumn("__block", block(time, days))
    ends = df.groupBy(symbol, "__block").agg(F.max_by(F.struct(F.col(value).alias("v")), time).alias("__end"))
    ends = ends.select(F.col(symbol).alias("__k"), F.col("__block").alias("__b"), F.lag("__end").over(Window.partitionBy(symbol).orderBy("__block")).alias("__prior"))
    within = F.lag(F.struct(F.col(value).alias("v"))).over(Window.partitionBy(symbol, "__block").orderBy(time))
    rows = df.withColumn("__own", within).join(ends, F.col(symbol).eqNullSafe(F.col("__k")) & (F.col("__block") == F.col("__b")))
    return rows.withColumn(out, F.coalesce("__own", "__prior")["v"]).drop("__block", "__own", "__prior", "__k", "__b")


def smoothed(df: DataFrame, series: dict[str, tuple[Column, float]], *, symbol: str, time: str, days: int = BLOCK_DAYS, index: str = "__index") -> DataFrame:
    """Exponential means y = (1 - weight) * y + weight * x, started on a symbol's first x; and each row's place from 0.

    series: {name: (x, weight)}; x is never null, times of a symbol are distinct. Each step is an affine map of y; the
    maps of a chunk are composed to one, y -> a^n * y + b, and chunks hand on their y. A chunk whose weight has fallen
    under NOTHING is not looked at any more, so a chunk looks back over some chunks only, however long the series is.
    """
    names = list(series)
    keep_ = {n: 1.0 - w for n, (_, w) in series.items()}
    if any(a < 0.1 for a in keep_.values()):
        raise ValueError("weights above 0.9 leave nothing to carry")
    df = df.withColumn("__block", block(time, days)).withColumns({f"__x{i}": x.cast("double") for i, (x, _) in enumerate(series.values())})
    df = df.withColumn("__n", F.row_number().over(Window.partitionBy(symbol, "__block").orderBy(time)) - 1)
    df = df.withColumns({"__chunk": F.floor(F.col("__n") / CHUNK), "__i": F.col("__n") % CHUNK})
    chunk = [symbol, "__block", "__chunk"]
    running = Window.partitionBy(*chunk).orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    local = {}
    for i, n in enumerate(names):
        a = F.lit(keep_[n])
        local[f"__s{i}"] = F.pow(a, "__i") * F.sum(F.lit(series[n][1]) * F.col(f"__x{i}") * F.pow(a, -F.col("__i"))).over(running)
    df = df.withColumns(local)

    composed = [F.max_by(f"__s{i}", "__i").alias(f"__b{i}") for i in range(len(names))] + [F.min_by(f"__x{i}", "__i").alias(f"__f{i}") for i in range(len(names))]
    maps = df.groupBy(*chunk).agg(F.count("*").alias("__rows"), *composed)
    over = Window.partitionBy(symbol).orderBy("__block", "__chunk")
    maps = maps.withColumn("__end", F.sum("__rows").over(over.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__start", F.col("__end") - F.col("__rows"))
    back = max(ceil(log(NOTHING) / log(a)) for a in keep_.values()) + CHUNK
    near = Window.partitionBy(symbol).orderBy("__end").rangeBetween(-back, -1)
    maps = maps.withColumn("__before", F.collect_list(F.struct("__end", *(f"__b{i}" for i in range(len(names))))).over(near))  # at most `back` chunks

    def handed_on(i: int, a: float) -> Column:
        """y before a chunk: the first x and what earlier chunks made of their own, each by its distance."""
        start = F.col("__start")
        first = F.first(f"__f{i}").over(over.rowsBetween(Window.unboundedPreceding, 0)) * F.pow(F.lit(a), start)
        return F.aggregate("__before", first, lambda y, m: y + m[f"__b{i}"] * F.pow(F.lit(a), start - m["__end"])).alias(f"__y{i}")

    handed = [handed_on(i, keep_[n]) for i, n in enumerate(names)]
    maps = maps.select(*(F.col(k).alias(f"__k{j}") for j, k in enumerate(chunk)), "__start", *handed)
    same = [F.col(k).eqNullSafe(F.col(f"__k{j}")) for j, k in enumerate(chunk)]
    made = {n: F.col(f"__s{i}") + F.pow(F.lit(keep_[n]), F.col("__i") + 1) * F.col(f"__y{i}") for i, n in enumerate(names)}
    out = df.join(maps, same).withColumns({**made, index: F.col("__start") + F.col("__i")})
    own = [f"__{k}{i}" for k in "xsy" for i in range(len(names))]
    return out.drop("__block", "__n", "__chunk", "__i", "__start", *own, *(f"__k{j}" for j in range(len(chunk))))


def cut(df: DataFrame) -> DataFrame:
    """The rows as they are now, written to the folder that the cluster shares (``spark.checkpoint.dir``).

    Where that setting is absent, a local session uses a temporary folder; on a cluster that is an error.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir("file://" + mkdtemp(prefix="tickweave-"))
    return df.checkpoint()


class Ranges:
    """Rows dealt into ranges of a sort key, written once, and how many rows each range holds.

    order: (column, descending) pairs, nulls last, that leave no ties. There are as many ranges as the session has
    shuffle partitions. A row's place is its place in its range and the rows of the ranges before.
    """

    def __init__(self, df: DataFrame, order: list[tuple[str, bool]]) -> None:
        self.spark = df.sparkSession
        self.order = [f for c, down in order for f in (F.col(c).isNull().asc(), F.desc(c) if down else F.asc(c))]
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.rows = cut(df.repartitionByRange(n, *self.order).withColumn("__range", F.spark_partition_id()))
        self.counts = {r["__range"]: r["count"] for r in self.rows.groupBy("__range").count().collect()}  # one a range
        self.starts, self.total = {}, 0
        for r in sorted(self.counts):
            self.starts[r] = self.total
            self.total += self.counts[r]

    def ranked(self, out: str) -> DataFrame:
        """All rows with their place from 1."""
        starts = self.spark.createDataFrame(list(self.starts.items()), "__range int, __start long")
        place = F.row_number().over(Window.partitionBy("__range").orderBy(*self.order)) + F.col("__start")
        return self.rows.join(F.broadcast(starts), "__range").withColumn(out, place.cast("int")).drop("__range", "__start")  # a row a range

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows from a place on: only the ranges that the page lies in are ordered."""
        on = [r for r, n in self.starts.items() if n < offset + limit and n + self.counts[r] > offset]
        rows = self.rows.filter(F.col("__range").isin(on)) if on else self.rows.limit(0)
        return rows.orderBy(*self.order).offset(offset - (self.starts[on[0]] if on else 0)).limit(limit).drop("__range")
