"""Sharding by a uniform random permutation, with exact shard sizes.

Rows lie in many logical partitions. How many rows each partition sends to each shard is drawn first: a communication
matrix of hypergeometric counts, whose columns add up to the exact shard sizes. Each partition then permutes its rows and
deals them out by its counts; after the exchange, each shard permutes what it got. That is a uniform permutation of all
rows, though no task ever holds a shard. Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.llm.scratch import Scratch

#: Rows that a logical partition is meant to hold, the fewest partitions, and how many are drawn for in one row.
PART_ROWS, LEAST_PARTS, DRAWN = 20_000, 64, 256


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _log_factorial(x: str) -> str:
    """Stirling's series seven steps up; its error is below 1e-11."""
    z = f"(({x}) + 8D)"
    low = " * ".join(f"(({x}) + {k}D)" for k in range(1, 8))
    return f"(({z} - 0.5D) * ln({z}) - {z} + 0.9189385332046727D + 1D / (12D * {z}) - 1D / (360D * pow({z}, 3)) + 1D / (1260D * pow({z}, 5)) - ln({low}))"


def hypergeometric(u: str, total: str, good: str, n: str) -> str:
    """SQL for how many of n draws without replacement out of total are among good, by the inverse of the distribution
    at u in [0, 1). Counts further than 12 standard deviations from the mean are left out (odds under 1e-31)."""
    lf = _log_factorial
    mean = "(h.n * h.good / greatest(h.total, 1D))"
    spread = f"(12D * sqrt({mean} * (1D - h.good / greatest(h.total, 1D)) * (h.total - h.n) / greatest(h.total - 1D, 1D)) + 12D)"
    low = f"cast(greatest(0D, h.n + h.good - h.total, floor({mean} - {spread})) as bigint)"
    high = f"cast(least(h.n, h.good, ceil({mean} + {spread})) as bigint)"
    first = f"exp({lf('h.good')} - {lf('r.lo')} - {lf('h.good - r.lo')} + {lf('h.total - h.good')} - {lf('h.n - r.lo')} - {lf('h.total - h.good - h.n + r.lo')} - {lf('h.total')} + {lf('h.n')} + {lf('h.total - h.n')})"
    ratio = "a.p * (h.good - k) * (h.n - k) / ((k + 1D) * greatest(h.total - h.good - h.n + k + 1D, 1D))"
    walk = f"aggregate(sequence(r.lo, r.hi), named_struct('p', {first}, 'sum', 0D, 'pick', r.lo), (a, k) -> named_struct('p', {ratio}, 'sum', a.sum + a.p, 'pick', if(a.sum <= h.u, k, a.pick)), a -> a.pick)"
    values = f"named_struct('u', {u}, 'total', cast({total} as double), 'good', cast({good} as double), 'n', cast({n} as double))"
    return _let("h", values, _let("r", f"named_struct('lo', {low}, 'hi', {high})", walk))


def deal(parts: str, caps: str, seed: int) -> str:
    """SQL for the rows of the matrix: array<struct<id, take: array<bigint>>> from parts (array<struct<id, n>>) and the
    shards' remaining room."""
    uniform = f"(shiftrightunsigned(xxhash64({seed}L, x.id, s), 11) / 9007199254740992D)"
    one = hypergeometric(uniform, "b.total", "a.caps[s]", "b.left")
    row = f"""aggregate(sequence(0, size(a.caps) - 1),
      named_struct('left', x.n, 'total', aggregate(a.caps, 0L, (p, q) -> p + q), 'row', cast(array() as array<bigint>)),
      (b, s) -> {_let("t", one, "named_struct('left', b.left - t, 'total', b.total - a.caps[s], 'row', array_append(b.row, t))")},
      b -> b.row)"""
    step = _let("taken", row, "named_struct('caps', zip_with(a.caps, taken, (p, q) -> p - q), 'out', array_append(a.out, named_struct('id', x.id, 'take', taken)))")
    return f"aggregate({parts}, named_struct('caps', {caps}, 'out', cast(array() as array<struct<id: bigint, take: array<bigint>>>)), (a, x) -> {step}, a -> a.out)"


def matrix(counts: DataFrame, sizes: list[int], seed: int) -> DataFrame:
    """(part, take): exact counts from (part, n), for shards of the given sizes, which add up to all n.

    Drawn for groups of partitions first, then inside each group, so that no row holds more than DRAWN partitions.
    """
    counts = counts.withColumn("grp", F.floor(F.col("part") / DRAWN))
    groups = counts.groupBy("grp").agg(F.sum("n").alias("n"))
    room = f"array({', '.join(f'{x}L' for x in sizes)})"
    top = groups.agg(F.array_sort(F.collect_list(F.struct(F.col("grp").alias("id"), "n"))).alias("parts")).select(F.explode(F.expr(deal("parts", room, seed))).alias("x")).select(F.col("x.id").alias("grp"), F.col("x.take").alias("room"))
    inner = counts.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct(F.col("part").alias("id"), "n"))).alias("parts"))
    drawn = inner.join(top, "grp").select(F.explode(F.expr(deal("parts", "room", seed + 1))).alias("x"))
    return drawn.select(F.col("x.id").alias("part"), F.col("x.take").alias("take"))


def shard(rows: DataFrame, key: list[str], n_shards: int = 8, seed: int = 0) -> DataFrame:
    """rows with shard (0 to n_shards - 1) and slot (gapless from 0 in each shard): a uniform permutation of all rows, dealt
    into shards whose counts differ by one at most.

    The draws hang on ``seed``, the columns ``key`` and the number of rows alone, so reruns agree. Rows of equal key are in
    no order among each other. Nulls are values like others; an empty table gives an empty table.
    """
    scratch = Scratch(rows.sparkSession, "shard")
    mark = F.xxhash64(F.lit(seed), *key)
    total = rows.count()
    n_parts = max(LEAST_PARTS, -(-total // PART_ROWS))
    subs = max(1, n_parts // n_shards)
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    placed = rows.withColumn("shard_mark", mark).withColumn("part", F.pmod("shard_mark", F.lit(n_parts)))
    drawn = scratch.table(matrix(placed.groupBy("part").agg(F.count("*").alias("n")), sizes, seed), "matrix")
    local = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed + 1), "shard_mark"))
    dealt = placed.withColumn("turn", F.row_number().over(local) - 1).join(drawn, "part")
    # The shard is how many of the running sums of the partition's counts are at or below the row's turn.
    to = "aggregate(take, named_struct('sum', 0L, 'at', 0), (a, t) -> named_struct('sum', a.sum + t, 'at', a.at + if(a.sum + t <= turn, 1, 0)), a -> a.at)"
    again = F.xxhash64(F.lit(seed + 2), "shard_mark")
    dealt = dealt.withColumn("shard", F.expr(to)).withColumn("again", again).withColumn("sub", F.pmod("again", F.lit(subs))).drop("part", "turn", "take", "shard_mark")
    dealt = scratch.table(dealt, "dealt")
    before = Window.partitionBy("shard").orderBy("sub")
    offsets = dealt.groupBy("shard", "sub").agg(F.count("*").alias("n")).withColumn("first", F.sum("n").over(before) - F.col("n")).drop("n")
    second = Window.partitionBy("shard", "sub").orderBy("again")
    placed = dealt.withColumn("place", F.row_number().over(second) - 1).join(offsets, ["shard", "sub"])
    return placed.withColumn("slot", (F.col("first") + F.col("place")).cast("long")).drop("sub", "again", "place", "first")


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """The law is ``rows``: shards whose counts differ by one at most. A null text is an empty one."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64("doc_id", "text").alias("row"))
    out = shard(slim, ["doc_id", "row"], n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
