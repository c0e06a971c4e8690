"""Sharding by balanced label propagation.

Rows with equal texts are linked. Every linked row starts in a shard dealt evenly, without regard to
its links. Then, round by round, the members of a group that lie in a shard ask to move to the shard
where most of their neighbours are. A 16 x 16 table of these wishes gives the flows that capacity
allows (inflow never exceeds free places plus outflow), and the wishes are granted up to those flows.
Rows without links keep the counts exact at the end: they take the places that linked rows leave.

All members of a group are alike, so the state that the rounds work on has one row for each group and
shard, not one for each document, and no pairs are made. A group that is larger than a shard
gathers in full shards as far as other groups' wishes leave it places. No step needs a group's rows in one task: counts are summed on the map side,
running numbers come from bucket counts plus a row number within a bucket of bounded size, and what a
group's rows have in common is joined bucket by bucket.

Defined cases: a null text counts as an empty one; repeated doc_ids and null doc_ids are rows like any
others; with fewer rows than shards some shards stay empty; an empty table gives an empty result; other
columns are ignored. Law: ``rows`` (shards' row counts are at most one apart).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marrow.llm.shared import remove, text_or_empty, work_dir, written

SHARDS = 16
#: At most so many rounds, for each shard; they end when no wish is granted.
ROUNDS = 1
#: Rows that one running-number bucket holds on average.
BUCKET_ROWS = 50_000
#: So that buckets spread evenly over tasks.
LEAST_BUCKETS = 1024


def _running(df: DataFrame, keys: list[str], bucket: Column, order: list[str], amount: Column, name: str, total: str | None = None) -> DataFrame:
    """Adds, as name, the sum of amount over the rows before this one among those with equal keys, and if asked the sum over all of these as total.

    Two steps: sums by (keys, bucket) are carried forward over the few buckets, and within a bucket by
    a window. So the largest window holds one bucket, whatever a key's share of the rows.
    """
    df = df.withColumn("_bucket", bucket)
    sums = df.groupBy(*keys, "_bucket").agg(F.sum(amount).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = [F.sum("_sum").over(Window.partitionBy(*keys)).alias(total)] if total else []
    offsets = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_k_bucket"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"), *totals)
    same = F.col("_bucket") == F.col("_k_bucket")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("_inner", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return inner.join(offsets, same).withColumn(name, (F.col("_offset") + F.col("_inner")).cast("long")).drop("_bucket", "_inner", "_offset", "_k_bucket", *[f"_k_{k}" for k in keys])


def allowed_flows(load: list[int], capacity: list[int], wish: list[list[int]]) -> list[list[int]]:
    """The part of the wished flows that keeps every shard within its capacity; a shards x shards table.

    Starts from all wishes and cuts inflows of overfull shards until none is left. Each cut lowers the
    total, and no flow at all is within capacity, so this ends.
    """
    shards = range(len(load))
    flow = [row[:] for row in wish]
    while True:
        over = [load[t] + sum(flow[s][t] for s in shards) - sum(flow[t]) - capacity[t] for t in shards]
        t = max(shards, key=over.__getitem__)
        if over[t] <= 0:
            return flow
        cut = over[t]
        for s in sorted(shards, key=lambda s: -flow[s][t]):
            less = min(cut, flow[s][t])
            flow[s][t] -= less
            cut -= less
        if cut:
            return [[min(wish[s][t], wish[t][s]) for t in shards] for s in shards]


def _case(keys: list[Column], values: dict[tuple[int, ...], int]) -> Column:
    """A lookup in at most shards x shards constants."""
    out = F.lit(0).cast("long")
    for at, v in values.items():
        if v:
            hit = F.lit(True)
            for k, x in zip(keys, at):
                hit = hit & (k == x)
            out = F.when(hit, F.lit(v).cast("long")).otherwise(out)
    return out


def propagate(state: DataFrame, capacity: list[int], folder: str, rounds: int | None = None) -> DataFrame:
    """Moves members of groups between shards; state and result: grp, shard, n (members there).

    Each round is written to the shared folder, so lineage stays short and lost executors cost a round.
    """
    shards = len(capacity)
    spark, previous = state.sparkSession, None
    state = written(state, f"{folder}/round-0")
    for i in range(1, (ROUNDS * shards if rounds is None else rounds) + 1):
        loads = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one row a shard
        load = [loads.get(t, 0) for t in range(shards)]
        full = [t for t in range(shards) if load[t] >= capacity[t]] if i > 1 else []
        tie = F.pmod(F.xxhash64("grp", F.lit(i)) + F.col("shard") * 7, F.lit(shards))
        ranks = Window.partitionBy("grp").orderBy(F.desc("n"), tie, "shard")
        # The nearest better shard that has places; in a full one a group may still gather by exchange with others.
        ranked = state.withColumn("rank", F.row_number().over(ranks)).withColumn("open", ~F.col("shard").isin(full) if full else F.lit(True))
        best = Window.partitionBy("grp")
        aim = ranked.withColumn("goal", F.coalesce(F.min(F.when(F.col("open"), F.struct("rank", "shard"))).over(best), F.min(F.struct("rank", "shard")).over(best)))
        wishes = aim.withColumn("to", F.when(F.col("goal.rank") < F.col("rank"), F.col("goal.shard"))).drop("goal", "rank", "open")
        wishes = written(wishes, f"{folder}/wishes-{i}")
        table = [[0] * shards for _ in range(shards)]
        for r in wishes.where("to is not null").groupBy("shard", "to").agg(F.sum("n").alias("n")).collect():  # shards x shards rows
            table[r["shard"]][r["to"]] = r["n"]
        if not any(map(any, table)):
            remove(spark, f"{folder}/wishes-{i}")
            break
        flow = allowed_flows(load, capacity, table)
        if not any(map(any, flow)):
            remove(spark, f"{folder}/wishes-{i}")
            break
        asked = _running(wishes.where("to is not null"), ["shard", "to"], F.pmod(F.xxhash64("grp", F.lit(-i)), F.lit(1024)), ["grp"], F.col("n"), "ahead")
        quota = _case([F.col("shard"), F.col("to")], {(s, t): flow[s][t] for s in range(shards) for t in range(shards)})
        granted = asked.withColumn("go", F.greatest(F.lit(0).cast("long"), F.least(F.col("n"), quota - F.col("ahead"))))
        parts = F.explode(F.array(F.struct(F.col("shard"), (F.col("n") - F.col("go")).alias("n")), F.struct(F.col("to").alias("shard"), F.col("go").alias("n"))))
        moved = granted.select("grp", parts.alias("part")).select("grp", "part.shard", "part.n")
        after = wishes.where("to is null").select("grp", "shard", "n").unionByName(moved).where("n > 0").groupBy("grp", "shard").agg(F.sum("n").alias("n"))
        state, last = written(after, f"{folder}/round-{i}"), previous
        previous = f"{folder}/round-{i - 1}"
        remove(spark, f"{folder}/wishes-{i}")
        if last:
            remove(spark, last)
    return state


def shard_rows(docs: DataFrame, shards: int = SHARDS, rounds: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, grp (binary digest of the text), shard, slot for every row of docs."""
    spark = docs.sparkSession
    folder = work_dir(spark, "sharding")
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("grp"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, f"{folder}/rows")
    total = rows.count()
    buckets = max(LEAST_BUCKETS, total // BUCKET_ROWS)
    # Every row gets a number within its group and its group's size; rows of a hot group are numbered in buckets.
    part = F.pmod(F.xxhash64("row"), F.lit(buckets))
    numbered = written(_running(rows, ["grp"], part, ["doc_id", "row"], F.lit(1).cast("long"), "member", "members"), f"{folder}/numbered")
    remove(spark, f"{folder}/rows")

    capacity = [total // shards + (t < total % shards) for t in range(shards)]
    spread = F.pmod(F.xxhash64("grp", "member"), F.lit(buckets))
    linked = _running(numbered.where("members > 1").withColumn("all", F.lit(0)), ["all"], spread, ["grp", "member"], F.lit(1).cast("long"), "k")
    start = linked.select("grp", F.pmod("k", F.lit(shards)).cast("int").alias("shard")).groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("n"))
    state = propagate(start, capacity, folder, rounds)

    # Members [low, high) of a group lie in a shard; at most one row a shard, so the arrays are short.
    up_to = Window.partitionBy("grp").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = state.withColumn("high", F.sum("n").over(up_to)).groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("high", "shard"))).alias("spans"))
    members = numbered.where("members > 1").withColumn("part", part)
    cells = members.select("grp", "part").distinct().join(spans, "grp")  # a group's spans go to each of its parts
    placed = members.join(cells, ["grp", "part"]).withColumn("shard", F.element_at(F.filter("spans", lambda s: s["high"] > F.col("member")), 1)["shard"])

    loads = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    ends, free = [], 0
    for t in range(shards):
        free += capacity[t] - loads.get(t, 0)
        ends.append(free)
    single = _running(numbered.where("members = 1").withColumn("all", F.lit(0)), ["all"], spread, ["grp"], F.lit(1).cast("long"), "k")
    home = F.lit(shards - 1)
    for t in reversed(range(shards - 1)):
        home = F.when(F.col("k") < ends[t], F.lit(t)).otherwise(home)
    keep = ["doc_id", "size", "text_crc32", "grp", "member"]
    done = placed.select(*keep, "shard").unionByName(single.select(*keep, home.alias("shard")))
    slotted = _running(done, ["shard"], F.pmod(F.xxhash64("grp", "member", F.lit(1)), F.lit(buckets)), ["grp", "member"], F.lit(1).cast("long"), "slot")
    return slotted.select("doc_id", "size", "text_crc32", "grp", "shard", "slot")
