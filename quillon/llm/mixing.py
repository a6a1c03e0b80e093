"""Mixing sources to target weights, with DataFrame operations only.

Each source's words, its documents one after the other, are packed into blocks of BLOCK words, smaller ones in a source
of few words. Every output shard draws how many of its slots each source fills. The draws are multinomial given the
corpus totals, not free: one pseudorandom permutation deals all slots to shards, so that a source meets its target to
within half a block at any size, where free draws miss small sources by several percent and can pass the cap. A source's
slots, in shard order, walk its block indices epoch by epoch, each epoch through a permutation of its own (swap-or-not
rounds), and blocks join by index. Whole epochs take every block once; only slots of the last one are joined to count
what a document gives. No block is taken more often than the cap allows, so no document is either.

Running sums over sources, groups of documents and shards are formed in two levels, so that no task holds all of them.

Defined cases: null text counts no words and is taken 0 times; a null source is a source of its own, ordered last;
repeated rows are separate documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import join_sized, shared_table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
CAP, BLOCK, SHARD, ROUNDS, SEED = 3, 32, 1024, 8, 20240517
#: Documents in a group, and groups or sources, within which running sums are formed by one window.
GROUP, NEAR = 256, 10_000
#: A source of fewer words than BLOCK times this has smaller blocks.
FINE = 256
#: Slots in a task.
PART = 200_000
#: Parts of a whole copy in which remainders are carried.
ONE = 1 << 20


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of index within [0, n), one for each key."""

    def swap(x, r):
        partner = F.pmod(F.xxhash64(F.lit(SEED), r, *key) - x, n)
        drawn = F.xxhash64(F.lit(~SEED), r, F.greatest(x, partner), *key).bitwiseAND(F.lit(1))
        return F.when(drawn == 1, partner).otherwise(x)

    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), index, swap)


def running(df: DataFrame, value: str, name: str, order: str, key: list[str] | None = None, near: int = NEAR) -> DataFrame:
    """df with the sum of value over the rows before, in the order of a whole number that is unique within key."""
    key = key or []
    df = df.withColumn("_far", F.expr(f"{order} div {near}"))
    inner = Window.partitionBy(*key, "_far").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*key, F.expr(f"_far div {near}")).orderBy("_far").rowsBetween(Window.unboundedPreceding, -1)
    far = df.groupBy(*key, "_far").agg(F.sum(value).alias("_sum"))
    # a third level, over as many rows as near * near of the first are one
    top = far.groupBy(*key, F.expr(f"_far div {near}").alias("_top")).agg(F.sum("_sum").alias("_top_sum"))
    top = top.withColumn("_top_sum", F.coalesce(F.sum("_top_sum").over(Window.partitionBy(*key).orderBy("_top").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    far = far.withColumns({"_top": F.expr(f"_far div {near}"), "_sum": F.coalesce(F.sum("_sum").over(outer), F.lit(0))}).join(top, [*key, "_top"])
    far = far.select(*key, "_far", (F.col("_sum") + F.col("_top_sum")).alias("_sum"))
    out = join_sized(df.withColumn(name, F.coalesce(F.sum(value).over(inner), F.lit(0))), far, [*key, "_far"])
    return out.withColumn(name, F.col(name) + F.col("_sum")).drop("_far", "_sum")


def ranked(sizes: DataFrame) -> DataFrame:
    """sizes(source, ...) with src: the rank of the source by code point, null last."""
    n = 1 + sizes.count() // NEAR
    by_name = F.col("source").asc_nulls_last()
    dealt = shared_table(sizes.repartitionByRange(n, by_name).withColumn("_part", F.spark_partition_id()), "mix-ranks")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(by_name)) - 1
    return dealt.withColumn("_at", place).join(F.broadcast(parts), "_part").withColumn("src", F.col("_first") + F.col("_at")).drop("_part", "_n", "_first", "_at")


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes(source, source_size) -> also src, weight and target: weights share all sizes, filled up under the cap.

    The share of a unit of weight grows as sources stop at their caps; each round finds those that do."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int"))
    rows = ranked(sizes).withColumns({"weight": weight, "most": F.col("source_size") * cap})
    rows = shared_table(rows, "mix-weights")
    share = 0.0
    while True:
        over = F.col("weight") * share > F.col("most")
        total, stopped, free = rows.agg(F.sum("source_size"), F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight")))).first()
        now = ((total or 0) - (stopped or 0)) / free if free else share
        if now <= share:
            break
        share = now
    target = F.least(F.col("weight") * share, F.col("most").cast("double"))
    return rows.select("source", "src", "weight", "source_size", target.alias("target"))


def shard_draws(sources: DataFrame, parts: int, shard: int = SHARD) -> DataFrame:
    """(src, blocks, quota, shard, n_slots, first): how many slots of each shard a source fills, and the ordinal of its first."""
    n_slots = sources.agg(F.sum("quota")).first()[0] or 0
    runs = running(sources, "quota", "start", "src").filter("quota > 0").select("src", "blocks", "quota", "start")
    runs = runs.withColumn("run", F.explode(F.sequence(F.lit(0), F.expr("(quota - 1) div 4096"))))
    # One row per 4096 slots, dealt evenly, so that a source of any size is drawn by many tasks.
    runs = runs.repartition(parts, "src", "run")
    slots = runs.withColumn("slot", F.explode(F.expr("sequence(start + run * 4096, start + least(quota, (run + 1) * 4096) - 1)")))
    slots = slots.select("src", "blocks", "quota", permuted(F.col("slot"), F.lit(n_slots)).alias("place"))
    drawn = slots.groupBy("src", "blocks", "quota", F.expr(f"place div {shard}").alias("shard")).agg(F.count("*").alias("n_slots"))
    return running(shared_table(drawn, "mix-draws"), "n_slots", "first", "shard", ["src"])


def slot_blocks(draws: DataFrame, parts: int, last: bool = False) -> DataFrame:
    """(shard, src, epoch, block): the block that each slot takes; last: of slots that are in no whole epoch only."""
    begin = "greatest(first, quota div blocks * blocks)" if last else "first"
    slots = draws.filter("first + n_slots > quota div blocks * blocks" if last else "true").repartition(parts, "src", "shard")
    slots = slots.withColumn("k", F.explode(F.expr(f"sequence({begin}, first + n_slots - 1)")))
    slots = slots.withColumns({"epoch": F.expr("k div blocks"), "at": F.expr("k % blocks")})
    block = permuted(F.col("at"), F.col("blocks"), F.col("src"), F.col("epoch"))
    return slots.select("shard", "src", "epoch", block.alias("block"))


def pieces(rows: DataFrame, n_rows: int) -> DataFrame:
    """rows(row, doc_id, th, src, size, block) -> (row, src, at, n, skip, place): the words of each row that lie in each
    block; n of them, after the first skip words of the row, from a place in the block on."""
    rows = rows.filter("size > 0").withColumn("grp", F.pmod(F.xxhash64("doc_id", "th"), F.lit(1 + n_rows // GROUP)))
    group = Window.partitionBy("src", "grp").orderBy("doc_id", "size", "th", "row")
    starts = shared_table(rows.groupBy("src", "grp").agg(F.sum("size").alias("g_size")), "mix-starts")
    starts = running(starts, "g_size", "g_start", "grp", ["src"])
    rows = join_sized(rows.withColumn("upto", F.sum("size").over(group)), starts.drop("g_size"), ["src", "grp"])
    rows = rows.withColumn("b", F.col("g_start") + F.col("upto")).withColumn("a", F.col("b") - F.col("size"))
    rows = rows.withColumn("at", F.explode(F.expr("sequence(a div block, (b - 1) div block)")))
    begin = F.expr("greatest(a, at * block)")
    return rows.select("row", "src", "at", (F.expr("least(b, (at + 1) * block)") - begin).alias("n"), (begin - F.col("a")).alias("skip"), (begin - F.expr("at * block")).alias("place"))


class Mix:
    """A mix of docs(doc_id, text, source) and what it is made of."""

    def __init__(self, docs: DataFrame, weights=WEIGHTS, cap: int = CAP, block: int = BLOCK, shard: int = SHARD):
        sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("th"))
        sized = shared_table(sized.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
        n_rows = sized.count()
        sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
        sources = sources.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), F.expr(f"source_size div {FINE}"))).cast("long"))
        sources = sources.withColumn("blocks", F.expr("(source_size + block - 1) div block"))
        quota = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0)
        sources = shared_table(sources.withColumn("quota", F.least(quota.cast("long"), F.col("blocks") * cap)), "mix-sources")
        keys = sources.select(F.col("source").alias("_source"), "src", "source_size", "target", "block", "blocks", "quota")
        rows = join_sized(sized, keys, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
        # A few rows become very many slots, which Spark can't foresee: state how many tasks share them, and never broadcast them.
        self.parts = max(1, min((sources.agg(F.sum("quota")).first()[0] or 0) // PART, 100_000))
        self.draws = shard_draws(sources, self.parts, shard)
        self.pieces = pieces(rows, n_rows)
        times = slot_blocks(self.draws, self.parts, last=True).groupBy("src", F.col("block").alias("at")).agg(F.count("*").alias("times"))
        extra = self.pieces.join(times.hint("merge"), ["src", "at"]).groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("extra"))
        whole = F.when(F.col("size") > 0, F.col("size") * F.expr("quota div blocks")).otherwise(0)
        taken = (whole + F.coalesce("extra", F.lit(0))).cast("long")
        #: doc_id, size, source_size, target, taken (words the mix takes), source, src, row, th: a row for each row of docs
        self.rows = rows.join(extra, "row", "left").select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "src", "row", "th")
        self._docs, self._sized = docs, sized

    def slots(self) -> DataFrame:
        """(shard, src, epoch, block): what every slot of every output shard holds."""
        return slot_blocks(self.draws, self.parts)

    def blocks(self) -> DataFrame:
        """(shard, src, epoch, block, words): the slots joined, by block index, to the words they hold."""
        own = self._sized.select("row", F.col("doc_id").alias("_doc"), F.col("source").alias("_source"), F.col("th").alias("_th"))
        # rows that agree in doc_id, source and text hold the same words
        same = F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("source").eqNullSafe(F.col("_source")) & (F.xxhash64("text") == F.col("_th"))
        texts = self._docs.select("doc_id", "source", "text").dropDuplicates().join(own, same)
        texts = texts.select("row", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("all"))
        held = self.pieces.join(texts, "row").select("src", F.col("at").alias("block"), "place", F.slice("all", (F.col("skip") + 1).cast("int"), F.col("n").cast("int")).alias("part"))
        held = held.groupBy("src", "block").agg(F.array_sort(F.collect_list(F.struct("place", "part"))).alias("parts"))
        return self.slots().join(held, ["src", "block"]).select("shard", "src", "epoch", "block", F.flatten(F.transform("parts", lambda p: p["part"])).alias("words"))


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, block: int = BLOCK, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """The mix of docs(doc_id, text, source): a row per input row with taken, and the slots (shard, src, epoch, block)."""
    made = Mix(docs, weights, cap, block, shard)
    return made.rows, made.slots()


def whole_copies(mixed: DataFrame, group: int = GROUP) -> DataFrame:
    """Rows of mix that are taken as whole documents -> source, doc_id, th, times.

    taken / size is rounded with its remainder carried from document to document of a source, from a seeded start: times
    is one of the two integers beside it, and a source's words stay within two documents of a group of what is taken."""
    rows = shared_table(mixed.filter("taken > 0").select("source", "src", "doc_id", "th", "row", "size", "taken"), "mix-taken")
    rows = join_sized(rows, rows.groupBy("src").agg(F.count("*").alias("n")), ["src"])
    share = F.expr(f"taken * {ONE} div size")
    rows = rows.withColumns({"grp": F.pmod(F.xxhash64("doc_id", "th"), F.expr(f"1 + n div {group}")), "share": share}).drop("n")
    starts = shared_table(rows.groupBy("src", "grp").agg(F.sum("share").alias("g_share")), "mix-shares")
    starts = running(starts, "g_share", "before", "grp", ["src"])
    starts = starts.select("src", "grp", (F.pmod(F.xxhash64(F.lit(SEED), "src"), F.lit(ONE)) + F.col("before")).alias("start"))
    # Neighbours have like sizes, so that a carried remainder is worth about as many words where it is paid out.
    order = Window.partitionBy("src", "grp").orderBy("size", F.xxhash64(F.lit(SEED), "doc_id", "th"), "doc_id", "th", "row")
    rows = rows.withColumn("upto", F.sum("share").over(order))
    rows = join_sized(rows, starts, ["src", "grp"])
    return rows.select("source", "doc_id", "th", F.expr(f"cast((start + upto) div {ONE} - (start + upto - share) div {ONE} as int)").alias("times"))


def query(spark, docs: DataFrame) -> DataFrame:
    return Mix(docs).rows.drop("row", "source", "src", "th")
