"""Mix sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Every source's documents are laid out in a seeded order and cut into blocks of
equal words: ``BLOCK_WORDS``, or fewer where a source is so small that a block
would be over 1 / ``FINEST`` of it (one word at least). Seats, one block each, go
to sources by the highest quotients target / (2 * seats + 1). Apportioning the
first s shards' seats for every s gives integer quotas per shard that never go
down, as the method is house-monotone. A source's seats run through its seeded
block order as often as needed: shard s holds the seats from its quota's start
to its end, so the blocks of a shard are a seeded selection, repeats included.
What a source takes differs from its target by three blocks at most: at most 3
words, or 3 / ``FINEST`` of the source.

All of it is DataFrame operations. Positions inside a source come from
distributed prefix sums, so a source with a third of the rows spreads over many
tasks; tables with one row for each source are the only ones ranked as a whole.

Results for odd input: null and blank texts have size 0 and nothing is taken of
them; the null source is a source of its own and comes last; rows with a null or
a repeated id each take what their own place in the order gives (the order is by
a seeded hash, then id, size and source); an empty table gives an empty table;
other columns are not read by ``mix`` and pass through ``stage``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.operators.prefix import prefix_sums
from quadrille.storage import materialize, row_key

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 64
FINEST = 64
MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
SHARDS = 40
SEED = 20


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per source (source, source_size): weight and target; a share above the cap is dealt to the others by weight.

    With sources in order of cap / weight, the capped ones come first, and the
    level (words per unit of weight) is what is left over by them, divided by
    the weight of the rest.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    table = F.array(*[F.lit(w) for w in weights])
    weighed = ranked.withColumn("weight", F.element_at(table, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn(
        "cap", F.lit(max_repeats) * F.col("source_size")
    )
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    filled = (
        weighed.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(earlier), F.lit(0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
        .withColumn("place", F.row_number().over(order))
        .withColumn("level", F.col("left") / F.col("open"))
    )
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))
    final = F.min(fits).over(everything).getField("level")
    target = F.least(F.col("cap").cast("double"), F.coalesce(final, F.lit(float("inf"))) * F.col("weight"))
    return filled.withColumn("target", target).select("source", "source_size", "rank", "weight", "target")


def with_blocks(targets: DataFrame, block_words: int = BLOCK_WORDS, finest: int = FINEST) -> DataFrame:
    """Add ``block``, the words of a block (the same for all sources), and ``blocks``, how many a source has."""
    least = F.min(F.when(F.col("source_size") > 0, F.col("source_size"))).over(Window.partitionBy())
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(least / F.lit(finest)))).cast("long")
    return targets.withColumn("block", block).withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")))


def apportion(blocked: DataFrame, shards: int = SHARDS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, rank, shard, upto): blocks of each source in the shards up to this one, by the highest quotients.

    ``blocked`` is source_targets() with_blocks().

    The seats of the first s shards are apportioned for every s at once. Rounding
    target / divisor is the method's own allocation for the number of seats it
    sums to; the seats that are missing or over (half the number of sources at
    most) are then given to the highest, or taken from the lowest, quotients.
    """
    everything = Window.partitionBy()
    base = blocked.where("source_size > 0").select("source", "rank", "target", "block", "blocks", F.sum("source_size").over(everything).alias("sum"))
    whole = F.round(F.col("sum") / F.col("block")).cast("long")
    houses = base.withColumn("prefix", F.explode(F.sequence(F.lit(1), F.lit(shards)))).withColumn(
        "house", F.floor(whole * F.col("prefix") / shards)
    )
    house = Window.partitionBy("prefix")
    share = F.round(F.col("target") * F.col("house") / F.col("sum")).cast("long")
    first = houses.withColumn("q", F.least(share, F.col("blocks") * max_repeats))
    first = first.withColumn("off", F.col("house") - F.sum("q").over(house))
    step = F.explode_outer(F.when(F.col("off") != 0, F.sequence(F.lit(1), F.abs("off").cast("int"))))
    seat = first.withColumn("k", step)
    more = F.when(F.col("q") + F.col("k") <= F.col("blocks") * max_repeats, -F.col("target") / (2 * (F.col("q") + F.col("k")) - 1))
    less = F.when(F.col("q") - F.col("k") >= 0, F.col("target") / (2 * (F.col("q") - F.col("k")) + 1))
    seat = seat.withColumn("quotient", F.when(F.col("off") > 0, more).otherwise(less))
    # of equal quotients the first source's is the higher
    order = house.orderBy(F.col("quotient").asc_nulls_last(), F.when(F.col("off") > 0, F.col("rank")).otherwise(-F.col("rank")), "k")
    chosen = seat.withColumn("n", F.row_number().over(order)).withColumn(
        "delta", F.when(F.col("quotient").isNotNull() & (F.col("n") <= F.abs("off")), F.signum("off")).otherwise(F.lit(0)).cast("long")
    )
    totals = chosen.groupBy("source", "rank", "prefix").agg((F.max("q") + F.sum("delta")).alias("upto"))
    return totals.select("source", "rank", (F.col("prefix") - 1).alias("shard"), "upto")


def mix(docs: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS, shards: int = SHARDS, max_repeats: int = MAX_REPEATS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, size): start in its source's order, plan of the source, words taken and the shards that hold them.

    Columns in ``carry`` stay, and order what the seeded draw, id and size do not.
    """
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size")))
    # written first: a range partitioning reads its input twice
    rows = materialize(docs.select("doc_id", "source", "size", *carry).withColumn("__draw", draw), "sizes")
    laid = materialize(prefix_sums(rows, ["__draw", "doc_id", "size", *carry], F.col("size"), group="source", out="start"), "laid-out")
    sizes = laid.groupBy("source").agg(F.sum("size").alias("source_size"))
    blocked = materialize(with_blocks(source_targets(sizes, max_repeats), block_words), "targets")
    quotas = apportion(blocked, shards, max_repeats).groupBy("rank").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("shard", "upto"))), lambda x: x["upto"]).alias("upto")
    )
    plan = materialize(
        blocked.join(quotas, "rank", "left")
        .withColumn("seats", F.coalesce(F.element_at("upto", -1), F.lit(0)))
        .withColumn("rounds", F.when(F.col("blocks") > 0, F.floor(F.col("seats") / F.col("blocks"))).otherwise(F.lit(0)))
        .withColumn("rest_words", (F.col("seats") - F.col("rounds") * F.col("blocks")) * F.col("block"))
        .drop("rank"),
        "mix-plan",
    )
    joined = laid.withColumnRenamed("source", "__source").join(plan, F.col("__source").eqNullSafe(F.col("source")))
    inside = F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), F.col("rest_words")) - F.col("start"))
    shard_of = lambda seat: F.size(F.filter("upto", lambda u: u <= seat))
    seat_at = lambda round_, word: round_ * F.col("blocks") + F.floor(word / F.col("block"))
    runs = lambda r, end: F.sequence(shard_of(seat_at(r, F.col("start"))), shard_of(seat_at(r, end - 1)))
    whole = F.when((F.col("size") > 0) & (F.col("rounds") > 0), F.flatten(F.transform(F.sequence(F.lit(0), F.col("rounds") - 1), lambda r: runs(r, F.col("start") + F.col("size")))))
    last = F.when(inside > 0, runs(F.col("rounds"), F.col("start") + inside))
    none = F.array().cast("array<int>")
    return (
        joined.withColumn("taken", (F.col("rounds") * F.col("size") + inside).cast("long"))
        .withColumn("shards", F.array_distinct(F.concat(F.coalesce(whole, none), F.coalesce(last, none))))
        .drop("__source", "__draw", "upto")
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select("doc_id", "source", words_in(F.col("text")).alias("size"))
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken", "seats", F.array_join("shards", ",").alias("shards"), "source")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one that a source's last block cuts stays if its middle is inside.

    Rows are told apart by content, not by id; equal rows are one row with the copies of all of them.
    """
    key = ("__key1", "__key2")
    keyed = docs.select("*", *[k.alias(n) for k, n in zip(row_key(docs), key, strict=True)])
    sized = keyed.select("doc_id", "source", words_in(F.col("text")).alias("size"), *key)
    middle = F.col("start") + F.col("size") / 2
    copies = F.col("rounds") + F.when(middle < F.col("rest_words"), 1).otherwise(0)
    mixed = mix(sized, carry=key).select(*key, F.when(F.col("size") > 0, copies).otherwise(0).cast("int").alias("__copies"))
    each = mixed.groupBy(*key).agg(F.sum("__copies").cast("int").alias("__copies")).where("__copies > 0")
    taken = keyed.dropDuplicates(list(key)).join(each, list(key))
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


ORACLE_SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
ranked as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rank from d group by source),
weighed as (select *, rank % 3 + 1 as weight, 3 * source_size as cap from ranked),
levels as (select *, (sum(source_size) over ()
      - coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0))::bigint
    / (sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0))::bigint as level,
    row_number() over (order by cap / weight, rank) as place from weighed),
targets as (select source, source_size, rank,
    least(cap::double, coalesce((select arg_min(level, place) from levels where level * weight <= cap), 'infinity'::double) * weight) as target,
    greatest(1, least(64, min(case when source_size > 0 then source_size end) over () // 64)) as block,
    sum(source_size) over ()::bigint as total from levels),
blocked as (select *, (source_size + block - 1) // block as blocks, round(total / block)::bigint as house from targets),
-- every quotient of every source, the highest first
seated as (select source, rank, house, row_number() over (order by target / (2 * j + 1) desc, rank, j) as n
  from blocked, unnest(range(0, 3 * blocks)) as t(j) where source_size > 0),
upto as (select rank, s, count(*) filter (where n <= floor(house * s / 40)) as upto from seated, unnest(range(1, 41)) as t(s) group by rank, s),
quotas as (select rank, list(upto order by s) as upto, max(upto) as seats from upto group by rank),
plan as (select b.*, coalesce(q.seats, 0) as seats, q.upto, case when blocks > 0 then coalesce(q.seats, 0) // blocks else 0 end as rounds
  from blocked b left join quotas q using (rank)),
laid as (select *, coalesce(sum(size) over (partition by source order by md5('20:' || coalesce(doc_id::varchar, '') || ':' || size), doc_id, size
    rows between unbounded preceding and 1 preceding), 0)::bigint as start from d),
placed as (select l.*, p.source_size, p.target, p.seats, p.upto, p.rounds, p.block, p.blocks,
    greatest(0, least(start + size, (p.seats - p.rounds * p.blocks) * p.block) - start) as inside
  from laid l join plan p on l.source is not distinct from p.source),
pieces as (select doc_id, source, size, r * blocks + start // block as lo,
    r * blocks + (start + case when r < rounds then size else inside end - 1) // block as hi, upto
  from placed, unnest(range(0, rounds + 1)) as t(r) where case when r < rounds then size else inside end > 0),
held as (select distinct doc_id, source, size, unnest(range(len(list_filter(upto, lambda u: u <= lo)), len(list_filter(upto, lambda u: u <= hi)) + 1)) as shard from pieces),
shown as (select doc_id, source, size, string_agg(shard::varchar, ',' order by shard) as shards from held group by all)
select p.doc_id, p.size, p.source_size, p.target, p.rounds * p.size + p.inside as taken, p.seats, coalesce(h.shards, '') as shards, p.source
from placed p left join shown h on h.doc_id = p.doc_id and h.size = p.size and h.source is not distinct from p.source
"""
