"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame functions only.

1. A document's size is its number of words.  Sources, in code-point order with
   null last, take the weights in turn and share all words by weight; a target
   stops at ``MOST_LAPS`` times its source's size and the excess is shared anew.
   The level at which this settles is the largest quotient of what the lighter
   capped sources leave and the weight that remains, a running sum over sources.
2. Slot n of the mix takes one block of ``block`` words.  Its source is where
   the point n * golden ratio (mod 1, in exact 40-bit integers) falls among the
   cumulative targets.  Points and sources meet by an equi-join on cells of the
   unit interval, and slots are numbered per source by counts of slot chunks.
3. A source's documents, ordered by a hash of their id, form a stream, read
   again from its start as often as the target asks (laps).  The stream up to
   the rounded target is cut into equal blocks, the last one shorter.  Slot r of
   a source takes its block r.
4. The points give a source a few slots more or fewer than its blocks.  Surplus
   slots stay empty; blocks without a slot close the mix, in slots numbered from
   the schedule's end, so a source's taken words equal its rounded target.

Null and empty texts have size 0 and are taken 0 times; null ids count as the
empty id in the hash and sort first among equal hashes.  Rows repeated with id,
source and size are collapsed to one with a count and dealt out again in chunks,
so one repeated row may hold any share of the table.  Very long texts span many
blocks.  Ties in the order are rows that look alike.  An empty table gives an
empty result.  Other columns of the table, whatever their names, are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelflow.llm import common as C
from labelflow.operators.joins import bounded_broadcast
from labelflow.operators.runs import RANGE, ranged, running

BLOCK = 1024
WEIGHTS = (5, 2, 1)
MOST_LAPS = 3
POINT_BITS = 40
GOLDEN = int(2 ** POINT_BITS * (math.sqrt(5) - 1) / 2) | 1
CELL_BITS = 12
SLOT_CHUNK = 65_536
COPY_CHUNK = 4096
GAP, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"


def word_count(text: Column) -> Column:
    """Number of words: every word becomes one letter, with the gaps around it."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(t.rlike(WORD), F.length(F.regexp_replace(t, f"{GAP}*{WORD}+{GAP}*", "x"))).otherwise(0).cast("long")


def sizes(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(id, source, size, copies) of the distinct rows, written."""
    rows = docs.select(docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"),
                       word_count(docs[text_col]).alias("size"))
    return C.materialize(rows.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("copies")), "sizes")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, laps: int = MOST_LAPS) -> DataFrame:
    """(source, s, source_size, target, stop, lo, hi) of every source, written.

    ``stop`` is the rounded target; [lo, hi) is its share of the 2**40 points.
    """
    by_name = [F.col("source").asc_nulls_last()]
    sums = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    src = running(ranged(sums, by_name, "sources"), by_name, {"s": F.lit(1)}).drop(RANGE)
    each = math.lcm(*weights)
    src = src.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights) + 1).cast("int")))
    src = src.withColumn("cap", F.col("source_size") * laps)
    # cap / weight as an integer, the level from which a source is capped
    src = src.withColumn("level", F.col("cap") * F.element_at(
        F.array(*[F.lit(each // w) for w in weights]), (F.col("s") % len(weights) + 1).cast("int")))
    by_level = [F.col("level"), F.col("s")]
    src = running(ranged(src, by_level, "levels"), by_level, {"cap_before": F.col("cap"), "w_before": F.col("w")}).drop(RANGE)
    src = C.materialize(src, "capped")
    total, weight = src.agg(F.sum("source_size"), F.sum("w")).first()
    if total is None:
        total, weight = 0, 1
    left = (F.lit(total) - F.col("cap_before")) / (F.lit(weight) - F.col("w_before")).cast("double")
    share = src.agg(F.max(left)).first()[0] or 0.0
    target = F.least(F.col("cap").cast("double"), F.lit(share) * F.col("w"))
    src = src.withColumn("target", target).withColumn("stop", F.floor(F.col("target") + 0.5).cast("long"))
    by_rank = [F.col("s")]
    src = running(ranged(src, by_rank, "shares"), by_rank, {"before": F.col("stop")})
    whole = src.agg(F.sum("stop")).first()[0] or 1

    def point(words: Column) -> Column:
        return F.floor(words / F.lit(float(whole)) * F.lit(float(2 ** POINT_BITS))).cast("long")

    return C.materialize(src.select("source", F.col("s").cast("long").alias("s"), "source_size", "target", "stop",
                                    point(F.col("before")).alias("lo"),
                                    point(F.col("before") + F.col("stop")).alias("hi")), "targets")


def golden_point(n: Column) -> Column:
    """(n * GOLDEN) mod 2**40 in 64-bit integers, for n below 2**40."""
    half = 1 << (POINT_BITS // 2)
    low, high = n % half, F.floor(n / half).cast("long") % half
    return (low * GOLDEN + ((high * (GOLDEN % half)) % half) * half) % (1 << POINT_BITS)


def schedule(src: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, s, block) of every block of every source, written."""
    spark = src.sparkSession
    need = src.withColumn("blocks", F.ceil(F.col("stop") / block).cast("long"))
    whole, ranks = need.agg(F.sum("stop"), F.count(F.lit(1))).first()
    slots = math.ceil((whole or 0) / block)
    shift = POINT_BITS - max(CELL_BITS, ranks.bit_length() + 1)
    cells = (need.where("lo < hi").select(
        "s", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright(F.col("hi") - 1, shift))).alias("cell")))
    points = (spark.range(slots).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("at"))
              .withColumn("cell", F.shiftright("at", shift)))
    hits = (points.join(bounded_broadcast(cells), "cell").where("at >= lo and at < hi")
            .select("slot", "s", F.floor(F.col("slot") / SLOT_CHUNK).cast("long").alias("chunk")))
    hits = C.materialize(hits, "slots")
    by_chunk = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = hits.groupBy("s", "chunk").agg(F.count(F.lit(1)).alias("m"))
    before = counts.select("s", "chunk", F.coalesce(F.sum("m").over(by_chunk), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("s", "chunk").orderBy("slot")) - 1 + F.col("before")
    ranked = (hits.join(before, ["s", "chunk"]).select("slot", "s", number.cast("long").alias("block"))
              .join(bounded_broadcast(need.select("s", "blocks")), "s").where("block < blocks")
              .select("slot", "s", "block"))
    got = counts.groupBy("s").agg(F.sum("m").alias("got"))
    closing = (need.join(got, "s", "left").withColumn("got", F.coalesce("got", F.lit(0)))
               .where("got < blocks")
               .select("s", "got", F.explode(F.sequence("got", F.col("blocks") - 1)).alias("block"))
               .select((F.lit(slots) + (F.col("block") - F.col("got")) * ranks + F.col("s")).cast("long").alias("slot"),
                       "s", "block"))
    return C.materialize(ranked.unionByName(closing), "schedule")


def streams(rows: DataFrame, src: DataFrame) -> DataFrame:
    """(id, s, size, copies, source_size, target, stop, at): each row's place in its source's stream, written.

    Rows are summed by the first digits of their hash; a source's sums are
    cumulated, and a window orders the rows of one digit group.
    """
    count = max(rows.count(), 2)
    digits = max(1, round(math.log(math.sqrt(count), 16)))
    known = src.select(F.col("source").alias("name"), "s", "source_size", "target", "stop")
    keyed = (rows.join(bounded_broadcast(known), F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
             .withColumn("h", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")))
             .withColumn("digit", F.substring("h", 1, digits)))
    words = F.col("size") * F.col("copies")
    upto = Window.partitionBy("s").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    base = (keyed.groupBy("s", "digit").agg(F.sum(words).alias("m"))
            .select("s", "digit", F.coalesce(F.sum("m").over(upto), F.lit(0)).alias("base")))
    inside = (Window.partitionBy("s", "digit").orderBy("h", F.col("id").asc_nulls_first(), "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    placed = (keyed.withColumn("at", F.coalesce(F.sum(words).over(inside), F.lit(0)))
              .join(base, ["s", "digit"]).withColumn("at", (F.col("at") + F.col("base")).cast("long")))
    return C.materialize(placed.drop("base", "digit"), "streams")


def pieces(placed: DataFrame, plan: DataFrame, block: int = BLOCK, laps: int = MOST_LAPS) -> DataFrame:
    """Every row's parts in blocks, with their slot; a row of which nothing is taken has one part without a slot."""
    key = ["id", "s", "size", "copies", "source_size", "target", "stop", "at"]
    one = placed.where("copies = 1").select(*key, F.lit(0).cast("long").alias("copy"))
    last = F.col("copies") - 1
    many = (placed.where("copies > 1")
            .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / COPY_CHUNK).cast("long"))))
            .repartition(C.partitions(placed.sparkSession), "id", "s", "chunk")
            .select(*key, F.explode(F.sequence(F.col("chunk") * COPY_CHUNK,
                                               F.least(last, (F.col("chunk") + 1) * COPY_CHUNK - 1))).alias("copy")))
    rows = one.unionByName(many)
    start = F.col("lap") * F.col("source_size") + F.col("at") + F.col("copy") * F.col("size")
    begun = (rows.withColumn("lap", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(laps - 1).cast("long"))))
             .withColumn("a", start).withColumn("z", F.least(F.col("a") + F.col("size"), F.col("stop"))))
    # of a row that is not reached, the first lap stays as a part without a block
    begun = begun.where("lap = 0 or a < z")
    cut = begun.withColumn("block", F.explode_outer(F.when(
        F.col("a") < F.col("z"), F.sequence(F.floor(F.col("a") / block).cast("long"),
                                            F.floor((F.col("z") - 1) / block).cast("long")))))
    first = F.greatest("a", F.col("block") * block)
    cut = (cut.withColumn("start", first - F.col("a"))
           .withColumn("length", F.least("z", (F.col("block") + 1) * block) - first))
    return cut.join(plan.select(F.col("s").alias("ps"), F.col("block").alias("pb"), "slot"),
                    (F.col("s") == F.col("ps")) & (F.col("block") == F.col("pb")), "left").drop("ps", "pb")


def _parts(docs, id_col, source_col, text_col, block):
    rows = sizes(docs, id_col, source_col, text_col)
    src = targets(rows)
    return pieces(streams(rows, src), schedule(src, block), block), src


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        block: int = BLOCK) -> DataFrame:
    """(slot, source, id_col, copy, lap, start, length): the parts of the mix, in words of a document.

    Sorted by slot, source, block order within the stream they are the mix itself.
    """
    parts, src = _parts(docs, id_col, source_col, text_col, block)
    return (parts.where("slot is not null")
            .join(bounded_broadcast(src.select(F.col("s").alias("ss"), "source")), F.col("s") == F.col("ss"))
            .select("slot", "source", F.col("id").alias(id_col), "copy", "lap", "start", "length"))


def taken(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
          block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: id_col, size, source_size, target, taken (words of it in the mix)."""
    parts, _ = _parts(docs, id_col, source_col, text_col, block)
    return (parts.groupBy("id", "s", "size", "copy", "source_size", "target")
            .agg(F.sum(F.when(F.col("slot").isNotNull(), F.col("length")).otherwise(0)).alias("taken"))
            .select(F.col("id").alias(id_col), "size", "source_size", "target", "taken"))


def q_op13(spark, sf_dir):
    return taken(C.read(spark, sf_dir, "documents"))


QUERIES = {"op13_source_mix": q_op13}
ORACLE_SQL = {"op13_source_mix": r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
s as (
  select source, cast(sum(size) as bigint) as source_size,
         row_number() over (order by source nulls last) - 1 as r
  from d group by source),
w as (select *, 3 * source_size as cap, case r % 3 when 0 then 5 when 1 then 2 else 1 end as w from s),
f as (
  select *, cast(sum(source_size) over () - coalesce(sum(cap) over o, 0) as double)
            / cast(sum(w) over () - coalesce(sum(w) over o, 0) as double) as level
  from w window o as (order by cap * (10 // w), r rows between unbounded preceding and 1 preceding)),
t as (
  select source, source_size, least(cast(cap as double), (max(level) over ()) * w) as target from f),
p as (
  select d.*, t.source_size, t.target, cast(floor(t.target + 0.5) as bigint) as stop,
         coalesce(sum(size) over (partition by d.source
           order by md5(coalesce(cast(doc_id as varchar), '')), doc_id nulls first, size
           rows between unbounded preceding and 1 preceding), 0) as a
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       cast(greatest(0, least(stop, a + size) - a)
          + greatest(0, least(stop, source_size + a + size) - source_size - a)
          + greatest(0, least(stop, 2 * source_size + a + size) - 2 * source_size - a) as bigint) as taken
from p"""}
