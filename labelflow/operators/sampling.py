"""Deterministic sampling: per-class exemplars, stratified samples, exact
splits, fraction / fixed samples and seeded shuffles.

All of them order rows by :func:`labelflow.functions.hashing.det_hash` of
the row id (ties by the id), so a result never depends on task scheduling.

Scale notes
-----------
* Per-class top-k uses ``row_number() <= k`` over a class window; up to
  k = 1000 Spark plans a ``WindowGroupLimit`` that keeps at most k rows per
  class and task *before* the shuffle, so even a class holding a third of the
  table ships only k rows per task.  Beyond that, classes are ranked in parts.
* Exact-size splits and global positions never sort the whole table in one
  task: rows are counted per hash bucket (a small table), the bucket offsets
  are cumulated there, and only rows inside one bucket are ranked together.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelflow.operators.joins import bounded_broadcast
from labelflow.functions.hashing import DEFAULT_SEED, det_hash

# det_hash is 32 bits; the top BUCKET_BITS of it form the counting bucket.
BUCKET_BITS = 16


def _order(df: DataFrame, id_col: str, seed) -> DataFrame:
    return df.withColumn("_h", det_hash(id_col, seed))


# Spark keeps at most k rows per class and task before the shuffle only up to
# this k (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000
MAX_MERGED = 10_000_000


def top_k_per_group(df: DataFrame, group_col: str, k: int, id_col: str,
                    seed=DEFAULT_SEED, order_by_hash: bool = True,
                    rank_col: str = "rnk") -> DataFrame:
    """At most ``k`` rows per group, ordered by hash (or by id), ranked 1..k.

    Above ``GROUP_LIMIT`` a class is first cut into parts by a hash of the id,
    whose first ``k`` rows each go on to the class's own ranking, so no class is
    sorted in one task."""
    keys = [F.col("_h"), F.col(id_col)] if order_by_hash else [F.col(id_col)]
    base = _order(df, id_col, seed) if order_by_hash else df
    if k > GROUP_LIMIT:
        parts = max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MAX_MERGED // k))
        part = F.pmod(F.xxhash64(F.lit("part"), base[id_col]), F.lit(parts))
        base = base.withColumn("_part", part)
        first = F.row_number().over(Window.partitionBy(group_col, "_part").orderBy(*keys))
        base = base.withColumn("_r", first).filter(F.col("_r") <= k).drop("_r", "_part")
    w = Window.partitionBy(group_col).orderBy(*keys)
    out = base.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
    return out.withColumn(rank_col, F.col(rank_col).cast("bigint")).drop("_h")


def exemplars_per_class(df: DataFrame, class_col: str, text_col: str, n: int,
                        id_col: str, seed=DEFAULT_SEED) -> DataFrame:
    """Exemplars per class as ``(category, rnk, text, <id_col>)``.

    ``n == 0``: one exemplar per class whose text is the class name itself
    (zero-shot: the label describes the class).  Otherwise ``min(n, size)``
    rows per class in hash order.
    """
    if n == 0:
        return (df.select(F.col(class_col).alias("category")).distinct()
                  .select("category", F.lit(1).cast("bigint").alias("rnk"),
                          F.col("category").alias("text"),
                          F.lit(None).cast(df.schema[id_col].dataType).alias(id_col)))
    picked = top_k_per_group(df.select(class_col, text_col, id_col), class_col, n, id_col, seed)
    return picked.select(F.col(class_col).alias("category"), "rnk",
                         F.col(text_col).alias("text"), id_col)


def stratified_sample(df: DataFrame, class_col: str, k: int, id_col: str,
                      seed=DEFAULT_SEED, strict: bool = False) -> DataFrame:
    """At most ``k`` rows per class.  ``strict`` fails the job when a class has
    fewer than ``k`` rows (the exact-k variant)."""
    out = top_k_per_group(df, class_col, k, id_col, seed)
    if strict:
        counts = df.groupBy(class_col).agg(F.count(F.lit(1)).alias("_n"))
        # assert_true returns null or fails the job; filtering on it keeps the
        # check in the plan
        counts = counts.withColumnRenamed(class_col, "_class")
        out = (out.join(counts, F.col(class_col).eqNullSafe(F.col("_class")))
                  .filter(F.assert_true(F.col("_n") >= k,
                                        F.lit(f"a class has fewer than {k} rows")).isNull())
                  .drop("_n", "_class"))
    return out


def first_n_per_class(df: DataFrame, class_col: str, k: int, order_col: str) -> DataFrame:
    """First ``k`` rows per class in table order (``order_col``)."""
    return top_k_per_group(df, class_col, k, order_col, order_by_hash=False)


def dedup_first(df: DataFrame, text_col: str, order_col: str) -> DataFrame:
    """Keep the first row (smallest ``order_col``) of every exact text; null is a text.

    The verdict comes first and is narrow: 256-bit digests and order values are
    counted map-side, and only the digests of several rows are written, with
    their first order value.  They are broadcast where they fit, so texts are
    not shuffled.  Of rows that share text and first order value, the one with
    the smallest digest of all its columns stays; only those rows are grouped.
    """
    def digest(side: DataFrame):
        return F.coalesce(F.unhex(F.sha2(side[text_col].cast("string"), 256)), F.lit(b"null"))

    per = df.select(digest(df).alias("_k"), df[order_col].alias("_o")).groupBy("_k", "_o").agg(
        F.count(F.lit(1)).alias("_n"))
    several = (per.groupBy("_k").agg(F.sum("_n").alias("_all"), F.min("_o").alias("_first"),
                                     F.coalesce(F.min_by("_n", "_o"), F.sum("_n")).alias("_ties"))
                  .where(F.col("_all") > 1).select("_k", "_first", "_ties"))
    several = bounded_broadcast(several)
    first = df[order_col].eqNullSafe(F.col("_first"))
    found = df.join(several, digest(df) == F.col("_k"), "left")
    kept = found.where(F.col("_k").isNull() | (first & (F.col("_ties") == 1))).select(*[df[c] for c in df.columns])
    if several.where("_ties > 1").isEmpty():
        return kept
    row = F.struct(*[df[c] for c in df.columns])
    tied = (df.join(several.where("_ties > 1"), digest(df) == F.col("_k")).where(first)
              .select("_k", row.alias("_r")).groupBy("_k")
              .agg(F.min_by("_r", F.md5(F.to_json("_r", {"ignoreNullFields": "false"}))).alias("_r")))
    return kept.unionByName(tied.select("_r.*"))


def label_index(df: DataFrame, label_col: str, base: int = 1, name: str = "label_id") -> DataFrame:
    """Distinct labels numbered ``base, base+1, ...`` in sorted order.

    The window runs on the distinct label table only (the label vocabulary),
    never on the input rows.
    """
    labels = df.select(F.col(label_col).alias("label")).where(F.col("label").isNotNull()).distinct()
    w = Window.orderBy("label")
    return labels.withColumn(name, (F.row_number().over(w) + (base - 1)).cast("bigint"))


LAST_HASH = (1 << 32) - 1


def _bucketed(df: DataFrame, id_col: str, seed, bits: int) -> DataFrame:
    """Adds the 32-bit hash of the id and its first ``bits``; null ids come last."""
    h = F.coalesce(det_hash(id_col, seed), F.lit(LAST_HASH).cast("bigint"))
    return df.withColumn("_h", h).withColumn("_b", F.shiftright(F.col("_h"), 32 - bits))


def _row_tie(df: DataFrame, id_col: str):
    """Tells rows without an id apart (0 for all others)."""
    return F.when(F.col(id_col).isNull(), F.xxhash64(*df.columns)).otherwise(F.lit(0).cast("bigint"))


def exact_split(df: DataFrame, id_col: str, test_fraction: float = 0.2,
                by: Sequence[str] = (), seed=DEFAULT_SEED, bits: int = BUCKET_BITS,
                split_col: str = "split") -> DataFrame:
    """Exact-size train/test split: ``ceil(test_fraction * n)`` rows of each
    ``by`` group (or of the whole table) go to ``test`` in hash order.

    Rows are counted per (group, hash bucket); the cumulative counts of that
    small table locate the one boundary bucket per group, and ranking the ids
    in it gives the group's cut (hash, id).  The split is then a comparison
    with the cut: only ids and groups are ever shuffled, never whole rows.
    Null groups are a group, null ids come last.  Rows that share an id (or
    lack one and are equal) fall on one side, so sizes are exact for unique ids.
    """
    by = list(by)
    rows = _bucketed(df.select(*by, F.col(id_col).alias("_id"), _row_tie(df, id_col).alias("_t")),
                     "_id", seed, bits)
    group = [f"_g{i}" for i in range(len(by))]
    rows = rows.select(*[F.col(c).alias(g) for c, g in zip(by, group)], "_id", "_t", "_h", "_b")
    counts = rows.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group) if group else Window.partitionBy()
    cum = (counts.withColumn("_cum", F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)))
                 .withColumn("_tot", F.sum("_n").over(w))
                 .withColumn("_k", F.ceil(F.col("_tot") * F.lit(Decimal(str(test_fraction)))).cast("bigint")))
    boundary = (cum.filter((F.col("_cum") - F.col("_n") < F.col("_k")) & (F.col("_cum") >= F.col("_k")))
                   .select(*[F.col(g).alias("c" + g) for g in group], F.col("_b").alias("c_b"),
                           (F.col("_k") - (F.col("_cum") - F.col("_n"))).alias("_need")))

    def same_group(left):
        hit = F.lit(True)
        for c, g in zip(left, group):
            hit = hit & F.col(c).eqNullSafe(F.col("c" + g))
        return hit

    edge = rows.join(boundary, same_group(group) & (F.col("_b") == F.col("c_b")))
    inside = Window.partitionBy(*group, "_b").orderBy("_h", F.col("_id").asc_nulls_last(), "_t")
    cut = (edge.withColumn("_r", F.row_number().over(inside)).filter(F.col("_r") == F.col("_need"))
               .select(*["c" + g for g in group], F.struct("_h", F.col("_id").isNull().alias("z"), "_id", "_t").alias("_cut")))
    own = F.struct(F.coalesce(det_hash(id_col, seed), F.lit(LAST_HASH).cast("bigint")).alias("_h"),
                   F.col(id_col).isNull().alias("z"), F.col(id_col).alias("_id"), _row_tie(df, id_col).alias("_t"))
    # one cut per group; a group without a test row has none
    out = df.withColumn("_own", own).join(bounded_broadcast(cut), same_group(by), "left")
    test = F.col("_cut").isNotNull() & (F.col("_own") <= F.col("_cut"))
    return out.withColumn(split_col, F.when(test, F.lit("test")).otherwise(F.lit("train"))).drop(
        "_own", "_cut", *["c" + g for g in group])


def train_test_split(df: DataFrame, id_col: str, test_fraction: float = 0.2,
                     seed=DEFAULT_SEED) -> tuple[DataFrame, DataFrame]:
    """(train, test) with exactly ``ceil(test_fraction * n)`` test rows."""
    s = exact_split(df, id_col, test_fraction, seed=seed, split_col="_split")
    return (s.filter(F.col("_split") == "train").drop("_split"),
            s.filter(F.col("_split") == "test").drop("_split"))


def stratified_split(df: DataFrame, id_col: str, class_col: str,
                     test_fraction: float = 0.2, seed=DEFAULT_SEED) -> DataFrame:
    """Per class exactly ``ceil(test_fraction * class size)`` test rows."""
    return exact_split(df, id_col, test_fraction, by=(class_col,), seed=seed)


def hash_split(df: DataFrame, id_col: str, test_percent: int = 20, seed=DEFAULT_SEED,
               split_col: str = "split") -> DataFrame:
    """Streaming-friendly split: test iff ``hash % 100 < test_percent``.
    A projection only: no shuffle, no count."""
    test = F.pmod(det_hash(id_col, seed), F.lit(100)) < test_percent
    return df.withColumn(split_col, F.when(test, F.lit("test")).otherwise(F.lit("train")))


def fraction_sample(df: DataFrame, id_col: str, percent: int = 30, seed=DEFAULT_SEED) -> DataFrame:
    """About ``percent`` % of the rows without replacement (hash threshold)."""
    return df.filter(F.pmod(det_hash(id_col, seed), F.lit(100)) < percent)


def fixed_sample(df: DataFrame, id_col: str, n: int = 100, seed=DEFAULT_SEED) -> DataFrame:
    """Exactly ``min(n, rows)`` rows: the ``n`` smallest hashes (a per-task
    top-n followed by one merge of n rows per task)."""
    return (_order(df, id_col, seed).orderBy("_h", id_col).limit(n).drop("_h"))


def seeded_shuffle(df: DataFrame, id_col: str, seed=DEFAULT_SEED, pos_col: str = "pos",
                   bits: int = BUCKET_BITS) -> DataFrame:
    """Deterministic permutation: adds ``pos`` = 1..n in hash order.

    Global positions without a global sort: per-bucket counts are cumulated
    into bucket offsets (a table of at most 2 * 2**bits rows), rows are ranked
    only inside their bucket, and ``pos = offset + rank``.  A bucket is the
    first ``bits`` of the id's hash.  Rows without an id come last, ordered and
    dealt by a second hash over the whole row; rows of one id are ordered by it.

    A bucket far above the mean holds an id that repeats.  Its rows are first
    collapsed where they are equal in all columns (their positions are a run),
    and ranked by id and the first bits of the second hash.
    """
    keyed = _shuffle_keys(df, id_col, seed, bits)
    counts = keyed.groupBy("_z", "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_z", "_b").rowsBetween(Window.unboundedPreceding, -1)
    mean = F.sum("_n").over(Window.partitionBy()) / (1 << bits)
    offsets = bounded_broadcast(counts.select(
        "_z", "_b", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_off"),
        (F.col("_n") > F.greatest(2 * mean, F.lit(MANY_ROWS))).alias("_hot")))
    placed = keyed.join(offsets, ["_z", "_b"])
    inside = ["_h", F.col("_id").asc_nulls_last(), "_h2"]
    rank = F.row_number().over(Window.partitionBy("_z", "_b").orderBy(*inside))
    out = placed.where(~F.col("_hot")).select("_row", (F.col("_off") + rank).cast("bigint").alias("_pos"))
    if not offsets.where("_hot").isEmpty():
        out = out.unionByName(_hot_positions(placed.where("_hot"), df.sparkSession))
    return out.select("_row.*", F.col("_pos").alias(pos_col))


# Rows that one task may rank in one group whatever the mean; copies dealt out at once.
MANY_ROWS = 1000
COPY_CHUNK = 4096


def _shuffle_keys(df: DataFrame, id_col: str, seed, bits: int) -> DataFrame:
    """(_row, _id, _z, _h, _h2, _b): id missing, its hash, the whole row's hash, and the bucket."""
    cols = [df[c] for c in df.columns]
    keyed = df.select(F.struct(*cols).alias("_row"), df[id_col].alias("_id"), df[id_col].isNull().alias("_z"),
                      F.coalesce(det_hash(df[id_col], seed), F.lit(LAST_HASH).cast("bigint")).alias("_h"),
                      F.xxhash64(F.lit(str(seed)), *cols).alias("_h2"))
    return keyed.withColumn("_b", F.when(F.col("_z"), F.shiftrightunsigned("_h2", 64 - bits))
                            .otherwise(F.shiftright("_h", 32 - bits)))


def _hot_positions(rows: DataFrame, spark) -> DataFrame:
    """(_row, _pos) of buckets that hold repeated ids, see :func:`seeded_shuffle`."""
    one = (rows.groupBy("_z", "_b", "_off", "_h", "_id", "_h2")
               .agg(F.first("_row").alias("_row"), F.count(F.lit(1)).alias("_m"))
               .withColumn("_b2", F.shiftrightunsigned("_h2", 64 - BUCKET_BITS)))
    key = ["_z", "_b", "_h", "_id", "_b2"]
    earlier = (Window.partitionBy("_z", "_b").orderBy("_h", F.col("_id").asc_nulls_last(), "_b2")
                     .rowsBetween(Window.unboundedPreceding, -1))
    parts = (one.groupBy(*key).agg(F.sum("_m").alias("_p"))
                .select(F.struct(*key).alias("_part"), F.coalesce(F.sum("_p").over(earlier), F.lit(0)).alias("_before")))
    within = Window.partitionBy(*key).orderBy("_h2").rowsBetween(Window.unboundedPreceding, -1)
    start = (one.withColumn("_run", F.coalesce(F.sum("_m").over(within), F.lit(0)))
                .withColumn("_part", F.struct(*key)).join(parts, "_part")
                .select("_row", "_h2", "_m", (F.col("_off") + F.col("_before") + F.col("_run")).alias("_s")))
    last = F.col("_m") - 1
    runs = (start.where("_m > 1")
                 .withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / COPY_CHUNK).cast("bigint"))))
                 .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_h2", "_c")
                 .select("_row", "_s", F.explode(F.sequence(F.col("_c") * COPY_CHUNK, F.least(
                     last, (F.col("_c") + 1) * COPY_CHUNK - 1))).alias("_i")))
    single = start.where("_m = 1").select("_row", "_s", F.lit(0).cast("bigint").alias("_i"))
    return single.unionByName(runs).select("_row", (F.col("_s") + F.col("_i") + 1).cast("bigint").alias("_pos"))
