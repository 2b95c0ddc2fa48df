"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions.

SQL functions only.  Sources fill like vessels at a common level: source s takes weight(s) times
the level, clamped at `max_epochs` times its size, and what a clamped source cannot take raises
the level of the others.  Sorted by the level at which they clamp, the clamped sources are a
prefix, so the level follows from running sums and needs no iteration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.llm.common import documents, stored, unused

#: Fixed values of the mix: weights dealt to sources in order, share of all words, most epochs.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: Leading hex digits of the seeded order that form a bucket: a source's rows split 4096 ways.
BUCKET_DIGITS = 3

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Target of each source.

    The windows run over one row a source, summed before, in one task: sources are kinds of text,
    thousands at most; a table whose source is a page's address needs a coarser column.
    """
    sums = sized.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    dealt = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    sums = sums.withColumn("weight", dealt).withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    every = Window.partitionBy(F.lit(0))
    by_level = every.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum(F.col("source_size").cast("double")).over(every) * F.lit(share)
    sums = sums.withColumn("total", total)
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    clamped = F.col("cap") * F.sum("weight").over(onward) <= left * F.col("weight")
    sums = sums.withColumn("clamped", clamped)
    taken = F.coalesce(F.sum(F.when(F.col("clamped"), F.col("cap"))).over(every), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("clamped"), F.col("weight"))).over(every)
    level = (F.col("total") - taken) * F.col("weight") / open_weight
    return sums.withColumn("target", F.when(F.col("clamped"), F.col("cap")).otherwise(level)).select(
        "source_key", "source_size", "target"
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """Words that the mix takes of every document.

    A source's target, rounded, is spent as whole repetitions of all its documents and, for the
    rest, one more repetition of the documents that come first in a seeded order; the document
    at the border gives only the words that are left.  So a source's taken words equal its
    rounded target, and no document exceeds `max_epochs` times its size.

    One row per input row: null text has size 0, null sources form a source that comes last,
    repeated rows count each, an empty table gives none.  The source's rows are ordered inside
    buckets of the seeded order and the buckets by sums made before, so that no source, however
    large, meets in one task.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        key.alias("source_key"),
        word_count(F.col(text_col)).alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")).cast("binary")).alias("place"),
    ).withColumn("bucket", F.substring("place", 1, BUCKET_DIGITS))
    # Read the texts once: everything below works on a few bytes a row.
    sized = stored(sized, "mix-sizes")
    buckets = sized.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(
        "source_key", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("buckets_before")
    ).join(source_targets(sized, weights, share, max_epochs), "source_key")
    inside = Window.partitionBy("source_key", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.select(
        "doc_id", "source_key", "bucket", "size", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("rows_before")
    ).join(buckets, ["source_key", "bucket"])
    goal = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = goal - whole * F.col("source_size") - F.col("buckets_before") - F.col("rows_before")
    taken = whole * F.col("size") + F.least(F.greatest(rest, F.lit(0)), F.col("size"))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that the mix takes, with all their columns: one row a repetition.

    A document of which the mix takes no word goes (one without words stays as it is, once, and
    costs nothing); the last row of one taken in part holds its first words, blanks between them.
    Ids are taken as unique; rows that share an id share what is taken of their sizes.
    """
    names = docs.columns
    id_, size_, taken_, n_, whole_, part_, copy_ = unused(docs, "id", "size", "taken", "n", "whole", "part", "copy")
    taken = mix(docs, id_col, text_col, **options).groupBy(F.col("doc_id").alias(id_), F.col("size").alias(size_)).agg(F.max("taken").alias(taken_))
    size = F.when(F.col(size_) > 0, F.col(size_))
    whole = F.coalesce(F.floor(F.col(taken_) / size), F.lit(1)).cast("int")
    part = F.coalesce(F.col(taken_) % size, F.lit(0)).cast("int")
    rows = docs.withColumn(n_, word_count(F.col(text_col))).join(
        taken, F.col(id_col).cast("long").eqNullSafe(F.col(id_)) & (F.col(n_) == F.col(size_))
    )
    rows = rows.withColumn(whole_, whole).withColumn(part_, part).where((F.col(whole_) > 0) | (F.col(part_) > 0))
    copies = F.sequence(F.lit(1), F.col(whole_) + F.when(F.col(part_) > 0, 1).otherwise(0))
    rows = rows.withColumn(copy_, F.explode(copies))
    first_words = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), F.lit(1), F.greatest(F.col(part_), F.lit(1))), " ")
    text = F.when(F.col(copy_) <= F.col(whole_), F.col(text_col)).otherwise(first_words)
    return rows.withColumn(text_col, text).select(*names)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


SQL = f"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         md5(concat('{SEED}:', doc_id)) as place
  from documents
), sums as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as k from sized group by source
), weighed as (
  select source, source_size, case (k - 1) % 3 when 0 then 5e0 when 1 then 2e0 else 1e0 end as weight,
         (2 * source_size)::double as cap, sum(source_size::double) over () * 1.5e0 as total
  from sums
), levels as (
  select *, cap * sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following)
    <= (total - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0e0)) * weight as clamped
  from weighed
), targets as (
  select source, source_size, case when clamped then cap else
    (total - coalesce(sum(cap) filter (clamped) over (), 0e0)) * weight / sum(weight) filter (not clamped) over () end as target
  from levels
), placed as (
  select d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5e0)::bigint as goal,
         coalesce(sum(d.size) over (partition by d.source order by d.place, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from sized d join targets t on d.source is not distinct from t.source
), spent as (
  select *, case when source_size > 0 then goal // source_size else 0 end as whole from placed
)
select doc_id, size, source_size, target, (whole * size + least(greatest(goal - whole * source_size - before, 0), size))::bigint as taken
from spent
"""

QUERIES = {"op8_mix_sources": op8_mix_sources}
ORACLES = {"op8_mix_sources": SQL}
