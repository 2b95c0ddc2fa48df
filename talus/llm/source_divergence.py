"""How far the sources of a language diverge, by exact integer chi-square contributions of their terms.

Terms are counted inside tasks, summed, and packed: a source's counts over one chunk of its language's
vocabulary are one row of positions and counts.  Sources fall into blocks; each tile of two blocks gets
the vectors of both, once for each span of vocabulary chunks, and one task computes its submatrix of
pairs chunk by chunk.  Spans are added up afterwards.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.llm.common import documents, give_back, slices, stored

RESULT = "lang string, source string, part string, item string, value long, rank int"
#: Documents of its language that a term must occur in to be kept, and ranks of terms that are reported.
MIN_DOCS, TOP_TERMS = 3, 200
#: Shares are integers of this unit (fixed value of the contract).
UNIT = 1_000_000_000
#: Kept terms of a vocabulary chunk, chunks of a span, and sources of a block, on average.
CHUNK, SPAN, BLOCK = 4096, 8, 32
#: Languages up to which their table is sent to all tasks, so that no language's terms meet in one.
FEW = 10_000
#: Distinct (group, term) entries that a counting task holds before it hands them on.
HELD = 200_000

#: Bytes that are no part of a term become blanks, and A to Z become a to z; all bytes of other characters stay.
_FOLD = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTED = "lang string, source string, term string, n long, docs long"


def term_counts(docs: DataFrame) -> DataFrame:
    """Partial counts `lang, source, term, n, docs`; a row of null term tells that the group occurs."""

    def flush(held: dict):
        for (lang, source), (n, docs_) in held.items():
            terms = [*n, None]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(terms), pa.string()),
                    pa.array([source] * len(terms), pa.string()),
                    pa.array([t if t is None else t.decode() for t in terms], pa.string()),
                    pa.array([*n.values(), 0], pa.int64()),
                    pa.array([*(docs_[t] for t in n), 0], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in slices(batches, 2):
            for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                n, docs_ = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                counted = Counter(text.encode().translate(_FOLD).split())
                n.update(counted)
                docs_.update(counted.keys())
                size += len(n) - before
                if size > HELD:
                    yield from flush(held)
                    held, size = {}, 0
        yield from flush(held)
        give_back()

    whole = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return whole.mapInArrow(run, _COUNTED)


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + kept)), exactly: three digits of the quotient at a time, without overflow."""
    whole = total + kept
    left, out = n + 1, F.lit(0).cast("long")
    for _ in range(3):
        out = out * 1000 + F.call_function("div", (left % whole) * 1000, whole)
        left = (left % whole) * 1000
    # Where one term is all there is, the quotient is UNIT itself.
    return F.call_function("div", n + 1, whole) * UNIT + out + 1


def _long_share(n: np.ndarray, whole: int) -> np.ndarray:
    """As `share`, on arrays."""
    high, left = np.divmod(n + 1, whole)
    out = np.zeros_like(n)
    for _ in range(3):
        digit, left = np.divmod(left * 1000, whole)
        out = out * 1000 + digit
    return high * UNIT + out + 1


def gap(p, q):
    """floor((p - q)² / q) of arrays of shares."""
    return (p - q) * (p - q) // q


class Audit:
    """The stored tables of an audit: groups, kept terms, and counts of kept terms by group."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS, chunk: int = CHUNK):
        counts = stored(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")
        occurring = counts.where("term is null").select("lang", "source")
        kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs"))
        kept = stored(kept.where(F.col("docs") >= min_docs).drop("docs"), "kept-terms")
        langs = occurring.groupBy("lang").agg(F.count("*").alias("n_groups"))
        sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all_n").alias("all_total"))
        zero = F.lit(0).cast("long")
        langs = langs.join(sizes, "lang", "left").select("lang", "n_groups", F.coalesce("kept", zero).alias("kept"), F.coalesce("all_total", zero).alias("all_total"))
        self.langs = stored(langs, "languages")
        langs = F.broadcast(self.langs) if self.langs.count() <= FEW else self.langs
        # Terms are dealt to chunks by hash and numbered inside a chunk, whose size hashing bounds.
        chunked = kept.join(langs.select("lang", "kept"), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.ceil(F.col("kept") / chunk)).cast("int"))
        numbered = chunked.select("lang", "term", "all_n", "chunk", (F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1).alias("pos"))
        self.terms = stored(numbered, "vocabulary")
        self.counts = stored(counts.where("term is not null").drop("docs").join(self.terms, ["lang", "term"]), "kept-counts")
        totals = self.counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        self.groups = stored(
            occurring.join(totals, ["lang", "source"], "left").join(langs, "lang").withColumn("total", F.coalesce("total", zero)), "groups"
        )

    def top_terms(self, top: int = TOP_TERMS) -> DataFrame:
        """Terms whose share in the group is above their share in the language, by their gap."""
        joined = self.counts.join(self.groups, ["lang", "source"])
        p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("all_n"), F.col("all_total"), F.col("kept"))
        shares = joined.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
        valued = shares.select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        return valued.withColumn("rank", rank).where(F.col("rank") <= top)

    def _tiles(self, block: int, span: int) -> tuple[DataFrame, DataFrame]:
        """Vectors and groups, each once for every tile of its block and span of chunks."""
        blocks = F.ceil(F.col("n_groups") / block).cast("int")
        placed = self.groups.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("source"), blocks).cast("int"))
        spread = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        tile = [F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")]
        vectors = self.counts.groupBy("lang", "source", "chunk").agg(F.sort_array(F.collect_list(F.struct("pos", "n"))).alias("v"))
        vectors = vectors.select("lang", "source", "chunk", F.col("v.pos").alias("pos"), F.col("v.n").alias("n"))
        vectors = vectors.join(placed.select("lang", "source", "blocks", "block"), ["lang", "source"])
        vectors = vectors.select("lang", F.floor(F.col("chunk") / span).cast("int").alias("span"), "source", "block", "chunk", "pos", "n", spread)
        # Every span of a language with its number of terms, also where no group of a tile has any of them.
        widths = self.terms.groupBy("lang", F.floor(F.col("chunk") / span).cast("int").alias("span")).agg(F.count("*").alias("width"))
        widths = self.langs.select("lang").join(widths, "lang", "left").select("lang", F.coalesce("span", F.lit(0)).alias("span"), F.coalesce("width", F.lit(0)).alias("width"))
        heads = placed.join(widths, "lang").select("lang", "span", "source", "block", (F.col("total") + F.col("kept")).alias("whole"), "width", spread)
        return vectors.select("*", *tile).drop("other"), heads.select("*", *tile).drop("other")

    def pairs(self, block: int = BLOCK, span: int = SPAN) -> DataFrame:
        """The gap of every ordered pair of a language's sources, summed over all its kept terms, by tiles."""
        vectors, heads = self._tiles(block, span)
        none = F.lit(None)
        rows = heads.select("lang", "a", "b", "span", "source", "block", "whole", "width", none.cast("int").alias("chunk"), none.cast("array<int>").alias("pos"), none.cast("array<long>").alias("n"))
        rows = rows.unionByName(vectors.select("lang", "a", "b", "span", "source", "block", none.cast("long").alias("whole"), none.cast("long").alias("width"), "chunk", "pos", "n"))
        tiles = rows.groupBy("lang", "a", "b", "span").applyInArrow(tile_gaps, "lang string, source string, item string, value long")
        summed = tiles.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        return summed.withColumn("rank", rank)


def _packed(cell: pa.ListScalar) -> np.ndarray:
    return cell.values.to_numpy(zero_copy_only=False).astype(np.int64)


def tile_gaps(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The submatrix of one tile over the chunks of one span.

    Terms that no group of the tile has give the same gap each: they are counted, not visited.
    """
    lang, a, b, _ = (k.as_py() for k in key)
    table = table.combine_chunks()
    head = table.filter(pc.is_valid(table["whole"]))
    sources, block, whole = head["source"].to_pylist(), head["block"].to_numpy(), head["whole"].to_numpy()
    width = int(head["width"][0].as_py())
    left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
    number = {s: i for i, s in enumerate(sources)}
    values = np.zeros((2, len(left), len(right)), np.int64)
    rest = width
    body = table.filter(pc.is_valid(table["chunk"]))
    chunks, owners = body["chunk"].to_numpy(), [number[s] for s in body["source"].to_pylist()]
    for chunk in np.unique(chunks):
        rows = np.flatnonzero(chunks == chunk)
        at = [_packed(body["pos"][int(r)]) for r in rows]
        there, slot = np.unique(np.concatenate(at), return_inverse=True)
        counts = np.zeros((len(sources), len(there)), np.int64)
        ends = np.cumsum([len(x) for x in at])
        for r, x, e in zip(rows, at, ends):
            counts[owners[r], slot[e - len(x) : e]] = _packed(body["n"][int(r)])
        shares = np.stack([_long_share(c, w) for c, w in zip(counts, whole)])
        rest -= len(there)
        for i, row in enumerate(shares[left]):
            values[0, i] += gap(row, shares[right]).sum(axis=1)
            values[1, i] += gap(shares[right], row).sum(axis=1)
    if rest:
        none = np.array([_long_share(np.zeros(1, np.int64), w)[0] for w in whole])
        p, q = none[left][:, None], none[right][None, :]
        values[0] += rest * gap(p, q)
        values[1] += rest * gap(q, p)
    names = np.array(sources, object)
    x, y = np.repeat(names[left], len(right)), np.tile(names[right], len(left))
    # A tile of one block with itself holds both orders already.
    sides = [(x, y, values[0].ravel())] if a == b else [(x, y, values[0].ravel()), (y, x, values[1].ravel())]
    one, two, value = (np.concatenate(c) for c in zip(*sides))
    other = one != two
    one, two, value = one[other], two[other], value[other]
    return pa.table({"lang": pa.array([lang] * len(one), pa.string()), "source": pa.array(one, pa.string()), "item": pa.array(two, pa.string()), "value": pa.array(value, pa.int64())})


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """Divergence of each source from each other source of its language, and the terms that mark it.

    `lang, source, part, item, value, rank`: part `pair` has all other sources of the language, part
    `term` the first `top` kept terms above their share in the language.  Null text, lang and source
    count as empty strings; repeated rows are documents of their own; a group without terms has pairs
    (value 0 where its language keeps no term); a language's only source has none; an empty table
    gives no row; other columns, ids included, are ignored.
    """
    audit = Audit(docs, min_docs)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = audit.pairs().withColumn("part", F.lit("pair")).select(*columns)
    return pairs.unionByName(audit.top_terms(top).withColumn("part", F.lit("term")).select(*columns))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir))


ORACLE = r"""
with docs as (
  select row_number() over () as doc, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source
  from documents
), words as (
  select lang, source, doc,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from docs
), kept as (
  select lang, term, count(*) as all_n from words group by all having count(distinct doc) >= 3
), langs as (
  select lang, count(*) as v, sum(all_n) as all_total from kept group by lang
), counts as (
  select w.lang, w.source, w.term, count(*) as n from words w join kept using (lang, term) group by all
), totals as (
  select lang, source, sum(n) as total from counts group by all
), found as (
  select distinct d.lang, d.source, coalesce(t.total, 0) as total, coalesce(l.v, 0) as v, l.all_total
  from docs d left join totals t using (lang, source) left join langs l on l.lang = d.lang
), shares as (
  select g.lang, g.source, k.term,
         1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (g.total + g.v)::hugeint as p,
         1 + (1000000000::hugeint * (k.all_n + 1)) // (g.all_total + g.v)::hugeint as base, coalesce(c.n, 0) as n
  from found g join kept k using (lang) left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term
), sums as (
  select x.lang, x.source, y.source as item, sum((x.p - y.p) * (x.p - y.p) // y.p) as value
  from shares x join shares y on x.lang = y.lang and x.term = y.term and x.source <> y.source
  group by all
), pairs as (
  select x.lang, x.source, y.source as item, coalesce(s.value, 0) as value
  from found x join found y on x.lang = y.lang and x.source <> y.source
  left join sums s on s.lang = x.lang and s.source = x.source and s.item = y.source
), terms as (
  select lang, source, term as item, (p - base) * (p - base) // base as value from shares where n > 0 and p > base
), ranked as (
  select lang, source, 'pair' as part, item, value,
         row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all
  select lang, source, 'term', item, value,
         row_number() over (partition by lang, source order by value desc, item) from terms
)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank
from ranked where part = 'pair' or rank <= 200
"""

QUERIES = {"op13_source_divergence": op13_source_divergence}
ORACLES = {"op13_source_divergence": ORACLE}
