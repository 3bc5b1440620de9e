"""Mixing sources to target weights by systematic sampling (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskspan.llm.columns import apart
from taskspan.llm.ordering import ranked
from taskspan.sources.stage import stage

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3.0
WORD = r"[^\x20\x09-\x0D]+"
_OFFSET_BITS = 20


def words(text: str) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def offset(seed: int, *columns: str) -> Column:
    """A number in [0, 1) fixed by the seed and the values; a multiple of 2^-20, so sums are exact."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c), F.lit("")) for c in columns))
    bits = F.conv(F.substring(F.md5(text), 1, _OFFSET_BITS // 4), 16, 10).cast("double")
    return bits / F.lit(float(1 << _OFFSET_BITS))


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS,
                   most: float = MOST_COPIES, share: float = 1.0) -> DataFrame:
    """Target size of every source, from a stored table (source, n_docs, source_size).

    Sources in code point order, null last, take the weights in turn and share `share` of all words.
    No target exceeds `most` times its source's size; what is over goes to the others by weight. The
    loop finds the level, target per unit of weight, at which no other source is above its limit: it
    only rises, and one sum per step suffices. A corpus without words has targets of 0.
    """
    order = ranked(sources, [F.col("source").isNull(), F.col("source")], name="place")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)),
                          (F.col("place") % len(weights) + 1).cast("int"))
    weighed = stage(order.withColumn("weight", weight), "weighed_sources")
    limit = F.col("source_size") * F.lit(float(most))
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    level, held = 0.0, -1
    while True:
        full = limit / F.col("weight") <= F.lit(level)
        row = weighed.agg(
            F.count_if(full), F.sum(F.when(full, F.col("source_size"))),
            F.sum(F.when(~full, F.col("weight")))).first()
        if row[0] == held or not row[2]:
            break
        held = row[0]
        level = (total - most * (row[1] or 0)) / row[2]
    return weighed.withColumn("target", F.least(limit, F.lit(level) * F.col("weight")))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES,
        share: float = 1.0, seed: int = 17) -> DataFrame:
    """One row per row of `docs`: doc_id, source, size, source_size, target, copies, taken.

    Within a source every document is expected target / source_size times. Documents stand in order
    of falling size; each one's prefix sum of expected copies, plus one offset per source, is cut at
    the whole numbers, and the document is taken once per whole number it crosses. So it comes
    floor or ceil of the expected copies times, and as neighbours are of like size, the words taken
    differ from the target by less than the largest document. Documents of equal size stand in the
    order of a hash. The same rows give the same mix.

    Null text or a text without words: size 0. Null source: a source of its own, last. Repeated rows
    are documents of their own. An empty table gives an empty mix. Extra columns are left out.
    """
    narrow = stage(docs.select(
        F.col("doc_id"), F.col("source"), words("text").alias("size"),
        F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
              ).alias("tie")), "sizes")
    sources = stage(narrow.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size")), "sources")
    targets = source_targets(sources, weights, most, share).select(
        F.col("source").alias("_source"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
        .alias("_each"), offset(seed, "source").alias("_offset"))
    order = [F.col("size").desc(), F.col("tie"), F.col("doc_id")]
    rows = ranked(narrow, order, within=["source"], name="_k").join(
        targets, F.col("source").eqNullSafe(F.col("_source")))
    crossed = F.floor((F.col("_k") + 1) * F.col("_each") + F.col("_offset")) - F.floor(
        F.col("_k") * F.col("_each") + F.col("_offset"))
    copies = F.least(crossed.cast("long"), F.ceil("_each").cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target",
                       copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each row of `docs` as often as `mix` takes it, with all its columns.

    The plan is joined back on (doc_id, source, size), nulls included. Rows that agree in all three
    take an even share of their copies each; what the share leaves over goes to rows drawn by a hash
    of their place in the table, so only the total of such rows is near and not equal to the plan's.
    """
    plan = mix(docs, **settings).groupBy("doc_id", "source", "size").agg(
        F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")
    ).filter("_copies > 0").withColumnsRenamed(
        {"doc_id": "_doc_id", "source": "_source", "size": "_size"})
    rows = apart(docs, "doc_id", "source", "text")
    placed = rows.withColumns({"_words": words("text"), "_row": F.monotonically_increasing_id()})
    joined = placed.join(plan, F.col("doc_id").eqNullSafe(F.col("_doc_id"))
                       & F.col("source").eqNullSafe(F.col("_source"))
                       & (F.col("_words") == F.col("_size")))
    drawn = F.pmod(F.xxhash64("_row"), F.col("_rows")) < F.col("_copies") % F.col("_rows")
    copies = F.floor(F.col("_copies") / F.col("_rows")) + drawn.cast("long")
    every = F.explode(F.array_repeat(F.lit(0), copies.cast("int")))
    return joined.withColumn("_every", every).select(*rows.columns).toDF(*docs.columns)
