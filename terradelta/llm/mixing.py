"""Mixing sources to target weights: hash-random keys, range-sort per source, prefix sums, a cut at the exact budget.

Each source's documents are put in the order of a key drawn by hashing the id, cut into key ranges of about
``RANGE_ROWS`` documents (keys are uniform, so ranges are even however hot the source is), sorted and summed within a
range, and the ranges' totals are summed along each source. A source with target T and S words is taken floor(T / S)
times in full and its next T - S * floor(T / S) words in key order once more; the document the cut falls into gives
the words that still fit.

Defined cases: a null text has size 0; a null source is a source of its own, ordered last; a null id hashes as the
empty text; repeated rows are documents of their own; an empty table gives an empty result; a corpus without words has
targets of 0. Only id, text and source are read, other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terradelta.llm.common import prefix_ranks, stored, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
RANGE_ROWS = 4096
SEED = "mix"
KEY_SPACE = 1 << 60


def mix_key(doc_id: Column, seed: str = SEED) -> Column:
    """The first 60 bits of md5(seed:id)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, key of every document, stored."""
    df = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), mix_key(F.col("doc_id"), seed).alias("key"))
    return stored(df, "mix-sized")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, n_docs, source_size, target: ``share`` of all words by weight, a target capped at ``epochs`` sources.

    The level (words per unit of weight) rises until the capped targets and the rest add up; every step is one
    aggregate over the sources' rows.
    """
    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    per = prefix_ranks(per.withColumn("_last", F.col("source").isNull()), ["_last", "source"], "mix-sources").drop("_last")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = stored(per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(epochs)), "mix-weights")
    total, all_weight = per.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = min(share, epochs) * float(total or 0)
    level = budget / all_weight if all_weight else 0.0
    while True:
        full = F.col("cap") <= F.col("weight") * level
        capped, rest = per.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        higher = (budget - (capped or 0.0)) / rest if rest else level
        if not rest or higher <= level * (1 + 1e-12):
            break
        level = higher
    return stored(per.select("source", "n_docs", "source_size", F.least("cap", F.col("weight") * level).alias("target")), "mix-targets")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, key, size, source_size, target and ``taken``: the words the mix takes of each document."""
    sizes = sized(docs, seed)
    targets = source_targets(sizes, weights, share, epochs)
    same = sizes["source"].eqNullSafe(targets["source"])
    rows = sizes.join(targets, same).drop(targets["source"])
    ranges = F.ceil(F.col("n_docs") / RANGE_ROWS)
    rows = rows.withColumn("range", F.floor(F.col("key") / float(KEY_SPACE) * ranges).cast("long"))
    order = W.partitionBy("source", "range").orderBy("key", "doc_id", "size")
    rows = rows.withColumn("before", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    totals = rows.groupBy("source", "range").agg(F.sum("size").alias("_sum"))
    starts = totals.select(F.col("source").alias("_source"), F.col("range").alias("_range"),
                           (F.sum("_sum").over(W.partitionBy("source").orderBy("range")) - F.col("_sum")).alias("_start"))
    rows = rows.join(starts, rows["source"].eqNullSafe(starts["_source"]) & (rows["range"] == starts["_range"]))
    words = F.floor("target").cast("long")
    times = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    left = words - times * F.col("source_size") - F.col("_start") - F.col("before")
    taken = times * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least("size", left))
    return rows.select("doc_id", "source", "key", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents themselves, as often as the mix takes them; the document a cut falls into is taken whole.

    The decision reaches the texts as one key per source (the key of the last document taken in its last epoch), so
    texts are not shuffled by id. Documents without a word are not taken.
    """
    plan = stored(mix(docs, **how), "mix-plan")
    times = F.floor(F.floor("target") / F.greatest("source_size", F.lit(1)))
    cuts = plan.withColumn("times", times.cast("int")).groupBy("source", "times").agg(
        F.max(F.when(F.col("taken") > F.col("times") * F.col("size"), F.col("key"))).alias("_mix_cut"))
    cuts = stored(cuts.select(F.col("source").alias("_mix_source"), F.col("times").alias("_mix_times"), "_mix_cut"), "mix-cuts")
    key = mix_key(F.col("doc_id"), how.get("seed", SEED))
    copies = F.col("_mix_times") + F.when(key <= F.col("_mix_cut"), 1).otherwise(0)
    kept = docs.join(cuts, docs["source"].eqNullSafe(cuts["_mix_source"])).where(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))
    return kept.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*docs.columns)
