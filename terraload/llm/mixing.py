"""Mix sources to target weights: how often, or how far, each document enters the mix.

Every document gets a hash-random key. Rows are range-sorted by source and key, so a large source
is spread over many partitions. Prefix sums of sizes are distributed: each task sums within its
partition, and the sums of the partitions before it (a row for each partition and source) are
added. A source's budget is whole epochs of all its documents and one part of an epoch, which
is cut at the exact word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from terraload.llm.scratch import Scratch, bounded_batches
from terraload.operators.ordering import number_rows

SEED = "mix"
SHARE = 1.5
MOST_EPOCHS = 2
WEIGHTS = (3, 1, 2)
SIZE_PATTERN = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SIZE_PATTERN)), F.lit(0)).cast("long")


def targets(sources: DataFrame, budget: float, most_epochs: int) -> DataFrame:
    """Add ``target`` to ``source_size, weight``: shares of ``budget`` by weight, none above
    ``most_epochs`` times its source.

    What a source can't take is shared again by weight among the others until none is above. Each
    round is one aggregate; only its two sums reach the driver.
    """
    cap = F.lit(most_epochs) * F.col("source_size")
    price = -1.0
    while True:
        full = cap <= F.lit(price) * F.col("weight")
        row = sources.agg(F.sum(F.when(full, cap)).alias("taken"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        higher = (budget - (row["taken"] or 0)) / row["open"]
        if higher <= price:
            break
        price = higher
    capped = F.when(cap <= F.lit(price) * F.col("weight"), cap.cast("double")).otherwise(F.lit(price) * F.col("weight"))
    return sources.withColumn("target", capped)


def _prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the source before each row, within this partition of rows sorted by source."""
    part = TaskContext.get().partitionId()
    rank, held = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ranks, sizes = (batch.column(c).to_numpy() for c in ("rank", "size"))
        ends = np.cumsum(sizes)
        new = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
        base = np.repeat((ends - sizes)[new], np.diff(np.append(new, len(ranks))))
        before = ends - sizes - base
        if ranks[0] == rank:
            before[:new[1] if len(new) > 1 else len(ranks)] += held
        rank, held = ranks[-1], int(before[-1] + sizes[-1])
        columns = [*batch.columns, pa.array(np.full(len(ranks), part, np.int64)), pa.array(before)]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "before"])


def _key(seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))))


def _placed(docs: DataFrame, weights: Sequence[float], share: float, most_epochs: int, seed: str,
            scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Each row's size and the words of its source before it, and each source's target, whole epochs and rest."""
    spark = docs.sparkSession
    bounded_batches(spark)
    sized = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size")), "sized")
    totals = scratch.keep(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "totals")
    ordered = number_rows(totals.withColumn("nulls", F.col("source").isNull().cast("int")), ["nulls", "source"], "rank", start=-1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    ordered = scratch.keep(ordered.select("source", "source_size", F.col("rank").cast("long").alias("rank"), weight.alias("weight")), "sources")
    everything = ordered.agg(F.sum("source_size")).first()[0] or 0
    budget = F.round("target").cast("long")
    goals = targets(ordered, share * everything, most_epochs)
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)))
    goals = scratch.keep(goals.withColumn("rest", budget - F.col("epochs") * F.col("source_size")), "goals")

    keyed = (sized.join(goals.select("source", "rank"), sized["source"].eqNullSafe(goals["source"]))
             .select("doc_id", "size", "rank", _key(seed).alias("key")))
    order = ["rank", "key", "doc_id", "size"]
    ranged = (keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "size", "rank")
              .mapInArrow(_prefix, "doc_id long, size long, rank long, part long, before long"))
    ranged = scratch.keep(ranged, "ranged")
    parts = ranged.groupBy("rank", "part").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = scratch.keep(parts.withColumn("earlier", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words"), "parts")
    placed = ranged.join(parts, ["rank", "part"]).select("doc_id", "size", "rank", (F.col("before") + F.col("earlier")).alias("before"))
    scratch.drop(sized, totals, ordered)
    return placed, goals


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most_epochs: int = MOST_EPOCHS,
        seed: str = SEED, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for each row of ``docs`` (``doc_id, text, source``).

    Sources in code point order, null last, weigh ``weights`` in turn, and share ``share`` times all
    words. ``taken`` counts the words that enter the mix, repeats included; a source's taken words
    are its target rounded to a whole word. A null or empty text has size 0 and takes 0. The same
    rows give the same mix; rows that share a ``doc_id`` are ordered by size, and equal rows take
    what falls to either. Other columns are ignored. An empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    placed, goals = _placed(docs, weights, share, most_epochs, seed, scratch)
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return placed.join(goals, "rank").select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + cut).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most_epochs: int = MOST_EPOCHS,
                    seed: str = SEED, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, as often as the mix takes them; the one at a source's cut ends at the cut's word.

    Texts do not move: a source's epochs and the place of its cut (one row for each source) say what
    becomes of each row. Rows that repeat the one at the cut wholly are all cut there. ``n_chars`` of a shortened
    text is its new length. Rows without words stay, once for each whole epoch.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    placed, goals = _placed(docs, weights, share, most_epochs, seed, scratch)
    at_cut = placed.join(goals, "rank").where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") >= F.col("rest")))
    cuts = at_cut.groupBy("rank").agg(F.min(F.struct(_key(seed).alias("key"), F.col("doc_id").alias("id"), "size")).alias("_cut"),
                                      F.max(F.col("rest") - F.col("before")).alias("_part"))
    rules = goals.join(cuts, "rank", "left").select(F.col("source").alias("_source"), F.col("epochs").cast("int").alias("_epochs"), "_cut", "_part")
    rules = scratch.keep(rules, "rules")
    rows = docs.join(rules, docs["source"].eqNullSafe(rules["_source"])).withColumn("_size", word_count(F.col("text")))
    place = F.struct(_key(seed).alias("key"), F.col("doc_id").cast("long").alias("id"), F.col("_size").alias("size"))
    extra = F.when(place < F.col("_cut"), F.col("_size")).when(place == F.col("_cut"), F.col("_part")).otherwise(F.lit(0))
    copies = F.concat(F.array_repeat("_size", F.col("_epochs")), F.filter(F.array(extra), lambda n: n > 0))
    rows = rows.withColumn("_words", F.explode(copies))
    short = F.col("_words") < F.col("_size")
    shortened = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(SIZE_PATTERN), F.lit(0)), F.lit(1), F.col("_words").cast("int")), " ")
    rows = rows.withColumn("text", F.when(short, shortened).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(short, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    scratch.drop(goals)
    return rows.select(*docs.columns)
