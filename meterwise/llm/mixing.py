"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterwise.llm.storage import hand_over

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 7
_BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of words, cut at space and 0x09-0x0D; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add exclusive running sums over ``order`` without bringing all rows to one task.

    Rows are range-partitioned and written once, so the partitions stay as they are; each
    partition's total is shifted by those before it (one row per partition).
    """
    ranged = hand_over(
        df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranged"
    )
    totals = ranged.groupBy("__range").agg(*[F.sum(c).alias(f"__{k}") for k, c in sums.items()])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "__range", *[F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__{k}") for k in sums]
    )
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.join(starts, "__range")
        .withColumns({k: F.col(f"__{k}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for k, c in sums.items()})
        .drop("__range", *[f"__{k}" for k in sums])
    )


def targets(sizes: DataFrame, source: str, size: str, weights: tuple[int, ...] = WEIGHTS,
            max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, size)``, one row per source, with its ``target``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the sum of all
    sizes; a target stops at ``max_epochs`` times its source's size and the excess is shared
    again by weight. That settles where target = min(max_epochs * size, level * weight) for one
    level. With sources in the order of the level at which they fill up, the level follows from
    two running sums: the first source that does not fill up at its own candidate level sets it.
    """
    ranked = running(
        sizes.select(F.col(source).alias("source"), F.col(size).alias("size")),
        [F.col("source").isNull(), F.col("source")],
        {"place": F.lit(1)},
    )
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    weighed = ranked.select(
        "source", "size", weight.alias("weight"), (F.col("size") * max_epochs).alias("full")
    )
    weighed = hand_over(weighed.withColumn("fills", F.col("full") / F.col("weight")), "weights")
    total, all_weight = weighed.agg(
        F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))
    ).first()
    levels = running(
        weighed,
        [F.col("fills"), F.col("source").isNull(), F.col("source")],
        {"full_before": F.col("full"), "weight_before": F.col("weight")},
    ).withColumn(
        "level",
        (F.lit(total) - F.col("full_before")).cast("double") / (F.lit(all_weight) - F.col("weight_before")),
    )
    level = levels.where("fills >= level").agg(F.min_by("level", F.struct("fills", "level"))).first()[0]
    share = F.lit(float(level or 0.0)) * F.col("weight")
    return weighed.select(
        F.col("source").alias(source), F.col("size").alias(size), F.least(F.col("full").cast("double"), share).alias("target")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
        whole: bool = False) -> DataFrame:
    """``docs`` with ``__size``, ``__source_size``, ``__target``, ``__epochs`` and ``__taken``.

    Every document of a source is taken ``floor(target / size of the source)`` times; the rest
    of the source's budget (whole words of its target) goes to documents in the order of a hash
    of seed, id and text. The document that reaches the budget is cut at exactly that word, or,
    with ``whole``, taken once more if at least half of it lies inside. ``__epochs`` counts whole
    copies, ``__taken`` all words.

    Null texts have no words and are taken no words. A null source is a source of its own, last.
    Equal hashes are ordered by id and size; rows equal in all of them are interchangeable, and
    repeated rows are documents of their own. Other columns ride along; names that begin with
    two underscores are the operator's own. An empty table gives an empty one.

    The order is sorted in pieces: a source is cut into 4096 ranges of the hash, ranges are
    sorted apart, and their totals (a small table) shift the sums inside them. A source that
    holds a third of all rows is spread over its ranges like any other.
    """
    source = F.col(source_col)
    rows = docs.withColumns(
        {
            "__size": word_count(F.col(text_col)),
            "__order": F.md5(
                F.concat_ws(
                    ":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                    F.md5(F.coalesce(F.col(text_col), F.lit(""))),
                )
            ),
            # A key that is never null: joins and windows then share one partitioning.
            "__source": F.coalesce(F.concat(F.lit("="), source), F.lit("-")),
        }
    ).withColumn("__bucket", F.substring("__order", 1, _BUCKET_DIGITS))
    parts = hand_over(
        rows.groupBy("__source", source.alias("source"), "__bucket").agg(F.sum("__size").alias("__part")), "parts"
    )
    sized = parts.groupBy("__source", "source").agg(F.sum("__part").alias("size"))
    aimed = targets(sized.select("source", "size"), "source", "size", weights, max_epochs).select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("__source"),
        F.col("size").alias("__source_size"),
        F.col("target").alias("__target"),
    )
    before = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        "__source", "__bucket", F.coalesce(F.sum("__part").over(before), F.lit(0)).alias("__start")
    ).join(aimed, "__source")
    starts = hand_over(starts, "starts")
    placed = rows.join(starts, ["__source", "__bucket"])
    inside = (
        Window.partitionBy("__source", "__bucket")
        .orderBy("__order", F.col(id_col), "__size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    epochs = F.when(
        F.col("__source_size") > 0, F.floor(F.floor("__target") / F.col("__source_size"))
    ).otherwise(0).cast("long")
    placed = placed.withColumns(
        {
            "__before": F.col("__start") + F.coalesce(F.sum("__size").over(inside), F.lit(0)),
            "__epochs": epochs,
            "__rest": F.floor("__target").cast("long") - epochs * F.col("__source_size"),
        }
    )
    room = F.col("__rest") - F.col("__before")
    if whole:
        more = (F.col("__size") > 0) & (room * 2 >= F.col("__size"))
        placed = placed.withColumn("__epochs", F.col("__epochs") + more.cast("long"))
        taken = F.col("__epochs") * F.col("__size")
    else:
        taken = F.col("__epochs") * F.col("__size") + F.greatest(F.lit(0), F.least(F.col("__size"), room))
    return placed.withColumn("__taken", taken).select(
        *[F.col(f"`{c}`") for c in docs.columns],
        "__size", "__source_size", "__target", "__epochs", "__taken",
    )


def materialise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", **options) -> DataFrame:
    """The mixture itself: whole documents, each as often as it is taken, columns unchanged.

    Documents without words cost nothing and stay as they are, once.
    """
    mixed = mix(docs, id_col, text_col, source_col, whole=True, **options)
    copies = F.when(F.col("__size") == 0, 1).otherwise(F.col("__epochs")).cast("int")
    repeated = mixed.where(copies > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), copies)))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
