"""Model and cluster quality measures."""

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterwise.operators.quantiles import running_totals, value_counts
from meterwise.session import settle


def regression_metrics(df: DataFrame, y: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """(rows, mae, rmse, r2) in one aggregation."""
    error = F.col(y) - F.col(pred)
    sums = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.var_pop(y).alias("spread"),
    )
    return sums.select(
        "rows",
        "mae",
        F.sqrt("mse").alias("rmse"),
        (1.0 - F.try_divide("mse", "spread")).alias("r2"),
    )


def label_metrics(df: DataFrame, y: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """(accuracy, precision, recall, f1); a ratio without denominator counts as 0."""
    truth, guess = F.col(y) == 1, F.col(pred) == 1
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(truth & guess).alias("tp"),
        F.count_if(~truth & guess).alias("fp"),
        F.count_if(truth & ~guess).alias("fn"),
    )

    def ratio(num, den):
        return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        ratio(F.col("rows") - fp - fn, F.col("rows")).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def ranking_metrics(df: DataFrame, y: str = "y_true", score: str = "y_prob") -> DataFrame:
    """(roc_auc, avg_precision) over distinct scores; both null where they are undefined.

    The area is the rank-sum statistic with ties counted half. Average precision adds, from the
    highest score down, the recall gained at each distinct score times the precision there.
    """
    counts = settle(
        value_counts(
            df.select(F.col(score).cast("double").alias("s"), F.col(y).cast("bigint").alias("t")),
            [],
            "s",
            {"n": F.count(F.lit(1)), "pos": F.sum("t")},
        )
    )
    ranked = running_totals(counts, [], "s", ["n", "pos"])
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    neg_before = F.col("n_before") - F.col("pos_before")
    at_least = F.col("pos_total") - F.col("pos_before")
    rows_at_least = F.col("n_total") - F.col("n_before")
    sums = ranked.agg(
        F.max("n_total").alias("n"),
        F.max("pos_total").alias("p"),
        F.sum(pos * (neg_before + neg / 2.0)).alias("wins"),
        F.sum(pos * at_least / rows_at_least).alias("gain"),
    )
    negatives = F.col("n") - F.col("p")
    return sums.select(
        F.try_divide(F.col("wins"), F.col("p") * negatives).alias("roc_auc"),
        F.try_divide("gain", "p").alias("avg_precision"),
    )


def classification_metrics(
    df: DataFrame, y: str = "y_true", pred: str = "y_pred", score: str = "y_prob"
) -> DataFrame:
    """All label and ranking metrics as one row."""
    ranks = ranking_metrics(df, y, score).select(F.struct("*"))
    labels = label_metrics(df, y, pred)
    return labels.withColumn("ranks", ranks.scalar()).select("ranks.*", *labels.columns)


def tip_share(df: DataFrame, by: Sequence[str], y: str = "y") -> DataFrame:
    """Percent of rows with a positive target per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        (F.avg((F.col(y) > 0).cast("int")) * 100.0).alias("tip_share_pct"),
    )


def calinski_harabasz(
    df: DataFrame, features: Sequence[str], label: str = "cluster", by: Sequence[str] = ()
) -> DataFrame:
    """(by..., clusters, rows, inertia, calinski_harabasz) from per-cluster means and variances."""
    per_cluster = df.groupBy(*by, label).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in features],
        *[F.var_pop(c).alias(f"v_{c}") for c in features],
    )
    # One row per cluster from here on.
    whole = Window.partitionBy(*by)
    n = F.col("n")

    def between(c):
        centre = F.sum(n * F.col(f"m_{c}")).over(whole) / F.sum(n).over(whole)
        return n * (F.col(f"m_{c}") - centre) * (F.col(f"m_{c}") - centre)

    def add(parts):
        return reduce(lambda a, b: a + b, parts)

    parts = per_cluster.select(
        *by,
        "n",
        add([between(c) for c in features]).alias("between"),
        add([n * F.col(f"v_{c}") for c in features]).alias("within"),
    )
    totals = parts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("clusters"),
        F.sum("n").alias("rows"),
        F.sum("between").alias("between"),
        F.sum("within").alias("inertia"),
        (F.min("n") / F.sum("n") * 100.0).alias("min_cluster_pct"),
        (F.max("n") / F.sum("n") * 100.0).alias("max_cluster_pct"),
    )
    spread = F.col("between") / (F.col("clusters") - 1)
    score = F.try_divide(spread * (F.col("rows") - F.col("clusters")), F.col("inertia"))
    return totals.select(
        *by,
        "clusters",
        "rows",
        "inertia",
        F.when((F.col("rows") >= 3) & (F.col("clusters") > 1), score).alias("calinski_harabasz"),
        "min_cluster_pct",
        "max_cluster_pct",
    )


def silhouettes(df: DataFrame, features: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """(labelling, silhouette): mean silhouette of one or many label columns over all rows.

    Distances are squared Euclidean. The mean squared distance from a row to a cluster then
    follows from the cluster's size, mean and mean squared length, so one aggregation over the
    labels and one scan replace all pairs. A row alone in its cluster scores 0. Null below three
    rows or with a single cluster. The per-cluster table has one row per label, which the k of a
    grid bounds; it becomes part of the plan.
    """
    spark = df.sparkSession
    norm = reduce(lambda a, b: a + b, [F.col(c) * F.col(c) for c in features])
    long = df.select(
        *features,
        F.inline(
            F.array(*[F.struct(F.lit(n).alias("labelling"), F.col(n).alias("part")) for n in labels])
        ),
    )
    parts = (
        long.groupBy("labelling", "part")
        .agg(F.count("*").alias("n"), F.avg(norm).alias("length"), *[F.avg(c).alias(f"m_{c}") for c in features])
        .collect()
    )
    scores = {}
    for name in labels:
        mine = [p for p in parts if p["labelling"] == name]
        if len(mine) < 2 or sum(p["n"] for p in mine) < 3:
            continue
        own, other = F.lit(None).cast("double"), []
        for p in mine:
            dot = reduce(lambda a, b: a + b, [F.col(c) * F.lit(p[f"m_{c}"]) for c in features])
            far = F.greatest(F.col("_norm") - F.lit(2.0) * dot + F.lit(p["length"]), F.lit(0.0))
            inside = F.col(name).eqNullSafe(F.lit(p["part"]))
            # The row itself lies at distance 0: the sum is shared by the n - 1 others.
            alone = F.lit(p["n"] / (p["n"] - 1.0)) * far if p["n"] > 1 else F.lit(-1.0)
            own = F.when(inside, alone).otherwise(own)
            other.append(F.when(~inside, far))
        nearest = F.least(*other)
        top = F.greatest(own, nearest)
        scores[name] = F.avg(F.when((own < 0) | (top <= 0), 0.0).otherwise((nearest - own) / top))
    if scores:
        row = df.withColumn("_norm", norm).agg(*[c.alias(n) for n, c in scores.items()]).first().asDict()
    else:
        row = {}
    return spark.createDataFrame([(n, row.get(n)) for n in labels], "labelling string, silhouette double")


#: Rows of the sample on which the Euclidean silhouette is taken.
SILHOUETTE_ROWS = 100_000
#: Rows of a block, which every task meets at a time, the rows of a task, and how many rows are compared at once.
_BLOCK_ROWS = 262_144
_ASKING_ROWS = 2048
_TASKS = 1024
_PART = (16, 1024)


def euclidean_silhouettes(df: DataFrame, features: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """(labelling, silhouette): mean Euclidean silhouette of one or many label columns.

    Sums of distances have no closed form, so all pairs of rows count: pass a sample where the
    square of the rows is too much. All rows are broadcast in blocks of ``_BLOCK_ROWS``, one at a time
    through the driver; a task holds one of them, and for each of its own rows the sums of its distances
    to the clusters of all labellings. It returns sums of scores only. Blocks are ordered by their clusters in all
    labellings, so a distance is added up once for all of them, and compared in parts that stay in
    the processor's cache. A row alone in its cluster scores 0. Null below three
    rows or with a single cluster. Rows need their labels; labels are whole numbers.
    """
    spark = df.sparkSession
    out = "labelling string, silhouette double"
    sizes = {name: {} for name in labels}
    parts = df.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("labelling"), F.col(n).cast("long").alias("part")) for n in labels
    ])))
    for r in parts.groupBy("labelling", "part").count().collect():
        sizes[r["labelling"]][r["part"]] = r["count"]
    total = max((sum(s.values()) for s in sizes.values()), default=0)
    used = [n for n in labels if len(sizes[n]) > 1 and total >= 3]
    if not used:
        return spark.createDataFrame([(n, None) for n in labels], out)
    # One cell per cluster of every labelling, side by side.
    order = {n: sorted(sizes[n]) for n in used}
    first = dict(zip(used, np.cumsum([0] + [len(order[n]) for n in used[:-1]]).tolist(), strict=True))
    cells = sum(len(order[n]) for n in used)
    chunks = math.ceil(total / _BLOCK_ROWS)
    number = lambda n: F.array_position(F.array(*[F.lit(p) for p in order[n]]), F.col(n).cast("long")) - 1
    rows = settle(df.select(
        F.array(*[F.col(c).cast("double") for c in features]).alias("x"),
        F.array(*[(number(n) + first[n]).cast("int") for n in used]).alias("cell"),
    ).withColumn("chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).cast("int")))

    def opened(table) -> tuple[np.ndarray, np.ndarray]:
        columns = [table.column(c) for c in ("x", "cell")]
        if isinstance(table, pa.Table):
            columns = [c.combine_chunks() for c in columns]
        x, cell = (c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) for c in columns)
        return x, cell

    def share(chunk: int):
        x, cell = opened(rows.where(F.col("chunk") == chunk).select("x", "cell").toArrow())
        by = np.lexsort(cell.T)
        return spark.sparkContext.broadcast((np.ascontiguousarray(x[by].T), cell[by]))

    shared = [share(c) for c in range(chunks)]

    def met(a: np.ndarray, x: np.ndarray, cell: np.ndarray, sums: np.ndarray) -> None:
        """Add the distances of rows ``a`` to rows ``x`` (feature by row) to the sums of their cells."""
        high, wide = _PART
        held = np.empty((2, high, wide))
        for left in range(0, x.shape[1], wide):
            part, mine = x[:, None, left : left + wide], cell[left : left + wide]
            starts = np.flatnonzero(np.r_[True, (mine[1:] != mine[:-1]).any(axis=1)])
            member = np.zeros((len(starts), cells))
            for column in mine[starts].T:
                member[np.arange(len(starts)), column] = 1
            for top in range(0, len(a), high):
                some = a[top : top + high].T[:, :, None]
                far, gap = held[:, : some.shape[1], : part.shape[2]]
                far[:] = 0
                # Differences per feature keep the distance of a row to its copies at exactly 0.
                for f in range(len(x)):
                    np.subtract(some[f], part[f], out=gap)
                    np.square(gap, out=gap)
                    far += gap
                sums[top : top + high] += np.add.reduceat(np.sqrt(far, out=far), starts, axis=1) @ member

    counts = np.zeros(cells)
    for name in used:
        for k, part in enumerate(order[name]):
            counts[first[name] + k] = sizes[name][part]

    def run(batches):
        found = np.zeros(len(used))
        for batch in batches:
            a, cell = opened(batch)
            sums = np.zeros((len(a), cells))
            for chunk in shared:
                met(a, *chunk.value, sums)
            for at, name in enumerate(used):
                low, high = first[name], first[name] + len(order[name])
                each, mine = np.arange(len(a)), cell[:, at] - low
                mean = sums[:, low:high] / counts[low:high]
                n = counts[low:high][mine]
                own = sums[:, low:high][each, mine] / np.maximum(n - 1, 1)
                mean[each, mine] = np.inf
                nearest = mean.min(axis=1)
                top = np.maximum(own, nearest)
                found[at] += np.where((n > 1) & (top > 0), (nearest - own) / np.where(top > 0, top, 1), 0).sum()
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(found)], ["labelling", "score"])

    # Few bytes cost much work here: their number, not their size, says how many tasks there are.
    tasks = rows.select("x", "cell").repartition(min(math.ceil(total / _ASKING_ROWS), _TASKS))
    added = tasks.mapInArrow(run, "labelling string, score double").groupBy("labelling").agg(F.sum("score").alias("score"))
    row = {r["labelling"]: r["score"] / total for r in added.collect()}
    for chunk in shared:
        chunk.destroy()
    return spark.createDataFrame([(n, row.get(n)) for n in labels], out)
