"""Segment queries. Those with SQL use a deterministic label: the distance band of the trip."""

from pyspark.sql import functions as F

from meterwise import constants as C
from meterwise.catalog import query
from meterwise.catalog import sqltext as S
from meterwise.catalog.common import _declared_once, clean
from meterwise.catalog.features import SAMPLE, segment_rows
from meterwise.catalog.profiling import union
from meterwise.catalog.sampling import hashed
from meterwise.catalog.zones import rounded
from meterwise.operators import metrics, outliers, sampling
from meterwise.operators import segments as ops
from meterwise.plans import segmentation as plan

KEY = "trip_key"
BEHAVIOR = C.BEHAVIOR_COLUMNS
DESCRIBED = ["hour_Daytime", "hour_Nightlife", "day_Friday", "month_July", "weekend", "night_trip"]

_BAND = """CASE WHEN s.trip_distance < 2 THEN 0 WHEN s.trip_distance < 5 THEN 1
WHEN s.trip_distance < 10 THEN 2 ELSE 3 END"""


LABELLED = SAMPLE + f""",
labelled AS (
  SELECT CAST({_BAND} AS INT) AS cluster, s.trip_key, s.fare_amount, s.tolls_amount,
    CAST(s.passenger_count AS DOUBLE) AS passenger_count, s.trip_distance, s.duration_min,
    s.speed_mph, s.tip_rate * 100 AS tip_rate_pct,
    CAST(s.is_airport_trip AS DOUBLE) AS is_airport_trip_num, s.weekend, s.night_trip,
    s.is_airport_trip,
    CAST(hour_bin = 'Daytime' AS INT) AS "hour_Daytime",
    CAST(hour_bin = 'Nightlife' AS INT) AS "hour_Nightlife",
    CAST(dow_name = 'Friday' AS INT) AS "day_Friday",
    CAST(month_cat = 'July' AS INT) AS "month_July", s.pickup_borough,
    coalesce(c.pickup_zone_name, 'Unknown') AS pickup_zone_name,
    coalesce(c.dropoff_borough, 'Unknown') AS dropoff_borough,
    coalesce(c.dropoff_zone_name, 'Unknown') AS dropoff_zone_name, c.year
  FROM sample s JOIN clean c USING (trip_key)
)"""


def band(df):
    miles = F.col("trip_distance")
    label = F.when(miles < 2, 0).when(miles < 5, 1).when(miles < 10, 2).otherwise(3)
    return df.withColumn("cluster", label.cast("int"))


@_declared_once
def labelled(spark, sf):
    return band(segment_rows(spark, sf))


MEANS = LABELLED + """,
means AS (SELECT cluster, count(*) AS n, """ + ", ".join(
    f"round_even(avg({c}), 4) AS {c}" for c in BEHAVIOR) + """ FROM labelled GROUP BY cluster),
sizes AS (SELECT cluster, n AS n_rows, n / sum(n) OVER () * 100 AS pct_rows FROM means)"""


@query(
    "d28_cluster_sizes",
    S.from_clean("SELECT cluster, n_rows, round(pct_rows, 6) AS pct_rows FROM sizes", MEANS),
)
def cluster_sizes(spark, sf):
    return rounded(ops.cluster_sizes(labelled(spark, sf)), "pct_rows")


@query("d29_cluster_means", S.from_clean("SELECT * EXCLUDE (n) FROM means", MEANS))
def cluster_means(spark, sf):
    return ops.cluster_means(labelled(spark, sf))


@query(
    "d29_cluster_index",
    S.from_clean(
        "SELECT cluster, " + ", ".join(
            f"round_even({c} / (SELECT avg({c}) FROM labelled), 3) AS {c}" for c in BEHAVIOR
        ) + " FROM means",
        MEANS,
    ),
)
def cluster_index(spark, sf):
    return ops.cluster_index(labelled(spark, sf))


@query(
    "d30_descriptor_rates",
    S.from_clean(
        "SELECT cluster, " + ", ".join(
            f'round_even(avg("{c}") * 100, 2) AS "{c}"' for c in DESCRIBED
        ) + " FROM labelled GROUP BY cluster",
        LABELLED,
    ),
)
def descriptor_rates(spark, sf):
    return ops.descriptor_rates(labelled(spark, sf), DESCRIBED)


def mix_sql(column: str) -> str:
    values = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    if column.startswith("dropoff"):
        values.append("Unknown")
    return "SELECT cluster, " + ", ".join(
        f"""round_even(count(*) FILTER ({column} = '{v}') / count(*) * 100, 2) AS "{v}\""""
        for v in values
    ) + " FROM labelled GROUP BY cluster"


@query("d31_category_mix", S.from_clean(mix_sql("dropoff_borough"), LABELLED))
def category_mix(spark, sf):
    return ops.category_mix(labelled(spark, sf), "dropoff_borough")


@query(
    "d32_year_summary_row",
    S.from_clean(
        """SELECT count(*) AS cluster_count, max(tip_rate_pct) AS top_cluster_tip_rate_pct,
min(tip_rate_pct) AS bottom_cluster_tip_rate_pct, CAST(sum(n) AS BIGINT) AS sample_rows FROM means""",
        MEANS,
    ),
)
def year_summary_row(spark, sf):
    rows = labelled(spark, sf)
    return ops.cluster_extremes(rows, ops.cluster_means(rows))


@query(
    "d33_weighted_profile",
    S.from_clean(
        """SELECT year, CAST(sum(n) AS BIGINT) AS n_rows,
round(sum(tip_rate_pct * n) / sum(n), 6) AS tip_rate_pct,
round(sum(trip_distance * n) / sum(n), 6) AS trip_distance FROM (
  SELECT year, cluster, count(*) AS n, avg(tip_rate_pct) AS tip_rate_pct,
    avg(trip_distance) AS trip_distance FROM labelled GROUP BY year, cluster) GROUP BY year""",
        LABELLED,
    ),
)
def weighted_profile(spark, sf):
    rows = band(
        clean(spark, sf)
        .withColumn("tip_rate_pct", F.col("tip_rate").cast("double") * 100)
        .withColumn("trip_distance", F.col("trip_distance").cast("double"))
    )
    grouped = rows.groupBy("year", "cluster")
    sizes = grouped.agg(F.count(F.lit(1)).alias("n_rows"))
    means = grouped.agg(
        F.avg("tip_rate_pct").alias("tip_rate_pct"), F.avg("trip_distance").alias("trip_distance")
    )
    out = ops.weighted_profile(means, sizes, ["year"], ["tip_rate_pct", "trip_distance"])
    return rounded(out, "tip_rate_pct", "trip_distance")


TOP = LABELLED + """,
ranked AS (
  SELECT cluster, pickup_zone_name, count(*) AS count,
    row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, pickup_zone_name) AS rank,
    CAST(sum(count(*)) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_total
  FROM labelled GROUP BY cluster, pickup_zone_name
),
top AS (SELECT * FROM ranked WHERE rank <= 10)"""


def _top(spark, sf):
    return ops.top_categories(labelled(spark, sf), "pickup_zone_name")


@query(
    "e01_top_categories",
    S.from_clean("SELECT cluster, pickup_zone_name, count, rank FROM top", TOP),
)
def top_categories(spark, sf):
    return _top(spark, sf).select("cluster", "pickup_zone_name", "count", "rank")


@query(
    "e02_top_shares",
    S.from_clean(
        """SELECT cluster, rank, cluster_total,
round(count / cluster_total * 100, 6) AS pct_within_cluster,
round(count / sum(count) OVER (PARTITION BY cluster) * 100, 6) AS pct_top_n_share FROM top""",
        TOP,
    ),
)
def top_shares(spark, sf):
    out = _top(spark, sf).select(
        "cluster", "rank", "cluster_total", "pct_within_cluster", "pct_top_n_share"
    )
    return rounded(out, "pct_within_cluster", "pct_top_n_share")


@query(
    "e03_top_pivoted",
    S.from_clean(
        "SELECT cluster, " + ", ".join(
            f'max(pickup_zone_name) FILTER (rank = {i}) AS "Top {i}"' for i in range(1, 11)
        ) + " FROM top GROUP BY cluster",
        TOP,
    ),
)
def top_pivoted(spark, sf):
    return ops.top_categories_wide(_top(spark, sf), "pickup_zone_name")


@query(
    "c04_group_totals_merged",
    S.from_clean(
        """SELECT cluster, pickup_zone_name, count, CAST(sum(count) OVER (PARTITION BY cluster)
AS BIGINT) AS shown_total FROM top""",
        TOP,
    ),
)
def group_totals_merged(spark, sf):
    top = _top(spark, sf).select("cluster", "pickup_zone_name", "count")
    return ops.add_group_totals(top, "cluster", "count", "shown_total")


@query(
    "e04_dense_tip_rank",
    S.from_clean(
        """SELECT cluster, tip_rate_pct, dense_rank() OVER (ORDER BY tip_rate_pct DESC) AS tip_rank
FROM means""",
        MEANS,
    ),
)
def dense_tip_rank(spark, sf):
    means = ops.cluster_means(labelled(spark, sf)).select("cluster", "tip_rate_pct")
    return means.withColumn("tip_rank", ops.dense_tip_rank())


_LINES = ["hour_Daytime", "hour_Nightlife", "day_Friday", "month_July"]


@query(
    "e07_top_columns",
    S.from_clean(
        """SELECT cluster, string_agg(format('{}: {:.2f}%', name, pct), '; ' ORDER BY pct DESC, i)
  AS lines FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY pct DESC, i) AS place FROM (""" + union(
            f"""SELECT cluster, {i} AS i, '{c}' AS name, round_even(avg("{c}") * 100, 2) AS pct
FROM labelled GROUP BY cluster""" for i, c in enumerate(_LINES)
        ) + ")) WHERE place <= 3 GROUP BY cluster",
        LABELLED,
    ),
)
def top_columns(spark, sf):
    rates = ops.descriptor_rates(labelled(spark, sf), _LINES)
    out = ops.top_columns(rates, _LINES, "", 3)
    return out.select("cluster", F.array_join("lines", "; ").alias("lines"))


@query(
    "e08_first_zones",
    S.from_clean(
        """SELECT cluster, string_agg(pickup_zone_name, '; ' ORDER BY rank) AS categories
FROM top WHERE rank <= 5 GROUP BY cluster""",
        TOP,
    ),
)
def first_zones(spark, sf):
    out = ops.first_categories(_top(spark, sf), "pickup_zone_name", 5)
    return out.select("cluster", F.array_join("categories", "; ").alias("categories"))


# --- k grid over deterministic labellings: k equal distance bands ---------------
_GRID_FEATURES = ["trip_distance", "duration_min", "fare_amount"]


def _long_labels(spark, sf):
    ks = F.explode(F.array(*[F.lit(k) for k in range(2, 11)])).alias("k")
    rows = segment_rows(spark, sf).select(*_GRID_FEATURES, ks)
    band_no = F.least(F.floor(F.col("trip_distance") * F.col("k") / 15.5), F.col("k") - 1)
    return rows.withColumn("cluster", band_no.cast("int"))


@_declared_once
def grid(spark, sf):
    """Inertia and variance ratio are real; the explained share stands in for the silhouette."""
    table = metrics.calinski_harabasz(_long_labels(spark, sf), _GRID_FEATURES, "cluster", ["k"])
    rows = segment_rows(spark, sf).agg(
        sum((F.var_pop(c) * F.count(c) for c in _GRID_FEATURES[1:]),
            F.var_pop(_GRID_FEATURES[0]) * F.count(_GRID_FEATURES[0]))
    )
    explained = 1.0 - F.col("inertia") / rows.scalar()
    return ops.inertia_drops(table.withColumn("silhouette", explained))


GRID = SAMPLE + """,
long_labels AS (
  SELECT k, least(CAST(floor(trip_distance * k / 15.5e0) AS INT), k - 1) AS cluster,
    trip_distance, duration_min, fare_amount FROM sample, range(2, 11) r(k)
),
per_cluster AS (
  SELECT k, cluster, count(*) AS n, """ + ", ".join(
    f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}" for c in _GRID_FEATURES) + """
  FROM long_labels GROUP BY k, cluster
),
overall AS (SELECT count(*) AS total, """ + ", ".join(
    f"avg({c}) AS o_{c}, var_pop({c}) AS ov_{c}" for c in _GRID_FEATURES) + """ FROM sample),
raw_grid AS (
  SELECT k, sum(n * (""" + " + ".join(f"v_{c}" for c in _GRID_FEATURES) + """)) AS inertia,
    1 - sum(n * (""" + " + ".join(f"v_{c}" for c in _GRID_FEATURES) + """))
      / max(total * (""" + " + ".join(f"ov_{c}" for c in _GRID_FEATURES) + """)) AS silhouette,
    sum(n * (""" + " + ".join(f"(m_{c} - o_{c}) ** 2" for c in _GRID_FEATURES) + """))
      / (count(*) - 1) / (sum(n * (""" + " + ".join(f"v_{c}" for c in _GRID_FEATURES) + """))
      / (sum(n) - count(*))) AS calinski_harabasz,
    min(n) / sum(n) * 100 AS min_cluster_pct, max(n) / sum(n) * 100 AS max_cluster_pct,
    count(*) AS clusters, CAST(sum(n) AS BIGINT) AS rows
  FROM per_cluster, overall GROUP BY k
),
grid AS (
  SELECT CAST(k AS INT) AS k, inertia, silhouette, calinski_harabasz, min_cluster_pct,
    max_cluster_pct, clusters, rows,
    lag(inertia) OVER (ORDER BY k) - inertia AS inertia_drop,
    (lag(inertia) OVER (ORDER BY k) - inertia) / lag(inertia) OVER (ORDER BY k) AS inertia_drop_pct
  FROM raw_grid
)"""


@query(
    "k05_calinski_harabasz",
    S.from_clean(
        """SELECT k, clusters, rows, round(inertia, 3) AS inertia,
round(calinski_harabasz, 3) AS calinski_harabasz, round(min_cluster_pct, 6) AS min_cluster_pct,
round(max_cluster_pct, 6) AS max_cluster_pct FROM grid""",
        GRID,
    ),
)
def calinski_harabasz(spark, sf):
    out = metrics.calinski_harabasz(_long_labels(spark, sf), _GRID_FEATURES, "cluster", ["k"])
    out = rounded(out, "inertia", "calinski_harabasz", digits=3)
    return rounded(out, "min_cluster_pct", "max_cluster_pct")


@query(
    "e05_inertia_drops",
    S.from_clean(
        """SELECT k, round(inertia_drop, 3) AS inertia_drop,
round(inertia_drop_pct, 9) AS inertia_drop_pct FROM grid""",
        GRID,
    ),
)
def inertia_drops(spark, sf):
    out = grid(spark, sf).select("k", "inertia_drop", "inertia_drop_pct")
    return rounded(rounded(out, "inertia_drop", digits=3), "inertia_drop_pct", digits=9)


SCORED = GRID + """,
longer AS (
  SELECT * FROM grid WHERE k >= 3 OR NOT EXISTS (SELECT 1 FROM grid WHERE k >= 3)
),
balanced AS (
  SELECT * FROM longer WHERE min_cluster_pct >= 2
    OR NOT EXISTS (SELECT 1 FROM longer WHERE min_cluster_pct >= 2)
),
candidates AS (
  SELECT *, coalesce(inertia_drop_pct, 0) AS elbow FROM balanced
  WHERE silhouette IS NOT NULL AND calinski_harabasz IS NOT NULL
),
scaled AS (
  SELECT k, """ + ", ".join(
    f"""CASE WHEN max({c}) OVER () - min({c}) OVER () < 1e-12 THEN 1
      ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END AS s_{c}"""
    for c in ["silhouette", "calinski_harabasz", "elbow", "min_cluster_pct"]) + """
  FROM candidates
),
scored AS (
  SELECT *, 0.4e0 * s_silhouette + 0.3e0 * s_elbow + 0.2e0 * s_calinski_harabasz
    + 0.1e0 * s_min_cluster_pct AS consensus_score FROM scaled
)"""


@query(
    "e06_min_max_scale",
    S.from_clean(
        """SELECT k, round(s_silhouette, 6) AS score_silhouette,
round(s_calinski_harabasz, 6) AS score_calinski_harabasz, round(s_elbow, 6) AS score_elbow_drop_pct,
round(s_min_cluster_pct, 6) AS score_cluster_balance FROM scored""",
        SCORED,
    ),
)
def min_max_scale(spark, sf):
    scored, _ = ops.score_k(grid(spark, sf))
    names = [c for c in scored.columns if c.startswith("score_")]
    return rounded(scored.select("k", *names), *names)


@query(
    "k06_choose_k",
    S.from_clean(
        """SELECT k, 'consensus_score' AS metric, round(consensus_score, 6) AS value FROM scored
ORDER BY consensus_score DESC, k LIMIT 1""",
        SCORED,
    ),
)
def choose_k(spark, sf):
    return rounded(ops.select_k(grid(spark, sf)), "value")


@query(
    "f04_best_row",
    S.from_clean(
        """SELECT k, round(calinski_harabasz, 3) AS calinski_harabasz FROM grid
ORDER BY calinski_harabasz DESC, k LIMIT 1""",
        GRID,
    ),
)
def best_row(spark, sf):
    out = ops.best_row(grid(spark, sf), "calinski_harabasz").select("k", "calinski_harabasz")
    return rounded(out, "calinski_harabasz", digits=3)


@query(
    "c05_score_merged",
    S.from_clean(
        """SELECT k, round(inertia, 3) AS inertia, round(consensus_score, 6) AS consensus_score
FROM grid LEFT JOIN scored USING (k)""",
        SCORED,
    ),
)
def score_merged(spark, sf):
    table = grid(spark, sf)
    scored, metric = ops.score_k(table)
    out = ops.add_scores(table, scored, metric).select("k", "inertia", metric)
    return rounded(rounded(out, "inertia", digits=3), metric)


# --- behaviour matrix, personas and bundles ------------------------------------
_WINSOR = C.BEHAVIOR_WINSOR_COLUMNS
BEHAVIOUR = LABELLED + """,
fitted AS (SELECT """ + ", ".join(
    f"quantile_cont({c}, 0.003) AS lo_{c}, quantile_cont({c}, 0.997) AS hi_{c}" for c in _WINSOR
) + """ FROM labelled),
held AS (SELECT trip_key, """ + ", ".join(
    f"least(greatest({c}, lo_{c}), hi_{c}) AS {c}" if c in _WINSOR else c for c in BEHAVIOR
) + """ FROM labelled, fitted),
moments AS (SELECT """ + ", ".join(
    f"""avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}"""
    for c in BEHAVIOR
) + " FROM held)"


@query(
    "k01_behaviour_matrix",
    S.from_clean(
        "SELECT trip_key, " + ", ".join(
            f"round({c}, 6) AS {c}, round(({c} - m_{c}) / s_{c}, 6) AS z_{c}" for c in BEHAVIOR
        ) + " FROM held, moments",
        BEHAVIOUR,
    ),
)
def behaviour_matrix(spark, sf):
    matrix = plan.behaviour_matrix(segment_rows(spark, sf))
    names = matrix.columns + matrix.scaled
    return rounded(matrix.frame.select(KEY, *names), *names)


@query(
    "k01_behaviour_summary",
    S.from_clean(
        "SELECT 0.003e0 AS winsor_lower, 0.997e0 AS winsor_upper, count(*) AS n_rows, "
        "8 AS n_features, " + " + ".join(
            f"count(*) FILTER ({c} < lo_{c} OR {c} > hi_{c})" for c in _WINSOR
        ) + " AS total_cells_clipped FROM labelled, fitted",
        BEHAVIOUR,
    ),
)
def behaviour_summary(spark, sf):
    return plan.behaviour_matrix(segment_rows(spark, sf)).summary


@query(
    "k08_scaler_summary",
    S.from_clean(
        union(
            f"""SELECT '{c}' AS feature, round(m_{c}, 6) AS mean_, round(s_{c}, 6) AS scale_
FROM moments""" for c in BEHAVIOR
        ),
        BEHAVIOUR,
    ),
)
def scaler_summary(spark, sf):
    matrix = plan.behaviour_matrix(segment_rows(spark, sf))
    return rounded(plan.scaler_table(spark, matrix.scaler), "mean_", "scale_")


def _top_sql(zone: str) -> str:
    """The ten most frequent zones per cluster, with their rank."""
    return f"""SELECT cluster, {zone} AS zone, count(*) AS n,
  row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, {zone}) AS rank,
  n / sum(n) OVER (PARTITION BY cluster) * 100 AS pct
FROM labelled GROUP BY cluster, {zone} QUALIFY rank <= 10"""


def _stacked_sql(part: str, table: str, columns) -> list[str]:
    return [
        f"""SELECT '{part}' AS part, cluster, '{c}' AS name, CAST("{c}" AS DOUBLE) AS value, NULL AS label FROM {table}"""
        for c in columns
    ]


_MIX = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_SIDES = {"pickup": _MIX, "dropoff": [*_MIX, "Unknown"]}
BUNDLE = MEANS + """,
idx AS (SELECT cluster, """ + ", ".join(
    f"round_even({c} / (SELECT avg({c}) FROM labelled), 3) AS {c}" for c in BEHAVIOR
) + """ FROM means),
rates AS (SELECT cluster, """ + ", ".join(
    f'round_even(avg("{c}") * 100, 2) AS "{c}"' for c in DESCRIBED
) + " FROM labelled GROUP BY cluster)" + "".join(
    f",\n{side}_mix AS ({mix_sql(side + '_borough')}),\n{side}_top AS ({_top_sql(side + '_zone_name')})"
    for side in _SIDES
)


@query(
    "k09_summary_bundle",
    S.from_clean(
        union(
            [
                *_stacked_sql("cluster_size", "sizes", ["n_rows"]),
                "SELECT 'cluster_size', cluster, 'pct_rows', round(pct_rows, 6), NULL FROM sizes",
                *_stacked_sql("behavioral_means", "means", BEHAVIOR),
                *_stacked_sql("behavioral_index", "idx", BEHAVIOR),
                *_stacked_sql("descriptive_rates_pct", "rates", DESCRIBED),
            ]
            + [
                text
                for side, values in _SIDES.items()
                for text in (
                    *_stacked_sql(f"{side}_borough_mix_pct", f"{side}_mix", values),
                    f"SELECT 'top_{side}_zones_long', cluster, zone, CAST(n AS DOUBLE), rank || ' ' || round(pct, 4)::DECIMAL(9,4) FROM {side}_top",
                    f"SELECT 'top_{side}_zones_wide', cluster, 'Top ' || rank, NULL, zone FROM {side}_top",
                )
            ]
        ),
        BUNDLE,
    ),
)
def summary_bundle(spark, sf):
    """All ten tables of the bundle, stacked as (part, cluster, name, value, label)."""
    from meterwise.operators.quantiles import long_values

    tables = plan.summary_tables(labelled(spark, sf).persist(), DESCRIBED)

    def stacked(part, table):
        columns = [c for c in table.columns if c != "cluster"]
        long = long_values(table, columns, ["cluster"]).withColumnRenamed("column", "name")
        return long.select(
            F.lit(part).alias("part"), "cluster", "name", "value", F.lit(None).cast("string").alias("label")
        )

    def long_top(part, table, zone):
        share = F.concat_ws(" ", F.col("rank").cast("string"), F.round("pct_within_cluster", 4).cast("decimal(9,4)").cast("string"))
        return table.select(
            F.lit(part).alias("part"), "cluster", F.col(zone).alias("name"),
            F.col("count").cast("double").alias("value"), share.alias("label"),
        )

    def wide_top(part, table):
        places = [c for c in table.columns if c != "cluster"]
        cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("label")) for c in places])
        long = table.select("cluster", F.inline(cells)).where("label IS NOT NULL")
        return long.select(
            F.lit(part).alias("part"), "cluster", "name", F.lit(None).cast("double").alias("value"), "label"
        )

    parts = []
    for part, table in tables.items():
        if part.endswith("_long"):
            parts.append(long_top(part, table, f"{part.split('_')[1]}_zone_name"))
        elif part.endswith("_wide"):
            parts.append(wide_top(part, table))
        else:
            parts.append(stacked(part, rounded(table, "pct_rows") if part == "cluster_size" else table))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


PERSONA = MEANS + """,
called AS (
  SELECT *, CASE
    WHEN is_airport_trip_num >= 0.4 AND trip_distance >= 8 THEN 'Airport Connector Long-Haul'
    WHEN passenger_count >= 2.5 THEN 'Group-Cab City Movers'
    WHEN trip_distance <= 2 AND duration_min <= 10 AND tip_rate_pct >= avg(tip_rate_pct) OVER ()
      THEN 'High-Tipping Local Errands'
    WHEN tip_rate_pct < avg(tip_rate_pct) OVER () AND trip_distance >= 3
      THEN 'Lower-Tip Mid-Range Trips'
    ELSE 'Core Manhattan Mixed Trips' END AS persona,
    dense_rank() OVER (ORDER BY tip_rate_pct DESC) AS tip_rank, count(*) OVER () AS clusters
  FROM means
),
overview AS (
  SELECT *, CASE WHEN tip_rank = 1 THEN 'Highest' WHEN tip_rank = clusters THEN 'Lowest'
      ELSE 'Mid-tier' END || ' tip propensity' || CASE
      WHEN persona LIKE '%Airport%' THEN ', airport-driven'
      WHEN persona LIKE '%Group-Cab%' THEN ', group-passenger segment'
      WHEN persona LIKE '%High-Tipping%' THEN ', short-hop urban core'
      WHEN persona LIKE '%Lower-Tip%' THEN ', mixed-value longer hauls' ELSE '' END AS comment
  FROM called
)"""


@_declared_once
def persona_means(spark, sf):
    return ops.cluster_means(labelled(spark, sf))


@query("k10_persona_label", S.from_clean("SELECT cluster, persona FROM called", PERSONA))
def persona_label(spark, sf):
    return ops.add_personas(persona_means(spark, sf)).select("cluster", "persona")


@query(
    "k11_persona_comment", S.from_clean("SELECT cluster, tip_rank, comment FROM overview", PERSONA)
)
def persona_comment(spark, sf):
    return ops.add_personas(persona_means(spark, sf)).select("cluster", "tip_rank", "comment")


def _text_case(index: int) -> str:
    whens = " ".join(f"WHEN '{p[0]}' THEN '{p[index]}'" for p in ops.PERSONAS)
    return f"CASE persona {whens} END"


@query(
    "k12_persona_texts",
    S.from_clean(
        f"""SELECT cluster, persona, {_text_case(2)} AS interpretation, {_text_case(3)} AS advice
FROM called""",
        PERSONA,
    ),
)
def persona_texts(spark, sf):
    out = ops.persona_texts(ops.add_personas(persona_means(spark, sf)))
    return out.select("cluster", "persona", "interpretation", "advice")


@query(
    "k13_persona_overview",
    S.from_clean(
        """SELECT cluster, persona, tip_rate_pct, tip_rank,
round(pct_rows, 6) AS cluster_share_pct, comment FROM overview JOIN sizes USING (cluster)""",
        PERSONA,
    ),
)
def persona_overview(spark, sf):
    sizes = ops.cluster_sizes(labelled(spark, sf))
    return rounded(ops.persona_overview(persona_means(spark, sf), sizes), "cluster_share_pct")


@query(
    "k14_assignment_export",
    S.from_clean(
        """SELECT cluster, fare_amount, tolls_amount, passenger_count, trip_distance, duration_min,
speed_mph, tip_rate_pct, is_airport_trip, pickup_borough, dropoff_borough, pickup_zone_name,
dropoff_zone_name FROM labelled""",
        LABELLED,
    ),
)
def assignment_export(spark, sf):
    return plan.assignment_export(labelled(spark, sf), [KEY])


# --- fitted: rows only ---------------------------------------------------------
def _fitted(spark, sf, k=4):
    matrix = plan.behaviour_matrix(segment_rows(spark, sf))
    held = matrix.frame.persist()
    model = plan.fit_kmeans(held, matrix.scaled, k, C.SEED)
    held.unpersist()
    return matrix, model


@query("k02_kmeans_labels")
def kmeans_labels(spark, sf):
    """Sizes of the clusters of the best of thirty starts."""
    matrix, model = _fitted(spark, sf)
    return ops.cluster_sizes(matrix.frame.withColumn("cluster", model.label(matrix.scaled)))


@query("k03_k_grid")
def k_grid(spark, sf):
    matrix = plan.behaviour_matrix(segment_rows(spark, sf))
    return plan.evaluate_grid(matrix, [KEY])


_FAR = "sqrt(" + " + ".join(f"(a.z_{c} - b.z_{c}) ** 2" for c in BEHAVIOR) + ")"


@query(
    "k04_silhouette",
    S.from_clean(
        f"""SELECT 'cluster' AS labelling, round(avg(CASE WHEN n = 1 THEN 0
  WHEN greatest(own, nearest) > 0 THEN (nearest - own) / greatest(own, nearest) ELSE 0 END), 6) AS silhouette
FROM near""",
        BEHAVIOUR + """,
z AS MATERIALIZED (SELECT trip_key, cluster, """ + ", ".join(f"(h.{c} - m_{c}) / s_{c} AS z_{c}" for c in BEHAVIOR) + f"""
  FROM held h JOIN labelled l USING (trip_key), moments ORDER BY {hashed(59)} LIMIT {metrics.SILHOUETTE_ROWS}),
size AS (SELECT cluster AS part, count(*) AS n FROM z GROUP BY cluster),
far AS (SELECT a.trip_key, a.cluster, b.cluster AS part, sum({_FAR}) AS d FROM z a, z b GROUP BY 1, 2, 3),
near AS (SELECT trip_key, max(n) FILTER (cluster = part) AS n, max(d / greatest(n - 1, 1)) FILTER (cluster = part) AS own,
  min(d / n) FILTER (cluster <> part) AS nearest FROM far JOIN size USING (part) GROUP BY trip_key)""",
    ),
)
def silhouette(spark, sf):
    """Distance bands scored on the standardised behaviour columns of the metric sample."""
    matrix = plan.behaviour_matrix(segment_rows(spark, sf))
    drawn = sampling.cap_rows(band(matrix.frame), metrics.SILHOUETTE_ROWS, [KEY], C.SEED + 17)
    return rounded(metrics.euclidean_silhouettes(drawn, matrix.scaled, ["cluster"]), "silhouette")


@query("k07_centroids")
def centroids(spark, sf):
    matrix, model = _fitted(spark, sf)
    scaled, raw = plan.centroid_tables(model, matrix)
    return scaled.withColumn("units", F.lit("scaled")).union(raw.withColumn("units", F.lit("raw")))


@query(
    "d26_inverse_scaling",
    S.from_clean(
        "SELECT l.cluster, " + ", ".join(f"round(avg(h.{c}), 6) AS {c}" for c in BEHAVIOR)
        + " FROM held h JOIN labelled l USING (trip_key) GROUP BY l.cluster",
        BEHAVIOUR,
    ),
)
def inverse_scaling(spark, sf):
    """Standardised means of the distance bands, brought back to raw units."""
    matrix = plan.behaviour_matrix(segment_rows(spark, sf))
    means = band(matrix.frame).groupBy("cluster").agg(
        *[F.avg(Z).alias(c) for c, Z in zip(matrix.columns, matrix.scaled, strict=True)]
    )
    return rounded(outliers.unscale(means, matrix.scaler), *matrix.columns)


@query("k15_segment_years")
def segment_years(spark, sf):
    """Every year that the data holds."""
    rows = clean(spark, sf)
    years = [r["year"] for r in rows.select("year").distinct().orderBy("year").collect()]
    return plan.segment_years(rows, years, [KEY], grid_restarts=5, final_restarts=5)[1]
