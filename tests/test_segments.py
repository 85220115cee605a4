import pytest

from meterwise.operators import segments as ops

GRID = ("k int, inertia double, silhouette double, calinski_harabasz double, "
        "min_cluster_pct double")
# Published k grids: k, inertia, silhouette, variance ratio, smallest cluster percent.
GRIDS = {
    2015: [
        (2, 23081741.899657574, 0.6714074534680975, 146892.63422190005, 7.00958),
        (3, 21915202.44882341, 0.6155865642035153, 82711.07004925687, 2.96006),
        (4, 15918433.11432117, 0.3330656529665118, 101246.60830394746, 6.56848),
        (5, 14772537.982861517, 0.3230177406888668, 85691.2393535658, 2.99842),
        (6, 12823861.962096006, 0.2715464797258829, 85229.26987084147, 2.06032),
        (7, 11597370.387866247, 0.2839476712780444, 81977.34224918798, 2.00604),
        (8, 10929623.273650754, 0.25922167288360065, 76156.8266876437, 2.01186),
        (9, 10141448.452277554, 0.24434743152621932, 74005.60654343557, 2.01476),
        (10, 9633159.810837006, 0.2631091339203433, 70412.85446675803, 2.00904),
    ],
    2020: [
        (2, 23521269.60825694, 0.7023845373324301, 142073.01362998772, 5.50054),
        (3, 19276298.433518827, 0.2915624239943358, 108849.77666225778, 5.212),
        (4, 15960748.392097967, 0.3543868446731211, 101441.70953229576, 5.03144),
        (5, 14151367.13610305, 0.30049774042223926, 92017.93048015668, 2.19856),
        (6, 12342038.90256754, 0.25416770038022934, 90281.93350790082, 1.7973),
    ],
    2022: [
        (2, 21282576.044942606, 0.653300047079669, 173986.5524121147, 10.13632),
        (3, 17988113.999612615, 0.275697266345463, 121566.79006144076, 9.84536),
        (4, 14910934.994859446, 0.2816481075162342, 111455.65117581976, 7.50916),
        (5, 13302244.842563558, 0.2938449846782353, 99720.37062987372, 3.31668),
        (6, 12360369.360803146, 0.2896205837493986, 88723.99134563301, 5.01514),
        (7, 11199797.348802313, 0.25698536119726834, 85251.89735593126, 3.15028),
        (8, 10126055.897933338, 0.23759426084794547, 83651.71057245666, 3.09996),
        (9, 9490192.147973808, 0.25814977662357985, 79921.47945498914, 3.08362),
        (10, 8888698.359116616, 0.2664471316517463, 77541.62044766193, 2.97946),
    ],
}


@pytest.mark.parametrize("year, score", [(2015, 0.695591), (2020, 0.868110), (2022, 0.833308)])
def test_published_grids_choose_four(spark, year, score):
    grid = ops.inertia_drops(spark.createDataFrame(GRIDS[year], GRID))
    row = ops.select_k(grid).first()
    assert row["k"] == 4 and row["value"] == pytest.approx(score, abs=1e-6)


def test_inertia_drops(spark):
    rows = ops.inertia_drops(spark.createDataFrame(GRIDS[2015], GRID)).orderBy("k").collect()
    assert rows[0]["inertia_drop"] is None
    assert rows[2]["inertia_drop_pct"] == pytest.approx(0.2736351328948913, abs=1e-12)


def test_filters_that_would_empty_the_list_are_skipped(spark):
    tiny = [(2, 10.0, 0.5, 5.0, 0.5), (2, 9.0, 0.4, 5.0, 0.1)]
    grid = ops.inertia_drops(spark.createDataFrame(tiny, GRID))
    assert ops.k_candidates(grid).count() == 2


def test_missing_metrics_and_single_metric(spark):
    rows = [(3, 10.0, None, 5.0, 9.0), (4, 9.0, 0.2, 4.0, 9.0)]
    grid = ops.inertia_drops(spark.createDataFrame(rows, GRID))
    assert ops.select_k(grid).first()["k"] == 4
    assert ops.select_k(grid, method="calinski_harabasz").first()["k"] == 3
    nothing = ops.inertia_drops(spark.createDataFrame([(3, 1.0, None, None, 9.0)], GRID))
    assert ops.select_k(nothing).first() is None
    with pytest.raises(ValueError):
        ops.select_k(grid, method="elbow")


def test_min_max_flat_and_empty(spark):
    df = spark.createDataFrame([(1.0, None, 0.0), (1.0, None, 4.0)], "a double, b double, c double")
    from pyspark.sql import functions as F

    rows = df.select(*[ops.min_max(F.col(c)).alias(c) for c in "abc"]).collect()
    assert {r["a"] for r in rows} == {1.0} and {r["b"] for r in rows} == {None}
    assert sorted(r["c"] for r in rows) == [0.0, 1.0]


MEANS = ("cluster int, passenger_count double, trip_distance double, duration_min double, "
         "tip_rate_pct double, is_airport_trip_num double")
# Published cluster means: cluster, passengers, miles, minutes, tip percent, airport share.
PUBLISHED = {
    2015: [(0, 1.2267, 1.4429, 9.0267, 22.9505, 0.0014), (1, 1.704, 13.4556, 33.9233, 21.068, 0.91),
           (2, 5.1128, 2.1342, 12.0178, 20.8103, 0.0041),
           (3, 1.2712, 4.2111, 20.7804, 15.9967, 0.0087)],
    2020: [(0, 1.1564, 1.4217, 8.6876, 28.5635, 0.001),
           (1, 1.5164, 13.8292, 33.397, 21.6609, 0.8899),
           (2, 4.4332, 1.8665, 10.5741, 27.0332, 0.0027),
           (3, 1.2375, 4.5522, 21.266, 19.0436, 0.0113)],
    2022: [(0, 4.0663, 2.244, 13.0909, 26.4131, 0.0041),
           (1, 1.1616, 2.1258, 12.6579, 26.6715, 0.0017),
           (2, 1.4856, 14.0042, 38.3797, 23.5143, 0.8591),
           (3, 1.3681, 12.5998, 34.9835, 19.3924, 0.7325)],
}
EXPECTED = {
    2015: [(0, ops.LOCAL, 1), (1, ops.AIRPORT, 2), (2, ops.GROUP, 3), (3, ops.LOWER, 4)],
    2020: [(0, ops.LOCAL, 1), (2, ops.GROUP, 2), (1, ops.AIRPORT, 3), (3, ops.LOWER, 4)],
    2022: [(1, ops.CORE, 1), (0, ops.GROUP, 2), (2, ops.AIRPORT, 3), (3, ops.AIRPORT, 4)],
}


@pytest.mark.parametrize("year", [2015, 2020, 2022])
def test_published_personas(spark, year):
    means = spark.createDataFrame(PUBLISHED[year], MEANS)
    sizes = spark.createDataFrame([(c, 10, 25.0) for c in range(4)],
                                  "cluster int, n_rows long, pct_rows double")
    rows = ops.persona_overview(means, sizes).collect()
    assert [(r["cluster"], r["persona"], r["tip_rank"]) for r in rows] == EXPECTED[year]
    if year == 2015:
        assert rows[0]["comment"] == "Highest tip propensity, short-hop urban core"
        assert rows[3]["comment"] == "Lowest tip propensity, mixed-value longer hauls"
    if year == 2022:
        assert rows[0]["comment"] == "Highest tip propensity"


def test_every_persona_has_texts(spark):
    df = spark.createDataFrame([(p[0],) for p in ops.PERSONAS], "persona string")
    assert all(r["interpretation"] and r["advice"] for r in ops.persona_texts(df).collect())


LABELLED = [(0, "b"), (0, "b"), (0, "a"), (0, "a"), (0, "c"), (1, "c"), (1, None)]


def test_top_categories_break_ties_by_name(spark):
    df = spark.createDataFrame(LABELLED, "cluster int, zone string").fillna("Unknown")
    top = ops.top_categories(df, "zone", 2)
    rows = [(r["cluster"], r["zone"], r["rank"]) for r in top.collect()]
    assert rows == [(0, "a", 1), (0, "b", 2), (1, "Unknown", 1), (1, "c", 2)]
    first = top.collect()[0]
    assert first["cluster_total"] == 5 and first["pct_within_cluster"] == 40.0
    assert first["pct_top_n_share"] == 50.0
    wide = ops.top_categories_wide(top, "zone", 3).orderBy("cluster").collect()
    assert wide[0]["Top 1"] == "a" and wide[0]["Top 3"] is None
    lists = {r["cluster"]: r["categories"] for r in ops.first_categories(top, "zone", 1).collect()}
    assert lists == {0: ["a"], 1: ["Unknown"]}


def test_mix_rows_add_up(spark):
    df = spark.createDataFrame(LABELLED, "cluster int, zone string").fillna("Unknown")
    for row in ops.category_mix(df, "zone").collect():
        assert sum(v for k, v in row.asDict().items() if k != "cluster") == pytest.approx(100, abs=0.05)


def test_index_uses_rounded_means(spark):
    df = spark.createDataFrame([(0, 0.33333), (1, 1.0), (1, 2.0)], "cluster int, v double")
    rows = {r["cluster"]: r["v"] for r in ops.cluster_index(df, ["v"]).collect()}
    assert rows == {0: round(0.3333 / (3.33333 / 3), 3), 1: round(1.5 / (3.33333 / 3), 3)}
