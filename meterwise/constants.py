"""Fixed values that the results depend on. Change one and published numbers move."""

# --- columns -----------------------------------------------------------------
RAW_COLUMNS = {
    "tpep_pickup_datetime": "timestamp_ntz",
    "tpep_dropoff_datetime": "timestamp_ntz",
    "passenger_count": "double",
    "trip_distance": "double",
    "RatecodeID": "int",
    "PULocationID": "int",
    "DOLocationID": "int",
    "fare_amount": "double",
    "extra": "double",
    "mta_tax": "double",
    "improvement_surcharge": "double",
    "congestion_surcharge": "double",
    "airport_fee": "double",
    "tip_amount": "double",
    "tolls_amount": "double",
    "total_amount": "double",
    "payment_type": "int",
}

ZONE_COLUMNS = {"zone_id": "int", "borough": "string", "zone_name": "string", "wkt": "string"}

CLEAN_COLUMNS = {
    "pickup_datetime": "timestamp_ntz",
    "dropoff_datetime": "timestamp_ntz",
    "passenger_count": "tinyint",
    "rate_code": "tinyint",
    "pickup_location_id": "int",
    "dropoff_location_id": "int",
    "pickup_borough": "string",
    "pickup_zone_name": "string",
    "dropoff_borough": "string",
    "dropoff_zone_name": "string",
    "is_airport_trip": "boolean",
    "pickup_hour": "tinyint",
    "dow": "tinyint",
    "month_num": "tinyint",
    "weekend": "boolean",
    "rush_hour": "boolean",
    "night_trip": "boolean",
    "trip_distance": "float",
    "duration_min": "float",
    "speed_mph": "float",
    "fare_amount": "decimal(9,2)",
    "extra": "decimal(9,2)",
    "mta_tax": "decimal(9,2)",
    "improvement_surcharge": "decimal(9,2)",
    "congestion_surcharge": "decimal(9,2)",
    "airport_fee": "decimal(9,2)",
    "tolls_amount": "decimal(9,2)",
    "tip_amount": "decimal(9,2)",
    "total_amount": "decimal(9,2)",
    "tip_rate": "float",
}

MODEL_SAMPLE_COLUMNS = [
    "passenger_count", "rate_code", "pickup_borough", "pickup_hour", "month_num", "dow",
    "weekend", "is_airport_trip", "rush_hour", "night_trip", "trip_distance", "duration_min",
    "speed_mph", "fare_amount", "extra", "mta_tax", "improvement_surcharge",
    "congestion_surcharge", "airport_fee", "tolls_amount", "tip_amount", "tip_rate",
    "total_amount",
]

SEGMENT_SAMPLE_COLUMNS = [
    "fare_amount", "tolls_amount", "passenger_count", "trip_distance", "duration_min",
    "speed_mph", "tip_rate", "is_airport_trip", "pickup_hour", "dow", "month_num", "weekend",
    "rush_hour", "night_trip", "pickup_borough", "pickup_zone_name", "dropoff_borough",
    "dropoff_zone_name",
]

SURCHARGE_COLUMNS = [
    "extra", "mta_tax", "improvement_surcharge", "congestion_surcharge", "airport_fee",
    "tolls_amount",
]
FLAG_COLUMNS = ["is_airport_trip", "weekend", "rush_hour", "night_trip"]

BEHAVIOR_COLUMNS = [
    "fare_amount", "tolls_amount", "passenger_count", "trip_distance", "duration_min",
    "speed_mph", "tip_rate_pct", "is_airport_trip_num",
]
BEHAVIOR_WINSOR_COLUMNS = [
    "fare_amount", "tolls_amount", "trip_distance", "duration_min", "speed_mph", "tip_rate_pct",
]
MODEL_OUTLIER_COLUMNS = [
    "trip_distance", "duration_min", "speed_mph", "fare_amount", "tolls_amount", "extra",
]
PROFILE_COLUMNS = [
    "trip_distance", "duration_min", "speed_mph", "fare_amount", "tip_amount", "tip_rate",
]
ASSIGNMENT_COLUMNS = [
    "cluster", "fare_amount", "tolls_amount", "passenger_count", "trip_distance",
    "duration_min", "speed_mph", "tip_rate_pct", "is_airport_trip", "pickup_borough",
    "dropoff_borough", "pickup_zone_name", "dropoff_zone_name",
]

TARGETS = ["tip_amount", "tip_rate", "log_tip"]
LEAKAGE_COLUMNS = ["tip_amount", "tip_rate", "log_tip", "total_amount"]
DUMMY_PREFIXES = ("hour_", "month_", "borough_")
ENCODED_AWAY = ["pickup_hour", "month_num", "pickup_borough", "dow", "rush_hour", "night_trip"]

# --- meter and cleaning ------------------------------------------------------
CARD_PAYMENT = 1
METERED_RATE_CODES = [1, 2]
FLAT_RATE_CODE = 2
# Limits of a plausible trip.
MAX_MILES = 100
MAX_SPEED_MPH = 60
MAX_MINUTES = 300
MIN_MINUTES_CROSSED = 1
# Hours (both ends included) and ISO weekdays.
RUSH_HOURS = ((7, 9), (16, 18))
NIGHT_HOURS = ((22, 23), (0, 5))
WEEKEND_DAYS = (6, 7)
MILES_PER_TICK = 0.2
SECONDS_PER_TICK = 60.0
ADDON_CAPS = {
    "extra": 5.0,
    "mta_tax": 1.0,
    "improvement_surcharge": 1.0,
    "congestion_surcharge": 5.0,
    "airport_fee": 2.0,
}
FARE_TOLERANCE = 0.20
AIRPORT_WORDS = ["airport", "jfk", "laguardia"]

# --- zone statistics ---------------------------------------------------------
EXCLUDED_ZONES = [264, 265]
RATE_MIN_FARE = 5
ZONE_WINSOR = (0.01, 0.99)
IQR_TO_SIGMA = 1.349
COLOR_RANGE = (0.003, 0.997)

# --- labels ------------------------------------------------------------------
HOUR_BINS = [
    (-1, 3, "Late Night"),
    (3, 6, "Airport Rush"),
    (6, 15, "Daytime"),
    (15, 20, "Evening Commute"),
    (20, 24, "Nightlife"),
]
HOUR_LABELS = ["Late Night", "Airport Rush", "Daytime", "Evening Commute", "Nightlife"]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]
BOROUGHS = ["Bronx", "Brooklyn", "Manhattan", "Queens", "Staten Island", "EWR", "Unknown"]

# --- profiling and preparation -----------------------------------------------
WINSOR_QUANTILES = (0.003, 0.997)
SKEW_CUTOFF = 1.0
CORR_CUTOFF = 0.9
ZERO_VARIANCE = 1e-12
NEAR_ZERO_VARIANCE = 1e-4
STD_RATIO_CUTOFF = 20.0
RANGE_RATIO_CUTOFF = 100.0
SKEW_RATE_CUTOFF = 30.0

# --- segmentation ------------------------------------------------------------
CONSENSUS_WEIGHTS = {
    "silhouette": 0.40,
    "elbow_drop_pct": 0.30,
    "calinski_harabasz": 0.20,
    "cluster_balance": 0.10,
}
AUTO_MIN_K = 3
MIN_CLUSTER_PCT = 2.0
SEED = 42
