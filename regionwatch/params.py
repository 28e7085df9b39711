"""Fixed values and default parameters shared by the operators."""

KEYS = ("date", "zipcode")

# --- Fixed values: signal columns in panel order -----------------------------
NUMERIC_COLUMNS = (
    "pharmacy_sales",
    "negative_sentiment",
    "post_volume",
    "symptom_mention_rate",
    "temperature_c",
    "humidity_pct",
    "precipitation_mm",
    "wind_speed_kmh",
    "aqi",
    "pm25_ugm3",
    "er_visits",
)

# --- Fixed values: physical ranges, (low, high); None = unbounded -------------
PHYSICAL_RANGES = {
    "negative_sentiment": (0.0, 1.0),
    "symptom_mention_rate": (0.0, 1.0),
    "humidity_pct": (0.0, 100.0),
    "precipitation_mm": (0.0, 500.0),
    "aqi": (0.0, 500.0),
    "pm25_ugm3": (0.0, 1000.0),
    "er_visits": (0.0, None),
    "pharmacy_sales": (0.0, None),
    "post_volume": (0.0, None),
    "wind_speed_kmh": (0.0, 300.0),
}

TARGET = "er_visits"
DIMENSION_COLUMNS = ("city", "state", "lat", "lon")

# --- Fixed values: feature defaults -----------------------------------------
LAG_DAYS = (1, 3, 7, 14)
LAG_COLUMNS = ("pharmacy_sales", "negative_sentiment", "aqi", "er_visits", "temperature_c")
ROLLING_WINDOWS = (3, 7, 14, 30)
ROLLING_COLUMNS = ("pharmacy_sales", "negative_sentiment", "er_visits", "aqi", "temperature_c")
ROLLING_STATS = ("mean", "std", "max")
CHANGE_PERIODS = (1, 7)
CHANGE_COLUMNS = ("pharmacy_sales", "er_visits", "negative_sentiment", "aqi")
CHANGE_LIMIT = 5.0
ANOMALY_COLUMNS = ("pharmacy_sales", "negative_sentiment", "er_visits", "aqi")
ANOMALY_WINDOW = 30
ANOMALY_MIN_VALUES = 5
ANOMALY_THRESHOLD = 2.5
SEASONAL_PERIOD = 7
COMFORT_TEMPERATURE_C = 18.0
STD_EPSILON = 1e-8

# --- Fixed values: composite score weights ----------------------------------
SCORE_WEIGHTS = {
    "pharmacy_sales": 0.30,
    "negative_sentiment": 0.25,
    "aqi": 0.20,
    "temp_extreme": 0.15,
    "anomaly_count": 0.10,
}
LOW_THRESHOLD = 0.33
MEDIUM_THRESHOLD = 0.66
RISK_LEVELS = ("High", "Medium", "Low")
RISK_COLORS = {"Low": "#2ecc71", "Medium": "#f39c12", "High": "#e74c3c"}
UNKNOWN_COLOR = "#95a5a6"

# --- Fixed values: air quality categories, (upper bound, label) --------------
AQI_CATEGORIES = (
    (50, "Good"),
    (100, "Moderate"),
    (150, "Unhealthy for Sensitive Groups"),
    (200, "Unhealthy"),
    (300, "Very Unhealthy"),
    (500, "Hazardous"),
)

# --- Fixed values: text keywords --------------------------------------------
SYMPTOM_KEYWORDS = ("sick", "fever", "hospital", "symptoms")
HEALTH_KEYWORDS = (
    "flu", "sick", "fever", "cough", "cold", "hospital", "ER",
    "COVID", "covid", "pandemic", "outbreak", "symptoms", "nausea",
    "vomiting", "infection", "quarantine", "positive test",
)
SEARCH_KEYWORDS = HEALTH_KEYWORDS[:5]
MENTION_FACTOR = 0.7

# --- Fixed values: hotspot defaults -----------------------------------------
CLUSTER_COLUMNS = ("pharmacy_sales", "negative_sentiment", "aqi", "er_visits", "disease_risk_score")
GEO_WEIGHT = 2.0
MIN_CLUSTER_SIZE = 3
MIN_SAMPLES = 2
CLUSTER_EPSILON = 0.5

# --- Fixed values: forecast defaults ----------------------------------------
REGRESSORS = ("temperature_c", "aqi", "pharmacy_sales", "negative_sentiment")
MIN_TRAINING_ROWS = 30
FORECAST_HORIZON = 30
INTERVAL_WIDTH = 0.90
YEARLY_ORDER = 10
WEEKLY_ORDER = 3
CHANGE_POINTS = 25
CHANGE_POINT_RANGE = 0.8
LOOKBACK = 14
PRIORITY_FEATURES = (
    "pharmacy_sales", "negative_sentiment", "aqi", "temperature_c",
    "humidity_pct", "day_of_week", "month", "season", "is_weekend",
    "pharmacy_sales_roll_7_mean", "er_visits_lag_1", "er_visits_lag_7",
    "disease_risk_score",
)
NON_FEATURES = ("date", "zipcode", "city", "state", "outbreak_event", "aqi_category")

# --- Fixed values: configured regions (zipcode, city, state, lat, lon) -------
REGIONS = (
    ("10001", "New York", "NY", 40.7484, -73.9967),
    ("90001", "Los Angeles", "CA", 33.9731, -118.2479),
    ("60601", "Chicago", "IL", 41.8858, -87.6181),
    ("77001", "Houston", "TX", 29.7543, -95.3677),
    ("85001", "Phoenix", "AZ", 33.4484, -112.0740),
    ("19101", "Philadelphia", "PA", 39.9526, -75.1652),
    ("78201", "San Antonio", "TX", 29.4241, -98.4936),
    ("75201", "Dallas", "TX", 32.7767, -96.7970),
    ("95101", "San Jose", "CA", 37.3382, -121.8863),
    ("78701", "Austin", "TX", 30.2672, -97.7431),
    ("32801", "Jacksonville", "FL", 30.3322, -81.6557),
    ("94102", "San Francisco", "CA", 37.7749, -122.4194),
    ("43201", "Columbus", "OH", 39.9612, -82.9988),
    ("28201", "Charlotte", "NC", 35.2271, -80.8431),
    ("46201", "Indianapolis", "IN", 39.7684, -86.1581),
)

# --- Fixed values: static lookup, the configured regions and ten more ---------
STATIC_LOOKUP = REGIONS + (
    ("98101", "Seattle", "WA", 47.6062, -122.3321),
    ("80202", "Denver", "CO", 39.7392, -104.9903),
    ("20001", "Washington", "DC", 38.9072, -77.0369),
    ("02101", "Boston", "MA", 42.3601, -71.0589),
    ("37201", "Nashville", "TN", 36.1627, -86.7816),
    ("97201", "Portland", "OR", 45.5051, -122.6750),
    ("89101", "Las Vegas", "NV", 36.1699, -115.1398),
    ("55401", "Minneapolis", "MN", 44.9778, -93.2650),
    ("85701", "Tucson", "AZ", 32.2540, -110.9742),
    ("30301", "Atlanta", "GA", 33.7490, -84.3880),
)
