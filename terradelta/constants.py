"""Every published threshold, table and word list the operators share, in one place."""

# --- Fixed values: physics thresholds (dB, normalised indices) --------------------------------
VV_WATER_DB = -18.0
VV_DROP_DB = 3.0
VV_DROP_CEILING_DB = -11.0
MNDWI_WATER = 0.0
DNBR_BURN = 0.10
DNBR_SEVERITY = (0.10, 0.27, 0.44, 0.66)
NDVI_FUEL = 0.10
NDVI_DROP = 0.20
NDVI_CANOPY = 0.5
VH_DROP_DB = 2.0
VH_CANOPY_DB = -17.0
SAR_ONLY_BURN_UNCERTAINTY = 0.5
CHANGE_DB = 3.0
CHANGE_INDEX = 0.2
PRE_WATER_THRESHOLD = 0.8
WEAK_HIGH, WEAK_LOW = 0.9, 0.1
IGNORE = 255

# --- Fixed values: acquisition -----------------------------------------------------------------
PIPELINE_VERSION = "0.1.0"
SENSORS = ("s1", "s2")
PERIODS = ("pre", "post")
S1_BANDS = ("vv", "vh")
S2_BANDS = ("b02", "b03", "b04", "b08", "b11", "b12")
BANDS = {"s1": S1_BANDS, "s2": S2_BANDS}
S2_INVALID_SCL = (0, 1, 3, 8, 9, 10)
S2_MIN_USABLE = 0.02
S2_OFFSET_BASELINE, S2_OFFSET_DN, S2_SCALE = 4.0, -1000.0, 10000.0
MIN_VALID_FRACTION = 0.01
MAX_SCENES = 4
MAX_S2_CLOUD = 60.0
STAC_PROJECTION = "https://stac-extensions.github.io/projection/v1.1.0/schema.json"
COLLECTIONS = {"s1": "sentinel-1-rtc", "s2": "sentinel-2-l2a", "dem": "cop-dem-glo-30", "mtbs": "mtbs"}

# --- Fixed values: requests ----------------------------------------------------------------------
SENSOR_ALIASES = {
    "s1": "s1", "sentinel-1": "s1", "sentinel1": "s1",
    "s2": "s2", "sentinel-2": "s2", "sentinel2": "s2",
}
MIN_AOI_KM2, MAX_AOI_KM2 = 0.01, 1000.0
MAX_WINDOW_DAYS = 120
MAX_SEASON_GAP_DAYS = 45
MIN_RES, MAX_RES = 10.0, 100.0

# --- Fixed values: results -----------------------------------------------------------------------
THRESHOLD = 0.5
REVIEW_UNCERTAINTY = 0.8
SEVERITY_CLASSES = ("low", "moderate-low", "moderate-high", "high")
SIEVE_PIXELS = 20
TASKS = {
    "flood": {"title": "Flood inundation", "target": "flood", "verb": "flooded",
              "composite": ("median", "first"), "scenes": "closest", "seasonal": False},
    "wildfire": {"title": "Wildfire / burn", "target": "burn", "verb": "burned",
                 "composite": ("median", "median"), "scenes": "closest", "seasonal": False},
    "vegetation": {"title": "Vegetation disturbance", "target": "disturbance", "verb": "disturbed",
                   "composite": ("median", "median"), "scenes": "spread", "seasonal": True},
}

# --- Fixed values: map colours (value, (r, g, b, a)) ---------------------------------------------
TARGET_COLORS = {
    "flood": ((40, 120, 255), (20, 90, 255)),
    "burn": ((235, 70, 30), (200, 20, 10)),
    "disturbance": ((190, 70, 235), (150, 30, 220)),
}
PALETTES = {
    "change": [(0.2, (255, 170, 0, 0)), (0.5, (255, 170, 0, 140)), (1.0, (255, 120, 0, 230))],
    "uncertainty": [(0.0, (60, 20, 90, 0)), (0.3, (120, 40, 140, 110)), (0.7, (230, 80, 90, 190)),
                    (1.0, (255, 210, 60, 230))],
}
SEVERITY_RGBA = [(0, 0, 0, 0), (127, 255, 212, 220), (255, 255, 0, 220), (255, 140, 0, 230), (255, 0, 0, 235)]

# --- Fixed values: model inputs and evaluation ------------------------------------------------------
NORM_MEAN = {"s1": (-12.0, -19.0), "s2": (0.08, 0.10, 0.10, 0.25, 0.20, 0.14)}
NORM_STD = {"s1": (5.0, 5.0), "s2": (0.06, 0.06, 0.08, 0.10, 0.10, 0.09)}
ELEV_SCALE, SLOPE_SCALE = 20.0, 10.0
BASELINE_ID, BASELINE_VERSION = "threshold-baseline", "1.1.0"
WINDOW_SIZE, WINDOW_STRIDE = 256, 192
MIN_LABELED = 0.02
GFC_FOREST = 30
ECE_BINS = 15
SENSOR_SUBSETS = {"s1+s2": ("s1", "s2"), "s1 only": ("s1",), "s2 only": ("s2",)}
TEMPERATURE_MIN, TEMPERATURE_MAX, TEMPERATURE_STEPS = 0.25, 4.0, 61

# --- Fixed values: event feeds ----------------------------------------------------------------------
HAZARD_CODES = {"FL": "flood", "WF": "wildfire", "Flood": "flood", "Wildfire": "wildfire"}
EONET_CATEGORIES = {"wildfires": "wildfire", "floods": "flood"}
MIN_FIRE_HA = 10_000
MIN_FIRE_ACRES = 1000
HAZARD_WORDS = {
    "vegetation": r"deforest|logging|forest (loss|clearing)|clear-?cut|land clearing",
    "wildfire": r"wildfire|bush ?fire|forest fire|brush ?fire|grass ?fire|blaze|burn",
    "flood": r"flood|inundat|deluge|overflow|submerg",
}
HAZARD_TURNS = ("flood", "wildfire", "vegetation")
MIN_ARTICLE_CHARS, MIN_SELECTED_CHARS = 400, 500
MIN_QUOTE_CHARS = 20
SPECULATIVE = r"\b(watch(es)?|warnings?|forecasts?|risk of|threat of|expected to|outlook|advisor(y|ies))\b"
TOO_VAGUE = ("country", "state", "region", "province", "continent", "ocean", "sea")
PLACE_KINDS = ("place", "boundary", "natural", "waterway", "water", "leisure", "landuse")
MAX_PLACE_KM = 150.0
MAX_PLACE_RANK = 30
DATE_LOOKBACK_DAYS, DATE_LOOKAHEAD_DAYS = 60, 1

# --- Fixed values: cases ----------------------------------------------------------------------------
EARTH_KM = 6371.0088
MERGE_KM = 50.0
MERGE_DAYS = 10
KEEP_DAYS = 45
POINT_KM, MIN_SIDE_KM, MAX_SIDE_KM = 15.0, 5.0, 30.0
SOURCE_PRIORITY = {"cems": 0, "gdacs": 1, "eonet": 2, "news": 3}
CASE_STATUS_ORDER = ("ready", "partial imagery", "waiting for imagery", "too recent")
CASE_LABEL = {"flood": "Flood", "wildfire": "Wildfire", "vegetation": "Forest loss"}
JOB_STATUSES = ("queued", "running", "succeeded", "failed", "cancelled")
