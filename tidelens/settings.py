"""Thresholds and fixed value tables."""

from __future__ import annotations

from dataclasses import dataclass

LEVELS = ("none", "low", "medium", "high")
LEADS = (7, 14, 21)
HORIZONS = (0, 24, 48, 72)
EARTH_KM = 6371.0
KM_PER_DEG = 111.32
LEGACY_VERSION = "legacy"
LOCAL_OFFSET_HOURS = -4  # fixed all year, no daylight saving


@dataclass(frozen=True)
class RiskBands:
    """Area bars in km2 for a zone or beach forecast."""

    minimum: float = 0.5
    low_max: float = 5.0
    medium_max: float = 25.0
    high_eta_hours: int = 24
    member_share: float = 0.5

    def scaled(self, factor: float) -> "RiskBands":
        return RiskBands(self.minimum * factor, self.low_max * factor, self.medium_max * factor,
                         self.high_eta_hours, self.member_share)


ZONE_BANDS = RiskBands()
BEACH_BANDS = RiskBands(minimum=0.1)
MEMBERS = 24
BEACH_STOP_KM = 10.0
ARRIVAL_KM = 3.0
ZONE_COAST_KM = 40.0
PRESENT_HOURS = 48
MAX_AGE_DAYS = 8
WIND_FACTOR = 0.01
QUICK_WIND_FACTOR = 0.02
COVERAGE_KM = 54.0
POSSIBLE_SHARE = 0.15


@dataclass(frozen=True)
class NearbyBands:
    """Bars for risk read from masses near one beach."""

    radius_km: float = 25.0
    imminent_km: float = 8.0
    minimum: float = 0.3
    low_max: float = 3.0
    medium_max: float = 12.0


NEARBY = NearbyBands()

# Optical bands and detection bars.
BAND_NM = {"red": 665.0, "nir": 842.0, "swir": 1610.0}
REFLECTANCE_SCALE = 10000.0
BAD_SCENE_CLASSES = (0, 1, 3, 8, 9, 10, 11)
QUALITY_MIN = 0.6
INDEX_ANOMALY_MIN = 0.005
INDEX_DENSE_MIN = 0.02
NDVI_MIN = 0.02
MIN_PATCH_KM2 = 0.05
FULL_COVER_INDEX = 0.08
MAX_SCENE_CLOUD = 60.0
COAST_BUFFER_M = 300.0

# Daily grid check.
GRID_ANOMALY_MIN = 0.001
GRID_WINDOW = 21
GRID_EDGE_CELLS = 2
GRID_SATURATED = 0.0039
GRID_MIN_CELLS = 2
GRID_FULL_COVER = 0.0869
GRID_MATCH_KM = 15.0
GRID_DEFAULT_STEP = 0.015
GRID_SOURCE = "usf-afai"
SCENE_SOURCE = "sentinel-2"

# Coast regions, month index, exposure and seaward bearing.
EAST = "East (Punta Cana / La Romana)"
NORTH = "North (Puerto Plata / Cabarete)"
SAMANA = "Samaná Peninsula"
SOUTH = "South (Santo Domingo / South Coast)"
SOUTHWEST = "Southwest (Barahona / Pedernales)"
REGION_ORDER = (EAST, NORTH, SAMANA, SOUTH, SOUTHWEST)
MONTH_INDEX = {1: 0.12, 2: 0.15, 3: 0.30, 4: 0.50, 5: 0.72, 6: 0.90,
               7: 1.00, 8: 0.88, 9: 0.60, 10: 0.38, 11: 0.22, 12: 0.13}
REGION_EXPOSURE = {EAST: 1.00, NORTH: 0.90, SAMANA: 0.70, SOUTH: 0.50, SOUTHWEST: 0.50}
DEFAULT_EXPOSURE = 0.7
SEASON_BANDS = ((0.15, "none"), (0.35, "low"), (0.60, "medium"))
REGION_BEARING = {NORTH: 10, EAST: 85, SAMANA: 355, SOUTH: 185, SOUTHWEST: 215}
DEFAULT_BEARING = 90

# Rating of surf and wind.
GLASSY_KT = 3.0
WIND_FULL_KT = 20.0
RATING_BANDS = ((0.5, "flat"), (3.0, "poor"), (5.5, "fair"), (8.5, "good"))
PERIOD_KNOTS = ((4.0, 0.40), (6.0, 0.60), (8.0, 0.80), (10.0, 0.95), (12.0, 1.00))
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE",
           "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
SHELTERED_WORDS = ("calm", "sheltered", "protected", "lagoon", "tidal pool",
                   "reef-protected", "reef-guarded", "bay water")
EXPOSED_WORDS = ("surf", "strong", "current", "open atlantic", "open water", "chop", "wave", "rip")
WIND_ACTIVITIES = ("Kitesurfing", "Windsurfing", "Foiling")

# Words for amounts.
AMOUNT_WORDS = {"nada": "none", "ninguno": "none", "limpia": "none", "none": "none",
                "poco": "low", "poquito": "low", "low": "low",
                "bastante": "medium", "moderado": "medium", "medium": "medium",
                "mucho": "high", "muchisimo": "high", "high": "high"}

MONTHS = ("january", "february", "march", "april", "may", "june", "july",
          "august", "september", "october", "november", "december")

# Ranking and ingest caps.
FEATURED = 3
SPECIES_TOTAL = 8
CANDIDATES_PER_BEACH = 12
THUMBNAILS_PER_BEACH = 8
PHOTOS_PER_GROUP = 10
SAME_GROUP_IN_TOP = 2
PLANTS_IN_TOP = 1
PLANT_GROUP = "Plantae"
SENSITIVE_PRIVACY = ("obscured", "private")
LOCAL_PLACES = (6931, 97394)

ALERT_COOLDOWN_HOURS = 6
LIMIT_WINDOW_S = 60
LIMIT_REQUESTS = 10
MIN_REPORT_ROWS = 150
MIN_TRAIN_ROWS = 40
REPORT_HOUR_UTC = 16
ASOF_TOLERANCE_H = 12
PAIR_TOLERANCE_H = 2
