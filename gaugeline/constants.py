"""Column names and the values that results depend on."""

STATION = "clave_estacion"
DAY = "fecha"
QUALITY = "calidad"
SOURCE = "fuente"

# --- fixed values: the data contract -----------------------------------------
SENTINELS = (-9999.0, 99999.0)
KEY_PATTERN = r"^[0-9A-Za-z]{1,8}$"
SOURCES = ("SIH", "BANDAS", "CLICOM", "EMAS")
QUALITY_LABELS = ((0, "ok"), (1, "imputed"), (2, "outlier"))
WET_MONTHS = (5, 6, 7, 8, 9, 10)
LAGS = (1, 3, 7, 14, 30)
ROLLING = (7, 30)
EARTH_RADIUS_KM = 6371.0
OUTLIER_QUANTILE = 0.999
OUTLIER_FACTOR = 3.0
MAX_GAP = 7
DEFAULT_PERIOD = ("2010-01-01", "2025-12-31")
PILOT_REGIONS = ("12", "18", "26")
COVERAGE_HYDRO = 0.60
COVERAGE_CLIMATE = 0.80
COVERAGE_EXTENDED = 0.30
STORAGE_CAP_GB = 9.5

# Pilot basins: name, region, (min_lon, min_lat, max_lon, max_lat), DEM metres.
PILOT_BASINS = (
    ("Cutzamala", "18", (-100.7, 18.4, -99.4, 19.7), 30),
    ("Lerma Alto", "12", (-100.6, 19.2, -99.4, 20.0), 30),
    ("Bajio", "12", (-103.5, 20.0, -100.5, 21.5), 30),
    ("Santiago", "12", (-105.7, 20.5, -102.0, 22.7), 30),
    ("Panuco", "26", (-100.7, 18.9, -97.5, 24.1), 30),
    ("Alta del Balsas", "18", (-99.5, 18.0, -97.6, 19.5), 15),
)

# Publisher's file layout for catalogues and series.
PUBLISHER_BASE = "https://sih.conagua.gob.mx/basedatos/"
PUBLISHER_DIRS = {"hidrometricas": "Hidros", "climatologicas": "Climas"}
PUBLISHER_CATALOGS = {
    "hidrometricas": "0_Catalogo de estaciones hidrometricas.csv",
    "climatologicas": "0_Catalogo_de_estaciones_climatologicas.csv",
}

# Measurement columns and their admissible range (None = open).
SERIES_RANGES = {
    "gasto_medio_m3s": (0.0, None),
    "nivel_m": (None, None),
    "precip_mm": (0.0, None),
    "tmax_c": (-30.0, 60.0),
    "tmin_c": (-40.0, 50.0),
    "tmed_c": (-40.0, 55.0),
    "evap_mm": (0.0, None),
}
CATALOG_RANGES = {
    "latitud": (14.0, 33.0),
    "longitud": (-118.5, -86.0),
    "altitud": (-50.0, None),
}
CATALOG_COLUMNS = (
    "clave", "nombre", "latitud", "longitud", "altitud",
    "estado", "municipio", "region_hidrologica", "cuenca",
)

# Header rules: a column takes the first free target with a matching rule. A rule
# is a list of alternatives; an alternative is a list of tests that must all hold.
# "^x" starts with x, "~x" contains x, "=x" equals x, "^^x" starts with x once
# dots and blanks are taken out.
SERIES_RULES = (
    ("fecha", (("^fecha",),)),
    ("gasto_medio_m3s", (("~gasto",),)),
    ("nivel_m", (("~nivel",),)),
    ("precip_mm", (("~precip",),)),
    ("tmax_c", (("~temp", "~max"),)),
    ("tmin_c", (("~temp", "~min"),)),
    ("tmed_c", (("~temp", "~media"), ("~temp", "~amb"))),
    ("evap_mm", (("~evap",),)),
)
CATALOG_RULES = (
    ("clave", (("^clave",),)),
    ("nombre", (("^nombre",),)),
    ("latitud", (("^latitud",),)),
    ("longitud", (("^longitud",),)),
    ("altitud", (("^altitud",),)),
    ("estado", (("=estado",),)),
    ("municipio", (("^municipio",),)),
    ("region_hidrologica", (("^^rh",), ("~region", "~num"))),
    ("cuenca", (("^cuenca",),)),
)

# Mexico ITRF2008 / LCC on GRS80 (EPSG:6372).
LCC_MEXICO = {
    "a": 6378137.0, "inv_f": 298.257222101,
    "lat0": 12.0, "lon0": -102.0, "lat1": 17.5, "lat2": 29.5,
    "false_easting": 2500000.0, "false_northing": 0.0,
}
# --- end of fixed values ------------------------------------------------------
