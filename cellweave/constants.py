"""Fixed values.

Every value in this module has to equal what the surveyed toolkit uses, or the results differ.
Lists keep their natural order; nothing here is computed.
"""

# Unit conversions as (variable, target unit, source unit, scale, offset),
# converted = value * scale + offset.
CONVERSIONS = [
    ("tas", "C", "K", 1.0, -273.15),
    ("tmin", "C", "K", 1.0, -273.15),
    ("tmax", "C", "K", 1.0, -273.15),
    ("pr", "mm/day", "kg m-2 s-1", 86400.0, 0.0),
    ("sfcWind", "km/h", "m s-1", 3.6, 0.0),
]

# File-name prefixes that do not count when two files are compared.
FILE_PREFIXES = ["ScenarioMIP_250km_", "CMIP6_", "CMIP5_"]

# A file named "<one of these>_..." is preferred among copies.
PLAIN_VARIABLES = ["tas", "pr", "huss", "psl", "ts", "uas", "vas"]

# Global attributes of the catalog; the first four are required.
REQUIRED_ATTRS = ["activity_id", "source_id", "variant_label", "variable_id"]
CATALOG_ATTRS = REQUIRED_ATTRS + ["institution_id"]

# The demonstration crop box, degrees.
DEMO_BOX = {"min_lat": 25.0, "max_lat": 50.0, "min_lon": -125.0, "max_lon": -65.0}

# Named areas of interest as north, south, east, west.
AREAS_OF_INTEREST = {
    "corn_belt": (49.5, 35.8, -80.4, -104.5),
    "iowa": (43.5, 40.3, -90.1, -96.7),
    "conus": (49.38, 24.52, -66.93, -124.78),
}

# Month of the representative day of seasons 1 (DJF) to 4 (SON).
SEASON_MONTHS = [2, 5, 8, 11]

# Search facets sent per project, as (setting, facet).
CMIP6_FACETS = [
    ("project", "project"),
    ("activity", "activity_id"),
    ("experiment", "experiment_id"),
    ("frequency", "frequency"),
    ("variable", "variable_id"),
    ("model", "source_id"),
    ("ensemble", "variant_label"),
    ("grid_label", "grid_label"),
    ("resolution", "nominal_resolution"),
]
CMIP5_FACETS = [
    ("project", "project"),
    ("model", "model"),
    ("institute", "institute"),
    ("experiment", "experiment"),
    ("experiment_family", "experiment_family"),
    ("frequency", "time_frequency"),
    ("realm", "realm"),
    ("variable", "variable"),
    ("ensemble", "ensemble"),
]
PREFERRED_NODE = "DKRZ"

# daily/monthly climate grids, address and resolution codes.
PRISM_BASE_URL = "https://data.prism.oregonstate.edu/time_series/us/an"
PRISM_RESOLUTION_CODES = {"800m": "30s", "4km": "25m"}

# Elevation tile buckets, regions and key layouts.
COP30_BUCKET, COP30_REGION = "copernicus-dem-30m", "eu-central-1"
USGS_BUCKET, USGS_REGION = "prd-tnm", "us-west-2"
USGS_CURRENT = "StagedProducts/Elevation/13/TIFF/current/"
USGS_HISTORICAL = "StagedProducts/Elevation/13/TIFF/historical/"

ERA5_BUCKET = "nsf-ncar-era5"

# Reanalysis variables as (code, folder, file code, description).
# A code with several rows is a composite; its parts are in order.
_AN = "e5.oper.an.sfc"
_ACC = "e5.oper.fc.sfc.accumu"
ERA5_VARIABLES = [
    # temperature and heat
    ("t2m", _AN, "128_167_2t", "2m Air Temperature"),
    ("2m_temperature", _AN, "128_167_2t", "2m Air Temperature"),
    ("d2m", _AN, "128_168_2d", "2m Dewpoint Temperature"),
    ("skt", _AN, "128_235_skt", "Skin Temperature"),
    ("sst", _AN, "128_034_sstk", "Sea Surface Temperature"),
    ("stl1", _AN, "128_139_stl1", "Soil Temperature Level 1"),
    ("stl2", _AN, "128_170_stl2", "Soil Temperature Level 2"),
    ("stl3", _AN, "128_183_stl3", "Soil Temperature Level 3"),
    ("stl4", _AN, "128_236_stl4", "Soil Temperature Level 4"),
    ("istl1", _AN, "128_035_istl1", "Ice Temperature Layer 1"),
    ("istl2", _AN, "128_036_istl2", "Ice Temperature Layer 2"),
    ("istl3", _AN, "128_037_istl3", "Ice Temperature Layer 3"),
    ("istl4", _AN, "128_038_istl4", "Ice Temperature Layer 4"),
    ("tsn", _AN, "128_238_tsn", "Temperature of Snow Layer"),
    # precipitation and water
    ("precip", _ACC, "128_143_cp", "Convective Precipitation (1/2)"),
    ("precip", _ACC, "128_142_lsp", "Large Scale Precipitation (2/2)"),
    ("total_precipitation", _ACC, "128_143_cp", "Convective Precipitation (1/2)"),
    ("total_precipitation", _ACC, "128_142_lsp", "Large Scale Precipitation (2/2)"),
    ("cp", _ACC, "128_143_cp", "Convective Precipitation"),
    ("lsp", _ACC, "128_142_lsp", "Large Scale Precipitation"),
    ("csf", _ACC, "128_239_csf", "Convective Snowfall"),
    ("lsf", _ACC, "128_240_lsf", "Large Scale Snowfall"),
    ("sf", _ACC, "128_144_sf", "Snowfall"),
    ("tcw", _AN, "128_136_tcw", "Total Column Water"),
    ("tcwv", _AN, "128_137_tcwv", "Total Column Water Vapour"),
    ("tclw", _AN, "128_078_tclw", "Total Column Cloud Liquid Water"),
    ("tciw", _AN, "128_079_tciw", "Total Column Cloud Ice Water"),
    ("tcrw", _AN, "228_089_tcrw", "Total Column Rain Water"),
    ("tcsw", _AN, "228_090_tcsw", "Total Column Snow Water"),
    ("tcc", _AN, "128_164_tcc", "Total Cloud Cover"),
    ("lcc", _AN, "128_186_lcc", "Low Cloud Cover"),
    ("mcc", _AN, "128_187_mcc", "Medium Cloud Cover"),
    ("hcc", _AN, "128_188_hcc", "High Cloud Cover"),
    ("e", _ACC, "128_182_e", "Evaporation"),
    ("pev", _ACC, "228_251_pev", "Potential Evaporation"),
    ("es", _ACC, "128_044_es", "Snow Evaporation"),
    ("smlt", _ACC, "128_045_smlt", "Snowmelt"),
    ("ro", _ACC, "128_205_ro", "Runoff"),
    ("sro", _ACC, "128_008_sro", "Surface Runoff"),
    ("ssro", _ACC, "128_009_ssro", "Sub-surface Runoff"),
    ("swvl1", _AN, "128_039_swvl1", "Volumetric Soil Water Layer 1"),
    ("swvl2", _AN, "128_040_swvl2", "Volumetric Soil Water Layer 2"),
    ("swvl3", _AN, "128_041_swvl3", "Volumetric Soil Water Layer 3"),
    ("swvl4", _AN, "128_042_swvl4", "Volumetric Soil Water Layer 4"),
    # wind and pressure
    ("u10", _AN, "128_165_10u", "10m U-Component of Wind"),
    ("v10", _AN, "128_166_10v", "10m V-Component of Wind"),
    ("100u", _AN, "228_246_100u", "100m U-Component of Wind"),
    ("100v", _AN, "228_247_100v", "100m V-Component of Wind"),
    ("sp", _AN, "128_134_sp", "Surface Pressure"),
    ("msl", _AN, "128_151_msl", "Mean Sea Level Pressure"),
    ("iews", _AN, "128_229_iews", "Instantaneous Eastward Wind Stress"),
    ("inss", _AN, "128_230_inss", "Instantaneous Northward Wind Stress"),
    ("ewss", _ACC, "128_180_ewss", "Eastward Turbulent Surface Stress"),
    ("nsss", _ACC, "128_181_nsss", "Northward Turbulent Surface Stress"),
    # radiation and fluxes
    ("ssrd", _ACC, "128_169_ssrd", "Surface Solar Radiation Downwards"),
    ("ssrdc", _ACC, "228_129_ssrdc", "Surface Solar Radiation Downwards, Clear Sky"),
    ("ssr", _ACC, "128_176_ssr", "Surface Net Solar Radiation"),
    ("ssrc", _ACC, "128_210_ssrc", "Surface Net Solar Radiation, Clear Sky"),
    ("tsr", _ACC, "128_178_tsr", "Top Net Solar Radiation"),
    ("tisr", _ACC, "128_212_tisr", "TOA Incident Solar Radiation"),
    ("fdir", _ACC, "228_021_fdir", "Total Sky Direct Solar Radiation"),
    ("cdir", _ACC, "228_022_cdir", "Clear-sky Direct Solar Radiation"),
    ("fal", _AN, "128_243_fal", "Forecast Albedo"),
    ("strd", _ACC, "128_175_strd", "Surface Thermal Radiation Downwards"),
    ("strdc", _ACC, "228_130_strdc", "Surface Thermal Radiation Downwards, Clear Sky"),
    ("str", _ACC, "128_177_str", "Surface Net Thermal Radiation"),
    ("strc", _ACC, "128_211_strc", "Surface Net Thermal Radiation, Clear Sky"),
    ("ttr", _ACC, "128_179_ttr", "Top Net Thermal Radiation"),
    ("sshf", _ACC, "128_146_sshf", "Surface Sensible Heat Flux"),
    ("slhf", _ACC, "128_147_slhf", "Surface Latent Heat Flux"),
    ("ishf", _AN, "128_231_ishf", "Instantaneous Surface Sensible Heat Flux"),
    ("ie", _AN, "128_232_ie", "Instantaneous Moisture Flux (Evaporation)"),
    # other surface and vegetation
    ("lsm", _AN, "128_172_lsm", "Land-Sea Mask"),
    ("sd", _AN, "128_141_sd", "Snow Depth"),
    ("asn", _AN, "128_032_asn", "Snow Albedo"),
    ("rsn", _AN, "128_033_rsn", "Snow Density"),
    ("ci", _AN, "128_031_ci", "Sea Ice Cover"),
    ("lailv", _AN, "128_066_lailv", "Leaf Area Index, Low Vegetation"),
    ("laihv", _AN, "128_067_laihv", "Leaf Area Index, High Vegetation"),
    ("cape", _AN, "128_059_cape", "Convective Available Potential Energy"),
    ("blh", _AN, "128_159_blh", "Boundary Layer Height"),
    ("tco3", _AN, "128_206_tco3", "Total Column Ozone"),
    ("fsr", _AN, "128_244_fsr", "Forecast Surface Roughness"),
]

# WGS84 ellipsoid and the standard parallel of the equal-area grid (EPSG:6933).
WGS84_A = 6378137.0
WGS84_INV_F = 298.257223563
EQUAL_AREA_PARALLEL = 30.0
