"""Parameters and fixed values.

Thresholds default to the values the original pipeline publishes with; the
registered test queries pass scaled-down values because the test tables are
small (see FIXTURES.md part D).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# ---------------------------------------------------------------------------
# Fixed values (must equal the original pipeline's for identical results)
# ---------------------------------------------------------------------------
# Logical column names of the five source tables.
KENTEKEN = "kenteken"
VOERTUIGSOORT = "voertuigsoort"
MERK = "merk"
HANDELSBENAMING = "handelsbenaming"
DATUM_EERSTE_TOELATING = "datum_eerste_toelating"
CATALOGUSPRIJS = "catalogusprijs"
MELD_DATUM = "meld_datum_door_keuringsinstantie"
MELD_TIJD = "meld_tijd_door_keuringsinstantie"
SOORT_MELDING = "soort_melding_ki_omschrijving"
GEBREK_ID = "gebrek_identificatie"
GEBREK_OMSCHRIJVING = "gebrek_omschrijving"
AANTAL_GEBREKEN = "aantal_gebreken_geconstateerd"
BRANDSTOF = "brandstof_omschrijving"
VERVALDATUM_APK = "vervaldatum_apk"
VERVALDATUM_KEURING = "vervaldatum_keuring"

# Report kind that marks a periodic inspection (compared after lower + strip).
PERIODIC_REPORT_KIND = "periodieke controle"
# Vehicle kinds and the usage groups they map to.
KIND_PASSENGER = "Personenauto"
KIND_COMMERCIAL = "Bedrijfsauto"
GROUP_CONSUMER = "consumer"
GROUP_COMMERCIAL = "commercial"
GROUP_OTHER = "other"
# Fuel descriptions that are recognised; everything else is bucketed.
FUEL_PETROL = "Benzine"
FUEL_DIESEL = "Diesel"
FUEL_ELECTRIC = "Elektriciteit"
FUEL_LPG = "LPG"
FUEL_HYBRID = "Hybrid"
FUEL_OTHER_PRIMARY = "Other"
FUEL_OTHER_BUCKET = "other"
KNOWN_FUEL_TYPES = (FUEL_PETROL, FUEL_DIESEL, FUEL_ELECTRIC, FUEL_LPG)
FUEL_BREAKDOWN_FIELDS = (FUEL_PETROL, FUEL_DIESEL, FUEL_ELECTRIC, FUEL_LPG, FUEL_OTHER_BUCKET)
# Description used when a defect code has no description.
UNKNOWN_DEFECT_DESCRIPTION = "Onbekend gebrek"
# Result text of a passed inspection.
PASS_MARKER = "Goedgekeurd"
# Sanity range of the age at inspection (inclusive).
AGE_MIN, AGE_MAX = 0, 100
# Segment keys.
BRAND_KEYS = (MERK, "vehicle_type_group", "primary_fuel")
MODEL_KEYS = (MERK, HANDELSBENAMING, "vehicle_type_group", "primary_fuel")
# Display defaults of the exploration views.
PAGE_SIZE = 50
TOP_BRANDS_CHART = 15
RELIABILITY_CHART_ITEMS = 15
LOOKUP_MAX_REPORTS = 50
LOOKUP_MAX_DEFECTS = 100
DEFAULT_AGE_WINDOW = (4, 30)
# Overlapping age bands named in the metrics documentation.
AGE_BANDS = (("4-7", 4, 7), ("8-12", 8, 12), ("13-20", 13, 20), ("5-15", 5, 15))


@dataclass(frozen=True)
class Thresholds:
    """Minimum group sizes; defaults are the original pipeline's."""

    brand: int = 100  # vehicles per (brand, type, fuel) segment
    model: int = 1  # vehicles per model across its segments
    age_bracket: int = 30  # vehicles per segment and age
    brand_ranking: int = 2000  # vehicles per brand in the ranking
    model_ranking: int = 100  # vehicles per model in the ranking
    yearly_trend: int = 10_000  # inspections per year
    fleet_age_vehicles: int = 100  # vehicles per age in the fleet curve
    fleet_age_min: int = 1
    fleet_age_max: int = 30
    top_codes: int = 50  # number of top defect codes
    ranking_size: int = 10  # entries per ranking list

    def with_(self, **kw) -> "Thresholds":
        return replace(self, **kw)


DEFAULT = Thresholds()
# Scaled values used by the registered queries at sf0.01 (FIXTURES.md, part D).
TEST_SF001 = Thresholds(
    brand=3, model=2, age_bracket=2, brand_ranking=30, model_ranking=2,
    yearly_trend=2300, fleet_age_vehicles=500, top_codes=50,
)
# Values used by ``entry()`` at sf0.001.
TEST_SF0001 = Thresholds(
    brand=1, model=1, age_bracket=1, brand_ranking=2, model_ranking=1,
    yearly_trend=1, fleet_age_vehicles=1, top_codes=5,
)
