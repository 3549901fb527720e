"""Tables of the listing store and the domains of their columns."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
SIZE = T.DecimalType(8, 2)
TIME = T.TimestampNTZType()

NOT_AVAILABLE = "Not Available"
#: Facts that are true, false or not known.
TRI_STATE = ("open_plan_kitchen", "elevator", "parking", "furnished", "air_conditioning", "balcony", "renovated", "storage", "water_view", "near_metro", "has_usage_license", "has_pool", "has_garden")
#: Known sources, statuses and channels, in their order (fixed values).
SOURCES = ("Idealista", "ImoVirtual", "CustoJusto", "CasaSapo", "CaixaImobiliario", "Santander")
STATUSES = ("Interested", "Contacted", "Waiting", "Rejected")
CHANNELS = ("Email", "Phone", "WhatsApp", "SMS")


def _struct(spec: str) -> T.StructType:
    """A schema from lines of "name type"; a name ending in ! is not null."""
    kinds = {"int": T.IntegerType(), "long": T.LongType(), "string": T.StringType(), "double": T.DoubleType(), "bool": T.BooleanType(), "money": MONEY, "size": SIZE, "time": TIME, "strings": T.ArrayType(T.StringType())}
    fields = [x.split() for x in spec.strip().splitlines()]
    return T.StructType([T.StructField(name.rstrip("!"), kinds[kind], not name.endswith("!")) for name, kind in fields])


_FACTS = "\n".join(f"{name} bool" for name in TRI_STATE)

PROPERTY = _struct(f"""
id! long
url! string
source! string
price money
size_m2 size
condo_fee_monthly size
location_string string
distrito string
concelho string
freguesia string
lat double
lng double
beds int
baths int
total_floors int
year_built int
description string
floor string
sun_orientation! string
orientation_source! string
construction_status! string
{_FACTS}
energy_rating string
photos strings
agent_name string
agent_phone string
agent_email string
source_property_id string
dedup_hash! string
created_at! time
last_seen_at! time
first_scraped_at time
ai_enriched_at time
""")
MY_LISTING = _struct("""
id! long
property_id! long
status! string
notes string
agent_name string
agent_phone string
agent_email string
asked_about_orientation bool
asked_about_open_plan_kitchen bool
follow_up_date time
date_added! time
last_updated! time
""")
PROPERTY_SOURCE = _struct("""
id! long
property_id! long
source! string
url! string
price money
first_seen_at! time
last_seen_at! time
""")
PRICE_HISTORY = _struct("""
id! long
property_id! long
old_price! money
new_price! money
changed_at! time
""")
#: Which listings have a hash, where they are looked up by it.
LISTING_HASH = _struct("""
dedup_hash! string
id! long
source! string
last_seen_at! time
""")
COMM_HISTORY = _struct("""
id! long
my_listing_id! long
channel! string
direction! string
subject string
message! string
created_at! time
""")
SCRAPER_RUN = _struct("""
id! long
source! string
run_start_time! time
run_end_time time
properties_found int
properties_added int
properties_updated int
properties_linked int
properties_skipped int
has_errors bool
errors strings
duration_seconds int
""")
APP_SETTING = _struct("""
districts strings
price_min money
price_max money
rooms_min int
rooms_max int
max_pages_per_source int
idealista_enabled bool
imovirtual_enabled bool
custojusto_enabled bool
casasapo_enabled bool
caixa_enabled bool
santander_enabled bool
log_file_path string
availability_text string
sender_name string
last_scraped_at time
updated_at time
""")
#: What a source parser returns: a listing before it is matched with the store.
CANDIDATE = T.StructType([f for f in PROPERTY.fields if f.name not in ("id", "dedup_hash", "created_at", "last_seen_at", "first_scraped_at", "ai_enriched_at")])
TABLES = {"property": PROPERTY, "my_listing": MY_LISTING, "property_source": PROPERTY_SOURCE, "price_history": PRICE_HISTORY, "comm_history": COMM_HISTORY, "scraper_run": SCRAPER_RUN, "app_setting": APP_SETTING}
