"""Fixed values that must equal the reference workflow's for equal results.

They are stated once, here, in the order the workflow uses them.
"""

# --- fixed values -------------------------------------------------------------
# Household key used across all tables.
KEY = "ehhn"
# Source name of the household key in campaign tables, renamed to KEY on load.
SOURCE_KEY = "HSHD_CODE"
# Campaign score column and its renamed form.
SOURCE_SCORE = "campaign_score"
SCORE = "ngr_score"
# Event time of an impression.
EVENT_TIME = "LogEntryTime"

# The thirteen impression-log columns kept after the union of the yearly logs.
IMPRESSION_COLUMNS = [
    "AuctionType", "ehhn", "LogEntryTime", "DeviceMake", "DeviceModel", "DeviceType",
    "Browser", "UserHourOfWeek", "SupplyVendor", "TemperatureInCelsius", "AdFormat",
    "Region", "Site",
]

# The nine categorical columns that are ordinal-encoded, in this order.
CATEGORICAL_FEATURES = [
    "DeviceMake", "Region", "DeviceModel", "DeviceType", "Browser", "SupplyVendor",
    "AuctionType", "AdFormat", "Site",
]

# Columns removed from the training frame (identifiers, times, costs and other
# labels). Written as given, including the repeated "dense_rank".
EXCLUDED_TRAINING_COLUMNS = [
    "CAMP_END_DATE", "ehhn", "ExpDT", "TDID", "RenderingContext", "KPMID", "ImpressionId",
    "CAMP_START_DATE", "CampaignId", "CampaignName", "AdvertiserId", "LogEntryTime", "id",
    "CUST_IDX", "dense_rank", "MatchedFoldPosition", "emb", "TTDCostInUSDollars",
    "PartnerCostInUSDollars", "IDLS", "ED", "AdvertiserCostInUSDollars", "KPM_PROJECT_ID",
    "cycle_date", "TTD_COOKIES", "effo_hh_id", "Recency", "Device_ID", "DataUsageTotalCost",
    "trn_dt", "trn_tm", "gtin_no", "dense_rank", "HSHD_CODE", "campaign_id", "UPC_ID",
    "ngr_campainid", "sales_conversion_ori", "FeeFeaturesCost", "clickthrough_conversion",
    "viewthrough_nonclk_conversion", "sales_conversion", "net_spend_amt", "cust_visits",
]

# Label of the bid-price model: source cost column and its training name.
SOURCE_LABEL = "MediaCostInBucks"
LABEL = "biddingprice"

# Second-price label shift: label - SHIFT_BASE + u, u ~ U(0, SHIFT_SPAN) drawn once.
SHIFT_BASE = 0.0006
SHIFT_SPAN = 0.0008

# Train / validation / test cut points (cumulative fractions).
SPLIT_FRACTIONS = (0.60, 0.80)

# A household "converts" when P(class 1) is strictly above this.
CONVERSION_THRESHOLD = 0.5

# Run stamp: month, day, year, hour.
RUN_STAMP_PYTHON = "%m%d%Y%H"
RUN_STAMP_SPARK = "MMddyyyyHH"

# Bid output and conversion output columns.
BID_COLUMN = "basebid"
CONVERSION_COLUMN = "sales_conversion"

# --- end of fixed values -------------------------------------------------------

# Ordinal codes for values not seen at fit time and for nulls not seen at fit time.
UNKNOWN_CODE = -1
NULL_CODE = -2
