"""Column names, alias lists and other fixed values of the ad data model."""

from __future__ import annotations

# ---------------------------------------------------------------- fixed values
# Canonical column -> accepted source names, in order of preference.
COLUMN_ALIASES = {
    "campaign_id": ["campaign_id", "campaignid", "campaignID"],
    "ad_group_id": ["ad_group_id", "adgroup_id", "adset_id", "adsetid"],
    "date_start": ["ad_group_start_date", "adgroup_start_date", "date_start", "start_time", "ad_delivery_start_time"],
    "date_stop": ["ad_group_end_date", "adgroup_end_date", "date_stop", "end_date", "ad_delivery_stop_time"],
    "campaign_start": ["campaign_start_date", "campaign_start", "campaign_start_time"],
    "campaign_end": ["campaign_end_date", "campaign_end", "campaign_end_time"],
    "impressions": ["impressions"],
    "reach": ["reach", "unique_impressions"],
    "clicks": ["clicks", "link_clicks"],
    "actions": ["actions", "conversions", "total_actions"],
    "conversion_value": ["conversion_value", "value", "purchase_value"],
    "cost": ["cost", "spend", "amount_spent", "total_spent"],
    "profile": ["profile", "page_name", "account_name", "advertiser_name"],
}

# Columns the ads-level feature table starts from.
AD_COLUMNS = [
    "profile",
    "campaign_objective",
    "creative_call_to_action_type",
    "impression_device",
    "ad_group_start_date",
    "ad_group_end_date",
    "campaign_start_date",
    "campaign_end_date",
    "cost",
    "actions",
    "clicks",
    "impressions",
    "conversion_value",
    "reach",
]

# Row identity for the campaign-level dedupe.
DEDUPE_KEY = [
    "campaign_id", "ad_group_id", "date_start", "date_stop",
    "impressions", "reach", "clicks", "actions", "conversion_value", "cost",
]

METRICS = ["cost", "impressions", "reach", "clicks", "actions", "conversion_value"]

# Campaign-level prediction targets and ads-level prediction targets.
CAMPAIGN_TARGETS = ["impressions", "reach", "clicks", "actions", "conversion_value"]
SCORE_TARGETS = ["impressions", "clicks", "actions", "reach", "conversion_value"]
LOG_TARGETS = [
    "impressions_log1p",
    "clicks_log1p",
    "actions_log1p",
    "reach_log1p",
    "conversion_value_log1p",
]

# Plausible span of each prediction on the log scale.
LOG_RANGES = {
    "impressions": (-1.0, 15.0),
    "clicks": (-1.0, 12.0),
    "actions": (-1.0, 10.0),
    "reach": (-1.0, 15.0),
    "conversion_value": (-1.0, 12.0),
}
DEFAULT_LOG_RANGE = (-1.0, 10.0)

# Units per currency unit above which a prediction is implausible.
UNITS_PER_DOLLAR = {"clicks": 50, "impressions": 500, "actions": 5}
DEFAULT_CHECK_BUDGET = 250.0

# Accepted date spellings, tried in this order (day before month).
DATE_FORMATS = ["yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "yyyy/M/d", "d-M-yyyy"]

# Category values known to the scoring models.
SCORING_VOCABULARY = {
    "campaign_objective_norm": [
        "app_installs", "brand_awareness", "conversions", "event_responses",
        "lead_generation", "link_clicks", "messages", "outcome_app_promotion",
        "outcome_awareness", "outcome_engagement", "outcome_leads",
        "outcome_sales", "outcome_traffic", "page_likes", "post_engagement",
        "product_catalog_sales", "reach", "store_visits", "video_views",
    ],
    "cta_type_norm": [
        "", "apply_now", "book_travel", "buy_tickets", "call_now", "contact_us",
        "download", "event_rsvp", "get_directions", "get_offer",
        "get_offer_view", "get_promotions", "instagram_message",
        "install_mobile_app", "learn_more", "like_page", "listen_now",
        "message_page", "no_button", "order_now", "play_game", "shop_now",
        "sign_up", "subscribe", "view_instagram_profile", "watch_more",
        "whatsapp_message",
    ],
    "impression_device_norm": [
        "", "android_smartphone", "android_tablet", "desktop", "ipad",
        "iphone", "ipod", "other",
    ],
    "business_type": [
        "beauty_cosmetics", "digital_marketing", "entertainment_media",
        "fashion_lifestyle", "financial_services", "food_beverage",
        "healthcare_medical", "industrial_manufacturing", "other",
        "real_estate", "retail_brand", "software_development",
        "technology_electronics", "transportation_logistics", "unknown",
    ],
}
# ------------------------------------------------------------ end fixed values

CATEGORICALS = list(SCORING_VOCABULARY)
DATE_ANCHORS = ["adg_start", "adg_end", "camp_start", "camp_end"]
CALENDAR_PARTS = [
    "month", "year4", "dow", "weekofyear", "doy", "days_in_month", "dom",
    "month_progress", "quarter", "is_weekend", "is_month_start", "is_month_end",
    "month_sin", "month_cos", "dow_sin", "dow_cos", "doy_sin", "doy_cos",
]
RELATION_FEATURES = [
    "adg_start_minus_camp_start_days", "camp_end_minus_adg_end_days",
    "adg_start_offset_days", "adg_end_offset_days",
    "adg_inside_campaign", "adg_duration_ratio",
]
MIDPOINT_FEATURES = [f"{p}_mid_month_{f}" for p in ("adg", "camp") for f in ("sin", "cos")]
COST_FEATURES = ["adg_cost_per_day", "camp_cost_per_day"] + [
    f"cost_x_{p}_start_month_{f}" for p in ("adg", "camp") for f in ("sin", "cos")
]

NUMERIC_FEATURES = (
    ["ad_group_duration", "campaign_duration"]
    + [f"{a}_{p}" for a in DATE_ANCHORS for p in CALENDAR_PARTS]
    + RELATION_FEATURES
    + MIDPOINT_FEATURES
    + COST_FEATURES
    + ["cost"]
)
FEATURES = NUMERIC_FEATURES[:-1] + CATEGORICALS + ["cost"]

ONE_HOT_FEATURES = [f"{c}_{v}" for c, vs in SCORING_VOCABULARY.items() for v in vs]
SCORED_FEATURES = NUMERIC_FEATURES + ONE_HOT_FEATURES

CAMPAIGN_COLUMNS = [
    "campaign_duration", "num_ads", "cost", "impressions", "reach", "clicks",
    "actions", "conversion_value", "business_type", "btype_confidence",
]
OUTLIER_COLUMNS = [
    "campaign_duration", "num_ads", "cost", "impressions", "reach", "clicks",
    "actions", "conversion_value", "btype_confidence",
]
OUTLIER_LOG_COLUMNS = METRICS
