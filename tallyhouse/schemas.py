"""Types of the tables the engine works on."""

from __future__ import annotations

VARIANT = (
    "struct<id:bigint,title:string,sku:string,price:string,compare_at_price:string,available:boolean,requires_shipping:boolean,"
    "option1:string,option2:string,option3:string>"
)
PRODUCT = (
    "id bigint, title string, handle string, body_html string, published_at string, created_at string, updated_at string, "
    f"vendor string, product_type string, tags array<string>, variants array<{VARIANT}>, "
    "options array<struct<name:string,position:int,values:array<string>>>"
)
REQUEST = (
    "key string, file string, url string, final_url string, http_status int, result string, bytes bigint, elapsed_ms bigint, note string"
)
RAW_FILE = "site string, snapshot_id string, file string, content string"
SNAPSHOT = (
    "site string, snapshot_id string, captured_at_utc string, source string, status string, identity_status string, fetch_error string, "
    "currency string, currency_source string, visitor_country string, ships_to_count int, cov_products string, "
    "pagination_complete boolean, cov_homepage boolean, cov_collections boolean, cov_meta boolean, theme_name string, "
    "theme_schema_name string, theme_schema_version string, theme_store_id string, localization_form string"
)
SNAP_PRODUCT = (
    "site string, snapshot_id string, product_key string, handle string, title string, vendor string, product_type string, "
    "tags array<string>, created_at string, published_at string, virtual boolean"
)
SNAP_VARIANT = (
    "site string, snapshot_id string, product_key string, variant_key string, pos int, title string, sku string, options array<string>, "
    "price decimal(18,6), compare_at_price decimal(18,6), available boolean"
)
SNAP_COLLECTION = "site string, snapshot_id string, handle string, id string, title string, products_count int"
SNAP_POLICY = (
    "site string, snapshot_id string, name string, checked_result string, text_sha256 string, sentences array<string>, "
    "key_terms map<string,string>"
)
SNAP_LINE = "site string, snapshot_id string, kind string, line string"
SNAP_SIGNAL = "site string, snapshot_id string, kind string, name string"
EVENT = (
    "site string, type string, severity string, product_id string, handle string, title string, variant_id string, variant string, "
    "field string, before string, after string, delta_pct double, currency string, virtual boolean, badge string"
)
CLAIM = "site string, pos int, source string, url string, topic string, kind string, value string, value_num double, snippet string"
FINDING = "site string, rule_id string, grp string, result string, level string, badge string, note string, evidence array<string>"
EVIDENCE = "site string, ord int, level string, kind string, claim string, source_url string, captured_at_utc string, locator string"
TAG_HIT = "site string, platform string, id string, install_via string, kind string, source string, problem string, count int"
REPORT_LINE = "report_id string, ln int, text string"
