"""Explicit schemas of the stored tables and the marketplace documents."""

from __future__ import annotations

# Normalised shop tables behind the source reads.
SHOP = {
    "orders": "order_id long, store_id int, customer_id long, customer_group_id int, payment_city string, "
    "payment_country string, shipping_city string, shipping_method string, payment_method string, "
    "total decimal(15,4), order_status_id int, currency_code string, currency_value decimal(15,8), "
    "date_added timestamp_ntz, date_modified timestamp_ntz",
    "order_products": "order_product_id long, order_id long, product_id long, name string, model string, "
    "quantity int, price decimal(15,4), total decimal(15,4), tax decimal(15,4)",
    "products": "product_id long, model string, sku string, isbn string, quantity int, stock_status_id int, "
    "manufacturer_id long, price decimal(15,4), date_available string, publishing_year short, pages_number short, "
    "author string, publisher string, pereplet string, status short, date_added timestamp_ntz, "
    "date_modified timestamp_ntz",
    "product_descriptions": "product_id long, language_id int, name string, description string",
    "product_to_category": "product_id long, category_id int, main_category int",
    "categories": "category_id int, parent_id int, status short, sort_order int",
    "category_descriptions": "category_id int, language_id int, name string, description string",
    "manufacturers": "manufacturer_id long, name string",
    "manufacturer_descriptions": "manufacturer_id long, language_id int, description string",
    "customers": "customer_id long, customer_group_id int, store_id int, newsletter boolean, "
    "date_added timestamp_ntz",
    "customer_group_descriptions": "customer_group_id int, language_id int, name string",
    "stock_statuses": "stock_status_id int, language_id int, name string",
}

# One landed page of marketplace orders. Amounts are read as text and coerced afterwards; the phone number and the
# recipient are left out so that personal data never enters the tables.
PURCHASE = (
    "struct<id: long, item_id: long, item_name: string, quantity: int, price: string, cost: string, "
    "cost_with_discount: string>"
)
DELIVERY = (
    "struct<delivery_service_id: int, delivery_service_name: string, delivery_method_id: int, cost: string, "
    "city: struct<id: int, name: string>>"
)
MARKETPLACE_ORDER = (
    "struct<id: long, market_id: int, created: timestamp_ntz, changed: timestamp_ntz, amount: string, "
    "amount_with_discount: string, cost: string, cost_with_discount: string, status: int, status_group: int, "
    f"ttn: string, total_quantity: int, delivery: {DELIVERY}, purchases: array<{PURCHASE}>>"
)
PAGE_META = "struct<totalCount: long, pageCount: int, currentPage: int, perPage: int>"
PAGE_FIELDS = (
    "success boolean, errors struct<message: string, code: string>, "
    f"content struct<orders: array<{MARKETPLACE_ORDER}>, _meta: {PAGE_META}>"
)
CORRUPT = "_corrupt"
PAGE = f"{PAGE_FIELDS}, {CORRUPT} string"

SYNC_LOG = (
    "sync_id long, channel string, sync_type string, started_at timestamp_ntz, completed_at timestamp_ntz, "
    "records_ingested long, records_failed long, status string, error_detail string"
)
ALERT_RULE = (
    "rule_id int, rule_type string, rule_name string, threshold decimal(12,2), channel_id int, category_id long, "
    "is_active boolean, cooldown_hours int, notify_email string, created_at timestamp_ntz"
)
ALERT_EVENT = (
    "event_id long, rule_id int, product_id long, triggered_at timestamp_ntz, detail string, email_sent boolean"
)
REPORT_CATALOGUE = (
    "report_id long, report_type string, format string, parameters string, file_path string, "
    "generated_at timestamp_ntz, generated_by int, schedule string"
)
AUDIT_LOG = (
    "log_id long, user_id long, action string, resource string, ip_address string, detail string, "
    "created_at timestamp_ntz"
)
ORDER_STATUS = "status_id long, source_id int, source_channel string, name_en string, status_group int"
SALES_CHANNEL = "channel_id int, channel_name string, channel_url string, is_active boolean"
