"""Raw and cleaned tables of the point-of-sale model."""

from __future__ import annotations

#: Raw columns in their order in a line.
RAW = {
    "transactions": "transaction_id store_id payment_method_id voucher_id user_id original_amount discount_applied final_amount created_at",
    "transaction_items": "transaction_id item_id quantity unit_price subtotal created_at",
    "menu": "item_id item_name category price is_seasonal available_from available_to",
    "store": "store_id store_name street postal_code city state latitude longitude",
    "users": "user_id gender birthdate registered_at",
}
#: Fields that a line has at least.
LEAST_FIELDS = {"transactions": 9, "transaction_items": 6, "menu": 2, "store": 3, "users": 3}
CLEANED = {
    "transactions": "transaction_id string, store_id string, user_id string, final_amount double, created_at timestamp_ntz",
    "transaction_items": "item_id string, quantity bigint, subtotal double, created_at timestamp_ntz",
    "menu": "item_id string, item_name string",
    "store": "store_id string, store_name string",
    "users": "user_id string, birthdate string",
}
TABLES = tuple(RAW)
