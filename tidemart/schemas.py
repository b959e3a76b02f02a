"""Schemas of the two feeds, the dimensions' configuration and the summary tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


def _longs(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


#: A change record of the business database; ``ts`` in epoch seconds.
CHANGE = T.StructType(
    [
        *_strings("database", "table", "type", "ts"),
        T.StructField("data", T.MapType(T.StringType(), T.StringType())),
        T.StructField("old", T.MapType(T.StringType(), T.StringType())),
    ]
)

#: A record of the behaviour log; ``ts`` in epoch milliseconds.
LOG = T.StructType(
    [
        T.StructField("common", T.StructType(_strings("ar", "ba", "ch", "is_new", "md", "mid", "os", "uid", "vc"))),
        T.StructField("start", T.StructType([*_strings("entry"), *_longs("loading_time", "open_ad_id", "open_ad_ms", "open_ad_skip_ms")])),
        T.StructField("page", T.StructType([*_strings("page_id", "last_page_id", "item", "item_type", "source_type"), *_longs("during_time")])),
        T.StructField(
            "displays",
            T.ArrayType(T.StructType([*_strings("display_type", "item", "item_type"), T.StructField("order", T.IntegerType()), T.StructField("pos_id", T.IntegerType())])),
        ),
        T.StructField("actions", T.ArrayType(T.StructType([*_strings("action_id", "item", "item_type"), *_longs("ts")]))),
        T.StructField("err", T.StructType([T.StructField("error_code", T.IntegerType()), *_strings("msg")])),
        *_longs("ts"),
    ]
)

#: A line of the configuration that routes database tables to dimension tables.
DIM_CONFIG = T.StructType(_strings("source_table", "sink_table", "sink_columns", "sink_pk", "sink_extend"))

#: The code dictionary.
DICTIONARY = T.StructType([*_strings("dic_code", "dic_name", "parent_code"), T.StructField("create_time", T.TimestampType()), T.StructField("operate_time", T.TimestampType())])

#: Money in the summary tables.
AMOUNT = T.DecimalType(38, 20)

#: Columns of the summary tables behind ``stt, edt`` and before ``ts``, in the sinks' order.
SUMMARIES = {
    "keyword": ["source", "keyword", "keyword_count"],
    "traffic": ["vc", "ch", "ar", "is_new", "uv_ct", "sv_ct", "pv_ct", "dur_sum", "uj_ct"],
    "page_view": ["home_uv_ct", "good_detail_uv_ct"],
    "user_login": ["back_ct", "uu_ct"],
    "user_register": ["register_ct"],
    "cart_add": ["cart_add_uu_ct"],
    "payment": ["payment_suc_unique_user_count", "payment_new_user_count"],
    "trade_order": ["order_unique_user_count", "order_new_user_count", "order_activity_reduce_amount", "order_coupon_reduce_amount", "order_origin_total_amount"],
    "user_spu_order": ["trademark_id", "trademark_name", "category1_id", "category1_name", "category2_id", "category2_name", "category3_id", "category3_name", "user_id", "spu_id", "spu_name", "order_count", "order_amount"],
    "province_order": ["province_id", "province_name", "order_count", "order_amount"],
    "refund": ["trademark_id", "trademark_name", "category1_id", "category1_name", "category2_id", "category2_name", "category3_id", "category3_name", "user_id", "refund_count"],
}
