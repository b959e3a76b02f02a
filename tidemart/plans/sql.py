"""DuckDB SQL of the registered queries, straight from the generated tables."""

from __future__ import annotations

_SECOND = "'%Y-%m-%d %H:%M:%S'"

_ORD = "ord AS (SELECT *, o_orderdate + to_seconds(o_orderkey % 86400) AS made FROM orders)"
_CHANGES = f"""{_ORD},
c AS (
    SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS user_id, CAST(c_nationkey AS VARCHAR) AS province_id, o_orderkey, made, o_orderstatus,
           made + INTERVAL 300 SECOND AS later
    FROM ord JOIN customer ON o_custkey = c_custkey),
oc AS (
    SELECT *, 'insert' AS type, '1001' AS status, NULL AS old_status, made AS moment FROM c
    UNION ALL SELECT *, 'update', CASE o_orderstatus WHEN 'F' THEN '1003' ELSE '1005' END, '1001', later FROM c WHERE o_orderstatus IN ('F', 'P')
    UNION ALL SELECT *, 'update', '1006', '1005', later FROM c WHERE o_orderstatus = 'P' AND o_orderkey % 2 = 0)"""
_LINES = """lines AS (
    SELECT *, l_orderkey || '-' || l_linenumber AS id, CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_discount AS DECIMAL(18,2)) AS discount FROM lineitem),
once AS (
    SELECT * FROM lines
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) = 1)"""
#: Every order detail with each change of its order, its activity and coupon.
_WIDE = f"""{_CHANGES},
{_LINES},
wide AS (
    SELECT l.id, CAST(l.l_orderkey AS VARCHAR) AS order_id, oc.user_id, CAST(l.l_partkey AS VARCHAR) AS sku_id, CAST(l.l_quantity AS BIGINT) AS sku_num,
           CAST(l.price AS DOUBLE) AS order_price, oc.province_id, CAST(a.l_suppkey AS VARCHAR) AS activity_id, CAST(k.l_suppkey AS VARCHAR) AS coupon_id,
           CAST(2401 + l.l_suppkey % 4 AS VARCHAR) AS source_type_id, 'name_' || (2401 + l.l_suppkey % 4) AS source_type_name,
           CAST(l.price - l.price * l.discount AS DOUBLE) AS split_total_amount,
           CASE WHEN l.l_returnflag = 'A' THEN CAST(l.price * l.discount AS DOUBLE) END AS split_activity_amount,
           CASE WHEN l.l_returnflag = 'R' THEN CAST(l.price * l.discount AS DOUBLE) END AS split_coupon_amount,
           oc.status AS order_status, oc.type, oc.old_status, strftime(o.made, {_SECOND}) AS create_time, strftime(oc.later, {_SECOND}) AS operate_time,
           'a' || a.id AS order_detail_activity_id, 'c' || k.id AS order_detail_coupon_id, o.made, l.price, l.discount, l.l_returnflag,
           l.l_shipdate, l.l_partkey, l.l_suppkey, l.l_quantity, l.l_extendedprice
    FROM lines l JOIN ord o ON l.l_orderkey = o.o_orderkey
    LEFT JOIN oc ON oc.o_orderkey = l.l_orderkey
    LEFT JOIN once a ON a.id = l.id AND a.l_returnflag = 'A'
    LEFT JOIN once k ON k.id = l.id AND k.l_returnflag = 'R'),
detail AS (SELECT * FROM wide WHERE type = 'insert')"""
_BY = "l_shipdate {0}, l_partkey {0}, l_suppkey {0}, l_quantity {0}, l_extendedprice {0}"
_FIRST = f"{_WIDE}, one AS (SELECT * FROM detail QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_BY.format('ASC')}) = 1)"
_LAST = f"{_WIDE}, one AS (SELECT * FROM detail QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_BY.format('DESC')}) = 1)"
_SHOWN = "id, order_id, user_id, sku_id, sku_num, order_price, province_id, activity_id, coupon_id, source_type_id, source_type_name, split_total_amount, split_activity_amount, split_coupon_amount"

_PAY = f"""{_WIDE},
pay AS (SELECT *, made + to_seconds(CASE WHEN o_orderkey % 5 = 0 THEN 1200 ELSE 600 END) AS paid FROM ord WHERE o_orderstatus = 'O')"""
_PAID = f"""CAST(pay.o_orderkey AS VARCHAR) AS p_order_id, d.id AS order_detail_id, d.user_id, d.sku_id, CAST(1101 + pay.o_orderkey % 3 AS VARCHAR) AS payment_type_id,
    'name_' || (1101 + pay.o_orderkey % 3) AS payment_type_name, strftime(paid, {_SECOND}) AS callback_time, d.split_total_amount"""

_LOG = """log AS (
    SELECT event_id AS n, user_id AS u, event_type AS kind, (epoch_us(ts) // 1000) AS ms, value, 'mid_' || user_id AS mid,
           CASE WHEN event_id % 10 <> 0 THEN CAST(user_id AS VARCHAR) END AS uid, 'v2.1.' || (event_id % 3) AS vc, 'ch_' || (user_id % 4) AS ch, 'ar_' || (user_id % 7) AS ar,
           CASE WHEN user_id % 2 = 0 THEN '1' ELSE '0' END AS said_new,
           CASE event_type WHEN 'view' THEN 'home' WHEN 'click' THEN 'good_detail' WHEN 'purchase' THEN 'payment' WHEN 'error' THEN 'cart' END AS page_id,
           CASE WHEN event_id % 3 = 1 THEN 'search' WHEN event_id % 3 = 2 THEN 'home' END AS last_page_id, CASE WHEN event_id % 3 = 1 THEN p_name ELSE CAST(event_id % 200 AS VARCHAR) END AS item,
           CASE WHEN event_id % 3 = 1 THEN 'keyword' ELSE 'sku_id' END AS item_type, CAST(floor(value) AS BIGINT) AS during_time, make_timestamp((epoch_us(ts) // 1000) * 1000) AS rt
    FROM events JOIN part ON event_id % 200 = p_partkey),
fixed AS (SELECT *, CASE WHEN said_new = '1' AND CAST(rt AS DATE) > min(CAST(rt AS DATE)) OVER (PARTITION BY mid) THEN '0' ELSE said_new END AS is_new FROM log),
page AS (SELECT * FROM fixed WHERE kind <> 'signup'),
uv AS (SELECT * FROM page WHERE last_page_id IS NULL QUALIFY row_number() OVER (PARTITION BY mid, CAST(rt AS DATE) ORDER BY ms, vc, page_id, item) = 1),
jump AS (
    SELECT * FROM (SELECT *, lead(ms) OVER w AS next_ms, lead(last_page_id IS NULL) OVER w AS next_starts FROM page WINDOW w AS (PARTITION BY mid ORDER BY ms, vc, page_id, item))
    WHERE last_page_id IS NULL AND (next_ms IS NULL OR next_starts OR next_ms - ms >= 21600000))"""
_PAGE = "mid, uid, vc, ch, ar, is_new, page_id, last_page_id, item, item_type, during_time, ms AS ts"

_CART = f"""cart AS (
    SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id, CAST(event_id % 200 AS VARCHAR) AS sku_id,
           CASE WHEN event_type = 'click' THEN 1 + event_id % 3 ELSE event_id % 6 - event_id % 4 END AS sku_num, strftime(ts, {_SECOND}) AS create_time,
           CAST(2401 + event_id % 4 AS VARCHAR) AS source_type_id, 'name_' || (2401 + event_id % 4) AS source_type_name, date_trunc('second', ts) AS rt
    FROM events WHERE event_type = 'click' OR (event_type = 'purchase' AND event_id % 11 <> 0 AND event_id % 6 > event_id % 4))"""
_REFUND = f"""{_CHANGES}, {_LINES},
asked AS (
    SELECT once.*, ord.made + INTERVAL 1 DAY AS asked, ord.o_custkey FROM once JOIN ord ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'),
refund AS (
    SELECT 'r' || asked.id AS id, CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_partkey AS VARCHAR) AS sku_id, oc.province_id,
           CAST(1501 + l_linenumber % 2 AS VARCHAR) AS refund_type_id, 'name_' || (1501 + l_linenumber % 2) AS refund_type_name,
           CAST(1301 + l_linenumber % 7 AS VARCHAR) AS refund_reason_type_id, 'name_' || (1301 + l_linenumber % 7) AS refund_reason_type_name,
           CAST(l_quantity AS BIGINT) AS refund_num, CAST(price AS DOUBLE) AS refund_amount, strftime(asked, {_SECOND}) AS create_time, asked AS rt, l_partkey
    FROM asked LEFT JOIN oc ON oc.o_orderkey = l_orderkey AND oc.status = '1005')"""
_CHAIN = """chain AS (
    SELECT DISTINCT p_type AS category3_id, lower(p_type) AS category3_name, CAST(length(p_type) % 3 AS VARCHAR) AS category2_id, 'second_' || (length(p_type) % 3) AS category2_name,
           CAST(length(p_type) % 3 % 2 AS VARCHAR) AS category1_id, 'first_' || (length(p_type) % 3 % 2) AS category1_name
    FROM part)"""


def _bounds(time: str, width: str) -> str:
    start = f"time_bucket(INTERVAL '{width}', {time}, TIMESTAMP '1970-01-01')"
    return f"strftime({start}, {_SECOND}) AS stt, strftime({start} + INTERVAL '{width}', {_SECOND}) AS edt"


SQL = {
    "cdc_parse": f"WITH {_CHANGES} SELECT 'order_info' AS \"table\", type, CAST(epoch(moment) AS BIGINT) AS ts, id, status, old_status FROM oc",
    "cdc_keep_types": """
        SELECT 'nation' AS "table", 'bootstrap-insert' AS type, CAST(n_nationkey AS VARCHAR) AS id FROM nation WHERE n_nationkey % 4 = 3
        UNION ALL SELECT 'part', 'insert', CAST(p_partkey AS VARCHAR) FROM part
        UNION ALL SELECT 'part', 'update', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 3 = 0
        UNION ALL SELECT 'supplier', 'insert', CAST(s_suppkey AS VARCHAR) FROM supplier""",
    "dic_lookup": "SELECT event_id, CAST(1101 + event_id % 5 AS VARCHAR) AS code, 'name_' || (1101 + event_id % 5) AS name FROM events WHERE event_id % 5 < 3",
    "upsert_latest": f"WITH {_CHANGES} SELECT id, max(status) AS status, CAST(epoch(max(moment)) AS BIGINT) AS ts FROM oc GROUP BY id",
    "dim_filter_columns": """
        SELECT 'dim_base_province' AS sink_table, 'bootstrap-insert' AS type, 'id,name' AS columns, CAST(n_nationkey AS VARCHAR) AS id FROM nation WHERE n_nationkey % 4 = 3
        UNION ALL SELECT 'dim_sku_info', 'insert', 'id,tm_id', CAST(p_partkey AS VARCHAR) FROM part
        UNION ALL SELECT 'dim_sku_info', 'update', 'id,tm_id', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 3 = 0""",
    "dim_route": """
        SELECT 'dim_base_province' AS sink_table, 'bootstrap-insert' AS type, 1704067200 AS ts, CAST(n_nationkey AS VARCHAR) AS id, NULL AS tm_id, n_name AS name FROM nation WHERE n_nationkey % 4 = 3
        UNION ALL SELECT 'dim_sku_info', 'insert', 1704067200, CAST(p_partkey AS VARCHAR), p_brand, NULL FROM part
        UNION ALL SELECT 'dim_sku_info', 'update', 1704070800, CAST(p_partkey AS VARCHAR), p_brand || '*', NULL FROM part WHERE p_partkey % 3 = 0""",
    "dim_upsert": """
        SELECT 'dim_base_province' AS sink_table, CAST(n_nationkey AS VARCHAR) AS pk, NULL AS tm_id, n_name AS name FROM nation WHERE n_nationkey % 4 = 3
        UNION ALL SELECT 'dim_sku_info', CAST(p_partkey AS VARCHAR), CASE WHEN p_partkey % 3 = 0 THEN p_brand || '*' ELSE p_brand END, NULL FROM part""",
    "dws_replace_latest": f"SELECT {_bounds('ts', '1 hour')}, event_type, count(*) AS n, 2 AS ts FROM events GROUP BY 1, 2, 3",
    "log_parse": f"""WITH {_LOG} SELECT mid, ms AS ts, page_id, CASE WHEN kind = 'signup' THEN 'icon' END AS entry,
        CASE WHEN kind = 'view' THEN n % 4 ELSE -1 END AS n_displays, CASE WHEN kind = 'error' THEN 1000 + n % 100 END AS error_code FROM log WHERE ms % 97 <> 0""",
    "log_dirty": f"WITH {_LOG} SELECT 'not json ' || ms AS value FROM log WHERE ms % 97 = 0",
    "log_fix_is_new": f"WITH {_LOG} SELECT mid, ms AS ts, is_new FROM fixed",
    "log_error": f"WITH {_LOG} SELECT mid, ms AS ts, page_id, 1000 + n % 100 AS error_code FROM log WHERE kind = 'error'",
    "log_fan_out": f"""WITH {_LOG},
        good AS (SELECT * FROM log WHERE ms % 97 <> 0),
        k AS (
            SELECT 'error' AS kind, mid, ms FROM good WHERE kind = 'error' UNION ALL SELECT 'start', mid, ms FROM good WHERE kind = 'signup' UNION ALL SELECT 'page', mid, ms FROM good WHERE kind <> 'signup'
            UNION ALL SELECT 'display', mid, ms FROM (SELECT *, unnest(range(1, n % 4 + 1)) FROM good WHERE kind = 'view') UNION ALL SELECT 'action', mid, NULL FROM good WHERE kind = 'click' AND n % 2 = 0
            UNION ALL SELECT 'dirty', NULL, NULL FROM log WHERE ms % 97 = 0)
        SELECT kind, mid, count(*) AS n, CAST(sum(ms) AS BIGINT) AS sum_ts FROM k GROUP BY kind, mid""",
    "log_fan_out_items": f"""WITH {_LOG}, good AS (SELECT * FROM log WHERE ms % 97 <> 0)
        SELECT 'display' AS kind, page_id, CAST(n + i AS VARCHAR) AS item, i AS place, ms AS ts FROM (SELECT *, unnest(range(1, n % 4 + 1)) AS i FROM good WHERE kind = 'view')
        UNION ALL SELECT 'action', page_id, CAST(n AS VARCHAR), NULL, ms FROM good WHERE kind = 'click' AND n % 2 = 0""",
    "log_start": f"WITH {_LOG} SELECT mid, ms AS ts, 'icon' AS entry, n % 1000 AS loading_time, n % 7 AS open_ad_id, n % 100 AS open_ad_ms FROM log WHERE kind = 'signup'",
    "log_display": f"WITH {_LOG} SELECT mid, ms AS ts, page_id, CAST(n + i AS VARCHAR) AS item, i AS place, i % 5 AS pos_id FROM (SELECT *, unnest(range(1, n % 4 + 1)) AS i FROM log WHERE kind = 'view')",
    "log_action": f"WITH {_LOG} SELECT mid, page_id, 'favor_add' AS action_id, CAST(n AS VARCHAR) AS item, ms AS action_ts FROM log WHERE kind = 'click' AND n % 2 = 0",
    "log_page": f"WITH {_LOG} SELECT mid, uid, vc, ch, ar, said_new AS is_new, page_id, last_page_id, item, item_type, during_time, ms AS ts FROM log WHERE kind <> 'signup'",
    "dwd_unique_visitor": f"WITH {_LOG} SELECT {_PAGE} FROM uv",
    "dwd_user_jump": f"WITH {_LOG} SELECT {_PAGE} FROM jump",
    "dwd_cart_add": f"WITH {_CART} SELECT id, user_id, sku_id, sku_num, create_time, source_type_id, source_type_name FROM cart",
    "dwd_order_pre_process": f"WITH {_WIDE} SELECT {_SHOWN}, order_status, type, old_status, create_time, operate_time, order_detail_activity_id, order_detail_coupon_id FROM wide",
    "dwd_order_detail": f"WITH {_WIDE} SELECT {_SHOWN}, create_time FROM detail",
    "dwd_cancel_detail": f"WITH {_WIDE} SELECT {_SHOWN}, operate_time AS cancel_time FROM wide WHERE order_status = '1003' AND old_status IS NOT NULL",
    "dwd_pay_detail_suc": f"WITH {_PAY} SELECT {_PAID} FROM pay LEFT JOIN detail d ON CAST(pay.o_orderkey AS VARCHAR) = d.order_id AND abs(epoch(paid) - epoch(d.made)) <= 905",
    "pay_detail_inner": f"WITH {_PAY} SELECT {_PAID} FROM pay JOIN detail d ON CAST(pay.o_orderkey AS VARCHAR) = d.order_id",
    "dwd_order_refund": f"WITH {_REFUND} SELECT * EXCLUDE (rt, l_partkey) FROM refund",
    "dwd_refund_pay_suc": f"""WITH {_REFUND}, even AS (SELECT * FROM asked WHERE l_orderkey % 2 = 0)
        SELECT 'p' || p.id AS id, oc.user_id, CAST(p.l_orderkey AS VARCHAR) AS order_id, CAST(p.l_partkey AS VARCHAR) AS sku_id, oc.province_id, CAST(1101 + p.l_orderkey % 3 AS VARCHAR) AS payment_type_id,
               'name_' || (1101 + p.l_orderkey % 3) AS payment_type_name, CAST(d.l_quantity AS BIGINT) AS refund_num, CAST(p.price * (1 - p.discount) AS DOUBLE) AS total_amount, strftime(p.asked, {_SECOND}) AS callback_time
        FROM even p JOIN even d ON p.l_orderkey = d.l_orderkey AND p.l_partkey = d.l_partkey JOIN oc ON oc.o_orderkey = p.l_orderkey AND oc.status = '1006'""",
    "dwd_coupon_get": f"WITH {_ORD} SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderkey % 50 AS VARCHAR) AS coupon_id, CAST(o_custkey AS VARCHAR) AS user_id, strftime(made, {_SECOND}) AS get_time FROM ord",
    "dwd_coupon_order": f"WITH {_ORD} SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderkey % 50 AS VARCHAR) AS coupon_id, CAST(o_custkey AS VARCHAR) AS user_id, CAST(o_orderkey AS VARCHAR) AS order_id, strftime(made, {_SECOND}) AS using_time FROM ord WHERE o_orderkey % 2 = 0",
    "dwd_coupon_pay": f"WITH {_ORD} SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderkey % 50 AS VARCHAR) AS coupon_id, CAST(o_custkey AS VARCHAR) AS user_id, CAST(o_orderkey AS VARCHAR) AS order_id, strftime(made, {_SECOND}) AS used_time FROM ord WHERE o_orderkey % 4 = 0",
    "dwd_favor_add": f"SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id, CAST(event_id % 200 AS VARCHAR) AS sku_id, strftime(ts, {_SECOND}) AS create_time FROM events WHERE event_type = 'view'",
    "dwd_comment": f"""SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS user_id, CAST(event_id % 200 AS VARCHAR) AS sku_id, CAST(event_id % 50 AS VARCHAR) AS spu_id, CAST(event_id * 2 AS VARCHAR) AS order_id,
        CAST(1201 + event_id % 5 AS VARCHAR) AS appraise_type_id, 'name_' || (1201 + event_id % 5) AS appraise_type_name, strftime(ts, {_SECOND}) AS create_time
        FROM events WHERE event_type = 'purchase' AND event_id % 5 < 4""",
    "dwd_user_register": f"""WITH u AS (SELECT c_custkey, TIMESTAMP '2024-01-01' + to_seconds(c_custkey * 37) AS made FROM customer)
        SELECT CAST(c_custkey AS VARCHAR) AS id, strftime(made, {_SECOND}) AS create_time, CAST(epoch(made) AS BIGINT) AS ts FROM u""",
    "dedup_first": f"WITH {_FIRST} SELECT id, sku_id, sku_num, order_price, split_total_amount FROM one",
    "dedup_latest": f"WITH {_LAST} SELECT id, sku_id, sku_num, order_price, split_total_amount FROM one",
    "dim_enrich_sku": f"""WITH {_LINES} SELECT CAST(l_partkey AS VARCHAR) AS sku_id, id, CAST(p_partkey % 50 AS VARCHAR) AS spu_id, p_brand AS trademark_id, p_type AS category3_id
        FROM lines JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "dim_category_chain": f"WITH {_CHAIN} SELECT * FROM chain",
    "keyword_tokens": "SELECT p_partkey, unnest(string_split(lower(p_name), ' ') || ['手机', '机壳', 'a1']) AS keyword FROM part",
    "dws_keyword_window": f"""WITH {_LOG}, w AS (SELECT rt, unnest(string_split(lower(item), ' ')) AS keyword FROM page WHERE last_page_id = 'search')
        SELECT {_bounds('rt', '1 day')}, 'SEARCH' AS source, keyword, count(*) AS keyword_count FROM w GROUP BY 1, 2, 3, 4""",
    "dws_traffic_window": f"""WITH {_LOG}, m AS (
            SELECT rt, vc, ch, ar, is_new, 1 AS uv, 0 AS sv, 0 AS pv, 0 AS dur, 0 AS uj FROM uv
            UNION ALL SELECT rt, vc, ch, ar, is_new, 0, CASE WHEN last_page_id IS NULL THEN 1 ELSE 0 END, 1, during_time, 0 FROM page
            UNION ALL SELECT rt, vc, ch, ar, is_new, 0, 0, 0, 0, 1 FROM jump)
        SELECT {_bounds('rt', '1 hour')}, vc, ch, ar, is_new, CAST(sum(uv) AS BIGINT) AS uv_ct, CAST(sum(sv) AS BIGINT) AS sv_ct, CAST(sum(pv) AS BIGINT) AS pv_ct, CAST(sum(dur) AS BIGINT) AS dur_sum, CAST(sum(uj) AS BIGINT) AS uj_ct
        FROM m GROUP BY 1, 2, 3, 4, 5, 6""",
    "dws_page_view_window": f"""WITH {_LOG}, f AS (SELECT * FROM page WHERE page_id IN ('home', 'good_detail') QUALIFY row_number() OVER (PARTITION BY mid, page_id, CAST(rt AS DATE) ORDER BY ms) = 1)
        SELECT {_bounds('rt', '1 hour')}, count(*) FILTER (page_id = 'home') AS home_uv_ct, count(*) FILTER (page_id = 'good_detail') AS good_detail_uv_ct FROM f GROUP BY 1, 2""",
    "dws_user_login_window": f"""WITH {_LOG}, f AS (SELECT * FROM page WHERE uid IS NOT NULL AND last_page_id IS NULL QUALIFY row_number() OVER (PARTITION BY uid, CAST(rt AS DATE) ORDER BY ms) = 1),
        b AS (SELECT *, CAST(rt AS DATE) - lag(CAST(rt AS DATE)) OVER (PARTITION BY uid ORDER BY ms) AS gap FROM f)
        SELECT {_bounds('rt', '1 hour')}, count(*) FILTER (gap > 7) AS back_ct, count(*) AS uu_ct FROM b GROUP BY 1, 2""",
    "dws_user_register_window": f"SELECT {_bounds("TIMESTAMP '2024-01-01' + to_seconds(c_custkey * 37)", '1 hour')}, count(*) AS register_ct FROM customer GROUP BY 1, 2",
    "dws_cart_add_window": f"""WITH {_CART}, f AS (SELECT * FROM cart QUALIFY row_number() OVER (PARTITION BY user_id, CAST(rt AS DATE) ORDER BY rt, id) = 1)
        SELECT {_bounds('rt', '1 hour')}, count(*) AS cart_add_uu_ct FROM f GROUP BY 1, 2""",
    "dws_payment_window": f"""WITH {_PAY}, p AS (SELECT DISTINCT d.id, d.user_id, paid FROM pay JOIN detail d ON CAST(pay.o_orderkey AS VARCHAR) = d.order_id),
        f AS (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(paid AS DATE) ORDER BY paid, id) AS day_n, row_number() OVER (PARTITION BY user_id ORDER BY paid, id) AS n FROM p)
        SELECT {_bounds('paid', '1 day')}, count(*) FILTER (day_n = 1) AS payment_suc_unique_user_count, count(*) FILTER (n = 1) AS payment_new_user_count FROM f GROUP BY 1, 2""",
    "dws_trade_order_window": f"""WITH {_FIRST},
        f AS (SELECT *, row_number() OVER (PARTITION BY user_id, CAST(made AS DATE) ORDER BY made, id) AS day_n, row_number() OVER (PARTITION BY user_id ORDER BY made, id) AS n FROM one)
        SELECT {_bounds('made', '1 day')}, count(*) FILTER (day_n = 1) AS order_unique_user_count, count(*) FILTER (n = 1) AS order_new_user_count,
               CAST(sum(CASE WHEN l_returnflag = 'A' THEN price * discount ELSE 0 END) AS DOUBLE) AS order_activity_reduce_amount,
               CAST(sum(CASE WHEN l_returnflag = 'R' THEN price * discount ELSE 0 END) AS DOUBLE) AS order_coupon_reduce_amount,
               CAST(sum(price * CAST(sku_num AS DECIMAL(12,0))) AS DOUBLE) AS order_origin_total_amount
        FROM f GROUP BY 1, 2""",
    "dws_user_spu_order_window": f"""WITH {_FIRST}, {_CHAIN},
        s AS (
            SELECT {_bounds('made', '1 day')}, user_id, CAST(p_partkey % 50 AS VARCHAR) AS spu_id, p_brand AS trademark_id, p_type AS category3_id,
                   count(DISTINCT order_id) AS order_count, CAST(sum(price - price * discount) AS DOUBLE) AS order_amount
            FROM one JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4, 5, 6)
        SELECT *, 'spu_' || spu_id AS spu_name, upper(trademark_id) AS trademark_name FROM s JOIN chain USING (category3_id)""",
    "dws_province_order_window": f"""WITH {_LAST}
        SELECT {_bounds('made', '1 day')}, province_id, n_name AS province_name, count(DISTINCT order_id) AS order_count, CAST(sum(price - price * discount) AS DOUBLE) AS order_amount
        FROM one JOIN nation ON CAST(n_nationkey AS VARCHAR) = province_id GROUP BY 1, 2, 3, 4""",
    "dws_refund_window": f"""WITH {_REFUND}, {_CHAIN},
        s AS (
            SELECT {_bounds('rt', '1 day')}, user_id, p_brand AS trademark_id, p_type AS category3_id, count(DISTINCT order_id) AS refund_count
            FROM refund JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4, 5)
        SELECT *, upper(trademark_id) AS trademark_name FROM s JOIN chain USING (category3_id)""",
}
