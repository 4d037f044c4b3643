"""The registered queries in DuckDB SQL, written from the definitions.

Where the Spark side rolls up from pairs or splits windows, the SQL counts distinct keys and
uses plain windows, so that the two agree only if the rewrites are right.
"""

from __future__ import annotations

import re

CTES = {
    "part_map": """
        SELECT p_partkey, p_brand || ' ' || p_type AS product_name,
               CAST(substr(p_brand, 7) AS BIGINT) AS brand,
               CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'MEDIUM' THEN 2
                    WHEN 'PROMO' THEN 3 WHEN 'SMALL' THEN 4 WHEN 'STANDARD' THEN 5 END AS kind
        FROM part""",
    "c_products": """
        SELECT DISTINCT brand * 10 + kind AS product_id, product_name,
               CAST(brand AS INTEGER) AS aisle_id, CAST(kind + 1 AS INTEGER) AS department_id
        FROM part_map""",
    "order_lines": """
        SELECT l_orderkey AS order_id, brand * 10 + kind AS product_id,
               min(l_linenumber) AS first_line
        FROM lineitem JOIN part_map ON l_partkey = p_partkey
        GROUP BY l_orderkey, brand * 10 + kind""",
    "kept_orders": """
        SELECT o_orderkey AS order_id, o_custkey AS user_id, CAST(o_orderdate AS DATE) AS day
        FROM orders WHERE o_orderkey IN (SELECT order_id FROM order_lines)""",
    "numbered": """
        SELECT order_id, user_id, day,
               row_number() OVER (PARTITION BY user_id ORDER BY day, order_id) AS n,
               count(*) OVER (PARTITION BY user_id) AS total,
               lag(day) OVER (PARTITION BY user_id ORDER BY day, order_id) AS prev
        FROM kept_orders""",
    "c_orders": """
        SELECT order_id, user_id,
               CASE WHEN n < total THEN 'prior' WHEN user_id % 3 = 0 THEN 'test'
                    ELSE 'train' END AS eval_set,
               CAST(n AS INTEGER) AS order_number,
               CAST(dayofweek(day) AS INTEGER) AS order_dow,
               CAST(order_id % 24 AS INTEGER) AS order_hour_of_day,
               CAST(date_diff('day', prev, day) AS DOUBLE) AS days_since_prior_order
        FROM numbered""",
    "accu_orders": """
        SELECT *, sum(coalesce(days_since_prior_order, 0)) OVER (
                   PARTITION BY user_id ORDER BY order_number
                   ROWS UNBOUNDED PRECEDING) AS interval_accu
        FROM c_orders""",
    "c_lines": """
        SELECT o.*, l.product_id, l.first_line,
               CAST(o.order_number > min(o.order_number) OVER (
                   PARTITION BY o.user_id, l.product_id) AS INTEGER) AS reordered
        FROM order_lines l JOIN accu_orders o ON l.order_id = o.order_id""",
    "cart": """
        SELECT order_id, product_id,
               CAST(row_number() OVER (PARTITION BY order_id ORDER BY first_line, product_id)
                    AS INTEGER) AS add_to_cart_order,
               reordered, eval_set
        FROM c_lines""",
    "prior_lines": """
        SELECT order_id, product_id, add_to_cart_order, reordered FROM cart
        WHERE eval_set = 'prior'""",
    "truth_lines": """
        SELECT order_id, product_id, add_to_cart_order, reordered FROM cart
        WHERE eval_set = 'train'""",
    "h": """
        SELECT order_id, product_id, reordered, user_id, order_number, order_dow,
               order_hour_of_day, days_since_prior_order, interval_accu,
               row_number() OVER (PARTITION BY user_id, product_id ORDER BY order_number) - 1
                   AS order_time
        FROM c_lines WHERE eval_set = 'prior'""",
    "cand": """
        SELECT o.order_id, o.user_id, p.product_id, o.eval_set
        FROM c_orders o JOIN (SELECT DISTINCT user_id, product_id FROM h) p
             ON o.user_id = p.user_id
        WHERE o.eval_set <> 'prior'""",
    "labelled": """
        SELECT c.order_id, c.user_id, c.product_id,
               CAST(CASE WHEN t.reordered = 1 THEN 1 ELSE 0 END AS INTEGER) AS label
        FROM cand c LEFT JOIN truth_lines t
             ON c.order_id = t.order_id AND c.product_id = t.product_id
        WHERE c.eval_set = 'train'""",
    "folds": """
        SELECT DISTINCT user_id,
               CAST(((user_id % 2147483648) * 2654435761 % 4294967296) // 65536 % 5 AS INTEGER)
                   AS seed
        FROM c_orders WHERE eval_set = 'train'""",
    # Pair, user and product blocks; averages stay NULL where undefined.
    "pair": """
        SELECT user_id, product_id, count(*) AS n, max(reordered) AS any_reordered,
               min(order_number) AS first_order,
               CASE WHEN count(*) > 1 THEN CAST(max(order_number) - min(order_number) AS DOUBLE)
                    / (count(*) - 1) END AS order_gap,
               CASE WHEN count(*) > 1 THEN CAST(max(interval_accu) - min(interval_accu) AS DOUBLE)
                    / (count(*) - 1) END AS days_gap
        FROM h GROUP BY user_id, product_id""",
    "last_purchase": """
        SELECT user_id, product_id, order_number AS last_order_number, interval_accu
        FROM (SELECT *, max(order_time) OVER (PARTITION BY user_id, product_id) AS latest FROM h)
        WHERE order_time = latest""",
    "user_pairs": """
        SELECT user_id, avg(n) AS user_avg_prod_norder, avg(order_gap) AS order_gap,
               avg(days_gap) AS days_gap
        FROM pair GROUP BY user_id""",
    "user_lines": """
        SELECT user_id, count(DISTINCT order_id) AS user_norder, count(*) AS user_nitems,
               count(DISTINCT product_id) AS user_ndistinctitems,
               count(*) FILTER (WHERE reordered = 1) AS user_nritems,
               count(DISTINCT product_id) FILTER (WHERE reordered = 1) AS user_nrdistinctitems,
               CAST(count(*) FILTER (WHERE order_time = 1) AS DOUBLE)
                   / count(*) FILTER (WHERE order_time = 0) AS user_second_order_rate,
               max(order_number) AS last_number
        FROM h GROUP BY user_id""",
    "user_gap": """
        SELECT user_id, avg(days_since_prior_order) AS user_interval
        FROM (SELECT DISTINCT user_id, order_id, days_since_prior_order FROM h
              WHERE days_since_prior_order IS NOT NULL) GROUP BY user_id""",
    "user_share": """
        SELECT user_id, avg(share) AS user_avg_reorder_ratio
        FROM (SELECT user_id, order_id, CAST(sum(reordered) AS DOUBLE) / count(*) AS share
              FROM h WHERE order_number <> 1 GROUP BY user_id, order_id) GROUP BY user_id""",
    "user_block": """
        SELECT l.user_id, user_norder, user_avg_prod_norder,
               round(coalesce(p.order_gap, 0), 9) AS user_order_interval_avg,
               round(coalesce(p.days_gap, 0), 9) AS user_days_interval_avg,
               user_nitems, user_ndistinctitems, user_nritems, user_nrdistinctitems,
               user_interval, user_second_order_rate,
               round(user_avg_reorder_ratio, 9) AS user_avg_reorder_ratio,
               CAST(user_nritems AS DOUBLE) / user_nitems AS user_nritem_ratio,
               CAST(user_nrdistinctitems AS DOUBLE) / user_ndistinctitems
                   AS user_nrdistinctitem_ratio,
               CAST(user_nitems AS DOUBLE) / user_norder AS user_nitem_per_order,
               CASE WHEN user_norder > 1 THEN CAST(user_nritems AS DOUBLE) / (user_norder - 1) END
                   AS user_nritem_per_order,
               CASE WHEN user_norder > 1 THEN (CAST(user_nritems AS DOUBLE) / (user_norder - 1))
                   / (CAST(user_nitems AS DOUBLE) / user_norder) END
                   AS user_nritem_per_order_ratio
        FROM user_lines l JOIN user_pairs p ON l.user_id = p.user_id
             JOIN user_gap g ON l.user_id = g.user_id
             JOIN user_share s ON l.user_id = s.user_id""",
    "product_pairs": """
        SELECT product_id, avg(order_gap) AS order_gap, avg(days_gap) AS days_gap
        FROM pair GROUP BY product_id""",
    "product_lines": """
        SELECT product_id, count(DISTINCT user_id) AS prod_nuser,
               count(DISTINCT order_id) AS prod_norder,
               count(DISTINCT user_id) FILTER (WHERE reordered = 1) AS prod_nruser,
               count(DISTINCT order_id) FILTER (WHERE reordered = 1) AS prod_nrorder,
               CAST(count(*) FILTER (WHERE order_time = 1) AS DOUBLE)
                   / count(*) FILTER (WHERE order_time = 0) AS prod_second_order_ratio
        FROM h GROUP BY product_id""",
    "product_block": """
        SELECT l.product_id, prod_nuser, prod_norder, prod_nruser, prod_nrorder,
               round(coalesce(days_gap, 366), 9) AS prod_days_interval_avg,
               round(coalesce(order_gap, 100), 9) AS prod_order_interval_avg,
               prod_second_order_ratio,
               CAST(prod_nruser AS DOUBLE) / prod_nuser AS prod_ruser_ratio,
               CAST(prod_nrorder AS DOUBLE) / prod_norder AS prod_rorder_ratio,
               CASE WHEN prod_nruser = 0 THEN 0 ELSE CAST(prod_nrorder AS DOUBLE) / prod_nruser END
                   AS prod_rorder_per_ruser,
               CAST(prod_norder AS DOUBLE) / prod_nuser AS prod_order_per_user
        FROM product_lines l JOIN product_pairs p ON l.product_id = p.product_id""",
    "pair_block": """
        SELECT p.user_id, p.product_id, p.n AS user_prod_norder,
               coalesce(p.order_gap, 100) AS user_prod_order_interval,
               coalesce(p.days_gap, 366) AS user_prod_days_interval,
               CASE WHEN user_norder = first_order THEN 0
                    ELSE CAST(p.n - 1 AS DOUBLE) / (user_norder - first_order) END
                   AS user_prod_reorder_rate,
               any_reordered AS user_prod_reordered,
               CAST(first_order = last_number AS INTEGER) AS user_prod_recentlydiscovered,
               round(coalesce(CASE WHEN u.order_gap <> 0 THEN coalesce(p.order_gap, 100)
                   / u.order_gap END, 80), 9) AS user_prod_order_interval_user_ratio,
               round(coalesce(CASE WHEN d.order_gap <> 0 THEN coalesce(p.order_gap, 100)
                   / d.order_gap END, 80), 9) AS user_prod_order_interval_prod_ratio,
               round(coalesce(CASE WHEN u.order_gap <> 0 THEN coalesce(p.days_gap, 366)
                   / u.order_gap END, 366), 9) AS user_prod_days_interval_user_ratio,
               round(coalesce(CASE WHEN d.order_gap <> 0 THEN coalesce(p.days_gap, 366)
                   / d.order_gap END, 366), 9) AS user_prod_days_interval_prod_ratio,
               p.n / user_avg_prod_norder AS user_prod_norder_user_ratio
        FROM pair p JOIN user_pairs u ON p.user_id = u.user_id
             JOIN user_lines l ON p.user_id = l.user_id
             JOIN product_pairs d ON p.product_id = d.product_id""",
    "target_block": """
        SELECT c.order_id, c.user_id, c.product_id, c.eval_set,
               o.days_since_prior_order AS user_lastorder_interval,
               CASE WHEN user_interval = 0 THEN 1600
                    ELSE coalesce(o.days_since_prior_order / user_interval, 1600) END
                   AS user_lastorder_interval_ratio,
               o.order_number - last_order_number AS user_prod_lastorder_interval,
               o.interval_accu - l.interval_accu AS user_prod_lastdays_interval,
               CASE WHEN user_prod_order_interval <> 0
                    THEN CAST(o.order_number - last_order_number AS DOUBLE)
                         / user_prod_order_interval END AS user_prod_lastorder_interval_rate,
               CASE WHEN user_prod_days_interval = 0 THEN 1600
                    ELSE (o.interval_accu - l.interval_accu) / user_prod_days_interval END
                   AS user_prod_lastdays_interval_rate
        FROM cand c JOIN accu_orders o ON c.order_id = o.order_id
             JOIN user_block u ON c.user_id = u.user_id
             JOIN last_purchase l ON c.user_id = l.user_id AND c.product_id = l.product_id
             JOIN pair_block p ON c.user_id = p.user_id AND c.product_id = p.product_id""",
    "r": "SELECT * FROM h WHERE reordered = 1",
    "time_block": """
        SELECT c.order_id, c.user_id, c.product_id, o.order_dow, o.order_hour_of_day,
               CAST(coalesce(ph.n, 0) AS DOUBLE) / nullif(hh.n, 0) AS prod_hour_prob,
               CAST(coalesce(pw.n, 0) AS DOUBLE) / nullif(ww.n, 0) AS prod_week_prob,
               CAST(coalesce(pw.n, 0) + 1 AS DOUBLE) / (coalesce(pp.n, 0) + 24) AS week_prod_prob,
               CAST(coalesce(ph.n, 0) + 1 AS DOUBLE) / (coalesce(pp.n, 0) + 7) AS hour_prod_prob,
               CAST(coalesce(uh.n, 0) + 1 AS DOUBLE) / (coalesce(uu.n, 0) + 24)
                   AS hour_user_reorder_prob,
               CAST(coalesce(uw.n, 0) + 1 AS DOUBLE) / (coalesce(uu.n, 0) + 7)
                   AS week_user_reorder_prob,
               CAST(coalesce(ph.r, 0) + 1 AS DOUBLE) / (coalesce(pp.r, 0) + 24)
                   AS hour_prod_reorder_prob,
               CAST(coalesce(pw.r, 0) + 1 AS DOUBLE) / (coalesce(pp.r, 0) + 7)
                   AS week_prod_reorder_prob,
               CAST(coalesce(puh.n, 0) + 1 AS DOUBLE) / (coalesce(pu.n, 0) + 24)
                   AS hour_prod_user_reorder_prob,
               CAST(coalesce(puw.n, 0) + 1 AS DOUBLE) / (coalesce(pu.n, 0) + 7)
                   AS week_prod_user_reorder_prob
        FROM cand c JOIN c_orders o ON c.order_id = o.order_id
        LEFT JOIN (SELECT order_hour_of_day AS k, count(*) AS n FROM h GROUP BY 1) hh
             ON hh.k = o.order_hour_of_day
        LEFT JOIN (SELECT order_dow AS k, count(*) AS n FROM h GROUP BY 1) ww ON ww.k = o.order_dow
        LEFT JOIN (SELECT product_id AS p, count(*) AS n, sum(reordered) AS r FROM h
                   GROUP BY 1) pp ON pp.p = c.product_id
        LEFT JOIN (SELECT product_id AS p, order_hour_of_day AS k, count(*) AS n,
                          sum(reordered) AS r FROM h GROUP BY 1, 2) ph
             ON ph.p = c.product_id AND ph.k = o.order_hour_of_day
        LEFT JOIN (SELECT product_id AS p, order_dow AS k, count(*) AS n, sum(reordered) AS r
                   FROM h GROUP BY 1, 2) pw ON pw.p = c.product_id AND pw.k = o.order_dow
        LEFT JOIN (SELECT user_id AS u, count(*) AS n FROM r GROUP BY 1) uu ON uu.u = c.user_id
        LEFT JOIN (SELECT user_id AS u, order_hour_of_day AS k, count(*) AS n FROM r
                   GROUP BY 1, 2) uh ON uh.u = c.user_id AND uh.k = o.order_hour_of_day
        LEFT JOIN (SELECT user_id AS u, order_dow AS k, count(*) AS n FROM r GROUP BY 1, 2) uw
             ON uw.u = c.user_id AND uw.k = o.order_dow
        LEFT JOIN (SELECT user_id AS u, product_id AS p, count(*) AS n FROM r GROUP BY 1, 2) pu
             ON pu.u = c.user_id AND pu.p = c.product_id
        LEFT JOIN (SELECT user_id AS u, product_id AS p, order_hour_of_day AS k, count(*) AS n
                   FROM r GROUP BY 1, 2, 3) puh
             ON puh.u = c.user_id AND puh.p = c.product_id AND puh.k = o.order_hour_of_day
        LEFT JOIN (SELECT user_id AS u, product_id AS p, order_dow AS k, count(*) AS n
                   FROM r GROUP BY 1, 2, 3) puw
             ON puw.u = c.user_id AND puw.p = c.product_id AND puw.k = o.order_dow""",
    "rd": "SELECT * FROM r JOIN c_products USING (product_id)",
    "id_block": """
        SELECT c.order_id, c.user_id, c.product_id, d.aisle_id, d.department_id,
               CAST(coalesce(ua.n, 0) + 1 AS DOUBLE) / (coalesce(uu.n, 0) + 134)
                   AS aisle_user_reorder_prob,
               CAST(coalesce(ud.n, 0) + 1 AS DOUBLE) / (coalesce(uu.n, 0) + 21)
                   AS dep_user_reorder_prob,
               CAST(coalesce(pr.n, 0) AS DOUBLE) / aa.n AS prod_aisle_reorder_prob,
               CAST(coalesce(pr.n, 0) AS DOUBLE) / dd.n AS prod_dep_reorder_prob
        FROM cand c JOIN c_products d ON c.product_id = d.product_id
        LEFT JOIN (SELECT user_id AS u, aisle_id AS k, count(*) AS n FROM rd GROUP BY 1, 2) ua
             ON ua.u = c.user_id AND ua.k = d.aisle_id
        LEFT JOIN (SELECT user_id AS u, department_id AS k, count(*) AS n FROM rd GROUP BY 1, 2) ud
             ON ud.u = c.user_id AND ud.k = d.department_id
        LEFT JOIN (SELECT user_id AS u, count(*) AS n FROM rd GROUP BY 1) uu ON uu.u = c.user_id
        LEFT JOIN (SELECT product_id AS p, count(*) AS n FROM rd GROUP BY 1) pr
             ON pr.p = c.product_id
        LEFT JOIN (SELECT aisle_id AS k, count(*) AS n FROM rd GROUP BY 1) aa ON aa.k = d.aisle_id
        LEFT JOIN (SELECT department_id AS k, count(*) AS n FROM rd GROUP BY 1) dd
             ON dd.k = d.department_id""",
    "features": """
        SELECT t.*, u.* EXCLUDE (user_id), p.* EXCLUDE (product_id),
               up.* EXCLUDE (user_id, product_id),
               w.* EXCLUDE (order_id, user_id, product_id),
               i.* EXCLUDE (order_id, user_id, product_id)
        FROM target_block t JOIN user_block u ON t.user_id = u.user_id
             JOIN product_block p ON t.product_id = p.product_id
             JOIN pair_block up ON t.user_id = up.user_id AND t.product_id = up.product_id
             JOIN time_block w ON t.order_id = w.order_id AND t.product_id = w.product_id
             JOIN id_block i ON t.order_id = i.order_id AND t.product_id = i.product_id""",
    "train_matrix": """
        SELECT f.* EXCLUDE (eval_set), l.label, s.seed
        FROM features f JOIN labelled l ON f.order_id = l.order_id AND f.product_id = l.product_id
             JOIN folds s ON f.user_id = s.user_id""",
    "test_matrix": "SELECT * EXCLUDE (eval_set) FROM features WHERE eval_set = 'test'",
    # Deterministic scores and their evaluation.
    "scored": """
        SELECT l.*, p.user_prod_reorder_rate AS pred_prob
        FROM labelled l JOIN pair_block p ON l.user_id = p.user_id AND l.product_id = p.product_id""",
    "outcome": """
        SELECT *, CAST(pred_prob > 0.177 AS INTEGER) AS pred FROM scored""",
    "user_outcome": """
        SELECT user_id, count(*) AS rows, count(*) FILTER (WHERE pred = 1 AND label = 1) AS tp,
               count(*) FILTER (WHERE pred = 1 AND label = 0) AS fp,
               count(*) FILTER (WHERE pred = 0 AND label = 1) AS fn
        FROM outcome GROUP BY user_id""",
    "user_metrics": """
        SELECT user_id,
               CASE WHEN tp + fp = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision,
               CASE WHEN tp + fn = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall,
               CAST(rows - fp - fn AS DOUBLE) / rows AS accuracy,
               CASE WHEN 2 * tp + fp + fn = 0 THEN 0
                    ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END AS f1
        FROM user_outcome""",
    "worst": "SELECT user_id FROM user_metrics ORDER BY f1, user_id LIMIT 1",
    "sweep": """
        SELECT threshold, avg(f1) AS mean_f1 FROM (
            SELECT threshold, user_id,
                   CASE WHEN count(*) FILTER (WHERE label = 1 OR pred_prob > threshold) = 0 THEN 0
                        ELSE CAST(2 * count(*) FILTER (WHERE label = 1 AND pred_prob > threshold)
                                  AS DOUBLE)
                             / (count(*) FILTER (WHERE label = 1)
                                + count(*) FILTER (WHERE pred_prob > threshold)) END AS f1
            FROM scored, (VALUES {grid}) g(threshold) GROUP BY threshold, user_id)
        GROUP BY threshold""",
    "order_stats": """
        SELECT p.user_id, p.product_id, p.n AS user_prod_norder,
               CAST(p.n AS DOUBLE) / last_number AS user_prod_order_rate,
               last_number - l.last_order_number + 1 AS user_prod_last_order_vacancy,
               CAST(p.n AS DOUBLE) / (l.last_order_number - p.first_order + 1)
                   AS user_prod_order_freq,
               CAST(p.n AS DOUBLE) / (last_number - p.first_order + 1)
                   AS up_order_rate_since_first_order
        FROM pair p JOIN last_purchase l ON p.user_id = l.user_id AND p.product_id = l.product_id
             JOIN user_lines u ON p.user_id = u.user_id""",
    "votes": """
        SELECT c.order_id, c.user_id, c.product_id,
               CAST(b.user_prod_reorder_rate > 0.05 AS INTEGER)
               + CAST(s.user_prod_order_rate > 0.15 AS INTEGER)
               + CAST(s.user_prod_order_freq > 0.3 AS INTEGER)
               + CAST(s.up_order_rate_since_first_order > 0.2 AS INTEGER)
               + CAST(1.0 / s.user_prod_last_order_vacancy > 0.25 AS INTEGER) AS votes
        FROM cand c JOIN order_stats s ON c.user_id = s.user_id AND c.product_id = s.product_id
             JOIN pair_block b ON c.user_id = b.user_id AND c.product_id = b.product_id
        WHERE c.eval_set = 'test'""",
    "test_scored": """
        SELECT c.order_id, c.product_id, CAST(p.user_prod_reorder_rate > 0.177 AS INTEGER) AS pred
        FROM cand c JOIN pair_block p ON c.user_id = p.user_id AND c.product_id = p.product_id
        WHERE c.eval_set = 'test'""",
    # Earlier feature set.
    "l_product": """
        SELECT product_id,
               CAST(count(*) FILTER (WHERE order_time = 1) AS DOUBLE)
                   / count(*) FILTER (WHERE order_time = 0) AS prod_norder_second_order_rate,
               CAST(count(*) AS DOUBLE) / count(*) FILTER (WHERE reordered = 0)
                   AS prod_norder_reorder_rate,
               count(*) AS prod_norder, CAST(sum(reordered) AS BIGINT) AS prod_nreorder
        FROM h GROUP BY product_id""",
    "l_users": """
        SELECT a.product_id, prod_nuser, prod_nuser_reorder,
               CAST(prod_nuser_reorder AS DOUBLE) / prod_nuser AS prod_nuser_reorder_rate
        FROM (SELECT product_id, count(DISTINCT user_id) AS prod_nuser FROM h GROUP BY 1) a
        JOIN (SELECT product_id, count(DISTINCT user_id) AS prod_nuser_reorder FROM r
              GROUP BY 1) b ON a.product_id = b.product_id""",
    "l_gap": """
        SELECT product_id, round(avg(days_since_prior_order), 9) AS prod_days_interval_avg
        FROM r GROUP BY product_id""",
    "l_dow": """
        SELECT p.product_id, CAST(d.k AS INTEGER) AS order_dow,
               CAST(coalesce(c.n, 0) + 1 AS DOUBLE)
                   / sum(coalesce(c.n, 0) + 1) OVER (PARTITION BY p.product_id) AS week_prob
        FROM (SELECT DISTINCT product_id FROM h) p CROSS JOIN range(7) d(k)
        LEFT JOIN (SELECT product_id, order_dow, count(*) AS n FROM h GROUP BY 1, 2) c
             ON c.product_id = p.product_id AND c.order_dow = d.k""",
    "l_hour": """
        SELECT p.product_id, CAST(d.k AS INTEGER) AS order_hour_of_day,
               CAST(coalesce(c.n, 0) + 1 AS DOUBLE)
                   / sum(coalesce(c.n, 0) + 1) OVER (PARTITION BY p.product_id) AS hour_prob
        FROM (SELECT DISTINCT product_id FROM h) p CROSS JOIN range(24) d(k)
        LEFT JOIN (SELECT product_id, order_hour_of_day, count(*) AS n FROM h GROUP BY 1, 2) c
             ON c.product_id = p.product_id AND c.order_hour_of_day = d.k""",
    "l_basket": """
        SELECT a.user_id, user_reorder_ratio, user_distinct_items, user_total_items,
               CAST(user_total_items AS DOUBLE) / orders AS user_avg_items
        FROM (SELECT user_id, count(DISTINCT product_id) AS user_distinct_items,
                     count(*) AS user_total_items, count(DISTINCT order_id) AS orders
              FROM h GROUP BY user_id) a
        JOIN (SELECT user_id, CAST(sum(reordered) AS DOUBLE) / count(*) AS user_reorder_ratio
              FROM h WHERE order_number <> 1 GROUP BY user_id) b ON a.user_id = b.user_id""",
    "l_interval": """
        SELECT user_id, avg(days_since_prior_order) AS user_interval_avg FROM c_orders
        WHERE days_since_prior_order IS NOT NULL GROUP BY user_id""",
    "l_user_dow": """
        SELECT user_id, order_dow,
               CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY user_id) AS user_week_prob
        FROM (SELECT user_id, order_dow, count(DISTINCT order_id) AS n FROM h GROUP BY 1, 2)""",
    "l_user_hour": """
        SELECT user_id, order_hour_of_day,
               CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY user_id) AS user_hour_prob
        FROM (SELECT user_id, order_hour_of_day, count(DISTINCT order_id) AS n
              FROM h GROUP BY 1, 2)""",
    "legacy": """
        SELECT c.order_id, c.user_id, c.product_id, c.eval_set,
               lp.* EXCLUDE (product_id), lg.prod_days_interval_avg,
               lu.* EXCLUDE (product_id), os.* EXCLUDE (user_id, product_id),
               lb.* EXCLUDE (user_id), li.user_interval_avg, o.order_dow, o.order_hour_of_day,
               o.days_since_prior_order, ld.week_prob, lh.hour_prob, ud.user_week_prob,
               uh.user_hour_prob,
               CASE WHEN user_interval_avg <> 0 THEN o.days_since_prior_order / user_interval_avg
                    END AS user_days_since_prior_ratio
        FROM cand c JOIN c_orders o ON c.order_id = o.order_id
             JOIN l_product lp ON c.product_id = lp.product_id
             JOIN l_gap lg ON c.product_id = lg.product_id
             JOIN l_users lu ON c.product_id = lu.product_id
             JOIN order_stats os ON c.user_id = os.user_id AND c.product_id = os.product_id
             JOIN l_basket lb ON c.user_id = lb.user_id
             JOIN l_interval li ON c.user_id = li.user_id
             LEFT JOIN l_dow ld ON ld.product_id = c.product_id AND ld.order_dow = o.order_dow
             LEFT JOIN l_hour lh ON lh.product_id = c.product_id
                  AND lh.order_hour_of_day = o.order_hour_of_day
             LEFT JOIN l_user_dow ud ON ud.user_id = c.user_id AND ud.order_dow = o.order_dow
             LEFT JOIN l_user_hour uh ON uh.user_id = c.user_id
                  AND uh.order_hour_of_day = o.order_hour_of_day""",
}

ORDER_COLUMNS = (
    "order_id, user_id, eval_set, order_number, order_dow, order_hour_of_day, "
    "days_since_prior_order"
)
HISTORY_COLUMNS = (
    "order_id, product_id, reordered, user_id, order_number, order_dow, order_hour_of_day, "
    "days_since_prior_order, interval_accu"
)


def _count(keys: str, name: str, source: str = "r", extra: str = "") -> str:
    return f"SELECT {keys}, count(*) AS {name}{extra} FROM {source} GROUP BY {keys}"


def _reorders(name: str) -> str:
    return f", count(*) FILTER (WHERE reordered = 1) AS {name}"


def _bracketed(name: str, low: float, high: float, tolerance: float, points: int = 41, most: int = 6) -> str:
    """The bracketed threshold search as one chain of passes; the first pass may widen the bracket."""
    passes = [f"p0 AS (SELECT CAST({low} AS DOUBLE) AS low, CAST({high} AS DOUBLE) AS high, false AS done, "
              "NULL::DOUBLE AS threshold, NULL::DOUBLE AS mean_f1, 0 AS passes)"]
    for n in range(1, most + 1):
        widen = f"AND place NOT IN (0, {points - 1})" if n == 1 else ""
        edges = (f"CASE WHEN place = 0 THEN 0.0 ELSE cuts[greatest(place, 1)] END AS low, "
                 f"CASE WHEN place = {points - 1} THEN 1.0 ELSE cuts[least(place + 2, {points})] END AS high"
                 ) if n == 1 else f"cuts[greatest(place, 1)] AS low, cuts[least(place + 2, {points})] AS high"
        passes.append(f"""p{n} AS (
            SELECT * FROM p{n - 1} WHERE done
            UNION ALL
            SELECT {edges}, cuts[2] - cuts[1] <= {tolerance} * (1 + 1e-6) {widen} AS done,
                   cuts[place + 1] AS threshold, mean_f1, {n} AS passes
            FROM (
                SELECT list(t ORDER BY i) AS cuts, max(mean_f1) AS mean_f1,
                       CAST(arg_min(i, struct_pack(a := -mean_f1, b := i)) AS INTEGER) AS place
                FROM (
                    SELECT i, t, round(avg(f1), 9) AS mean_f1 FROM (
                        SELECT c.i, c.t, s.user_id,
                               CAST(2 * count(*) FILTER (WHERE label = 1 AND pred_prob > c.t) AS DOUBLE)
                               / greatest(1, count(*) FILTER (WHERE label = 1)
                                             + count(*) FILTER (WHERE pred_prob > c.t)) AS f1
                        FROM scored s, (
                            SELECT i, round(low + (high - low) * i / {points - 1}, 12) AS t
                            FROM p{n - 1}, range({points}) AS r(i) WHERE NOT done) c
                        GROUP BY ALL)
                    GROUP BY ALL)
                HAVING count(*) > 0))""")
    return (f"SELECT * FROM (WITH {', '.join(passes)} "
            f"SELECT '{name}' AS bracket, threshold, mean_f1, CAST(passes AS INTEGER) AS passes FROM p{most})")


def _bodies() -> dict[str, str]:
    from encore.config import CATEGORICAL, HOLDOUT_DROPPED, KEYS
    from encore.plans.catalog import BRACKETS, SCALED

    dropped = ", ".join(HOLDOUT_DROPPED)
    scaled = ", ".join(
        f"round(coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), "
        f"CASE WHEN {c} IS NOT NULL THEN 0.0 END), 9) AS {c}"
        for c in SCALED
    )
    keys = ", ".join(KEYS)
    submission = """
        SELECT order_id, coalesce(string_agg(CAST(product_id AS VARCHAR), ' '
                   ORDER BY product_id) FILTER (WHERE pred = 1), 'None') AS products
        FROM {source} GROUP BY order_id"""
    orders = f"SELECT {ORDER_COLUMNS} FROM c_orders"
    train_candidates = f"SELECT {keys} FROM cand WHERE eval_set = 'train'"
    labelled_folds = "SELECT l.*, s.seed FROM labelled l JOIN folds s ON l.user_id = s.user_id"
    scored = f"SELECT {keys}, label, pred_prob, pred FROM outcome"
    fold_counts = """
        SELECT seed, count(*) AS rows, count(*) FILTER (WHERE label = 1) AS positives
        FROM {source} GROUP BY seed"""
    debug_sample = f"SELECT * FROM train_matrix ORDER BY {keys} LIMIT 10000"
    values = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, count(*) AS rows FROM train_matrix "
        f"WHERE {c} IS NOT NULL GROUP BY ALL" for c in CATEGORICAL)
    codes = f"""
        SELECT feature, value, rows, CAST(row_number() OVER (
            PARTITION BY feature ORDER BY rows DESC, value) - 1 AS INTEGER) AS code FROM ({values})"""
    code = ", ".join(
        f"CAST(coalesce(d_{c}.code, (SELECT count(*) FROM codes WHERE feature = '{c}')) AS INTEGER) AS {c}"
        for c in CATEGORICAL)
    joins = " ".join(
        f"LEFT JOIN codes d_{c} ON d_{c}.feature = '{c}' AND d_{c}.value = CAST(m.{c} AS VARCHAR)"
        for c in CATEGORICAL)
    frame = (f"SELECT * FROM (WITH codes AS ({codes}) "
             f"SELECT m.* EXCLUDE ({', '.join(CATEGORICAL)}), {code} FROM {{source}} m {joins})")
    return {
        "category_codes": codes,
        "training_frame": frame.format(source="train_matrix"),
        "test_frame": frame.format(source="test_matrix"),
        "canonical_orders": orders,
        "canonical_order_products": "SELECT * FROM prior_lines",
        "canonical_order_products_train": "SELECT * FROM truth_lines",
        "canonical_products": "SELECT * FROM c_products",
        "orders_csv_roundtrip": orders,
        "order_products_csv_roundtrip": "SELECT * FROM prior_lines",
        "products_csv_roundtrip": "SELECT * FROM c_products",
        "candidates_tsv_roundtrip": labelled_folds,
        "test_candidates_tsv_roundtrip": f"SELECT {keys} FROM cand WHERE eval_set = 'test'",
        "indexed_tsv_roundtrip": scored,
        "dataset_parquet_roundtrip": """
            SELECT * REPLACE (CAST(label AS DOUBLE) AS label, CAST(seed AS DOUBLE) AS seed),
                   'train' AS split
            FROM train_matrix
            UNION ALL BY NAME SELECT *, 'test' AS split FROM test_matrix""",
        "submission_csv_roundtrip": submission.format(source="test_scored"),
        "submission_file_roundtrip": submission.format(source="test_scored"),
        "dataset_replaced_key": f"""
            SELECT 'train' AS split, {keys} FROM train_matrix WHERE seed < 2
            UNION ALL SELECT 'test', {keys} FROM test_matrix""",
        "user_order_products": "SELECT order_id, user_id, product_id FROM h",
        "user_products": "SELECT DISTINCT user_id, product_id FROM h",
        "train_candidates": train_candidates,
        "train_labelled": "SELECT * FROM labelled",
        "fold_assignment": "SELECT * FROM folds",
        "test_candidates": f"SELECT {keys} FROM cand WHERE eval_set = 'test'",
        "order_interval_accu": f"SELECT {ORDER_COLUMNS}, interval_accu FROM accu_orders",
        "purchase_history": f"SELECT {HISTORY_COLUMNS} FROM h",
        "purchase_occurrence": f"SELECT {HISTORY_COLUMNS}, order_time FROM h",
        "user_features": "SELECT * FROM user_block",
        "product_features": "SELECT * FROM product_block",
        "user_product_features": "SELECT * FROM pair_block",
        "user_product_last": "SELECT * FROM last_purchase",
        "target_order_features": "SELECT * EXCLUDE (eval_set) FROM target_block",
        "hour_counts": _count("order_hour_of_day", "hour_cnt", "h"),
        "dow_counts": _count("order_dow", "week_cnt", "h"),
        "product_counts": _count("product_id", "prod_cnt", "h", _reorders("prod_rcnt")),
        "product_hour_counts": _count(
            "product_id, order_hour_of_day", "prod_hour_cnt", "h", _reorders("prod_hour_rcnt")
        ),
        "product_dow_counts": _count(
            "product_id, order_dow", "prod_week_cnt", "h", _reorders("prod_week_rcnt")
        ),
        "user_reorder_counts": _count("user_id", "user_rcnt"),
        "user_hour_counts": _count("user_id, order_hour_of_day", "user_hour_rcnt"),
        "user_dow_counts": _count("user_id, order_dow", "user_week_rcnt"),
        "user_product_reorder_counts": _count("product_id, user_id", "prod_user_rcnt"),
        "user_product_hour_counts": _count(
            "product_id, user_id, order_hour_of_day", "prod_user_hour_rcnt"
        ),
        "user_product_dow_counts": _count(
            "product_id, user_id, order_dow", "prod_user_week_rcnt"
        ),
        "time_features": "SELECT * FROM time_block",
        "user_aisle_counts": _count("user_id, aisle_id", "user_aisle_rcnt", "rd"),
        "user_department_counts": _count("user_id, department_id", "user_dep_rcnt", "rd"),
        "product_aisle_counts": _count("product_id, aisle_id", "prod_aisle_rcnt", "rd"),
        "product_department_counts": _count("product_id, department_id", "prod_dep_rcnt", "rd"),
        "aisle_counts": _count("aisle_id", "aisle_cnt", "rd"),
        "department_counts": _count("department_id", "dep_cnt", "rd"),
        "id_features": "SELECT * FROM id_block",
        "user_affinity": """
            SELECT t.user_id, a.aisle_id, d.department_id,
                   CAST(a.n AS DOUBLE) / t.n AS aisle_user_reorder_prob,
                   CAST(d.n AS DOUBLE) / t.n AS department_user_reorder_prob
            FROM (SELECT user_id, count(*) AS n FROM rd GROUP BY 1) t
            JOIN (SELECT user_id, aisle_id, count(*) AS n FROM rd GROUP BY 1, 2) a
                 ON a.user_id = t.user_id
            JOIN (SELECT user_id, department_id, count(*) AS n FROM rd GROUP BY 1, 2) d
                 ON d.user_id = t.user_id""",
        "feature_matrix_train": "SELECT * FROM train_matrix",
        "feature_matrix_test": "SELECT * FROM test_matrix",
        "product_reorder_stats": "SELECT * FROM l_product",
        "product_reorder_rate": "SELECT product_id, prod_norder_reorder_rate FROM l_product",
        "product_user_reorder": "SELECT * FROM l_users",
        "product_reorder_gap": "SELECT * FROM l_gap",
        "product_dow_share": """
            SELECT product_id, order_dow,
                   CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY product_id) AS prod_week_prob,
                   CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY order_dow) AS week_prod_prob
            FROM (SELECT product_id, order_dow, count(*) AS n FROM h GROUP BY 1, 2)""",
        "product_hour_share": """
            SELECT product_id, order_hour_of_day,
                   CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY product_id) AS prod_hour_prob,
                   CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY order_hour_of_day)
                       AS hour_prod_prob
            FROM (SELECT product_id, order_hour_of_day, count(*) AS n FROM h GROUP BY 1, 2)""",
        "product_dow_smoothed": "SELECT * FROM l_dow",
        "product_hour_smoothed": "SELECT * FROM l_hour",
        "user_product_order_stats": "SELECT * FROM order_stats",
        "user_basket_stats": "SELECT * FROM l_basket",
        "user_interval_avg": "SELECT * FROM l_interval",
        "user_dow_share": "SELECT * FROM l_user_dow",
        "user_hour_share": "SELECT * FROM l_user_hour",
        "legacy_matrix": """
            SELECT g.* EXCLUDE (eval_set), l.label FROM legacy g JOIN labelled l
                ON g.order_id = l.order_id AND g.product_id = l.product_id""",
        "legacy_matrix_test": "SELECT * EXCLUDE (eval_set) FROM legacy WHERE eval_set = 'test'",
        "cv_fold_counts": fold_counts.format(source="train_matrix"),
        "debug_sample": debug_sample,
        "debug_fold_counts": fold_counts.format(source=f"({debug_sample})"),
        "holdout_split": f"""
            SELECT * EXCLUDE ({dropped}),
                   CASE WHEN seed < 2 THEN 'train' ELSE 'valid' END AS split
            FROM train_matrix WHERE seed < 2 OR seed = 3""",
        "zero_based_ids": f"""
            SELECT {keys}, aisle_id - 1 AS aisle_id, department_id - 1 AS department_id,
                   order_dow - 1 AS order_dow, order_hour_of_day - 1 AS order_hour_of_day
            FROM train_matrix""",
        "standardised_features": f"SELECT {keys}, {scaled} FROM train_matrix WHERE seed < 2",
        "one_hot_aisle": """
            SELECT 'aisle_id' AS feature, CAST(aisle_id - 1 AS INTEGER) AS position,
                   CAST(count(*) AS DOUBLE) AS rows
            FROM train_matrix WHERE seed < 2 GROUP BY ALL
            UNION ALL SELECT 'user_prod_reordered', CAST(user_prod_reordered AS INTEGER),
                             CAST(count(*) AS DOUBLE)
            FROM train_matrix WHERE seed < 2 GROUP BY ALL""",
        "thresholded_predictions": f"SELECT {keys}, pred_prob, pred FROM outcome",
        "scored_rows": scored,
        "per_user_f1": "SELECT user_id, f1 FROM user_metrics",
        "mean_user_f1": "SELECT round(avg(f1), 9) AS mean_f1 FROM user_metrics",
        "user_debug_metrics": "SELECT * FROM user_metrics",
        "roc_auc": """
            SELECT CAST(sum(neg * (2 * above + pos)) AS DOUBLE)
                       / (2.0 * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS auc
            FROM (SELECT pos, neg, coalesce(sum(pos) OVER (ORDER BY pred_prob DESC
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above
                  FROM (SELECT pred_prob, count(*) FILTER (WHERE label = 1) AS pos,
                               count(*) FILTER (WHERE label = 0) AS neg
                        FROM scored GROUP BY pred_prob))""",
        "threshold_sweep": "SELECT threshold, round(mean_f1, 9) AS mean_f1 FROM sweep",
        "best_threshold": """
            SELECT threshold, round(mean_f1, 9) AS mean_f1 FROM sweep
            ORDER BY round(mean_f1, 9) DESC, threshold LIMIT 1""",
        "threshold_search": "\nUNION ALL ".join(
            _bracketed(name, *bracket, tolerance) for name, bracket, tolerance in BRACKETS),
        "best_threshold_exact": """
            SELECT threshold, round(mean_f1, 9) AS mean_f1 FROM (
                SELECT threshold, avg(f1) AS mean_f1 FROM (
                    SELECT g.threshold, s.user_id,
                           CAST(2 * count(*) FILTER (WHERE label = 1 AND pred_prob > g.threshold)
                                AS DOUBLE)
                           / greatest(1, count(*) FILTER (WHERE label = 1)
                                         + count(*) FILTER (WHERE pred_prob > g.threshold)) AS f1
                    FROM scored s CROSS JOIN (
                        SELECT DISTINCT pred_prob AS threshold FROM scored
                        UNION SELECT min(pred_prob) - 1 FROM scored) g
                    GROUP BY g.threshold, s.user_id)
                GROUP BY threshold)
            ORDER BY round(mean_f1, 9) DESC, threshold DESC LIMIT 1""",
        "case_user_rows": f"SELECT {keys}, label, pred_prob, pred FROM outcome JOIN worst USING (user_id)",
        "case_user_product_history": f"""
            SELECT {HISTORY_COLUMNS} FROM h
            WHERE (user_id, product_id) IN (
                SELECT (user_id, min(product_id)) FROM outcome JOIN worst USING (user_id)
                GROUP BY user_id)""",
        "case_order": f"""
            SELECT {ORDER_COLUMNS} FROM c_orders
            WHERE order_id IN (SELECT order_id FROM outcome JOIN worst USING (user_id))""",
        "ensemble_vote": f"SELECT {keys}, votes, CAST(votes > 3 AS INTEGER) AS pred FROM votes",
        "vote_baskets": submission.format(
            source="(SELECT *, CAST(votes > 3 AS INTEGER) AS pred FROM votes)"
        ),
        "submission": submission.format(source="test_scored"),
        **dict.fromkeys(("model_roundtrip", "model_text_roundtrip"), """
            SELECT count(*) AS rows, CAST(0 AS BIGINT) AS changed FROM train_matrix
            WHERE seed = 3"""),
    }


def _needed(body: str) -> list[str]:
    found: set[str] = set()
    todo = [body]
    while todo:
        words = set(re.findall(r"\b[a-z_]+\b", todo.pop()))
        for name in CTES.keys() & words - found:
            found.add(name)
            todo.append(CTES[name])
    return [name for name in CTES if name in found]


def oracle_sql() -> dict[str, str]:
    from encore.plans.catalog import grid_values

    grid = ", ".join(f"(CAST({t!r} AS DOUBLE))" for t in grid_values())
    queries = {}
    for name, body in _bodies().items():
        chain = ",\n".join(f"{cte} AS ({CTES[cte]})" for cte in _needed(body))
        queries[name] = f"WITH {chain}\n{body}".replace("{grid}", grid)
    return queries
