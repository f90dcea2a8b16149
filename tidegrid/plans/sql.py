"""Common table expressions of the SQL forms: name -> (names it needs, SQL)."""

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), "SELECT CAST(user_id % 4 AS VARCHAR) AS stream, event_id AS seq, CAST(epoch_us(ts) * 1000 AS BIGINT) AS ts_ns, value, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "trades": (("ev",), "SELECT stream, seq, ts_ns, 75.0::DOUBLE + 0.5::DOUBLE * k AS price, value AS size, CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 ELSE 2 END AS side FROM ev"),
    "books": (("ev",), "SELECT stream, seq, max(ts_ns) OVER (PARTITION BY stream ORDER BY seq ROWS UNBOUNDED PRECEDING) AS eff FROM ev WHERE seq % 5 = 0"),
    "hours": (
        ("ev", "trades"),
        """SELECT stream, ts_ns // 3600000000000 AS col_idx, arg_min(price, seq) AS o, max(price) AS h, min(price) AS l, arg_max(price, seq) AS c,
        sum(CASE WHEN side = 0 THEN size ELSE 0 END) AS vol_buy, sum(CASE WHEN side = 1 THEN size ELSE 0 END) AS vol_sell,
        sum(CASE side WHEN 0 THEN size WHEN 1 THEN -size ELSE 0 END) AS delta, sum(price * size) AS num, sum(size) AS den FROM trades GROUP BY 1, 2""",
    ),
    "bars": (
        ("ev", "trades", "hours"),
        """SELECT stream, col_idx - min(col_idx) OVER (PARTITION BY stream) AS col_seq, CAST(col_idx * 3600000000000 AS BIGINT) AS t0_ns, coalesce(o, cc) AS o, coalesce(h, cc) AS h, coalesce(l, cc) AS l, cc AS c,
        coalesce(vol_buy, 0) AS vol_buy, coalesce(vol_sell, 0) AS vol_sell, cvd_cum, vwap_num_cum, vwap_den_cum, CASE WHEN vwap_den_cum > 0 THEN vwap_num_cum / vwap_den_cum END AS vwap
        FROM (SELECT g.stream, g.col_idx, o, h, l, vol_buy, vol_sell, last_value(c IGNORE NULLS) OVER w AS cc, sum(coalesce(delta, 0)) OVER w AS cvd_cum, sum(coalesce(num, 0)) OVER w AS vwap_num_cum, sum(coalesce(den, 0)) OVER w AS vwap_den_cum
          FROM (SELECT stream, unnest(range(min(col_idx), max(col_idx) + 1)) AS col_idx FROM hours GROUP BY stream) g LEFT JOIN hours USING (stream, col_idx)
          WINDOW w AS (PARTITION BY g.stream ORDER BY g.col_idx ROWS UNBOUNDED PRECEDING))""",
    ),
    "intervals": (
        ("ev",),
        """SELECT stream, seq, side, price, amount AS size, eff AS from_ns, coalesce(CASE WHEN fseq < coalesce(nseq, 9223372036854775807) THEN feff ELSE neff END, last_ns) AS till_ns
        FROM (SELECT *, lead(seq) OVER w AS fseq, lead(eff) OVER w AS feff
          FROM (SELECT *, 75.0::DOUBLE + 0.5::DOUBLE * k AS price, CASE WHEN k < 50 THEN 0 ELSE 1 END AS side, CASE WHEN event_type = 'error' THEN 0 ELSE value END AS amount, max(eff) OVER (PARTITION BY stream) AS last_ns,
              max(snap) OVER (PARTITION BY stream ORDER BY seq ROWS UNBOUNDED PRECEDING) AS started,
              min(snap) OVER (PARTITION BY stream ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nseq,
              min(snap_eff) OVER (PARTITION BY stream ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS neff
            FROM (SELECT *, max(ts_ns) OVER (PARTITION BY stream ORDER BY seq ROWS UNBOUNDED PRECEDING) AS eff, CASE WHEN seq % 500 = 0 THEN seq END AS snap, CASE WHEN seq % 500 = 0 THEN ts_ns END AS snap_eff FROM ev))
          WHERE started IS NOT NULL WINDOW w AS (PARTITION BY stream, side, price ORDER BY seq))
        WHERE amount > 0""",
    ),
    "cells": (
        ("ev", "intervals"),
        """SELECT stream, col_idx, CAST(row AS INTEGER) AS row, sum(CASE WHEN side = 0 THEN v ELSE 0 END) AS bid, sum(CASE WHEN side = 1 THEN v ELSE 0 END) AS ask
        FROM (SELECT stream, side, row, col_idx, size * (least(till_ns, (col_idx + 1) * 3600000000000) - greatest(from_ns, col_idx * 3600000000000)) / 3600000000000.0::DOUBLE AS v
          FROM (SELECT *, round_even((price - 70) / 0.5, 0) AS row, unnest(range(from_ns // 3600000000000, (till_ns - 1) // 3600000000000 + 1)) AS col_idx FROM intervals WHERE till_ns > from_ns) WHERE row BETWEEN 0 AND 127)
        GROUP BY 1, 2, 3""",
    ),
    "newest": (("ev", "intervals", "cells"), "SELECT c.* FROM cells c JOIN (SELECT stream, max(col_idx) AS col_idx FROM cells GROUP BY stream) USING (stream, col_idx)"),
    "level1": (("ev", "intervals", "cells"), "SELECT stream, CAST(col_idx // 4 AS BIGINT) AS col_idx, CAST(row // 4 AS INTEGER) AS row, least(sum(bid), 60000) AS bid, least(sum(ask), 60000) AS ask FROM cells JOIN (SELECT stream, max(col_idx) AS last FROM cells GROUP BY stream) USING (stream) WHERE (col_idx // 4 + 1) * 4 <= last + 1 GROUP BY 1, 2, 3"),
    "extents": (
        ("ev", "intervals", "cells"),
        "SELECT stream, col_idx, min(row) FILTER (bid > 0 OR ask > 0) AS lo, max(row) FILTER (bid > 0 OR ask > 0) AS hi, max(row) FILTER (bid > 0) AS bid_top, min(row) FILTER (ask > 0) AS ask_bot FROM cells GROUP BY 1, 2",
    ),
    "histogram": (
        ("ev", "intervals", "cells"),
        """SELECT stream, CAST(col_idx // 256 AS BIGINT) AS tile, CAST(greatest(0, least(255, floor((ln(v) - ln(1/64.0::DOUBLE)) * (256 / (ln(65536.0::DOUBLE) - ln(1/64.0::DOUBLE)))))) AS INTEGER) AS bin, count(*) AS n
        FROM (SELECT stream, col_idx, unnest([round(bid, 6), round(ask, 6)]) AS v FROM cells) WHERE v > 0 GROUP BY 1, 2, 3""",
    ),
    "candles": (
        (),
        """SELECT o_orderpriority AS stream, CAST(epoch_us(date_trunc('week', o_orderdate)::TIMESTAMP) * 1000 AS BIGINT) AS t0_ns, arg_min(o_totalprice / 1000, o_orderkey) AS o, max(o_totalprice / 1000) AS h,
        min(o_totalprice / 1000) AS l, arg_max(o_totalprice / 1000, o_orderkey) AS c, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2""",
    ),
    "gridded": (
        ("candles",),
        """SELECT *, max((t0_ns // 1209600000000000) * 1209600000000000 - n * 1209600000000000) OVER (PARTITION BY stream ORDER BY n ROWS UNBOUNDED PRECEDING) + n * 1209600000000000 AS t0
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY stream ORDER BY t0_ns) - 1 AS INTEGER) AS n FROM candles)""",
    ),
    "quoted": (
        ("candles",),
        """SELECT *, CASE WHEN first <> 0 THEN (price - first) / first * 100 END AS change_pct
        FROM (SELECT stream, arg_max(c, t0_ns) AS price, arg_min(c, t0_ns) AS first, least(64, count(*)) AS points FROM candles GROUP BY stream)""",
    ),
    "directory": (
        (),
        """SELECT *, CASE WHEN market = 'sim' THEN 'sim' WHEN market = 'equity' THEN 'equity' ELSE 'crypto' END AS grp
        FROM (SELECT p_partkey AS id, p_name AS symbol, CASE p_brand WHEN 'Brand#1' THEN 'equity' WHEN 'Brand#2' THEN 'sim' ELSE 'venue' || replace(p_brand, 'Brand#', '') || '-spot' END AS market FROM part)""",
    ),
}


def score_sql(column: str, q: str, name: str) -> str:
    """Columns of a SELECT that end in ``name``: the score of a search for ``q``; each letter's first place after the one before."""
    t, n = f"t_{name}", len(q)
    p = [f"p{k}_{name}" for k in range(n)]
    run = [f"r{k}_{name}" for k in range(n)]
    out = [f"lower({column}) AS {t}", f"instr({t}, '{q[0]}') AS {p[0]}", f"1 AS {run[0]}"]
    for k in range(1, n):
        rest = f"instr(substr({t}, CAST({p[k - 1]} + 1 AS BIGINT)), '{q[k]}')"
        out += [f"CASE WHEN {p[k - 1]} > 0 AND {rest} > 0 THEN {p[k - 1]} + {rest} ELSE 0 END AS {p[k]}", f"CASE WHEN {p[k]} = {p[k - 1]} + 1 THEN {run[k - 1]} + 1 ELSE 1 END AS {run[k]}"]
    loose = f"CASE WHEN {p[-1]} > 0 THEN 100.0::DOUBLE + {' + '.join(run)} + CASE WHEN {p[0]} = 1 THEN 5 ELSE 0 END - length({t}) * 0.1::DOUBLE ELSE -1.0::DOUBLE END"
    out.append(f"CASE WHEN {t} = '{q}' THEN 1000.0::DOUBLE WHEN starts_with({t}, '{q}') THEN 800.0::DOUBLE - length({t}) WHEN contains({t}, '{q}') THEN 600.0::DOUBLE - (instr({t}, '{q}') - 1) - length({t}) * 0.1::DOUBLE ELSE {loose} END AS {name}")
    return ", ".join(out)
