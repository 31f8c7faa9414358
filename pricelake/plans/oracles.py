"""The same questions in SQL for an independent engine. ``CHAIN`` builds the price-list tables, as :mod:`.proxies` does."""

from __future__ import annotations

CHAIN = """
base AS (
    SELECT concat_ws('-', lpad(CAST(l_orderkey AS VARCHAR), 12, '0'), lpad(CAST(l_linenumber AS VARCHAR), 2, '0'), l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'), CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS VARCHAR)) AS item_id,
        l_suppkey AS partner_id, concat_ws('-', l_suppkey, year(l_shipdate)) AS doc_id, CAST(l_partkey AS VARCHAR) AS code, p_name AS name, lower(p_name) AS name_norm, p_type AS section, p_brand AS unit,
        CASE l_returnflag WHEN 'A' THEN 'KZT' WHEN 'N' THEN 'USD' ELSE 'RUB' END AS currency, CAST(l_extendedprice AS DECIMAL(14,2)) AS price_original,
        CAST(round(CAST(l_extendedprice AS DECIMAL(14,2)) * (CAST(1 AS DECIMAL(4,2)) + CAST(l_tax AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(14,2)) AS nonresident_original,
        CAST(l_shipdate AS DATE) AS effective_date, l_linenumber
    FROM lineitem JOIN part ON l_partkey = p_partkey
), rates(code, per_unit) AS (VALUES ('USD', CAST(486.47 AS DECIMAL(12,6))), ('RUB', CAST(6.26 AS DECIMAL(12,6)))
), converted AS (
    SELECT base.*, item_id AS seq,
        CAST(CASE WHEN currency = 'KZT' THEN price_original ELSE round(price_original * coalesce(per_unit, CAST(1 AS DECIMAL(12,6))), 2) END AS DECIMAL(14,2)) AS r,
        CAST(CASE WHEN currency = 'KZT' THEN nonresident_original ELSE round(nonresident_original * coalesce(per_unit, CAST(1 AS DECIMAL(12,6))), 2) END AS DECIMAL(14,2)) AS n
    FROM base LEFT JOIN rates ON rates.code = currency
), priced AS (
    SELECT * EXCLUDE (r, n), CAST(CASE WHEN r <= 50000000 THEN r END AS DOUBLE) AS price_resident, CAST(CASE WHEN n <= 50000000 THEN n END AS DOUBLE) AS price_nonresident FROM converted
), accepted AS (
    SELECT *, coalesce(effective_date >= max(effective_date) OVER (PARTITION BY partner_id, code ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS ok FROM priced
), chained AS (
    SELECT *, last_value(CASE WHEN ok THEN {'d': effective_date, 'p': price_resident} END IGNORE NULLS) OVER (PARTITION BY partner_id, code ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
        seq = max(CASE WHEN ok THEN seq END) OVER (PARTITION BY partner_id, code) AS is_active FROM accepted
), folded AS (
    SELECT * EXCLUDE (ok, prev), CASE WHEN ok AND prev.d IS NOT NULL AND prev.d <> effective_date THEN prev.p END AS prev_resident FROM chained
), services AS (
    SELECT p_name AS service_name, min(p_partkey) AS seq, 'S' || min(p_partkey) AS service_id, min(p_type) AS category FROM part WHERE length(p_name) % 3 <> 0 GROUP BY p_name
), reasoned AS (
    SELECT folded.*, service_id, l_linenumber = 7 AS is_verified, CASE WHEN service_id IS NOT NULL THEN 'exact' END AS match_method, CASE WHEN service_id IS NOT NULL THEN 1.0::DOUBLE END AS match_confidence,
        nullif(concat_ws('; ',
            CASE WHEN price_resident IS NULL OR price_resident <= 0 THEN 'price missing or not positive' END,
            CASE WHEN price_nonresident < price_resident THEN 'nonresident price lower than resident' END,
            CASE WHEN effective_date > DATE '1998-06-01' THEN 'effective date is in the future' END,
            CASE WHEN prev_resident > 0 AND price_resident <> 0 AND abs(price_resident - prev_resident) / prev_resident > 0.5 THEN 'price changed ' || CAST(round_even(abs(price_resident - prev_resident) / prev_resident * 100, 0) AS BIGINT) || '% vs previous version' END
        ), '') AS review_reason
    FROM folded LEFT JOIN services ON lower(service_name) = name_norm
), items AS (SELECT *, review_reason IS NOT NULL AS needs_review FROM reasoned
), partners AS (
    SELECT s_suppkey AS partner_id, s_name AS name, n_name AS city, s_acctbal >= 0 AS is_active FROM supplier JOIN nation ON s_nationkey = n_nationkey
), reports AS (
    SELECT doc_id, count(*) AS parsed, count(*) FILTER (l_linenumber <> 6) AS written, count(*) FILTER (l_linenumber = 6) AS dropped, count(*) FILTER (l_linenumber <> 6 AND needs_review) AS review,
        count(*) FILTER (l_linenumber <> 6 AND service_id IS NOT NULL) AS matched FROM items GROUP BY doc_id
), statused AS (SELECT *, CASE WHEN written = 0 THEN 'error' WHEN review > 0 THEN 'needs_review' ELSE 'done' END AS status FROM reports
), docs AS (
    SELECT p.doc_id, min(partner_id) AS partner_id, make_date(year(min(effective_date)), 1, 1) AS effective_date, min(status) AS parse_status FROM priced p JOIN statused s ON s.doc_id = p.doc_id GROUP BY p.doc_id
)
"""


def sql(select: str, *more: str) -> str:
    """A query over the chain, with further common table expressions."""
    return "WITH " + ",\n".join([CHAIN.strip(), *more]) + "\n" + select
