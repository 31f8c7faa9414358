"""The registered queries, each with its SQL where SQL can say it. ``QUERIES`` and ``ORACLES`` go by name."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, numbers, tariffs, text
from ..operators import golden, grid, history, layout, matching, overlay, pages, quality, queries, rates, statistics
from ..sources import formats, model_rows, rate_feed
from ..sources import catalogue as catalogue_files
from . import golden_rows
from .oracles import sql
from .proxies import AS_OF, Proxies, item_id

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Callable[[Proxies], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Proxies(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def names(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns)


# ---------------------------------------------------------------- lists, filters, pages


@query(sql("SELECT service_id, service_name, category FROM services ORDER BY service_name ASC NULLS LAST, service_id LIMIT 50"))
def service_list(p: Proxies) -> DataFrame:
    return queries.page(p.services, [F.asc_nulls_last("service_name"), F.asc("service_id")], 50, most=1000).select("service_id", "service_name", "category")


@query(sql("SELECT service_id, service_name, category FROM services WHERE category = (SELECT min(category) FROM services) ORDER BY service_name LIMIT 1000"))
def service_list_category(p: Proxies) -> DataFrame:
    first = p.services.agg(F.min("category").alias("category"))
    return queries.page(p.services.join(F.broadcast(first), "category", "left_semi"), [F.asc_nulls_last("service_name")], 1000).select("service_id", "service_name", "category")


@query(sql("SELECT service_id, service_name FROM services WHERE service_name ILIKE '%RE_%' ORDER BY service_name LIMIT 1000"))
def service_search_ilike(p: Proxies) -> DataFrame:
    return queries.page(p.services.where(text.ilike_any(F.col("service_name"), "RE_")), [F.asc_nulls_last("service_name")], 1000).select("service_id", "service_name")


@query(sql("SELECT partner_id, name, city FROM partners WHERE is_active AND city ILIKE '%n%' ORDER BY name NULLS LAST, partner_id OFFSET 1 LIMIT 200"))
def partner_list_city_active(p: Proxies) -> DataFrame:
    found = queries.where_flag(p.partners, "is_active", True).where(text.ilike_any(F.col("city"), "n"))
    return queries.page(queries.where_given(found, city=""), [F.asc_nulls_last("name"), F.asc("partner_id")], 200, 1, 2000).select("partner_id", "name", "city")


@query(sql("SELECT item_id, name, section, price_resident FROM items WHERE partner_id = 7 AND is_active ORDER BY section NULLS LAST, name NULLS LAST, seq OFFSET 3 LIMIT 40"))
def partner_price_list_raw(p: Proxies) -> DataFrame:
    return queries.price_list(p.items, 7, limit=40, offset=3).select("item_id", "name", "section", "price_resident")


@query(
    sql(
        """SELECT partner_id, name, currency, price, count(*) AS merged_count, CASE WHEN count(*) > 1 THEN string_agg(DISTINCT code, ',' ORDER BY code) END AS merged_codes, min(seq) AS first_seq
        FROM rounded GROUP BY partner_id, name, currency, price""",
        "rounded AS (SELECT partner_id, trim(name) AS name, currency, code, seq, floor(price_resident / 100000) * 100000 AS price FROM items WHERE is_active AND price_resident IS NOT NULL)",
    )
)
def partner_price_list_aggregated(p: Proxies) -> DataFrame:
    """Rows that differ in their code only are one; prices are coarse here so that there are some."""
    own = p.items.where("is_active and price_resident is not null").withColumn("price_resident", F.floor(F.col("price_resident") / 100000) * F.lit(100000.0))
    own = own.select("seq", F.concat_ws("|", "partner_id", "name").alias("name"), "code", "currency", "price_resident", F.lit(None).cast("double").alias("price_nonresident"), F.lit(None).cast("map<string,decimal(14,2)>").alias("tiers"), "partner_id", F.col("name").alias("plain"))
    out = queries.merged(own)
    return out.select("partner_id", F.trim("plain").alias("name"), "currency", F.col("price_resident").alias("price"), "merged_count", F.array_join(F.array_sort("merged_codes"), ",").alias("merged_codes"), F.col("seq").alias("first_seq"))


@query(sql("SELECT service_id, i.partner_id, p.name AS partner_name, city, price_resident FROM items i JOIN partners p ON p.partner_id = i.partner_id WHERE i.is_active AND service_id IS NOT NULL"))
def service_partners_cheapest(p: Proxies) -> DataFrame:
    return queries.offers(p.items, p.partners, p.services.select("service_id")).select("service_id", "partner_id", "partner_name", "city", "price_resident")


@query(sql("SELECT item_id, i.partner_id, p.name AS partner_name, i.name, price_resident FROM items i LEFT JOIN partners p ON p.partner_id = i.partner_id WHERE i.is_active AND (i.name ILIKE '%red%' OR name_norm ILIKE '%red%') ORDER BY name_norm, price_resident NULLS LAST, seq LIMIT 50"))
def search_items(p: Proxies) -> DataFrame:
    found = queries.with_partner(queries.search_items(p.items, "red", "red"), p.partners)
    return queries.page(found, [F.asc("name_norm"), F.asc_nulls_last("price_resident"), F.asc("seq")], 50, most=500).select("item_id", "partner_id", "partner_name", "name", "price_resident")


@query(sql("SELECT 'partner' AS kind, CAST(partner_id AS VARCHAR) AS id, name FROM partners WHERE name ILIKE '%0%' UNION ALL SELECT 'service', service_id, service_name FROM services WHERE service_name ILIKE '%0%'"))
def search_partners_services(p: Proxies) -> DataFrame:
    own = lambda kind, df, i, n: df.where(text.ilike_any(F.col(n), "0")).select(F.lit(kind).alias("kind"), F.col(i).cast("string").alias("id"), F.col(n).alias("name"))
    return own("partner", p.partners, "partner_id", "name").unionByName(own("service", p.services, "service_id", "service_name"))


@query(sql("SELECT item_id, name FROM items WHERE is_active AND service_id IS NULL"))
def queue_unmatched(p: Proxies) -> DataFrame:
    return queries.unmatched(p.items).select("item_id", "name")


@query(sql("SELECT item_id, review_reason FROM items WHERE needs_review AND NOT is_verified"))
def queue_review(p: Proxies) -> DataFrame:
    return queries.review(p.items).select("item_id", "review_reason")


@query(
    sql(
        "SELECT item_id, reason AS review_reason, list_aggregate(list_transform(list_filter(string_split(reason, ';'), lambda x: trim(x) LIKE 'LLM:%'), lambda x: trim(trim(x)[5:])), 'string_agg', '|') AS flags FROM noted WHERE is_active AND NOT is_verified AND reason LIKE '%LLM:%'",
        "noted AS (SELECT *, concat_ws('; ', review_reason, CASE WHEN l_linenumber % 3 = 1 THEN 'LLM: odd name' END, CASE WHEN l_linenumber % 2 = 1 THEN 'LLM: unit missing' END) AS reason FROM items)",
    )
)
def queue_flagged(p: Proxies) -> DataFrame:
    noted = F.concat_ws("; ", "review_reason", F.when(F.col("l_linenumber") % 3 == 1, "LLM: odd name"), F.when(F.col("l_linenumber") % 2 == 1, "LLM: unit missing"))
    return queries.flagged(p.items.withColumn("review_reason", noted)).select("item_id", "review_reason", F.array_join(text.llm_flags(F.col("review_reason")), "|").alias("flags"))


@query(sql("SELECT item_id, CASE WHEN regexp_matches(review_reason, '(?i)цен|price|резидент|resident|nonresident|implausible|тариф') THEN 'price' WHEN regexp_matches(review_reason, '(?i)наименован|назван|name|пуст|empty') THEN 'name' WHEN regexp_matches(review_reason, '(?i)измен|change|%|previous|верси') THEN 'change' ELSE 'other' END AS bucket FROM items WHERE needs_review"))
def review_buckets(p: Proxies) -> DataFrame:
    return p.items.where("needs_review").select("item_id", text.review_bucket(F.col("review_reason")).alias("bucket"))


@query(sql("SELECT item_id FROM items WHERE lower(concat_ws(' ', coalesce(name, ''), coalesce(code, ''), coalesce(section, ''))) LIKE '%re%' AND year(effective_date) = 1996"))
def filter_includes_year(p: Proxies) -> DataFrame:
    return p.items.where(text.contains_folded(" RE ", F.col("name"), F.col("code"), F.col("section")) & (F.year("effective_date") == 1996)).select("item_id")


@query(sql("SELECT item_id, row_number() OVER (PARTITION BY partner_id ORDER BY CASE CAST(code AS BIGINT) % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END, CAST(code AS BIGINT), l_linenumber, item_id) AS place FROM base"))
def natural_sorted(p: Proxies) -> DataFrame:
    """Every item's place in its partner's list by codes such as ``B1204.3``, whose numbers compare as numbers."""
    letter = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("code").cast("long") % 3 + 1).cast("int"))
    raw = F.concat(letter, "code", F.lit("."), F.col("l_linenumber").cast("string"))
    place = F.row_number().over(Window.partitionBy("partner_id").orderBy("__key", "item_id"))
    return p.base.withColumn("__key", text.natural_key(raw)).select("item_id", place.cast("long").alias("place"))


# ---------------------------------------------------------------- history and versions


@query(sql("SELECT partner_id, code, seq, is_active, prev_resident FROM folded"))
def version_fold(p: Proxies) -> DataFrame:
    return p.folded.select("partner_id", "code", "seq", "is_active", "prev_resident")


@query(sql("SELECT item_id, partner_id, code, name, effective_date, price_resident, price_nonresident, needs_review, review_reason, service_id FROM items WHERE is_active"))
def current_items(p: Proxies) -> DataFrame:
    return p.items.where("is_active").select("item_id", "partner_id", "code", "name", "effective_date", "price_resident", "price_nonresident", "needs_review", "review_reason", "service_id")


@query(sql("SELECT item_id, round(abs(price_resident - prev_resident) / prev_resident * 100, 3) AS change_pct FROM folded WHERE prev_resident > 0 AND price_resident <> 0 AND abs(price_resident - prev_resident) / prev_resident * 100 > 50"))
def price_anomalies(p: Proxies) -> DataFrame:
    from ..operators.versions import anomalies

    return anomalies(p.folded).select("item_id", F.round("change_pct", 3).alias("change_pct"))


@query(sql("SELECT item_id, effective_date, price_resident FROM items WHERE partner_id = (SELECT min(partner_id) FROM seed) AND (code = (SELECT min(code) FROM seed) OR name_norm = (SELECT min(name_norm) FROM seed))", "seed AS (SELECT * FROM items WHERE seq = (SELECT min(seq) FROM items))"))
def item_history(p: Proxies) -> DataFrame:
    """Of one item, superseded prices included; two equi-joins instead of an OR."""
    seed = p.items.join(F.broadcast(p.items.agg(F.min("seq").alias("seq"))), "seq", "left_semi")
    pairs = history.related_pairs(p.items, seed)
    return p.items.join(pairs, "item_id", "left_semi").select("item_id", "effective_date", "price_resident")


@query(
    sql(
        "SELECT seed_id, count(*) AS related FROM pairs GROUP BY seed_id",
        "asked AS (SELECT item_id AS seed_id, partner_id, code, name_norm FROM items WHERE is_active)",
        "pairs AS (SELECT seed_id, item_id FROM asked a JOIN items i ON i.partner_id = a.partner_id AND i.code = a.code UNION SELECT seed_id, item_id FROM asked a JOIN items i ON i.partner_id = a.partner_id AND i.name_norm = a.name_norm)",
    )
)
def history_bulk(p: Proxies) -> DataFrame:
    return history.related_counts(p.items, p.items.where("is_active"))


_POINTS = "points AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY partner_id, name_norm, effective_date ORDER BY price_resident IS NULL, seq) AS nth FROM priced) WHERE nth = 1)"


@query(sql("SELECT partner_id, name_norm, effective_date, price_resident, round((price_resident - before) / nullif(before, 0) * 100, 3) AS change_pct FROM (SELECT *, lag(price_resident) OVER (PARTITION BY partner_id, name_norm ORDER BY effective_date) AS before FROM points)", _POINTS))
def history_yoy(p: Proxies) -> DataFrame:
    by = ["partner_id", "name_norm"]
    return history.changes(history.points(p.priced, by, ["seq"]), by).select(*by, "effective_date", "price_resident", F.round("change_pct", 3).alias("change_pct"))


@query(sql("SELECT partner_id, name_norm, first_price, last_price, round((last_price - first_price) / nullif(first_price, 0) * 100, 3) AS total_change_pct, years, points FROM (SELECT partner_id, name_norm, min_by(price_resident, CASE WHEN price_resident IS NOT NULL THEN effective_date END) AS first_price, max_by(price_resident, CASE WHEN price_resident IS NOT NULL THEN effective_date END) AS last_price, count(DISTINCT year(effective_date)) AS years, count(*) AS points FROM points GROUP BY partner_id, name_norm)", _POINTS))
def history_overall(p: Proxies) -> DataFrame:
    by = ["partner_id", "name_norm"]
    out = history.overall(history.points(p.priced, by, ["seq"]), by)
    return out.withColumn("total_change_pct", F.round("total_change_pct", 3)).select(*by, "first_price", "last_price", "total_change_pct", "years", "points")


# ---------------------------------------------------------------- counters


@query(sql("SELECT items, matched, needs_review, documents, partners, services, CASE WHEN items > 0 THEN round_even(matched / items * 100, 1) ELSE 0.0 END AS match_rate FROM (SELECT (SELECT count(*) FROM items) AS items, (SELECT count(service_id) FROM items) AS matched, (SELECT count(*) FROM items WHERE needs_review) AS needs_review, (SELECT count(*) FROM docs) AS documents, (SELECT count(*) FROM partners) AS partners, (SELECT count(*) FROM services) AS services)"))
def stats_overview(p: Proxies) -> DataFrame:
    return statistics.overview(p.documents, p.partners, p.services, p.items)


@query(sql("SELECT parse_status, count(*) AS n FROM docs GROUP BY parse_status"))
def docs_by_status(p: Proxies) -> DataFrame:
    return statistics.by_status(p.documents)


@query(sql("SELECT slice, n FROM (SELECT 'matched' AS slice, count(service_id) AS n FROM items UNION ALL SELECT 'needs_review', count(*) FROM items WHERE needs_review UNION ALL SELECT 'other', greatest(0, count(*) - count(service_id) - count(*) FILTER (needs_review)) FROM items) WHERE n > 0"))
def status_pie(p: Proxies) -> DataFrame:
    return statistics.pie(p.items)


@query(sql("SELECT doc_id, parsed, written, dropped, review, matched, status FROM statused"))
def ingest_report(p: Proxies) -> DataFrame:
    return p.reports.select("doc_id", "parsed", "written", "dropped", "review", "matched", "status")


@query(sql("SELECT count(*) AS files, count(*) FILTER (status = 'error') AS errors, CAST(sum(written) AS BIGINT) AS rows_written, CAST(sum(review) AS BIGINT) AS rows_needs_review FROM statused"))
def job_rollup(p: Proxies) -> DataFrame:
    return statistics.job_rollup(p.reports)


# ---------------------------------------------------------------- rates, tiers, prices


@query(sql("SELECT item_id, price_resident, price_nonresident FROM priced"))
def fx_convert(p: Proxies) -> DataFrame:
    return p.priced.select("item_id", "price_resident", "price_nonresident")


def _feed(p: Proxies) -> DataFrame:
    """Rates of some days, out of the events: one per day and currency, every third day missing."""
    day = F.to_date("ts")
    own = p.table("events").groupBy(day.alias("as_of")).agg(F.count("*").alias("n"))
    coded = own.where(F.dayofmonth("as_of") % 3 != 0).withColumn("code", F.explode(F.array(F.lit("USD"), F.lit("RUB"))))
    return coded.select("as_of", "code", (F.when(F.col("code") == "USD", 400).otherwise(5) + F.col("n") / 100).cast("decimal(12,6)").alias("per_unit"))


_FEED = "feed AS (SELECT as_of, code, CAST(CASE code WHEN 'USD' THEN 400 ELSE 5 END + n / 100 AS DECIMAL(12,6)) AS per_unit FROM (SELECT CAST(ts AS DATE) AS as_of, count(*) AS n FROM events GROUP BY 1) CROSS JOIN (VALUES ('USD'), ('RUB')) c(code) WHERE day(as_of) % 3 <> 0)"


@query(
    "WITH "
    + _FEED
    + """, wanted AS (SELECT DISTINCT CAST(ts AS DATE) AS as_of, code FROM events CROSS JOIN (VALUES ('USD'), ('RUB')) c(code))
    SELECT w.as_of, w.code, CAST(coalesce(per_unit, CASE w.code WHEN 'USD' THEN 486.47 ELSE 6.26 END) AS DOUBLE) AS per_unit, CASE WHEN per_unit IS NOT NULL THEN 'nbk' ELSE 'last_good' END AS source
    FROM wanted w LEFT JOIN feed f ON f.as_of = w.as_of AND f.code = w.code"""
)
def fx_fallback(p: Proxies) -> DataFrame:
    wanted = p.table("events").select(F.to_date("ts").alias("as_of")).distinct().withColumn("code", F.explode(F.array(F.lit("USD"), F.lit("RUB"))))
    return rates.with_fallback(p.spark, _feed(p), wanted).withColumn("per_unit", F.col("per_unit").cast("double"))


@query(
    "WITH "
    + _FEED
    + """, asked AS (SELECT event_id, CAST(ts AS DATE) AS day, CASE WHEN event_id % 2 = 0 THEN 'USD' ELSE 'RUB' END AS currency FROM events)
    SELECT event_id, CAST(per_unit AS DOUBLE) AS per_unit FROM asked ASOF LEFT JOIN feed ON currency = code AND day >= as_of"""
)
def fx_asof(p: Proxies) -> DataFrame:
    asked = p.table("events").select("event_id", F.to_date("ts").alias("day"), F.when(F.col("event_id") % 2 == 0, "USD").otherwise("RUB").alias("currency"))
    return rates.as_of(asked, _feed(p), "day").select("event_id", F.col("per_unit").cast("double").alias("per_unit"))


@query(sql("SELECT item_id, CASE WHEN l_linenumber % 3 = 0 THEN b ELSE a END AS resident, CASE WHEN l_linenumber % 3 = 0 THEN c ELSE b END AS nonresident, CASE WHEN l_linenumber % 3 = 0 THEN 'СНГ' WHEN l_linenumber % 3 = 1 THEN 'tier_3' ELSE 'страховая' END AS extra_label, CASE WHEN l_linenumber % 3 = 0 THEN a ELSE c END AS extra_price FROM (SELECT item_id, l_linenumber, CAST(price_original AS DOUBLE) AS a, CAST(nonresident_original AS DOUBLE) AS b, CAST(price_original + 1 AS DOUBLE) AS c FROM base)"))
def map_tariffs(p: Proxies) -> DataFrame:
    """Labels with the resident second, none at all, and labels that name no resident."""
    n = F.col("l_linenumber") % 3
    labels = F.when(n == 0, F.array(F.lit("СНГ"), F.lit("граждан республики"), F.lit("дальнее"))).when(n == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("A"), F.lit("B"), F.lit(" страховая ")))
    prices = F.array(F.col("price_original").cast("double"), F.col("nonresident_original").cast("double"), (F.col("price_original") + 1).cast("double"))
    t = p.base.select("item_id", tariffs.map_tariffs(prices, labels).alias("t"))
    return t.select("item_id", "t.resident", "t.nonresident", F.element_at(F.map_keys("t.extra"), 1).alias("extra_label"), F.element_at(F.map_values("t.extra"), 1).alias("extra_price"))


@query(sql("SELECT item_id, concat_ws(';', CASE WHEN b <= 50000000 THEN 'СНГ=' || b END, CASE WHEN a <= 50000000 THEN 'страховая=' || a END) AS tiers FROM (SELECT item_id, CAST(CASE WHEN currency = 'KZT' THEN x ELSE round(x * per_unit, 2) END AS DECIMAL(14,2)) AS a, CAST(CASE WHEN currency = 'KZT' THEN y ELSE round(y * per_unit, 2) END AS DECIMAL(14,2)) AS b FROM (SELECT *, CAST(round(price_original * CAST(1.1 AS DECIMAL(4,2)), 2) AS DECIMAL(14,2)) AS x, nonresident_original AS y FROM base) LEFT JOIN rates ON rates.code = currency)"))
def extra_tiers_kzt(p: Proxies) -> DataFrame:
    eleven = F.round(F.col("price_original") * F.lit("1.1").cast("decimal(4,2)"), 2).cast("decimal(14,2)")
    tiers = F.create_map(F.lit("страховая"), eleven, F.lit("СНГ"), F.col("nonresident_original"))
    joined = p.base.join(F.broadcast(p.rates.withColumnRenamed("code", "currency")), "currency", "left")
    return joined.select("item_id", tariffs.tiers_text(tariffs.tiers_to_kzt(tiers, F.col("currency"), F.col("per_unit"))).alias("tiers"))


@query(sql("SELECT item_id, CASE WHEN x <= 50000000 THEN x END AS price, CASE WHEN x > 50000000 THEN 'resident price implausible (suspected OCR error); cleared for manual entry' END AS reason FROM (SELECT item_id, CAST(price_original * 1000 AS DOUBLE) AS x FROM base)"))
def sane_prices(p: Proxies) -> DataFrame:
    x = (F.col("price_original") * 1000).cast("double")
    return p.base.select("item_id", tariffs.sane(x).alias("price"), tariffs.sane_reason(x, "resident").alias("reason"))


# ---------------------------------------------------------------- quality


@query(sql("SELECT item_id, needs_review, review_reason FROM items"))
def validate_items(p: Proxies) -> DataFrame:
    return p.items.select("item_id", "needs_review", "review_reason")


_AUDIT = {
    "future_date": "effective_date > DATE '1998-06-01'",
    "empty_name": "coalesce(trim(name), '') = ''",
    "null_key": "name_norm IS NULL",
    "unknown_currency": "currency NOT IN ('KZT', 'USD', 'RUB')",
    "implausible_price": "price_resident > 50000000",
    "unpriced_not_reviewed": "(price_resident IS NULL OR price_resident <= 0) AND NOT needs_review",
    "nonresident_lower_not_reviewed": "price_nonresident < price_resident AND NOT needs_review",
    "review_without_reason": "needs_review AND coalesce(review_reason, '') = ''",
    "matched_without_method": "service_id IS NOT NULL AND match_method IS NULL",
    "low_confidence_match": "service_id IS NOT NULL AND match_method <> 'manual' AND coalesce(match_confidence, 0) < 0.85",
    "confidence_out_of_range": "match_confidence < 0 OR match_confidence > 1",
}


@query(sql(" UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) AS broken FROM items WHERE {v}" for k, v in _AUDIT.items())))
def quality_audit(p: Proxies) -> DataFrame:
    return quality.audit(p.items, AS_OF)


@query(sql("SELECT 'unknown_status' AS rule, count(*) FILTER (parse_status NOT IN ('pending', 'processing', 'done', 'error', 'needs_review')) AS broken FROM docs UNION ALL SELECT 'unknown_format', 0 UNION ALL SELECT 'never_parsed', 0 UNION ALL SELECT 'future_date', count(*) FILTER (effective_date > DATE '1998-06-01') FROM docs UNION ALL SELECT 'empty_not_error', 0"))
def quality_audit_documents(p: Proxies) -> DataFrame:
    return quality.audit_documents(p.documents, p.items, AS_OF)


@query(sql("SELECT round_even(count(service_id) / count(*) * 100, 1) AS active_match_rate, count(service_id) / count(*) >= 0.7 AS rate_ok, (SELECT count(*) > 0 FROM services) AS catalogue_ok FROM items WHERE is_active"))
def kpi_audit(p: Proxies) -> DataFrame:
    n, matched = F.count("*"), F.count("service_id")
    own = p.items.where("is_active").agg(matching.percent(matched, n).alias("active_match_rate"), (matched / n >= 0.7).alias("rate_ok"))
    return own.crossJoin(p.services.agg((F.count("*") > 0).alias("catalogue_ok")))


@query(sql("SELECT item_id FROM priced JOIN rates ON rates.code = currency WHERE currency <> 'KZT' AND abs(CAST(round(price_original * CAST(per_unit + CASE rates.code WHEN 'RUB' THEN 1 ELSE 0 END AS DECIMAL(12,6)), 2) AS DOUBLE) - price_resident) > 0.01"))
def fx_audit(p: Proxies) -> DataFrame:
    """Against a rate that moved since."""
    moved = p.rates.withColumn("per_unit", (F.col("per_unit") + F.when(F.col("code") == "RUB", 1).otherwise(0)).cast("decimal(12,6)"))
    return quality.converted_wrongly(p.priced, moved).select("item_id")


@query(sql("SELECT item_id FROM items WHERE service_id IS NOT NULL AND service_id NOT IN (SELECT service_id FROM services WHERE seq % 5 <> 0)"))
def orphans(p: Proxies) -> DataFrame:
    return quality.orphans(p.items, p.services.where("seq % 5 <> 0")).select("item_id")


@query(sql("SELECT partner_id, name_norm, count(*) AS n FROM items WHERE is_active GROUP BY partner_id, name_norm HAVING count(*) > 1"))
def dup_active_keys(p: Proxies) -> DataFrame:
    """By name here: by code there are none, as the fold leaves one."""
    return quality.duplicate_active(p.items, ["partner_id", "name_norm"])


@query(sql("SELECT DISTINCT city FROM partners EXCEPT SELECT city FROM partners WHERE partner_id % 4 = 0"))
def missing_required(p: Proxies) -> DataFrame:
    return quality.missing(p.partners, p.partners.where("partner_id % 4 = 0"), "city")


# ---------------------------------------------------------------- comparisons


@query(sql("SELECT item_id, best_price, coalesce(price_resident = best_price, FALSE) AS is_best FROM (SELECT item_id, price_resident, min(price_resident) OVER (PARTITION BY lower(name)) AS best_price FROM items WHERE is_active)"))
def best_offer(p: Proxies) -> DataFrame:
    return queries.best_offers(p.items.where("is_active")).select("item_id", "best_price", "is_best")


@query(sql("SELECT DISTINCT year(effective_date) AS year, section FROM items WHERE section IS NOT NULL"))
def distinct_years_sections(p: Proxies) -> DataFrame:
    return p.items.where("section is not null").select(F.year("effective_date").cast("long").alias("year"), "section").distinct()


@query(sql("SELECT partner_id, count(*) AS lists, CAST(sum(n) AS BIGINT) AS merged_total FROM (SELECT partner_id, name, count(*) AS n FROM items WHERE is_active GROUP BY partner_id, name) GROUP BY partner_id"))
def merged_totals(p: Proxies) -> DataFrame:
    merged = p.items.where("is_active").groupBy("partner_id", "name").agg(F.count("*").alias("merged_count"))
    return merged.groupBy("partner_id").agg(F.count("*").alias("lists"), F.sum("merged_count").alias("merged_total"))


@query(sql("SELECT partner_id, CAST(run AS BIGINT) AS run, min(section) AS section, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY partner_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN lag(section) OVER w IS DISTINCT FROM section OR lag(1) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM items WINDOW w AS (PARTITION BY partner_id ORDER BY seq))) GROUP BY partner_id, run"))
def section_runs(p: Proxies) -> DataFrame:
    numbered = queries.runs(p.items, ["partner_id"], ["seq"], "section")
    return numbered.groupBy("partner_id", "run").agg(F.min("section").alias("section"), F.count("*").alias("n"))


# ---------------------------------------------------------------- text and numbers


_NOISY = "CASE l_linenumber % 4 WHEN 0 THEN upper(name) WHEN 1 THEN replace(name, ' ', '  ') WHEN 2 THEN ' ' || name || ' ' ELSE name || ' STD' END"


def _noisy() -> Column:
    n = F.col("l_linenumber") % 4
    return F.when(n == 0, F.upper("name")).when(n == 1, F.replace("name", F.lit(" "), F.lit("  "))).when(n == 2, F.concat(F.lit(" "), "name", F.lit(" "))).otherwise(F.concat("name", F.lit(" STD")))


@query(sql(f"SELECT item_id, trim(regexp_replace(lower({_NOISY}), '\\s+', ' ', 'g')) AS key FROM base"))
def normalize_names(p: Proxies) -> DataFrame:
    return p.base.select("item_id", text.match_key(_noisy()).alias("key"))


@query(sql("SELECT item_id, CASE l_linenumber % 4 WHEN 0 THEN 'ультразвуковое исследование сердца ' WHEN 1 THEN 'магнитно-резонансная томография головы ' WHEN 2 THEN 'елка и электрокардиография, повторно ' ELSE 'фиброгастродуоденоскопия (ультразвуковое исследование) ' END || name_norm AS key FROM base"))
def folded_names(p: Proxies) -> DataFrame:
    """Latin letters inside Cyrillic words, ё, abbreviations between other signs, and Latin words that stay."""
    n = F.col("l_linenumber") % 4
    raw = F.when(n == 0, "УЗИ cepдцa").when(n == 1, "\u00a0МPТ  гoлoвы").when(n == 2, "Ёлка и экг, пoвторно").otherwise("ФГДС (узи)")
    return p.base.select("item_id", text.match_key(F.concat(raw, F.lit(" "), F.col("name"))).alias("key"))


@query("SELECT doc_id, regexp_replace(upper(translate(url_code, 'АВЕКМНОРСТУХ', 'ABEKMHOPCTYX')), '[^A-Z0-9.]', '', 'g') AS code FROM (SELECT doc_id, 'В ' || lang || '.' || doc_id || '-Н' AS url_code FROM documents)")
def codenorm(p: Proxies) -> DataFrame:
    return p.table("documents").select("doc_id", text.code_norm(F.concat(F.lit("В "), "lang", F.lit("."), F.col("doc_id").cast("string"), F.lit("-Н"))).alias("code"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Раздел ' || doc_id || '. Массаж' WHEN 1 THEN doc_id || '.7. Определение' ELSE NULL END AS section FROM documents")
def clean_section(p: Proxies) -> DataFrame:
    i, n = F.col("doc_id").cast("string"), F.col("doc_id") % 3
    raw = F.when(n == 0, F.concat(F.lit("Раздел  "), i, F.lit(".Массаж "))).when(n == 1, F.concat(i, F.lit(".7.Определение"))).otherwise("  ")
    return p.table("documents").select("doc_id", text.clean_section(raw).alias("section"))


@query(sql("SELECT item_id, floor(v) + CASE WHEN l_linenumber % 2 = 0 THEN round(v - floor(v), 2) ELSE 0 END AS value, l_linenumber % 4 <> 3 AS clean FROM (SELECT item_id, l_linenumber, CAST(price_original AS DOUBLE) AS v FROM base)"))
def parse_price(p: Proxies) -> DataFrame:
    """Grouped thousands, decimal commas, currency words, and digits that were read as letters."""
    v = F.col("price_original")
    whole, cents = F.floor(v).cast("string"), F.lpad(F.floor((v - F.floor(v)) * 100).cast("string"), 2, "0")
    grouped = F.regexp_replace(whole, r"(\d)(?=(\d{3})+$)", "$1 ")
    n = F.col("l_linenumber") % 4
    raw = F.when(n == 0, F.concat(grouped, F.lit(","), cents, F.lit(" тенге"))).when(n == 1, F.concat(grouped, F.lit(" тг."))).when(n == 2, F.concat(whole, F.lit("."), cents)).otherwise(F.translate(grouped, "03", "ОЗ"))
    found = p.base.select("item_id", numbers.parse_price(raw, aggressive=True).alias("v"), (n == 3).alias("damaged"))
    return found.select("item_id", F.round("v.value", 2).alias("value"), (F.col("v.clean") & ~F.col("damaged")).alias("clean"))


@query("SELECT doc_id, CAST(CASE doc_id % 4 WHEN 0 THEN 10.0 * doc_id + 10 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 1000.0 * (doc_id + 1) END AS DOUBLE) AS value FROM documents")
def price_cell(p: Proxies) -> DataFrame:
    i, n = F.col("doc_id"), F.col("doc_id") % 4
    raw = F.when(n == 0, F.concat((i + 1).cast("string"), F.lit("О тг"))).when(n == 1, F.concat(i.cast("string"), F.lit(" посещение"))).when(n == 2, "до 0,5 см").otherwise(F.concat((i + 1).cast("string"), F.lit(" ООС")))
    return p.table("documents").select("doc_id", numbers.price_cell_value(raw).alias("value"))


@query("SELECT doc_id, CASE WHEN lower(text) LIKE '%$%' OR lower(text) LIKE '%usd%' OR lower(text) LIKE '%долл%' THEN 'USD' WHEN lower(text) LIKE '%rub%' OR lower(text) LIKE '%руб%' OR lower(text) LIKE '%₽%' THEN 'RUB' ELSE 'KZT' END AS currency FROM documents")
def detect_currency(p: Proxies) -> DataFrame:
    return p.table("documents").select("doc_id", numbers.detect_currency(F.col("text")).alias("currency"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN make_date(2000 + doc_id % 100, 1 + doc_id % 12, 1 + doc_id % 28) END AS day FROM documents")
def strict_dates(p: Proxies) -> DataFrame:
    i = F.col("doc_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    raw = F.when(i % 2 == 0, F.concat_ws(".", two(1 + i % 28), two(1 + i % 12), (2000 + i % 100).cast("string"))).when(i % 3 == 0, "31.02.2024").otherwise(F.concat(i.cast("string"), F.lit(".1.2020")))
    return p.table("documents").select("doc_id", dates.feed_date(raw).alias("day"))


@query("SELECT doc_id, replace(printf('%,d', n_chars), ',', ' ') || ' ₸' AS money, CASE WHEN doc_id % 2 = 0 THEN printf('%.1f%%', doc_id / 4) ELSE '—' END AS share FROM (SELECT doc_id, n_chars FROM documents)".replace("printf('%,d', n_chars)", "format('{:,}', n_chars)").replace("printf('%.1f%%', doc_id / 4)", "format('{:,.1f}%', CAST(floor(doc_id / 2.0) AS DOUBLE))"))
def display_texts(p: Proxies) -> DataFrame:
    return p.table("documents").select("doc_id", text.money_text(F.col("n_chars")).alias("money"), text.percent_text(F.when(F.col("doc_id") % 2 == 0, F.floor(F.col("doc_id") / 2).cast("double"))).alias("share"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'xlsx' WHEN 1 THEN 'docx' WHEN 2 THEN 'pdf' END AS file_format FROM pages")
def detect_format(p: Proxies) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, (".XLSX", ".docx", ".Pdf", ".txt"))), (F.col("page_id") % 4 + 1).cast("int"))
    return p.table("pages").select("page_id", formats.file_format(F.concat(F.lit("/in/dir.d/list"), F.col("page_id").cast("string"), kind)).alias("file_format"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Клиника ' || page_id ELSE 'Центр ' || translate(CAST(page_id AS VARCHAR), '0123456789', 'ABCDEFGHIJ') END AS partner FROM pages")
def partner_from_filename(p: Proxies) -> DataFrame:
    i = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/a/КЛИНИКА  "), i, F.lit(" прайс 2025 год.PDF"))).otherwise(F.concat(F.lit("/a/Прайс_Центр-"), F.translate(i, "0123456789", "ABCDEFGHIJ"), F.lit("_2024 года.xlsx")))
    return p.table("pages").select("page_id", formats.partner_name(path).alias("partner"))


@query("SELECT page_id, CASE WHEN 1990 + page_id % 40 >= 2000 THEN make_date(1990 + CAST(page_id % 40 AS INTEGER), 1, 1) END AS effective_date FROM pages")
def effective_date_from_filename(p: Proxies) -> DataFrame:
    return p.table("pages").select("page_id", formats.effective_date(F.concat(F.lit("/x/2024/price_"), (1990 + F.col("page_id") % 40).cast("string"), F.lit("_1985.xls"))).alias("effective_date"))


# ---------------------------------------------------------------- catalogue and matching


@query(
    sql(
        "SELECT item_id, coalesce(e.service_id, y.service_id) AS service_id, CASE WHEN e.service_id IS NOT NULL THEN 'exact' WHEN y.service_id IS NOT NULL THEN 'synonym' END AS match_method FROM keyed LEFT JOIN services e ON lower(e.service_name) = key LEFT JOIN services y ON lower(y.service_name) || ' std' = key",
        f"keyed AS (SELECT item_id, trim(regexp_replace(lower({_NOISY}), '\\s+', ' ', 'g')) AS key FROM base)",
    )
)
def match_exact_synonym(p: Proxies) -> DataFrame:
    keyed = p.base.select("item_id", text.match_key(_noisy()).alias("name_norm"))
    return matching.match_exact(keyed, p.services).select("item_id", "service_id", "match_method")


@query()
def match_fuzzy(p: Proxies) -> DataFrame:
    """Distinct names of the parts against the catalogue: exact, synonym, then the best token-set score."""
    keyed = p.table("part").select(text.match_key(F.concat(F.lit("new "), "p_name")).alias("name_norm")).distinct()
    return matching.match_all(keyed, p.services).select("name_norm", "service_id", "suggestion_id", "match_method", F.round("match_confidence", 4).alias("match_confidence"))


@query(sql("SELECT count(*) FILTER (is_active AND old IS NULL) AS considered, count(*) FILTER (is_active AND old IS NULL AND service_id IS NOT NULL) AS newly_matched, count(*) FILTER (is_active) AS items, count(*) FILTER (is_active AND service_id IS NOT NULL) AS matched, round_even(count(*) FILTER (is_active AND service_id IS NOT NULL) / count(*) FILTER (is_active) * 100, 1) AS rate FROM (SELECT *, CASE WHEN l_linenumber < 4 THEN service_id END AS old FROM items)"))
def rematch_stats(p: Proxies) -> DataFrame:
    before = p.items.withColumn("service_id", F.when(F.col("l_linenumber") < 4, F.col("service_id")))
    return matching.rematch_stats(before, p.items)


@query(
    sql(
        "SELECT t.name_norm, service_name, category, n FROM totals t JOIN named USING (name_norm) JOIN common USING (name_norm) WHERE n >= 2 ORDER BY n DESC, first LIMIT 4000",
        "active AS (SELECT * FROM items WHERE is_active)",
        "totals AS (SELECT name_norm, count(*) AS n, min(seq) AS first FROM active GROUP BY name_norm)",
        "named AS (SELECT name_norm, name AS service_name FROM (SELECT name_norm, name, row_number() OVER (PARTITION BY name_norm ORDER BY count(*) DESC, min(seq)) AS nth FROM active GROUP BY name_norm, name) WHERE nth = 1)",
        "common AS (SELECT name_norm, section AS category FROM (SELECT name_norm, section, row_number() OVER (PARTITION BY name_norm ORDER BY count(*) DESC, min(seq)) AS nth FROM active GROUP BY name_norm, section) WHERE nth = 1)",
    )
)
def bootstrap_catalogue(p: Proxies) -> DataFrame:
    return matching.bootstrap(p.items).select("name_norm", "service_name", "category", "n")


@query(sql("SELECT lower(p_name) AS key, coalesce(s.service_name, p_name) AS service_name, coalesce(s.category, min(p_brand)) AS category, CASE WHEN s.service_name IS NULL THEN 'alt' ELSE concat_ws('|', s.service_name || ' std', 'alt') END AS synonyms, s.service_name IS NULL AS is_new FROM part LEFT JOIN services s ON s.service_name = p_name GROUP BY p_name, s.service_name, s.category"))
def upsert_services(p: Proxies) -> DataFrame:
    brand = p.table("part").groupBy("p_name").agg(F.min("p_brand").alias("category"), F.min("p_partkey").alias("seq"))
    incoming = brand.select("seq", F.col("p_name").alias("service_name"), F.array(F.lit("alt")).alias("synonyms"), "category", F.lit(None).cast("string").alias("icd_code"), F.lit(None).cast("string").alias("service_id"))
    existing = p.services.drop("seq", "is_active").withColumn("icd_code", F.lit(None).cast("string"))
    return matching.upsert(existing, incoming).select("key", "service_name", "category", F.array_join("synonyms", "|").alias("synonyms"), "is_new")


# ---------------------------------------------------------------- edits


@query(
    sql(
        """SELECT item_id, CASE WHEN o_orderkey IS NOT NULL THEN CASE WHEN o_orderkey % 3 <> 0 THEN 'M' || o_orderkey END ELSE service_id END AS service_id,
        CASE WHEN o_orderkey IS NOT NULL THEN CASE WHEN o_orderkey % 3 <> 0 THEN 'manual' END ELSE match_method END AS match_method FROM items LEFT JOIN last USING (item_id)""",
        "numbered AS (SELECT item_id, CAST(substr(item_id, 1, 12) AS BIGINT) AS k FROM items WHERE l_linenumber = 1)",
        "last AS (SELECT item_id, max(o_orderkey) AS o_orderkey FROM numbered JOIN orders ON o_orderkey // 4 = k GROUP BY item_id)",
    )
)
def manual_overlay(p: Proxies) -> DataFrame:
    """Orders are events: of all that name an item, the last one's link (or its removal) holds."""
    numbered = p.items.where("l_linenumber = 1").select("item_id", F.substring("item_id", 1, 12).cast("long").alias("k"))
    events = numbered.join(p.table("orders").withColumn("k", F.floor(F.col("o_orderkey") / 4)), "k").select("item_id", F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("M"), "o_orderkey")).alias("service_id"), F.lit("").alias("note"))
    return overlay.with_matches(p.items.withColumn("verification_note", F.lit(None).cast("string")), events).select("item_id", "service_id", "match_method")


@query(sql("SELECT item_id, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE section END AS section, CASE WHEN l_linenumber % 2 = 0 THEN 'renamed ' || l_linenumber ELSE name END AS name, name_norm FROM items"))
def field_edits(p: Proxies) -> DataFrame:
    """Fields that an edit names are written, null included; the key stays as it was."""
    own = p.items.select("item_id", "l_linenumber")
    edit = lambda seq, field, value, when: own.where(when).select("item_id", F.lit(seq).alias("seq"), F.lit(field).alias("field"), value.cast("string").alias("value"))
    events = edit(1, "name", F.lit("first"), "l_linenumber % 2 = 0").unionByName(edit(2, "name", F.concat(F.lit("renamed "), F.col("l_linenumber")), "l_linenumber % 2 = 0")).unionByName(edit(3, "section", F.lit(None), "l_linenumber % 3 = 0"))
    return overlay.with_edits(p.items, events, ["name", "section"]).select("item_id", "section", "name", "name_norm")


@query(sql("SELECT item_id, is_verified OR l_linenumber = 2 AS is_verified, needs_review AND l_linenumber <> 2 AS needs_review, CASE WHEN l_linenumber = 2 THEN 1.5 ELSE price_resident END AS price_resident, review_reason FROM items"))
def verified_overlay(p: Proxies) -> DataFrame:
    none = F.lit(None).cast("double")
    events = p.items.where("l_linenumber = 2").select("item_id", F.lit(1).alias("seq"), F.lit(True).alias("verified"), F.lit(1.5).alias("price_resident"), none.alias("price_nonresident"))
    return overlay.with_verifications(p.items, events).select("item_id", "is_verified", "needs_review", "price_resident", "review_reason")


@query(sql("SELECT doc_id, count(*) AS n FROM items WHERE doc_id NOT IN (SELECT doc_id FROM docs WHERE partner_id % 10 = 3) GROUP BY doc_id"))
def delete_document(p: Proxies) -> DataFrame:
    gone = p.documents.where("partner_id % 10 = 3").select("doc_id")
    return overlay.without_deleted(p.items, gone, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS sha FROM documents WHERE source <> 'src1' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src1') GROUP BY sha256(text)")
def dedup_documents(p: Proxies) -> DataFrame:
    docs = p.table("documents").select("doc_id", "source", F.sha2("text", 256).alias("sha"))
    return overlay.new_documents(docs.where("source <> 'src1'"), docs.where("source = 'src1'"), "sha", "doc_id").select("doc_id", "sha")


@query(sql("SELECT DISTINCT name FROM partners WHERE partner_id % 2 = 0"))
def new_partners(p: Proxies) -> DataFrame:
    return overlay.new_partners(p.partners.select("name").union(p.partners.select("name")), p.partners.where("partner_id % 2 = 1")).select("name")


@query(sql("SELECT item_id, nullif(concat_ws('; ', review_reason, CASE WHEN l_linenumber = 1 THEN 'LLM: new' END), '') AS review_reason, CASE WHEN is_verified THEN needs_review ELSE review_reason IS NOT NULL OR l_linenumber = 1 END AS needs_review FROM items"))
def recleaned_items(p: Proxies) -> DataFrame:
    old = p.items.withColumn("review_reason", F.concat_ws("; ", "review_reason", F.lit("LLM: old")))
    flags = p.items.where("l_linenumber = 1").select("item_id", F.array(F.lit("new")).alias("flags"))
    return overlay.recleaned(old, flags).select("item_id", "review_reason", "needs_review")


# ---------------------------------------------------------------- golden lists


_GOLDEN = "golden AS (SELECT item_id AS golden_id, partner_id || '|' || lower(name) AS key, code, price_resident + CASE WHEN l_linenumber % 5 = 0 THEN 10 ELSE 0 END AS resident, CASE WHEN l_linenumber % 7 = 3 THEN 'RUB' ELSE currency END AS currency FROM items WHERE is_active AND price_resident IS NOT NULL)"
_VERDICTS = """verdicts AS (SELECT golden_id, CASE WHEN pid IS NULL THEN 'missing' WHEN currency <> pcur THEN 'wrong_currency' WHEN abs(resident - pres) > 0.5 THEN 'wrong_resident' ELSE 'ok' END AS verdict, coalesce(flagged, FALSE) AS flagged
    FROM golden LEFT JOIN (SELECT * FROM (SELECT golden_id, i.item_id AS pid, i.currency AS pcur, i.price_resident AS pres, i.needs_review AS flagged, row_number() OVER (PARTITION BY golden_id ORDER BY (i.code <> g.code)::INT, abs(g.resident - i.price_resident), i.item_id) AS nth
        FROM golden g JOIN items i ON i.partner_id || '|' || lower(i.name) = g.key WHERE i.is_active AND i.price_resident IS NOT NULL AND i.l_linenumber <> 6) WHERE nth = 1) USING (golden_id))"""


def _verdicts(p: Proxies) -> DataFrame:
    """By rows as numbers; of partners with lines that these can't say, by rows as they are."""
    bounds, odd = golden_rows.bounds(p)
    parts = (p, None) if not odd else bounds and golden_rows.parted(p)
    if bounds and parts:
        with suppress(OverflowError):
            out = golden_rows.verdicts(parts[0], bounds)
            return out.unionByName(_verdicts_of_any(parts[1])) if parts[1] else out
    return _verdicts_of_any(p)


def _verdicts_of_any(p: Proxies) -> DataFrame:
    """Rows are dealt out once, as both golden and parsed, with what their ids and prices are made of."""
    own = p.items.where("is_active and price_resident is not null").select(F.lower("name").alias("name_key"), "partner_id", "l_orderkey", "l_partkey", "effective_date", "price_original", "l_linenumber", "needs_review", "currency")
    own = own.repartition("partner_id", "name_key").withColumns({"code": F.col("l_partkey").cast("string"), "resident": F.col("price_original")})
    own = rates.convert(own, p.rates, ["resident"]).withColumns({"id": item_id(), "resident": F.col("resident").cast("double")})
    both = own.withColumn("asked", F.explode(F.array(F.lit(True), F.when(F.col("l_linenumber") != 6, False)))).where("asked is not null")
    off = F.when(F.col("l_linenumber") % 5 == 0, 10).otherwise(0)
    none = F.lit(None).cast("double").alias("nonresident")
    wanted = F.struct((F.col("resident") + off).alias("resident"), none, F.when(F.col("l_linenumber") % 7 == 3, "RUB").otherwise(F.col("currency")).alias("currency"))
    parsed = F.struct(F.col("id").alias("row_id"), "resident", none, "currency", F.lit(None).cast("map<string,double>").alias("tiers"), "needs_review")
    rows = both.select("partner_id", "name_key", "code", F.when(F.col("asked"), F.col("id")).alias("golden_id"), F.when(F.col("asked"), wanted).alias("golden"), F.when(~F.col("asked"), parsed).alias("parsed"))
    return golden.judged(rows, ["partner_id", "name_key"], "code").select("golden_id", "verdict", "flagged")


@query(sql("SELECT golden_id, verdict, flagged FROM verdicts", _GOLDEN, _VERDICTS))
def golden_compare(p: Proxies) -> DataFrame:
    return _verdicts(p)


@query(sql("SELECT total, correct, flagged_wrong, silent, round(correct / total, 6) AS accuracy, round((correct + flagged_wrong) / total, 6) AS effective, (correct + flagged_wrong) / total >= 0.95 AND silent = 0 AS passed FROM (SELECT count(*) AS total, count(*) FILTER (verdict = 'ok') AS correct, count(*) FILTER (verdict NOT IN ('ok', 'missing') AND flagged) AS flagged_wrong, count(*) FILTER (verdict NOT IN ('ok', 'missing') AND NOT flagged) AS silent FROM verdicts)", _GOLDEN, _VERDICTS))
def accuracy_summary(p: Proxies) -> DataFrame:
    return golden.accuracy(_verdicts(p)).withColumn("accuracy", F.round("accuracy", 6)).withColumn("effective", F.round("effective", 6))


# ---------------------------------------------------------------- grids and pages


def _sheets(p: Proxies) -> DataFrame:
    """A sheet per order: a title, a header, a numbering line, sections, rows and a row without a name."""
    line = p.base
    sheet = [F.concat(F.lit("d"), F.col("partner_id")).alias("doc_id"), F.lit("s").alias("sheet")]
    row = F.row_number().over(Window.partitionBy("partner_id").orderBy("seq"))
    body = line.withColumn("k", row).select(*sheet, (10 + F.col("k")).cast("int").alias("row_idx"), F.when(F.col("k") % 10 == 1, F.array(F.col("section"), F.lit(""), F.lit(""))).otherwise(F.array(F.when(F.col("k") % 10 == 2, "").otherwise(F.col("name")), F.col("code"), F.col("price_original").cast("string"))).alias("cells"))
    head = line.select("partner_id").distinct().select(*sheet, F.explode(F.array(F.struct(F.lit(1).alias("row_idx"), F.array(F.lit("Прейскурант"), F.lit(""), F.lit("")).alias("cells")), F.struct(F.lit(2).alias("row_idx"), F.array(F.lit("Н аим ен ование услуги"), F.lit("Код услуги"), F.lit("Цена, тенге")).alias("cells")), F.struct(F.lit(3).alias("row_idx"), F.array(F.lit("1"), F.lit("2"), F.lit("3")).alias("cells")))).alias("x")).select("doc_id", "sheet", "x.*")
    return head.unionByName(body)


_SHEETS = "sheets AS (SELECT 'd' || partner_id AS doc_id, partner_id, seq, name, code, section, price_original, row_number() OVER (PARTITION BY partner_id ORDER BY seq) AS k FROM converted)"


@query(sql("SELECT doc_id, CAST(10 + k AS INTEGER) AS row_idx, CASE WHEN k % 10 = 2 THEN '(?)' ELSE name END AS name, code, title AS section, CAST(price_original AS DOUBLE) AS price FROM (SELECT *, last_value(CASE WHEN k % 10 = 1 THEN section END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS title FROM sheets) WHERE k % 10 <> 1", _SHEETS))
def grid_rows(p: Proxies) -> DataFrame:
    rows = grid.interpret(_sheets(p))
    return rows.select("doc_id", "row_idx", "name", "code", "section", F.get("prices", F.lit(0)).alias("price"))


@query(sql("SELECT doc_id, CAST(2 AS INTEGER) AS header_nth, 0 AS name_col, 1 AS code_col, '2' AS price_cols FROM (SELECT DISTINCT doc_id FROM sheets)", _SHEETS))
def grid_columns(p: Proxies) -> DataFrame:
    rows = grid.cleaned(_sheets(p))
    heads = grid.headers(rows)
    found = grid.roles(grid.column_statistics(rows, heads)).join(heads, grid.SHEET)
    return found.select("doc_id", "header_nth", "name_col", "code_col", F.array_join(F.col("price_cols").cast("array<string>"), ",").alias("price_cols"))


def _words(p: Proxies) -> DataFrame:
    """Words on pages of three columns: one page per partner, a line per item."""
    w = Window.partitionBy("partner_id").orderBy("seq")
    line = p.base.withColumn("k", F.row_number().over(w))
    boxes = F.array(F.struct(F.lit(10.0).alias("x0"), (10.0 + F.length("name") * 4).alias("x1"), F.col("name").alias("text")), F.struct(F.lit(400.0).alias("x0"), (400.0 + F.length("code") * 4).alias("x1"), F.col("code").alias("text")), F.struct(F.lit(500.0).alias("x0"), F.lit(560.0).alias("x1"), F.col("price_original").cast("string").alias("text")))
    return line.select(F.concat(F.lit("d"), F.col("partner_id")).alias("doc_id"), F.lit(1).alias("page"), F.lit(600.0).alias("page_width"), (F.col("k") * 12.0).alias("top"), F.explode(boxes).alias("b")).select("doc_id", "page", "page_width", "top", "b.*")


_BOXES = "boxes AS (SELECT 'd' || partner_id AS doc_id, length(name) AS n, length(code) AS c, name, code, price_original, row_number() OVER (PARTITION BY partner_id ORDER BY item_id) AS k FROM base)"


@query(sql("SELECT doc_id, round((10 + 4 * max(n) + 1 + 400) / 2.0, 1) AS first_gap, round((400 + 4 * max(c) + 1 + 500) / 2.0, 1) AS second_gap FROM boxes GROUP BY doc_id", _BOXES))
def layout_bounds(p: Proxies) -> DataFrame:
    return layout.column_bounds(_words(p)).select("doc_id", F.get("bounds", F.lit(1)).alias("first_gap"), F.get("bounds", F.lit(2)).alias("second_gap"))


@query(sql("SELECT doc_id, CAST(k - 1 AS INTEGER) AS row_idx, name || '|' || code || '|' || price_original AS cells FROM boxes", _BOXES))
def layout_grid(p: Proxies) -> DataFrame:
    return layout.grid(_words(p)).select("doc_id", "row_idx", F.array_join("cells", "|").alias("cells"))


@query(sql("SELECT doc_id, k, CASE WHEN 400 - 10 - 4 * n > greatest(7, 1.6 * upper_gap) THEN 1 ELSE 0 END AS second_cell FROM (SELECT *, greatest(400 - 10 - 4 * n, 500 - 400 - 4 * c) AS upper_gap FROM boxes)", _BOXES))
def layout_cells(p: Proxies) -> DataFrame:
    rows = _words(p).withColumn("k", F.round(F.col("top") / 12).cast("long"))
    return layout.segments(rows, ["doc_id", "k"]).groupBy("doc_id", "k").agg(F.max(F.when(F.col("x0") == 400, F.col("cell"))).cast("int").alias("second_cell"))


@query(
    sql(
        "SELECT doc_id, k, string_agg(name, ' ' ORDER BY j) AS name FROM (SELECT a.doc_id, a.k, b.k AS j, b.name FROM marked a JOIN marked b ON b.doc_id = a.doc_id AND b.g = a.g AND b.k <= a.k WHERE a.priced) GROUP BY doc_id, k",
        _BOXES,
        "marked AS (SELECT *, k % 3 = 0 AS priced, coalesce(sum(CASE WHEN k % 3 = 0 OR k % 7 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM boxes)",
    )
)
def layout_name_buffer(p: Proxies) -> DataFrame:
    w = Window.partitionBy("partner_id").orderBy("seq")
    lines = p.base.withColumn("k", F.row_number().over(w).cast("long")).select(F.concat(F.lit("d"), F.col("partner_id")).alias("doc_id"), "k", F.col("name").alias("text"), (F.col("k") % 3 == 0).alias("priced"), (F.col("k") % 7 == 1).alias("section"))
    return layout.with_wrapped_names(lines, ["doc_id"], "k").select("doc_id", "k", "name")


@query(sql("SELECT item_id, '1 посещение' AS unit, CAST(price_original AS DOUBLE) AS price, 'В02.110.002' AS code, name FROM base"))
def layout_rows(p: Proxies) -> DataFrame:
    """Codes, units and tiers of assembled lines."""
    texts = F.array(F.concat(F.lit("12 "), F.col("name"), F.lit(" В02.110.002")), F.lit("1 посещение"), F.col("price_original").cast("string"))
    split = p.base.select("item_id", layout.split_row(texts).alias("s"))
    coded = split.select("item_id", "s.unit", "s.prices", layout.code_and_name(F.col("s.name")).alias("c"))
    return coded.select("item_id", "unit", F.get("prices", F.lit(0)).alias("price"), "c.code", "c.name")


def _pages(p: Proxies) -> DataFrame:
    """A document per partner, 40 lines a page: every 20th line is a section, every 10th wraps into the next one, and the
    first page has a header over its two price columns, the resident's second."""
    rows = p.base.select("partner_id", "l_orderkey", "l_partkey", "effective_date", "price_original", "nonresident_original", "l_linenumber", "name")
    rows = rows.repartition("partner_id").withColumn("code", F.col("l_partkey").cast("string")).withColumn("seq", item_id()).withColumn("k", F.row_number().over(Window.partitionBy("partner_id").orderBy("seq")))
    box = lambda x, width, top, text: F.struct(F.lit(float(x)).alias("x0"), F.lit(float(x + width)).alias("x1"), top.alias("top"), text.alias("text"))

    def boxes(line):
        k, top = line["k"], (line["k"] - 1) % 40 * 20.0 + 60
        before = [box(10 + 30 * i, 28, top, F.lit(w)) for i, w in enumerate(("услуга", "врача", "по", "записи", "номер"))]
        named = [*before, box(160, 28, top, line["name"])]
        priced = [box(400, 40, top, line["nonresident_original"].cast("string")), box(500, 40, top, line["price_original"].cast("string"))]
        title = F.array(box(10, 28, top, F.lit("РАЗДЕЛ")), box(40, 28, top, F.floor(k / 20).cast("string")))
        return F.when(k % 20 == 0, title).when(k % 10 == 5, F.array(*named)).otherwise(F.array(*named, *priced))

    head = F.array(box(400, 40, F.lit(20.0), F.lit("Нерезиденты")), box(500, 40, F.lit(20.0), F.lit("Резиденты")))
    page = (F.floor((F.col("k") - 1) / 40) + 1).cast("int").alias("page")
    found = rows.groupBy("partner_id", page).agg(F.collect_list(F.struct("k", "name", "price_original", "nonresident_original")).alias("lines"))
    words = F.flatten(F.transform("lines", boxes))
    return found.select(F.concat(F.lit("d"), F.col("partner_id")).alias("doc_id"), "page", F.lit(600.0).alias("page_width"), F.when(F.col("page") == 1, F.concat(head, words)).otherwise(words).alias("words"))


def _page_words(p: Proxies) -> DataFrame:
    return _pages(p).select("doc_id", "page", "page_width", F.inline("words"))


_LINES = "lines AS (SELECT *, row_number() OVER (PARTITION BY partner_id ORDER BY item_id) AS k FROM base), read AS (SELECT *, 'd' || partner_id AS doc, CAST((k - 1) // 40 + 1 AS INTEGER) AS page, 'услуга врача по записи номер ' || name AS own, lag('услуга врача по записи номер ' || name || ' ') OVER (PARTITION BY partner_id ORDER BY k) AS upper FROM lines)"
_NAMED = "CASE WHEN k % 10 = 6 THEN upper ELSE '' END || own"


@query(sql(f"SELECT doc AS doc_id, page, {_NAMED} AS name, CASE WHEN k > 20 THEN 'РАЗДЕЛ ' || k // 20 END AS section, CAST(price_original AS DOUBLE) AS resident, CAST(nonresident_original AS DOUBLE) AS nonresident, TRUE AS tariffs_resolved FROM read WHERE k % 20 <> 0 AND k % 10 <> 5", _LINES))
def text_page_rows(p: Proxies) -> DataFrame:
    """Price rows of pages with a text layer: columns, wrapped names, sections, tiers learnt from the first page."""
    return pages.text_rows_of(_pages(p)).select("doc_id", "page", "name", "section", "resident", "nonresident", "tariffs_resolved")


@query(sql(f"SELECT doc AS doc_id, page, {_NAMED} AS name, CASE WHEN k // 20 * 20 > (page - 1) * 40 THEN 'РАЗДЕЛ ' || k // 20 END AS section, CAST(nonresident_original AS DOUBLE) AS first_price, CAST(price_original AS DOUBLE) AS second_price FROM read WHERE k % 20 <> 0 AND k % 10 <> 5", _LINES))
def scan_page_rows(p: Proxies) -> DataFrame:
    """Price rows of recognised pages, line by line."""
    words = _page_words(p).where("top >= 60")
    return pages.scan_rows(words).select("doc_id", "page", "name", "section", F.get("prices", F.lit(0)).alias("first_price"), F.get("prices", F.lit(1)).alias("second_price"))


_PAIRED = "lines AS (SELECT *, row_number() OVER (PARTITION BY partner_id ORDER BY item_id) AS k FROM base)"


@query(sql("SELECT 'd' || partner_id AS doc_id, item_id AS golden_id, CASE WHEN k % 15 <> 0 THEN item_id END AS row_id, CASE WHEN k % 15 = 0 THEN NULL WHEN k % 3 = 0 THEN 'price' ELSE 'name' END AS how, CASE WHEN k % 15 = 0 THEN 'missing' WHEN k % 3 = 0 THEN 'garbled' WHEN k % 3 = 1 THEN 'wrong' ELSE 'ok' END AS status FROM lines", _PAIRED))
def golden_aligned(p: Proxies) -> DataFrame:
    """Golden rows against parsed ones, one to one: two of three by name, one in three of those at another price, the
    rest by price, as far as they have any."""
    k = F.row_number().over(Window.partitionBy("partner_id").orderBy("seq"))
    rows = p.base.select(F.concat(F.lit("d"), F.col("partner_id")).alias("doc_id"), "item_id", k.alias("k"))
    price = (F.col("k") * 10).cast("double")
    asked = rows.select("doc_id", F.col("item_id").alias("golden_id"), F.concat(F.when(F.col("k") % 3 == 0, "lost").otherwise("k"), F.col("k").cast("string")).alias("key"), F.when(F.col("k") % 15 != 0, price).alias("resident"), F.lit(None).cast("double").alias("nonresident"))
    parsed = rows.select("doc_id", F.col("item_id").alias("row_id"), F.concat(F.lit("k"), F.col("k").cast("string")).alias("key"), F.array(price + F.when(F.col("k") % 3 == 1, 1_000_003.0).otherwise(0.0)).alias("prices"))
    return pages.aligned(asked, parsed)


# ---------------------------------------------------------------- sources


@query("SELECT page_id AS feed_id, code, CASE WHEN page_id % 2 = 0 THEN DATE '2024-02-01' ELSE DATE '2023-03-05' END AS as_of, CAST(400 + page_id % 7 AS DOUBLE) AS raw, CAST(10 AS INTEGER) AS quant, round((400 + page_id % 7) / 10.0, 6)::DOUBLE AS per_unit FROM pages, (VALUES ('USD'), ('RUB')) AS c(code) WHERE code = 'USD' OR page_id % 2 = 0")
def fx_xml(p: Proxies) -> DataFrame:
    item = lambda code, day: F.concat(F.lit(f"<item><title>{code}</title>{day}<description>"), F.format_string("%.2f", (F.lit(400.0) + F.col("page_id") % 7).cast("double")), F.lit("</description><quant>10</quant></item>"))
    rss = F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel>'), item("USD", "<pubDate>01.02.2024</pubDate>"), item("RUB", "<pubDate>01.02.2024</pubDate>"), F.lit("</channel></rss>"))
    flat = F.concat(F.lit("<rates><date>05.03.2023</date>"), item("USD", ""), F.lit("</rates>"))
    feeds = p.table("pages").select(F.col("page_id").alias("feed_id"), F.when(F.col("page_id") % 2 == 0, rss).otherwise(flat).alias("xml"))
    return rate_feed.rates(feeds)


@query("SELECT page_id, 0 AS place, 'Услуга ' || page_id AS service_name, 'a|b' AS synonyms, CASE WHEN page_id % 2 = 0 THEN 'K' END AS category FROM pages")
def catalogue_json(p: Proxies) -> DataFrame:
    i = F.col("page_id")
    one = F.concat(F.lit('{"услуга": "Услуга '), i.cast("string"), F.lit('", "synonyms": "a; b", "категория": "'), F.when(i % 2 == 0, "K").otherwise(""), F.lit('"}'))
    texts = p.table("pages").select(i.alias("path"), F.when(i % 3 == 0, F.concat(F.lit("["), one, F.lit("]"))).otherwise(F.concat(F.lit('{"services": ['), one, F.lit("]}"))).alias("value"))
    found = catalogue_files.from_json(texts)
    return found.select(F.col("seq.path").alias("page_id"), F.col("seq.place").alias("place"), "service_name", F.array_join("synonyms", "|").alias("synonyms"), "category")


@query("SELECT page_id, 'Анализ ' || page_id AS name, CAST(1200 AS DOUBLE) AS resident, CAST(CASE WHEN page_id % 2 = 0 THEN 900 ELSE 700 END AS DOUBLE) AS nonresident, CASE WHEN page_id % 2 = 0 THEN 'нерезидент' ELSE 'страховая' END AS tier FROM pages")
def model_answers(p: Proxies) -> DataFrame:
    i = F.col("page_id")
    answer = F.concat(
        F.lit("<think>{not this}</think> Вот: {\"rows\": [{\"name\": \" Анализ "), i.cast("string"), F.lit("\", \"price_resident_kzt\": \"1 2ОО\", "),
        F.when(i % 2 == 0, '"price_nonresident_kzt": 900, ').otherwise(""), F.lit('"extra_tiers": [{"label": "'), F.when(i % 2 == 0, "дальнее зарубежье").otherwise("страховых компаний"), F.lit('", "price_kzt": 800}'),
        F.when(i % 2 == 0, "").otherwise(', {"label": "нерезиденты", "price_kzt": 700}'), F.lit('] }, {"name": ""}]} конец'),
    )
    rows = model_rows.rows(p.table("pages").select(i.alias("doc_id"), answer.alias("answer")))
    return rows.select(F.col("doc_id").alias("page_id"), "name", "resident", "nonresident", F.element_at(F.map_keys("extra_tiers"), 1).alias("tier"))


# ---------------------------------------------------------------- streaming


@query("SELECT user_id, day, event_type, value, event_id FROM (SELECT user_id, CAST(ts AS DATE) AS day, event_type, value, event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE), event_type ORDER BY event_id) AS nth FROM events) WHERE nth = 1")
def stream_ingest(p: Proxies) -> DataFrame:
    """The events as a stream into a store that holds the first row of each key, run to its end twice."""
    import uuid

    from ..streaming.ingest import append_new, once

    context = p.spark.sparkContext
    given = context.getConf().get("spark.checkpoint.dir") or ("/tmp/checkpoints" if context.master.startswith("local[") else None)
    if not given:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = f"{given.rstrip('/')}/pricelake/stream-{uuid.uuid4().hex}"
    path = f"{p.sf_dir.rstrip('/')}/events.parquet"
    schema = p.table("events").schema
    for _ in range(2):
        one_file = p.spark.read.format("binaryFile").load(path).select("path").first()["path"].endswith("/events.parquet")
        reader = p.spark.readStream.schema(schema)
        stream = reader.option("pathGlobFilter", "events.parquet").parquet(p.sf_dir) if one_file else reader.parquet(path)
        keyed = stream.select(F.concat_ws("/", "user_id", F.to_date("ts"), "event_type").alias("key"), "user_id", F.to_date("ts").alias("day"), "event_type", "value", "event_id")
        once(keyed, f"{root}/checkpoint", append_new(f"{root}/store", "key", "event_id")).awaitTermination()
    return p.spark.read.parquet(f"{root}/store").select("user_id", "day", "event_type", "value", "event_id")


# ---------------------------------------------------------------- rules, sinks and parts of pages, each over all rows


def _nth(c: Column, *values: Column | str | None) -> Column:
    """The value at the place that ``c`` gives, over and over."""
    return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (c % len(values) + 1).cast("int"))


_NAMELESS = "CASE l_linenumber % 6 WHEN 0 THEN ' (?) ' WHEN 1 THEN '—' WHEN 2 THEN '' WHEN 3 THEN name WHEN 4 THEN NULL ELSE '- ' || name END"


@query(sql(f"SELECT item_id, raw FROM (SELECT item_id, {_NAMELESS} AS raw FROM base) WHERE trim(coalesce(raw, '')) NOT IN ('', '(?)', '-', '—')"))
def named_rows(p: Proxies) -> DataFrame:
    """Rows whose name stands for one."""
    raw = _nth(F.col("l_linenumber"), " (?) ", "—", "", F.col("name"), None, F.concat(F.lit("- "), "name"))
    rows = p.base.select("item_id", raw.alias("raw"))
    return rows.where(~quality.droppable_name(F.col("raw")))


_HEADED = "CASE l_linenumber % 5 WHEN 0 THEN 'НАИМЕНОВАНИЕ ' || name WHEN 1 THEN name || ', цена для граждан' WHEN 2 THEN 'Единица  измерения' WHEN 3 THEN name || ' Единица измерения' ELSE name END"


@query(sql(f"SELECT item_id, regexp_matches(lower({_HEADED}), 'наименование|цена для|цена с учетом|единица измер|прейскурант') AS header FROM base"))
def header_rows(p: Proxies) -> DataFrame:
    """Rows that look like a table's header: they stay, to be reviewed."""
    name = F.col("name")
    raw = _nth(F.col("l_linenumber"), F.concat(F.lit("НАИМЕНОВАНИЕ "), name), F.concat(name, F.lit(", цена для граждан")), "Единица  измерения", F.concat(name, F.lit(" Единица измерения")), name)
    return p.base.select("item_id", quality.header_row(raw).alias("header"))


@query(sql("SELECT item_id, CASE WHEN resident > 50000000 THEN 'implausibly large price (suspected OCR error)' END AS review_reason FROM (SELECT item_id, CAST(price_original * 1000 AS DOUBLE) AS resident FROM base)"))
def implausible_prices(p: Proxies) -> DataFrame:
    """The rule for prices that no step before has cleared."""
    price = (F.col("price_original") * 1000).cast("double")
    rows = p.base.select("item_id", price.alias("price_resident"), price.alias("price_nonresident"), F.lit(None).cast("date").alias("effective_date"), F.lit(None).cast("double").alias("prev_resident"))
    return quality.validated(rows, AS_OF).select("item_id", "review_reason")


@query("SELECT t AS table_name, count(*) FILTER (NOT EXISTS (SELECT 1 FROM information_schema.columns c WHERE c.table_name = t AND c.column_name = col)) AS missing FROM (VALUES ('part', 'p_partkey'), ('part', 'p_colour'), ('part', 'p_weight'), ('orders', 'o_orderkey'), ('nation', 'n_name'), ('nation', 'n_flag')) AS required(t, col) GROUP BY t")
def required_columns(p: Proxies) -> DataFrame:
    """How many of the columns that a reader needs a table doesn't have."""
    required = {"part": ["p_partkey", "p_colour", "p_weight"], "orders": ["o_orderkey"], "nation": ["n_name", "n_flag"]}
    return p.spark.createDataFrame([(t, len(quality.missing_columns(p.table(t), columns))) for t, columns in required.items()], "table_name string, missing long")


@query(sql("SELECT 'hand-' || item_id AS item_id, b.doc_id, d.partner_id, name, TRUE AS needs_review, 'manually added' AS review_reason, TRUE AS is_active, FALSE AS is_verified, CAST(NULL AS VARCHAR) AS name_norm FROM base b JOIN docs d ON d.doc_id = b.doc_id WHERE l_linenumber = 6"))
def manual_items(p: Proxies) -> DataFrame:
    """Rows that parsing dropped, added again by hand."""
    rows = p.base.where("l_linenumber = 6").select(F.concat(F.lit("hand-"), "item_id").alias("item_id"), "doc_id", "name")
    return overlay.manual_items(rows, p.documents).select("item_id", "doc_id", "partner_id", "name", "needs_review", "review_reason", "is_active", "is_verified", "name_norm")


@query("SELECT event_type || user_id % 50 AS code, arg_max(value, event_id) AS per_unit FROM events WHERE value IS NOT NULL GROUP BY ALL")
def last_good_rates(p: Proxies) -> DataFrame:
    """The latest saved value of each code."""
    saved = p.table("events").where("value is not null").select(F.concat("event_type", (F.col("user_id") % 50).cast("string")).alias("code"), F.col("value").alias("per_unit"), F.col("event_id").alias("saved_at"))
    return overlay.last_good(saved)


@query("SELECT page_id, substr(sha256(url), 1, 16) || '__прайс ' || page_id || '.pdf' AS kept_as FROM pages")
def archived_names(p: Proxies) -> DataFrame:
    """What originals are kept as, whatever folder they came from."""
    path = F.concat(_nth(F.col("page_id"), "/in/a.b/прайс ", "прайс ", "../../прайс "), F.col("page_id").cast("string"), F.lit(".pdf"))
    return p.table("pages").select("page_id", overlay.archived_name(F.sha2("url", 256), path).alias("kept_as"))


@query(sql("SELECT item_id, round_even(CAST(code AS BIGINT) % 4096 / 32.0, 4) AS shown FROM base"))
def display_rates(p: Proxies) -> DataFrame:
    """Four decimals, ties to the even one."""
    return p.base.select("item_id", rates.display_rate((F.col("code").cast("long") % 4096) / F.lit(32.0)).alias("shown"))


@query(sql("SELECT item_id, strftime(effective_date, '%d.%m.%Y') AS asked FROM base"))
def feed_dates(p: Proxies) -> DataFrame:
    """Days as the rate feed wants them."""
    return p.base.select("item_id", dates.feed_text(F.col("effective_date")).alias("asked"))


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN page_id * 1000 + 7 WHEN 1 THEN -page_id END AS value FROM pages")
def whole_numbers(p: Proxies) -> DataFrame:
    """Digits with spaces between them, a sign, and what is no integer."""
    i = F.col("page_id").cast("string")
    raw = _nth(F.col("page_id"), F.concat(F.lit(" "), i, F.lit(" 007 ")), F.concat(F.lit("-"), i), F.concat(i, F.lit("a")), "", None)
    return p.table("pages").select("page_id", numbers.whole_number(raw).alias("value"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_replace(md5(url), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') WHEN 1 THEN md5(url) END AS id FROM pages")
def identifiers(p: Proxies) -> DataFrame:
    """Identifiers with and without dashes, in capitals, with a digit too few, and other texts."""
    plain = F.md5("url")
    dashed = F.regexp_replace(plain, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    raw = _nth(F.col("page_id"), F.concat(F.lit(" "), F.upper(dashed), F.lit("\n")), plain, F.substring(plain, 1, 31), F.col("url"))
    return p.table("pages").select("page_id", text.valid_uuid(raw).alias("id"))


_LISTED = "listed AS (SELECT partner_id, code, section, k // 40 + 1 AS page FROM (SELECT *, row_number() OVER (PARTITION BY partner_id ORDER BY seq) AS k FROM converted) WHERE k // 40 % 5 <> 3)"


@query(
    sql(
        "SELECT partner_id, count(*) AS rows, count(code) - count(DISTINCT code) AS duplicate_codes, count(DISTINCT section) AS sections, array_to_string(list_filter(range(min(page), max(page) + 1), lambda x: NOT list_contains(any_value(seen), x)), ',') AS missing_pages FROM listed JOIN pages_seen USING (partner_id) GROUP BY partner_id",
        _LISTED,
        "pages_seen AS (SELECT partner_id, list(DISTINCT page) AS seen FROM listed GROUP BY partner_id)",
    )
)
def list_gaps(p: Proxies) -> DataFrame:
    """Lists of 40 rows a page that lost each fifth page: repeated codes, sections, missing pages."""
    k = F.row_number().over(Window.partitionBy("partner_id").orderBy("seq"))
    rows = p.base.select("partner_id", "code", "section", F.floor(k / 40).alias("sheet")).where("sheet % 5 <> 3").withColumn("page", F.col("sheet") + 1)
    found = statistics.list_gaps(rows, ["partner_id"])
    return found.withColumn("missing_pages", F.array_join(F.array_sort("missing_pages").cast("array<string>"), ","))


_CELLS = "cells AS (SELECT partner_id, unnest([0, 1, 2, 3, 4, 5]) AS col, unnest([name, code, CASE WHEN partner_id % 3 = 0 THEN name ELSE code END, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE code END, CASE WHEN l_linenumber < 4 THEN name ELSE code END, CASE WHEN partner_id % 2 = 0 THEN 'шт' ELSE code END]) AS text FROM base)"


@query(
    sql(
        "SELECT partner_id, string_agg(g.col, ',' ORDER BY g.col) AS price_cols FROM good g WHERE dense AND NOT EXISTS (SELECT 1 FROM good a JOIN good b ON b.partner_id = a.partner_id AND b.dense AND b.col > a.col WHERE a.partner_id = g.partner_id AND NOT a.dense AND a.col > g.col) GROUP BY partner_id",
        _CELLS,
        "good AS (SELECT partner_id, col, coalesce(avg(CASE WHEN text <> '' THEN CAST(regexp_full_match(text, '[0-9]+') AND TRY_CAST(text AS BIGINT) > 0 AS INTEGER) END), 0) >= 0.6 AS dense FROM cells GROUP BY partner_id, col)",
    )
)
def price_columns(p: Proxies) -> DataFrame:
    """The rightmost run of columns of numbers, in lists with empty, mixed and broken ones."""
    line, name, code = F.col("l_linenumber"), F.col("name"), F.col("code")
    texts = F.array(name, code, F.when(F.col("partner_id") % 3 == 0, name).otherwise(code), F.when(line % 2 == 0, "").otherwise(code), F.when(line < 4, name).otherwise(code), F.when(F.col("partner_id") % 2 == 0, "шт").otherwise(code))
    found = layout.price_columns(p.base.select("partner_id", F.posexplode(texts).alias("col", "text")), ["partner_id"])
    return found.select("partner_id", F.array_join(F.col("price_cols").cast("array<string>"), ",").alias("price_cols"))


_LABELS = ["Цена для ", "ГРАЖДАН республики ", "Иностранцы: ", "без гражданства, ", "Постоянно проживающие ", "кандасы и ", "из стран зарубежья ", "НЕ проживающие "]
_LABEL = f"list_extract([{', '.join(repr(x) for x in _LABELS)}], CAST(CAST(code AS BIGINT) % 8 + 1 AS INTEGER)) || CASE l_linenumber WHEN 1 THEN 'Нерезидентов' WHEN 2 THEN 'РЕЗИДЕНТОВ' ELSE name END"


@query(sql("SELECT item_id, CASE WHEN label LIKE '%нерезидент%' THEN 'F' WHEN label LIKE '%резидент%' THEN 'R' WHEN regexp_matches(label, 'иностран|без граждан') THEN 'F' WHEN regexp_matches(label, 'граждан республики|постоянно прожива|кандас|оралман') THEN 'R' WHEN regexp_matches(label, 'зарубеж|не прожива') THEN 'F' ELSE 'U' END AS role FROM labelled", f"labelled AS (SELECT item_id, lower({_LABEL}) AS label FROM base)"))
def label_roles(p: Proxies) -> DataFrame:
    """Whose price a column's header announces."""
    label = F.concat(_nth(F.col("code").cast("long"), *_LABELS), F.when(F.col("l_linenumber") == 1, "Нерезидентов").when(F.col("l_linenumber") == 2, "РЕЗИДЕНТОВ").otherwise(F.col("name")))
    return p.base.select("item_id", layout.label_role(label).alias("role"))


_ROLES = "roles AS (SELECT item_id, list_transform(range(1 + CAST(l_linenumber % 3 AS BIGINT)), lambda i: substr('FRU', 1 + CAST((CAST(code AS BIGINT) // CAST(3 ** i AS BIGINT)) % 3 AS INTEGER), 1)) AS r FROM base), placed AS (SELECT *, CASE WHEN len(r) = 1 THEN CASE WHEN r[1] <> 'F' THEN 1 END ELSE coalesce(nullif(list_position(r, 'R'), 0), nullif(list_position(r, 'U'), 0)) END AS own FROM roles), paired AS (SELECT *, CASE WHEN own IS NULL THEN 1 WHEN own < len(r) THEN own + 1 WHEN own > 1 THEN own - 1 END AS other FROM placed)"


@query(sql("SELECT item_id, array_to_string(list_transform(r, lambda x, i: CASE WHEN i IS NOT DISTINCT FROM own THEN 'resident' WHEN i IS NOT DISTINCT FROM other THEN 'nonresident' ELSE 'extra' END), ',') AS pattern, list_contains(r, 'R') OR (len(r) = 1 AND r[1] = 'F') AS confident FROM paired", _ROLES))
def tier_patterns(p: Proxies) -> DataFrame:
    """Which of one to three price columns are the resident's and the nonresident's, for all roles they may have."""
    code = F.col("code").cast("long")
    letter = lambda i: F.substring(F.lit("FRU"), (F.floor(code / F.pow(F.lit(3), i)) % 3 + 1).cast("int"), F.lit(1))
    roles = F.transform(F.sequence(F.lit(0), (F.col("l_linenumber") % 3).cast("int")), letter)
    return p.base.select("item_id", roles.alias("r")).select("item_id", F.array_join(layout.tier_pattern(F.col("r")), ",").alias("pattern"), layout.is_confident(F.col("r")).alias("confident"))


@query(sql("SELECT item_id, CASE WHEN near THEN a * 1000 + b || '.0|' || c || '.0' ELSE a || '.0|' || b || '.0|' || c || '.0' END AS prices FROM (SELECT item_id, CAST(code AS BIGINT) % 130 AS a, 100 + partner_id % 900 AS b, 1000 + l_linenumber AS c, CAST(code AS BIGINT) % 130 < 100 AND l_linenumber % 2 = 1 AS near FROM base)"))
def split_thousands(p: Proxies) -> DataFrame:
    """Numbers that a column's edge cut at their thousands become whole; others stay."""
    cells = F.array(F.col("code").cast("long") % 130, 100 + F.col("partner_id") % 900, 1000 + F.col("l_linenumber").cast("long"))
    columns = F.when(F.col("l_linenumber") % 2 == 1, F.array(F.lit(3), F.lit(4), F.lit(5))).otherwise(F.array(F.lit(2), F.lit(4), F.lit(5)))
    joined = layout.join_thousands(cells.cast("array<double>"), columns, cells.cast("array<string>"))
    return p.base.select("item_id", F.array_join(F.transform(joined, lambda x: x["price"].cast("string")), "|").alias("prices"))


_TITLES = "titles AS (SELECT item_id, CASE CAST(code AS BIGINT) % 8 WHEN 0 THEN 'Раздел ' || name WHEN 1 THEN upper(name) WHEN 2 THEN l_linenumber || '. Услуги ' || name WHEN 3 THEN l_linenumber || ') ' || name WHEN 4 THEN upper(name) || ' цена' WHEN 5 THEN 'Разделка ' || name WHEN 6 THEN repeat(upper(name) || ' ', 6) ELSE 'УЗИ' || CASE WHEN l_linenumber % 2 = 0 THEN 'Я' ELSE '' END END AS t FROM base), lettered AS (SELECT *, regexp_replace(t, '[^\\p{L}]', '', 'g') AS l, regexp_replace(t, '[^\\p{Lu}]', '', 'g') AS u, trim(regexp_extract(t, '^[\\s*.+•·]*\\d{1,3}[.)\\s]+(\\p{L}.*)$', 1)) AS body, regexp_matches(t, '(?i)^(раздел|блок|подраздел|глава|часть|приложение|прейскурант)([^\\p{L}\\p{N}_]|$)') AS worded FROM titles)"


@query(sql("SELECT item_id, length(t) <= 80 AND NOT regexp_matches(lower(t), 'ндс|тенге|цена|наимен|единиц|руб|зарубежь') AND (worded OR (length(l) >= 5 AND length(u) / length(l) >= 0.75) OR (body <> '' AND NOT regexp_matches(body, '^\\p{Ll}') AND NOT ends_with(body, ',') AND len(regexp_split_to_array(body, '\\s+')) <= 6)) AS of_text, worded OR (length(l) >= 4 AND length(u) / length(l) >= 0.75) AS of_scan FROM lettered", _TITLES))
def section_titles(p: Proxies) -> DataFrame:
    """Titles of sections by word, capitals or number, in texts and in scans, where the test is looser."""
    name, line = F.col("name"), F.col("l_linenumber").cast("string")
    shout = F.upper(name)
    t = _nth(F.col("code").cast("long"), F.concat(F.lit("Раздел "), name), shout, F.concat(line, F.lit(". Услуги "), name), F.concat(line, F.lit(") "), name), F.concat(shout, F.lit(" цена")), F.concat(F.lit("Разделка "), name), F.repeat(F.concat(shout, F.lit(" ")), 6), F.concat(F.lit("УЗИ"), F.when(F.col("l_linenumber") % 2 == 0, "Я").otherwise("")))
    return p.base.select("item_id", t.alias("t")).select("item_id", layout.is_section(F.col("t")).alias("of_text"), layout.is_section_of_scan(F.col("t")).alias("of_scan"))


@query(sql("SELECT item_id FROM base WHERE NOT (greatest(partner_id % 200, l_linenumber * 20) < 100 AND length(repeat(name || ' ', CAST(l_linenumber AS BIGINT))) > 120)"))
def band_artifacts(p: Proxies) -> DataFrame:
    """Rows without bands of lines that ran together before a stray number."""
    prices = F.array((F.col("partner_id") % 200).cast("double"), (F.col("l_linenumber") * 20).cast("double"))
    rows = p.base.select("item_id", prices.alias("prices"), F.repeat(F.concat("name", F.lit(" ")), F.col("l_linenumber")).alias("long_name"))
    return rows.where(~layout.is_band_artifact(F.col("prices"), F.col("long_name"))).select("item_id")


@query(sql("SELECT doc_id, partner_id, parse_status, CAST(effective_date AS TIMESTAMP) AS parsed_at FROM docs ORDER BY effective_date DESC, doc_id LIMIT 500"))
def recent_documents(p: Proxies) -> DataFrame:
    """A page of documents, the latest first."""
    return queries.page(p.documents, [F.desc("parsed_at"), F.asc("doc_id")], 500, most=5000).select("doc_id", "partner_id", "parse_status", "parsed_at")


@query(
    sql(
        "SELECT item_id, CASE WHEN done OR k IN (0, 3) THEN r WHEN k = 1 THEN r ELSE n END AS resident, CASE WHEN done THEN n WHEN k = 0 THEN n WHEN k = 1 THEN r + n WHEN k = 2 THEN r END AS nonresident, CASE WHEN done AND k = 2 THEN 'VIP=' || format('{:.2f}', r) WHEN NOT done AND k = 1 THEN 'иностранцы=' || format('{:.2f}', n) WHEN NOT done AND k = 2 THEN 'tier_3=' || format('{:.2f}', r + 1) || ',tier_4=' || format('{:.2f}', n + 2) END AS extra FROM served",
        "served AS (SELECT item_id, CAST(price_original AS DOUBLE) AS r, CAST(nonresident_original AS DOUBLE) AS n, l_linenumber % 4 AS k, partner_id % 2 = 0 AS done FROM base)",
    )
)
def serialised_rows(p: Proxies) -> DataFrame:
    """What an extraction hands on: resolved tiers as they are, others mapped by three labels or by position."""
    r, n, k = F.col("r"), F.col("n"), F.col("l_linenumber") % 4
    prices = F.when(k == 0, F.array(r, n)).when(k == 1, F.array(n, r, r + n)).when(k == 2, F.array(n, r, r + 1, n + 2)).otherwise(F.array(r))
    rows = p.base.withColumns({"r": F.col("price_original").cast("double"), "n": F.col("nonresident_original").cast("double"), "tariffs_resolved": F.col("partner_id") % 2 == 0})
    extra = F.when(k == 2, F.create_map(F.lit("VIP"), r))
    served = rows.select(F.col("item_id").alias("doc_id"), "name", "code", "unit", "section", "currency", prices.alias("prices"), r.alias("resident"), n.alias("nonresident"), extra.alias("extra_tiers"), "tariffs_resolved")
    found = pages.serialised(served, F.array(F.lit(" иностранцы "), F.lit("граждан республики"), F.lit("СНГ")))
    tiers = F.array_join(F.transform(F.map_entries("price_extra_tiers"), lambda e: F.format_string("%s=%.2f", e["key"], e["value"])), ",")
    return found.select(F.col("doc_id").alias("item_id"), F.col("price_resident").alias("resident"), F.col("price_nonresident").alias("nonresident"), tiers.alias("extra"))
