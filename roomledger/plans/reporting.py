"""Sources, projections, filters, joins and the booking-grain reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roomledger.functions import dates, labels
from roomledger.functions.exact import cents as cents_of
from roomledger.functions.exact import mean_int as mean_int_of
from roomledger.functions.exact import money as money_of
from roomledger.functions.exact import ratio, sum_money as sum_money_of
from roomledger.operators import bookings as b
from roomledger.operators import features, guests, ordered, policy, quality, stats
from roomledger.plans import views
from roomledger.plans.registry import (
    LEAD_CASE,
    LEAD_CUT,
    cents,
    half_even,
    half_up,
    lead_cut_name,
    mean_int,
    mean_money,
    money,
    plain_mean,
    plan,
    sum_money,
)
from roomledger.session import scratch_path
from roomledger.sources import readers, writers
from roomledger.sources.schema import BOOKINGS, COLUMNS
from roomledger.sources.testdata import HISTORY
from roomledger.sources.testdata import load_bookings as load

SNAPSHOT = "2002-01-01"
# The monthly files of the multi-file source.
MONTH_FILES = tuple(
    "January February March April May June July August September October November December".split()
)
PLAIN_COLUMNS = tuple(c for c in COLUMNS if c not in HISTORY)


# --- sources and sinks -------------------------------------------------------


@plan("src_testdata", " SELECT * FROM bookings")
def src_testdata(spark, path):
    return load(spark, path)


@plan("join_adapter", " SELECT reservation_id, primary_guest_name, booking_source, nights_booked, avg_price_per_room FROM bookings")
def join_adapter(spark, path):
    return load(
        spark, path, "reservation_id", "primary_guest_name", "booking_source", "nights_booked", "avg_price_per_room"
    )


@plan("src_csv", " SELECT * FROM bookings")
def src_csv(spark, path):
    target = scratch_path(spark, "bookings-csv")
    writers.write_csv(load(spark, path), target)
    return readers.read_csv(spark, target)


@plan("src_sql", " SELECT * FROM bookings")
def src_sql(spark, path):
    """The stored table ``bookings``, after its busiest month has been written once more."""
    spark.catalog.dropTempView("bookings")
    writers.save_table(load(spark, path), "bookings", scratch_path(spark, "bookings-table"))
    stored = readers.read_table(spark, "bookings")
    month = stored.groupBy(writers.MONTH).count().orderBy(F.desc("count"), writers.MONTH).first()[0]
    # A table cannot be read while it is overwritten, so the month's rows come from the source.
    again = load(spark, path).filter(F.date_format("check_in_date", "yyyy-MM") == month)
    writers.replace_months(again, "bookings")
    return readers.read_table(spark, "bookings").select(*COLUMNS)


@plan(
    "src_multi_union",
    """ SELECT reservation_id, booking_source, total_amount, is_cancelled, MONTHNAME(check_in_date) AS source_month FROM bookings""",
)
def src_multi_union(spark, path):
    return monthly_files(spark, path)


def monthly_files(spark, path, files=(*MONTH_FILES, "Absent")):
    """Bookings written as a file per month, and those of the named files read back; absent ones are skipped."""
    cols = ("reservation_id", "booking_source", "total_amount", "is_cancelled")
    rows = load(spark, path, *cols, "check_in_date")
    root = scratch_path(spark, "monthly-csv")
    name = F.array(*[F.lit(m) for m in MONTH_FILES])[F.month("check_in_date") - 1]
    rows.select(*cols, name.alias("file")).write.partitionBy("file").csv(root, header=True)
    read = readers.read_many_csv(spark, root, [f"file={n}" for n in files])
    return read.select(*cols, F.substring_index("source_file", "=", -1).alias("source_month"))


@plan(
    "set_union_byname",
    """ SELECT reservation_id, booking_source, corporate_name, lead_time_days FROM bookings WHERE is_cancelled = 0
 UNION ALL SELECT reservation_id, booking_source, NULL, lead_time_days FROM bookings WHERE is_cancelled = 1""",
)
def set_union_byname(spark, path):
    rows = load(spark, path, "reservation_id", "booking_source", "corporate_name", "lead_time_days", "is_cancelled")
    kept = rows.filter("is_cancelled = 0").drop("is_cancelled")
    gone = rows.filter("is_cancelled = 1").select("lead_time_days", "reservation_id", "booking_source")
    return kept.unionByName(gone, allowMissingColumns=True)


@plan(
    "view_register",
    f""" SELECT 'v_guest_lifetime_value' AS view_name, COUNT(DISTINCT primary_guest_name) AS n_rows FROM bookings
 UNION ALL SELECT 'v_lead_time_risk', COUNT(DISTINCT {LEAD_CASE}) FROM bookings
 UNION ALL SELECT 'v_monthly_revpar', COUNT(DISTINCT DATE_TRUNC('month', check_in_date)) FROM bookings WHERE is_cancelled = 0
 UNION ALL SELECT 'v_revenue_daily', COUNT(DISTINCT check_in_date) FROM bookings WHERE is_cancelled = 0
 UNION ALL SELECT 'v_source_performance', COUNT(DISTINCT booking_source) FROM bookings""",
)
def view_register(spark, path):
    names = views.register(spark, load(spark, path, *PLAIN_COLUMNS), SNAPSHOT)
    counts = [
        spark.table(n).agg(F.lit(n).alias("view_name"), F.count(F.lit(1)).alias("n_rows")) for n in names
    ]
    result = counts[0]
    for one in counts[1:]:
        result = result.unionByName(one)
    return result


@plan(
    "snk_csv",
    f""" SELECT booking_source, {sum_money('total_amount')} AS revenue,
 {half_even(f"SUM({cents('total_amount')}) * 100", f"SUM(SUM({cents('total_amount')})) OVER ()", 1)} AS pct_of_revenue
 FROM bookings WHERE is_cancelled = 0 GROUP BY booking_source""",
)
def snk_csv(spark, path):
    report = b.source_share(load(spark, path, "booking_source", "total_amount", "is_cancelled"))
    target = scratch_path(spark, "report-csv")
    writers.write_csv(report, target)
    return readers.read_csv(spark, target, report.schema)


@plan(
    "snk_json",
    f""" SELECT COUNT(*) AS bookings, {mean_int('is_cancelled', 3, True)} AS cancellation_rate,
 CAST(SUM(CASE WHEN is_cancelled = 0 THEN {cents('total_amount')} END) // 100 AS BIGINT) AS total_revenue,
 CAST(SUM(CASE WHEN is_cancelled = 0 THEN {cents('total_amount')} END) // (100 * SUM(1 - is_cancelled)) AS BIGINT) AS avg_booking_value
 FROM bookings""",
)
def snk_json(spark, path):
    summary = b.kpis(load(spark, path, "is_cancelled", "total_amount"))
    target = scratch_path(spark, "summary-json")
    writers.write_json(summary, target)
    return spark.read.schema(summary.schema).json(target)


@plan("snk_sample", " SELECT * FROM bookings ORDER BY reservation_id LIMIT 50")
def snk_sample(spark, path):
    target = scratch_path(spark, "sample-csv")
    writers.write_sample(load(spark, path), target)
    return readers.read_csv(spark, target)


# --- data quality ------------------------------------------------------------


@plan("dq_required", " SELECT COUNT(*) AS n_rows, 37 AS n_columns, 0 AS n_missing FROM bookings")
def dq_required(spark, path):
    return quality.shape(load(spark, path))


@plan(
    "dq_invariants",
    """, c AS (SELECT *, CAST(ROUND(total_lodging_amount*100) AS BIGINT) AS lo, CAST(ROUND(total_lodging_taxes*100) AS BIGINT) AS tx,
 CAST(ROUND(total_amount*100) AS BIGINT) AS tt, CAST(ROUND(net_revenue*100) AS BIGINT) AS nt, CAST(ROUND(paid_at_hotel_amount*100) AS BIGINT) AS ph,
 CAST(ROUND(paid_to_ota_amount*100) AS BIGINT) AS po FROM bookings),
 r AS (SELECT
 COUNT(*) FILTER (is_cancelled = 1 AND (lo <> 0 OR tx <> 0 OR tt <> 0 OR nt <> 0)) AS cancelled_has_revenue,
 COUNT(*) FILTER (is_cancelled = 1 AND stayed_room_nights <> 0) AS cancelled_has_nights,
 COUNT(*) FILTER (is_cancelled = 0 AND cancel_days_before_arrival <> -1) AS honoured_has_cancel_day,
 COUNT(*) FILTER (lo + tx <> tt) AS total_not_lodging_plus_tax,
 COUNT(*) FILTER (ABS(lo * 12 - tx * 100) > 100) AS tax_not_12_percent,
 COUNT(*) FILTER (ABS(ROUND(tt * (100 - ota_commission_pct) / 100) - nt) > 1) AS net_not_after_commission,
 COUNT(*) FILTER (tt - ph - po <> 0) AS payments_do_not_add_up,
 COUNT(*) FILTER (ABS((avg_price_per_room - competitor_avg_rate) * 100 / NULLIF(competitor_avg_rate, 0) - rate_premium_pct) > 0.01) AS premium_off,
 COUNT(*) FILTER (check_in_date - lead_time_days <> booking_date) AS booking_date_off,
 COUNT(*) FILTER (NOT (lead_time_days BETWEEN 0 AND 180)) AS lead_time_out_of_range,
 COUNT(*) FILTER (market_segment IS DISTINCT FROM (CASE booking_source WHEN 'OTA' THEN 'Online Leisure' WHEN 'Web' THEN 'Online Leisure'
   WHEN 'Corporate' THEN 'Corporate' WHEN 'Travel Agent' THEN 'Group / Agent' WHEN 'Direct / Front Desk' THEN 'Direct' END)) AS segment_not_of_source
 FROM c)
 SELECT name AS rule, value AS violations FROM r UNPIVOT (value FOR name IN (cancelled_has_revenue, cancelled_has_nights, honoured_has_cancel_day,
 total_not_lodging_plus_tax, tax_not_12_percent, net_not_after_commission, payments_do_not_add_up, premium_off, booking_date_off, lead_time_out_of_range, segment_not_of_source))""",
)
def dq_invariants(spark, path):
    return quality.violations(load(spark, path, *PLAIN_COLUMNS))


@plan(
    "dq_suspicious",
    " SELECT booking_source, corporate_name, total_amount, paid_to_ota_amount FROM bookings WHERE paid_to_ota_amount < -1000",
)
def dq_suspicious(spark, path):
    rows = load(spark, path, "booking_source", "corporate_name", "total_amount", "paid_to_ota_amount")
    return quality.suspicious_payouts(rows)


# --- projections and filters -------------------------------------------------


@plan(
    "prj_logit_input",
    """ SELECT reservation_id, lead_time_days, n_special_requests, previous_cancellations, previous_successful_bookings, n_adults, n_children,
 booking_source, market_segment, room_type_reserved, meal_plan, payment_mode, avg_price_per_room, rate_premium_pct, nights_booked, got_room_upgrade,
 CAST(EXTRACT(MONTH FROM check_in_date) AS INT) AS checkin_month, CAST(EXTRACT(DOW FROM check_in_date) AS INT) AS checkin_dow,
 CASE WHEN EXTRACT(DOW FROM check_in_date) >= 5 THEN 1 ELSE 0 END AS is_weekend,
 CASE WHEN EXTRACT(MONTH FROM check_in_date) IN (4,9,10,12) THEN 1 ELSE 0 END AS is_peak_month, is_cancelled FROM bookings""",
)
def prj_logit_input(spark, path):
    return features.prebooking_signals(load(spark, path, *features.SIGNALS, "check_in_date", "is_cancelled"))


@plan(
    "prj_drop_cols",
    """ SELECT booking_source, market_segment, lead_time_days, n_adults, n_children, previous_cancellations, previous_successful_bookings,
 n_special_requests, room_no, room_type_reserved, got_room_upgrade, meal_plan, nights_booked, avg_price_per_room, competitor_avg_rate,
 rate_premium_pct, payment_mode, ota_commission_pct, is_cancelled FROM bookings""",
)
def prj_drop_cols(spark, path):
    return features.without_leakage(load(spark, path))


@plan(
    "prj_keep",
    " SELECT total_lodging_amount, total_amount, paid_at_hotel_amount, paid_to_ota_amount, stayed_room_nights FROM bookings",
)
def prj_keep(spark, path):
    return load(
        spark, path, "total_lodging_amount", "total_amount", "paid_at_hotel_amount", "paid_to_ota_amount", "stayed_room_nights"
    )


@plan("prj_rename", " SELECT check_in_date AS ds, total_amount AS y FROM bookings WHERE is_cancelled = 0")
def prj_rename(spark, path):
    rows = b.honoured(load(spark, path, "check_in_date", "total_amount", "is_cancelled"))
    return rows.withColumnsRenamed({"check_in_date": "ds", "total_amount": "y"}).drop("is_cancelled")


@plan(
    "flt_honoured",
    " SELECT reservation_id, total_amount FROM bookings WHERE is_cancelled = 0 AND total_lodging_amount <> 0",
)
def flt_honoured(spark, path):
    rows = load(spark, path, "reservation_id", "total_amount", "total_lodging_amount", "is_cancelled")
    return b.honoured(rows).filter("total_lodging_amount <> 0").select("reservation_id", "total_amount")


@plan(
    "flt_cancelled_pos_lead",
    " SELECT reservation_id, lead_time_days, cancel_days_before_arrival FROM bookings WHERE is_cancelled = 1 AND lead_time_days > 0",
)
def flt_cancelled_pos_lead(spark, path):
    rows = load(spark, path, "reservation_id", "lead_time_days", "cancel_days_before_arrival", "is_cancelled")
    return rows.filter((F.col("is_cancelled") == 1) & (F.col("lead_time_days") > 0)).drop("is_cancelled")


@plan(
    "flt_in_list",
    """ SELECT reservation_id, booking_source, check_in_date, room_no FROM bookings WHERE booking_source IN ('OTA','Web')
 AND EXTRACT(MONTH FROM check_in_date) IN (4,9,10,12) AND room_no IN (202,206,208,210,301,302,309)""",
)
def flt_in_list(spark, path):
    rows = load(spark, path, "reservation_id", "booking_source", "check_in_date", "room_no")
    return rows.filter(
        F.col("booking_source").isin("OTA", "Web")
        & F.month("check_in_date").isin(*dates.PEAK_MONTHS)
        & F.col("room_no").isin(*features.HOT_ROOMS)
    )


@plan(
    "flt_not_blank",
    " SELECT reservation_id, corporate_name FROM bookings WHERE corporate_name IS NOT NULL AND corporate_name <> ''",
)
def flt_not_blank(spark, path):
    name = F.col("corporate_name")
    return load(spark, path, "reservation_id", "corporate_name").filter(name.isNotNull() & (name != ""))


@plan(
    "flt_complete_obs",
    " SELECT reservation_id, corporate_name, total_amount FROM bookings WHERE corporate_name IS NOT NULL AND total_amount IS NOT NULL",
)
def flt_complete_obs(spark, path):
    rows = load(spark, path, "reservation_id", "corporate_name", "total_amount")
    return rows.na.drop(subset=["corporate_name", "total_amount"])


@plan("flt_having_n", " SELECT booking_source, COUNT(*) AS n FROM bookings WHERE is_cancelled = 0 GROUP BY booking_source HAVING COUNT(*) >= 100")
def flt_having_n(spark, path):
    return b.having_at_least(b.honoured(load(spark, path, "booking_source", "is_cancelled")), "booking_source", 100)


@plan("prj_stayed_flag", " SELECT reservation_id, CASE WHEN total_amount = 0 THEN 0 ELSE 1 END AS stayed FROM bookings")
def prj_stayed_flag(spark, path):
    rows = load(spark, path, "reservation_id", "total_amount")
    return rows.select("reservation_id", features.stayed_flag().alias("stayed"))


@plan("prj_distinct_values", " SELECT DISTINCT booking_source FROM bookings")
def prj_distinct_values(spark, path):
    return load(spark, path, "booking_source").distinct()


# --- joins -------------------------------------------------------------------


@plan(
    "join_map_label",
    """ SELECT reservation_id, booking_source, CASE booking_source WHEN 'OTA' THEN 'Online Leisure' WHEN 'Web' THEN 'Online Leisure'
 WHEN 'Corporate' THEN 'Corporate' WHEN 'Travel Agent' THEN 'Group / Agent' WHEN 'Direct / Front Desk' THEN 'Direct' END AS segment FROM bookings""",
)
def join_map_label(spark, path):
    rows = load(spark, path, "reservation_id", "booking_source")
    return rows.withColumn("segment", labels.lookup(F.col("booking_source"), labels.SEGMENT_OF_SOURCE))


@plan(
    "join_concat_cols",
    """ SELECT reservation_id, CAST(lead_time_days AS DOUBLE) AS lead_time_days, CASE WHEN booking_source = 'Web' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "booking_source_Web",
 CASE WHEN payment_mode = 'Pay at Hotel' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "payment_mode_Pay at Hotel" FROM bookings""",
)
def join_concat_cols(spark, path):
    rows = load(spark, path, "reservation_id", "lead_time_days", "booking_source", "payment_mode")
    dummies = features.dummies({"booking_source": ["Web"], "payment_mode": ["Pay at Hotel"]})
    return rows.select("reservation_id", F.col("lead_time_days").cast("double"), *dummies)


# --- aggregates --------------------------------------------------------------


@plan(
    "q02_cancel_by_source",
    f""" SELECT booking_source, market_segment, COUNT(*) AS total_bookings, CAST(SUM(is_cancelled) AS BIGINT) AS cancellations,
 {mean_int('is_cancelled', 4)} AS cancellation_rate, {mean_int('lead_time_days', 1)} AS avg_lead_time_days
 FROM bookings GROUP BY booking_source, market_segment ORDER BY cancellation_rate DESC""",
)
def q02_cancel_by_source(spark, path):
    return b.cancellation_by_source(load(spark, path, "booking_source", "market_segment", "is_cancelled", "lead_time_days"))


@plan(
    "q03_lead_buckets",
    f""" SELECT {LEAD_CASE} AS lead_time_bucket, COUNT(*) AS bookings, CAST(SUM(is_cancelled) AS BIGINT) AS cancellations,
 {mean_int('is_cancelled', 4)} AS cancellation_rate FROM bookings GROUP BY 1 ORDER BY MIN(lead_time_days)""",
)
def q03_lead_buckets(spark, path):
    return b.lead_buckets(load(spark, path, "lead_time_days", "is_cancelled"))


@plan(
    "q03b_lead_buckets_cut",
    f""", cut AS (SELECT {LEAD_CUT} AS slot, is_cancelled FROM bookings)
 SELECT {lead_cut_name(labels.LEAD_NAMES_DASH)} AS lead_bucket, {mean_int('is_cancelled', 4, True)} AS cancellation_rate, COUNT(*) AS bookings
 FROM cut WHERE slot IS NOT NULL GROUP BY slot ORDER BY slot""",
)
def q03b_lead_buckets_cut(spark, path):
    return b.lead_buckets_cut(load(spark, path, "lead_time_days", "is_cancelled"))


@plan(
    "q04_monthly_revenue",
    f""" SELECT CAST(DATE_TRUNC('month', check_in_date) AS DATE) AS month, COUNT(*) AS bookings, {sum_money('total_amount')} AS gross_revenue,
 {sum_money('net_revenue')} AS net_revenue_after_commission, {mean_money('total_amount')} AS avg_booking_value,
 {mean_money('avg_price_per_room')} AS avg_daily_rate FROM bookings WHERE is_cancelled = 0 GROUP BY 1 ORDER BY 1""",
)
def q04_monthly_revenue(spark, path):
    return b.monthly_revenue(
        load(spark, path, "check_in_date", "total_amount", "net_revenue", "avg_price_per_room", "is_cancelled")
    )


_TENTHS = "CAST(ROUND(ota_commission_pct * 10) AS BIGINT)"


@plan(
    "q05_source_net_revenue",
    f""", s AS (SELECT booking_source, COUNT(*) AS n, SUM({cents('total_amount')}) AS g, SUM({cents('net_revenue')}) AS t,
 SUM({_TENTHS}) AS c FROM bookings WHERE is_cancelled = 0 GROUP BY booking_source),
 w AS (SELECT *, SUM(n) OVER () AS all_n, SUM(t) OVER () AS all_t FROM s)
 SELECT booking_source, n AS bookings, {half_up('n * 100', 'all_n', 1)} AS pct_of_bookings, {money('g')} AS gross_revenue, {money('t')} AS net_revenue,
 {money('(g - t)')} AS commission_paid, {half_up('t * 100', 'all_t', 1)} AS pct_of_net_revenue, {half_up('c', '(n * 10)', 1)} AS avg_commission_pct
 FROM w ORDER BY net_revenue DESC""",
)
def q05_source_net_revenue(spark, path):
    return b.source_net_revenue(
        load(spark, path, "booking_source", "total_amount", "net_revenue", "ota_commission_pct", "is_cancelled")
    )


@plan(
    "q05b_net_per_booking",
    f""", s AS (SELECT booking_source, COUNT(*) AS n, SUM({cents('total_amount')}) AS g, SUM({cents('net_revenue')}) AS t,
 SUM({_TENTHS}) AS c FROM bookings WHERE is_cancelled = 0 GROUP BY booking_source)
 SELECT booking_source, n AS bookings, {money('g')} AS gross_revenue, {money('t')} AS net_revenue, CAST(c AS DOUBLE) / (n * 10.0::DOUBLE) AS avg_commission,
 {money('(g - t)')} AS commission_paid, {half_even('t', '(n * 100)', 2)} AS net_per_booking, {half_even('g', '(n * 100)', 2)} AS gross_per_booking
 FROM s ORDER BY net_revenue DESC""",
)
def q05b_net_per_booking(spark, path):
    return b.net_per_booking(
        load(spark, path, "booking_source", "reservation_id", "total_amount", "net_revenue", "ota_commission_pct", "is_cancelled")
    )


@plan(
    "q06_daily_revpar",
    f""", d AS (SELECT check_in_date AS date, CAST(SUM(stayed_room_nights) AS BIGINT) AS rooms_sold, SUM({cents('avg_price_per_room')}) AS p, COUNT(*) AS n
 FROM bookings WHERE is_cancelled = 0 GROUP BY check_in_date)
 SELECT date, rooms_sold, {half_up('p', '(n * 100)', 2)} AS avg_daily_rate, {half_up('rooms_sold', '14', 4)} AS occupancy_rate,
 {half_up('p * rooms_sold', '(n * 1400)', 2)} AS revpar FROM d ORDER BY date""",
)
def q06_daily_revpar(spark, path):
    return b.daily_revpar(load(spark, path, "check_in_date", "stayed_room_nights", "avg_price_per_room", "is_cancelled"))


@plan(
    "q08_room_performance",
    f""" SELECT room_no, room_type_assigned, COUNT(*) AS total_bookings, CAST(SUM(stayed_room_nights) AS BIGINT) AS total_nights,
 {mean_int('is_cancelled', 3)} AS cancellation_rate, {mean_money('avg_price_per_room')} AS avg_nightly_rate, {sum_money('net_revenue')} AS total_net_revenue
 FROM bookings GROUP BY room_no, room_type_assigned ORDER BY total_bookings DESC""",
)
def q08_room_performance(spark, path):
    return b.room_performance(
        load(spark, path, "room_no", "room_type_assigned", "stayed_room_nights", "is_cancelled", "avg_price_per_room", "net_revenue")
    )


@plan(
    "q09_prior_cancel_outcome",
    f""" SELECT previous_cancellations, COUNT(*) AS bookings, {mean_int('is_cancelled', 4)} AS cancellation_rate
 FROM bookings GROUP BY previous_cancellations ORDER BY previous_cancellations""",
)
def q09_prior_cancel_outcome(spark, path):
    return b.outcome_by_history(load(spark, path, "previous_cancellations", "is_cancelled"))


@plan(
    "v_revenue_daily",
    f""" SELECT check_in_date AS ds, {sum_money('total_amount')} AS y, {sum_money('net_revenue')} AS net_y, COUNT(*) AS bookings,
 {mean_money('avg_price_per_room')} AS adr FROM bookings WHERE is_cancelled = 0 GROUP BY check_in_date ORDER BY check_in_date""",
)
def v_revenue_daily(spark, path):
    return b.revenue_daily(load(spark, path, "check_in_date", "total_amount", "net_revenue", "avg_price_per_room", "is_cancelled"))


@plan(
    "v_source_performance",
    f""" SELECT booking_source, market_segment, COUNT(*) AS bookings, CAST(SUM(is_cancelled) AS BIGINT) AS cancellations,
 {mean_int('is_cancelled', 4)} AS cancellation_rate, {sum_money('total_amount')} AS gross_revenue, {sum_money('net_revenue')} AS net_revenue,
 {mean_int('lead_time_days', 1)} AS avg_lead_time FROM bookings GROUP BY booking_source, market_segment""",
)
def v_source_performance(spark, path):
    return b.source_performance(
        load(spark, path, "booking_source", "market_segment", "is_cancelled", "total_amount", "net_revenue", "lead_time_days")
    )


@plan(
    "v_lead_time_risk",
    f""" SELECT {LEAD_CASE} AS lead_bucket, COUNT(*) AS bookings, {mean_int('is_cancelled', 4)} AS cancellation_rate,
 {money(f"SUM(CASE WHEN is_cancelled = 1 THEN {cents('total_amount')} ELSE 0 END)")} AS revenue_at_risk,
 {money(f"SUM(CASE WHEN is_cancelled = 1 THEN {cents('avg_price_per_room')} * nights_booked ELSE 0 END)")} AS booked_value_at_risk
 FROM bookings GROUP BY 1""",
)
def v_lead_time_risk(spark, path):
    return b.lead_time_risk(
        load(spark, path, "lead_time_days", "is_cancelled", "total_amount", "avg_price_per_room", "nights_booked")
    )


_MONTHLY = f""", d AS (SELECT CAST(DATE_TRUNC('month', check_in_date) AS DATE) AS month, CAST(SUM(stayed_room_nights) AS BIGINT) AS s,
 SUM({cents('avg_price_per_room')}) AS p, COUNT(*) AS n FROM bookings WHERE is_cancelled = 0 GROUP BY 1),
 m AS (SELECT *, CAST(EXTRACT(DAY FROM LAST_DAY(month)) AS INT) AS dim FROM d)"""


@plan(
    "v_monthly_revpar",
    f"""{_MONTHLY} SELECT month, {half_up('p', '(n * 100)', 2)} AS adr, s AS rooms_sold, dim * 14 AS total_capacity,
 {half_up('s', '(dim * 14)', 4)} AS occupancy_rate, {half_up('p * s', '(n * 1400 * dim)', 2)} AS revpar FROM m ORDER BY month""",
)
def v_monthly_revpar(spark, path):
    return b.monthly_revpar(load(spark, path, "check_in_date", "stayed_room_nights", "avg_price_per_room", "is_cancelled"))


@plan(
    "revpar_clipped",
    f"""{_MONTHLY}, k AS (SELECT *, LEAST(s, dim * 14) AS sold FROM m)
 SELECT STRFTIME(month, '%Y-%m') AS month, {half_even('p', '(n * 100)', 2)} AS adr, s AS rooms_sold, dim AS days_in_month, dim * 14 AS capacity,
 {half_even('sold', '(dim * 14)', 4)} AS occupancy, {half_even('p * sold', '(n * 1400 * dim)', 2)} AS revpar FROM k ORDER BY month""",
)
def revpar_clipped(spark, path):
    return b.monthly_revpar_clipped(load(spark, path, "check_in_date", "stayed_room_nights", "avg_price_per_room", "is_cancelled"))


_DIMS = ("booking_source", "room_type_reserved", "payment_mode", "n_special_requests", "previous_successful_bookings")


@plan(
    "agg_rate_by_dim",
    " "
    + " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS level, {plain_mean('is_cancelled')} AS cancellation_rate, COUNT(*) AS bookings FROM bookings GROUP BY {d}"
        for d in _DIMS
    ),
)
def agg_rate_by_dim(spark, path):
    return b.rates_by_each(load(spark, path, *_DIMS, "is_cancelled"), _DIMS)


@plan(
    "agg_global_rate",
    f""" SELECT {plain_mean('is_cancelled')} AS overall_rate, CAST(SUM(CASE WHEN booking_source = 'OTA' THEN is_cancelled END) AS DOUBLE)
 / COUNT(CASE WHEN booking_source = 'OTA' THEN 1 END) AS segment_rate FROM bookings""",
)
def agg_global_rate(spark, path):
    return b.global_rates(load(spark, path, "booking_source", "is_cancelled"))


@plan(
    "agg_source_share",
    f""", s AS (SELECT booking_source, SUM({cents('total_amount')}) AS t FROM bookings WHERE is_cancelled = 0 GROUP BY 1), w AS (SELECT *, SUM(t) OVER () AS a FROM s)
 SELECT booking_source, {money('t')} AS revenue, {half_even('t * 100', 'a', 1)} AS pct_of_revenue FROM w ORDER BY revenue DESC""",
)
def agg_source_share(spark, path):
    return b.source_share(load(spark, path, "booking_source", "total_amount", "is_cancelled"))


@plan(
    "agg_source_month_fact",
    f""" SELECT booking_source, STRFTIME(check_in_date, '%Y-%m') AS month, COUNT(*) AS bookings, {sum_money('total_amount')} AS revenue
 FROM bookings WHERE is_cancelled = 0 GROUP BY 1, 2 ORDER BY 1, 2""",
)
def agg_source_month_fact(spark, path):
    return b.source_month_fact(load(spark, path, "booking_source", "check_in_date", "reservation_id", "total_amount", "is_cancelled"))


@plan(
    "agg_kpis",
    f""" SELECT COUNT(*) AS bookings, {mean_int('is_cancelled', 3, True)} AS cancellation_rate,
 CAST(SUM(CASE WHEN is_cancelled = 0 THEN {cents('total_amount')} END) // 100 AS BIGINT) AS total_revenue,
 CAST(SUM(CASE WHEN is_cancelled = 0 THEN {cents('total_amount')} END) // (100 * SUM(1 - is_cancelled)) AS BIGINT) AS avg_booking_value FROM bookings""",
)
def agg_kpis(spark, path):
    return b.kpis(load(spark, path, "is_cancelled", "total_amount"))


@plan(
    "agg_revenue_by_source_r",
    f""" SELECT booking_source, {sum_money('total_lodging_amount')} AS total_revenue,
 CAST(SUM({cents('total_lodging_amount')}) AS DOUBLE) / (COUNT(total_lodging_amount) * 100.0::DOUBLE) AS mean_revenue, COUNT(*) AS n_bookings
 FROM bookings WHERE total_lodging_amount <> 0 GROUP BY booking_source ORDER BY total_revenue DESC""",
)
def agg_revenue_by_source_r(spark, path):
    rows = load(spark, path, "booking_source", "total_lodging_amount").filter("total_lodging_amount <> 0")
    return b.revenue_by(rows, "booking_source", "total_lodging_amount")


@plan(
    "agg_corporate_top",
    f""" SELECT corporate_name, {sum_money('total_lodging_amount')} AS revenue, COUNT(*) AS bookings FROM bookings
 WHERE total_lodging_amount <> 0 AND corporate_name IS NOT NULL AND corporate_name <> '' GROUP BY corporate_name ORDER BY revenue DESC""",
)
def agg_corporate_top(spark, path):
    rows = load(spark, path, "corporate_name", "total_lodging_amount").filter("total_lodging_amount <> 0")
    return b.corporate_top(rows)


@plan(
    "agg_value_counts",
    """ SELECT 'booking_source' AS attribute, booking_source AS level, COUNT(*) AS n FROM bookings WHERE is_cancelled = 0 GROUP BY 2
 UNION ALL SELECT 'stayed_room_nights', CAST(stayed_room_nights AS VARCHAR), COUNT(*) FROM bookings WHERE is_cancelled = 0 GROUP BY 2
 UNION ALL SELECT 'pax', pax, COUNT(*) FROM bookings WHERE is_cancelled = 0 GROUP BY 2""",
)
def agg_value_counts(spark, path):
    cols = ("booking_source", "stayed_room_nights", "pax")
    rows = b.honoured(load(spark, path, *cols, "is_cancelled"))
    cells = [F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("level")) for c in cols]
    long = rows.select(F.inline(F.array(*cells)))
    return long.groupBy("attribute", "level").agg(F.count(F.lit(1)).alias("n"))


@plan(
    "agg_prop_table",
    f""", s AS (SELECT CASE WHEN is_cancelled = 1 THEN 'Cancelled' ELSE 'Honoured' END AS label, COUNT(*) AS n FROM bookings GROUP BY 1),
 w AS (SELECT *, SUM(n) OVER () AS a FROM s) SELECT label, n, {half_even('n * 100', 'a', 1)} AS pct FROM w""",
)
def agg_prop_table(spark, path):
    label = F.when(F.col("is_cancelled") == 1, "Cancelled").otherwise("Honoured")
    return b.proportions(load(spark, path, "is_cancelled").select(label.alias("label")), "label", 1)


@plan(
    "agg_elasticity",
    """, r AS (SELECT booking_source, LN(avg_price_per_room / GREATEST(competitor_avg_rate, 1.0)) AS x, LN(CAST(GREATEST(nights_booked, 1) AS DOUBLE)) AS y
 FROM bookings WHERE is_cancelled = 0 AND avg_price_per_room > 0),
 g AS (SELECT booking_source, REGR_SLOPE(y, x) AS slope, REGR_R2(y, x) AS r2, COUNT(*) AS n FROM r GROUP BY 1 HAVING COUNT(*) >= 100)
 SELECT booking_source, ROUND(slope, 3) + 0.0 AS elasticity, ROUND(r2, 4) AS r2, n, CASE WHEN ABS(slope) < 0.3 THEN 'inelastic (demand insensitive to price)'
 ELSE 'elastic (demand falls when overpriced)' END AS interpretation FROM g""",
)
def agg_elasticity(spark, path):
    rows = load(spark, path, "booking_source", "avg_price_per_room", "competitor_avg_rate", "nights_booked", "is_cancelled")
    return stats.log_log_slope(b.honoured(rows))


_NUMERIC = (
    "lead_time_days",
    "n_adults",
    "n_children",
    "n_special_requests",
    "previous_cancellations",
    "previous_successful_bookings",
    "avg_price_per_room",
    "rate_premium_pct",
    "nights_booked",
    "is_cancelled",
)


def _corr_sql() -> str:
    pairs = [(x, y) for i, x in enumerate(_NUMERIC) for y in _NUMERIC[i + 1 :]]
    row = ", ".join(f"CORR({x}, {y}) AS c{i}" for i, (x, y) in enumerate(pairs))
    cells = [
        f"SELECT '{a}' AS a, '{o}' AS b, ROUND(c{i}, 3) + 0.0 AS r FROM k"
        for i, (x, y) in enumerate(pairs)
        for a, o in ((x, y), (y, x))
    ]
    cells += [f"SELECT '{x}', '{x}', 1.0::DOUBLE" for x in _NUMERIC]
    return f", k AS (SELECT {row} FROM bookings) " + " UNION ALL ".join(cells)


@plan("agg_corr_matrix", _corr_sql())
def agg_corr_matrix(spark, path):
    return stats.correlation(load(spark, path, *_NUMERIC), _NUMERIC)


_DESCRIBED = tuple(f.name for f in BOOKINGS if isinstance(f.dataType, T.NumericType))


@plan(
    "agg_describe",
    " "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, COUNT({c}) AS count, ROUND(AVG({c}), 4) AS mean, ROUND(STDDEV_SAMP({c}), 4) AS std, CAST(MIN({c}) AS DOUBLE) AS min,
 ROUND(QUANTILE_CONT(CAST({c} AS DOUBLE), 0.25), 4) AS p25, ROUND(QUANTILE_CONT(CAST({c} AS DOUBLE), 0.5), 4) AS p50,
 ROUND(QUANTILE_CONT(CAST({c} AS DOUBLE), 0.75), 4) AS p75, CAST(MAX({c}) AS DOUBLE) AS max FROM bookings"""
        for c in _DESCRIBED
    ),
)
def agg_describe(spark, path):
    return stats.describe(load(spark, path, *_DESCRIBED), _DESCRIBED)


@plan(
    "agg_null_counts",
    " SELECT 'corporate_name' AS column_name, COUNT(*) - COUNT(corporate_name) AS nulls FROM bookings HAVING COUNT(*) > COUNT(corporate_name)",
)
def agg_null_counts(spark, path):
    return quality.null_counts(load(spark, path))


@plan(
    "agg_histogram",
    """, v AS (SELECT CAST(cancel_days_before_arrival AS DOUBLE) AS x FROM bookings WHERE is_cancelled = 1 AND lead_time_days > 0),
 e AS (SELECT MIN(x) AS lo, MAX(x) AS hi FROM v), p AS (SELECT CAST(LEAST(FLOOR((x - lo) / ((hi - lo) / 40)), 39) AS INT) AS bin, lo, hi FROM v, e)
 SELECT bin, lo + bin * ((hi - lo) / 40) AS left_edge, COUNT(*) AS n FROM p GROUP BY bin, lo, hi""",
)
def agg_histogram(spark, path):
    rows = load(spark, path, "cancel_days_before_arrival", "is_cancelled", "lead_time_days")
    return stats.histogram(policy.cancelled_with_lead(rows), "cancel_days_before_arrival", 40)


@plan(
    "agg_box_stats",
    """, h AS (SELECT booking_source, total_lodging_amount AS x FROM bookings WHERE total_lodging_amount <> 0),
 q AS (SELECT booking_source, MIN(x) AS mn, MAX(x) AS mx, QUANTILE_CONT(x, 0.25) AS q1, QUANTILE_CONT(x, 0.5) AS md, QUANTILE_CONT(x, 0.75) AS q3 FROM h GROUP BY 1)
 SELECT q.booking_source, mn AS min, ROUND(q1, 4) AS q1, ROUND(md, 4) AS median, ROUND(q3, 4) AS q3, mx AS max,
 COUNT(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers FROM h JOIN q ON q.booking_source = h.booking_source GROUP BY ALL""",
)
def agg_box_stats(spark, path):
    rows = load(spark, path, "booking_source", "total_lodging_amount").filter("total_lodging_amount <> 0")
    return stats.box_stats(rows, "booking_source", "total_lodging_amount")


@plan(
    "agg_median_tier",
    """, h AS (SELECT reservation_id, total_amount FROM bookings WHERE is_cancelled = 0), m AS (SELECT QUANTILE_CONT(total_amount, 0.5) AS md FROM h)
 SELECT reservation_id, total_amount, CASE WHEN total_amount > md THEN 'High' ELSE 'Low' END AS revenue_tier FROM h, m""",
)
def agg_median_tier(spark, path):
    rows = b.honoured(load(spark, path, "reservation_id", "total_amount", "is_cancelled")).drop("is_cancelled")
    return stats.above_median(rows, "total_amount", "revenue_tier")


# --- windows, order ----------------------------------------------------------


@plan(
    "win_share_of_total",
    f""", s AS (SELECT market_segment, COUNT(*) AS n, SUM({cents('net_revenue')}) AS t FROM bookings WHERE is_cancelled = 0 GROUP BY 1),
 w AS (SELECT *, SUM(n) OVER () AS an, SUM(t) OVER () AS total_t FROM s)
 SELECT market_segment, {half_up('n * 100', 'an', 1)} AS pct_of_bookings, {half_up('t * 100', 'total_t', 1)} AS pct_of_revenue FROM w""",
)
def win_share_of_total(spark, path):
    rows = b.honoured(load(spark, path, "market_segment", "net_revenue", "is_cancelled"))
    whole = Window.partitionBy()
    grouped = rows.groupBy("market_segment").agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents_of("net_revenue")).alias("t")
    )
    return grouped.select(
        "market_segment",
        ratio(F.col("n") * 100, F.sum("n").over(whole), 1).alias("pct_of_bookings"),
        ratio(F.col("t") * 100, F.sum("t").over(whole), 1).alias("pct_of_revenue"),
    )


@plan(
    "win_guest_history",
    " SELECT reservation_id, primary_guest_name, previous_cancellations, previous_successful_bookings FROM bookings",
)
def win_guest_history(spark, path):
    return load(spark, path, "reservation_id", "primary_guest_name", "previous_cancellations", "previous_successful_bookings")


@plan(
    "srt_order",
    f""" SELECT booking_source, room_type_reserved, COUNT(*) AS bookings, {sum_money('total_amount')} AS revenue FROM bookings
 GROUP BY 1, 2 ORDER BY revenue DESC, MIN(lead_time_days), booking_source, room_type_reserved""",
)
def srt_order(spark, path):
    rows = load(spark, path, "booking_source", "room_type_reserved", "total_amount", "lead_time_days")
    return (
        rows.groupBy("booking_source", "room_type_reserved")
        .agg(
            F.count(F.lit(1)).alias("bookings"),
            sum_money_of("total_amount").alias("revenue"),
            F.min("lead_time_days").alias("_first"),
        )
        .orderBy(F.desc("revenue"), "_first", "booking_source", "room_type_reserved")
        .drop("_first")
    )


@plan(
    "srt_topk",
    f""", d AS (SELECT STRFTIME(check_in_date, '%Y-%m') AS month, SUM({cents('total_amount')}) AS t FROM bookings WHERE is_cancelled = 0 GROUP BY 1)
 SELECT month, {money('t')} AS revenue FROM d ORDER BY month DESC LIMIT 6""",
)
def srt_topk(spark, path):
    rows = b.honoured(load(spark, path, "check_in_date", "total_amount", "is_cancelled"))
    monthly = rows.groupBy(dates.month_label("check_in_date").alias("month")).agg(
        sum_money_of("total_amount").alias("revenue")
    )
    return monthly.orderBy(F.desc("month")).limit(6)


# --- scalar functions --------------------------------------------------------


@plan(
    "fn_date_parts",
    """ SELECT reservation_id, CAST(EXTRACT(MONTH FROM check_in_date) AS INT) AS month, CAST(EXTRACT(DOW FROM check_in_date) AS INT) AS dow_sunday0,
 CAST(EXTRACT(ISODOW FROM check_in_date) - 1 AS INT) AS dow_monday0, CAST(EXTRACT(QUARTER FROM check_in_date) AS INT) AS quarter,
 CASE WHEN EXTRACT(DOW FROM check_in_date) >= 5 THEN 1 ELSE 0 END AS weekend_fri_sat,
 CASE WHEN EXTRACT(ISODOW FROM check_in_date) >= 5 THEN 1 ELSE 0 END AS weekend_fri_sun FROM bookings""",
)
def fn_date_parts(spark, path):
    day = "check_in_date"
    return load(spark, path, "reservation_id", day).select(
        "reservation_id",
        F.month(day).alias("month"),
        dates.dow_sunday0(day).alias("dow_sunday0"),
        dates.dow_monday0(day).alias("dow_monday0"),
        F.quarter(day).alias("quarter"),
        dates.weekend_fri_sat(day).alias("weekend_fri_sat"),
        dates.weekend_fri_sun(day).alias("weekend_fri_sun"),
    )


@plan(
    "fn_month_trunc",
    " SELECT reservation_id, CAST(DATE_TRUNC('month', check_in_date) AS DATE) AS month, STRFTIME(check_in_date, '%Y-%m') AS label FROM bookings",
)
def fn_month_trunc(spark, path):
    day = "check_in_date"
    return load(spark, path, "reservation_id", day).select(
        "reservation_id", dates.month_start(day).alias("month"), dates.month_label(day).alias("label")
    )


@plan(
    "fn_days_in_month",
    " SELECT reservation_id, CAST(EXTRACT(DAY FROM LAST_DAY(check_in_date)) AS INT) AS days_in_month FROM bookings",
)
def fn_days_in_month(spark, path):
    rows = load(spark, path, "reservation_id", "check_in_date")
    return rows.select("reservation_id", dates.days_in_month("check_in_date").alias("days_in_month"))


@plan(
    "fn_date_diff",
    f""" SELECT reservation_id, CAST(DATE '{SNAPSHOT}' - check_in_date AS INT) AS days_since, check_in_date - lead_time_days AS booked_on,
 check_in_date + 3 AS plus_three FROM bookings""",
)
def fn_date_diff(spark, path):
    return load(spark, path, "reservation_id", "check_in_date", "lead_time_days").select(
        "reservation_id",
        dates.days_since(SNAPSHOT, "check_in_date").alias("days_since"),
        F.date_sub("check_in_date", F.col("lead_time_days")).alias("booked_on"),
        F.date_add("check_in_date", 3).alias("plus_three"),
    )


@plan(
    "fn_case_bucket",
    f""", c AS (SELECT reservation_id, lead_time_days, {LEAD_CUT} AS slot FROM bookings)
 SELECT reservation_id, {LEAD_CASE} AS closed_bucket, {lead_cut_name(labels.LEAD_NAMES_SHORT)} AS cut_bucket FROM c""",
)
def fn_case_bucket(spark, path):
    return load(spark, path, "reservation_id", "lead_time_days").select(
        "reservation_id",
        labels.lead_bucket_closed().alias("closed_bucket"),
        labels.lead_bucket_cut(names=labels.LEAD_NAMES_SHORT).alias("cut_bucket"),
    )


@plan(
    "fn_round",
    f""", s AS (SELECT primary_guest_name, SUM({cents('total_amount')}) AS t, COUNT(*) AS n, SUM(is_cancelled) AS x FROM bookings GROUP BY 1)
 SELECT primary_guest_name, {half_up('t', '(n * 100)', 2)} AS half_away, {half_even('t', '(n * 100)', 2)} AS half_even,
 CAST(t // 100 AS INT) AS truncated, CAST(x AS DOUBLE) / NULLIF(n - x, 0) AS odds FROM s""",
)
def fn_round(spark, path):
    rows = load(spark, path, "primary_guest_name", "total_amount", "is_cancelled")
    grouped = rows.groupBy("primary_guest_name").agg(
        F.sum(cents_of("total_amount")).alias("t"), F.count(F.lit(1)).alias("n"), F.sum("is_cancelled").alias("x")
    )
    kept = F.nullif(F.col("n") - F.col("x"), F.lit(0))
    return grouped.select(
        "primary_guest_name",
        ratio(F.col("t"), F.col("n") * 100, 2).alias("half_away"),
        ratio(F.col("t"), F.col("n") * 100, 2, half_even=True).alias("half_even"),
        (F.col("t") / 100).cast("int").alias("truncated"),
        (F.col("x").cast("double") / kept).alias("odds"),
    )


@plan(
    "fn_math",
    """ SELECT reservation_id, ROUND(LN(avg_price_per_room), 6) AS ln_price, ROUND(EXP(rate_premium_pct / 100), 6) AS exp_premium,
 POWER(lead_time_days, 2) AS lead_sq, ABS(rate_premium_pct) AS abs_premium, ROUND(SQRT(lead_time_days), 6) AS sqrt_lead,
 LEAST(GREATEST(rate_premium_pct, -5.0), 5.0) AS clipped, ROUND(1 / (1 + EXP(-(lead_time_days - 30) / 10.0)), 6) AS sigmoid FROM bookings""",
)
def fn_math(spark, path):
    lead, premium = F.col("lead_time_days"), F.col("rate_premium_pct")
    return load(spark, path, "reservation_id", "avg_price_per_room", "rate_premium_pct", "lead_time_days").select(
        "reservation_id",
        F.round(F.ln("avg_price_per_room"), 6).alias("ln_price"),
        F.round(F.exp(premium / 100), 6).alias("exp_premium"),
        F.pow(lead, 2).alias("lead_sq"),
        F.abs(premium).alias("abs_premium"),
        F.round(F.sqrt(lead), 6).alias("sqrt_lead"),
        F.least(F.greatest(premium, F.lit(-5.0)), F.lit(5.0)).alias("clipped"),
        F.round(1 / (1 + F.exp(-(lead - 30) / 10.0)), 6).alias("sigmoid"),
    )


@plan(
    "fn_bool_int",
    """ SELECT reservation_id, CAST(n_children > 0 AS INT) AS has_children, CAST(lead_time_days > 30 AS INT) AS high_lead,
 CAST(room_no IN (202,206,208,210,301,302,309) AS INT) AS is_hot_room FROM bookings""",
)
def fn_bool_int(spark, path):
    rows = load(spark, path, "reservation_id", "n_children", "lead_time_days", "room_no")
    return rows.select(
        "reservation_id",
        (F.col("n_children") > 0).cast("int").alias("has_children"),
        (F.col("lead_time_days") > 30).cast("int").alias("high_lead"),
        F.col("room_no").isin(*features.HOT_ROOMS).cast("int").alias("is_hot_room"),
    )


@plan(
    "fn_safe_ratio",
    """ SELECT reservation_id, CAST(previous_cancellations AS DOUBLE) / (previous_cancellations + previous_successful_bookings + 1) AS ratio FROM bookings""",
)
def fn_safe_ratio(spark, path):
    rows = load(spark, path, "reservation_id", "previous_cancellations", "previous_successful_bookings")
    return rows.select("reservation_id", features.history_ratio().alias("ratio"))


@plan(
    "fn_pax_parse",
    " SELECT reservation_id, pax AS built, n_adults AS adults, n_children AS children FROM bookings",
)
def fn_pax_parse(spark, path):
    rows = load(spark, path, "reservation_id", "n_adults", "n_children", "pax")
    return rows.select(
        "reservation_id",
        labels.pax_text().alias("built"),
        labels.pax_adults().alias("adults"),
        labels.pax_children().alias("children"),
    )


@plan(
    "fn_label_format",
    " SELECT c_custkey, 'Guest_' || LPAD(CAST(c_custkey AS VARCHAR), 6, '0') AS guest, 'R' || CAST(c_custkey + 100000 AS VARCHAR) AS reservation FROM customer",
)
def fn_label_format(spark, path):
    return spark.read.parquet(f"{path}/customer.parquet").select(
        "c_custkey",
        labels.guest_label(F.col("c_custkey")).alias("guest"),
        labels.reservation_label(F.col("c_custkey")).alias("reservation"),
    )


@plan(
    "fn_sig_stars",
    """, p AS (SELECT reservation_id, lead_time_days / 1000.0 AS p FROM bookings)
 SELECT reservation_id, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '—' END AS stars FROM p""",
)
def fn_sig_stars(spark, path):
    rows = load(spark, path, "reservation_id", "lead_time_days")
    return rows.select("reservation_id", labels.significance_stars(F.col("lead_time_days") / 1000.0).alias("stars"))


@plan(
    "fn_elastic_label",
    """ SELECT reservation_id, CASE WHEN ABS(rate_premium_pct / 20) < 0.3 THEN 'inelastic (demand insensitive to price)'
 ELSE 'elastic (demand falls when overpriced)' END AS label FROM bookings""",
)
def fn_elastic_label(spark, path):
    rows = load(spark, path, "reservation_id", "rate_premium_pct")
    return rows.select("reservation_id", labels.elasticity_label(F.col("rate_premium_pct") / 20).alias("label"))


@plan("fn_premium_pct", " SELECT reservation_id, rate_premium_pct AS premium FROM bookings")
def fn_premium_pct(spark, path):
    rows = load(spark, path, "reservation_id", "avg_price_per_room", "competitor_avg_rate")
    return rows.select("reservation_id", features.premium_pct().alias("premium"))
