"""Rule-based labels as ordered ``when`` chains, and text formats."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds (days) and names of the lead-time buckets.
LEAD_EDGES = (7, 14, 30, 60)
LEAD_NAMES = ("0-7 days", "8-14 days", "15-30 days", "31-60 days", "60+ days")
LEAD_NAMES_DASH = ("0–7 days", "8–14 days", "15–30 days", "31–60 days", "60+ days")
LEAD_NAMES_SHORT = ("0-7d", "8-14d", "15-30d", "31-60d", "60d+")
LEAD_CUT_TOP = 999

# Booking source -> market segment.
SEGMENT_OF_SOURCE = {
    "OTA": "Online Leisure",
    "Web": "Online Leisure",
    "Corporate": "Corporate",
    "Travel Agent": "Group / Agent",
    "Direct / Front Desk": "Direct",
}

# Guest tier -> recommended action.
ACTION_OF_TIER = {
    "VIP": "Personalised loyalty reward + early access to offers",
    "Loyal": "Targeted upsell (room upgrade, meal plan)",
    "At Risk": "Proactive win-back email within 30 days",
    "New": "Welcome sequence + incentive for second stay",
    "Lapsed": "Reactivation offer or remove from active CRM",
}


def lead_bucket_closed(lead: str = "lead_time_days") -> Column:
    """Buckets that include lead 0; everything else (also NULL) is the last one."""
    col = F.col(lead)
    expr, low = None, 0
    for edge, name in zip(LEAD_EDGES, LEAD_NAMES):
        inside = col.between(low, edge)
        expr = F.when(inside, name) if expr is None else expr.when(inside, name)
        low = edge + 1
    return expr.otherwise(LEAD_NAMES[-1])


def lead_bucket_cut(
    lead: str = "lead_time_days", names: tuple[str, ...] = LEAD_NAMES_DASH
) -> Column:
    """Half-open ``(lo, hi]`` buckets; NULL outside ``(0, 999]``."""
    return _cut(lead, names)


def lead_bucket_cut_index(lead: str = "lead_time_days") -> Column:
    return _cut(lead, range(len(LEAD_EDGES) + 1))


def _cut(lead, results) -> Column:
    col = F.col(lead)
    expr, low = None, 0
    for edge, result in zip((*LEAD_EDGES, LEAD_CUT_TOP), results):
        inside = (col > low) & (col <= edge)
        expr = F.when(inside, result) if expr is None else expr.when(inside, result)
        low = edge
    return expr


def lookup(key: Column, pairs: dict[str, str]) -> Column:
    """Small dictionary lookup as a literal map; NULL for an unknown key."""
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])
    return F.try_element_at(literal, key)


def significance_stars(p: str | Column) -> Column:
    col = F.col(p) if isinstance(p, str) else p
    return F.when(col < 0.001, "***").when(col < 0.01, "**").when(col < 0.05, "*").otherwise("—")


def elasticity_label(slope: Column) -> Column:
    return F.when(F.abs(slope) < 0.3, "inelastic (demand insensitive to price)").otherwise(
        "elastic (demand falls when overpriced)"
    )


def tier(r: str = "r", f: str = "f", score: str = "rfm_score") -> Column:
    rr, ff, total = F.col(r), F.col(f), F.col(score)
    return (
        F.when(total >= 13, "VIP")
        .when((rr >= 4) & (ff >= 3), "Loyal")
        .when((rr <= 2) & (ff >= 3), "At Risk")
        .when((ff == 1) & (rr >= 3), "New")
        .otherwise("Lapsed")
    )


def pax_text(adults: str = "n_adults", children: str = "n_children") -> Column:
    return F.format_string("%d(A) %d(C)", F.col(adults), F.col(children))


def pax_adults(pax: str = "pax") -> Column:
    return F.regexp_extract(pax, r"^(\d+)\(A\)", 1).try_cast("int")


def pax_children(pax: str = "pax") -> Column:
    return F.regexp_extract(pax, r"(\d+)\(C\)$", 1).try_cast("int")


def guest_label(number: Column) -> Column:
    return F.concat(F.lit("Guest_"), _zero_pad(number, 6))


def reservation_label(number: Column) -> Column:
    return F.concat(F.lit("R"), (number + 100000).cast("string"))


def _zero_pad(number: Column, width: int) -> Column:
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def odds_phrase(odds_ratio: Column) -> Column:
    """Plain reading of an odds ratio, derived from its value."""
    change = F.abs(F.round((odds_ratio - 1) * 100, 0)).cast("long").cast("string")
    return F.when(odds_ratio >= 1, F.concat(F.lit("odds up "), change, F.lit("%"))).otherwise(
        F.concat(F.lit("odds down "), change, F.lit("%"))
    )
