"""Column functions that name the role of a band, a connector or a piece of evidence. A missing property counts as an empty text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bands of the network, the one all turnouts meet, beginnings of names of bands under review, and statuses.
TRACK_BANDS = ("mainline_2_track", "parallel_minus_5m", "parallel_plus_5m")
MAIN_BAND = "mainline_2_track"
REVIEWED = ("possible_", "diagnostic_", "candidate_")
REVIEWED_ROLE = "diagnostic_candidate"
LOW_SUPPORT = "self_review_pass_low_support"
# What evidence of a role is set back by, in metres.
SUPPORT_PENALTY, PAIR_PENALTY, MAIN_PENALTY, OTHER_PENALTY = 0.05, 0.0, 0.35, 0.2
# Fixed value: the coverage below which a branch is refined.
LEAST_COVERAGE = 0.35


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def band_use(band: Column, role: Column, kept: tuple[str, ...] = TRACK_BANDS) -> Column:
    """'track' for a band of the network, 'diagnostic' for one under review by its name or role, else null."""
    reviewed = F.lit(False)
    for beginning in REVIEWED:
        reviewed = reviewed | text(band).startswith(beginning)
    return F.when(text(band).isin(*kept), "track").when(reviewed | (text(role) == REVIEWED_ROLE), "diagnostic")


def supported(status: Column) -> Column:
    """Whether a turnout's review found more than low support."""
    return text(status) != LOW_SUPPORT


def connector_kind(start: Column, end: Column) -> Column:
    """A connector that touches the main band at either end is a turnout, any other a crossover."""
    return F.when((text(start) == MAIN_BAND) | (text(end) == MAIN_BAND), "turnout").otherwise("crossover")


def is_crossover(role: Column, name: Column, shape: Column, pair: Column) -> Column:
    """Whether a feature is a connector between tracks, by its name, its shape's model or the pair it belongs to."""
    signs = F.upper(text(name)).startswith("CX") | text(shape).contains("crossover") | (text(pair) == "minus_to_main")
    return (text(role) == "turnout_connector") & signs


def priority_label(priority: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("low", "medium", "high"))), F.least(F.greatest(priority.cast("int"), F.lit(1)), F.lit(3)))


def needs_refinement(status: Column, support: Column, transition: Column) -> Column:
    """Low support by name or by either coverage; an unknown coverage is whole."""
    return text(status).contains("low_support") | (F.least(F.coalesce(support, F.lit(1.0)), F.coalesce(transition, F.lit(1.0))) < LEAST_COVERAGE)


def evidence_penalty(role: Column, source: Column, seq: Column) -> Column:
    """What a piece of evidence is set back by: support first, then pairs of rails, then the main line."""
    pair = text(source).contains("gauge_pair") | text(seq).endswith("GP01") | text(seq).endswith("GP02")
    support = (text(role) == "support") | text(source).contains("support_chain")
    return F.when(support, SUPPORT_PENALTY).when(pair, PAIR_PENALTY).when(text(role) == "mainline", MAIN_PENALTY).otherwise(OTHER_PENALTY)


def direction(slope: Column, low: Column, high: Column) -> Column:
    """Which band a transition leads from and to, by the sign of its slope."""
    return F.when(slope >= 0, F.concat_ws("->", low, high)).otherwise(F.concat_ws("->", high, low))


def proposal_note(start_mode: Column, end_mode: Column, start_whole: Column, end_whole: Column) -> Column:
    anchored = (text(start_mode) == "switch_anchor_hermite") | (text(end_mode) == "switch_anchor_hermite")
    whole = F.coalesce(start_whole, F.lit(False)) & F.coalesce(end_whole, F.lit(False))
    return F.when(anchored, "raw_evidence_plus_switch_anchor_completion").when(whole, "raw_evidence_observed_to_band").otherwise("partial_raw_evidence_no_forced_smoothstep")
