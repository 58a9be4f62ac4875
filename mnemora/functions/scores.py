"""Scoring formulas of the store: decay, tiers, salience, erosion, spacing and lift. "Now" is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ----
DECAY_RATE = {"enriched": 0.001, "fertile": 0.01, "natural": 0.05, "depleted": 0.10, "waste": 0.20}
TIER_FLOOR = {"hot": 0.75, "warm": 0.50, "cold": 0.25, "frozen": 0.0}
TIER_EROSION = {"hot": 0.25, "warm": 1.0, "cold": 2.5, "frozen": 0.25}
NEUTRAL, FRESH_DAYS, NEVER_DAYS = 0.5, 7, 9999
SALIENCE_DAMPING, CAPTURE_DAMPING, DAMPING_CAP, FREEZE_EXEMPT = 0.9, 0.5, 0.95, 0.85
EMA = 1 - (1 - 0.855) ** (1 / 3)  # three events reach 0.855
# ---- end of fixed values ----


def _c(c: str | Column | float) -> Column:
    return F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Between low and high; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def rounded(x, places: int = 4) -> Column:
    """Rounded half up in binary arithmetic, the same in any engine: floor(x * 10^places + 0.5) / 10^places."""
    return F.floor(_c(x) * float(10**places) + 0.5) / float(10**places)


def days_since(last: str | Column, today: str | Column) -> Column:
    """Whole days, never negative; 9999 without a date."""
    d = F.datediff(_c(today) if isinstance(today, Column) else F.lit(today).cast("date"), _c(last))
    return F.when(d.isNull(), F.lit(NEVER_DAYS)).otherwise(F.greatest(d, F.lit(0)))  # greatest() alone would skip the null


def tier_for(relevance: str | Column) -> Column:
    """hot, warm, cold or frozen."""
    r = _c(relevance)
    return F.when(r >= 0.75, "hot").when(r >= 0.5, "warm").when(r >= 0.25, "cold").otherwise("frozen")


def grade_rate(grade: str | Column) -> Column:
    """Decay rate of a grade; unknown and null count as natural."""
    g, out = _c(grade), F.lit(DECAY_RATE["natural"])
    for name, rate in DECAY_RATE.items():
        out = F.when(g == name, F.lit(rate)).otherwise(out)
    return out


def step_relevance(relevance, days, grade, salience=0.0, capture=0.0, touched=None) -> Column:
    """One decay step: towards 0.5 within a week of the last access, towards 0 after; damped by salience and capture."""
    r, d = F.coalesce(_c(relevance), F.lit(0.5)), _c(days)
    damping = F.least(F.lit(DAMPING_CAP), SALIENCE_DAMPING * clamp(F.coalesce(_c(salience), F.lit(0.0))) + CAPTURE_DAMPING * clamp(F.coalesce(_c(capture), F.lit(0.0))))
    target = F.when(d <= FRESH_DAYS, F.lit(NEUTRAL)).otherwise(F.lit(0.0))
    stepped = r + (target - r) * (grade_rate(grade) * (1 - damping))
    return stepped if touched is None else F.when(_c(touched), r).otherwise(stepped)


def half_life(days, half: float) -> Column:
    """0.5 ^ (days / half)."""
    return F.pow(F.lit(0.5), _c(days) / F.lit(half))


def attenuate(score, captured_at, now: float, half: float = 3.0) -> Column:
    """Capture score faded since captured_at (epoch seconds; 0, null or less: not faded), between 0 and 1."""
    s, at = F.coalesce(_c(score), F.lit(0.0)), F.coalesce(_c(captured_at), F.lit(0.0))
    faded = s * half_life(F.greatest(F.lit(0.0), (F.lit(now) - at) / 86400.0), half)
    return F.when(s <= 0, F.lit(0.0)).when(at <= 0, clamp(s)).otherwise(clamp(faded))


def erosion_rate(days, tier, salience=0.0, semantic=None) -> Column:
    """Share of intact characters lost in one pass."""
    factor = F.lit(TIER_EROSION["warm"])
    for name, f in TIER_EROSION.items():
        factor = F.when(F.lower(_c(tier)) == name, F.lit(f)).otherwise(factor)
    if semantic is not None:
        factor = F.when(_c(semantic), F.lit(0.25)).otherwise(factor)
    recency = 1 + F.least(F.lit(3.0), F.greatest(F.lit(0), _c(days)) * 0.02)
    return F.greatest(F.lit(0.0), 0.02 * factor * recency * (1 - 0.9 * clamp(F.coalesce(_c(salience), F.lit(0.0)))))


def restore_integrity(old, strength: float) -> Column:
    """Moved towards 1 by a share of what is missing."""
    return clamp(_c(old) + (1 - _c(old)) * strength)


def composite_salience(surprise, contradiction, access, tagged=None, recalls=0, familiarity: float = 0.45) -> Column:
    """Weighted surprise (fading with recalls), contradiction and access; an explicit tag gives 0.95."""
    value = clamp(0.5 * _c(surprise) * F.pow(F.lit(familiarity), F.greatest(F.lit(0), _c(recalls))) + 0.3 * _c(contradiction) + 0.2 * F.least(F.lit(1.0), _c(access) / 5))
    return value if tagged is None else F.when(_c(tagged), F.lit(0.95)).otherwise(value)


def gap_strength(seconds) -> Column:
    """Deposit of a gap: 1 from a day on, else 1 - exp(-gap / 8 h)."""
    g = _c(seconds)
    return F.when(g >= 86400, F.lit(1.0)).when(g <= 0, F.lit(0.0)).otherwise(1 - F.exp(-g / 28800.0))


def count_saturation(n) -> Column:
    """1 - exp(-n / 1.2)."""
    return F.when(_c(n) <= 0, F.lit(0.0)).otherwise(1 - F.exp(-_c(n) / 1.2))


def selectivity(degree_a, degree_b) -> Column:
    """Penalty of well-connected ends, 0.27 at least."""
    return F.greatest(F.lit(0.27), 1 / (1 + 0.59 * F.log(1 + _c(degree_a) * _c(degree_b))))


def lift(pair, a, b, total) -> Column:
    """pair * total / (a * b); 0 where a count is missing."""
    ok = (_c(a) > 0) & (_c(b) > 0) & (_c(total) > 0)
    return F.when(ok, _c(pair).cast("double") * _c(total) / (_c(a).cast("double") * _c(b))).otherwise(F.lit(0.0))


def floor_ok(a, b, pair, total) -> Column:
    """Enough support and lift for a credit inside one day."""
    return (_c(a) >= 3) & (_c(b) >= 3) & (_c(pair) >= 2) & (lift(pair, a, b, total) >= 2)


def breadth(distance, sittings) -> Column:
    """Credit of a varied neighbourhood; needs three sittings."""
    d, n = _c(distance), _c(sittings)
    return F.when((n < 3) | (d <= 0), F.lit(0.0)).otherwise(clamp(d) * clamp(1 - F.exp(-(n - 2) / 3.0)))


def depth(lift_value, surprising, reengagement) -> Column:
    """Credit of a lifted, surprising and re-engaged pair."""
    return clamp((_c(lift_value) - 2) / 4.0) * F.when(_c(surprising), 1.0).otherwise(0.0) * clamp(_c(reengagement))


def day_credit(a, b) -> Column:
    """Half of each surface, 0.6 at most."""
    return F.least(F.lit(0.6), 0.5 * F.greatest(F.lit(0.0), _c(a)) + 0.5 * F.greatest(F.lit(0.0), _c(b)))


def ema_weight(n) -> Column:
    """Weight after n genuine events from zero."""
    return 1 - F.pow(F.lit(1 - EMA), _c(n))


def promotable(weight, genuine) -> Column:
    """Strong enough and genuinely repeated."""
    return (_c(weight) >= 0.85) & (_c(genuine) >= 3)


def promotion_tier(weight, strength) -> Column:
    """strong, weak or none."""
    return F.when(_c(weight) < 0.85, "none").when(_c(strength) >= 3, "strong").when(_c(strength) >= 1.5, "weak").otherwise("none")


def edge_decay(weight, days) -> Column:
    """Linear decay, half a percent a day."""
    return _c(weight) * F.greatest(F.lit(0.0), 1 - 0.005 * _c(days))


def review_quality(relevance, tier) -> Column:
    """Grade of a recall from relevance, or from the tier where relevance is missing."""
    t = F.lower(F.trim(F.coalesce(_c(tier), F.lit("warm"))))
    r = F.coalesce(_c(relevance), F.when(t == "hot", 0.8).when(t == "cold", 0.4).when(t == "frozen", 0.1).otherwise(0.6))
    return F.when(r >= 0.75, 5).when(r >= 0.5, 4).when(r >= 0.25, 3).otherwise(1)


def review_step(easiness, interval, count, quality) -> Column:
    """Next spaced-repetition state: struct of easiness_factor, review_interval_days, review_count."""
    ef, iv, n, q = F.coalesce(_c(easiness), F.lit(2.5)), F.coalesce(_c(interval), F.lit(1)), F.coalesce(_c(count), F.lit(0)), _c(quality)
    lapse = q < 3
    grown = F.when(n + 1 == 1, F.lit(1)).when(n + 1 == 2, F.lit(6)).otherwise(F.greatest(F.lit(1), F.rint(iv * ef).cast("bigint")))
    easier = F.greatest(F.lit(1.3), ef + (0.1 - (5 - q) * (0.08 + (5 - q) * 0.02)))
    return F.struct(
        rounded(F.when(lapse, ef).otherwise(easier), 3).alias("easiness_factor"),
        F.when(lapse, F.lit(1)).otherwise(grown).cast("bigint").alias("review_interval_days"),
        F.when(lapse, F.lit(0)).otherwise(n + 1).cast("bigint").alias("review_count"),
    )


def min_max(x: str | Column, window) -> Column:
    """Scaled to 0..1 over a window; 0 where the span is 0."""
    v = _c(x)
    low, high = F.min(v).over(window), F.max(v).over(window)
    return F.when(high > low, (v - low) / (high - low)).otherwise(F.lit(0.0))
