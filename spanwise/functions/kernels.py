"""Distance, drive share and willingness kernels, as Column expressions.

All are undefined at a time of 0 or less and give 0 there; null in, null out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Log-log quadratic from travel time in seconds to miles, and its power-law variant.
MILES_C0, MILES_C1, MILES_C2 = -5.6726, 0.9591, 0.02319
MILES_POWER = (1.04e-3, 1.2955)
#: Plateau, scale in miles and shape of the drive share of each component.
DRIVE_SHARE = {
    "commute": (0.6940, 1.2867, 0.9888),
    "retail": (0.5492, 0.8706, 1.6052),
    "res": (0.6148, 0.7409, 1.3967),
    "school_primary": (0.8474, 0.9126, 2.1546),
    "school_postprimary": (0.4273, 0.9896, 2.3069),
    "school_tertiary": (0.3199, 1.6968, 1.9983),
}


def _d(x: float) -> Column:
    return F.lit(float(x))


def equivalent_miles(t: Column) -> Column:
    log = F.log(t)
    return F.when(t <= 0, _d(0)).otherwise(F.exp(_d(MILES_C0) + _d(MILES_C1) * log + _d(MILES_C2) * log * log))


def equivalent_miles_power(t: Column) -> Column:
    return F.when(t <= 0, _d(0)).otherwise(_d(MILES_POWER[0]) * F.pow(t, _d(MILES_POWER[1])))


def equivalent_miles_slope(t: Column) -> Column:
    """Miles for one more second."""
    return F.when(t <= 0, _d(0)).otherwise(equivalent_miles(t) * (_d(MILES_C1) + _d(2 * MILES_C2) * F.log(t)) / t)


def drive_share(miles: Column, component: str | Column) -> Column:
    """Saturating share of trips by car; ``component`` is a name, or a column of names."""
    if isinstance(component, str):
        p, d0, k = DRIVE_SHARE[component]
        return _d(p) * (_d(1) - F.exp(-F.pow(miles / _d(d0), _d(k))))
    out = F.lit(None).cast("double")
    for name in DRIVE_SHARE:
        out = F.when(component == name, drive_share(miles, name)).otherwise(out)
    return out


def willingness(t: Column, w: Column, tau_s: Column, tau_l: Column, component: str | Column) -> Column:
    """Drive share times a mix of a short and a long exponential; the long one is never the shorter."""
    mix = w * F.exp(-t / tau_s) + (_d(1) - w) * F.exp(-t / F.greatest(tau_l, tau_s))
    return F.when(t <= 0, _d(0)).otherwise(drive_share(equivalent_miles(t), component) * mix)


def clamped_willingness(t: Column, *args, floor_s: float = 30.0) -> Column:
    """``willingness`` with times below ``floor_s`` taken as that."""
    return willingness(F.greatest(t, _d(floor_s)), *args)


def tanner(t: Column, b: float, peak: float) -> Column:
    """``u**b * exp(b * (1 - u))`` for ``u = t / peak``; 0 at the origin, 1 at the peak."""
    u = t / _d(peak)
    return F.when(t <= 0, _d(0)).otherwise(F.pow(u, _d(b)) * F.exp(_d(b) * (_d(1) - u)))


def logit(p: Column, eps: float = 1e-9) -> Column:
    q = F.least(F.greatest(p, _d(eps)), _d(1 - eps))
    return F.log(q / (_d(1) - q))


def expit(x: Column) -> Column:
    return _d(1) / (_d(1) + F.exp(-x))


def probit_gain(sigma: Column, variation: Column, cost: Column) -> Column:
    """Weight of a random cost term: ``sigma / (sigma + variation * cost)``."""
    total = sigma + variation * cost
    return F.when(total > 0, sigma / total).otherwise(_d(0))


def turn_penalty(angle: Column, degree: Column, uturn: Column, penalty: float = 7.5, bias: float = 1.075, u_turn: float = 20.0) -> Column:
    """Seconds for a turn: a logistic in its angle, steeper to one side; 0 where no road joins and it is no u-turn."""
    b = 1.0 / bias
    right = _d(penalty) / (_d(1) + F.exp(-(_d(13.0 / b) * angle / _d(180) - _d(6.5 * b))))
    left = _d(penalty) / (_d(1) + F.exp(-(_d(13.0 * b) * -angle / _d(180) - _d(6.5 / b))))
    base = F.when(angle >= 0, right).otherwise(left) + F.when(uturn, _d(u_turn)).otherwise(_d(0))
    return F.when(angle.isNull() | ~((degree > 2) | uturn), _d(0)).otherwise(base)
