"""Binning, geodesy, time slots, keys, sentinels and text, as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: Strings that stand for a missing value.
MISSING = ("NA", "")
DAY_NAMES = ("Week", "Sat", "Sun")


def safe_ratio(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    """``a / b``, or ``otherwise`` where ``b`` is 0 or null."""
    return F.when(b != 0, a / b).otherwise(F.lit(otherwise).cast("double"))


# --- bins -----------------------------------------------------------------------


def bin_left_closed(x: Column, edges: Sequence[float]) -> Column:
    """Number of the bin ``[edge, next edge)``, from 0; null outside all of them."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        out = F.when((x >= float(edges[i])) & (x < float(edges[i + 1])), F.lit(i)).otherwise(out)
    return out


def bin_last_closed(x: Column, edges: Sequence[float]) -> Column:
    """``bin_left_closed``, but the last bin also holds its upper edge."""
    return F.when(x == float(edges[-1]), F.lit(len(edges) - 2)).otherwise(bin_left_closed(x, edges))


def band_label(x: Column, bands: Sequence[tuple[str, float, float]]) -> Column:
    """Label of the first band ``low <= x < high``; null if none."""
    out = F.lit(None).cast("string")
    for name, low, high in reversed(bands):
        out = F.when((x >= float(low)) & (x < float(high)), F.lit(name)).otherwise(out)
    return out


def geometric_midpoint(low: Column, high: Column) -> Column:
    return F.sqrt(low * high)


# --- sphere ----------------------------------------------------------------------


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from 0 to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))), F.lit(360.0))


def heading_change(before: Column, after: Column) -> Column:
    """Signed turn from -180 to 180."""
    return F.pmod(after - before + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


# --- time ------------------------------------------------------------------------


def day_type(ts: Column) -> Column:
    """0 on weekdays, 1 on Saturday, 2 on Sunday."""
    return F.greatest(F.weekday(ts) - 4, F.lit(0))


def slot_label(day: Column, hour: Column) -> Column:
    """``Week 1400``; empty if either is null."""
    name = F.lit("?")
    for i, n in enumerate(DAY_NAMES):
        name = F.when(day == i, F.lit(n)).otherwise(name)
    return F.when(day.isNull() | hour.isNull(), F.lit("")).otherwise(F.format_string("%s %02d00", name, hour.cast("int")))


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(1e6)


def duration_seconds(text: Column) -> Column:
    """``1234s`` as a number; null if it is none."""
    return F.regexp_replace(text, "s$", "").try_cast("double")


def hour_of_clock(text: Column) -> Column:
    """The hour of ``HH:MM``."""
    return F.element_at(F.split(text, ":"), 1).try_cast("int")


# --- counts ----------------------------------------------------------------------


def jeffreys_sigma(n: Column) -> Column:
    """Uncertainty of a Poisson count, to three decimals."""
    return F.round(F.sqrt(n + F.lit(0.5)), 3)


def daily_from_count(n: Column, seconds: Column, fraction: Column) -> Column:
    """Daily total from a count over ``seconds`` in an hour that holds ``fraction`` of the day."""
    return (n + F.lit(0.5)) * safe_ratio(F.lit(3600.0), seconds * fraction, None)


def daily_sigma(n: Column, seconds: Column, fraction: Column, fraction_sigma: Column) -> Column:
    k = safe_ratio(F.lit(3600.0), seconds * fraction, None)
    rel = safe_ratio((n + F.lit(0.5)) * fraction_sigma, fraction, None)
    return k * F.sqrt(F.pow(jeffreys_sigma(n), F.lit(2.0)) + rel * rel)


def poisson_deviance(predicted: Column, n_effective: Column) -> Column:
    """Twice the log-likelihood ratio; ``n = n_effective - 0.5``, the prediction at least 1e-30."""
    n, p = n_effective - F.lit(0.5), F.greatest(predicted, F.lit(1e-30))
    return F.when(n <= 0, F.lit(2.0) * p).otherwise(F.lit(2.0) * (p - n + n * F.log(n / p)))


def pearson_z(predicted: Column, n_effective: Column) -> Column:
    return safe_ratio(predicted - n_effective, F.sqrt(n_effective), None)


def gaussian_z(predicted: Column, observed: Column, sigma: Column) -> Column:
    return safe_ratio(predicted - observed, sigma, None)


# --- sentinels, keys and text ------------------------------------------------------


def is_missing(c: Column, sentinels: Sequence[str] = MISSING) -> Column:
    """Null, or a string that stands for it."""
    return c.isNull() | F.trim(c.cast("string")).isin(*sentinels)


def clean(c: Column, sentinels: Sequence[str] = MISSING) -> Column:
    return F.when(is_missing(c, sentinels), F.lit(None)).otherwise(c)


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws(",", a.cast("string"), b.cast("string"))


def parse_pair_key(key: Column) -> Column:
    parts = F.split(key, ",")
    return F.struct(F.element_at(parts, 1).try_cast("long").alias("u"), F.element_at(parts, 2).try_cast("long").alias("v"))


def bare_name(name: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def _latin() -> tuple[str, str, dict[str, str]]:
    """By Unicode's compatibility decomposition: characters with one ASCII character, that character, and those with several."""
    one, several = {}, {}
    for code in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), *range(0xFB00, 0xFB07)):
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one[chr(code)] = plain
        elif plain:
            several[chr(code)] = plain
    return "".join(one), "".join(one.values()), several


def plain_text(c: Column) -> Column:
    """A text without accents: Latin characters as their ASCII ones; characters that have none are left out."""
    one, to, several = _latin()
    out = F.translate(c, one, to)
    spread = out
    for x, y in several.items():
        spread = F.replace(spread, F.lit(x), F.lit(y))
    out = F.when(out.rlike("[" + "".join(several) + "]"), spread).otherwise(out)
    return F.regexp_replace(out, "[^\\x00-\\x7F]", "")


def name_words(name: Column, generic: Sequence[str] = ()) -> Column:
    """Words of a name up to its first comma, in order, without accents, apostrophes and generic words; ``&`` is ``and``, ``saint`` is ``st``."""
    first = F.lower(F.element_at(F.split(plain_text(name), ","), 1))
    spaced = F.regexp_replace(F.replace(F.replace(first, F.lit("&"), F.lit(" and ")), F.lit("'"), F.lit("")), "[^a-z0-9]", " ")
    kept = F.filter(F.split(spaced, " +"), lambda w: ~w.isin("", *generic))
    return F.transform(kept, lambda w: F.when(w == "saint", F.lit("st")).otherwise(w))


def normal_name(name: Column, generic: Sequence[str] = ()) -> Column:
    """``name_words`` joined by blanks."""
    return F.array_join(name_words(name, generic), " ")


def name_tokens(name: Column, generic: Sequence[str] = ()) -> Column:
    """Distinct words of a name."""
    return F.array_distinct(name_words(name, generic))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays' distinct elements; 0 if both are empty."""
    return safe_ratio(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def parse_weights(text: Column) -> Column:
    """``A=1,B=0.5`` as a map of doubles."""
    return F.transform_values(F.str_to_map(text, F.lit(","), F.lit("=")), lambda k, v: v.try_cast("double"))


def slot_hash(*keys: Column, seed: int = 0) -> Column:
    """A number from 0 to 1 that depends on the keys and the seed alone, not on partitions."""
    text = F.concat_ws("|", *(k.cast("string") for k in keys), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def content_signature(*columns: Column) -> Column:
    """SHA-1 of a row; null and empty differ."""
    return F.sha1(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns)))


# --- curves ----------------------------------------------------------------------


def interpolate_loglog(x: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Log-log interpolation between given points, constant beyond the ends."""
    out = F.lit(float(ys[-1]))
    for i in range(len(xs) - 2, -1, -1):
        a, b, p, q = (F.log(F.lit(float(v))) for v in (xs[i], xs[i + 1], ys[i], ys[i + 1]))
        out = F.when(x < float(xs[i + 1]), F.exp(p + (q - p) * (F.log(x) - a) / (b - a))).otherwise(out)
    return F.when(x <= float(xs[0]), F.lit(float(ys[0]))).otherwise(out)


def tilted(rate: Column, place: Column, theta: Column) -> Column:
    """A rate tilted geometrically along a place; normalise afterwards to keep the total."""
    return rate * F.exp(theta * place)
