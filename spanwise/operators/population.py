"""Rates and levels of populations: shares by age, own-vehicle rates, levels blended over regions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import safe_ratio

#: An age code's own age, the codes of pupils of the two school levels, and the rate taken at one code.
AGE_OF_CODE = {4: 8, 5: 13, 6: 16, 7: 17, 8: 18, 9: 19, 10: 20, 11: 23, 12: 27}
PRIMARY_CODE, SECONDARY_CODE = 4, 5
SPLIT_CODES, ADULT_CODE = (6, 7, 8, 9), 10
FIRM_RATES = {8: 0.1085}


def academic_shares(students: DataFrame, age: str, provider: str, number: str, secondary: Sequence[str], tertiary: Sequence[str]) -> DataFrame:
    """(age, share): secondary students of those in secondary and tertiary education, by academic age; 0 where there are none."""
    s, t = (F.sum(F.when(F.col(provider).isin(*kinds), F.col(number)).otherwise(F.lit(0.0))) for kinds in (secondary, tertiary))
    return students.groupBy(F.col(age).alias("age")).agg(s.alias("_s"), t.alias("_t")).select("age", safe_ratio(F.col("_s"), F.col("_s") + F.col("_t")).alias("share"))


def secondary_share(age: Column, academic: Mapping[int, float]) -> Column:
    """Secondary share at an actual age: half the pupils are still of the academic age before; all up to 14."""
    table = F.create_map(*(F.lit(x) for k, v in academic.items() for x in (int(k), float(v))))
    at = lambda a: F.coalesce(F.try_element_at(table, a.cast("int")), F.lit(0.0))
    return F.when(age <= 14, F.lit(1.0)).otherwise(F.lit(0.5) * at(age - 1) + F.lit(0.5) * at(age))


def level_shares(code: Column, student: Column, academic: Mapping[int, float]) -> Column:
    """(primary, secondary, tertiary) by age code; from 16 on of full-time students only."""
    ages = F.create_map(*(F.lit(x) for k, v in AGE_OF_CODE.items() for x in (k, v)))
    s = secondary_share(F.try_element_at(ages, code.cast("int")), academic)
    of = lambda p, q, r: F.struct(F.lit(p).alias("primary") if not isinstance(p, Column) else p.alias("primary"), (q if isinstance(q, Column) else F.lit(q)).alias("secondary"), (r if isinstance(r, Column) else F.lit(r)).alias("tertiary"))
    return (
        F.when(code == PRIMARY_CODE, of(1.0, 0.0, 0.0))
        .when(code == SECONDARY_CODE, of(0.0, 1.0, 0.0))
        .when(student & code.isin(*SPLIT_CODES), of(0.0, s, F.lit(1.0) - s))
        .when(student & (code >= ADULT_CODE), of(0.0, 0.0, 1.0))
        .otherwise(of(0.0, 0.0, 0.0))
    )


def own_vehicle_rates(people: DataFrame, code: str, student: Column, weight: Column, trips: Column, firm: Mapping[int, float] = FIRM_RATES, days: float = 7.0) -> DataFrame:
    """(code, rate): weighted trips a day of an age code's pupils, or of its students from 16 on; a firm rate where one is given."""
    mine = (F.col(code) <= SECONDARY_CODE) | student
    g = people.groupBy(F.col(code).alias("code")).agg(F.sum(F.when(mine, weight)).alias("_w"), F.sum(F.when(mine, trips)).alias("_t"))
    out = safe_ratio(F.col("_t"), F.col("_w")) / F.lit(days)
    for k, v in firm.items():
        out = F.when((F.col("code") == k) & (F.col("_w") > 0), F.lit(float(v))).otherwise(out)
    return g.select("code", F.coalesce(out, F.lit(0.0)).alias("rate"))


def level_rates(people: DataFrame, rates: DataFrame, code: str, enrolled: Column, weight: Column, academic: Mapping[int, float]) -> DataFrame:
    """(level, rate): age codes' rates, averaged over their students' shares of each level."""
    of = F.col("code")
    students = people.groupBy(F.col(code).alias("code")).agg(F.sum(F.when((F.col(code) <= SECONDARY_CODE) | enrolled, weight).otherwise(F.lit(0.0))).alias("_n"))
    shares = level_shares(of, F.lit(True), academic)
    long = students.where(of >= PRIMARY_CODE).join(rates, "code").select("_n", "rate", F.explode(F.create_map(*(x for k in ("primary", "secondary", "tertiary") for x in (F.lit(k), shares[k])))).alias("level", "share"))
    w = F.col("_n") * F.col("share")
    return long.groupBy("level").agg(safe_ratio(F.sum(F.col("rate") * w), F.sum(w)).alias("rate"))


def expected_total(rates: DataFrame, population: DataFrame, keys: Sequence[str], rate: str = "rate", people: str = "people") -> DataFrame:
    """One row (total, people, level): rates times people summed over the keys that both have; people and level over the whole population."""
    total = population.join(rates.select(*keys, rate), list(keys)).agg(F.sum(F.col(rate) * F.col(people)).alias("total"))
    return total.crossJoin(population.agg(F.sum(people).alias("people"))).select("total", "people", safe_ratio(F.col("total"), F.col("people")).alias("level"))


def blended_level(regions: DataFrame, level: str, people: str, reference: Column) -> DataFrame:
    """One row (level, between, sigma, multiplier): the people's mean level of regions, its spread between them over it, that twice
    in squares (as much again within them), and the level over a reference."""
    w, x = F.col(people), F.col(level)
    m = regions.agg(F.sum(w).alias("_w"), F.sum(w * x).alias("_wx"), F.sum(w * x * x).alias("_wxx"))
    mean = F.col("_wx") / F.col("_w")
    between = F.sqrt(F.greatest(F.col("_wxx") / F.col("_w") - mean * mean, F.lit(0.0))) / mean
    return m.select(mean.alias("level"), between.alias("between"), F.hypot(between, between).alias("sigma"), (mean / reference).alias("multiplier"))
