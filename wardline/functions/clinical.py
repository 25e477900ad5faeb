"""Clinical rules as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions import fixed


def _words(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _ladder(value: Column, steps: list[tuple[float, int]]) -> Column:
    """Points of the first step that `value` reaches, else 0."""
    out = F.lit(0)
    for least, points in reversed(steps):
        out = F.when(value >= least, points).otherwise(out)
    return out


def age_in_years(birth: Column, on: Column) -> Column:
    """Completed years, at least 0; a 29 February counts by month and day."""
    early = (F.month(on) < F.month(birth)) | ((F.month(on) == F.month(birth)) & (F.dayofmonth(on) < F.dayofmonth(birth)))
    return F.greatest(F.lit(0), F.year(on) - F.year(birth) - early.cast("int"))


def age_group(age: Column) -> Column:
    return F.when(age < 18, "pediatric").when(age < 40, "young_adult").when(age < 65, "middle_aged").when(age < 80, "elderly").otherwise("very_elderly")


def stay_days(start: Column, end: Column) -> Column:
    """Days between two timestamps, at least 0; 0 where one is missing."""
    seconds = F.timestamp_diff("SECOND", start, end)
    return F.coalesce(F.greatest(F.lit(0.0), seconds / 86400.0), F.lit(0.0))


def plain_text(text: Column) -> Column:
    """Lower case, letters, digits and single spaces only; empty for null."""
    kept = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-zA-Z0-9\s]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def icd9_category(code: Column) -> Column:
    """Category by three characters, then by two, else OTHER."""
    clean = F.upper(F.trim(code))
    three, two = F.substring(clean, 1, 3), F.substring(clean, 1, 2)
    table = lambda values: F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(table(fixed.ICD9_CATEGORY), three), F.try_element_at(table(fixed.ICD9_PREFIX), two), F.lit("OTHER"))


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def condition_categories(text: Column) -> Column:
    """All categories whose keywords or phrases the text holds, sorted; [OTHER] if none."""
    named: dict[str, list[str]] = {k: list(v) for k, v in fixed.KEYWORDS.items()}
    for phrase, name in fixed.PHRASES.items():
        named[name].append(phrase)

    def found(plain: Column) -> Column:
        return F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [plain.contains(w) for w in dict.fromkeys(ws)]), F.lit(n)) for n, ws in sorted(named.items())]))

    return let(let(plain_text(text), found), lambda hits: F.when(F.size(hits) > 0, hits).otherwise(_words(["OTHER"])))


def specific_categories(categories: Column) -> Column:
    """Distinct and sorted, without OTHER if there is any other."""
    rest = F.array_except(categories, _words(["OTHER"]))
    return F.array_sort(F.when(F.size(rest) > 0, rest).otherwise(F.array_distinct(categories)))


def comorbidity_score(dx: Column) -> Column:
    return F.least(F.size(dx) + F.size(F.filter(dx, lambda d: d.isin(fixed.SEVERE))), F.lit(10))


def risk_level(age: Column, dx: Column, score: Column) -> Column:
    severe = F.size(F.filter(dx, lambda d: d.isin(fixed.SEVERE)))
    points = F.aggregate(dx, F.lit(0), lambda a, d: a + F.when(d.isin(fixed.SEVERE), 3).when(d.isin(fixed.MODERATE), 2).otherwise(1))
    young = F.when((age < 40) & (severe >= 2), 2).when((age < 40) & (severe >= 1) & (F.size(dx) >= 3), 1).otherwise(0)
    total = _ladder(age, [(80, 3), (65, 2), (50, 1)]) + points + young + _ladder(score, [(7, 3), (5, 2), (3, 1)])
    return F.when(total >= 10, "critical").when(total >= 7, "high").when(total >= 4, "medium").otherwise("low")


def utilization_category(hospital_los: Column, icu_los: Column, procedures: Column, medications: Column) -> Column:
    total = (
        _ladder(hospital_los, [(14, 3), (7, 2), (3, 1)]) + _ladder(icu_los, [(7, 3), (3, 2), (1, 1)])
        + _ladder(procedures, [(10, 2), (5, 1)]) + _ladder(medications, [(15, 2), (8, 1)])
    )
    return F.when(total >= 8, "high").when(total >= 4, "medium").otherwise("low")


def high_complexity(dx: Column, score: Column, icu_los: Column) -> Column:
    return ((F.size(dx) >= 3) | (score >= 5) | (icu_los >= 7)).cast("int")


def keyed_uniform(*keys: Column | str) -> Column:
    """A number in [0, 1) from the md5 of the keys; the same on any partitioning, and in other SQL engines."""
    text = F.concat_ws(":", *[k.cast("string") if isinstance(k, Column) else F.lit(k) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / 4294967296.0


def parse_age(text: Column) -> Column:
    """Whole years of '6 months', '80 years' or '3 weeks'; null without a number."""
    n = F.regexp_extract(text, r"(\d+)", 1).try_cast("int")
    unit = F.lower(text)
    return F.when(unit.contains("month"), F.floor(n / 12)).when(unit.contains("week"), F.floor(n / 52)).when(unit.contains("day"), F.floor(n / 365)).otherwise(n).cast("int")


def parse_date(text: Column) -> Column:
    """The first of three formats that parses: month day, year; month year; ISO."""
    return F.coalesce(F.try_to_date(text, "MMMM d, yyyy"), F.try_to_date(text, "MMMM yyyy"), F.try_to_date(text, "yyyy-MM-dd"))


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def json_list(text: Column) -> Column:
    """array<string> of a JSON list; an empty array for null, empty and unreadable text."""
    return F.coalesce(F.from_json(text, "array<string>", {"mode": "PERMISSIVE"}), F.array().cast("array<string>"))
