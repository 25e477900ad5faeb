"""Cohort descriptions: free text to a cohort, and a cohort to a predicate that Spark can push down.

Words are matched whole, and an explicit age range goes before a named one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import fixed


@dataclass(frozen=True)
class Cohort:
    diagnoses: tuple[str, ...] = ()
    every: bool = False
    age: tuple[int, int] | None = None
    gender: str | None = None
    icu: bool | None = None
    mortality: bool | None = None
    risk: str | None = None
    complexity: str | None = None
    emergency: bool | None = None
    size: int | None = None


def predicate(c: Cohort) -> Column:
    """The rows of the patient table that belong to the cohort."""
    tests = []
    if c.diagnoses:
        wanted = F.array(*[F.lit(d) for d in c.diagnoses])
        tests.append(F.size(F.array_intersect("diagnoses", wanted)) == len(c.diagnoses) if c.every else F.arrays_overlap("diagnoses", wanted))
    if c.age:
        tests.append(F.col("age").between(*c.age))
    if c.gender:
        tests.append(F.col("gender") == c.gender[0])
    for name, value in (("has_icu_stay", c.icu), ("mortality", c.mortality), ("emergency_admission", c.emergency)):
        if value is not None:
            tests.append(F.col(name) == int(value))
    if c.risk:
        tests.append(F.col("risk_level") == c.risk)
    if c.complexity:
        tests.append(F.col("high_complexity") == int(c.complexity == "high"))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _word(text: Column, *words: str) -> Column:
    return text.rlike(rf"\b(?:{'|'.join(words)})\b")


def parsed(text: Column) -> Column:
    """A struct with the fields of a cohort from a column of descriptions; what is not said is null."""
    t = F.lower(text)
    dx = F.array_compact(F.array(*[F.when(_word(t, *ws), n) for n, ws in fixed.COHORT_WORDS.items()]))
    joined = t.rlike(" and | with | plus | alongside | combined with | having both ") & ~t.rlike(" or | either | any of | one of ")
    every = (F.size(dx) > 1) & (joined | (t.contains(" and ") & (F.size(dx) == 2)))
    span = r"(?:aged?|age)\s*(\d+)\s*-\s*(\d+)"

    def bound(group: int, old: int, young: int, child: int) -> Column:
        said = F.regexp_extract(t, span, group)
        return F.when(said != "", said.try_cast("int")).when(_word(t, "elderly", "old", "geriatric"), old).when(_word(t, "young", "adult", "adults"), young).when(_word(t, "pediatric", "child", "children"), child)

    empty = F.lit(None).cast("string")
    size = F.coalesce(
        F.nullif(F.regexp_extract(t, r"(\d+)\s*(?:patients?|records?|cases?|samples?)", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"(?:generate|create)\s*(\d+)", 1), F.lit("")), empty)
    return F.struct(
        dx.alias("diagnoses"), every.alias("every"), bound(1, 65, 18, 0).alias("age_low"), bound(2, 100, 65, 18).alias("age_high"),
        F.when(_word(t, "female", "women"), "f").when(_word(t, "male", "men"), "m").alias("gender"),
        F.when(_word(t, "icu", "critical") | t.contains("intensive care"), True).alias("icu"),
        F.when(_word(t, "mortality", "death", "died"), True).when(_word(t, "survived", "survivors?"), False).alias("mortality"),
        F.when(t.rlike("high[ -]risk") | _word(t, "severe"), "high").when(t.rlike("low[ -]risk") | _word(t, "mild"), "low").alias("risk"),
        F.when(_word(t, "complex", "multiple", "comorbid"), "high").alias("complexity"), size.try_cast("int").alias("size"),
    )


def parse(spark, text: str) -> Cohort:
    """The cohort that one description asks for."""
    r = spark.range(1).select(parsed(F.lit(text)).alias("p")).first().p
    age = (r.age_low, r.age_high) if r.age_low is not None else None
    return Cohort(tuple(r.diagnoses), r.every, age, r.gender, r.icu, r.mortality, r.risk, r.complexity, None, r.size)


def icd10(condition: Column) -> Column:
    out = F.array().cast("array<string>")
    for name, codes in fixed.ICD10.items():
        out = F.when(condition == name, F.array(*[F.lit(c) for c in sorted(codes)])).otherwise(out)
    return out


def parse_confidence(p: Column) -> Column:
    """How much of a parsed description was understood: .5, up to .2 for diagnoses, .1 for age and .05 for gender, at most 1."""
    said = F.least(0.1 * F.size(p["diagnoses"]), F.lit(0.2)) + F.when(p["age_low"].isNotNull(), 0.1).otherwise(0) + F.when(p["gender"].isNotNull(), 0.05).otherwise(0)
    return F.least(0.5 + said, F.lit(1.0))


def normalised(text: Column) -> Column:
    """Lower-case text in which other words for a condition are its first one."""
    out = F.lower(text)
    for words in fixed.COHORT_WORDS.values():
        out = F.regexp_replace(out, rf"\b(?:{'|'.join(words[1:])})\b", words[0])
    return out


def checked(c: Cohort) -> Cohort:
    """The cohort with unknown conditions and levels left out, ages within 0 to 120 and in order, size within 1 to 10000."""
    age = tuple(sorted(min(max(a, 0), 120) for a in c.age)) if c.age else None
    return Cohort(
        tuple(d for d in c.diagnoses if d in fixed.COHORT_WORDS), c.every, age, c.gender[0] if c.gender and c.gender[0] in "fm" else None, c.icu, c.mortality,
        c.risk if c.risk in ("low", "medium", "high", "critical") else None, c.complexity if c.complexity in ("low", "high") else None, c.emergency, min(max(c.size, 1), 10_000) if c.size else None)


def enhanced(text: Column) -> Column:
    """A struct of what a request says in the full vocabulary: conditions, ages, gender, setting, concepts, expansions, ICD-10 codes, confidence.

    A condition's first word found counts .9, or .7 if it has at most three letters. Ages in figures go
    before named groups; words are matched whole.
    """
    t = F.lower(text)
    # One search for all words of a condition first: few requests name it, and only they are searched for each.
    first = lambda words: F.when(_word(t, *words), F.coalesce(*[F.when(_word(t, w), 0.9 if len(w) > 3 else 0.7) for w in words]))
    entities = F.filter(F.array(*[F.struct(F.lit(n).alias("condition"), first(words).alias("confidence")) for n, (words, _, _) in fixed.MEDICAL_TERMS.items()]), lambda e: e["confidence"].isNotNull())

    def of(which: int, most: int):
        def pick(c: Column) -> Column:
            out = F.array().cast("array<string>")
            for n, info in fixed.MEDICAL_TERMS.items():
                out = F.when(c == n, F.array(*[F.lit(x) for x in info[which][:most]])).otherwise(out)
            return out
        return pick

    number = lambda pattern, g=1: F.regexp_extract(t, pattern, g).try_cast("int")
    forms = [
        (r"(\d+)\s*[-–to]+\s*(\d+)", lambda p: (number(p), number(p, 2))), (r"(?:over|above|older than|>)\s*(\d+)", lambda p: (number(p), F.lit(100))),
        (r"(?:under|below|younger than|<)\s*(\d+)", lambda p: (F.lit(0), number(p))), (r"age[sd]?\s*(\d+)", lambda p: (number(p) - 5, number(p) + 5)),
        (r"(\d+)\s*(?:year|yr)s?\s*old", lambda p: (number(p) - 2, number(p) + 2)),
    ]
    said = [F.when(t.rlike(p), F.struct(*[F.least(F.greatest(b, F.lit(0)), F.lit(120)).alias(n) for n, b in zip(("low", "high"), bounds(p), strict=True)])) for p, bounds in forms]
    groups = [F.when(_word(t, *words), F.struct(F.lit(low).alias("low"), F.lit(high).alias("high"))) for low, high, words in fixed.AGE_TERMS]
    setting = F.coalesce(*[F.when(_word(t, *words), n) for n, words in fixed.SETTINGS.items()])
    gender = F.when(_word(t, "male", "men", "man", "boy", "gentleman"), "male").when(_word(t, "female", "women", "woman", "girl", "lady"), "female")
    found = F.struct(entities.alias("e"), F.coalesce(*said, *groups).alias("age"), gender.alias("gender"), setting.alias("setting"))

    def shaped(f: Column) -> Column:
        e, names = f["e"], F.transform(f["e"], lambda x: x["condition"])
        mean = F.try_divide(F.aggregate(e, F.lit(0.0), lambda a, x: a + x["confidence"]), F.size(e))
        confidence = 0.5 + F.least(0.1 * F.size(e), F.lit(0.2)) + F.when(f["age"].isNotNull(), 0.1).otherwise(0.0) + F.when(f["gender"].isNotNull(), 0.05).otherwise(0.0) + F.when(f["setting"].isNotNull(), 0.1).otherwise(0.0) + F.coalesce(mean * 0.1, F.lit(0.0))
        return F.struct(
            names.alias("conditions"), e.alias("entities"), f["age"]["low"].alias("age_low"), f["age"]["high"].alias("age_high"), f["gender"].alias("gender"), f["setting"].alias("setting"),
            F.slice(F.flatten(F.transform(names, of(2, 99))), 1, 10).alias("concepts"), F.slice(F.flatten(F.transform(names, of(1, 3))), 1, 10).alias("expansions"), F.least(confidence, F.lit(1.0)).alias("confidence"))

    return F.element_at(F.transform(F.array(found), shaped), 1)


def suggested_filters(p: Column) -> Column:
    """array<string>: what a parsed description filters by, for showing."""
    age = F.when(p["age_low"].isNotNull(), F.format_string("Age: %d-%d", p["age_low"], p["age_high"]))
    return F.concat(F.transform(p["diagnoses"], lambda d: F.concat(F.lit("Diagnosis: "), d)), F.array_compact(F.array(
        age, F.concat(F.lit("Gender: "), p["gender"]), F.when(p["icu"], "ICU Stay: Required"), F.when(p["mortality"].isNotNull(), F.concat(F.lit("Mortality: "), F.when(p["mortality"], "Yes").otherwise("No"))), F.concat(F.lit("Risk Level: "), p["risk"]))))


def recognised(p: Column) -> Column:
    """The share of seven kinds of filter that a parsed description has, the way conditions are joined counted always; at most 1."""
    n = sum(((x.isNotNull()).cast("int") for x in (p["age_low"], p["gender"], p["icu"], p["mortality"], p["risk"], p["complexity"])), (F.size(p["diagnoses"]) > 0).cast("int"))
    return F.least((n + 1) / 7, F.lit(1.0))


def is_complex(p: Column) -> Column:
    """Whether a parsed description says anything that reasoning in steps can follow: a condition, ages, a gender or a severity."""
    return (F.size(p["diagnoses"]) > 0) | p["age_low"].isNotNull() | p["gender"].isNotNull() | p["risk"].isNotNull()


# Words of retrieved texts that name a condition, and clinical factors.
TEXT_CONDITIONS = ["diabetes", "cardiovascular", "hypertension", "renal", "respiratory", "sepsis", "neurological", "trauma", "cancer"]
FACTORS = ["icu", "mortality", "severity", "risk", "comorbidity"]
AGE_WORDS = ["age", "elderly", "young", "adult", "pediatric", "geriatric"]


def from_documents(docs: DataFrame, by: str, order: str = "doc_id", text: str = "content") -> DataFrame:
    """(by, conditions, age_low, age_high, factors): what the texts retrieved for each key say to filter by.

    Conditions and factors are those of any text, in the order of their lists. Ages are those of the first text, by `order`, that
    says any: figures after "age" (ten years on where there is one only), else 65 to 100 for elderly or geriatric
    and 0 to 18 for young or pediatric. Null texts say nothing.
    """
    low = F.lower(F.coalesce(docs[text].cast("string"), F.lit("")))
    any_of = lambda words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    pattern = r"age[ds]?\s*(\d+)\s*[-to]?\s*(\d+)?"
    first, last = (F.nullif(F.regexp_extract(low, pattern, i), F.lit("")).try_cast("int") for i in (1, 2))
    old, young = any_of(["elderly", "geriatric"]), any_of(["young", "pediatric"])
    ages = F.when(any_of(AGE_WORDS), F.when(first.isNotNull(), F.struct(first.alias("low"), F.coalesce(last, first + 10).alias("high"))).when(old, F.struct(F.lit(65).alias("low"), F.lit(100).alias("high"))).when(young, F.struct(F.lit(0).alias("low"), F.lit(18).alias("high"))))
    rows = docs.select(docs[by].alias(by), docs[order].alias("__order"), *[low.contains(w).alias(f"__{w}") for w in [*TEXT_CONDITIONS, *FACTORS]], ages.alias("__ages"))
    one = rows.groupBy(by).agg(*[F.max(f"__{w}").alias(f"__{w}") for w in [*TEXT_CONDITIONS, *FACTORS]], F.min_by("__ages", F.when(F.col("__ages").isNotNull(), F.col("__order"))).alias("__ages"))
    named = lambda words, shown: F.array_compact(F.array(*[F.when(F.col(f"__{w}"), shown(w)) for w in words]))
    return one.select(by, named(TEXT_CONDITIONS, str.upper).alias("conditions"), F.col("__ages.low").alias("age_low"), F.col("__ages.high").alias("age_high"), named(FACTORS, str).alias("factors"))
