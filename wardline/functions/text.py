"""Text cleaning, entity patterns, quality and chunks as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.clinical import let

# Entity patterns.
DRUGS = [
    r"\b[A-Z][a-z]+(?:mab|nib|vir|pril|sartan|statin|olol|dipine|zole|mycin|cillin|floxacin)\b",
    r"\b(?:aspirin|ibuprofen|metformin|insulin|warfarin|lisinopril|atorvastatin|omeprazole|losartan|amlodipine)\b",
]
DISEASES = {
    "diabetes": r"\b(?:diabetes|diabetic|t1dm|t2dm|hyperglycemia|hypoglycemia|insulin.?resistance)\b",
    "cardiovascular": r"\b(?:cardiac|heart|coronary|cardiovascular|myocardial|angina|arrhythmia|atrial.?fibrillation)\b",
    "respiratory": r"\b(?:respiratory|pulmonary|lung|copd|asthma|pneumonia|bronchitis|emphysema)\b",
    "neurological": r"\b(?:neurological|brain|stroke|alzheimer|parkinson|epilepsy|seizure|dementia)\b",
    "oncology": r"\b(?:cancer|tumor|oncology|carcinoma|malignant|metastasis|chemotherapy|radiation)\b",
    "infectious": r"\b(?:infection|sepsis|bacterial|viral|antibiotic|pathogen|fever)\b",
    "renal": r"\b(?:kidney|renal|nephritis|dialysis|creatinine|proteinuria)\b",
    "hypertension": r"\b(?:hypertension|high.?blood.?pressure|hypotension)\b",
}
PROCEDURES = [
    r"\b(?:surgery|surgical|transplant|biopsy|endoscopy|catheterization|angioplasty|bypass)\b",
    r"\b(?:MRI|CT.?scan|X.?ray|ultrasound|echocardiogram|EKG|ECG)\b",
    r"\b(?:dialysis|chemotherapy|radiation.?therapy|immunotherapy|ventilation)\b",
]
MEASUREMENTS = [
    r"\b(\d+(?:\.\d+)?)\s*(?:mg|kg|ml|mmHg|mmol|%|bpm|mm)\b",
    r"\b(?:HbA1c|BMI|GFR|eGFR|LDL|HDL|blood.?pressure)\s*(?:of|:)?\s*(\d+(?:\.\d+)?)\b",
]
WORD = r"(?U)\w+"


def _any(patterns: list[str]) -> str:
    """One pattern that is found wherever one of the given \\b(?:...)\\b is: a text without it is passed over in one search instead of many."""
    return r"\b(?:" + "|".join(p[p.index("(?:") + 3 : p.rindex(")")] for p in patterns) + r")\b"


DRUG_HINT = "(?i)(?:" + "|".join(p[p.index("(?:") + 3 : p.rindex(")")] for p in DRUGS) + r")\b"


def without_markup(html: Column) -> Column:
    """Text of HTML: script and style go with what they hold, tags become spaces, the common entities characters."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return out


def clean_text(text: Column) -> Column:
    """Plain text: no markup, addresses or rare characters, single spaces, one space after punctuation."""
    out = F.when(text.contains("<") & text.contains(">"), without_markup(text)).otherwise(text)
    for pattern, new in (
        (r"https?://\S+|www\.\S+", ""), (r"\S+@\S+\.\S+", ""), (r"\s+", " "), (r"(?U)[^\w\s\-.,;:()/%]", ""), (r"\s+([.,;:])", "$1"), (r"([.,;:])\s*", "$1 "),
    ):
        out = F.regexp_replace(out, pattern, new)
    return F.trim(out)


def content_hash(text: Column) -> Column:
    """md5 of the lower-cased text with single spaces."""
    return F.md5(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")))


def all_matches(text: Column, patterns: list[str]) -> Column:
    """Distinct sorted lower-case matches of any pattern, in either case."""
    found = [F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(0)) for p in patterns]
    return F.array_sort(F.array_distinct(F.transform(reduce(F.array_union, found), lambda m: F.lower(m))))


def drugs(text: Column) -> Column:
    """Drug names; texts without any ending or name of the patterns are passed over by a quick search."""
    return F.when(text.rlike(DRUG_HINT), all_matches(text, DRUGS)).otherwise(F.array().cast("array<string>"))


def procedures(text: Column) -> Column:
    return F.when(text.rlike("(?i)" + _any(PROCEDURES)), all_matches(text, PROCEDURES)).otherwise(F.array().cast("array<string>"))


def diseases(text: Column) -> Column:
    """Disease categories that the text names."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(n)) for n, p in DISEASES.items()]))


def disease_mentions(text: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.regexp_count(F.lower(text), F.lit(p)) for p in DISEASES.values()])


def measurements(text: Column) -> Column:
    """All measured values, as doubles."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit("(?i)" + p), F.lit(1)) for p in MEASUREMENTS])
    return F.transform(found, lambda v: v.try_cast("double"))


def tokens(text: Column) -> Column:
    """Lower-case words of letters, marks, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def quality_score(text: Column) -> Column:
    """Length, entity density, sentences, categories and word length, at most 1."""
    def scored(words: Column, counts: Column) -> Column:
        n = F.size(words)
        mentions = F.aggregate(counts, F.lit(0), lambda a, c: a + c)
        entities = mentions + F.size(drugs(text)) + F.size(procedures(text))
        length = F.when(n < 10, 0.0).when(n < 50, 0.2).when(n < 200, 0.3).otherwise(0.35)
        mean_word = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)) / F.greatest(n, F.lit(1))
        return (
            length + F.least(10.0 * entities / F.greatest(n, F.lit(1)), F.lit(0.25)) + F.when(F.size(F.split(text, r"[.!?]+", 3)) >= 3, 0.1).otherwise(0.0)
            + F.least(F.size(F.filter(counts, lambda c: c > 0)) * 0.05, F.lit(0.2)) + let(mean_word, lambda m: F.when(m.between(4, 8), 0.1).otherwise(0.0))
        )

    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    found = lambda low: F.array(*[F.regexp_count(low, F.lit(p)) for p in DISEASES.values()])
    counts = let(F.lower(text), lambda low: F.when(low.rlike(_any(list(DISEASES.values()))), found(low)).otherwise(F.array(*[F.lit(0)] * len(DISEASES))))
    return F.least(let(words, lambda w: let(counts, lambda c: scored(w, c))), F.lit(1.0))


def stride_chunks(text: Column, size: int, overlap: int) -> Column:
    """array<string>: windows of `size` characters, each `size - overlap` after the one before."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length(text) - overlap) / step), F.lit(1)) - 1
    return F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.substr(text, i * step + 1, F.lit(size)))


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: s != "")


def snapped(text: str, size: int, overlap: int) -> list[str]:
    """Windows that end after a sentence where one ends in their second half."""
    text = text.strip()
    out, at = [], 0
    while text and at < len(text):
        end = at + size
        if end < len(text):
            for mark in (". ", ".\n", "! ", "? ", "\n\n"):
                place = text.rfind(mark, at, end)
                if place - at > size // 2:
                    end = place + len(mark)
                    break
        if piece := text[at:end].strip():
            out.append(piece)
        if end >= len(text):
            break
        at = end - overlap
    return out


def highlights(text: Column, terms: Column, around: int = 10, most: int = 3) -> Column:
    """Up to `most` snippets of `around` words on either side of the first places of different words that are terms."""
    words = F.split(text, r"\s+")
    bare = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"(?U)\W", ""))
    hits = F.filter(F.transform(bare, lambda w, i: F.when(F.array_contains(terms, w) & (F.array_position(bare, w) == i + 1), i)), lambda i: i.isNotNull())
    return F.transform(F.slice(hits, 1, most), lambda i: F.array_join(F.slice(words, F.greatest(i - around, F.lit(0)) + 1, F.least(i, F.lit(around)) + around + 1), " "))


def summary(text: Column, n: int = 2) -> Column:
    return F.array_join(F.slice(sentences(text), 1, n), " ")


def prevalence(text: Column) -> Column:
    """array<struct<condition,percent>> of phrases like 'diabetes prevalence of 12.5%'."""
    pattern = r"(?i)([a-z]+) (?:prevalence|rate) (?:of|was|is) (\d+(?:\.\d+)?)\s*%"
    names, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.zip_with(names, values, lambda n, v: F.struct(F.lower(n).alias("condition"), v.try_cast("double").alias("percent")))


def mean_age(text: Column) -> Column:
    return F.regexp_extract(text, r"(?i)mean age (?:of|was|is) (\d+(?:\.\d+)?)", 1).try_cast("double")
