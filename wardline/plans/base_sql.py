"""Common table expressions of the patient table, for the comparison SQL."""

from wardline.functions import fixed
from wardline.sources.views import AS_OF, with_clauses


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


# The SQL's own literals: ranges of three characters, then prefixes of two.
_RANGES = [
    ("250", "250", "DIABETES"), ("410", "414", "CARDIOVASCULAR"), ("428", "428", "CARDIOVASCULAR"), ("401", "405", "HYPERTENSION"), ("580", "586", "RENAL"), ("490", "494", "RESPIRATORY"),
    ("496", "496", "RESPIRATORY"), ("486", "486", "RESPIRATORY"), ("038", "038", "SEPSIS"), ("995", "995", "SEPSIS"), ("430", "437", "NEUROLOGICAL"), ("345", "345", "NEUROLOGICAL"),
    ("800", "819", "TRAUMA"), ("140", "165", "CANCER"), ("170", "176", "CANCER"), ("179", "199", "CANCER"),
]
_PREFIXES = [(["25"], "DIABETES"), (["40"], "HYPERTENSION"), (["41", "42", "43"], "CARDIOVASCULAR"), (["49"], "RESPIRATORY"), (["58"], "RENAL"), (["03", "99"], "SEPSIS"),
             (["14", "15", "16", "17", "18", "19"], "CANCER"), (["80", "81", "82", "83", "84", "85", "86", "87"], "TRAUMA")]


def _icd9(code: str) -> str:
    three = " ".join(f"when length({code}) >= 3 and substr({code}, 1, 3) between '{a}' and '{b}' then '{n}'" for a, b, n in _RANGES)
    two = " ".join(f"when substr({code}, 1, 2) in ({_list(p)}) then '{n}'" for p, n in _PREFIXES)
    return f"case {three} {two} else 'OTHER' end"


ICD9 = _icd9("upper(trim(icd9_code))")
SEVERE, MODERATE = _list(fixed.SEVERE), _list(fixed.MODERATE)
SPECIFIC = "list_sort(case when len(list_filter(l, lambda x: x <> 'OTHER')) > 0 then list_filter(l, lambda x: x <> 'OTHER') else l end)"
SCORED = f"""
select *, len(diagnoses) as num_diagnoses, cast(least(len(diagnoses) + len(list_filter(diagnoses, lambda x: x in ({SEVERE}))), 10) as integer) as comorbidity_score,
  len(list_filter(diagnoses, lambda x: x in ({SEVERE}))) as severe, len(list_filter(diagnoses, lambda x: x in ({MODERATE}))) as moderate"""
RATED = """
select *,
  case when pts >= 10 then 'critical' when pts >= 7 then 'high' when pts >= 4 then 'medium' else 'low' end as risk_level,
  case when use >= 8 then 'high' when use >= 4 then 'medium' else 'low' end as utilization_category,
  cast(num_diagnoses >= 3 or comorbidity_score >= 5 or icu_los_days >= 7 as integer) as high_complexity"""
POINTS = """
select *, case when age >= 80 then 3 when age >= 65 then 2 when age >= 50 then 1 else 0 end
    + 3 * severe + 2 * moderate + (num_diagnoses - severe - moderate)
    + case when age < 40 and severe >= 2 then 2 when age < 40 and severe >= 1 and num_diagnoses >= 3 then 1 else 0 end
    + case when comorbidity_score >= 7 then 3 when comorbidity_score >= 5 then 2 when comorbidity_score >= 3 then 1 else 0 end as pts,
  case when hospital_los_days >= 14 then 3 when hospital_los_days >= 7 then 2 when hospital_los_days >= 3 then 1 else 0 end
    + case when icu_los_days >= 7 then 3 when icu_los_days >= 3 then 2 when icu_los_days >= 1 then 1 else 0 end
    + case when num_procedures >= 10 then 2 when num_procedures >= 5 then 1 else 0 end
    + case when num_medications >= 15 then 2 when num_medications >= 8 then 1 else 0 end as use"""

BASE = f"""
with {with_clauses("patients", "admissions", "diagnoses", "procedures", "prescriptions", "icustays")},
demo as (
  select * from (
    select *, greatest(0, year(ref) - year(birthdate) - case when month(ref) * 100 + day(ref) < month(birthdate) * 100 + day(birthdate) then 1 else 0 end) as age,
      cast(deathdate is not null as integer) as mortality
    from (select *, coalesce(deathdate, date '{AS_OF}') as ref from patients)
  ) where age between 18 and 100
), grouped as (
  select *, case when age < 18 then 'pediatric' when age < 40 then 'young_adult' when age < 65 then 'middle_aged' when age < 80 then 'elderly' else 'very_elderly' end as age_group from demo
), dx as (
  select patient_id, {SPECIFIC} as diagnoses from (select patient_id, list(distinct {ICD9}) as l from diagnoses group by 1)
), adm as (
  select patient_id, round(stay_minutes / 1440.0, 1) as hospital_los_days, admittime as last_admission,
    case admission_type when 'URGENT' then 'Urgent' when 'ELECTIVE' then 'Elective' else 'Emergency' end as admission_type
  from admissions qualify row_number() over (partition by patient_id order by admittime desc, admission_id) = 1
), icu as (
  select patient_id, round(sum(icu_minutes) / 1440.0, 1) as icu_los_days, count(*) as icu_stays from icustays group by 1
), joined as (
  select g.*, d.diagnoses, coalesce(a.hospital_los_days, 3.0) as hospital_los_days, coalesce(a.admission_type, 'Emergency') as admission_type, a.last_admission,
    coalesce(i.icu_los_days, 0) as icu_los_days, coalesce(i.icu_stays, 0) as icu_stays, coalesce(p.n, 0) as num_procedures, coalesce(m.n, 0) as num_medications, coalesce(e.n, 0) as num_encounters
  from grouped g join dx d using (patient_id) left join adm a using (patient_id) left join icu i using (patient_id)
    left join (select patient_id, count(*) as n from procedures group by 1) p using (patient_id)
    left join (select patient_id, count(*) as n from prescriptions group by 1) m using (patient_id)
    left join (select patient_id, count(*) as n from admissions group by 1) e using (patient_id)
), scored as ({SCORED}, cast(icu_stays > 0 as integer) as has_icu_stay, cast(admission_type = 'Emergency' as integer) as emergency_admission from joined),
pt as ({RATED} from ({POINTS} from scored))
"""
