"""Values that have to equal the published ones."""

# Disease categories and the keywords that name them.
KEYWORDS = {
    "DIABETES": ["diabetes", "diabetic", "hyperglycemia", "insulin", "glucose"],
    "CARDIOVASCULAR": ["cardiac", "heart", "coronary", "myocardial", "cardiovascular", "angina"],
    "HYPERTENSION": ["hypertension", "hypertensive", "blood pressure", "high bp"],
    "RENAL": ["kidney", "renal", "nephritis", "dialysis", "creatinine"],
    "RESPIRATORY": ["copd", "asthma", "pneumonia", "respiratory", "lung", "bronchitis"],
    "SEPSIS": ["sepsis", "septic", "infection", "bacteremia"],
    "NEUROLOGICAL": ["stroke", "seizure", "neurological", "brain", "cerebral"],
    "TRAUMA": ["trauma", "fracture", "injury", "accident", "wound"],
    "CANCER": ["cancer", "tumor", "malignant", "carcinoma", "oncology"],
    "OTHER": ["other", "unspecified", "unknown"],
}
# Phrases of the first source that name a category besides the keywords.
PHRASES = {
    "diabetes mellitus": "DIABETES", "essential hypertension": "HYPERTENSION", "chronic kidney disease": "RENAL",
    "acute myocardial infarction": "CARDIOVASCULAR", "congestive heart failure": "CARDIOVASCULAR",
    "chronic obstructive pulmonary disease": "RESPIRATORY", "pneumonia": "RESPIRATORY", "stroke": "NEUROLOGICAL",
    "seizure": "NEUROLOGICAL", "sepsis": "SEPSIS", "malignant neoplasm": "CANCER", "fracture": "TRAUMA",
}
# Category by ICD-9 code of three characters.
ICD9_CATEGORY = {
    "250": "DIABETES",
    "410": "CARDIOVASCULAR", "411": "CARDIOVASCULAR", "412": "CARDIOVASCULAR", "413": "CARDIOVASCULAR", "414": "CARDIOVASCULAR", "428": "CARDIOVASCULAR",
    "401": "HYPERTENSION", "402": "HYPERTENSION", "403": "HYPERTENSION", "404": "HYPERTENSION", "405": "HYPERTENSION",
    "580": "RENAL", "581": "RENAL", "582": "RENAL", "583": "RENAL", "584": "RENAL", "585": "RENAL", "586": "RENAL",
    "490": "RESPIRATORY", "491": "RESPIRATORY", "492": "RESPIRATORY", "493": "RESPIRATORY", "494": "RESPIRATORY", "496": "RESPIRATORY", "486": "RESPIRATORY",
    "038": "SEPSIS", "995": "SEPSIS",
    "430": "NEUROLOGICAL", "431": "NEUROLOGICAL", "432": "NEUROLOGICAL", "433": "NEUROLOGICAL", "434": "NEUROLOGICAL", "435": "NEUROLOGICAL", "436": "NEUROLOGICAL", "437": "NEUROLOGICAL",
    "345": "NEUROLOGICAL",
    "800": "TRAUMA", "801": "TRAUMA", "802": "TRAUMA", "803": "TRAUMA", "804": "TRAUMA", "805": "TRAUMA", "806": "TRAUMA", "807": "TRAUMA",
    "808": "TRAUMA", "809": "TRAUMA", "810": "TRAUMA", "811": "TRAUMA", "812": "TRAUMA", "813": "TRAUMA", "814": "TRAUMA", "815": "TRAUMA",
    "816": "TRAUMA", "817": "TRAUMA", "818": "TRAUMA", "819": "TRAUMA",
    "140": "CANCER", "141": "CANCER", "142": "CANCER", "143": "CANCER", "144": "CANCER", "145": "CANCER", "146": "CANCER", "147": "CANCER",
    "148": "CANCER", "149": "CANCER", "150": "CANCER", "151": "CANCER", "152": "CANCER", "153": "CANCER", "154": "CANCER", "155": "CANCER",
    "156": "CANCER", "157": "CANCER", "158": "CANCER", "159": "CANCER", "160": "CANCER", "161": "CANCER", "162": "CANCER", "163": "CANCER",
    "164": "CANCER", "165": "CANCER", "170": "CANCER", "171": "CANCER", "172": "CANCER", "173": "CANCER", "174": "CANCER", "175": "CANCER",
    "176": "CANCER", "179": "CANCER", "180": "CANCER", "181": "CANCER", "182": "CANCER", "183": "CANCER", "184": "CANCER", "185": "CANCER",
    "186": "CANCER", "187": "CANCER", "188": "CANCER", "189": "CANCER", "190": "CANCER", "191": "CANCER", "192": "CANCER", "193": "CANCER",
    "194": "CANCER", "195": "CANCER", "196": "CANCER", "197": "CANCER", "198": "CANCER", "199": "CANCER",
}
# Category by the first two characters, where no code of three is known.
ICD9_PREFIX = {
    "25": "DIABETES",
    "40": "HYPERTENSION",
    "41": "CARDIOVASCULAR", "42": "CARDIOVASCULAR", "43": "CARDIOVASCULAR",
    "49": "RESPIRATORY",
    "58": "RENAL",
    "03": "SEPSIS", "99": "SEPSIS",
    "14": "CANCER", "15": "CANCER", "16": "CANCER", "17": "CANCER", "18": "CANCER", "19": "CANCER",
    "80": "TRAUMA", "81": "TRAUMA", "82": "TRAUMA", "83": "TRAUMA", "84": "TRAUMA", "85": "TRAUMA", "86": "TRAUMA", "87": "TRAUMA",
}
# Conditions that weigh more in scores.
SEVERE = ["SEPSIS", "CANCER", "NEUROLOGICAL", "TRAUMA"]
MODERATE = ["CARDIOVASCULAR", "RESPIRATORY", "RENAL"]
# Target shares of diagnosis combinations; they sum to 1.
TARGET_MIX = {
    ("DIABETES",): 0.08, ("CARDIOVASCULAR",): 0.12, ("HYPERTENSION",): 0.05, ("RESPIRATORY",): 0.07, ("RENAL",): 0.03, ("SEPSIS",): 0.05,
    ("DIABETES", "HYPERTENSION"): 0.09, ("DIABETES", "RENAL"): 0.05, ("CARDIOVASCULAR", "DIABETES"): 0.06,
    ("CARDIOVASCULAR", "HYPERTENSION"): 0.08, ("HYPERTENSION", "RENAL"): 0.04, ("CARDIOVASCULAR", "RESPIRATORY"): 0.03,
    ("DIABETES", "HYPERTENSION", "RENAL"): 0.06, ("CARDIOVASCULAR", "DIABETES", "HYPERTENSION"): 0.05,
    ("CARDIOVASCULAR", "HYPERTENSION", "RENAL"): 0.03, ("CARDIOVASCULAR", "HYPERTENSION", "RESPIRATORY"): 0.02,
    ("CARDIOVASCULAR", "SEPSIS"): 0.02, ("CANCER", "SEPSIS"): 0.02, ("OTHER",): 0.05,
}
# Chance that a condition brings another, and how age changes a condition's chance.
CO_OCCURRENCE = {
    "DIABETES": {"HYPERTENSION": 0.55, "RENAL": 0.25, "CARDIOVASCULAR": 0.35, "SEPSIS": 0.15},
    "HYPERTENSION": {"RENAL": 0.75, "CARDIOVASCULAR": 0.60, "DIABETES": 0.30},
    "CARDIOVASCULAR": {"HYPERTENSION": 0.70, "DIABETES": 0.25, "RENAL": 0.40, "RESPIRATORY": 0.20},
    "RESPIRATORY": {"CARDIOVASCULAR": 0.30, "HYPERTENSION": 0.56, "SEPSIS": 0.12},
    "RENAL": {"HYPERTENSION": 0.80, "DIABETES": 0.40, "CARDIOVASCULAR": 0.50},
    "SEPSIS": {"CARDIOVASCULAR": 0.30, "RESPIRATORY": 0.25, "CANCER": 0.20, "RENAL": 0.15},
    "CANCER": {"SEPSIS": 0.30, "CARDIOVASCULAR": 0.15, "RESPIRATORY": 0.10},
}
AGE_MODIFIERS = {
    "young_adult": {"DIABETES": 0.5, "HYPERTENSION": 0.3, "CARDIOVASCULAR": 0.2, "TRAUMA": 2.0, "SEPSIS": 0.7},
    "middle_aged": {"DIABETES": 1.0, "HYPERTENSION": 1.0, "CARDIOVASCULAR": 1.0, "CANCER": 1.5, "RESPIRATORY": 1.2},
    "elderly": {"DIABETES": 1.3, "HYPERTENSION": 1.5, "CARDIOVASCULAR": 1.8, "RENAL": 1.6, "SEPSIS": 1.4},
    "very_elderly": {"DIABETES": 1.2, "HYPERTENSION": 1.8, "CARDIOVASCULAR": 2.0, "RENAL": 2.0, "SEPSIS": 1.8, "NEUROLOGICAL": 2.5},
}
# Chance of intensive care by condition.
ICU_CHANCE = {
    "SEPSIS": 0.8, "CARDIOVASCULAR": 0.6, "RESPIRATORY": 0.5, "NEUROLOGICAL": 0.7, "TRAUMA": 0.4,
    "CANCER": 0.3, "RENAL": 0.4, "DIABETES": 0.2, "HYPERTENSION": 0.1, "OTHER": 0.2,
}
# Columns of the combined patient table, in order.
COMBINED = (
    "patient_id", "age", "gender", "ethnicity", "insurance", "admission_type", "diagnoses", "num_diagnoses", "num_procedures",
    "num_medications", "hospital_los_days", "icu_los_days", "has_icu_stay", "mortality", "emergency_admission", "age_group",
    "comorbidity_score", "high_complexity", "source", "risk_level", "utilization_category",
)
# Condition names in free-text cohort descriptions.
COHORT_WORDS = {
    "DIABETES": ["diabetes", "diabetic", "dm", "glucose"],
    "CARDIOVASCULAR": ["cardiovascular", "cardiac", "heart", "cvd", "coronary"],
    "HYPERTENSION": ["hypertension", "hypertensive", "high blood pressure", "htn"],
    "RENAL": ["renal", "kidney", "nephritis", "dialysis", "ckd"],
    "RESPIRATORY": ["respiratory", "pulmonary", "copd", "asthma", "pneumonia", "lung"],
    "SEPSIS": ["sepsis", "septic", "infection", "bacteremia"],
    "NEUROLOGICAL": ["neurological", "stroke", "seizure", "brain", "neuro"],
    "TRAUMA": ["trauma", "fracture", "injury", "accident"],
    "CANCER": ["cancer", "tumor", "malignant", "oncology", "carcinoma"],
}
# ICD-10 codes by condition.
ICD10 = {
    "DIABETES": ["E10", "E11", "E13", "E08", "E09"], "CARDIOVASCULAR": ["I20", "I21", "I22", "I25", "I50", "I48", "I49"],
    "HYPERTENSION": ["I10", "I11", "I12", "I13", "I15"], "RENAL": ["N17", "N18", "N19", "N00", "N05"],
    "RESPIRATORY": ["J44", "J45", "J18", "J96", "J80"], "SEPSIS": ["A41", "R65.2", "A40"],
    "NEUROLOGICAL": ["I60", "I61", "I63", "I64", "G40", "G20", "G30"], "TRAUMA": ["S00-S99", "T07", "T14"], "CANCER": ["C00-C96", "D00-D09"],
    "LIVER": ["K70", "K74", "K72", "B18"], "PSYCHIATRIC": ["F20", "F30", "F32", "F41", "F10-F19"],
}
# ICD-10 codes by words of a topic search.
TOPIC_CODES = {
    "diabetes": ["E11", "E11.9"], "hypertension": ["I10", "I11"], "cardiovascular": ["I25", "I50"], "heart": ["I25", "I51"], "respiratory": ["J44", "J45"], "copd": ["J44"], "asthma": ["J45"],
    "renal": ["N18", "N19"], "kidney": ["N18", "N19"], "sepsis": ["A41"], "cancer": ["C80"], "stroke": ["I63", "I64"], "neurological": ["G00", "G89"],
}

# Words by which a request names a condition, terms that go with it, and what it may bring.
MEDICAL_TERMS = {
    "DIABETES": (
        ["diabetes", "diabetic", "dm", "type 1 diabetes", "type 2 diabetes", "t1dm", "t2dm", "glucose", "insulin", "hyperglycemia", "hypoglycemia", "diabetes mellitus", "blood sugar", "glycemic", "hba1c", "a1c"],
        ["diabetic nephropathy", "diabetic retinopathy", "diabetic neuropathy"], ["renal", "cardiovascular", "neurological", "ophthalmological"],
    ),
    "CARDIOVASCULAR": (
        ["cardiovascular", "cardiac", "heart", "cvd", "coronary", "myocardial", "angina", "heart attack", "mi", "myocardial infarction", "cad", "coronary artery disease", "heart failure", "chf", "cardiomyopathy", "arrhythmia", "atrial fibrillation", "afib", "cardiac arrest"],
        ["stent", "bypass", "cabg", "pci", "angioplasty"], ["heart_failure", "arrhythmia", "stroke"],
    ),
    "HYPERTENSION": (
        ["hypertension", "hypertensive", "high blood pressure", "htn", "bp", "elevated blood pressure", "essential hypertension", "malignant hypertension", "resistant hypertension", "secondary hypertension"],
        ["blood pressure medication", "antihypertensive"], ["stroke", "cardiovascular", "renal"],
    ),
    "RENAL": (
        ["renal", "kidney", "nephritis", "dialysis", "ckd", "chronic kidney", "acute kidney injury", "aki", "esrd", "end stage renal", "nephropathy", "glomerulonephritis", "kidney failure", "creatinine", "gfr", "bun", "hemodialysis", "peritoneal dialysis"],
        ["dialysis catheter", "kidney transplant", "fistula"], ["cardiovascular", "anemia", "bone_disease"],
    ),
    "RESPIRATORY": (
        ["respiratory", "copd", "asthma", "pneumonia", "lung", "bronchitis", "pulmonary", "chronic obstructive", "emphysema", "ards", "respiratory failure", "hypoxia", "hypoxemia", "oxygen", "ventilator", "intubation", "bronchiectasis", "pulmonary fibrosis", "pleural effusion"],
        ["nebulizer", "inhaler", "oxygen therapy", "cpap", "bipap"], ["respiratory_failure", "pulmonary_hypertension"],
    ),
    "SEPSIS": (
        ["sepsis", "septic", "infection", "bacteremia", "septicemia", "septic shock", "severe sepsis", "urosepsis", "systemic infection", "blood infection", "sirs", "qsofa"],
        ["blood culture", "antibiotics", "source control"], ["organ_failure", "dic", "ards", "aki"],
    ),
    "NEUROLOGICAL": (
        ["neurological", "stroke", "seizure", "brain", "neuro", "cerebral", "cva", "cerebrovascular accident", "tia", "transient ischemic", "hemorrhagic stroke", "ischemic stroke", "epilepsy", "encephalopathy", "meningitis", "encephalitis", "parkinson", "alzheimer", "dementia", "intracranial hemorrhage", "ich", "sah", "subarachnoid"],
        ["mri brain", "ct head", "lumbar puncture", "eeg"], ["disability", "cognitive_impairment"],
    ),
    "TRAUMA": (
        ["trauma", "fracture", "injury", "accident", "wound", "broken", "laceration", "contusion", "fall", "mvc", "motor vehicle", "head injury", "tbi", "traumatic brain injury", "polytrauma", "blunt trauma", "penetrating trauma", "burns"],
        ["surgery", "fixation", "cast", "splint"], ["infection", "compartment_syndrome"],
    ),
    "CANCER": (
        ["cancer", "tumor", "malignant", "oncology", "carcinoma", "neoplasm", "metastatic", "metastasis", "chemotherapy", "radiation", "lymphoma", "leukemia", "sarcoma", "melanoma", "adenocarcinoma", "stage iv"],
        ["biopsy", "oncologist", "tumor marker"], ["metastasis", "cachexia", "immunosuppression"],
    ),
    "LIVER": (
        ["liver", "hepatic", "cirrhosis", "hepatitis", "liver failure", "jaundice", "ascites", "hepatorenal", "hepatocellular", "hcc", "liver disease", "fatty liver", "nafld", "nash", "esophageal varices"],
        ["liver transplant", "tips", "paracentesis"], ["encephalopathy", "variceal_bleeding", "coagulopathy"],
    ),
    "PSYCHIATRIC": (
        ["psychiatric", "mental health", "depression", "anxiety", "bipolar", "schizophrenia", "psychosis", "suicide", "suicidal", "overdose", "substance abuse", "addiction", "withdrawal", "delirium"],
        ["psychiatrist", "antidepressant", "antipsychotic"], ["self_harm", "medical_noncompliance"],
    ),
}
# Age groups of requests, with their words, in order of precedence.
AGE_TERMS = [
    (65, 100, ["elderly", "geriatric", "senior", "older adult", "aged", "old"]), (80, 100, ["very elderly", "very old", "oldest old", "octogenarian", "nonagenarian"]), (40, 65, ["middle aged", "middle-aged", "midlife"]),
    (18, 65, ["adult", "grown-up", "mature"]), (18, 40, ["young adult", "young", "youth"]), (12, 18, ["adolescent", "teenager", "teen", "juvenile"]),
    (0, 18, ["pediatric", "child", "children", "kid", "minor"]), (0, 2, ["infant", "baby", "neonate", "newborn"]), (1, 4, ["toddler", "preschool"]),
]
# Words of clinical settings, in order of precedence.
SETTINGS = {
    "icu": ["icu", "intensive care", "critical care", "micu", "sicu", "ccu", "nicu", "picu"], "emergency": ["emergency", "ed", "er", "urgent", "acute", "emergent", "trauma center"],
    "inpatient": ["inpatient", "admitted", "hospitalized", "hospital stay", "ward"], "outpatient": ["outpatient", "clinic", "ambulatory", "office visit"],
    "surgical": ["surgical", "surgery", "operative", "post-op", "pre-op", "or"], "palliative": ["palliative", "hospice", "end of life", "comfort care", "dnr"],
}
# Subject headings and keywords of literature topics.
TOPICS = {
    "DIABETES": (["Diabetes Mellitus", "Diabetes Mellitus, Type 2", "Diabetes Mellitus, Type 1", "Diabetic Nephropathy", "Diabetic Retinopathy", "Hyperglycemia"], ["insulin", "glucose", "hba1c", "metformin", "glycemic"]),
    "CARDIOVASCULAR": (["Cardiovascular Diseases", "Heart Failure", "Myocardial Infarction", "Coronary Artery Disease", "Atrial Fibrillation", "Hypertension"], ["cardiac", "heart", "coronary", "angina", "arrhythmia"]),
    "RESPIRATORY": (["Respiratory Tract Diseases", "Pulmonary Disease, Chronic Obstructive", "Asthma", "Pneumonia", "Respiratory Insufficiency"], ["lung", "pulmonary", "copd", "ventilation", "bronchial"]),
    "ONCOLOGY": (["Neoplasms", "Carcinoma", "Tumor", "Cancer", "Metastasis"], ["chemotherapy", "radiation", "oncology", "tumor", "malignant"]),
    "NEUROLOGY": (["Nervous System Diseases", "Stroke", "Alzheimer Disease", "Parkinson Disease", "Epilepsy", "Multiple Sclerosis"], ["brain", "neurological", "cognitive", "seizure", "dementia"]),
    "INFECTIOUS": (["Infection", "Sepsis", "Bacterial Infections", "Viral Infections"], ["infection", "bacterial", "viral", "antibiotic", "pathogen"]),
}
