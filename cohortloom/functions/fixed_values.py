"""The code and text lists that decide which records count."""

# Laboratory codes that mark the risk, with their names (spelling as published).
RISK_MARKERS = {
    "50827": "respiration",
    "50912": "creatinine",
    "50813": "lactate",
    "50889": "CRP",
    "51300": "WBC",
    "51006": "BUN",
    "51288": "ESR",
    "51265": "platelet",
    "50825": "tempurature",
    "50816": "oxygen",
    "51275": "PT",
    "51274": "PTT",
    "51277": "RBCDW",
    "51256": "neutrophils",
    "50818": "pco2",
    "50821": "po2",
    "50893": "calcium",
    "50931": "glucose",
    "51221": "hematocrit",
    "51222": "hemoglobin",
    "51244": "lymphocytes",
    "51248": "MCH",
    "51237": "INR",
    "50956": "lipase",
    "50878": "AST",
    "50867": "amylase",
    "50863": "alkaline phosphatase",
    "50820": "PH",
    "50882": "bicarbonate",
}

# Words that a diagnosis title of interest holds, case-sensitive.
TITLE_WORDS = ["epsis", "SIRS"]

# Admission diagnosis texts kept for the model, blanks at either end included.
ADMISSION_DIAGNOSES = [
    " MITRAL REGURGITATION;CORONARY ARTERY DISEASE\\CORONARY ARTERY BYPASS GRAFT WITH MVR  ? MITRAL VALVE REPLACEMENT /SDA",
    "ABDOMINAL PAIN",
    "ABSCESS",
    "ACUTE CHOLANGITIS",
    "ACUTE CHOLECYSTITIS",
    "ACUTE PULMONARY EMBOLISM",
    "ACUTE RESPIRATORY DISTRESS SYNDROME;ACUTE RENAL FAILURE",
    "ACUTE SUBDURAL HEMATOMA",
    "ALCOHOLIC HEPATITIS",
    "ALTERED MENTAL STATUS",
    "AROMEGLEY;BURKITTS LYMPHOMA",
    "ASTHMA/COPD FLARE",
    "ASTHMA;CHRONIC OBST PULM DISEASE",
    "BASAL GANGLIN BLEED",
    "BRADYCARDIA",
    "BRAIN METASTASES",
    "CELLULITIS",
    "CEREBROVASCULAR ACCIDENT",
    "CHEST PAIN",
    "CHEST PAIN/ CATH",
    "CHOLANGITIS",
    "CHOLECYSTITIS",
    "CHRONIC MYELOGENOUS LEUKEMIA;TRANSFUSION REACTION",
    "CONGESTIVE HEART FAILURE",
    "CORONARY ARTERY DISEASE\\CORONARY ARTERY BYPASS GRAFT /SDA",
    "CRITICAL AORTIC STENOSIS/HYPOTENSION",
    "ELEVATED LIVER FUNCTIONS;S/P LIVER TRANSPLANT",
    "ESOPHAGEAL CA/SDA",
    "ESOPHAGEAL CANCER/SDA",
    "FACIAL NUMBNESS",
    "FAILURE TO THRIVE",
    "FEVER",
    "FEVER;URINARY TRACT INFECTION",
    "GASTROINTESTINAL BLEED",
    "HEADACHE",
    "HEPATIC ENCEP",
    "HEPATITIS B",
    "HUMERAL FRACTURE",
    "HYPOGLYCEMIA",
    "HYPONATREMIA;URINARY TRACT INFECTION",
    "HYPOTENSION",
    "HYPOTENSION, RENAL FAILURE",
    "HYPOTENSION;TELEMETRY",
    "HYPOTENSION;UNRESPONSIVE",
    "INFERIOR MYOCARDIAL INFARCTION\\CATH",
    "LEFT HIP FRACTURE",
    "LEFT HIP OA/SDA",
    "LIVER FAILURE",
    "LOWER GI BLEED",
    "LUNG CANCER;SHORTNESS OF BREATH",
    "MEDIASTINAL ADENOPATHY",
    "METASTATIC MELANOMA;BRAIN METASTASIS",
    "METASTIC MELANOMA;ANEMIA",
    "MI CHF",
    "NON SMALL CELL CANCER;HYPOXIA",
    "OVERDOSE",
    "PERICARDIAL EFFUSION",
    "PLEURAL EFFUSION",
    "PNEUMONIA",
    "PNEUMONIA/HYPOGLCEMIA/SYNCOPE",
    "PNEUMONIA;TELEMETRY",
    "PULMONARY EDEMA, MI",
    "PULMONARY EDEMA\\CATH",
    "RECURRENT LEFT CAROTID STENOSIS,PRE HYDRATION",
    "RENAL CANCER/SDA",
    "RENAL FAILIURE-SYNCOPE-HYPERKALEMIA",
    "RESPIRATORY DISTRESS",
    "RIGHT HUMEROUS FRACTURE",
    "S/P FALL",
    "S/P MOTOR VEHICLE ACCIDENT",
    "S/P MOTORCYCLE ACCIDENT",
    "SEIZURE",
    "SEIZURE;STATUS EPILEPTICUS",
    "SEPSIS",
    "SEPSIS; UTI",
    "SEPSIS;PNEUMONIA;TELEMETRY",
    "SEPSIS;TELEMETRY",
    "SHORTNESS OF BREATH",
    "STATUS POST MOTOR VEHICLE ACCIDENT WITH INJURIES",
    "STEMI;",
    "STROKE/TIA",
    "SUBDURAL HEMATOMA/S/P FALL",
    "SYNCOPE;TELEMETRY",
    "SYNCOPE;TELEMETRY;INTRACRANIAL HEMORRHAGE",
    "TACHYPNEA;TELEMETRY",
    "TRACHEAL ESOPHAGEAL FISTULA",
    "TRACHEAL STENOSIS",
    "UNSTABLE ANGINA",
    "UPPER GI BLEED",
    "URINARY TRACT INFECTION;PYELONEPHRITIS",
    "UROSEPSIS",
    "UTI/PYELONEPHRITIS",
    "VARICEAL BLEED",
    "VF ARREST ",
    "VOLVULUS",
]
