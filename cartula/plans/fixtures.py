"""Small notes and resources of our own, for tests and a first try."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Which sections have which flag, and from which priority symptoms count there.
_FLAGS = {
    "assertion_history": "PAST_HISTORY PAST_PROCEDURE PAST_MEDICATION",
    "assertion_family": "FAMILY_HISTORY",
    "diagnosis_structural": "PAST_HISTORY HOSPITAL_ASSESSMENT DIAGNOSIS DIAGNOSIS_EXTRA DISEASE_COURSE FAMILY_HISTORY COMPLICATIONS FAQ_DIAGNOSIS",
    "symptom_structural": "CURRENT_SYMPTOMS CURRENT_SYMPTOMS_EXTRA SYMPTOM_CHARACTERISTICS DISEASE_COURSE PRE_ADMISSION_EVENTS PRE_ADMISSION_STATUS PHYSICAL_EXAM COMPLICATIONS FAQ_SYMPTOMS",
    "trusted": "CURRENT_ILLNESS ADMISSION_REASON ONSET CURRENT_SYMPTOMS CURRENT_SYMPTOMS_EXTRA SYMPTOM_CHARACTERISTICS PRE_ADMISSION_EVENTS PRE_ADMISSION_STATUS USER_QUESTION",
}
_PRIORITY = {"HOSPITAL_ASSESSMENT": 90, "PHYSICAL_EXAM": 90, "DISEASE_COURSE": 100, "COMPLICATIONS": 100}

NOTES = [
    ("1", "Lý do nhập viện: ho và sốt\nTiền sử bệnh:\n- tăng huyết áp\nXét nghiệm:\nCreatinin: 120 µmol/L\nĐiều trị: uống aspirin 81 mg mỗi ngày"),
    ("2", "Bệnh nhân không sốt, có đau ngực. Mẹ bệnh nhân bị đái tháo đường.\nglucose 7.8 mmol/L; kết quả dương tính"),
    ("3", "Triệu chứng bệnh Kawasaki ở trẻ em\n- Sốt cao kéo dài\n- Phát ban đỏ toàn thân"),
    ("4", ""),
]
ALIASES = [
    ("ADMISSION_REASON", "Lý do nhập viện"), ("PAST_HISTORY", "Tiền sử bệnh"), ("LAB_RESULT", "Xét nghiệm"), ("FAMILY_HISTORY", "Tiền sử gia đình"),
    ("CURRENT_SYMPTOMS", "Triệu chứng hiện tại"), ("DIAGNOSIS", "Chẩn đoán"), ("TREATMENT", "Điều trị"),
]


def policy(spark: SparkSession) -> DataFrame:
    names = sorted({s for v in _FLAGS.values() for s in v.split()} | {"UNKNOWN", *_PRIORITY})
    has = lambda flag, s: s in _FLAGS[flag].split()
    rows = []
    for s in names:
        trusted = has("trusted", s)
        rows.append((s, "unknown", 0 if trusted else _PRIORITY.get(s, 110), has("symptom_structural", s), has("diagnosis_structural", s), has("assertion_history", s), has("assertion_family", s), "trusted" if trusted else "model_support"))
    return spark.createDataFrame(rows, "section string, role string, min_priority int, symptom_structural boolean, diagnosis_structural boolean, assertion_history boolean, assertion_family boolean, rule_trust string")


def notes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NOTES, "note_id string, text string")


def resources(spark: SparkSession) -> dict:
    from pyspark.sql import functions as F

    from cartula.operators.linking import code_map

    table = spark.createDataFrame
    diagnoses = table([("tăng huyết áp", "hypertension", ["I10"], 120), ("đái tháo đường", "diabetes mellitus", ["E14"], 120)], "surface string, canonical string, codes array<string>, priority int")
    return {
        "aliases": ALIASES,
        "policy": policy(spark),
        "tests": table([("creatinin", "creatinine", "laboratory", 100), ("glucose", "glucose", "laboratory", 100), ("NEUT%", "neutrophils", "laboratory", 100)], "surface string, canonical string, category string, priority int"),
        "drugs": table([("aspirin", "aspirin", "1191"), ("amlodipine", "amlodipine", "")], "surface string, canonical string, code string"),
        "symptoms": table([("ho", "cough", 110), ("sốt", "fever", 110), ("đau ngực", "chest pain", 120), ("đau", "pain", 60)], "surface string, canonical string, priority int"),
        "diagnoses": diagnoses,
        "icd_aliases": code_map(diagnoses.withColumn("ord", F.lit(0))),
        "icd_catalog": table([(1, "I10", "Essential hypertension", "Hypertensive diseases"), (2, "E14", "Unspecified diabetes mellitus", "Diabetes"), (3, "J18.9", "Pneumonia, unspecified", "Pneumonia")], "row long, code string, title string, category string"),
        "rx_catalog": table([("1191", "aspirin", "IN"), ("243670", "aspirin 81 MG Oral Tablet", "SCD"), ("17767", "amlodipine", "IN")], "rxcui string, name string, tty string"),
    }
