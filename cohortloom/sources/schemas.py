"""Column positions, names and types of the hospital tables.

Each entity is a map ``position -> (name, type)``. Positions that no operator needs are left out; the reader
fills them with unread string columns so that the later ones stay in place.
"""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _TS = T.StringType(), T.DoubleType(), T.TimestampNTZType()

ENTITIES: dict[str, dict[int, tuple[str, T.DataType]]] = {
    "patients": {
        1: ("SUBJECT_ID", _S),
        2: ("GENDER", _S),
        3: ("DOB", _TS),
        4: ("DOD", _TS),
        5: ("DOD_HOSP", _TS),
    },
    "admissions": {
        1: ("SUBJECT_ID", _S),
        2: ("HADM_ID", _S),
        3: ("ADMITTIME", _TS),
        4: ("DISCHTIME", _TS),
        5: ("DEATHTIME", _TS),
        6: ("ADMISSION_TYPE", _S),
        9: ("INSURANCE", _S),
        16: ("DIAGNOSIS", _S),
    },
    "lab_events": {
        0: ("ROW_ID", T.LongType()),
        1: ("SUBJECT_ID", _S),
        2: ("HADM_ID", _S),
        3: ("ITEMID", _S),
        4: ("CHARTTIME", _TS),
        5: ("VALUE", _S),
        6: ("VALUENUM", _D),
        7: ("VALUEUOM", _S),
        8: ("FLAG", _S),
    },
    "chart_events": {
        1: ("SUBJECT_ID", _S),
        4: ("CHARTCD", _S),
        9: ("VALUENUM", _D),
        10: ("VALUEUOM", _S),
        11: ("WARNING", _S),
    },
    "diagnoses": {
        1: ("SUBJECT_ID", _S),
        4: ("ICD9_CODE", _S),
    },
    "diagnosis_lookup": {
        1: ("ICD9_CODE", _S),
        2: ("SHORT_TITLE", _S),
    },
    "microbiology": {
        1: ("SUBJECT_ID", _S),
        2: ("HADM_ID", _S),
        3: ("CHARTDATE", _TS),
        4: ("CHARTTIME", _TS),
        5: ("SPEC_ITEMID", _S),
        6: ("SPEC_TYPE_DESC", _S),
        7: ("ORG_ITEMID", _S),
        8: ("ORG_NAME", _S),
        9: ("ISOLATE_NUM", _S),
        10: ("AB_ITEMID", _S),
        11: ("AB_NAME", _S),
        12: ("DILUTION_TEXT", _S),
        13: ("DILUTION_COMPARISON", _S),
        14: ("DILUTION_VALUE", _D),
        15: ("INTERPRETATION", _S),
    },
}


def entity_schema(entity: str) -> T.StructType:
    """Positional schema of an entity's file; unnamed positions become ``_cN`` strings."""
    columns = ENTITIES[entity]
    return T.StructType(
        [T.StructField(*columns.get(i, (f"_c{i}", _S)), True) for i in range(max(columns) + 1)]
    )
