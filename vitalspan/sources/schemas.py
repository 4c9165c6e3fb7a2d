"""Explicit schemas of the modelled tables and the rules they must satisfy."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)  # DDL text -> StructType


DDL = {
    "surv_master": "pid BIGINT, train BOOLEAN, time INT, event BOOLEAN",
    "baseline": (
        "pid BIGINT, sex BOOLEAN, age DOUBLE, height DECIMAL(5,0), weight DECIMAL(5,0), pulse INT, sys_bp INT, "
        "dia_bp INT, crea DECIMAL(5,0), arrest BOOLEAN, enzymes BOOLEAN, stemi BOOLEAN, smoking STRING, "
        "vessels STRING, dominance STRING, nyha INT, ccs INT, killip INT"
    ),
    "clinicaltwo": (
        "pid BIGINT, sex BOOLEAN, height DECIMAL(5,0), weight DECIMAL(5,0), dia_bp INT, smoking STRING, "
        "vessels STRING, dominance STRING, nyha INT, ccs INT, familiary_ihd STRING, icd_or_pm BOOLEAN, "
        "lvef STRING, ischemia_test STRING, abnormal_ekg STRING, abnormal_qrs_st STRING"
    ),
    "diagnoses": "pid BIGINT, time INT, level STRING, code STRING",
    "biochem": "pid BIGINT, qid STRING, time INT, value INT",
    "nomesco": "pid BIGINT, code STRING, time INT",
    "polygenic_scores": "pid BIGINT, name STRING, score DOUBLE",
    "risk_scores": "pid BIGINT, time DOUBLE, type STRING, imputed BOOLEAN, value DOUBLE",
    "patients": (
        "pid BIGINT, entryid BIGINT, sex STRING, index_type STRING, index_date DATE, age DOUBLE, status STRING, "
        "status_date DATE"
    ),
    "predictions": "model STRING, pid BIGINT, time DOUBLE, surv DOUBLE",
    "attributions": "pid BIGINT, feature STRING, shap DOUBLE, vals DOUBLE, timepoint DOUBLE",
}


def schema(table: str) -> T.StructType:
    return _schema(DDL[table])


# The constraints of the relational tables.
RULES = {
    "surv_master": [{"rule": "primary_key", "columns": ["pid"]}],
    "baseline": [
        {"rule": "primary_key", "columns": ["pid"]},
        {"rule": "foreign_key", "columns": ["pid"], "parent": "surv_master"},
        {"rule": "domain", "column": "smoking", "values": ["yes", "ex", "no"]},
        {"rule": "domain", "column": "vessels", "values": ["DIF", "1VD", "2VD", "3VD"]},
        {"rule": "domain", "column": "dominance", "values": ["R", "L", "B"]},
        {"rule": "range", "column": "nyha", "lo": 1, "hi": 4},
        {"rule": "range", "column": "ccs", "lo": 0, "hi": 4},
        {"rule": "range", "column": "killip", "lo": 1, "hi": 4},
    ],
    "diagnoses": [
        {"rule": "foreign_key", "columns": ["pid"], "parent": "surv_master"},
        {"rule": "domain", "column": "level", "values": ["lvl4", "lvl3", "block", "chap"]},
    ],
    "biochem": [
        {"rule": "foreign_key", "columns": ["pid"], "parent": "surv_master"},
        {"rule": "not_null", "column": "qid"},
        {"rule": "not_null", "column": "time"},
        {"rule": "not_null", "column": "value"},
    ],
    "risk_scores": [{"rule": "foreign_key", "columns": ["pid"], "parent": "surv_master"}],
}
