"""Declared schemas of the operational tables: nothing is inferred at run time."""

from __future__ import annotations

from pyspark.sql import types as T

_short, _int, _long, _text = T.ShortType(), T.IntegerType(), T.LongType(), T.StringType()
_double, _date, _moment, _money = T.DoubleType(), T.DateType(), T.TimestampNTZType(), T.DecimalType(12, 2)

# Names of the operational tables and columns.
_FIELDS: dict[str, dict[str, T.DataType]] = {
    "departments": {"department_id": _short, "department": _text, "staffed_beds": _short},
    "doctors": {
        "doctor_id": _int, "doctor_name": _text, "department_id": _short, "employment_status": _text,
        "years_experience": _short,
    },
    "patients": {
        "patient_id": _long, "patient_name": _text, "date_of_birth": _date, "gender": _text, "state": _text,
        "insurance_type": _text,
    },
    "admissions": {
        "admission_id": _long, "patient_id": _long, "doctor_id": _int, "department_id": _short,
        "admission_date": _moment, "admission_type": _text, "severity_score": _double, "length_of_stay_days": _double,
        "discharge_date": _moment, "wait_minutes": _double, "discharge_efficiency": _double, "readmitted_30d": _int,
        "department_raw_text": _text,
    },
    "billing": {
        "billing_id": _long, "admission_id": _long, "gross_charge": _money, "insurance_payment": _money,
        "patient_out_of_pocket": _money, "direct_operating_cost": _money,
    },
    "satisfaction_surveys": {
        "survey_id": _long, "admission_id": _long, "satisfaction_score": _double,
        "response_days_after_discharge": _short,
    },
    "treatments": {
        "treatment_id": _long, "admission_id": _long, "procedure": _text, "treatment_cost": T.DecimalType(10, 2),
    },
}

SCHEMAS: dict[str, T.StructType] = {
    table: T.StructType([T.StructField(name, kind) for name, kind in fields.items()])
    for table, fields in _FIELDS.items()
}
NATURAL_KEY = ["patient_id", "doctor_id", "department_id", "admission_date", "admission_type"]
