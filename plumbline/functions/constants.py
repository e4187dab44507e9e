"""Fixed values.

Every list, pattern, threshold and message in this file is part of the result
contract: results only compare equal when these are exactly as written.
"""

# ---- characters str.strip() removes -------------------------------------------------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# ---- text null tokens of a CSV scan -------------------------------------------------
CSV_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# ---- JSON keys that may wrap the records --------------------------------------------
JSON_WRAPPER_KEYS = (
    "data", "items", "records", "results", "rows", "dataset", "features", "payload",
)

# ---- column-name rules --------------------------------------------------------------
IDENTIFIER_NAMES = (
    "id", "uuid", "guid", "key", "code", "ssn", "email", "username",
    "account_number", "account_no", "token",
)
IDENTIFIER_SUFFIXES = ("_id", "_key", "_code", "_uuid", "_guid", "_pk")
IDENTIFIER_PREFIXES = ("id_", "key_", "pk_")
NON_NEGATIVE_WORDS = (
    "age", "count", "quantity", "qty", "inventory", "price", "revenue", "salary",
    "duration", "size", "height", "weight", "distance", "items", "num_of",
)
SIGNED_WORDS = (
    "profit", "loss", "temperature", "delta", "change", "diff", "balance", "growth",
    "return", "net", "variance", "offset",
)
PERCENT_WORDS = ("percent", "pct", "rate", "ratio", "%")
PHONE_WORDS = ("phone", "telephone", "mobile", "cell_number")
DATE_WORDS = ("date", "time", "created_at", "updated_at", "timestamp", "dob")
CLEANING_NON_NEGATIVE_WORDS = (
    "age", "count", "quantity", "price", "revenue", "spending", "visits", "total", "num_",
)
SECRET_WORDS = ("password", "secret", "token", "ssn", "api_key")

# ---- value patterns -----------------------------------------------------------------
EMAIL_STRICT = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"
EMAIL_LOOSE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
PHONE_CHARACTERS = r"^[0-9\s+\-().]+$"
DATE_ISO = (
    r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}"
    r"(?:[ T]\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
)
DATE_DELIMITED = r"^\d{1,2}[-/]\d{1,2}[-/]\d{4}(?:[ T]\d{2}:\d{2}(?::\d{2})?)?$"
DATE_NAMED = r"^(?:\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}|[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4})"
SHORT_NUMBER = r"^\d{1,6}$"
REPEATED_CHARACTER = r"^(.)\1{4,}$"
REPEATED_WORD = r"(?iu)\b(\w+)\b(?:\s+\1\b){2}"
WIDE_GAP = r"[ \t]{2,}"
MONTHS = (
    "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
    "january", "february", "march", "april", "may", "june", "july", "august",
    "september", "october", "november", "december",
)

# ---- personal data ------------------------------------------------------------------
PII_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PII_SSN = r"\b\d{3}-\d{2}-\d{4}\b"
PII_CARD = r"\b(?:\d{4}[-\s]?){3}\d{4}\b|\b\d{15,16}\b"
PII_PHONE = r"(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{2,4}\)?[-.\s]?)?\d{3,4}[-.\s]?\d{4}\b"
MASK_EMAIL = "[EMAIL_REDACTED]"
MASK_SSN = "[SSN_REDACTED]"
MASK_CARD = "[CARD_REDACTED]"
MASK_PHONE = "[PHONE_REDACTED]"
MASK_SECRET = "[SENSITIVE_REDACTED]"

# ---- cleaning -----------------------------------------------------------------------
PLACEHOLDERS = (
    "", "n/a", "na", "null", "none", "nan", "-", "--", "nil", "undefined", "#n/a", "?",
)

# ---- intake -------------------------------------------------------------------------
EXTENSIONS = (".csv", ".json")
MAX_FILE_BYTES = 52_428_800
RETENTION_HOURS = 24
BLOCKED_MIME_PREFIXES = (
    "application/x-msdownload", "application/x-sh", "application/x-executable",
    "application/x-dosexec", "application/javascript", "text/html", "image/",
    "video/", "audio/",
)
CSV_MIMES = (
    "text/csv", "text/plain", "application/csv", "application/vnd.ms-excel",
    "text/x-csv", "application/octet-stream",
)
JSON_MIMES = (
    "application/json", "text/plain", "application/x-json", "application/octet-stream",
)
DATASET_ID = r"^[a-zA-Z0-9_-]{8,64}$"

# ---- rate limiting ------------------------------------------------------------------
RATE_WINDOW_SECONDS = 60
RATE_LIMIT = 120

# ---- scoring ------------------------------------------------------------------------
SCORE_WEIGHTS = {
    "completeness": 0.30,
    "validity": 0.30,
    "uniqueness": 0.20,
    "consistency": 0.20,
}
SCORE_PENALTIES = {
    "empty_column": 15.0,
    "high_missing": 8.0,
    "elevated_missing": 4.0,
    "constant": 10.0,
    "low_variance": 5.0,
    "high_factor": 1.0,
    "medium_factor": 0.6,
}
REPORT_TIERS = ("Excellent Quality", "Good Quality", "Moderate Risk", "Critical Degradation")
DASHBOARD_TIERS = (
    "Excellent Quality", "Good Quality", "Fair / Moderate Issues", "Critical Quality Alert",
)
TARGET_SCORE = 85

# ---- issue catalogue: type -> (severity, method, description) ------------------------
# {c} column, {n} affected rows, {p} percentage, {x} extra rows, {v} value,
# {lo} {hi} bounds, {t} threshold
ISSUES = {
    "empty_column": (
        "high",
        "Total null count verification",
        "Column '{c}' is completely empty (100% missing values).",
    ),
    "high_missing_percentage": (
        "high",
        "Null rate threshold (>= 50%)",
        "Column '{c}' has a critically high missing rate ({p}% of rows are null).",
    ),
    "elevated_missing_percentage": (
        "medium",
        "Null rate threshold (>= 20%)",
        "Column '{c}' has an elevated missing rate ({p}% of rows are null).",
    ),
    "missing_values": (
        "low",
        "Null cell check",
        "Column '{c}' contains {n} missing value(s) ({p}%).",
    ),
    "duplicate_rows": (
        "high",
        "Exact full-row comparison",
        "Found {x} duplicate row(s) ({n} total rows involved in duplication).",
    ),
    "duplicate_identifier": (
        "high",
        "Identifier uniqueness check",
        "Likely identifier column '{c}' contains {n} duplicate entry/entries ({p}% of rows).",
    ),
    "normalized_duplicate_rows": (
        "medium",
        "Normalized row comparison (lowercased & whitespace trimmed)",
        "Found {x} near-duplicate row(s) caused by subtle letter casing or whitespace "
        "inconsistencies.",
    ),
    "constant_column": (
        "medium",
        "Cardinality check (unique_count == 1)",
        "Column '{c}' is constant; every non-null row contains the identical value '{v}'.",
    ),
    "low_variance_column": (
        "low",
        "Dominant value frequency threshold (>= 99%)",
        "Column '{c}' provides very little information ({p}% of rows share the same "
        "dominant value).",
    ),
    "invalid_email": (
        "high",
        "Standard RFC email regex verification",
        "Column '{c}' contains {n} malformed email address(es).",
    ),
    "impossible_percentage": (
        "high",
        "Percentage boundary check [0, 100]",
        "Column '{c}' contains {n} impossible percentage value(s) outside [0, 100].",
    ),
    "negative_value_violation": (
        "high",
        "Domain-specific non-negativity constraint",
        "Column '{c}' represents a strictly non-negative quantity but contains {n} negative "
        "value(s).",
    ),
    "malformed_phone": (
        "medium",
        "Phone format and digit length check (7 to 15 digits)",
        "Column '{c}' contains {n} malformed phone number(s) (invalid digits or illegal "
        "characters).",
    ),
    "invalid_date": (
        "high",
        "Calendar date parsing and realistic year range check [1800, 2150]",
        "Column '{c}' contains {n} unparseable or out-of-range date value(s).",
    ),
    "outliers": (
        "graded",
        "IQR (Tukey's Fences: Q1 - 1.5*IQR to Q3 + 1.5*IQR)",
        "Column '{c}' has {n} statistical outlier(s) ({p}% of rows) outside the bounds "
        "[{lo}, {hi}].",
    ),
    "near_empty_text": (
        "graded",
        "Trimmed text length audit (length <= 1)",
        "Column '{c}' contains {n} near-empty or single-character entry/entries ({p}% of rows).",
    ),
    "extremely_long_text": (
        "medium",
        "Text length anomaly threshold (>= {t} chars)",
        "Column '{c}' has {n} abnormally long string(s) exceeding {t} characters.",
    ),
    "repeated_text_anomaly": (
        "medium",
        "Repetitive character & repeated word regex inspection",
        "Column '{c}' contains {n} entry/entries with repeating placeholder characters or "
        "words.",
    ),
    "whitespace_formatting_anomaly": (
        "low",
        "Whitespace and control character audit",
        "Column '{c}' contains {n} value(s) with unstripped whitespace, consecutive spaces, or "
        "control characters.",
    ),
}

# ---- score explanation notes: {c} {n} {p} as above, {d} points, {y} issue type --------
SCORE_NOTES = {
    "null_cells": "{n} missing cell(s) across dataset ({p}% of total cells, -{d} pts)",
    "empty_column": "column '{c}' is 100% empty (-{d} pts)",
    "high_missing_percentage": "column '{c}' has {p}% missing rate (-{d} pts)",
    "validity": "column '{c}' contains {n} {y} entry/entries (-{d} pts)",
    "duplicate_rows": "{n} duplicate rows detected ({p}% of dataset, -{d} pts)",
    "duplicate_identifier": "identifier collision in '{c}' ({n} duplicate keys, -{d} pts)",
    "normalized_duplicate_rows": "{n} near-duplicate records with subtle casing/whitespace "
    "differences (-{d} pts)",
    "constant_column": "column '{c}' is constant with zero variation (-{d} pts)",
    "low_variance_column": "column '{c}' provides near-zero informational variance (-{d} pts)",
    "outliers": "column '{c}' has {n} statistical outlier(s) (-{d} pts)",
    "text": "column '{c}' exhibits text formatting anomalies ({y}, -{d} pts)",
}
SCORE_PERFECT = {
    "completeness": "Perfect score — no missing values or empty columns detected.",
    "validity": "Perfect score — all inspected records adhere to domain constraints and "
    "formats.",
    "uniqueness": "Perfect score — no duplicate rows or identifier collisions detected.",
    "consistency": "Perfect score — uniform distributions and formatting across all columns.",
}
SCORE_LINE = "{k} ({s}/100): Deductions due to {notes}."
SCORE_LINE_PERFECT = "{k} ({s}/100): {notes}"
SCORE_OVERALL_LINE = (
    "Overall Quality Score ({s}/100): Weighted synthesis of Completeness ({wc}%), "
    "Validity ({wv}%), Uniqueness ({wu}%), and Consistency ({ws}%)."
)

# ---- cleaning audit descriptions ----------------------------------------------------
CLEANING_STEPS = {
    "remove_duplicates": "Removed {n} exact duplicate row(s) (preserved first occurrence).",
    "trim_whitespace": "Trimmed leading and trailing whitespace across {k} column(s) ({n} "
    "cells modified).",
    "normalize_whitespace": "Collapsed consecutive internal whitespace in text values across "
    "{k} column(s) ({n} cells modified).",
    "normalize_email_casing": "Standardized email addresses to lowercase in column(s): "
    "{names} ({n} cells modified).",
    "standardize_missing": "Standardized ambiguous placeholder strings ('N/A', 'null', "
    "'none', empty strings) to standard missing values in {k} column(s) ({n} cells).",
}
CLEANING_WARNINGS = {
    "outliers": "Detected {n} statistical outlier(s) in numeric column '{c}' outside "
    "[{lo}, {hi}]. Preserved without automatic clipping; manual inspection or "
    "domain-specific Winsorization recommended.",
    "negatives": "Found {n} negative value(s) in column '{c}' (e.g. {v}). Preserved without "
    "sign inversion to avoid data distortion; please verify data ingestion source.",
    "malformed_email": "Detected {n} malformed email address(es) in column '{c}' (e.g. "
    "'{v}'). Preserved without deletion to prevent accidental data loss; verify with user "
    "records.",
    "mostly_null": "Column '{c}' has {p}% missing values ({n}/{r} rows). Column retained; "
    "evaluate whether this column should be dropped based on business context.",
}

# ---- insight texts ------------------------------------------------------------------
# {f} format, {s} overall score, {r} rows, {k} columns, {dims} dimension names
SUMMARY_STRONG = (
    "The {f} dataset exhibits strong overall health ({s}/100) across {r} rows and {k} "
    "columns. Minor hygiene items were detected, but core dimensions (Completeness: "
    "{completeness}/100, Validity: {validity}/100) show readiness for analytics pipeline "
    "ingestion."
)
SUMMARY_MODERATE = (
    "The {f} dataset displays moderate quality issues (Overall Score: {s}/100) across {r} "
    "rows. Key risk areas include {dims}, which require targeted cleaning before model "
    "training to prevent biased inference or pipeline ingestion failures."
)
SUMMARY_CRITICAL = (
    "The {f} dataset displays critical data-quality defects (Overall Score: {s}/100) across "
    "{r} rows. Severe degradation in {dims} indicates substantial risk of corrupted "
    "downstream analysis or modeling anomalies if used without extensive data remediation."
)
SUMMARY_MODERATE_DEFAULT = "uniqueness/validity"
SUMMARY_CRITICAL_DEFAULT = "multiple dimensions"
# type -> (issue, importance, explanation, recommendation)
PRIORITY_TEXTS = {
    "empty_column": (
        "Completely Empty Column: '{c}'",
        "High",
        "Column '{c}' contains 0 non-null values across {r} rows, offering zero predictive "
        "signal and consuming storage/schema overhead.",
        "Drop column '{c}' from the active feature schema.",
    ),
    "high_missing_percentage": (
        "Severe Missingness in '{c}'",
        "High",
        "{p}% of rows ({n} entries) are null. High missingness causes sample attrition or "
        "biased imputation.",
        "Evaluate whether '{c}' can be imputed using domain heuristics or if a missingness "
        "indicator column should be engineered.",
    ),
    "duplicate_rows": (
        "Exact Duplicate Records",
        "High",
        "{n} rows ({p}% of the dataset) are exact duplicates. Redundant records artificially "
        "inflate sample size and cause data leakage during cross-validation.",
        "Deduplicate the dataset by keeping the first occurrence of each unique record.",
    ),
    "duplicate_identifier": (
        "Identifier Collision in '{c}'",
        "High",
        "{n} rows share duplicated IDs in column '{c}'. Primary key collisions break "
        "relational integrity and record linkage.",
        "Inspect upstream ingestion pipelines to resolve key assignment collisions in '{c}'.",
    ),
    "negative_value_violation": (
        "Domain Range Violation in '{c}'",
        "High",
        "Column '{c}' represents a strictly non-negative metric but contains {n} negative "
        "value(s).",
        "Clip negative values at zero or investigate sensor/entry logging errors causing "
        "inverted signs.",
    ),
    "invalid_email": (
        "Malformed Email Entries in '{c}'",
        "Medium",
        "{n} entries in '{c}' fail standard RFC email formatting, leading to deliverability "
        "errors and broken identity resolution.",
        "Apply regex standardization or route malformed records to an invalid contact "
        "quarantine queue.",
    ),
}
PRIORITY_OTHER = (
    "{title} in '{c}'",
    "Medium",
    "{description}",
    "Audit column transformations and validate source ingestion logic.",
)
PRIORITY_NONE = (
    "No Critical Anomalies",
    "Low",
    "The dataset adheres to expected format constraints and basic schema hygiene.",
    "Proceed with exploratory data analysis and feature engineering.",
)
PRIORITY_NO_COLUMN = "Dataset-wide"
PLAN_EMPTY = "Remove completely empty column(s): {names}."
PLAN_DUPLICATES = "Deduplicate full duplicate records to ensure sample independence."
PLAN_RULES = (
    "Correct or filter domain rule violations (invalid emails, out-of-bounds percentages, "
    "negative values)."
)
PLAN_MISSING = (
    "Address missing values through targeted imputation (median for numeric, mode/constant "
    "for categorical)."
)
PLAN_OUTLIERS = (
    "Review statistical numerical outliers outside 1.5x IQR boundaries; consider robust "
    "scaling or winsorizing."
)
PLAN_NOTHING = (
    "Dataset structure is clean; proceed with standard type casting and downstream workflow."
)
CLIENT_SUMMARY = (
    "The dataset contains {r} rows and {k} columns with an overall quality score of {s}/100. "
    "{n} data quality issues were identified."
)
CLIENT_RECOMMENDATION = "Remediate {n} affected rows in column {c}."
CLIENT_PLAN = (
    "Step 1: Inspect and resolve high-severity issues identified in the quality report.",
    "Step 2: Clean invalid and out-of-range values.",
    "Step 3: Handle null and missing values appropriately.",
)
