"""Values that results depend on.  Change one and published numbers change."""

from __future__ import annotations

# ---- Fixed values -------------------------------------------------------

# The ordered life-cycle phases: canonical id, label, ordinal, aliases.
PHASES = [
    ("phase_req", "要求・要件定義", 10, ["要求", "要件", "Requirement", "REQ"]),
    ("phase_basic_design", "基本設計", 20, ["概要設計", "Basic Design", "BD", "FD"]),
    ("phase_detail_design", "詳細設計", 30, ["内部設計", "Detail Design", "DD"]),
    ("phase_coding", "実装・単体作成", 35, ["コーディング", "実装", "製造", "PG", "Coding"]),
    ("phase_unit_test", "単体試験", 40, ["UT", "単体", "単体テスト", "Unit Test", "単体検証"]),
    ("phase_integration", "結合試験", 50, ["IT", "結合", "結合テスト", "Integration Test", "サブシステム試験"]),
    ("phase_system", "システム試験", 60, ["ST", "総合", "総合試験", "総合テスト", "System Test"]),
    ("phase_acceptance", "受入試験", 70, ["UAT", "受入", "検収試験", "Acceptance Test"]),
    ("phase_operation", "運用・保守", 80, ["本番", "運用", "出荷後", "Operation", "Maintenance"]),
]

# Source header -> column id.  Headers outside the table keep their own name.
HEADER_IDS = {
    "管理番号": "defect_id",
    "不具合番号": "defect_id",
    "タイトル": "title",
    "検出工程": "detect_phase",
    "混入工程": "injection_phase",
    "重要度": "severity",
    "不具合分類": "defect_type",
    "原因": "cause",
    "流出原因": "escape_cause",
    "対策": "countermeasure",
    "担当者": "assignee",
    "検出日": "detect_date",
    "状態": "status",
}

# Words that mark a countermeasure as superficial.
SUPERFICIAL_WORDS = ["注意", "周知", "徹底"]

# Capabilities, and what each role has by default.
CAPABILITIES = ["filterable", "searchable", "aggregatable", "normalizable", "ordered"]
ROLE_CAPABILITIES = {
    "record_id": ["filterable", "searchable"],
    "date": ["filterable", "aggregatable", "ordered"],
    "numeric": ["filterable", "ordered"],
    "category": ["filterable", "aggregatable", "normalizable"],
    "ordered_category": ["filterable", "aggregatable", "normalizable", "ordered"],
    "short_text": ["filterable", "searchable"],
    "long_text": ["searchable"],
    "status": ["filterable", "aggregatable", "normalizable"],
    "ignore": [],
}

# Filter operators each role accepts.
ROLE_OPERATORS = {
    "record_id": ["eq", "neq", "in", "not_in", "is_null", "is_not_null", "starts_with"],
    "date": ["eq", "neq", "lt", "lte", "gt", "gte", "between", "is_null", "is_not_null"],
    "numeric": ["eq", "neq", "lt", "lte", "gt", "gte", "between", "is_null", "is_not_null"],
    "category": ["eq", "neq", "in", "not_in", "is_null", "is_not_null"],
    "ordered_category": [
        "eq", "neq", "in", "not_in", "lt", "lte", "gt", "gte", "between", "is_null", "is_not_null",
    ],
    "short_text": ["eq", "neq", "contains", "starts_with", "ends_with", "is_null", "is_not_null"],
    "long_text": ["contains", "is_null", "is_not_null"],
    "status": ["eq", "neq", "in", "not_in", "is_null", "is_not_null"],
    "ignore": [],
}

# Column pairs cross-tabulated when the caller names none.
DEFAULT_CROSS_PAIRS = [
    ("detect_phase", "defect_type"),
    ("injection_phase", "detect_phase"),
    ("severity", "detect_phase"),
    ("component", "defect_type"),
]

# Column names the landscape looks for, first match wins.
LANDSCAPE_PHASE_COLUMNS = ["detect_phase", "injection_phase"]
LANDSCAPE_TYPE_COLUMN = "defect_type"

# Columns searched, and columns projected, when the caller names none.
DEFAULT_SEARCH_COLUMNS = ["title", "cause"]
DEFAULT_PROJECTION = ["title", "cause", "escape_cause", "countermeasure", "detect_phase"]

# Batch packing: characters per batch, and overhead charged per record.
BATCH_BUDGET_CHARS = 12000
RECORD_OVERHEAD_CHARS = 50

# Id and label formats.
BATCH_ID_FORMAT = "batch-%03d"
FINDING_ID_FORMAT = "FIND-%03d"
FEEDBACK_ID_FORMAT = "FB-%04d"
LESSON_ID_FORMAT = "LES-%04d"
UNKNOWN_VALUE_PREFIX = "val_"
NULL_CATEGORY = "(NULL)"
NULL_MARKER = "*NULL*"
NOT_NORMALIZED_MARKER = "-"

# What a proposed mapping says about itself.
MATCHED = ("high", "dictionary_match", "Matched known dictionary alias for '%s'")
UNMATCHED = ("low", "unknown_value", "Unmatched distinct category value")

# Finding defaults and vocabularies.
DEFAULT_FINDING_TYPE = "root_cause_pattern"
DEFAULT_CONFIDENCE_REASON = "Supported by deterministic candidate records"
CONFIDENCE_LEVELS = ["high", "medium", "low"]
LESSON_STATUSES = ["candidate", "accepted", "rejected", "retired"]
JUDGMENTS = ["MATCH", "NO_MATCH", "UNCERTAIN"]

# Reasons a finding is rejected; %s is the first missing ids, %d their number.
REASON_EMPTY_CLAIM = "Finding claim is empty."
REASON_NO_SUPPORT = "Finding lacks supporting records."
REASON_SUPPORT_OUTSIDE = "Supporting records not found in candidate set: [%s] (total missing: %d)"
REASON_COUNTER_OUTSIDE = "Counter records not found in candidate set: [%s] (total missing: %d)"

# Notes on search columns; {} is the column.
SEARCH_COLUMN_UNKNOWN = "Lexical search column '{}' not found in catalog; ignoring."
SEARCH_COLUMN_NOT_SEARCHABLE = "Lexical search column '{}' is not marked as searchable."

# Names of the two row tests of the audit.
IDENTICAL_FIELDS_METRIC = "identical_cause_and_escape_cause_count"
SUPERFICIAL_METRIC = "superficial_countermeasure_keywords_count"

# Build check messages.
MESSAGE_INDEX_OK = "FTS index verified: %d records cleanly indexed."
MESSAGE_STRUCTURE = "Total records verified: %d, total columns: %d"

# Report sizes.
TOP_CATEGORIES = 8
TOP_CROSS_CELLS = 10
SHOWN_SUPPORTING_IDS = 5
SHOWN_MISSING_IDS = 3

# ---- End of fixed values ------------------------------------------------
