"""Values that must be exactly these for results to be right.

Field names, domains, limits, patterns and message texts of the log, package
and hand-off formats. Fixed values; nothing here is computed.
"""

# --- log records ---------------------------------------------------------
REQUIRED_FIELDS = ("timestamp", "severity", "service", "message")
LOG_SEVERITIES = ("CRITICAL", "ERROR", "WARNING", "INFO", "DEBUG")
CLUSTERED_SEVERITIES = ("CRITICAL", "ERROR")
NAMED_FIELDS = (
    "event_id", "timestamp", "severity", "service", "environment", "version", "message",
    "error_type", "error_message", "stack_trace", "request_id", "trace_id", "span_id", "raw_ref",
)
OPTIONAL_TEXT_FIELDS = (
    "environment", "version", "request_id", "trace_id", "span_id",
    "error_type", "error_message", "stack_trace",
)
IDENTITY_FIELDS = ("timestamp", "service", "severity", "message", "request_id")
CREDENTIAL_WORDS = ("authorization", "cookie", "password", "api_key", "apikey", "token", "secret")

# --- message template ----------------------------------------------------
UUID_PATTERN = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
QUOTED_PATTERN = "'[^']*'|\"[^\"]*\""
DIGITS_PATTERN = r"\d+"
FRAME_PATTERN = r'File "[^"]*", line \d+, in (\w+)'
UNKNOWN = "unknown"

# --- limits --------------------------------------------------------------
DEDUP_TTL_SECONDS = 3600
ERROR_THRESHOLD = 2
CRITICAL_THRESHOLD = 1
STACK_TRACE_CHARS = 2000
MESSAGE_CHARS = 500
HEAD_MARK = "...[truncated]"
TAIL_MARK = "...[truncated]...\n"

# --- incidents and packages ------------------------------------------------
BUSINESS_SEVERITY = {
    "CRITICAL": "critical", "ERROR": "high", "WARNING": "medium", "INFO": "low", "DEBUG": "low",
}
BUSINESS_SEVERITIES = ("critical", "high", "medium", "low")
PACKAGE_VERSION = "1.1"
PACKAGE_REQUIRED = (
    "incident_id", "schema_version", "severity", "detected_at",
    "service", "summary", "observed_facts", "confidence_overall",
)
PACKAGE_FIELDS = (
    "incident_id", "schema_version", "severity", "detected_at", "environment", "service",
    "affected_component", "impact", "summary", "symptoms", "error_clusters", "observed_facts",
    "correlated_events", "timeline", "hypotheses", "suspected_root_cause", "confidence_overall",
    "deployment_information", "relevant_commit", "relevant_files", "documentation_context",
    "recommended_investigation", "log_references", "related_incident_ids",
)

# --- investigation gate ----------------------------------------------------
VERDICTS = ("confirmed", "refuted", "partially_confirmed", "inconclusive")
SUPPORTING_VERDICTS = ("confirmed", "partially_confirmed")
PLANNING_PATHS = ("openspec", "lightweight", "undetermined")
REASON_NO_CAUSE = (
    "validated_root_cause is null or empty -- investigation did not establish a cause"
)
REASON_NO_VERDICT = (
    "no hypothesis_assessment carries a 'confirmed' or 'partially_confirmed' "
    "verdict -- Codex's own investigation did not support the claimed root cause"
)
REASON_UNDETERMINED = (
    "planning_path is 'undetermined' -- Codex could not decide how to proceed"
)
REASON_AUTHORIZED = (
    "validated_root_cause present, a hypothesis was confirmed or partially confirmed, "
    "and planning_path is decided"
)

# --- delivery ---------------------------------------------------------------
MAX_ATTEMPTS = 3
BACKOFF_SECONDS = (1, 2)
RETRYABLE_STATUS = (429, 500, 502, 503, 504)

# --- lifecycle ----------------------------------------------------------------
LIFECYCLE_STEPS = (
    ("DETECTED", "CONTEXT_READY"),
    ("CONTEXT_READY", "CODEX_INVESTIGATING"),
    ("CODEX_INVESTIGATING", "FIX_IN_PROGRESS"),
    ("FIX_IN_PROGRESS", "PR_OPEN"),
    ("PR_OPEN", "REVIEWING"),
    ("REVIEWING", "CHANGES_REQUESTED"),
    ("CHANGES_REQUESTED", "REVIEWING"),
    ("REVIEWING", "READY_FOR_HUMAN"),
    ("READY_FOR_HUMAN", "MERGED"),
    ("MERGED", "VERIFYING"),
    ("VERIFYING", "RESOLVED"),
    ("VERIFYING", "PERSISTING"),
    ("VERIFYING", "CHANGED"),
    ("VERIFYING", "REGRESSED"),
)
INITIAL_STATE = "DETECTED"
FAILED_STATE = "FAILED"
ESCALATED_STATE = "HUMAN_ATTENTION_REQUIRED"
MAX_REMEDIATIONS = 3

# --- checkout -------------------------------------------------------------------
BULK_QUANTITY = 10
BULK_RATE = 0.10
CLEARANCE_RATE = 0.05
LOG_EXTRA_FIELDS = (
    "http_method", "endpoint", "http_status", "latency_ms", "product_id", "quantity",
    "order_id", "error_type", "error_message",
)
