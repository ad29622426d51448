"""Lists, patterns and texts that results depend on."""

# Telemetry states and quality marks.
OPERATING_STATUSES = (
    "NORMAL",
    "CURTAILED_BY_ERCOT",
    "CURTAILED_BY_CAISO",
    "CURTAILED_BY_PJM",
    "NIGHT_REST",
)
GENERIC_STATUSES = ("NORMAL", "CURTAILED_BY_ISO")
VALID_QUALITY = "VALID"
CURTAILED_PREFIX = "CURTAILED_BY"

# Validation codes, in order of precedence.
INVALID_TIMESTAMP = "INVALID_TIMESTAMP"
MISSING_ASSET = "MISSING_ASSET"
UNKNOWN_ASSET = "UNKNOWN_ASSET"
NEGATIVE_GENERATION = "NEGATIVE_GENERATION"
NEGATIVE_EXPECTED_BASELINE = "NEGATIVE_EXPECTED_BASELINE"
NEGATIVE_GRID_LIMIT = "NEGATIVE_GRID_LIMIT"
UNKNOWN_STATUS = "UNKNOWN_STATUS"

# Time and energy constants.
TELEMETRY_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
SAMPLE_SECONDS = 10
LOOKBACK_HOURS = 72

# Section heading pattern and length limits.
HEADING_PATTERN = (
    r"^\s*((section|article|exhibit|schedule|appendix)\s+[\w\-.]+|\d+(\.\d+)*\s+)"
    r"[\):.\-\s]+(.{3,120})$"
)
HEADING_MAX_CHARS = 200
CAPS_HEADING_MAX_CHARS = 120

# Clause keywords, in tie order.
CLAUSE_KEYWORDS = {
    "curtailment": ["curtail", "curtailment", "dispatch down", "reduction", "limited by grid"],
    "settlement": ["settlement", "invoice", "payment", "true-up", "billing"],
    "price": ["price", "rate", "$", "mwh", "megawatt-hour"],
    "limitation": ["liability", "limit", "cap", "exclusion", "damages"],
    "notice": ["notice", "dispute", "claim", "cure", "days after"],
    "force_majeure": ["force majeure", "uncontrollable", "emergency", "iso order"],
}

# Section split and sliding window sizes.
SPLIT_MAX_CHARS = 1400
SPLIT_OVERLAP_CHARS = 200
SPLIT_MIN_FILL = 0.55
WINDOW_CHARS = 900
WINDOW_OVERLAP_CHARS = 150

# Retrieval.
RETRIEVAL_VERSION = "contract-scoped-v1"
EMBEDDING_MODEL = "text-embedding-3-small"
EMBED_BATCH = 64
RETRIEVAL_TOP_K = 6
CACHE_TTL_SECONDS = 3600
MIN_SIMILARITY = 0.62
DEFAULT_EVENT_TYPE = "curtailment settlement variance"
RETRIEVAL_QUERY = (
    "Find PPA clauses for {event_type}. Contract: {contract_id}. Asset: {asset_id}. "
    "ISO region: {iso_region}. Revenue variance from Gold table: {leakage}. "
    "Focus on curtailment compensation, settlement true-up, notice, dispute, "
    "limitations of liability, and payment adjustment language."
)

# Case readiness, grounding and routes.
REQUIRED_CASE_FIELDS = (
    "breach_event_id",
    "asset_id",
    "contract_id",
    "estimated_leakage_revenue_usd",
    "recommended_next_action",
)
GROUNDED_FIELDS = ("asset_id", "contract_id", "invoice_id", "sf_contract_id")
EVIDENCE_TOP_K = 8
UNRANKED = 999
MSG_CASE_NOT_FOUND = "Breach event ID not found: "
MSG_MISSING_FIELD = "Missing required field: "
MSG_NO_EVIDENCE_SUPPLIED = "No evidence_context was supplied."
MSG_EMPTY_ANSWER = "Generated answer is empty."
LEAKED_INSTRUCTION = "do not recalculate"
MSG_LEAKED_INSTRUCTION = "Answer leaked prompt instruction text."
MSG_NOT_MENTIONED = "Answer does not mention required grounded value: "
MSG_NO_EVIDENCE_USED = "No evidence chunks were used."
READY = "READY"
BLOCKED = "BLOCKED"
ACTION_READY = "READY_FOR_HUMAN_REVIEW"
ACTION_UPDATE = "UPDATE_EXISTING_SALESFORCE_DISPUTE"
ACTION_GAPS = "REVIEW_DATA_GAPS"
ROUTE_BLOCKED = "BLOCKED_REVIEW_REQUIRED"
ROUTE_REVIEW = "HUMAN_REVIEW_QUEUE"
ROUTE_UPDATE = "HUMAN_REVIEW_EXISTING_DISPUTE_UPDATE"
ROUTE_GAPS = "DATA_GAP_OR_THRESHOLD_REVIEW"

# Document types and the evidence role, rank and score of each.
DOC_PPA = "PPA"
DOC_NOTICE = "ISO_CURTAILMENT_NOTICE"
DOC_STATEMENT = "ISO_SETTLEMENT_STATEMENT"
EVIDENCE_ROLES = (
    (DOC_PPA, "CONTRACTUAL_SUPPORT", 1, 95),
    (DOC_NOTICE, "OPERATIONAL_SUPPORT", 2, 80),
    (DOC_STATEMENT, "SETTLEMENT_SUPPORT", 3, 75),
)

# Explanation text; {platform} is a parameter.
EXPLANATION = (
    "{platform} identified a revenue leakage event for asset {asset_id} under contract "
    "{contract_id} with {offtaker_name}.\n\n"
    "The Gold case fact estimates leakage of ${estimated_leakage_revenue_usd} and eligible "
    "compensable energy of {eligible_compensable_mwh} MWh. This explanation does not recalculate "
    "that amount; it relies on the curated Gold calculation.\n\n"
    "Contractual support is {ppa_support} from the linked PPA evidence. Operational support is "
    "{notice_support} from the ISO curtailment notice evidence. Settlement support is "
    "{statement_support} from the ISO settlement statement evidence.\n\n"
    "SAP context shows invoice {invoice_id} with invoice status {invoice_status}, open amount "
    "{open_amount_usd}, accounting document {accounting_doc_id}, and GL account {gl_account}. "
    "This provides finance and revenue-recognition context for the leakage case.\n\n"
    "Salesforce context shows account {account_name}, contract record {sf_contract_id}, and "
    "existing open dispute flag {existing_open_dispute_flag}. Existing dispute number is "
    "{existing_dispute_number}.\n\n"
    "Recommended next action: {recommended_next_action}. Salesforce create/update should not be "
    "automated yet because human approval is required."
)

# Fact labels of the case prompt, grouped by block.
PROMPT_FACTS = (
    ("Case Facts", (
        ("Breach Event ID", "breach_event_id"),
        ("Asset ID", "asset_id"),
        ("Asset Name", "asset_name"),
        ("Contract ID", "contract_id"),
        ("Offtaker", "offtaker_name"),
        ("Curtailment Reason", "curtailment_reason"),
        ("Eligible Compensable MWh", "eligible_compensable_mwh"),
        ("Estimated Leakage USD", "estimated_leakage_revenue_usd"),
        ("Breach Severity", "breach_severity"),
    )),
    ("SAP Context", (
        ("Invoice ID", "invoice_id"),
        ("Invoice Status", "invoice_status"),
        ("Open Amount USD", "open_amount_usd"),
        ("Accounting Doc ID", "accounting_doc_id"),
        ("GL Account", "gl_account"),
        ("Profit Center", "profit_center"),
    )),
    ("Salesforce Context", (
        ("Account Name", "account_name"),
        ("SF Account ID", "sf_account_id"),
        ("SF Contract ID", "sf_contract_id"),
        ("Existing Open Dispute", "existing_open_dispute_flag"),
        ("Existing Dispute Number", "existing_dispute_number"),
        ("Recommended Next Action", "recommended_next_action"),
    )),
)
PROMPT_EVIDENCE = (
    ("Evidence Rank", "context_rank"),
    ("Document Type", "document_type"),
    ("Evidence Role", "evidence_role"),
    ("Document ID", "document_id"),
)

# Verdict guard messages and terminal states.
VERDICT_FIELDS = (
    "dispute_warranted",
    "audited_variance_usd",
    "contract_id",
    "supporting_chunk_ids",
    "compliance_justification_rationale",
    "recommended_case_priority",
    "salesforce_case_subject",
    "salesforce_case_description",
)
PRIORITIES = ("Low", "Medium", "High")
DEFAULT_PRIORITY = "High"
VARIANCE_TOLERANCE_USD = 0.01
HIGH_VALUE_USD = 5000.0
MSG_NO_CHUNKS = "No evidence chunks were retrieved."
MSG_WRONG_CONTRACT = "Retrieved chunks from wrong contract: "
MSG_LOW_SIMILARITY = "Best evidence similarity %.3f is below threshold %.3f."
MSG_CONTRACT_MISMATCH = "Verdict contract_id does not match breach event contract_id."
MSG_VARIANCE_MISMATCH = "Verdict variance does not match Gold fact variance."
MSG_NO_CITATIONS = "Dispute is warranted but no supporting chunk IDs were provided."
MSG_UNKNOWN_CITATIONS = "Verdict cites chunks not present in retrieved evidence: "
MSG_ALT_CONTRACT = "Verdict contract_id does not match payload associated_ppa_id."
MSG_ALT_VARIANCE = "Verdict variance does not match deterministic Gold fact variance."
MSG_ALT_NO_EVIDENCE = "No retrieved contract evidence was available."
MSG_ALT_REFERENCE = "Evidence reference (%s, %s) was not retrieved from the contract store."
TERMINAL_QUARANTINED = "halted_or_quarantined"
TERMINAL_NO_DISPUTE = "no_dispute_warranted"
TERMINAL_NO_APPROVAL = "blocked_missing_human_approval"
TERMINAL_CREATED = "crm_case_created"
TERMINAL_FAILED = "crm_dispatch_failed"
PENDING = "PENDING"
APPROVED = "APPROVED"
REJECTED = "REJECTED"
APPROVAL_TYPE = "salesforce_case_dispatch"
APPROVAL_INSTRUCTIONS = "Approve, reject, or edit before any CRM write is executed."
DEFAULT_SUBJECT = "PPA Settlement Dispute"
MOCK_CREATE = "MOCK_CREATE_SALESFORCE_DISPUTE"
MOCK_UPDATE = "MOCK_UPDATE_SALESFORCE_DISPUTE"
MOCK_REVIEW = "MOCK_REVIEW_ONLY"
TOKEN_THRESHOLD = 4000
RETENTION_DAYS = 2555
