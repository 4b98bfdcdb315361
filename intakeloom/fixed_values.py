"""Word lists, patterns, limits and messages.

Everything in this module is data that query results depend on.  The order of
dictionaries and lists matters: ties between labels go to the earlier entry and
the first listed word that occurs wins.  Operators turn these values into Spark
column expressions; nothing here is executed on its own.
"""

# ---------------------------------------------------------------- fixed values
# Intent phrases, matched as substrings of the lower-cased text.
INTENT_PHRASES = {
    "rfq": ["request for quote", "rfq", "quotation request", "price inquiry"],
    "invoice": ["invoice", "bill", "payment due", "amount owed", "total due"],
    "complaint": ["complaint", "issue", "problem", "dissatisfied", "concern"],
    "regulation": ["regulation", "compliance", "policy", "guideline", "standard"],
    "contract": ["contract", "agreement", "terms", "conditions", "legal"],
    "order": ["purchase order", "order", "buy", "procurement"],
    "inquiry": ["inquiry", "question", "information", "help", "support"],
}

# Document types of page texts, matched the same way.
DOCUMENT_TYPE_WORDS = {
    "invoice": ["invoice", "bill", "payment", "amount due", "total", "tax"],
    "complaint": ["complaint", "issue", "problem", "concern", "dissatisfied", "resolve"],
    "rfq": ["request for quote", "rfq", "proposal", "bid", "quotation", "tender"],
    "report": ["report", "analysis", "summary", "findings", "conclusion", "executive"],
    "contract": ["agreement", "contract", "terms", "conditions", "party", "whereas"],
}

# Urgency levels, highest first.
URGENCY_WORDS = {
    "high": ["urgent", "asap", "immediately", "critical", "emergency", "rush"],
    "medium": ["soon", "priority", "important", "expedite"],
    "low": ["when convenient", "no rush", "whenever possible"],
}

# Sentiment and sender intent of replies that are not JSON, first hit wins.
SENTIMENT_WORDS = {
    "positive": ["happy", "great", "excellent", "good", "satisfied"],
    "negative": ["angry", "upset", "terrible", "bad", "complaint"],
}
SENDER_INTENT_WORDS = {
    "request": ["request", "need", "want", "asking"],
    "inquiry": ["question", "ask", "inquiry", "wondering"],
    "complaint": ["complaint", "problem", "issue", "wrong"],
}

# Case progress words of complaints, first hit wins.
COMPLAINT_STATUS_WORDS = ["resolved", "pending", "open", "closed", "in progress"]

# A line of an invoice is an item line when it has a price and one of these.
ITEM_LINE_WORDS = ["qty", "quantity", "item", "description"]
ITEM_LINE_PRICE = r"\$\d+"

# Marks of an e-mail, searched in the lower-cased text; two make an e-mail.
MAIL_MARKS = [
    r"from:.*?@.*?\.",
    r"to:.*?@.*?\.",
    r"subject:",
    r"dear\s+\w+",
    r"sincerely|regards|best\s+regards",
]
# Words without which the mark of the same place cannot match; for "subject:"
# and the sign-off the word alone decides.
MAIL_MARK_WORDS = [["from:"], ["to:"], ["subject:"], ["dear"], ["sincerely", "regards"]]

# Entities of e-mails.
EMAIL_ADDRESS = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
MAIL_PHONE = r"(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
MAIL_DATE = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b"
MAIL_MONEY = r"\$\s?\d+(?:,\d{3})*(?:\.\d{2})?"
MAIL_REFERENCE = r"(?:order|invoice|ref|reference)(?:\s*#?\s*:?\s*)([A-Z0-9-]+)"

# Entities of page texts.
PAGE_PHONE = r"(\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
PAGE_DATE = r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2}"
PAGE_CURRENCY = r"\$\d+(?:,\d{3})*(?:\.\d{2})?"
STREET_ADDRESS = (
    r"\d+\s+[A-Za-z\s]+"
    r"(?:Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Lane|Ln|Boulevard|Blvd)[^\n]*"
)
COMPANY_NAME = (
    r"(?:company|corp|corporation|inc|llc|ltd)[\s:]*([A-Z][A-Za-z\s&.,]+?)(?:\n|$)"
)

# Fields of page texts by document type: group 1 of the first match.
PAGE_FIELDS = {
    "invoice": {
        "invoice_number": r"(?:invoice|inv)\s*(?:number|#|no)[\s:]*([A-Z0-9-]+)",
        "date": r"(?:date|issued)[\s:]*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2})",
        "amount": r"(?:total|amount|due)[\s:]*\$?(\d+(?:,\d{3})*(?:\.\d{2})?)",
        "vendor": r"(?:from|vendor|company)[\s:]*([A-Za-z\s&.,]+?)(?:\n|$)",
        "customer": r"(?:to|bill\s+to|customer)[\s:]*([A-Za-z\s&.,]+?)(?:\n|$)",
    },
    "complaint": {
        "case_number": r"(?:case|complaint|ticket)\s*(?:number|#|no)[\s:]*([A-Z0-9-]+)",
        "date": r"(?:date|filed|submitted)[\s:]*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2})",
        "complainant": r"(?:complainant|filed\s+by|name)[\s:]*([A-Za-z\s.,]+?)(?:\n|$)",
        "subject": r"(?:subject|regarding|issue)[\s:]*([^\n]+)",
        "priority": r"(?:priority|urgency|level)[\s:]*([A-Za-z]+)",
    },
    "rfq": {
        "rfq_number": r"(?:rfq|request)\s*(?:number|#|no)[\s:]*([A-Z0-9-]+)",
        "due_date": r"(?:due|deadline|by)[\s:]*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2})",
        "project": r"(?:project|for)[\s:]*([^\n]+)",
        "contact": r"(?:contact|email|phone)[\s:]*([A-Za-z0-9@._\s-]+)",
    },
    "report": {
        "title": r"(?:title|report|subject)[\s:]*([^\n]+)",
        "date": r"(?:date|prepared|generated)[\s:]*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2})",
        "author": r"(?:author|prepared\s+by|by)[\s:]*([A-Za-z\s.,]+?)(?:\n|$)",
        "department": r"(?:department|division|unit)[\s:]*([A-Za-z\s&.,]+?)(?:\n|$)",
    },
}
INVOICE_TAX = r"tax[\s:]*\$?(\d+(?:,\d{3})*(?:\.\d{2})?)"
# A description or a requirement runs to the end of its line.
COMPLAINT_DESCRIPTION = r"(?:description|details|issue)[\s:]*([^\n]+)"
RFQ_REQUIREMENTS = r"(?:requirements|specifications|scope)[\s:]*([^\n]+)"
RFQ_DELIVERY = r"(?:delivery|timeline|schedule)[\s:]*([^\n]+)"

# JSON documents: required keys and types, by schema and path.
JSON_REQUIRED = {
    "invoice": ["header", "summary"],
    "order": ["order_id", "customer", "items"],
    "product": ["id", "name", "price"],
}
JSON_TYPES = {
    "invoice": {
        "header": "object",
        "header.invoice_number": "string",
        "header.invoice_date": "string",
        "header.due_date": "string",
        "summary": "object",
        "summary.total_amount": "number",
        "vendor": "object",
        "customer": "object",
        "line_items": "array",
    },
    "order": {
        "order_id": "string",
        "customer": "string",
        "items": "array",
        "total": "number",
        "status": "string",
    },
    "product": {
        "id": "string",
        "name": "string",
        "price": "number",
        "category": "string",
        "description": "string",
    },
}
JSON_NESTED_REQUIRED = {
    "invoice": [
        "header.invoice_number",
        "header.invoice_date",
        "header.due_date",
        "summary.total_amount",
    ],
    "order": [],
    "product": [],
}

# File admission.
MAX_FILE_MB = 25
RETENTION_HOURS = 24
FILE_TYPE_BY_EXTENSION = {
    ".pdf": "pdf",
    ".json": "json",
    ".txt": "email",
    ".eml": "email",
    ".msg": "email",
}
FORMAT_BY_EXTENSION = {
    ".pdf": "PDF",
    ".json": "JSON",
    ".jsonl": "JSON",
    ".txt": "EMAIL",
    ".eml": "EMAIL",
    ".msg": "EMAIL",
}
MIME_BY_EXTENSION = {
    ".pdf": "application/pdf",
    ".json": "application/json",
    ".txt": "text/plain",
    ".eml": "message/rfc822",
    ".csv": "text/csv",
    ".html": "text/html",
    ".xml": "text/xml",
}
KNOWN_FORMATS = ["EMAIL", "JSON", "PDF"]
AGENT_BY_FORMAT = {
    "PDF": "pdf_agent",
    "JSON": "json_agent",
    "EMAIL": "email_agent",
    "TEXT": "email_agent",
}
DEFAULT_AGENT = "email_agent"
# Names the extractors sign ledger records with, by route.
RECORDED_AGENT = {"email": "email", "json": "json_agent", "pdf": "pdf_agent"}
CLASSIFIER = "classifier"

# Thresholds and scores.
RULE_ACCEPT = 0.7
REPLY_ACCEPT = 0.5
NO_RULE = ("unknown", 0.1)
NO_REPLY = ("unknown", 0.3)
MAIL_FACTORS = {"sender": 0.8, "subject": 0.7, "topic": 0.9, "intent": 0.8}
MAIL_NO_FACTORS = 0.5
MIN_MAIL_CHARS = 10
PREVIEW_CHARS = 200
FIELD_CHARS = 500

# Text windows shown to a model.
INTENT_PROMPT_CHARS = 1000
MAIL_PROMPT_CHARS = 1500
PAGE_PROMPT_CHARS = 2000

# Defaults of the six reply fields of an e-mail.
MAIL_REPLY_DEFAULTS = {
    "main_topic": "Unknown",
    "sender_intent": "Unknown",
    "key_entities": [],
    "action_required": "Review required",
    "deadline_mentioned": None,
    "sentiment": "neutral",
}

# Messages.
UNKNOWN_SCHEMA = "Unknown schema type"
NO_FIELDS = "No fields extracted"
JSON_NOT_VALID = "JSON data failed schema validation"
JSON_ANOMALY = "Anomalies detected in JSON data"
JSON_DONE = "JSON processing completed successfully"
PAGES_MANY = "Consider document summarization for large PDFs"
PAGES_FEW_WORDS = "Document appears to have minimal text content - check for scan quality"
PAGES_FEW_FIELDS = "Limited structured data extracted - consider manual review"
PAGES_NO_AMOUNT = "Invoice amount not detected - verify document completeness"
PAGES_NO_DESCRIPTION = "Complaint description not found - check document structure"
PAGES_TABLES = "Document contains tables - consider structured data extraction"
PAGES_DONE = "Document processing completed successfully"
MANUAL_REVIEW = "Manual review required due to processing error"

# Ledger.
RECENT_LIMIT = 50
SEARCH_LIMIT = 20
LEDGER_DEFAULTS = {
    "sender": "",
    "urgency": "normal",
    "extracted_fields": "{}",
    "processed_by": "",
    "thread_id": "",
    "confidence_score": 0.0,
    "status": "pending",
    "error_message": "",
    "file_size": 0,
    "processing_time": 0.0,
}
SUCCESS_STATUSES = ["completed"]
FAILURE_STATUSES = ["failed", "error", "ERROR"]
# ---------------------------------------------------------- end of fixed values
