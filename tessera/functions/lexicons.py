"""Fixed values that decide results: word lists, lookup tables, patterns and weights."""

# Domains, source tiers and precedence.
DOMAINS = ("technical", "business", "compliance")
AUTHORITY_WEIGHTS = {"policy": 1.00, "standard": 0.85, "runbook": 0.65, "wiki": 0.40}
DEFAULT_AUTHORITY = "wiki"
DOMAIN_PRECEDENCE = {"compliance": 1.00, "business": 0.85, "technical": 0.70}
DEFAULT_PRECEDENCE = 0.70

# Function words that are not index terms.
STOPWORDS = tuple("""
a about above after again against all am an and any are aren as at be because been
before being below between both but by can cannot could couldn did didn do does
doesn doing don down during each few for from further had hadn has hasn have haven
having he her here hers herself him himself his how i if in into is isn it its
itself just ll me more most mustn my myself no nor not now o of off on once only or
other our ours ourselves out over own re s same shan she should shouldn so some such
t than that the their theirs them themselves then there these they this those through
to too under until up ve very was wasn we were weren what when where which while who
whom why will with won would wouldn you your yours yourself yourselves
""".split())

# Words that turn a statement's polarity.
NEGATION_MARKERS = (
    "not", "never", "no", "cannot", "prohibited", "forbidden", "disallowed", "must-not", "may-not",
    "banned", "denied", "refuse", "reject", "rejected", "withdrawn",
)

# Numbers written as words.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16,
    "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50,
    "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000,
}

# Unit, family, multiplier to the family's base unit.
UNITS = (
    ("second", "duration", 1 / 86400), ("seconds", "duration", 1 / 86400), ("minute", "duration", 1 / 1440),
    ("minutes", "duration", 1 / 1440), ("hour", "duration", 1 / 24), ("hours", "duration", 1 / 24),
    ("day", "duration", 1.0), ("days", "duration", 1.0), ("week", "duration", 7.0), ("weeks", "duration", 7.0),
    ("month", "duration", 30.0), ("months", "duration", 30.0), ("quarter", "duration", 91.0),
    ("quarters", "duration", 91.0), ("year", "duration", 365.0), ("years", "duration", 365.0),
    ("percent", "ratio", 1.0), ("eur", "currency", 1.0), ("usd", "currency", 1.0), ("reviewer", "people", 1.0),
    ("reviewers", "people", 1.0), ("approver", "people", 1.0), ("approvers", "people", 1.0),
    ("signatory", "people", 1.0), ("signatories", "people", 1.0), ("replica", "count", 1.0),
    ("replicas", "count", 1.0), ("attempt", "count", 1.0), ("attempts", "count", 1.0), ("retry", "count", 1.0),
    ("retries", "count", 1.0),
)

# Intents in the order in which they are tried, with their cues.
INTENTS = (
    ("approval", ("approval", "approve", "approver", "sign-off", "sign off", "authorise", "authorize", "who signs", "who can approve")),
    ("diagnostic", ("troubleshoot", "debug", "diagnose", "why is", "why are", "root cause", "slow", "failing", "degraded", "investigate", "latency spike", "outage")),
    ("comparative", ("versus", "vs", "compare", "trade-off", "tradeoff", "build or buy", "better than", "difference between")),
    ("procedural", ("process for", "how do i", "how to", "steps", "procedure", "runbook", "workflow for", "what's the process", "what is the process", "implement", "deploy")),
    ("requirement", ("required", "requirement", "needed", "must", "mandatory", "checks", "obligation", "policy on", "rules for", "am i allowed", "permitted")),
    ("definitional", ("what is", "what are", "define", "definition of", "meaning of", "explain")),
)
DEFAULT_INTENT = "requirement"
PROCEDURAL_INTENTS = ("diagnostic", "procedural")

# Routing cues by domain.
DOMAIN_CUES = {
    "technical": {
        "deploy": 2.0, "deployment": 2.0, "microservice": 2.5, "canary": 2.0, "rollback": 1.8, "api": 1.8,
        "latency": 2.2, "performance": 1.8, "troubleshoot": 2.0, "debug": 1.8, "database": 1.8, "query": 1.2,
        "kubernetes": 2.2, "container": 1.8, "pipeline": 1.5, "cache": 1.8, "timeout": 1.8, "observability": 2.0,
        "trace": 1.5, "tracing": 1.8, "logs": 1.2, "incident": 1.5, "build": 1.2, "endpoint": 1.8,
        "throughput": 1.8, "scaling": 1.8, "replica": 1.8, "index": 1.5, "architecture": 1.3, "runbook": 1.3,
        "infrastructure": 1.5, "terraform": 2.0, "p99": 2.5, "schema": 1.3, "retry": 1.5, "connection": 1.5,
        "monitoring": 1.3, "service": 1.0, "code": 1.2,
    },
    "business": {
        "approval": 2.0, "approve": 2.0, "approver": 2.0, "budget": 2.2, "cost": 1.8, "spend": 2.0,
        "procurement": 2.5, "vendor": 1.8, "contract": 1.8, "headcount": 2.5, "hiring": 2.0, "roi": 2.2,
        "business": 1.8, "stakeholder": 2.0, "prioritisation": 2.0, "prioritization": 2.0, "intake": 1.8,
        "kpi": 2.2, "council": 1.8, "authority": 1.8, "delegation": 2.0, "finance": 2.2, "investment": 2.0,
        "sla": 1.8, "forecast": 2.0, "procure": 2.0, "purchase": 2.0, "sign-off": 2.0, "governance": 1.5,
        "eur": 1.5, "committee": 1.5, "benefit": 1.5, "capacity": 1.3, "roadmap": 1.8, "showback": 2.2,
    },
    "compliance": {
        "compliance": 2.5, "gdpr": 2.5, "privacy": 2.2, "dpia": 2.5, "retention": 2.0, "audit": 2.2,
        "policy": 1.6, "policies": 1.6, "security": 1.8, "regulation": 2.2, "regulatory": 2.2, "consent": 2.2,
        "breach": 2.2, "segregation": 2.2, "encryption": 2.0, "lawful": 2.5, "residency": 2.2,
        "subprocessor": 2.5, "classification": 1.8, "personal": 1.8, "pii": 2.5, "control": 1.5,
        "controls": 1.5, "evidence": 1.8, "cab": 2.0, "soc2": 2.5, "attestation": 2.2, "least privilege": 2.2,
        "access": 1.3, "confidential": 2.0, "restricted": 1.8, "anonymisation": 2.2, "data protection": 2.5,
        "change control": 2.2, "exception": 1.5, "risk": 1.3, "legal": 1.8, "am i allowed": 2.2,
        "allowed to": 1.6, "may i": 1.6, "is it ok": 1.6, "permitted": 1.8, "can i": 1.1,
    },
}

# Patterns at which a compound question is cut, tried in this order.
CLAUSE_SPLITTERS = (
    r"\s+while\s+(?:also\s+)?", r"\s+as\s+well\s+as\s+", r"\s*,\s*and\s+", r"\s*;\s*",
    r"\s+and\s+(?:what|which|who|how|whether|any|the\s+\w+\s+)", r"\s+and\s+also\s+",
    r"\s*\?\s*(?=[A-Za-z])", r"\s+but\s+",
)
QUESTION_WORD = r"\b(what|which|who|whom|whose|when|where|why|how)\b"
WORD = r"[a-z0-9]+(?:[-'][a-z0-9]+)*"
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z(])"

# Words that frame a question without naming its subject.
META_TERMS = (
    "process", "processes", "step", "steps", "procedure", "approach", "way", "thing", "things", "check",
    "checks", "need", "needed", "needs", "require", "required", "requirement", "requirements", "following",
    "follow", "also", "well", "place", "use", "used", "doing", "get", "getting", "make", "take", "what's",
    "whats", "how's", "it's", "there's", "let's",
)

# What domains share (dimension, value, substrings) and what it adds to a query.
CONTEXT_CUES = (
    ("environment", "production", ("production", "prod ", "live traffic", "customer-facing")),
    ("environment", "staging", ("staging", "pre-production", "test environment")),
    ("data_sensitivity", "personal_data", ("personal data", "pii", "customer data", "data subject", "special category", "gdpr")),
    ("data_sensitivity", "restricted", ("restricted", "payment credential", "authentication secret", "credentials")),
    ("data_sensitivity", "internal", ("internal use", "internal only")),
    ("change_type", "deployment", ("deploy", "deployment", "release", "rollout", "ship")),
    ("change_type", "new_workflow", ("new data processing", "new workflow", "implement a new", "new pipeline")),
    ("change_type", "diagnosis", ("troubleshoot", "debug", "diagnose", "incident", "latency spike")),
    ("change_type", "procurement", ("vendor", "procure", "purchase", "contract", "subprocessor")),
    ("governing_body", "change_advisory_board", ("change advisory board", "cab")),
    ("governing_body", "data_governance_council", ("data governance council", "governance council")),
    ("governing_body", "data_protection_officer", ("data protection officer", "dpo")),
    ("governing_body", "security_team", ("security team",)),
)
CONTEXT_EXPANSIONS = (
    ("environment", "production", ("production", "change control")),
    ("data_sensitivity", "personal_data", ("personal data", "lawful basis", "retention")),
    ("data_sensitivity", "restricted", ("restricted", "encryption", "access control")),
    ("change_type", "deployment", ("change record", "approval", "release")),
    ("change_type", "new_workflow", ("processing register", "impact assessment", "sign-off")),
    ("change_type", "diagnosis", ("diagnostics", "logging", "payload")),
    ("change_type", "procurement", ("due diligence", "data processing agreement")),
    ("governing_body", "change_advisory_board", ("change advisory board approval",)),
    ("governing_body", "data_governance_council", ("council sign-off",)),
)

# Anchors too general to prove one subject (stems), and markers of procedures and rules.
GENERIC_ANCHORS = (
    "retain", "requir", "sampl", "keep", "set", "review", "complet", "approv", "exceed", "appli", "use",
    "includ", "provid", "must", "need", "allow", "expir", "raise", "report", "record", "document", "perform",
    "run", "take", "within", "least", "than", "after", "befor", "everi", "each", "default", "standard",
    "normal", "typic", "gener", "other",
)
PROCEDURAL_MARKERS = (
    "begin", "start", "first", "next", "then", "check", "verify", "confirm", "inspect", "identify",
    "decompose", "review", "run", "use", "open", "collect", "measure", "compare", "look", "trace", "triage",
    "diagnose", "reproduce", "enable", "disable", "restart", "roll", "rollback", "escalate", "follow",
    "ensure", "set", "configure", "apply", "raise", "lower", "increase",
)
OBLIGATION_MARKERS = (
    "must", "required", "require", "requires", "shall", "mandatory", "prohibited", "forbidden", "may",
    "cannot", "need", "needs", "should", "obliged", "expected", "permitted", "allowed", "blocked", "rejected",
    "enforced", "triggers", "approved", "approval", "withdrawn", "banned",
)
CONFIDENCE_BANDS = ((0.70, "high"), (0.45, "moderate"), (0.0, "low"))
