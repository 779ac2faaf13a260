"""Lists, tables, constants and patterns that results depend on. They are stated here once, as they are."""

from __future__ import annotations

# Kinds of files, by ending.
CODE_ENDINGS = [".py", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".ejs"]
DOCUMENT_ENDINGS = [".md", ".mdx", ".txt", ".rst", ".html"]
IMAGE_ENDINGS = [".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp"]
PAPER_ENDINGS = [".pdf", ".docx", ".tex", ".bib"]

# Names of files that may hold secrets; they are looked for anywhere in the name.
SENSITIVE_NAMES = [
    r"(?i)(^|[\\/])\.(env|envrc)(\.|$)",
    r"(?i)\.(pem|key|p12|pfx|cert|crt|der|p8)$",
    r"(?i)(credential|secret|passwd|password|token|private_key)",
    r"(id_rsa|id_dsa|id_ecdsa|id_ed25519)(\.pub)?$",
    r"(?i)(\.netrc|\.pgpass|\.htpasswd)$",
    r"(?i)(aws_credentials|gcloud_credentials|service.account)",
]

# Signs that a text is a paper; PAPER_LEAST of them make one.
PAPER_SIGNALS = [
    r"(?i)\barxiv\b",
    r"(?i)\bdoi\s*:",
    r"(?i)\babstract\b",
    r"(?i)\bproceedings\b",
    r"(?i)\bjournal\b",
    r"(?i)\bpreprint\b",
    r"\\cite\{",
    r"\[\d+\]",
    r"\[\n\d+\n\]",
    r"(?i)eq\.\s*\d+|equation\s+\d+",
    r"\d{4}\.\d{4,5}",
    r"(?i)\bwe propose\b",
    r"(?i)\bliterature\b",
]
PAPER_LEAST = 3

# Folders of what is made or installed, what such names end in, and files that tools write.
NOISE_FOLDERS = ["venv", ".venv", "env", ".env", "node_modules", "__pycache__", ".git", "dist", "build", "target", "out", "site-packages", "lib64", ".pytest_cache", ".mypy_cache", ".pyrefly_cache", ".ruff_cache", ".tox", ".eggs", "graph-out"]
NOISE_FOLDER_ENDINGS = ["_venv", "_env", ".egg-info"]
LOCK_FILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "Gemfile.lock", "composer.lock", "go.sum", "go.work.sum"]

# Words below which no graph is needed; words and files from which a tree is large.
FEW_WORDS = 50_000
MANY_WORDS = 500_000
MANY_FILES = 200

# Repository addresses: owner and name.
HTTPS_ADDRESS = r"^https://[^/]+/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?/?$"
SSH_ADDRESS = r"^git@[^:]+:([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?$"

# The graph's schema.
NODE_KINDS = ["code", "document", "paper", "image", "rationale", "video"]
CONFIDENCE_LABELS = ["EXTRACTED", "INFERRED", "AMBIGUOUS"]
STRUCTURAL_RELATIONS = ["imports", "imports_from", "contains", "method"]
SURPRISE_POINTS = {"AMBIGUOUS": 3, "INFERRED": 2, "EXTRACTED": 1}

# Weights of relations, and how the words of a query change them (later rules win).
RELATION_WEIGHTS = {"imports": 0.3, "imports_from": 0.3, "contains": 0.15, "method": 0.3, "calls": 0.7, "uses": 0.7, "inherits": 0.8, "rationale_for": 0.9, "semantically_similar_to": 1.0}
INTENT_RULES = [
    (["flow", "process", "work", "how"], {"calls": 0.9, "uses": 0.9}),
    (["schema", "structure", "fields", "columns", "table"], {"contains": 0.5}),
    (["inherit", "extend", "implement", "subclass"], {"inherits": 0.95}),
    (["similar", "like", "compare", "related"], {"semantically_similar_to": 1.1}),
]

# What the comments that explain begin with.
REASON_MARKS = ["NOTE:", "IMPORTANT:", "HACK:", "WHY:", "RATIONALE:", "TODO:", "FIXME:"]

# How services say that a text is too long, and that one failed that may answer again.
CONTEXT_MARKERS = ["available context size", "context length", "context_length", "context size", "context window", "context_length_exceeded", "maximum context", "max context", "too many tokens", "input is too long"]
CONTEXT_PATTERNS = [
    r"\brequest\b.{0,120}\btokens\b.{0,120}\bexceed",
    r"\binput\b.{0,120}\btokens\b.{0,120}\bexceed",
    r"\bexceed\w*\b.{0,120}\bcontext\b",
    r"\bmaximum\b.{0,120}\btokens\b",
]
CRASH_MARKER = "llama.cpp terminated unexpectedly"
