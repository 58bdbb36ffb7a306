"""Fixed values. They have to be exactly these for the results to be right."""

# --- score weights, in signal order -------------------------------------------------
SIGNAL_WEIGHTS = {
    "genericNames": 15,
    "commentRatio": 12,
    "obviousComments": 10,
    "emptyCatch": 10,
    "nullChecks": 8,
    "formattingUniformity": 8,
    "universalJsdoc": 7,
    "namingEntropy": 10,
    "boilerplatePatterns": 10,
    "helperOrdering": 10,
    "emojiComments": 10,
    "perplexity": 12,
    "burstiness": 12,
}
DEFAULT_THRESHOLD = 9
NO_VALUE = "undefined"  # what a missing number reads as inside an identifier
BASELINE_NOTE = "baseline captured; future scans will show new and resolved findings"
MAX_FILE_SIZE = 1_048_576
HIGH_RISK_SCORE = 65
BAND_CUTS = (40, 70)

# --- severities, most severe first --------------------------------------------------
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
SEVERITY_RISK = {"CRITICAL": 8, "HIGH": 5, "MEDIUM": 2, "LOW": 1}
BLOCK_ON = ("CRITICAL", "HIGH")
BANDS = ("LOW", "UNCERTAIN", "HIGH")
REGRESSION_RISK_CHANGE = 5

# --- paths --------------------------------------------------------------------------
CLI_EXTENSIONS = (".js", ".jsx", ".ts", ".tsx")
WEB_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".mts")
CALIBRATION_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")
CLI_IGNORED_DIRS = (
    "node_modules", "dist", "build", ".git", "coverage", ".next", ".nuxt", ".svelte-kit",
    ".turbo", ".cache", ".parcel-cache", ".vite", ".vercel", ".vscode", ".idea", "tmp",
    "temp", "out",
)
WEB_IGNORED_DIRS = (
    "node_modules", "dist", "build", ".git", "coverage", ".next", "__pycache__", ".venv",
)
DEFAULT_EXCLUDES = (
    "node_modules/", "dist/", "build/", ".git/", "coverage/", "test/", "tests/", "__tests__/",
)

# --- word lists ---------------------------------------------------------------------
GENERIC_NAMES = (
    "data", "result", "results", "item", "items", "value", "values", "temp", "obj", "arr",
    "response", "payload", "config", "options",
)
OBVIOUS_COMMENT_VERBS = (
    "set", "get", "return", "create", "update", "delete", "loop", "check", "initialize",
    "calculate", "fetch",
)
# Reserved words of the scanned language (ECMAScript), which are not identifiers.
RESERVED_WORDS = (
    "async", "await", "break", "case", "catch", "class", "const", "continue", "debugger",
    "default", "delete", "do", "else", "export", "extends", "false", "finally", "for",
    "function", "if", "import", "in", "instanceof", "let", "new", "null", "of", "return",
    "static", "super", "switch", "this", "throw", "true", "try", "typeof", "var", "void",
    "while", "with", "yield",
)

# --- patterns -----------------------------------------------------------------------
# White space as the scanned language defines it (body of a character class). The rare part
# stands behind one range test, which ordinary text fails at once.
WS_PLAIN = r"\t\n\x0B\f\r \x{A0}"
WS_RARE = r"\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS = rf"{WS_PLAIN}[\x{{1680}}-\x{{FEFF}}&&[{WS_RARE}]]"
# The same class without the line feed, for patterns that must stay on one line.
WS_INLINE = WS.replace(r"\n", "")
# The same set as plain characters, for trimming.
WS_CHARACTERS = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WORD_START = r"(?<![A-Za-z0-9_])"
WORD_END = r"(?![A-Za-z0-9_])"
EMPTY_CATCH = (
    rf"catch[{WS}]*\([^)]*\)[{WS}]*\{{[{WS}]*"
    rf"(?:console\.(?:error|log)\([^)]*\);[{WS}]*)?\}}"
)
NULL_CHECKS = (
    rf"\?\?|\?\.|typeof[{WS}]+[A-Za-z0-9_]+[{WS}]*===[{WS}]*['\"]undefined['\"]"
    rf"|!==[{WS}]*null|===[{WS}]*null"
)
HELPER_DEFINITIONS = rf"(?i)function[{WS}]+(?:validate|format|process|handle|create|update)[A-Za-z0-9_]*"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
DOC_COMMENT_BEFORE = rf"(?s)/\*\*.*?\*/[{WS}]*$"
DOC_COMMENT_LOOKBACK = 400

# --- detectors ----------------------------------------------------------------------
INVALID_CALLS = {
    "axios.fetchData": rf"axios\.fetchData[{WS}]*\(",
    "fs.readFilePromise": rf"fs\.readFilePromise[{WS}]*\(",
    "express.createServer": rf"express\.createServer[{WS}]*\(",
    "prisma.connect": rf"prisma\.connect[{WS}]*\(",
}
SECRET_RULES = {
    "aws-access-key": r"AKIA[0-9A-Z]{16}",
    "github-token": r"gh[ps]_[A-Za-z0-9_]{36,}",
    "jwt": r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    "private-key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "password": r"(?i)(?:password|passwd|pwd)[\"']?\s*[:=]\s*[\"'][^\"'\n]{4,}[\"']",
    "generic-api-key": r"(?i)(?:api_key|apikey|token|secret)[\"']?\s*[:=]\s*[\"'][A-Za-z0-9_\-./+=]{8,}[\"']",
}
LITERAL = r"\"[^\"\n]*\"|'[^'\n]*'"
LITERAL_ENTROPY = 4.5
LITERAL_MIN_LENGTH = 20
HEX_LITERAL = r"^[0-9a-fA-F]{40}$"
# Literals that look random but are no secrets: URLs, paths, messages, CSS colours.
HARMLESS_LITERAL = r"(?i)^[a-z][a-z0-9+.-]*://|^\.{0,2}/|\s|^#[0-9a-f]{3,8}$"

SEVERITY_BY_KIND = {  # kind: (score >= 65, below)
    "secret": ("CRITICAL", "HIGH"),
    "known-vulnerability": ("HIGH", "MEDIUM"),
    "insecure-pattern": ("MEDIUM", "LOW"),
    "code-quality": ("MEDIUM", "LOW"),
}
RULE_TAXONOMY = {  # category: substrings of a rule id
    "injection": ("injection", "sql", "xss", "command", "child-process"),
    "credential-exposure": ("secret", "password", "token", "api-key", "credential", "private-key", "jwt"),
    "unsafe-dynamic-exec": ("eval", "dynamic", "non-literal-require", "function-constructor"),
    "weak-crypto": ("crypto", "md5", "sha1", "pseudorandom"),
    "data-exposure": ("privacy", "pii", "logging", "data-exposure"),
    "insecure-config": ("cors", "header", "tls", "https", "csrf"),
}

# --- scanners -----------------------------------------------------------------------
SCANNER_SOURCES = {  # configuration key: source tag
    "semgrep": "semgrep",
    "eslint": "eslint",
    "npmAudit": "npm-audit",
    "nodejsscan": "nodejsscan",
    "bearer": "bearer",
}
ESLINT_RULES = (
    "security/detect-unsafe-regex",
    "security/detect-eval-with-expression",
    "security/detect-non-literal-fs-filename",
    "security/detect-non-literal-require",
    "security/detect-object-injection",
    "security/detect-possible-timing-attacks",
    "security/detect-no-csrf-before-method-override",
    "security/detect-buffer-noassert",
    "security/detect-child-process",
    "security/detect-disable-mustache-escape",
    "security/detect-new-buffer",
    "security/detect-pseudoRandomBytes",
)
NPM_SEVERITY_ORDER = ("low", "moderate", "high", "critical")
NODEJSSCAN_CATEGORIES = (  # first match wins
    ("injection", ("injection", "sql")),
    ("xss", ("xss", "cross-site")),
    ("unsafe-code-execution", ("eval", "code execution")),
    ("weak-cryptography", ("crypto", "encryption")),
    ("authentication", ("auth", "session")),
    ("misconfiguration", ("header", "cors")),
)
BEARER_CATEGORIES = (
    ("injection", ("injection", "sql")),
    ("xss", ("xss", "cross-site")),
    ("authentication", ("auth", "authentication")),
    ("weak-cryptography", ("crypto", "encryption")),
    ("misconfiguration", ("header", "cors")),
)
DOCKER_DOWN_MARKS = ("dockerDesktopLinuxEngine", "docker: error during connect")
DOCKER_DOWN_NOTE = "nodejsscan skipped because Docker is not running or not reachable"

# --- retention and limits -----------------------------------------------------------
HISTORY_LINES_KEPT = 300
SCANS_KEPT = 20
MAX_FAILED_ATTEMPTS = 5
LOCK_MINUTES = 15
SCANS_PER_HOUR = 10
REPO_SIZE_LIMIT = 100 * 1024 * 1024
EMAIL_SHAPE = rf"^[^{WS}@]+@[^{WS}@]+\.[^{WS}@]+$"

# --- repository URL messages --------------------------------------------------------
URL_MISSING = "repoUrl is required"
URL_INVALID = "repoUrl must be a valid URL"
URL_NOT_HTTPS = "Only https repository URLs are allowed"
URL_PRIVATE = "Private or local repository hosts are not allowed"
