"""Constants that results depend on.

Word lists, thresholds, patterns, messages and templates in this file are fixed
values. They must not change if results are to stay comparable.
"""

# --- fixed values: enumerations -------------------------------------------------
TASK_STATUSES = ["pending", "processing", "completed", "failed", "cancelled", "retry"]
TASK_PRIORITIES = ["low", "normal", "high", "urgent"]
ANALYSIS_STATUSES = ["pending", "in_progress", "completed", "failed"]
ISSUE_TYPES = [
    "style", "bug", "performance", "security",
    "best_practice", "complexity", "maintainability", "documentation",
]
SEVERITIES = ["info", "low", "medium", "high", "critical"]  # ascending: position is the rank

# --- fixed values: aliases for incoming issue types and severities --------------
ISSUE_TYPE_ALIASES = {
    "unknown": "bug",
    "error": "bug",
    "warning": "best_practice",
    "info": "style",
    "quality": "maintainability",
}
SEVERITY_ALIASES = {"error": "high", "warning": "medium"}

# --- fixed values: text measures ------------------------------------------------
COMPLEXITY_KEYWORDS = ["if", "else", "elif", "for", "while", "try", "except", "finally"]
COMPLEXITY_CAP = 50
BLOCK_STARTERS = ["def ", "class ", "function ", "const ", "let ", "var "]
MIN_LINES_FOR_DUPLICATION = 10
MIN_LENGTH_FOR_DUPLICATION = 10
CODE_TEXT_LIMIT = 512
EMBEDDING_DIM = 384
EMBEDDING_BATCH = 32

# --- fixed values: quality thresholds -------------------------------------------
MAX_FUNCTION_LINES = 50
MAX_FILE_LINES = 500
MAX_COMPLEXITY = 10
MAX_DUPLICATION = 0.3
MAX_RETRIES = 3

# Characters removed by a whitespace strip, and the same set as a regex class.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"[\t\n\x0b\x0c\r\x1c-\x1f\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"

# --- fixed values: line patterns ------------------------------------------------
# The three statement patterns mean "these words in this order, then a plus sign".
# Each part is matched once, left to right, so a long line costs linear time.
SQL_INJECTION_PATTERNS = [
    r"(?is)\A(?>.*?SELECT)(?>.*?FROM)(?>.*?WHERE)(?>.*?=).*?\+",
    r"(?is)\A(?>.*?INSERT)(?>.*?VALUES).*?\+",
    r"(?is)\A(?>.*?UPDATE)(?>.*?SET)(?>.*?=).*?\+",
]
XSS_PATTERNS = [rf"innerHTML{SPACE}*=", r"document\.write\(", r"eval\("]
SENSITIVE_DATA_PATTERNS = [
    rf"(?i)(password|secret|key|token){SPACE}*={SPACE}*['\"][^'\"]+['\"]",
    rf"(?i)api_key{SPACE}*=",
]
UNTYPED_DEF_PATTERN = rf"^{SPACE}*def{SPACE}+{WORD}+{SPACE}*\([^)]*\){SPACE}*:"
VAR_PATTERN = rf"(^|[^\p{{L}}\p{{N}}_])var{SPACE}+"
DEF_NAME_PATTERN = rf"^{SPACE}*def{SPACE}+({WORD}+)"
SYMBOL_PATTERNS = [
    rf"def{SPACE}+({WORD}+)",
    rf"function{SPACE}+({WORD}+)",
    rf"class{SPACE}+({WORD}+)",
]
HTTPS_REPO_PATTERN = r"^https://github\.com/([\p{L}\p{N}_\-\.]+)/([\p{L}\p{N}_\-\.]+)/?$"
SSH_REPO_PATTERN = r"^git@github\.com:([\p{L}\p{N}_\-\.]+)/([\p{L}\p{N}_\-\.]+)\.git$"
REPO_HOST = "github.com"
SNAKE_CASE_PATTERN = r"^[a-z_][a-z0-9_]*$"

# --- fixed values: findings, as rule -> (type, severity, message, suggestion) ----
LINT_TEXTS = {
    "python.line_length": (
        "style", "low", "Line too long ({length} > 88 characters)", "Break long lines for better readability",
    ),
    "python.return_type": (
        "typing", "low", "Missing return type annotation",
        "Add return type annotation for better code documentation",
    ),
    "script.var": (
        "style", "medium", "Use 'let' or 'const' instead of 'var'",
        "Replace 'var' with 'let' or 'const' for better scoping",
    ),
    "script.console_log": (
        "style", "low", "Remove console.log statements", "Use proper logging library instead of console.log",
    ),
}

# --- fixed values: suggestions, as (type, priority, message, suggestion) ---------
WILDCARD_IMPORT = ("import", "medium", "Avoid wildcard imports", "Use explicit imports for better code clarity")
BARE_EXCEPT = (
    "exception_handling", "high", "Use specific exception types",
    "Catch specific exceptions instead of bare except clauses",
)
LOOSE_EQUALITY = ("comparison", "medium", "Use strict equality", "Use '===' instead of '==' for strict comparison")
LONG_FUNCTION = (
    "refactoring", "medium", "Function '{name}' is too long ({length} lines)",
    "Consider breaking large functions into smaller, focused functions",
)

# --- fixed values: review summary -------------------------------------------------
DEFAULT_AVERAGE = 75.0
EXCELLENT_FROM, GOOD_FROM, REFACTOR_BELOW = 85, 75, 70
LARGE_PR_FILES = 20
ADVISE_CRITICAL = "Address {count} critical security issues immediately"
ADVISE_REFACTORING = "Consider refactoring to improve code quality"
ADVISE_SPLITTING = "Large PR - consider breaking into smaller changes"
ADVISE_NOTHING = "Code looks good! Consider adding tests if not present"
ANALYSIS_TOOLS = ["ai_agent", "code_analyzer"]

# --- fixed values: progress reports of a review, as (progress, stage, message) ----
STAGES_BEFORE_FILES = [
    (0, "initializing", "Starting PR analysis..."),
    (10, "fetching_pr_data", "Fetching PR data from GitHub..."),
    (30, "analyzing_files", "Analyzing {files} files..."),
]
FILE_STAGE = ("analyzing_files", "Analyzing file {place}/{files}: {path}")
STAGES_AFTER_FILES = [
    (85, "generating_summary", "Generating analysis summary..."),
    (95, "saving_results", "Saving analysis results..."),
    (100, "completed", "Analysis completed successfully!"),
]

# --- fixed values: language rules -----------------------------------------------
LINE_LIMITS = {"python": 88, "javascript": 100, "typescript": 100}
WANTED_IMPORTS = {"python": ["typing", "logging"]}
WANTED_WORDS = {"javascript": ["const", "let"], "typescript": ["interface", "type"]}
UNWANTED_WORDS = {"javascript": ["var"]}

# --- fixed values: file extension to language -----------------------------------
LANGUAGE_BY_EXTENSION = {
    "py": "python", "pyw": "python", "pyi": "python",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript",
    "java": "java", "kt": "kotlin", "scala": "scala", "groovy": "groovy",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp",
    "cs": "csharp", "go": "go", "rs": "rust", "swift": "swift", "m": "objective-c",
    "rb": "ruby", "php": "php", "pl": "perl", "lua": "lua", "r": "r", "jl": "julia",
    "sh": "shell", "bash": "shell", "ps1": "powershell",
    "sql": "sql", "html": "html", "htm": "html", "css": "css", "scss": "scss", "less": "less",
    "xml": "xml", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml",
    "md": "markdown", "tex": "tex", "vue": "vue", "dart": "dart",
}

# --- fixed values: diff rules ---------------------------------------------------
SOURCE_SUFFIXES = [".py", ".js", ".ts", ".java"]
DOCUMENT_SUFFIXES = [".md", ".txt", ".json"]
TEST_WORDS = ["test", "spec", "mock"]
CONFIG_WORDS = ["config", "setting", "env"]

# --- fixed values: review request templates -------------------------------------
TEMPERATURE = 0.1
MAX_TOKENS = 4000
QUALITY_SYSTEM = (
    "You are an expert code reviewer. Analyze the provided code and return "
    "detailed quality metrics in JSON format."
)
SECURITY_SYSTEM = (
    "You are a security expert. Analyze the provided code for security "
    "vulnerabilities and return a JSON array of issues found."
)
SUGGESTIONS_SYSTEM = (
    "You are a senior software engineer. Provide constructive code improvement "
    "suggestions in JSON format."
)
# Each template is (text before the language, text after the fenced content).
PROMPT_FRAME = ("File: ", "```")
QUALITY_TEMPLATE = (
    "Analyze the following {language} code for quality metrics and issues:",
    """Provide a detailed analysis in JSON format with these fields:
- score: Overall quality score (0-10)
- issues: Array of specific issues found
- suggestions: Array of improvement suggestions
- metrics: Object with maintainability, readability, complexity scores (0-10)

Focus on:
- Code structure and organization
- Variable and function naming
- Code complexity and maintainability
- Best practices adherence
- Documentation quality
""",
)
SECURITY_TEMPLATE = (
    "Analyze the following {language} code for security vulnerabilities:",
    """Return a JSON array of security issues with these fields for each issue:
- type: Type of vulnerability (e.g., "sql_injection", "xss", "hardcoded_secret")
- severity: "low", "medium", "high", or "critical"
- title: Brief title of the issue
- description: Detailed description of the vulnerability
- line: Line number where the issue occurs
- recommendation: How to fix the issue

Look for:
- SQL injection vulnerabilities
- Cross-site scripting (XSS)
- Hardcoded secrets/passwords
- Insecure data handling
- Authentication/authorization issues
- Input validation problems
""",
)
SUGGESTIONS_TEMPLATE = (
    "Review the following {language} code and provide improvement suggestions:",
    """Return a JSON array of suggestions with these fields for each suggestion:
- type: Type of improvement (e.g., "performance", "readability", "best_practice")
- priority: "low", "medium", or "high"
- title: Brief title of the suggestion
- description: Detailed description of the improvement
- line: Line number where the improvement applies
- example: Optional code example showing the improvement

Focus on:
- Performance optimizations
- Code readability improvements
- Best practice adoption
- Error handling enhancements
- Code maintainability
""",
)

# --- fixed values: answers used when the model's answer is free text or missing --
FREE_TEXT_SCORE = 7.5
FREE_TEXT_METRICS = {"maintainability": 8, "readability": 7, "complexity": 6}
UNAVAILABLE_SUGGESTION = {
    "type": "configuration",
    "priority": "high",
    "title": "AI Service Not Configured",
    "description": "Set OPENROUTER_API_KEY environment variable to enable real AI-powered analysis",
}
