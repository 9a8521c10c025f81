"""Fixed value sets and Spark schemas of a code-review run.

JSON schemas are declared here and never inferred.  The enumerations and the
artifact names are fixed values that review data has to match.
"""

# Fixed values.
ISSUE_TYPES = ["Syntax", "Logical", "Runtime", "Performance", "Security"]
SEVERITIES = ["Low", "Medium", "High"]
LANGUAGES = ["typescript", "javascript"]
RECORDED, LIVE = SOURCE_KINDS = ["bob", "watsonx"]
STAGES = ["analyze", "fix", "test", "report"]
STATUSES = ["running", "done", "error"]
EVENT_TYPES = ["stage", "result", "error"]
SUPPORTED_EXTENSIONS = [".ts", ".js"]
VERSIONS = ["original", "fixed"]
SAFE_INTEGER = 2**53 - 1

ISSUE = (
    "struct<id: string, type: string, description: string, line: bigint, "
    "severity: string, suggestion: string>"
)
ANALYSIS = f"struct<errors: array<{ISSUE}>, risk_level: string, summary: string>"
FIX_ITEM = "struct<issueId: string, change: string>"
FIX = f"struct<fixedCode: string, fixes: array<{FIX_ITEM}>>"
CASE = "struct<name: string, issueId: string>"
TESTS = f"struct<framework: string, code: string, cases: array<{CASE}>>"
SUMMARY = "struct<summary: string, recommendations: array<string>>"
SOURCE = "struct<kind: string, model: string, recordedAt: string, author: string>"
TEST_RUN = "struct<passed: bigint, failed: bigint, total: bigint>"
VERIFICATION = f"struct<command: string, original: {TEST_RUN}, fixed: {TEST_RUN}>"
DETECTION = "struct<expected: bigint, caught: bigint, missed: array<string>>"
TIMINGS = (
    "struct<analyzeMs: double, fixMs: double, testMs: double, "
    "reportMs: double, totalMs: double, method: string>"
)
REPORT = (
    "struct<schemaVersion: int, id: string, title: string, fileName: string, "
    f"language: string, source: {SOURCE}, originalCode: string, "
    f"analysis: {ANALYSIS}, fix: {FIX}, tests: {TESTS}, report: {SUMMARY}, "
    f"verification: {VERIFICATION}, detection: {DETECTION}, timings: {TIMINGS}>"
)

META = "struct<name: string, fileName: string, language: string, ext: string, startedAt: string>"
TRUTH = "struct<bugs: array<struct<id: string, line: bigint, description: string>>>"
TEST_RESULT = "struct<numPassedTests: bigint, numFailedTests: bigint, numTotalTests: bigint>"
INDEX_ENTRY = "id string, fileName string, recordedAt string, author string, issues bigint"
