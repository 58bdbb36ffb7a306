"""Schemas of what is read: scanner output, history lines, progress events."""

SEMGREP = (
    "results array<struct<path:string, check_id:string, start:struct<line:int, col:int>, "
    "extra:struct<message:string, severity:string, lines:string, metadata:struct<category:string, cwe:string>>>>"
)
ESLINT = (
    "array<struct<filePath:string, messages:array<struct<ruleId:string, severity:int, message:string, "
    "line:int, column:int>>>>"
)
# "via" mixes texts and objects in one array: kept as text, each object parsed on its own.
NPM_AUDIT = (
    "vulnerabilities map<string, struct<id:string, title:string, severity:string, "
    "findings:array<struct<paths:array<string>>>, name:string, via:array<string>, nodes:array<string>, "
    "range:string>>"
)
NPM_VIA = "source string, name string, title string, severity string, range string"
NODEJSSCAN = "results array<struct<file:string, line:int, issue:string, severity:string, code:string>>"
BEARER = (
    "findings array<struct<title:string, description:string, severity:string, cwe:array<string>, "
    "file:struct<path:string, line:int, column:int>, snippet:struct<code:string>, "
    "data_types:array<string>, category:string>>"
)
HISTORY = (
    "timestamp string, mode string, target string, blocked boolean, filesScanned int, aiScore string"
)
