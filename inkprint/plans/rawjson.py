"""Scanner output built from ``part`` and ``supplier`` rows.

SQL texts that Spark and DuckDB read alike; ``{s}`` is the name of the text type. They hold
broken documents, missing lists, missing fields and both layouts on purpose.
"""

from __future__ import annotations

_K = "cast(p_partkey as {s})"
_SK = "cast(s_suppkey as {s})"

SEMGREP = (
    "case when p_partkey % 6 = 0 then '{{\"results\": [' when p_partkey % 6 = 1 then '{{}}' else concat("
    "'{{\"results\":[{{\"path\":\"src/p', " + _K + ", '.ts\",\"check_id\":\"rules.', lower(p_type), '.no-eval_', p_brand, "
    "'\",\"start\":{{\"line\":', cast(p_size as {s}), ',\"col\":3}},\"extra\":{{\"message\":\"  uses ', p_name, ' \",\"severity\":\"', "
    "case p_partkey % 5 when 0 then 'ERROR' when 1 then 'warning' when 2 then 'Info' when 3 then 'x-critical' else 'note' end, "
    "'\",\"lines\":\" call() \",\"metadata\":{{\"category\":\"', case when p_partkey % 3 = 0 then '' else p_type end, '\"}}}}}},"
    "{{\"path\":\"/abs/./q/../p', " + _K + ", '.ts\"}}]}}') end"
)

ESLINT = (
    "case when p_partkey % 7 = 0 then 'not json' else concat("
    "'[{{\"filePath\":\"/r/p', " + _K + ", '.js\",\"messages\":[{{\"ruleId\":\"', "
    "case p_partkey % 5 when 0 then 'security/detect-unsafe-regex' when 1 then 'no-eval' when 2 then 'no-buffer_constructor' "
    "when 3 then 'prefer-regex-literals' else 'security/detect-object-injection' end, "
    "'\",\"severity\":', cast(p_partkey % 3 as {s}), ',\"message\":\"', p_name, '\",\"line\":', cast(p_size as {s}), ',\"column\":2}},"
    "{{\"ruleId\":null,\"severity\":2,\"message\":\"parse\",\"line\":1,\"column\":1}}]}},{{\"filePath\":\"/r/e.js\",\"messages\":[]}}]') end"
)

NPM_LEGACY = (
    "concat('{{\"vulnerabilities\":{{\"', replace(p_name, ' ', '-'), '\":{{', "
    "case when p_partkey % 4 = 0 then '' else concat('\"id\":', " + _K + ", ',') end, "
    "case when p_partkey % 3 = 0 then '\"title\":\" \",' else concat('\"title\":\" Bad ', p_type, ' \",') end, "
    "'\"severity\":\"', case p_partkey % 5 when 0 then 'critical' when 1 then 'high' when 2 then 'moderate' when 3 then 'low' else 'info' end, "
    "'\",\"findings\":[', case when p_partkey % 5 = 4 then '' else concat('{{\"paths\":[\"a>', p_brand, '\",\"b\"]}},{{\"paths\":[\"b\"]}},{{}}') end, "
    "']}}}}}}')"
)

NPM_MODERN = (
    "concat('{{\"vulnerabilities\":{{\"', replace(p_name, ' ', '-'), '\":{{\"name\":\"', case when p_partkey % 4 = 1 then ' ' else 'nm' end, "
    "'\",\"severity\":\"', case p_partkey % 4 when 0 then 'critical' when 1 then 'high' when 2 then 'moderate' else 'low' end, "
    "'\",\"range\":\"<1\",\"nodes\":[', case when p_partkey % 3 = 0 then '' else concat('\"node_modules/', p_brand, '\",\"x\"') end, "
    "'],\"via\":[\"other\"', case when p_partkey % 5 = 0 then '' else concat("
    "',{{\"source\":', " + _K + ", ',\"name\":\"n1\",\"title\":\" T ', p_type, '\",\"severity\":\"high\",\"range\":\" <2.0 \"}}"
    ",\"more\",{{\"name\":\"n2\",\"title\":\"\"}},{{\"title\":\"anon\",\"severity\":\"low\"}}') end, "
    "']}}}}}}')"
)

NODEJSSCAN = (
    "case when s_suppkey % 9 = 8 then '{{\"results\":7}}' else concat("
    "'{{\"results\":[{{\"file\":\"lib/s', " + _SK + ", '.js\",\"line\":', cast(s_suppkey % 4 as {s}), ',\"issue\":\"', "
    "case s_suppkey % 8 when 0 then 'SQL Injection found' when 1 then 'XSS  reflected' when 2 then 'Eval used' when 3 then 'weak crypto' "
    "when 4 then 'Session fixation' when 5 then 'missing Header' when 6 then '' else 'Other issue' end, "
    "'\",\"severity\":\"', case s_suppkey % 5 when 0 then 'Critical' when 1 then 'HIGH' when 2 then 'warning' when 3 then 'Medium' else 'info' end, "
    "'\",\"code\":\"x()\"}},{{\"file\":\"../up.js\",\"issue\":\"code execution\"}}]}}') end"
)

BEARER = (
    "concat('{{\"findings\":[{{\"title\":\"t', " + _SK + ", '\",\"description\":\"', case when s_suppkey % 3 = 0 then '' else s_name end, "
    "'\",\"severity\":\"', case s_suppkey % 5 when 0 then 'critical' when 1 then 'High' when 2 then 'medium' when 3 then 'low' else 'warning' end, "
    "'\",\"file\":{{\"path\":\"', case when s_suppkey % 7 = 0 then '' else concat('app/s', " + _SK + ", '.rb') end, "
    "'\",\"line\":', cast(s_suppkey % 3 as {s}), '}},\"snippet\":{{\"code\":\"c\"}},\"data_types\":[', "
    "case when s_suppkey % 2 = 0 then '' else '\"Email\",\"Name\"' end, '],\"category\":\"', "
    "case s_suppkey % 6 when 0 then 'sql_lang' when 1 then 'Cross-Site thing' when 2 then 'Auth flow' when 3 then 'encryption-use' "
    "when 4 then 'CORS' else 'Logger Leak' end, '\"}},{{\"title\":\"nofile\",\"category\":\"x\"}}]}}')"
)


def text(template: str, dialect: str) -> str:
    return template.format(s={"spark": "string", "duckdb": "varchar"}[dialect])
