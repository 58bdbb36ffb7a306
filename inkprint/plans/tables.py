"""The driver tables, and the tables of the engine derived from them.

The driver tables hold prose and orders, no source code. Code units come from ``orders``: the
order key picks one of twelve templates and fills it. Sixteen neighbouring orders share a
file, each in its own slot of twenty lines, so every unit knows its lines without a window
and no file grows with the data. Each derived column is one SQL text that Spark and DuckDB
both read; `dialect` only names the types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 16
SLOT_LINES = 20

# (kind, name or None if the template declares no unit, lines)
TEMPLATES: tuple[tuple[str, ...], ...] = (
    (
        "function settleLedger{k}(ledger, rate) {",
        "  const accrued = ledger.balance * rate;",
        "  if (accrued > {k}) {",
        "    ledger.post(accrued);",
        "  }",
        "  return accrued;",
        "}",
    ),
    (
        "async function getData{k}(id) {",
        "  // Fetch the data",
        "  try {",
        "    const result = await api.load(id);",
        "    return result;",
        "  } catch (error) {",
        "    console.error(error);",
        "  }",
        "}",
    ),
    (
        "function handleReq(req, res) {",
        "  const value = req?.body?.value ?? null;",
        "  if (value === null) { return; }",
        '  if (typeof value === "undefined") { return; }',
        "  res.status(200).json(value);",
        "}",
    ),
    (
        "const Panel{k} = () => {",
        "  const [items, setItems] = useState([]);",
        "  // \U0001F680 load",
        "  useEffect(() => { setItems([{k}]); }, []);",
        "  return items;",
        "};",
    ),
    (
        "function validateInput(x) { return x; }",
        "function formatInput(x) { return x; }",
        "function processInput(x) { return x; }",
        "validateInput({k}); formatInput({k}); processInput({k});",
    ),
    (
        "function loadAll{k}() {",
        '  axios.fetchData("/a{k}");',
        '  axios.fetchData("/b");',
        '  fs.readFilePromise("x");',
        "  prisma.connect();",
        "}",
    ),
    (
        "function connect{k}() {",
        '  const a = "AKIA{k16}";',
        '  const b = "ghp_{k36}";',
        "  return open(a, b);",
        "}",
    ),
    (
        "function login{k}() {",
        '  const token = "{sha}";',
        '  const salt = "Qw7zR2mK9xLp4VtB8nYc1HsD{k}";',
        "  return sign(token, salt);",
        "}",
    ),
    (
        "// step one",
        "// step two",
        "// step three",
        "function a{k}() {",
        "  one();",
        "  two();",
        "  three();",
        "  four();",
        "  five();",
        "  six();",
        "}",
    ),
    (
        "function total(amounts) {",
        "  let sum = 0;",
        "  for (const a of amounts) sum += a;",
        "  return sum;",
        "}",
    ),
    (
        "count(count, count);",
        "count(count, count);",
        "count(count, count);",
        "count(count, count);",
    ),
    (
        "class Box{k} {",
        "  open() {",
        "      return this.lid;",
        "  }",
        "   close() { this.lid = {k}; }",
        "}",
    ),
)
KINDS = ("function", "function", "function", "arrow", "function", "function",
         "function", "function", "function", "function", "function", "class")
NAMES = ("settleLedger{k}", "getData{k}", "handleReq", "Panel{k}", "validateInput", "loadAll{k}",
         "connect{k}", "login{k}", "a{k}", "total", "count", "Box{k}")


# views: arrows whose bodies are expressions, one file an order
VIEWS: tuple[tuple[str, ...], ...] = (
    (
        "export const List{k} = ({ rows, onOpen }) => (",
        "  <ul className=\"list\">",
        "    {rows.map((row) => (",
        "      <li key={row.id} onClick={() => onOpen({k})}>",
        "        {row.label}",
        "      </li>",
        "    ))}",
        "  </ul>",
        ");",
    ),
    (
        "const scale{k} = (rate) => (amount) =>",
        "  amount *",
        "  rate + // (not an argument",
        "  {k}",
        "const after = 1",
    ),
    (
        "export const load{k} = async (ids) =>",
        "  ids",
        "    .filter((id) => id > {k})",
        "    .map(async (id) => {",
        "      const found = await read(id, [{k}]);",
        "      return found;",
        "    });",
        "const handlers = {",
        "  open: (event) =>",
        "    event.target ===",
        "    null,",
        "  close(event) {",
        "    event.stop();",
        "    return {k};",
        "  },",
        "};",
    ),
    (
        "register({k}, (value) =>",
        "  value",
        "    ? [value, {k}]",
        "    : [],",
        "  function (done) {",
        "    done();",
        "  },",
        "  (left, right) => {",
        "    if (left) {",
        "      return right;",
        "    }",
        "  });",
    ),
)


def _by_template(values: list[str]) -> str:
    branches = " ".join(f"when {i} then {v}" for i, v in enumerate(values))
    return f"case o_orderkey % {len(values)} {branches} end"


def _fill(text: str, string: str) -> str:
    key = f"cast(o_orderkey as {string})"
    for mark, value in (
        ("{k16}", f"lpad({key}, 16, '0')"),
        ("{k36}", f"lpad({key}, 36, '0')"),
        ("{sha}", f"sha1({key})"),
        ("{k}", key),
    ):
        text = f"replace({text}, '{mark}', {value})"
    return text


def unit_columns(dialect: str) -> dict[str, str]:
    """Column name to SQL text of the derived units, for ``spark`` or ``duckdb``."""
    string, whole = {"spark": ("string", "bigint"), "duckdb": ("varchar", "bigint")}[dialect]
    code = _by_template(["concat_ws(chr(10), " + ", ".join(f"'{line}'" for line in t) + ")" for t in TEMPLATES])
    file_no = f"cast(floor(o_orderkey / {SLOTS}) as {whole})"
    first = f"cast((o_orderkey % {SLOTS}) * {SLOT_LINES} + 1 as int)"
    return {
        "unit_key": "o_orderkey",
        "path": f"concat('pkg', cast({file_no} % 7 as {string}), '/mod', cast({file_no} as {string}), '.ts')",
        "name": _fill(_by_template([f"'{n}'" for n in NAMES]), string),
        "kind": _by_template([f"'{k}'" for k in KINDS]),
        "ordinal": f"cast(o_orderkey % {SLOTS} as int)",
        "start_line": first,
        "end_line": f"cast({first} + {_by_template([str(len(t) - 1) for t in TEMPLATES])} as int)",
        "prefix": "case when o_orderkey % 5 = 0 then '/** doc */' else '' end",
        "code": _fill(code, string),
    }


def finding_columns(dialect: str) -> dict[str, str]:
    """Findings at scale from ``lineitem``: severity, identity, place and time."""
    string = {"spark": "string", "duckdb": "varchar"}[dialect]
    part, supp, line = (f"cast({c} as {string})" for c in ("l_partkey", "l_suppkey", "l_linenumber"))
    return {
        "id": f"substring(sha1(concat('lineitem:', {part}, ':', {line})), 1, 10)",
        "severity": (
            "case when l_returnflag = 'R' and l_linestatus = 'F' then 'CRITICAL' "
            "when l_returnflag = 'R' then 'HIGH' "
            "when l_returnflag = 'A' and l_linestatus = 'F' then 'HIGH' "
            "when l_returnflag = 'A' then 'MEDIUM' else 'LOW' end"
        ),
        "file": (
            f"case when l_suppkey % 11 = 0 then concat('mod', {part}, '.ts') "
            f"else concat('pkg', cast(l_suppkey % 23 as {string}), '/mod', {part}, '.ts') end"
        ),
        "line": "cast(l_linenumber * 10 + l_quantity as int)",
        "supplier": supp,
        "current": "l_shipdate >= timestamp '1998-05-24 00:00:00'",
    }


# every form of import: {a} and {b} are modules, {n} is a digit
LINKED = (
    'import top, { f{n} as one, type g } from "{a}";',
    "import * as space from ''{b}'';",
    'import type { Shape } from "{b}";',
    'import "{a}";',
    'import local from "./local";',
    'const { g: two, f{n} } = require("{a}");',
    'const whole = require("{b}");',
    'const later = await import("{a}");',
    'export { g as three } from "{b}";',
    'export * from "{a}";',
    'top.f{n}(1); space.g(); whole.f{n} (2); later.h(); two.g(); other.f1(); local.g();',
)


def linked_source(dialect: str) -> str:
    """SQL text of a file's code, from a row of ``part``."""
    string = {"spark": "string", "duckdb": "varchar"}[dialect]
    # DuckDB and Spark agree on a doubled quote only through chr
    lines = ", ".join("'" + line.replace("''", "{q}") + "'" for line in LINKED)
    text = f"replace(concat_ws(chr(10), {lines}), '{{q}}', chr(39))"
    for mark, value in (("{a}", "p_partkey % 31"), ("{b}", "p_size"), ("{n}", "p_partkey % 9")):
        name = f"cast({value} as {string})" if mark == "{n}" else f"concat('NATION_', cast({value} as {string}))"
        text = f"replace({text}, '{mark}', {name})"
    return text


def view_columns(dialect: str) -> dict[str, str]:
    """Column name to SQL text of the derived views, for ``spark`` or ``duckdb``."""
    string = {"spark": "string", "duckdb": "varchar"}[dialect]
    code = _by_template(["concat_ws(chr(10), " + ", ".join(f"'{line}'" for line in v) + ")" for v in VIEWS])
    return {"path": f"concat('views/view', cast(o_orderkey as {string}), '.tsx')", "content": _fill(code, string)}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def derived_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = unit_columns("spark")
    return read(spark, sf_dir, "orders").select(*[F.expr(sql).alias(name) for name, sql in columns.items()])


def derived_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = finding_columns("spark")
    return read(spark, sf_dir, "lineitem").select(
        "*", *[F.expr(sql).alias(name) for name, sql in columns.items()]
    )


def derived_files(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Source files: the sixteen slots of a file put together.

    One aggregate per slot instead of a collected list: the state per file is fixed. With ``parts``
    the orders are dealt out by file before they become texts, which the aggregate then finds in place.
    """
    columns = unit_columns("spark")
    keys = read(spark, sf_dir, "orders").select("o_orderkey", F.expr(columns["path"]).alias("path"))
    if parts:
        keys = keys.repartition(parts, "path")
    staged = keys.select("path", *[F.expr(columns[name]).alias(name) for name in ("ordinal", "code", "start_line", "end_line")])
    units = staged.select(
        "path", "ordinal", "code", (F.col("end_line") - F.col("start_line") + 1).alias("n")
    )
    padded = units.withColumn("code", F.concat("code", F.repeat(F.lit("\n"), SLOT_LINES - F.col("n"))))
    grouped = padded.groupBy("path").agg(
        *[F.max(F.when(F.col("ordinal") == i, F.col("code"))).alias(f"slot{i}") for i in range(SLOTS)]
    )
    empty = F.lit("\n" * (SLOT_LINES - 1))
    return grouped.select(
        "path", F.concat_ws("\n", *[F.coalesce(F.col(f"slot{i}"), empty) for i in range(SLOTS)]).alias("content")
    )


def derived_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views_of(read(spark, sf_dir, "orders"))


def views_of(orders: DataFrame) -> DataFrame:
    return orders.select(*[F.expr(sql).alias(name) for name, sql in view_columns("spark").items()])


def document_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as units of prose; ``source`` stands for the repository."""
    return read(spark, sf_dir, "documents").select(
        "doc_id", "source", F.col("text").alias("code"), F.lit("").alias("prefix")
    )
