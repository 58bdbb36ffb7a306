"""The lexical splitter on hand-written sources."""

import random

from inkprint.functions import text as tx
from inkprint.operators import units as un
from pyspark.sql import functions as F

SOURCE = """import x from "y";

/** Adds. */
export async function add(a, b = f(1)) {
  // function hidden() {
  const text = "class Fake {";
  return a + b;
}

const plain = function named(q) {
  one();
  two();
};

export default class Shop extends Base {
  constructor(a) {
    this.a = a;
    this.b = a;
  }

  get size() {
    one();
    return 1;
  }

  static async load(id: string): Promise<Shop> {
    if (id) {
      return await fetch(`/${id}`);
    }
  }
}

const handler = async (req, res) => {
  step();
  return res;
};

const table = {
  onClick: (e) => {
    e.stop();
    return 1;
  },
  run(a) {
    for (const x of a) {
      x();
    }
  },
};

items.forEach((item) => {
  use(item);
  drop(item);
});
"""


def spans(spark, source):
    df = spark.createDataFrame([("a.ts", source)], "path string, content string")
    return [
        (r["kind"], r["name"], r["start_line"], r["end_line"], r["code"])
        for r in un.split_files(df).orderBy("ordinal").collect()
    ]


def test_kinds_names_and_lines(spark):
    found = [s[:4] for s in spans(spark, SOURCE)]
    assert found == [
        ("function", "add", 4, 8),
        ("class", "Shop", 15, 31),
        ("method", "load", 26, 30),
        ("arrow", "handler", 33, 36),
        ("arrow", "onClick", 39, 42),
        ("method", "run", 43, 47),
        ("arrow", "<anonymous>", 50, 53),
    ]


EXPRESSIONS = """export const Card = ({ title, items }: Props) => (
  <section className="card" onClick={() => open(title)}>
    <h1>{title}</h1>
    {items.map((item) => (
      <li key={item.id}>
        {item.name}
      </li>
    ))}
  </section>
);

const curried = (a) => (b) =>
  a +
  b;

const chained = list =>
  list
    .filter((x) => x.ok)
    .map((x) => {
      touch(x);
      return x.id;
    })
const next = 1

const typed: (a: string) => number = (a) => {
  log(a);
  return a.length;
};

const table = {
  first: (a) =>
    a.one +
    a.two,
  second: async (b) =>
    await b
      .three(),
};

load(
  (e) =>
    e.code ===
    "x",
  function named(q) {
    return (
      q
    );
  },
  [1, 2].map((n) =>
    n *
    2),
);
"""


def test_expressions_as_bodies(spark):
    found = spans(spark, EXPRESSIONS)
    assert [s[:4] for s in found] == [
        ("arrow", "Card", 1, 10),
        ("arrow", "<anonymous>", 4, 8),
        ("arrow", "curried", 12, 14),
        ("arrow", "<anonymous>", 12, 14),
        ("arrow", "chained", 16, 22),
        ("arrow", "<anonymous>", 19, 22),
        ("arrow", "typed", 25, 28),
        ("arrow", "first", 31, 33),
        ("arrow", "second", 34, 36),
        ("arrow", "<anonymous>", 40, 42),
        ("arrow", "<anonymous>", 48, 50),
    ]
    code = {(s[1], s[2]): s[4] for s in found}
    assert code["Card", 1].startswith("({ title, items }: Props) => (\n") and code["Card", 1].endswith("</section>\n)")
    assert code["chained", 16].endswith("return x.id;\n    })") and code["first", 31].endswith("a.two") and code["second", 34].startswith("async (b)")
    assert code["<anonymous>", 40].endswith('"x"') and code["<anonymous>", 48] == "(n) =>\n    n *\n    2"


def test_open_ends_of_expressions(spark):
    assert spans(spark, "const f = (a) =>") == [] and spans(spark, ")]}, (a) => b") == []
    assert [s[1:4] for s in spans(spark, "x => [(\n}\nconst g = (a) =>\n a +\n 1;\n")] == [("g", 3, 5)]
    assert [s[1:4] for s in spans(spark, "const f = a =>\n  // one (\n  a(\n    1,\n  ) // end\nother()")] == [("f", 1, 5)]


def test_one_mebibyte_of_expressions(spark):
    body = "".join(f"const f{i} = (a) => (\n  <b>{{g('{'x' * 20}', [a])}}</b>\n);\n" for i in range(16000))[: 1 << 20]
    got = spans(spark, body)
    assert len(got) > 14000 and got[0][1:4] == ("f0", 1, 3)


def test_code_and_doc_prefix(spark):
    df = spark.createDataFrame([("a.ts", SOURCE)], "path string, content string")
    rows = {r["name"]: r for r in un.with_features(un.split_files(df)).collect()}
    assert rows["add"]["code"].startswith("export async function add(") and rows["add"]["code"].endswith("}")
    assert rows["handler"]["code"].startswith("async (req, res) => {")
    assert rows["add"]["has_doc"] and not rows["Shop"]["has_doc"]
    assert rows["add"]["loc"] == 4 and rows["add"]["comment_lines"] == 1
    assert rows["add"]["parameters"] == ["a", "b"]
    assert len(rows["add"]["id"]) == 12


def test_files_without_units(spark):
    assert spans(spark, "") == [] and spans(spark, "const a = 1;") == [] and spans(spark, None) == []
    assert spans(spark, "function short() { return 1; }") == []
    # open ends do not stop the rest
    assert spans(spark, "}}}} function f() {\n a();\n b();\n") == []
    assert [s[1] for s in spans(spark, "} function f() {\n a();\n b();\n}\n\"open")] == ["f"]


def test_one_mebibyte_file(spark):
    body = "".join(f"function f{i}(a) {{\n  if (a) {{ g('{'x' * 40}'); }}\n  return a;\n}}\n" for i in range(11000))
    text = "const s = `" + "y" * 200_000 + "`;\n/* " + "z " * 50_000 + "*/\n" + body[: 1_048_576 - 400_000]
    got = spans(spark, text)
    assert len(got) > 5000 and got[0][1] == "f0" and got[0][2] == 3


def test_masking_keeps_offsets(spark):
    source = "a 'x{' \"y\\\"}\" /* {\n } */ b // c {\n`t${x}\n`z / 2"
    masked = spark.createDataFrame([(source,)], "s string").select(tx.masked(F.col("s"))).first()[0]
    assert len(masked) == len(source) and masked.count("\n") == source.count("\n")
    assert "{" not in masked and "}" not in masked and masked[0] == "a" and masked.endswith("z / 2")


def test_what_is_like_a_head_holds_all_heads(spark):
    """The look ahead of the heads changes no match; patterns are searched outside the fold."""
    pieces = ["export ", "default ", "async ", "function", "class ", "return ", "static get ", "const ", "a", "#b", "$", "1c", "public ", " ", "\n", "(", ")", "<T>",
              ":", "=", "=>", "{", "}", ",", "?", "[", "]", ";", "if ", "new "]
    rng = random.Random(5)
    texts = ["".join(rng.choice(pieces) for _ in range(60)) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in (un._HEADS, un._HEADS_AND_EXPRESSIONS, un._PARTS, un._BRACKET_PARTS):
        bare = pattern.replace(un._LIKE_A_HEAD, "")
        assert bare != pattern
        assert df.filter(tx.every(F.col("t"), pattern) != tx.every(F.col("t"), bare)).count() == 0


def test_steps_of_the_fold_search_no_pattern(spark):
    df = spark.createDataFrame([("a.ts", SOURCE)], "path string, content string")
    plan = df.select(un._spans(un.source_parts(F.col("content")), True).alias("s"))._jdf.queryExecution().analyzed().toString()
    step = plan[plan.index("aggregate(transform("):]
    assert "_bracket" not in step and plan.lower().count("regexp_replace") + plan.lower().count("rlike") < 60


def test_units_far_below_a_comment_see_it(spark):
    """400 characters before a unit may be hundreds of short lines."""
    source = "/** far */" + "\n" * 200 + "function f() {\n  one();\n  two();\n}\n"
    df = spark.createDataFrame([("a.ts", source)], "path string, content string")
    assert [r["prefix"] for r in un.split_files(df).collect()] == ["/** far */" + "\n" * 200]


def test_only_heads_and_what_closes_them_are_parts(spark):
    """Brackets without a head in them, and ends where no expression is on top, cost no step of the fold."""
    source = "const f = (a) =>\n  g(a, [1, 2], { b: 1 })\n    .then(a, (b));\n" + "x(1, [2], { c: d }); y = z\n" * 200
    parts = un.source_parts(F.col("s"), F.lit(True))
    found = spark.createDataFrame([(source,)], "s string").select(F.size(parts), parts[1], parts[4], F.length(parts[6])).first()
    assert tuple(found)[:3] == (7, "const f = (a) =>", "") and found[3] == 2 + 200 * len("x(1, [2], { c: d }); y = z\n")
    assert [s[1:4] for s in spans(spark, source)] == [("f", 1, 3)]


def test_breaks_and_stray_arrows(spark):
    """A line break after a bracket ends a statement at the end of the text, one after a word does not; an arrow of no head may be an expression."""
    assert [s[1:4] for s in spans(spark, "const f = (a) =>\n  b +\n  c()\n")] == [("f", 1, 3)]
    assert spans(spark, "const f = (a) =>\n  b +\n  c\n") == []
    assert ("<anonymous>", 2, 5, "k =>{\n  a;\n  b;\n}") in [s[1:] for s in spans(spark, "x => (a = f(g(h(1))))\n  k =>{\n  a;\n  b;\n}, c")]
    assert [s[1:] for s in spans(spark, "x => y;\n(a = f(g(1)))=>{\n  a;\n  b;\n}, c")] == [("<anonymous>", 2, 5, "=>{\n  a;\n  b;\n}")]


def test_long_text_behind_the_last_part(spark):
    assert [s[1:4] for s in spans(spark, "const f = (a) =>\n  b(\n    1);\n(x) => " + ". " * 200_000)] == [("f", 1, 3)]
