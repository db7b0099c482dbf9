"""Queries over source files that every part stands for, one for each language and for components and security.

A part is a file whose text imports, renders or calls what its number says, so
the sources go through the extractors while the SQL computes from the numbers
alone what must be found.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import udtf
from sparkloom.operators import extract, graph, security
from sparkloom.plans.roles import table

#: Numbers named in templates: the part, three others, one of the same directory; `d` in front of them: the directory.
NUMBERS = {"k": "{0}", "a": "({0} + 1) % {1}", "b": "({0} * 7 + 1) % {1}", "c": "({0} * 13 + 5) % {1}", "e": "({0} + 50) % {1}"}


def _numbers(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    n = part.count()
    # A few bytes of a part stand for a whole file: what is one task to read is many to extract from.
    part = part.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    cols = {f"_{x}": F.expr(f.format("k", n)) for x, f in NUMBERS.items()}
    return part.withColumns(cols).withColumns({f"_d{x}": F.col(f"_{x}") % 50 for x in NUMBERS})


def _filled(template: str) -> Column:
    """The template with each <name> replaced by the number of that name."""
    parts = re.split(r"<(d?[kabce])>", template)
    return F.concat(*[F.col(f"_{p}").cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


def _files(spark: SparkSession, sf: str, path: str, text: str) -> DataFrame:
    return _numbers(spark, sf).select(_filled(path).alias("path"), _filled(text).alias("text"), F.col("k").cast("long").alias("ord"))


def _sql_filled(template: str, number: str) -> str:
    """SQL of a path template for the part of a given number."""
    parts = re.split(r"<(d?k)>", template)
    return " || ".join(f"({number})" if p == "k" else f"(({number}) % 50)" if p == "dk" else "'" + p.replace("'", "''") + "'" for p in parts if p)


#: Of each language: path, text, targets (a number, or the first or last of its directory), whether a file may import itself.
LANGUAGES = {
    "javascript": ("src/d<dk>/m<k>.ts", 'import A, { x } from "../d<da>/m<a>";\nimport React from "react";\nconst b = require(\'../d<db>/m<b>.js\');\nconst c = await import("@/d<dc>/m<c>");\nexport * from "./missing";\n', "abc", True),
    "python": ("pkg/d<dk>/m<k>.py", "import os\nimport pkg.d<da>.m<a>\nfrom ..d<db>.m<b> import thing\nfrom pkg.d<dc>.m<c>.deeper import other\nfrom . import sibling\n", "abc", True),
    "go": ("d<dk>/m<k>.go", 'package d<dk>\n\nimport "example.com/x/d<da>"\n\nimport (\n\t"fmt"\n\tq "example.com/x/d<db>"\n)\n', ("first a", "first b"), True),
    "java": ("src/com/d<dk>/M<k>.java", "package com.d<dk>;\n\nimport java.util.List;\nimport com.d<da>.M<a>;\nimport static com.d<dc>.M<c>;\nimport com.d<db>.*;\n\nclass M<k> {}\n", ("a", "c", "last b"), False),
    "kotlin": ("src/com/d<dk>/M<k>.kt", "package com.d<dk>\n\nimport kotlin.math.max\nimport com.d<da>.M<a>\nimport com.d<db>.M<b>\n\nclass M<k>\n", "ab", False),
    "rust": ("src/d<dk>/m<k>.rs", "use std::fmt;\nuse crate::d<da>::m<a>::Thing;\nuse super::d<db>::m<b>;\nmod m<e>;\nmod none;\n", "abe", False),
    "csharp": ("src/D<dk>/M<k>.cs", "using System;\nusing static App.D<da>.M<a>;\nusing App.D<db>.M<b>;\nnamespace App.D<dk>.M<k>\n{\n}\n", "ab", False),
    "php": ("src/D<dk>/M<k>.php", "<?php\nnamespace App\\D<dk>;\nuse App\\D<da>\\M<a>;\nuse Other\\Thing;\nrequire_once 'src/D<db>/M<b>.php';\ninclude('../D<dc>/M<c>.php');\n", "abc", False),
    "ruby": ("lib/d<dk>/m<k>.rb", "require 'json'\nrequire 'd<da>/m<a>'\nrequire_relative '../d<db>/m<b>'\n", "ab", False),
}


def _target(which: str) -> str:
    number = NUMBERS[which[-1]].format("k", "n")
    if which.startswith("first"):
        return f"({number}) % 50"
    return f"(n - 1 - (n - 1 - ({number})) % 50)" if which.startswith("last") else number


def _edges_sql(language: str) -> str:
    path, _, targets, own = LANGUAGES[language]
    rows = " UNION ALL ".join(f"SELECT k, {_target(t)} AS t FROM p" for t in targets)
    return f"WITH p AS (SELECT p_partkey AS k, (SELECT count(*) FROM part) AS n FROM part), r AS ({rows}) SELECT DISTINCT {_sql_filled(path, 'k')} AS source, {_sql_filled(path, 't')} AS target, 'import' AS type FROM r{'' if own else ' WHERE k <> t'}"


def _edges_query(language: str):
    path, text, *_ = LANGUAGES[language]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return extract.import_edges(_files(spark, sf, path, text), extract.Aliases([("@/", ["src/"])]), "example.com/x")

    run.__doc__ = f"Imports of the {language} files that the parts stand for."
    return run


COMPONENT_PATH = "src/d<dk>/C<k>.tsx"
COMPONENT = """import { useState } from 'react';
interface C<k>Props {
  title: string;
  size?: number;
}
export default function C<k>(props: C<k>Props) {
  const [s] = useState(0);
  const theme = useContext(Theme<dk>);
  const q = useQuery('x<a>');
  return <div><C<a> title="x" /><C<b>>{q}</C<b>></div>;
}
"""
_P = "WITH p AS (SELECT p_partkey AS k, (SELECT count(*) FROM part) AS n FROM part)"
_A, _B = (NUMBERS[x].format("k", "n") for x in "ab")


def components(spark, sf):
    """Components with their props, hooks and children."""
    found = extract.components(_files(spark, sf, COMPONENT_PATH, COMPONENT))
    props = F.array_join(F.transform("props", lambda p: F.concat_ws(":", p["name"], p["type"], p["is_required"].cast("string"))), ",")
    return found.select("name", "file_path", props.alias("props"), F.array_join("hooks", ",").alias("hooks"), F.array_join("children", ",").alias("children"), "is_default_export")


COMPONENTS_SQL = f"{_P} SELECT 'C' || k AS name, {_sql_filled(COMPONENT_PATH, 'k')} AS file_path, 'title:string:true,size:number:false' AS props, 'useState,useContext,useQuery' AS hooks, CASE WHEN {_A} = {_B} THEN 'C' || ({_A}) ELSE 'C' || ({_A}) || ',C' || ({_B}) END AS children, true AS is_default_export FROM p"


def render_edges(spark, sf):
    return extract.render_edges(extract.components(_files(spark, sf, COMPONENT_PATH, COMPONENT)))


RENDER_SQL = f"{_P}, r AS (SELECT k, {_A} AS t FROM p UNION ALL SELECT k, {_B} FROM p) SELECT DISTINCT {_sql_filled(COMPONENT_PATH, 'k')} AS source, {_sql_filled(COMPONENT_PATH, 't')} AS target, 'renders' AS type FROM r WHERE k <> t"


def data_flows(spark, sf):
    return extract.data_flows(_files(spark, sf, COMPONENT_PATH, COMPONENT)).select("component_name", "file_path", "type", "name")


FLOWS_SQL = f"{_P}, f(type, name) AS (VALUES ('local-state', 'useState'), ('api', 'useQuery'), ('props', 'props')) SELECT 'C' || k AS component_name, {_sql_filled(COMPONENT_PATH, 'k')} AS file_path, type, name FROM p, f UNION ALL SELECT 'C' || k, {_sql_filled(COMPONENT_PATH, 'k')}, 'context', 'Theme' || (k % 50) FROM p"

#: (extension, language, line, rules that must find it): each of the seventeen rules, and what must not be found.
LINES = [
    (".ts", "typescript", 'const password = "supersecretpass123";', "secret"),
    (".go", "go", 'api_key := "x"; apikey = "abcdefghijklmnop"', "secret"),
    (".ts", "typescript", "  readonly password: string;", ""),
    (".ts", "typescript", 'const token = "abc";', ""),
    (".js", "javascript", "const result = eval(input);", "eval-js"),
    (".ts", "typescript", 'const fn = new Function("return " + code);', "new-function"),
    (".py", "python", "result = exec(user_input)", "eval-python"),
    (".rb", "ruby", "eval(params[:x])", "eval-ruby"),
    (".php", "php", "eval($code);", "eval-php"),
    (".go", "go", "result := eval(input)", ""),
    (".js", "javascript", "import eval('x')", ""),
    (".js", "javascript", "// eval(input)", ""),
    (".ts", "typescript", "el.innerHTML = content;", "xss-innerhtml"),
    (".tsx", "typescript", "<div dangerouslySetInnerHTML={{__html: data}} />", "xss-dangerously"),
    (".js", "javascript", "document.write(x);", "xss-document-write"),
    (".java", "java", 'String q = "SELECT * FROM users WHERE id=" + userId;', "sql-injection-concat"),
    (".ts", "typescript", "const q = `DELETE FROM users WHERE id=${userId}`;", "sql-injection-template"),
    (".js", "javascript", "const h = crypto.createHash('md5').update(x);", "insecure-crypto-md5"),
    (".py", "python", "h = hashlib.md5(data)", "insecure-crypto-md5-python"),
    (".js", "javascript", 'const h = createHash("sha1");', "insecure-crypto-sha1"),
    (".js", "javascript", "require('child_process').exec(`ls ${dir}`);", "cmd-injection-js"),
    (".py", "python", 'os.system(f"rm {path}")', "cmd-injection-python"),
    (".py", "python", "subprocess.run(cmd, shell=True)", "cmd-injection-python-subprocess"),
    (".js", "javascript", 'const s = "SELECT " + eval(x);', "eval-js,sql-injection-concat"),
    (".py", "python", "total = sum(values)", ""),
]


def _sources(spark: SparkSession, sf: str, text: Column, ext: Column, language: Column) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k")).select(F.concat(F.lit("src/m"), "k", ext).alias("path"), language.alias("language"), F.lit("util").alias("module_type"), text.alias("text"))


def _of(column: int) -> Column:
    return F.element_at(F.array(*[F.lit(x[column]) for x in LINES]), (F.col("k") % len(LINES)).cast("int") + 1)


def security_rules(spark, sf):
    """Findings of each rule, on lines that it must and must not find."""
    text = F.concat(F.lit("head\n\n"), _of(2), F.lit("\nlast"))
    return security.findings(_sources(spark, sf, text, _of(0), _of(1))).select("path", "line", "rule")


def _quoted(values) -> str:
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in row) + ")" for row in values)


RULES_SQL = f"WITH e(i, ext, rule) AS (VALUES {_quoted([(i, ext, r) for i, (ext, _, _, rules) in enumerate(LINES) for r in rules.split(',') if r])}) SELECT 'src/m' || p_partkey || ext AS path, CAST(3 AS INT) AS line, rule FROM part JOIN e ON p_partkey % {len(LINES)} = i"


def security_issues(spark, sf):
    """One issue per file and kind: up to five lines of one kind, of which three are shown, and perhaps one of another."""
    k = F.col("k")
    many = F.repeat(F.lit("el.innerHTML = v;\n"), (k % 6).cast("int"))
    text = F.concat(many, F.when(k % 2 == 1, "eval(code);\n").otherwise(""))
    return security.issues(_sources(spark, sf, text, F.lit(".js"), F.lit("javascript"))).select("type", "severity", "message", F.array_join("files", ",").alias("file"))


ISSUES_SQL = """WITH p AS (SELECT p_partkey AS k, CAST(p_partkey % 6 AS INT) AS r FROM part)
SELECT 'security-xss' AS type, 'warning' AS severity, 'Security: ' || array_to_string(list_transform(range(1, least(r, 3) + 1), lambda i: 'L' || i || ': el.innerHTML = v;'), '; ') || CASE WHEN r > 3 THEN ' (+' || (r - 3) || ' more)' ELSE '' END AS message, 'src/m' || k || '.js' AS file FROM p WHERE r > 0
UNION ALL SELECT 'security-injection', 'error', 'Security: L' || (r + 1) || ': eval(code);', 'src/m' || k || '.js' FROM p WHERE k % 2 = 1"""


def _tree(spark, sf) -> DataFrame:
    """Components in chains of five that hand a prop down."""
    k = F.col("k")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("k"))
    name = lambda n: F.concat(F.lit("C"), n)
    below = F.when(k % 5 < 4, F.array(name(k + 1))).otherwise(F.array().cast("array<string>"))
    return part.select(name(k).alias("name"), F.concat(name(k), F.lit(".tsx")).alias("file_path"), F.array(F.concat(F.lit("p"), F.floor(k / 5))).alias("props"), below.alias("children"), k.cast("long").alias("ord"))


def prop_issues(spark, sf):
    return graph.prop_issues(_tree(spark, sf)).select("type", "message", F.array_join("files", ",").alias("files"))


PROPS_SQL = """WITH p AS (SELECT p_partkey AS k, list_transform(range(p_partkey, p_partkey - p_partkey % 5 + 5), lambda i: 'C' || i) AS chain FROM part)
SELECT 'prop-drilling' AS type, 'Prop "p' || CAST(floor(k / 5) AS BIGINT) || '" drilled through ' || len(chain) || ' levels: ' || array_to_string(chain, ' → ') AS message, array_to_string(list_transform(chain, lambda x: x || '.tsx'), ',') AS files FROM p WHERE len(chain) >= 3"""


def component_issues(spark, sf):
    """Components of more than twenty children or fifteen hooks."""
    k = F.col("p_partkey")
    names = lambda n, x: F.transform(F.slice(F.sequence(F.lit(1), F.lit(40)), 1, n.cast("int")), lambda i: F.concat(F.lit(x), i))
    comps = table(spark, sf, "part").select(F.concat(F.lit("C"), k).alias("name"), F.concat(F.lit("C"), k, F.lit(".tsx")).alias("file_path"), names(k % 30, "X").alias("children"), names(k % 20, "use").alias("hooks"))
    return graph.god_components(comps).select("type", "message", F.array_join("files", ",").alias("file"))


GOD_SQL = """SELECT 'god-module' AS type, 'God component "C' || p_partkey || '" renders ' || (p_partkey % 30) || ' child components' AS message, 'C' || p_partkey || '.tsx' AS file FROM part WHERE p_partkey % 30 > 20
UNION ALL SELECT 'high-coupling', 'Component "C' || p_partkey || '" uses ' || (p_partkey % 20) || ' hooks (consider splitting)', 'C' || p_partkey || '.tsx' FROM part WHERE p_partkey % 20 > 15"""

NESTED_PATH = "src/d<dk>/P<k>.tsx"
NESTED = """// const Ghost<k> = () => <Lost />;
interface P<k>Props { id: string }
export const P<k> = ({ id }: P<k>Props) => {
  const t = useContext(Theme<dk>);
  const [s] = useState<Map<string, number>>(new Map());
  const Inner = () => { const r = useReducer(f, "const X = () => <Y />"); return <P<a> />; };
  const c = useSelector(pick), d = useDispatch(), e = useCartStore();
  const r = useSWR("/k<k>"); fetch("/x<b>"); /* useQuery("no") */
  return <Box.Row>{c ? <Inner /> : <P<b> />}</Box.Row>;
}, Q<k>: React.FC<P<k>Props> = () => <P<k> />;
"""
_KINDS = [("context", None), ("local-state", "useState"), ("local-state", "useReducer"), ("store", "redux"), ("store", "redux-dispatch"), ("store", "useCartStore"), ("api", "fetch"), ("api", "useSWR"), ("props", "props")]
FLOW_KINDS_SQL = f"{_P}, f(type, name) AS (VALUES {', '.join(f'({t!r}, {n!r})' if n else f'({t!r}, NULL)' for t, n in _KINDS)}) SELECT 'P' || k AS component_name, {_sql_filled(NESTED_PATH, 'k')} AS file_path, type, coalesce(name, 'Theme' || (k % 50)) AS name FROM p, f"
NESTED_SQL = f"""{_P} SELECT 'P' || k AS name, {_sql_filled(NESTED_PATH, 'k')} AS file_path, 'useCartStore,useContext,useDispatch,useReducer,useSWR,useSelector,useState' AS hooks, array_to_string(list_sort(list_distinct(['Box.Row', 'Inner', 'P' || ({_A}), 'P' || ({_B})])), ',') AS children, 'id:string' AS props FROM p
 UNION ALL SELECT 'Q' || k, {_sql_filled(NESTED_PATH, 'k')}, '', 'P' || k, '' FROM p"""


def nested_components(spark, sf):
    """Components that hold others, two of one keyword, beside code in comments and strings."""
    found = extract.components(_files(spark, sf, NESTED_PATH, NESTED))
    joined = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return found.select("name", "file_path", joined("hooks"), joined("children"), F.array_join(F.transform("props", lambda p: F.concat(p["name"], F.lit(":"), p["type"])), ",").alias("props"))


def data_flow_kinds(spark, sf):
    return extract.data_flows(_files(spark, sf, NESTED_PATH, NESTED)).select("component_name", "file_path", "type", "name")


#: Modules, and folders that an index file stands for.
MODULE_PATH, FOLDER_PATH = "src/d<dk>/m<k>.ts", "lib/u<k>/index.ts"
MODULE = 'import x from "@lib/u<a>";\nimport { y } from "lib/u<b>";\nimport z from "@one/m<c>.js";\nexport * from "~/d<de>/m<e>";\nimport w from "./nothing";\nimport v from "..";\n'
FOLDER = 'export * from "../../src/d<dk>/m<k>";\nconst s = require("../u<a>");\nconst t = import(\'../u<b>/index\');\n'
RESOLVED_SQL = f"""{_P}, a AS (SELECT {_sql_filled(MODULE_PATH, 'k')} AS source, unnest([{_sql_filled(FOLDER_PATH, _A)}, {_sql_filled(FOLDER_PATH, _B)}, {_sql_filled(MODULE_PATH, NUMBERS['e'].format('k', 'n'))}]) AS target FROM p),
 b AS (SELECT {_sql_filled(FOLDER_PATH, 'k')} AS source, unnest([{_sql_filled(MODULE_PATH, 'k')}, {_sql_filled(FOLDER_PATH, _A)}, {_sql_filled(FOLDER_PATH, _B)}]) AS target FROM p)
SELECT DISTINCT source, target, 'import' AS type FROM (SELECT * FROM a UNION ALL SELECT * FROM b)"""


def import_resolution(spark, sf):
    """Aliases of several targets, the base directory, folders by their index file, and specifiers that lead nowhere."""
    modules, folders = _files(spark, sf, MODULE_PATH, MODULE), _files(spark, sf, FOLDER_PATH, FOLDER)
    aliases = extract.Aliases([("@lib/", ["missing/", "lib/"]), ("@one/", ["gone/", "away/"]), ("~/", ["src/"])], ".")
    return extract.import_edges(modules.unionByName(folders.withColumn("ord", -F.col("ord"))), aliases)


def imports_by_table_function(spark, sf):
    """The Ruby edges in SQL alone: the table function gives the specifiers, a join finds the files."""
    udtf.register(spark)
    files = _files(spark, sf, *LANGUAGES["ruby"][:2])
    return spark.sql(
        r"""SELECT DISTINCT f.path AS source, t.path AS target, 'import' AS type FROM {files} f JOIN LATERAL import_edges(f.text, 'ruby') i
        JOIN {files} t ON t.path = concat('lib/', regexp_replace(i.spec, '^[.][.]/', ''), '.rb') WHERE f.path <> t.path""",
        files=files,
    )


QUERIES = {f"import_edges_{x}": _edges_query(x) for x in LANGUAGES} | {f.__name__: f for f in (components, render_edges, data_flows, security_rules, security_issues, prop_issues, component_issues)}
SQL = {f"import_edges_{x}": _edges_sql(x) for x in LANGUAGES} | {"components": COMPONENTS_SQL, "render_edges": RENDER_SQL, "data_flows": FLOWS_SQL, "security_rules": RULES_SQL, "security_issues": ISSUES_SQL, "prop_issues": PROPS_SQL, "component_issues": GOD_SQL}
QUERIES["imports_by_table_function"], SQL["imports_by_table_function"] = imports_by_table_function, SQL["import_edges_ruby"]
QUERIES |= {f.__name__: f for f in (nested_components, data_flow_kinds, import_resolution)}
SQL |= {"nested_components": NESTED_SQL, "data_flow_kinds": FLOW_KINDS_SQL, "import_resolution": RESOLVED_SQL}
