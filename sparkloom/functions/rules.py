"""Ordered rule tables and their compilation to one Column (or SQL CASE), first match wins.

Patterns keep to what Java and RE2 read alike, but for word boundaries, which
Java takes to be Unicode ones: `java` puts ASCII ones in their place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def java(pattern: str) -> str:
    """The pattern with ASCII word boundaries."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


@dataclass(frozen=True)
class Rule:
    """A label for texts that match `pattern` and not `unless`; on the text as it is if `exact`, else on its small letters."""

    pattern: str
    label: str
    unless: str | None = None
    exact: bool = False


# Module type by path, first match wins; on lower-cased paths.
PATH_RULES = [
    Rule(r"\.(test|spec)\.|__tests__", "test"),
    Rule(r"/_?test[_s]?/|_test\.py$|test_\w+\.py$", "test"),
    Rule(r"_test\.go$", "test"),
    Rule(r"test\.java$|spec\.java$|test\.kt$", "test"),
    Rule(r"_test\.rs$|/tests/", "test"),
    Rule(r"tests?\.cs$|/tests?/", "test"),
    Rule(r"_test\.rb$|_spec\.rb$|/spec/", "test"),
    Rule(r"\.proto$", "schema"),
    Rule(r"\.graphql$|\.gql$", "schema"),
    Rule(r"schema\.prisma$", "schema"),
    Rule(r"\.html$|\.jinja2$|\.jinja$", "template"),
    Rule(r"\.blade\.php$|\.erb$|\.ejs$", "template"),
    Rule(r"/templates/|/views/.*\.html$", "template"),
    Rule(r"\.controller\.[tj]sx?$", "controller"),
    Rule(r"\.service\.[tj]sx?$", "service"),
    Rule(r"\.middleware\.[tj]sx?$", "middleware"),
    Rule(r"\.guard\.[tj]sx?$", "guard"),
    Rule(r"\.interceptor\.[tj]sx?$", "interceptor"),
    Rule(r"\.repository\.[tj]sx?$", "repository"),
    Rule(r"\.entity\.[tj]sx?$", "entity"),
    Rule(r"\.model\.[tj]sx?$", "model"),
    Rule(r"\.dto\.[tj]sx?$", "dto"),
    Rule(r"\.validator\.[tj]sx?$", "validator"),
    Rule(r"\.decorator\.[tj]sx?$", "decorator"),
    Rule(r"\.serializer\.[tj]sx?$", "serializer"),
    Rule(r"\.pipe\.[tj]sx?$", "validator"),
    Rule(r"\.directive\.[tj]sx?$", "directive"),
    Rule(r"\.composable\.[tj]sx?$", "composable"),
    Rule(r"\.module\.[tj]s$", "config"),
    Rule(r"controller\.(java|kt)$", "controller"),
    Rule(r"service\.(java|kt)$", "service"),
    Rule(r"repository\.(java|kt)$", "repository"),
    Rule(r"entity\.(java|kt)$", "entity"),
    Rule(r"config\.java$|configuration\.java$", "config"),
    Rule(r"application\.java$", "entry-point"),
    Rule(r"/src/main\.rs$", "entry-point"),
    Rule(r"/src/lib\.rs$", "entry-point"),
    Rule(r"/mod\.rs$", "config"),
    Rule(r"_handler\.rs$|/handlers?/.*\.rs$", "handler"),
    Rule(r"_service\.rs$|/services?/.*\.rs$", "service"),
    Rule(r"_model\.rs$|/models?/.*\.rs$", "model"),
    Rule(r"/config/.*\.rs$", "config"),
    Rule(r"/utils?/.*\.rs$", "util"),
    Rule(r"/db/.*\.rs$|_repo\.rs$", "repository"),
    Rule(r"views\.py$|/views/.*\.py$", "view"),
    Rule(r"urls\.py$", "route-config"),
    Rule(r"models\.py$|/models/.*\.py$", "model"),
    Rule(r"serializers\.py$|/serializers/.*\.py$", "serializer"),
    Rule(r"forms\.py$", "validator"),
    Rule(r"admin\.py$", "config"),
    Rule(r"tasks\.py$", "service"),
    Rule(r"manage\.py$|wsgi\.py$|asgi\.py$", "entry-point"),
    Rule(r"/migrations/.*\.py$", "migration"),
    Rule(r"/handlers?/.*\.go$|_handler\.go$", "handler"),
    Rule(r"/middleware/.*\.go$", "middleware"),
    Rule(r"/models?/.*\.go$", "model"),
    Rule(r"/repositor(y|ies)/.*\.go$|/repo/.*\.go$", "repository"),
    Rule(r"cmd/.*/main\.go$", "entry-point"),
    Rule(r"/services?/.*\.go$", "service"),
    Rule(r"/config/.*\.go$|_config\.go$", "config"),
    Rule(r"/utils?/.*\.go$|/pkg/.*\.go$", "util"),
    Rule(r"/store/.*\.go$", "store"),
    Rule(r"controller\.cs$", "controller"),
    Rule(r"service\.cs$", "service"),
    Rule(r"repository\.cs$", "repository"),
    Rule(r"program\.cs$|startup\.cs$", "entry-point"),
    Rule(r"controller\.php$", "controller"),
    Rule(r"/app/models/.*\.php$", "model"),
    Rule(r"service\.php$|/app/services/.*\.php$", "service"),
    Rule(r"repository\.php$|/app/repositories/.*\.php$", "repository"),
    Rule(r"middleware\.php$|/app/middleware/.*\.php$", "middleware"),
    Rule(r"/config/.*\.php$", "config"),
    Rule(r"provider\.php$", "config"),
    Rule(r"/database/migrations/.*\.php$", "migration"),
    Rule(r"request\.php$|/app/requests/.*\.php$", "validator"),
    Rule(r"resource\.php$|/app/resources/.*\.php$", "serializer"),
    Rule(r"controller\.rb$|/controllers/.*\.rb$", "controller"),
    Rule(r"/models/.*\.rb$", "model"),
    Rule(r"config\.ru$|/bin/rails", "entry-point"),
    Rule(r"_service\.rb$|/services?/.*\.rb$", "service"),
    Rule(r"/config/.*\.rb$", "config"),
    Rule(r"/lib/.*\.rb$", "util"),
    Rule(r"_job\.rb$|/jobs?/.*\.rb$", "service"),
    Rule(r"/mailers?/.*\.rb$", "service"),
    Rule(r"/serializers?/.*\.rb$", "serializer"),
    Rule(r"/middleware/.*\.rb$", "middleware"),
    Rule(r"/validators?/.*\.rb$", "validator"),
    Rule(r"/migrations?/", "migration"),
    Rule(r"/schemas?/", "schema"),
    Rule(r"/(database|db)/", "repository"),
    Rule(r"/controllers?/", "controller"),
    Rule(r"/services?/", "service"),
    Rule(r"/middlewares?/", "middleware"),
    Rule(r"/guards?/", "guard"),
    Rule(r"/interceptors?/", "interceptor"),
    Rule(r"/repositor(y|ies)/", "repository"),
    Rule(r"/entit(y|ies)/", "entity"),
    Rule(r"/models?/", "model"),
    Rule(r"/dtos?/", "dto"),
    Rule(r"/validators?/", "validator"),
    Rule(r"/decorators?/", "decorator"),
    Rule(r"/serializers?/", "serializer"),
    Rule(r"/composables?/", "composable"),
    Rule(r"/directives?/", "directive"),
    Rule(r"/api/|/routes/", "api-route"),
    Rule(r"/pages?/(.*/)?[^/]*page\.(tsx|jsx|ts|js)$", "page"),
    Rule(r"/pages?/", "page", unless=r"/components/"),
    Rule(r"layout\.(tsx|jsx)$", "layout"),
    Rule(r"/(hooks?|use)/", "hook"),
    Rule(r"/use[A-Z]", "hook", exact=True),
    Rule(r"/context/|context\.ts|provider\.ts", "context"),
    Rule(r"/store|slice\.ts|reducer\.ts", "store"),
    Rule(r"/types|\.types\.ts$|\.d\.ts$", "type"),
    Rule(r"/config/|\.config\.[tj]sx?$", "config"),
    Rule(r"/utils/|/lib/|/helpers/", "util"),
    Rule(r"(^|/)(main|server|app)\.[tj]sx?$", "entry-point"),
    Rule(r"/components/|\.tsx$|\.jsx$", "component"),
    Rule(r"\.vue$|\.svelte$", "component"),
]

# Module type by content, for files that no path rule knows.
CONTENT_RULES = [
    Rule(p, label, exact=True)
    for p, label in [
        (r"@Controller\b|@RestController\b", "controller"),
        (r"@Injectable\b|@Service\b", "service"),
        (r"@Entity\b", "entity"),
        (r"@Component\b|@NgModule\b", "component"),
        (r"@Repository\b", "repository"),
        (r"@Guard\b|@UseGuards\b", "guard"),
        (r"@Middleware\b", "middleware"),
        (r"defineComponent\s*\(", "component"),
        (r"<template>", "component"),
        (r"app\.(get|post|put|patch|delete)\s*\(", "controller"),
        (r"router\.(get|post|put|patch|delete)\s*\(", "controller"),
        (r"@app\.route\b|@router\.(get|post|put|delete)", "controller"),
        (r"class\s+\w+.*\bAPIView\b", "controller"),
        (r"class\s+\w+.*models\.Model\b", "model"),
        (r"class\s+\w+.*ViewSet\b", "view"),
        (r"class\s+\w+.*View\b.*:", "view"),
        (r"class\s+\w+.*Serializer\b", "serializer"),
        (r"class\s+\w+.*Form\b", "validator"),
        (r"func\s+\w+.*http\.Handler|func\s+\w+.*gin\.Context|func\s+\w+.*echo\.Context", "handler"),
        (r"@RequestMapping\b|@GetMapping\b|@PostMapping\b", "controller"),
        (r"@Configuration\b", "config"),
        (r"async fn handle", "handler"),
        (r"extends Controller", "controller"),
        (r"extends Model", "model"),
        (r"extends Middleware", "middleware"),
        (r"extends FormRequest", "validator"),
        (r"class \w+ < ApplicationController", "controller"),
        (r"class \w+ < ApplicationRecord", "model"),
        (r"class \w+ < ActiveJob::Base", "service"),
        (r"class \w+ < ApplicationMailer", "service"),
        (r"\[ApiController\]", "controller"),
        (r"\[HttpGet\]|\[HttpPost\]", "controller"),
        (r"class\s+\w+.*Migration\b", "migration"),
        (r"class\s+\w+.*Test\b|describe\s*\(|it\s*\(|test\s*\(", "test"),
    ]
]
#: Lines of a file that the content rules see.
HEAD_LINES = 150


def first_match(text: Column, rules: list[Rule], otherwise: str) -> Column:
    """The label of the first rule that holds: one CASE, whose branches are tried in turn."""
    low, out = F.lower(text), None
    for r in rules:
        side = text if r.exact else low
        holds = side.rlike(java(r.pattern))
        if r.unless:
            holds = holds & ~side.rlike(r.unless)
        out = F.when(holds, r.label) if out is None else out.when(holds, r.label)
    return out.otherwise(otherwise)


def first_match_sql(text: str, rules: list[Rule], otherwise: str) -> str:
    """The same as a DuckDB CASE."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for r in rules:
        side = text if r.exact else f"lower({text})"
        more = f" AND NOT regexp_matches({side}, {q(r.unless)})" if r.unless else ""
        parts.append(f"WHEN regexp_matches({side}, {q(r.pattern)}){more} THEN {q(r.label)}")
    return f"CASE {' '.join(parts)} ELSE {q(otherwise)} END"


def classify_path(path: Column) -> Column:
    return first_match(path, PATH_RULES, "unknown")


def head(text: Column, lines: int = HEAD_LINES) -> Column:
    return F.array_join(F.slice(F.split(text, "\n", -1), 1, lines), "\n")


def classify_content(text: Column) -> Column:
    """Module type by the first lines; null and empty texts stay unknown."""
    return F.when(F.length(text) > 0, first_match(head(text), CONTENT_RULES, "unknown")).otherwise("unknown")


@dataclass(frozen=True)
class SecurityRule:
    id: str
    kind: str
    severity: str
    languages: tuple[str, ...]
    pattern: str


_JS = ("javascript", "typescript")
# Line rules of the security scan; no language means all.
SECURITY_RULES = [
    SecurityRule("secret", "security-secret", "error", (), r"""(?i)(?:password|secret|api_key|apikey|token|private_key)\s*[:=]\s*["'][^"']{8,}"""),
    SecurityRule("eval-js", "security-injection", "error", _JS, r"\beval\s*\("),
    SecurityRule("new-function", "security-injection", "error", _JS, r"new\s+Function\s*\("),
    SecurityRule("eval-python", "security-injection", "error", ("python",), r"\b(?:eval|exec)\s*\("),
    SecurityRule("eval-ruby", "security-injection", "error", ("ruby",), r"\beval\s*\("),
    SecurityRule("eval-php", "security-injection", "error", ("php",), r"\beval\s*\("),
    SecurityRule("xss-innerhtml", "security-xss", "warning", _JS, r"\.innerHTML\s*="),
    SecurityRule("xss-dangerously", "security-xss", "warning", _JS, r"dangerouslySetInnerHTML"),
    SecurityRule("xss-document-write", "security-xss", "warning", _JS, r"document\.write\s*\("),
    SecurityRule("sql-injection-concat", "security-injection", "warning", (), r"""(?i)\b(?:SELECT|INSERT|UPDATE|DELETE)\b.*["']\s*\+\s*"""),
    SecurityRule("sql-injection-template", "security-injection", "warning", _JS, r"(?i)\b(?:SELECT|INSERT|UPDATE|DELETE)\b.*\$\{"),
    SecurityRule("insecure-crypto-md5", "security-crypto", "warning", _JS, r"""createHash\s*\(\s*["']md5["']\)"""),
    SecurityRule("insecure-crypto-md5-python", "security-crypto", "warning", ("python",), r"hashlib\.md5\s*\("),
    SecurityRule("insecure-crypto-sha1", "security-crypto", "warning", _JS, r"""createHash\s*\(\s*["']sha1["']\)"""),
    SecurityRule("cmd-injection-js", "security-injection", "error", _JS, r"child_process.*\bexec\s*\(.*\$\{"),
    SecurityRule("cmd-injection-python", "security-injection", "error", ("python",), r"""os\.system\s*\(.*f\""""),
    SecurityRule("cmd-injection-python-subprocess", "security-injection", "error", ("python",), r"subprocess.*shell\s*=\s*True"),
]
# Lines and files that the scan passes over.
COMMENT_LINE = r"^\s*(?://|#|/\*|\*|--)"
IMPORT_LINE = r"^\s*(?:import\b|from\b|require\s*\()"
TYPE_LINE = r"(?i)^\s*(?:type|interface|export\s+type|export\s+interface|readonly|class\s+\w+.*\{|\*|//|#|--|enum\s)"
TYPE_FIELD = r":\s*(?:string|number|boolean|\{)"
ESCAPE_FUNCTION = r"function\s+(?:esc|escHtml|sanitize|escape|encode)\s*\("
SKIPPED_FILES = r"(?i)\.d\.ts$|\.env\.example$|\.env\.sample$|\.env\.template$|security.scanner|security.analyzer|[/\\](?:__fixtures__|fixtures?|__mocks__|test-data|seed)[/\\]"
MOST_BYTES = 100_000

# What counts as a branch, by language family, and what is stripped first.
BRANCHES = {
    "c": (r"\b(?:if|else\s+if|else|switch|case|for|while|do|try|catch|finally)\b", r"\?\s*[^?:]", r"&&|\|\|"),
    "python": (r"\b(?:if|elif|else|for|while|try|except|finally|with|match|case)\b", r"\bif\b.+\belse\b", r"\band\b|\bor\b"),
    "ruby": (r"\b(?:if|elsif|else|unless|case|when|for|while|until|begin|rescue|ensure)\b", r"&&|\|\|"),
}
#: (Java pattern, RE2 pattern, replacement); the possessive Java form cannot exhaust the stack on long literals.
STRIPS = [
    (r"(?s)/\*.*?\*/", r"(?s)/\*.*?\*/", ""),
    (r'(?s)""".*?"""', r'(?s)""".*?"""', ""),
    (r"(?s)'''.*?'''", r"(?s)'''.*?'''", ""),
    (r"//[^\n\r\x{2028}\x{2029}]*", r"//[^\n\r\x{2028}\x{2029}]*", ""),
    (r"#[^\n\r\x{2028}\x{2029}]*", r"#[^\n\r\x{2028}\x{2029}]*", ""),
    (r'(?s)"(?:[^"\\]++|\\.)*+"', r'(?s)"(?:[^"\\]|\\.)*"', '""'),
    (r"(?s)'(?:[^'\\]++|\\.)*+'", r"(?s)'(?:[^'\\]|\\.)*'", "''"),
    (r"(?s)`(?:[^`\\]++|\\.)*+`", r"(?s)`(?:[^`\\]|\\.)*`", "``"),
]
