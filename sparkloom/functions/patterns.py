"""Patterns of import statements, read alike by the JVM and by Python."""

_SCRIPT = [
    ("script", r"""(?:import|export)\s+(?:[\s\S]*?\s+from\s+)?["']([^"']+)["']"""),
    ("script", r"""require\s*\(\s*["']([^"']+)["']\s*\)"""),
    ("script", r"""import\s*\(\s*["']([^"']+)["']\s*\)"""),
]
_JVM = [("java", r"(?m)^import\s+(?:static\s+)?([\w.]+)")]
# The patterns of import statements by language, (kind, pattern with the specifier as its group).
IMPORTS = {
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "python": [("python", r"(?m)^import\s+([\w.]+)"), ("python", r"(?m)^from\s+(\.*(?:\w[\w.]*)?)\s+import\s+")],
    "go": [("go", r'import\s+"([^"]+)"')],
    "java": _JVM,
    "kotlin": _JVM,
    "rust": [("crate", r"use\s+(crate(?:::\w+)+)"), ("mod", r"(?m)^mod\s+(\w+)\s*;"), ("super", r"use\s+super::(\w+(?:::\w+)*)")],
    "csharp": [("csharp", r"(?m)^using\s+(?:static\s+)?([\w.]+)\s*;")],
    "php": [("php", r"(?m)^use\s+([\w\\]+)"), ("include", r"""(?:require|include)(?:_once)?\s*\(?\s*['"]([^'"]+)['"]""")],
    "ruby": [("ruby", r"""require\s+['"]([^'"]+)['"]"""), ("ruby_relative", r"""require_relative\s+['"]([^'"]+)['"]""")],
}
GO_BLOCK, GO_LINE = r"import\s*\(([\s\S]*?)\)", r'"([^"]+)"'
