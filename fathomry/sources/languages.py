"""Languages: extensions, folders to skip, and the grammars that the extractor reads."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Extensions and folders that hold no sources, by language.
EXTENSIONS = {
    "typescript": (".ts", ".tsx"),
    "javascript": (".js", ".jsx", ".mjs"),
    "python": (".py",),
    "go": (".go",),
    "java": (".java",),
    "kotlin": (".kt", ".kts"),
    "rust": (".rs",),
    "swift": (".swift",),
    "dart": (".dart",),
}
SKIPPED = {
    "typescript": ("node_modules", "dist", "build", ".next", ".nuxt", "coverage", "cdk.out"),
    "python": ("venv", ".venv", "__pycache__", ".tox", "egg-info"),
    "go": ("vendor",),
    "java": ("target", "build", ".gradle", ".mvn", "out", "bin"),
    "kotlin": ("build", ".gradle", "out", "bin"),
    "rust": ("target",),
    "swift": (".build", "DerivedData", "Pods", ".swiftpm"),
    "dart": (".dart_tool", ".pub-cache", "build", ".flutter-plugins", ".flutter-plugins-dependencies"),
}
MARKERS = {
    "typescript": ("tsconfig.json",), "javascript": ("package.json",), "python": ("pyproject.toml", "setup.py", "requirements.txt"), "go": ("go.mod",),
    "java": ("pom.xml", "build.gradle"), "kotlin": ("build.gradle.kts",), "rust": ("Cargo.toml",), "swift": ("Package.swift",), "dart": ("pubspec.yaml",),
}

BY_EXTENSION = {e: lang for lang, all_of in EXTENSIONS.items() for e in all_of}


def language_of(path: str) -> str | None:
    """Language by extension, whatever its case."""
    dot = path.rfind(".")
    return BY_EXTENSION.get(path[dot:].lower()) if dot > path.rfind("/") else None


def skipped_folders() -> list[str]:
    return sorted({d for all_of in SKIPPED.values() for d in all_of})


@dataclass(frozen=True)
class Declaration:
    """One kind of declaration: a pattern at the start of a line with a group ``name``.

    scope: its body names what is in it; inner: it counts inside such a body only.
    """

    kind: str
    pattern: re.Pattern
    scope: bool = False
    inner: bool = False


@dataclass(frozen=True)
class Grammar:
    declarations: tuple[Declaration, ...]
    keywords: frozenset[str] = field(default_factory=frozenset)
    raw_strings: tuple[str, ...] = ()
    #: A single quote opens a string (else a character of at most a few signs).
    single_quotes: bool = False


def _d(kind: str, pattern: str, scope: bool = False, inner: bool = False) -> Declaration:
    return Declaration(kind, re.compile(r"^[ \t]*" + pattern, re.M), scope, inner)


_FLOW = frozenset("if for while switch catch return function new typeof await super match when guard else do try with in is as sizeof throw assert yield".split())
_MOD = r"(?P<mod>(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|override|async|export|default|declare|readonly|synchronized|native|strictfp|transient|volatile|data|inline|value|inner|operator|infix|tailrec|external|suspend|lateinit|fileprivate|mutating|class|convenience|required|indirect|factory|const|late|get|set|unsafe|crate)\s+)*)"

GRAMMARS = {
    "typescript": Grammar(
        (
            _d("class", r"(?P<mod>(?:(?:export|default|abstract|declare)\s+)*)class\s+(?P<name>\w+)", scope=True),
            _d("interface", r"(?P<mod>(?:(?:export|default|declare)\s+)*)interface\s+(?P<name>\w+)"),
            _d("type", r"(?P<mod>(?:(?:export|declare)\s+)*)type\s+(?P<name>\w+)(?=\s*(?:<[^=]*>)?\s*=)"),
            _d("enum", r"(?P<mod>(?:(?:export|declare|const)\s+)*)enum\s+(?P<name>\w+)"),
            _d("function", r"(?P<mod>(?:(?:export|default|async|declare)\s+)*)function\s*\*?\s*(?P<name>\w+)(?=\s*[<(])"),
            _d("function", r"(?P<mod>(?:export\s+)?)(?:const|let|var)\s+(?P<name>\w+)(?=\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=\n]+)?=>|\w+\s*=>))"),
            _d("constructor", r"(?P<mod>(?:(?:public|private|protected)\s+)*)(?P<name>constructor)(?=\s*\()", inner=True),
            _d("method", r"(?P<mod>(?:(?:public|private|protected|static|abstract|override|readonly|async|get|set)\s+)*)\*?(?P<name>[#\w]+)(?=\s*(?:<[^>\n]*>)?\s*\([^;{}]*\)\s*(?::[^;{}=]+)?\{)", inner=True),
        ),
        _FLOW | {"constructor", "import", "require"},
        ("`",), True,
    ),
    "go": Grammar(
        (
            _d("method", r"func\s+\((?:\w+\s+)?\*?(?P<owner>\w+)(?:\[[^\]]*\])?\)\s*(?P<name>\w+)(?=\s*\()"),
            _d("function", r"func\s+(?P<name>\w+)(?=\s*[\[(])"),
            _d("class", r"type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+struct\b"),
            _d("interface", r"type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+interface\b"),
            _d("type", r"type\s+(?P<name>\w+)(?!\s*(?:\[[^\]]*\])?\s+(?:struct|interface)\b)(?=\s)"),
        ),
        _FLOW | {"func", "range", "select", "go", "defer", "make", "len", "append", "panic"},
        ("`",),
    ),
    "java": Grammar(
        (
            _d("decorator", _MOD + r"@interface\s+(?P<name>\w+)", scope=True),
            _d("class", _MOD + r"(?:class|record)\s+(?P<name>\w+)", scope=True),
            _d("interface", _MOD + r"interface\s+(?P<name>\w+)", scope=True),
            _d("enum", _MOD + r"enum\s+(?P<name>\w+)", scope=True),
            _d("method", _MOD + r"(?:<[^>\n]+>\s+)?(?P<ret>[\w.]+(?:<[^;{}()]*>)?(?:\[\])*)\s+(?P<name>\w+)(?=\s*\([^;{}]*\)\s*(?:throws\s+[\w.,\s]+)?[{;])", inner=True),
            _d("constructor", r"(?P<mod>(?:(?:public|private|protected)\s+)?)(?P<name>[A-Z]\w*)(?=\s*\([^;{}]*\)\s*(?:throws\s+[\w.,\s]+)?\{)", inner=True),
        ),
        _FLOW | {"synchronized"},
    ),
    "kotlin": Grammar(
        (
            _d("decorator", _MOD + r"annotation\s+class\s+(?P<name>\w+)"),
            _d("enum", _MOD + r"enum\s+class\s+(?P<name>\w+)", scope=True),
            _d("interface", _MOD + r"(?:fun\s+)?interface\s+(?P<name>\w+)", scope=True),
            _d("class", r"(?P<mod>(?:(?:public|private|protected|internal|abstract|sealed|open|data|inline|value|inner)\s+)*)class\s+(?P<name>\w+)", scope=True),
            _d("class", r"(?P<mod>(?:(?:public|private|internal|data|companion)\s+)*)object\s+(?P<name>\w+)", scope=True),
            _d("type", _MOD + r"typealias\s+(?P<name>\w+)"),
            _d("function", _MOD + r"fun\s+(?:<[^>]+>\s+)?(?:[\w.<>?]+\.)?(?P<name>\w+)(?=\s*\()"),
        ),
        _FLOW,
        ('"""',),
    ),
    "rust": Grammar(
        (
            _d("class", r"(?P<mod>(?:pub(?:\([^)]*\))?\s+)?)struct\s+(?P<name>\w+)"),
            _d("interface", r"(?P<mod>(?:pub(?:\([^)]*\))?\s+)?)(?:unsafe\s+)?trait\s+(?P<name>\w+)", scope=True),
            _d("enum", r"(?P<mod>(?:pub(?:\([^)]*\))?\s+)?)enum\s+(?P<name>\w+)"),
            _d("type", r"(?P<mod>(?:pub(?:\([^)]*\))?\s+)?)type\s+(?P<name>\w+)(?=[^=\n]*=)"),
            _d("function", r"(?P<mod>(?:pub(?:\([^)]*\))?\s+)?)macro_rules!\s+(?P<name>\w+)"),
            _d("scope", r"(?:unsafe\s+)?impl(?:<[^{]*?>)?\s+(?:[\w:]+(?:<[^{]*?>)?\s+for\s+)?(?P<name>\w+)", scope=True),
            _d("function", r"(?P<mod>(?:pub(?:\([^)]*\))?\s+)?(?:(?:unsafe|async|const|extern(?:\s+\"[^\"]*\")?)\s+)*)fn\s+(?P<name>\w+)(?=\s*[<(])"),
        ),
        (_FLOW | {"fn", "Some", "Ok", "Err", "loop", "unsafe"}) - {"new"},
    ),
    "swift": Grammar(
        (
            _d("class", r"(?P<mod>(?:(?:public|private|internal|open|fileprivate|final|indirect)\s+)*)(?:class|struct|actor)\s+(?!func\b|var\b)(?P<name>\w+)", scope=True),
            _d("interface", _MOD + r"protocol\s+(?P<name>\w+)", scope=True),
            _d("enum", r"(?P<mod>(?:(?:public|private|internal|open|fileprivate|indirect)\s+)*)enum\s+(?P<name>\w+)", scope=True),
            _d("scope", _MOD + r"extension\s+(?P<name>\w+)", scope=True),
            _d("type", _MOD + r"typealias\s+(?P<name>\w+)"),
            _d("constructor", _MOD + r"(?P<name>init)(?=[?!]?\s*[<(])", inner=True),
            _d("function", _MOD + r"func\s+(?P<name>\w+)(?=\s*[<(])"),
        ),
        _FLOW,
        ('"""',),
    ),
    "dart": Grammar(
        (
            _d("class", r"(?P<mod>(?:(?:abstract|sealed|base|final|interface|mixin)\s+)*)class\s+(?P<name>\w+)", scope=True),
            _d("class", r"mixin\s+(?!class\b)(?P<name>\w+)", scope=True),
            _d("enum", r"enum\s+(?P<name>\w+)", scope=True),
            _d("scope", r"extension\s+(?P<name>\w+)", scope=True),
            _d("type", r"typedef\s+(?P<name>\w+)"),
            _d("property", r"(?P<mod>(?:static\s+)?)(?:[\w<>?,]+\s+)?(?:get|set)\s+(?P<name>\w+)(?=\s*(?:\(|=>|\{|async))"),
            _d("function", r"(?P<mod>(?:(?:static|external|factory|const)\s+)*)(?P<ret>[\w.]+(?:<[^;{}()]*>)?\??)\s+(?P<name>\w+)(?=\s*\([^;{]*\)\s*(?:async\*?|sync\*)?\s*(?:\{|=>))"),
        ),
        _FLOW,
        ("'''", '"""'), True,
    ),
}
GRAMMARS["javascript"] = GRAMMARS["typescript"]
