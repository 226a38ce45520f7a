"""A file's imports, exports, declarations and calls: the small helper that runs inside ``operators.parse``.

Python is read with the standard ``ast`` module.  The brace languages share one scanner: comments and
string contents are blanked out (offsets stay), then the patterns of a language find declarations,
and counting brackets finds where they end.  Exotic syntax goes unseen rather than misread.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

Record = dict[str, object]
_ID = r"[A-Za-z_$][\w$]*"
_CHAIN = rf"{_ID}(?:\s*\??\.\s*{_ID})*"
# Modifiers before a declaration, in the order in which they are listed.
_SCRIPT_MODIFIERS = ("public", "private", "protected", "static", "async", "abstract", "readonly")
_OTHER_MODIFIERS = ("public", "private", "protected", "static", "async", "abstract", "final")
# Words that stand before a bracket without being called.
_NOT_CALLED = frozenset((
    "if", "for", "while", "switch", "catch", "function", "return", "typeof", "super", "import", "new", "await", "yield", "func", "match", "fn", "sizeof",
    "synchronized", "do", "else", "try", "in", "of", "instanceof", "throw", "delete", "void", "case",
))

# Patterns by language family: category, pattern with group ``name``, how the record ends.
_BLOCK, _LINE, _EXPR = "block", "line", "expr"
_PATTERNS: dict[str, list[tuple[str, str, str]]] = {
    "js": [
        ("classes", rf"\b(?:abstract\s+)?class\s+(?P<name>{_ID})", _BLOCK),
        ("functions", rf"\b(?:async\s+)?function\s*\*?\s*(?P<name>{_ID})\s*(?=[(<])", _BLOCK),
        ("variables", rf"(?:\b(?P<key>const|let|var)\s+)(?P<name>{_ID})(?:\s*:[^=;\n]+)?\s*(?==(?!=|>)|;|$|\n)", _EXPR),
    ],
    "ts": [
        ("interfaces", rf"\binterface\s+(?P<name>{_ID})", _BLOCK),
        ("enums", rf"\b(?:const\s+)?enum\s+(?P<name>{_ID})", _BLOCK),
        ("typeAliases", rf"\btype\s+(?P<name>{_ID})(?:<[^=]*>)?\s*(?==)", _LINE),
    ],
    "java": [
        ("classes", rf"(?:\b(?:public|private|protected|static|final|abstract)\s+)*\bclass\s+(?P<name>{_ID})", _BLOCK),
        ("interfaces", rf"(?:\b(?:public|private|protected|static)\s+)*\binterface\s+(?P<name>{_ID})", _BLOCK),
        ("enums", rf"(?:\b(?:public|private|protected|static)\s+)*\benum\s+(?P<name>{_ID})", _BLOCK),
        ("methods", rf"(?:\b(?:public|private|protected|static|final|abstract|synchronized)\s+)+(?:[\w.<>\[\], ?]+\s+)?(?P<name>{_ID})\s*(?=\([^()]*\)[^;{{=]*\{{)", _BLOCK),
        ("variables", rf"(?<=\s)(?:[A-Z]\w*(?:<[^<>;]*>)?|int|long|double|float|boolean|char|byte|short|var)(?:\[\])*\s+(?P<name>{_ID})\s*(?==(?!=))", _EXPR),
    ],
    "go": [
        ("classes", rf"(?<=\btype )\s*(?P<name>{_ID})\s+struct\b", _BLOCK),
        ("interfaces", rf"(?<=\btype )\s*(?P<name>{_ID})\s+interface\b", _BLOCK),
        ("functions", rf"\bfunc\s+(?P<name>{_ID})\s*(?=[(\[])", _BLOCK),
        ("methods", rf"\bfunc\s*\([^()]*\)\s*(?P<name>{_ID})\s*(?=\()", _BLOCK),
        ("variables", rf"\bvar\s+(?P<name>{_ID})\b|(?<![\w.,])(?P<name2>{_ID})(?:\s*,\s*{_ID})*\s*(?=:=)", _LINE),
    ],
    "rust": [
        ("classes", rf"(?:\bpub(?:\([^)]*\))?\s+)?\bstruct\s+(?P<name>{_ID})", _BLOCK),
        ("interfaces", rf"(?:\bpub(?:\([^)]*\))?\s+)?\btrait\s+(?P<name>{_ID})", _BLOCK),
        ("enums", rf"(?:\bpub(?:\([^)]*\))?\s+)?\benum\s+(?P<name>{_ID})", _BLOCK),
        ("functions", rf"(?:\bpub(?:\([^)]*\))?\s+)?(?:\basync\s+)?\bfn\s+(?P<name>{_ID})", _BLOCK),
        ("variables", rf"\blet\s+(?:mut\s+)?(?P<name>{_ID})", _LINE),
    ],
}
_IMPORTS = {
    "js": r"(?m)^[ \t]*import\b(?!\s*\()[^;'\"]*['\"][^'\"\n]*['\"]",
    "java": r"(?m)^[ \t]*import\s+[^;]+;",
    "go": r"(?m)^import\s+(?:\([^)]*\)|\"[^\"\n]*\")",
    "rust": r"(?m)^[ \t]*(?:pub\s+)?use\s+[^;]+;",
}
FAMILIES = {
    "javascript": "js", "js": "js", "mjs": "js", "cjs": "js", "react": "js", "jsx": "js",
    "typescript": "ts", "ts": "ts", "tsx": "ts", "react-ts": "ts", "python": "python", "java": "java", "go": "go", "rust": "rust",
}

_BLANKED = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.DOTALL)


def _blank(text: str, family: str) -> str:
    def cover(m: re.Match) -> str:
        s = m.group()
        if s[0] == "'" and family == "rust" and len(s) > 4:
            return s  # a lifetime, not a character
        keep = s[0] in "\"'`"
        inner = re.sub(r"[^\n]", " ", s[1:-1] if keep else s)
        return s[0] + inner + s[-1] if keep else inner

    return _BLANKED.sub(cover, text)


def _close(code: str, at: int) -> int:
    """The offset after the bracket that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(code)):
        if code[i] in "([{":
            depth += 1
        elif code[i] in ")]}":
            depth -= 1
            if depth == 0:
                return i + 1
    return len(code)


def _end(code: str, start: int, how: str) -> int:
    i = start
    while i < len(code):
        c = code[i]
        if c == "{" and how == _BLOCK:
            return _close(code, i)
        if c in "([{":
            i = _close(code, i)
            continue
        if c == ";" or c in ")]}" or (how == _EXPR and c == ",") or (how != _BLOCK and c == "\n" and code[start:i].strip()[-1:] not in ("", "=", ",", "&", "|", "+", ".", ">")):
            return i + (c == ";" and how == _BLOCK)
        i += 1
    return len(code)


def _modifiers(head: str, family: str) -> list[str]:
    return [w for w in (_SCRIPT_MODIFIERS if family in ("js", "ts") else _OTHER_MODIFIERS) if re.search(rf"(^|\s){w}(\s|$)", head)]


def _parameters(code: str, at: int) -> tuple[list[dict], int]:
    """Names and types in the bracket at ``at``, and the offset after it."""
    stop = _close(code, at)
    found = []
    for part in re.split(r",(?![^<(\[{]*[>)\]}])", code[at + 1 : stop - 1]):
        if part.strip():
            m = re.match(rf"\s*(?:\.\.\.|&|mut\s+|public\s+|private\s+|protected\s+|readonly\s+)*(?P<n>{_ID})\??\s*(?::\s*(?P<t>[^=]+))?", part)
            found.append({"name": m["n"] if m else "anonymous", "type": m["t"].strip() if m and m["t"] else None})
    return found, stop


def _record(category: str, name: str | None, start: int, end: int, **more: object) -> Record:
    return {"category": category, "name": name, "start": start, "end": end, **more}


def _js_import(text: str, m: re.Match) -> Record:
    start = m.start() + len(m.group()) - len(m.group().lstrip())
    body, module = text[start : m.end()], re.search(r"['\"]([^'\"]*)['\"]$", text[start : m.end()])
    clause = re.sub(r"^import\s*(?:type\s+)?|\s*\bfrom\s*['\"][^'\"]*['\"]$|['\"][^'\"]*['\"]$", "", body).strip()
    named, space = re.search(r"\{([^}]*)\}", clause), re.search(rf"\*\s*as\s+({_ID})", clause)
    default = re.match(rf"({_ID})\s*(?:,|$)", clause)
    bindings = [{"imported": "default", "local": default[1]}] if default else []
    for part in (named[1].split(",") if named else []):
        if names := re.findall(_ID, part):
            names = [n for n in names if n != "type"] or names
            bindings.append({"imported": names[0], "local": names[-1]})
    if space:
        bindings.append({"imported": "*", "local": space[1]})
    kind = ("mixed" if default else "named") if named else "namespace" if space else "default" if default else "side-effect"
    return _record("imports", None, start, m.end(), module=module[1] if module else None, kind=kind, bindings=bindings)


def _js_exports(code: str, text: str) -> Iterator[Record]:
    for m in re.finditer(r"(?m)(?<![\w.$])export\b", code):
        rest = code[m.end() :]
        default = re.match(r"\s+default\b", rest)
        head = re.match(rf"\s+(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?P<what>class|function\s*\*?|interface|enum|type|const|let|var)?\s*(?P<name>{_ID})?", rest)
        what = (head["what"] or "") if head else ""
        block = bool(re.match(r"class|function|interface|enum", what))
        end = _end(code, m.end(), _BLOCK if block else _LINE)
        name = head["name"] if head and head["name"] and what not in ("const", "let", "var") else "anonymous"
        yield _record("exports", name, m.start(), end + (code[end : end + 1] == ";"), kind="default" if default else "named")


def _methods(code: str, start: int, end: int, family: str) -> Iterator[Record]:
    """Methods at the first level of a class body."""
    at = code.find("{", start) + 1
    pattern = re.compile(rf"(?:\b(?:public|private|protected|static|async|abstract|readonly|override|get|set)\s+)*\*?\s*(?P<name>#?{_ID})\s*(?:<[^<>()]*>)?(?=\()")
    while 0 < at < end - 1:
        if code[at] in "{[(":
            at = _close(code, at)
            continue
        m = pattern.match(code, at)
        if m and m["name"] not in _NOT_CALLED and (at == 0 or not re.match(r"[\w$.]", code[at - 1])):
            parameters, stop = _parameters(code, m.end())
            tail = re.match(r"\s*(?::\s*(?P<t>[^{;=]+?))?\s*\{", code[stop:end])
            if tail:
                close = _close(code, stop + tail.end() - 1)
                head = code[m.start() : m.end()]
                yield _function("methods", m["name"], m.start(), close, head, parameters, tail["t"], family)
                at = close
                continue
            at = stop
            continue
        at = m.end() if m else at + 1


def _function(category: str, name: str, start: int, end: int, head: str, parameters: list, returns: str | None, family: str, whole: str = "") -> Record:
    words = _modifiers(whole or head, family)
    return _record(
        category, name, start, end, modifiers=words, parameters=parameters, return_type=returns.strip() if returns else None, visibility=next((w for w in words if w in ("public", "private", "protected")), None),
        is_async="async" in words or head.lstrip().startswith("async"), is_generator="*" in head, is_static="static" in words if family in ("js", "ts") else None,
    )


def _braces(text: str, family: str) -> Iterator[Record]:
    code, script = _blank(text, family), family in ("js", "ts")
    for m in re.finditer(_IMPORTS["js" if script else family], text):
        if code[m.start() : m.end()].strip():
            quoted = re.search(r"[\"']([^\"']+)[\"']", m.group())
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            yield _js_import(text, m) if script else _record("imports", None, start, m.end(), module=quoted[1] if quoted else None, kind="unknown", bindings=[])
    if script:
        yield from _js_exports(code, text)
    declared: set[int] = set()
    for category, pattern, how in _PATTERNS["js"] * script + _PATTERNS.get(family if family != "js" else "", []):
        for m in re.finditer(pattern, code, re.MULTILINE):
            name = m["name"] or m.groupdict().get("name2")
            start = m.start("name") if category == "variables" and script or family == "java" and category == "variables" else m.start() + len(m.group()) - len(m.group().lstrip())
            declared.add(m.start("name") if m["name"] else start)
            end = _end(code, m.end(), how)
            head = code[start : re.search(r"[({]|$", code[start:end]).start() + start]
            if category == "variables":
                before = code[max(0, m.start() - 8) : m.start()]
                yield _record(category, name, start, end, kind=m.groupdict().get("key") or ("let" if family == "rust" else "var" if m.group().startswith("var") else "unknown"), exported=bool(re.search(r"export\s*$", before)))
            elif category in ("functions", "methods"):
                bracket = code.find("(", m.end())
                parameters, stop = _parameters(code, bracket) if 0 <= bracket < end else ([], m.end())
                returns = re.match(r"\s*(?::|->)?\s*([^{;]*?)\s*(?:\{|;|$)", code[stop:end])
                yield _function(category, name, start, end, head, parameters, (returns[1] or None) if returns and (family != "java") else None, family, "" if script else text[start:end])
            else:
                more: Record = {"modifiers": _modifiers(head if script else text[start:end], family)}
                if category == "classes" and script:
                    inherits = code[m.end() : code.find("{", m.end())]
                    base, kinds = re.search(r"\bextends\s+([^\s{]+)", inherits), re.search(r"\bimplements\s+([^\s{]+)", inherits)
                    more |= {"extends": base[1] if base else None, "implements": kinds[1].split(",") if kinds else []}
                yield _record(category, name, start, end, **more)
                if category == "classes" and script:
                    for method in _methods(code, start, end, family):
                        declared.add(code.find(str(method["name"]), method["start"]))
                        yield method
    pattern = rf"(?<![\w$.])(?P<callee>{_CHAIN})\s*(?:\?\.)?\(" if family != "rust" else rf"(?<![\w.:])(?P<callee>{_ID}(?:(?:::|\.){_ID})*)\s*\("
    for m in re.finditer(pattern, code):
        callee = m["callee"]
        if callee.split(".")[0].strip() in _NOT_CALLED - {"super"} or m.start("callee") in declared or re.search(r"\b(?:function|func|fn|new)\s*\*?\s*$", code[max(0, m.start() - 12) : m.start()]):
            continue
        stop = _close(code, m.end() - 1)
        arguments = re.split(r",(?![^<(\[{]*[>)\]}])", code[m.end() : stop - 1]) if code[m.end() : stop - 1].strip() else []
        if family == "java" and "." in callee:
            callee = callee.rsplit(".", 1)[0]  # the receiver comes first there
        yield _record("calls", None, m.start("callee"), stop, callee=callee, arg_count=len(arguments), is_optional="?." in code[m.start() : stop])


def _python(text: str) -> Iterator[Record]:
    tree = ast.parse(text)
    starts = [0]
    for line in text.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    lines = text.splitlines(keepends=True)

    def span(node: ast.AST) -> tuple[int, int]:
        at = lambda row, column: starts[row - 1] + len(lines[row - 1].encode()[:column].decode(errors="ignore"))
        return at(node.lineno, node.col_offset), at(node.end_lineno, node.end_col_offset)

    for node in ast.walk(tree):
        if isinstance(node, ast.Import | ast.ImportFrom):
            a, b = span(node)
            quoted = re.search(r"[\"']([^\"']+)[\"']", text[a:b])
            yield _record("imports", None, a, b, module=quoted[1] if quoted else None, kind="unknown", bindings=[])
        elif isinstance(node, ast.ClassDef):
            a, b = span(node)
            yield _record("classes", node.name, a, b, modifiers=_modifiers(text[a:b], "python"))
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            a, b = span(node)
            parameters = [{"name": p.arg, "type": ast.unparse(p.annotation) if p.annotation else None} for p in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs)]
            yield _function("functions", node.name, a, b, text[a:b].split("(")[0], parameters, ast.unparse(node.returns) if node.returns else None, "python", text[a:b])
        elif isinstance(node, ast.Call):
            a, b = span(node)
            c, d = span(node.func)
            yield _record("calls", None, a, b, callee=text[c:d], arg_count=len(node.args) + len(node.keywords), is_optional=False)


#: Language to outliner; more can be registered.
REGISTRY: dict[str, Callable[[str], Iterator[Record]]] = {
    name: (_python if family == "python" else (lambda text, f=family: _braces(text, f))) for name, family in FAMILIES.items()
}


def register(language: str, outliner: Callable[[str], Iterator[Record]]) -> None:
    REGISTRY[language.lower()] = outliner


def outline(language: str, text: str) -> list[Record]:
    """Records of a file, the first of each (category, start, end); none if the file can't be read."""
    reader = REGISTRY.get(language.lower())
    if reader is None:
        return []
    try:
        found = sorted(reader(text), key=lambda r: (r["start"], -r["end"]))
    except (SyntaxError, ValueError, RecursionError):
        return []
    seen: set[tuple] = set()
    return [r for r in found if (k := (r["category"], r["start"], r["end"])) not in seen and not seen.add(k)]
