"""Structural facts of one source file: declarations, containment, imports, exports, calls, references, with byte spans.

Python is read by the standard library's parser and tokenizer, JSON by a scanner of its own; both are exact. Languages
with braces are read by a tokenizer that knows strings, comments and declaring words; TOML and YAML by lines and
indentation. What these cannot see (macros, computed names, types without a declaring word) is not invented, and their
results carry the warning `lexical_extraction`.

A fact is (class, start, end, syntax kind, name, module, parent key). Facts count against a ceiling in the order of a walk
from the outside in; what lies beyond is counted in `demand`, not emitted.
"""

from __future__ import annotations

import ast
import io
import json
import keyword
import re
import tokenize
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field

CLASSES = ("declaration", "contains", "import", "export", "call", "reference")
PLACE_OF_CLASS = {c: i for i, c in enumerate(CLASSES)}

# Languages by file ending, and the file names under which JSON counts as configuration.
LANGUAGES = {
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp", "cjs": "javascript", "clj": "clojure", "cljc": "clojure", "cljs": "clojure", "cs": "csharp",
    "ex": "elixir", "exs": "elixir", "go": "go", "hs": "haskell", "java": "java", "js": "javascript", "jsx": "jsx", "kt": "kotlin", "kts": "kotlin", "lhs": "haskell", "mjs": "javascript", "php": "php",
    "py": "python", "rb": "ruby", "rs": "rust", "scala": "scala", "swift": "swift", "toml": "toml", "ts": "typescript", "tsx": "tsx", "yaml": "yaml", "yml": "yaml",
}
STRICT_JSON = ("package.json", "deno.json", "composer.json", "manifest.json")
JSONC = ("tsconfig.json", "jsconfig.json", "devcontainer.json")
EDITOR_JSONC = ("settings.json", "tasks.json", "launch.json", "extensions.json")


@dataclass(slots=True)
class Fact:
    kind: str  # one of CLASSES
    start: int
    end: int
    syntax: str
    name: str | None = None
    module: str | None = None
    parent: str | None = None

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


@dataclass
class Parsed:
    facts: list[Fact] = field(default_factory=list)
    demand: int = 0
    syntax_errors: bool = False
    warnings: list[str] = field(default_factory=list)


class Source:
    """Byte places of a text's lines."""

    def __init__(self, data: bytes):
        self.data = data
        self.starts = [0, *(m.end() for m in re.finditer(rb"\r\n|\n|\r", data))]

    def line(self, number: int) -> bytes:
        end = self.starts[number] if number < len(self.starts) else len(self.data)
        return self.data[self.starts[number - 1] : end]

    def at(self, number: int, column: int) -> int:
        """Place of a column counted in bytes."""
        return self.starts[number - 1] + column

    def at_character(self, number: int, column: int) -> int:
        return self.starts[number - 1] + len(self.line(number).decode("utf-8", "replace")[:column].encode())


#: Syntax without anything below it that makes facts.
LEAVES = frozenset((ast.Name, ast.Constant, ast.Load, ast.Store, ast.Del, ast.Pass, ast.Break, ast.Continue, ast.alias))
#: What a pattern of names alone cannot read: strings, comments, joined lines, other line ends, letters beyond ASCII, numbers with letters or a point.
NOT_PLAIN = re.compile(rb"""['"#\\\r\f\x80-\xff]|(?<![A-Za-z0-9_])[0-9]+[A-Za-z_.]""")
PLAIN_NAME = re.compile(rb"((?:def|class)[ \t]+)?([A-Za-z_][A-Za-z0-9_]*)")
KEYWORDS = frozenset(k.encode() for k in keyword.kwlist)


def syntax_nodes(tree: ast.AST) -> Iterator[ast.AST]:
    """The nodes of a tree, without its leaves; not in the order of the text."""
    todo = [tree]
    while todo:
        node = todo.pop()
        yield node
        for name in node._fields:
            below = getattr(node, name, None)
            if isinstance(below, list):
                todo += [x for x in below if isinstance(x, ast.AST) and type(x) not in LEAVES]
            elif isinstance(below, ast.AST) and type(below) not in LEAVES:
                todo.append(below)


#: The syntax that makes facts.
PYTHON_NODES = frozenset((ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Assign, ast.AnnAssign, ast.Import, ast.ImportFrom, ast.Call, ast.Match, ast.TypeAlias))


def python_facts(data: bytes, wanted: Collection[str] = CLASSES) -> list[Fact]:
    """Facts of Python source, not yet nested. Raises SyntaxError. Calls and references that are not wanted may be left out."""
    source, tree = Source(data), ast.parse(data)
    found: list[Fact] = []
    soft: set[tuple[int, int]] = set()

    def span(node) -> tuple[int, int]:
        return source.at(node.lineno, node.col_offset), source.at(node.end_lineno, node.end_col_offset)

    matches = False
    for node in syntax_nodes(tree):
        if type(node) not in PYTHON_NODES:
            continue
        match node:
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                found.append(Fact("declaration", *span(node), "function_definition", node.name))
            case ast.ClassDef():
                found.append(Fact("declaration", *span(node), "class_definition", node.name))
            case ast.Assign():
                end = span(node)[1]
                for target in node.targets:
                    found.append(Fact("declaration", span(target)[0], end, "assignment", target.id if isinstance(target, ast.Name) else None))
            case ast.AnnAssign():
                found.append(Fact("declaration", *span(node), "assignment", node.target.id if isinstance(node.target, ast.Name) else None))
            case ast.Import():
                found.append(Fact("import", *span(node), "import_statement", module=next((a.name for a in node.names if not a.asname), None)))
            case ast.ImportFrom() if node.module != "__future__":
                found.append(Fact("import", *span(node), "import_from_statement", module="." * node.level + (node.module or "")))
            case ast.Call() if "call" in wanted:
                found.append(Fact("call", *span(node), "call", node.func.id if isinstance(node.func, ast.Name) else None))
            case ast.Match():
                matches = True
                soft.add((node.lineno, node.col_offset))
            case ast.TypeAlias():
                soft.add((node.lineno, node.col_offset))
    if not soft and not NOT_PLAIN.search(data):
        # its names are its words: the tokenizer would give the same ones
        if "reference" not in wanted:
            return found
        for m in PLAIN_NAME.finditer(data):
            if not m[1] and m[2] not in KEYWORDS:
                found.append(Fact("reference", m.start(2), m.end(2), "identifier", m[2].decode()))
        return found
    before = ""
    # characters are bytes where all of them are ASCII
    place_of = source.at if data.isascii() else source.at_character
    for token in tokenize.tokenize(io.BytesIO(data).readline):
        if token.type == tokenize.NAME:
            name, row = token.string, token.start[0]
            if not keyword.iskeyword(name) and before not in ("def", "class"):
                place = place_of(*token.start)
                column = place - source.starts[row - 1]
                is_case = matches and name == "case" and not source.line(row)[:column].strip()
                if (row, column) not in soft and not is_case:
                    found.append(Fact("reference", place, place + len(name.encode()), "identifier", name))
            before = name
        elif token.type not in (tokenize.NL, tokenize.COMMENT, tokenize.ENCODING):
            before = ""
    return found


STRING = re.compile(rb'"(?:[^"\\\x00-\x1f]|\\.)*"')


def json_facts(data: bytes, comments: bool) -> list[Fact]:
    """One declaration per key, spanning its pair. Raises ValueError for strict JSON that is none."""
    if not comments:
        json.loads(data)
    found: list[Fact] = []
    stack: list[list] = []  # open braces: [is object, open pair]
    at, last, key = 0, 0, None

    def close() -> None:
        pair = stack[-1][1] if stack else None
        if pair:
            pair.end = last
            found.append(pair)
            stack[-1][1] = None

    while at < len(data):
        c = data[at : at + 1]
        if c in b" \t\r\n":
            at += 1
        elif comments and data.startswith(b"//", at):
            at = data.find(b"\n", at) if data.find(b"\n", at) >= 0 else len(data)
        elif comments and data.startswith(b"/*", at):
            end = data.find(b"*/", at + 2)
            at = end + 2 if end >= 0 else len(data)
        elif c in b"{[":
            stack.append([c == b"{", None])
            at = last = at + 1
        elif c in b"}]":
            close()
            if stack:
                stack.pop()
            at = last = at + 1
        elif c == b",":
            close()
            at += 1
        elif c == b":":
            if stack and stack[-1][0] and key:
                stack[-1][1] = Fact("declaration", key[0], key[1], "pair", key[2])
            at += 1
        elif m := STRING.match(data, at):
            text = m[0][1:-1].decode("utf-8", "replace")
            key = (at, m.end(), text)
            at = last = m.end()
        else:
            m = re.compile(rb"[^\s,:\[\]{}]+").match(data, at)
            at = last = m.end() if m else at + 1
    return found


#: Words that declare, with the syntax kind each gives, by language; the name follows the word.
DECLARING = {
    "rust": {"fn": "function_item", "struct": "struct_item", "enum": "enum_item", "union": "union_item", "trait": "trait_item"},
    "go": {"func": "function_declaration", "type": "type_spec"},
    "java": {"class": "class_declaration", "interface": "interface_declaration", "enum": "enum_declaration", "record": "record_declaration"},
    "kotlin": {"class": "class_declaration", "interface": "class_declaration", "object": "object_declaration", "fun": "function_declaration", "typealias": "type_alias"},
    "csharp": {"class": "class_declaration", "interface": "interface_declaration", "struct": "struct_declaration", "enum": "enum_declaration", "record": "record_declaration", "delegate": "delegate_declaration"},
    "c": {"struct": "struct_specifier", "union": "union_specifier", "enum": "enum_specifier"},
    "cpp": {"class": "class_specifier", "struct": "struct_specifier", "union": "union_specifier", "enum": "enum_specifier", "namespace": "namespace_definition"},
    "javascript": {"function": "function_declaration", "class": "class_declaration", "const": "lexical_declaration", "let": "lexical_declaration", "var": "variable_declaration"},
    "php": {"function": "function_definition", "class": "class_declaration", "interface": "interface_declaration", "trait": "trait_declaration", "namespace": "namespace_definition", "enum": "enum_declaration"},
    "swift": {"func": "function_declaration", "class": "class_declaration", "struct": "class_declaration", "enum": "class_declaration", "protocol": "protocol_declaration", "typealias": "typealias_declaration"},
    "scala": {"class": "class_definition", "trait": "trait_definition", "object": "object_definition", "def": "function_definition", "enum": "enum_definition"},
    "ruby": {"class": "class", "module": "module", "def": "method"},
    "elixir": {"defmodule": "call", "def": "call", "defp": "call"},
    "haskell": {}, "clojure": {},
}
DECLARING["jsx"] = DECLARING["javascript"]
DECLARING["typescript"] = DECLARING["tsx"] = DECLARING["javascript"] | {"interface": "interface_declaration", "type": "type_alias_declaration", "enum": "enum_declaration"}
SCRIPT = ("javascript", "jsx", "typescript", "tsx")
HASH_COMMENT = ("ruby", "elixir", "php")
#: Lines that import, by language: the module is the first group.
IMPORTS = {
    "rust": r"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?use[ \t]+([^;]+);",
    "go": r'^[ \t]*(?:import[ \t]+)?(?:[A-Za-z_.][A-Za-z0-9_]*[ \t]+)?"([^"\n]+)"[ \t]*$',
    "java": r"^[ \t]*import[ \t]+(?:static[ \t]+)?([A-Za-z0-9_.]+(?:\.\*)?)[ \t]*;",
    "kotlin": r"^[ \t]*import[ \t]+([A-Za-z0-9_.]+)",
    "scala": r"^[ \t]*import[ \t]+([A-Za-z0-9_.]+)",
    "csharp": r"^[ \t]*using[ \t]+(?:static[ \t]+)?([A-Za-z0-9_.]+)[ \t]*;",
    "c": r'^[ \t]*#[ \t]*include[ \t]*(<[^>\n]+>|"[^"\n]+")',
    "cpp": r'^[ \t]*#[ \t]*include[ \t]*(<[^>\n]+>|"[^"\n]+")',
    "swift": r"^[ \t]*import[ \t]+([A-Za-z0-9_.]+)",
    "haskell": r"^import[ \t]+(?:qualified[ \t]+)?([A-Za-z0-9_.]+)",
    "ruby": r"""^[ \t]*(?:require|require_relative|load)[ \t(]+["']([^"'\n#]+)["']""",
    "elixir": r"^[ \t]*(?:import|alias|require|use)[ \t]+([A-Za-z0-9_.]+)",
    "php": r"""^[ \t]*(?:include|include_once|require|require_once)[ \t(]+["']([^"'\n$]+)["']""",
    "javascript": r"""^[ \t]*import[ \t][^;\n]*?["']([^"'\n]+)["'];?""",
}
for _name in ("jsx", "typescript", "tsx"):
    IMPORTS[_name] = IMPORTS["javascript"]
CODE_TOKEN = re.compile(
    rb"""(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)|(?P<name>[A-Za-z_$][A-Za-z0-9_$]*)|(?P<mark>[{}()\[\];.=])|(?P<other>\s+|.)""",
    re.DOTALL,
)
PLAIN_WORDS = frozenset("if else for while switch return match catch do in of new case break continue throw try finally import export from default as async await public private protected static final abstract const let var this self super pub use mod impl where mut ref void int true false null nil None loop end then begin package extends implements throws override val".split())


def closing(tokens: list, first: int) -> int:
    """Index of the token that ends a declaration: its closing brace, or the semicolon before any brace."""
    depth = round_ = 0
    for i in range(first, len(tokens)):
        t = tokens[i][2]
        if t in (b"(", b"["):
            round_ += 1
        elif t in (b")", b"]"):
            round_ -= 1
        elif t == b"{":
            depth += 1
        elif t == b"}":
            depth -= 1
            if depth <= 0:
                return i if depth == 0 else max(first, i - 1)
        elif t == b";" and depth == 0 and round_ <= 0:
            return i
    return len(tokens) - 1


def brace_facts(data: bytes, language: str) -> list[Fact]:
    """Facts of a language with braces, from its tokens and import lines."""
    found: list[Fact] = []
    declaring = {k.encode(): v for k, v in DECLARING.get(language, {}).items()}
    imported: list[tuple[int, int]] = []
    if pattern := IMPORTS.get(language):
        for m in re.finditer(pattern.encode(), data, re.MULTILINE):
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            imported.append((start, m.end()))
            found.append(Fact("import", start, m.end(), "import", module=m[1].decode("utf-8", "replace").strip()))
    if language in HASH_COMMENT:
        data = re.sub(rb"(?m)(^|\s)#[^{\n][^\n]*", lambda m: m[1] + b" " * (len(m[0]) - len(m[1])), data)
    tokens = [(m.start(), m.lastgroup, m[0]) for m in CODE_TOKEN.finditer(data) if m.lastgroup not in ("comment", "string") and m[0].strip()]
    named: set[int] = set()
    for i, (start, group, text) in enumerate(tokens):
        if group != "name" or text not in declaring or i + 1 >= len(tokens) or tokens[i + 1][1] != "name":
            continue
        if i and tokens[i - 1][2] == b".":
            continue
        end = closing(tokens, i + 2)
        name, named_at = tokens[i + 1][2].decode(), i + 1
        named.add(named_at)
        syntax = declaring[text]
        exported = language in SCRIPT and i and tokens[i - 1][2] in (b"export", b"default")
        found.append(Fact("declaration", start, tokens[end][0] + len(tokens[end][2]), syntax, name))
        if exported:
            found.append(Fact("export", tokens[i - 1][0], tokens[end][0] + len(tokens[end][2]), "export_statement", name))
    for i, (start, group, text) in enumerate(tokens):
        if group != "name" or i in named or text in declaring or text.decode() in PLAIN_WORDS:
            continue
        if any(a <= start < b for a, b in imported):
            continue
        member = i > 0 and tokens[i - 1][2] == b"."
        if i + 1 < len(tokens) and tokens[i + 1][2] == b"(":
            depth, j = 0, i + 1
            while j < len(tokens):
                depth += {b"(": 1, b")": -1}.get(tokens[j][2], 0)
                if depth == 0:
                    break
                j += 1
            j = min(j, len(tokens) - 1)
            found.append(Fact("call", start, tokens[j][0] + len(tokens[j][2]), "call_expression", None if member else text.decode()))
        elif not member:
            found.append(Fact("reference", start, start + len(text), "identifier", text.decode()))
    return found


def toml_facts(data: bytes) -> list[Fact]:
    """A declaration per table, up to the next table, and per pair."""
    found, table, last = [], None, 0
    for m in re.finditer(rb"[^\n]*\n?", data):
        line = m[0].strip()
        end = m.start() + len(m[0].rstrip())
        if head := re.fullmatch(rb"\[\[?\s*([^\]]+?)\s*\]\]?\s*(?:#.*)?", line):
            if table:
                table.end = last
            table = Fact("declaration", m.start() + m[0].index(b"["), end, "table_array_element" if line.startswith(b"[[") else "table", head[1].decode("utf-8", "replace"))
            found.append(table)
        elif pair := re.match(rb"([A-Za-z0-9_.\"'-]+)\s*=", line):
            found.append(Fact("declaration", m.start() + m[0].index(pair[0][:1]), end, "pair", pair[1].decode("utf-8", "replace")))
        if line and not line.startswith(b"#"):
            last = end
    if table:
        table.end = max(last, table.end)
    return found


def yaml_facts(data: bytes) -> list[Fact]:
    """A declaration per block mapping pair, up to the last deeper line."""
    found, open_, last = [], [], 0
    for m in re.finditer(rb"[^\n]*\n?", data):
        line = m[0].rstrip()
        if not line.strip() or line.strip().startswith(b"#"):
            continue
        pair = re.match(rb"(?P<indent>[ ]*(?:- +)*)(?P<key>[^\s#:'\"\[{][^:#]*|\"[^\"]*\"|'[^']*')\s*:(?:\s|$)", line)
        depth = len(pair["indent"]) if pair else len(line) - len(line.lstrip())
        while open_ and open_[-1][0] >= depth:
            open_.pop()[1].end = last
        last = m.start() + len(line)
        if pair:
            fact = Fact("declaration", m.start() + depth, last, "block_mapping_pair", pair["key"].strip().strip(b"\"'").decode("utf-8", "replace"))
            found.append(fact)
            open_.append((depth, fact))
    for _, fact in open_:
        fact.end = last
    return found


def nested(found: list[Fact], most: int) -> tuple[list[Fact], int]:
    """The facts in source order with their parents and containment, up to `most`, and how many there are in all."""
    walk = sorted(found, key=lambda f: (f.start, -f.end, PLACE_OF_CLASS[f.kind]))
    open_: list[Fact] = []
    out: list[Fact] = []
    demand = 0
    for fact in walk:
        while open_ and open_[-1].end < fact.end or open_ and open_[-1].end <= fact.start:
            open_.pop()
        parent = open_[-1].key if open_ else None
        fact.parent = parent
        contained = fact.kind == "declaration" and parent is not None
        demand += 1 + contained
        if len(out) + 1 + contained <= most:
            if contained:
                out.append(Fact("contains", fact.start, fact.end, "containment", fact.name, None, parent))
            out.append(fact)
        if fact.kind == "declaration":
            open_.append(fact)
    return out, demand


def fact_key(fact: Fact) -> str:
    return f"contains:{fact.parent}:declaration:{fact.start}:{fact.end}" if fact.kind == "contains" else fact.key


def parse(data: bytes, language: str, most: int, wanted: Collection[str] = CLASSES) -> Parsed:
    """Facts of one file, at most `most`, ordered by place, class and key.

    wanted: classes of the facts that are read. Others may be left out, and then neither count nor take of `most`.
    """
    out = Parsed()
    try:
        if language == "python":
            found = python_facts(data, wanted)
        elif language in ("json", "jsonc"):
            found = json_facts(data, language == "jsonc")
        elif language == "toml":
            found = toml_facts(data)
        elif language == "yaml":
            found = yaml_facts(data)
        else:
            found = brace_facts(data, language)
        if language not in ("python", "json", "jsonc"):
            out.warnings.append("lexical_extraction")
    except (SyntaxError, ValueError, tokenize.TokenError, RecursionError):
        out.syntax_errors = True
        out.warnings.append("strict_json_validation_failed" if language == "json" else "syntax_recovery_present")
        found = []
    facts, out.demand = nested(found, most)
    if out.demand > len(facts):
        out.warnings.append("structural_resource_limit_reached")
    out.facts = sorted(facts, key=lambda f: (f.start, f.end, PLACE_OF_CLASS[f.kind], fact_key(f)))
    return out


