"""Entities and relations from source files: Python by its own parser, JavaScript and TypeScript by a small lexer.

`extract` turns files into rows in one `mapInArrow`; links between files are joins. Rows: (kind, seq, id, label, file_type,
source_file, start_line, end_line, source, target, relation, callee, module, name).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import constants as C

SCHEMA = "kind string, seq long, id string, label string, file_type string, source_file string, start_line int, end_line int, source string, target string, relation string, callee string, module string, name string"
ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[c.split()[1]]) for c in SCHEMA.split(", ")])
REASONS = tuple(C.REASON_MARKS)


def slug(*parts: str) -> str:
    words = (re.findall("[0-9A-Za-z]+", p) for p in parts)
    return "_".join(w for some in words for w in some).lower()


class Rows:
    def __init__(self, path: str) -> None:
        self.path, self.rows, self.known = path, [], {}
        self.stem = re.sub(r"\.[^.]*$", "", path)
        self.file = slug(path)
        self.node(self.file, path.rsplit("/", 1)[-1], 1, None)

    def add(self, **row) -> None:
        self.rows.append({"source_file": self.path, **row})

    def ends(self, i: str | None, line: int) -> None:
        """The node's last line."""
        if i is not None:
            self.known[i]["end_line"] = line

    def node(self, i: str, label: str, start: int, end: int | None, file_type: str = "code") -> str:
        if i not in self.known:
            self.add(kind="node", id=i, label=label, file_type=file_type, start_line=start, end_line=end)
            self.known[i] = self.rows[-1]
        return i

    def edge(self, source: str, target: str, relation: str, line: int) -> None:
        if source != target:
            self.add(kind="edge", source=source, target=target, relation=relation, start_line=line)


def python_rows(path: str, text: str) -> list[dict]:
    out = Rows(path)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return out.rows
    named: dict[str, str] = {}
    bodies: list[tuple[str, ast.AST]] = []

    def reason(owner: str, node: ast.AST) -> None:
        doc = ast.get_docstring(node)
        if doc and len(doc) > 20:
            i = out.node(slug(out.stem, "rationale", str(node.body[0].lineno)), doc.strip().split("\n")[0][:80], node.body[0].lineno, None, "rationale")
            out.edge(i, owner, "rationale_for", node.body[0].lineno)

    def visit(body: list[ast.stmt], owner: str, inside: str | None) -> None:
        for n in body:
            if isinstance(n, ast.ClassDef):
                i = named[n.name] = out.node(slug(out.stem, n.name), n.name, n.lineno, n.end_lineno)
                out.edge(owner, i, "contains", n.lineno)
                for b in n.bases:
                    if isinstance(b, (ast.Name, ast.Attribute)):
                        name = b.id if isinstance(b, ast.Name) else b.attr
                        out.add(kind="inherit", source=i, callee=name, start_line=n.lineno)
                reason(i, n)
                visit(n.body, i, n.name)
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                i = out.node(slug(out.stem, inside, n.name) if inside else slug(out.stem, n.name), f".{n.name}()" if inside else f"{n.name}()", n.lineno, n.end_lineno)
                named.setdefault(n.name, i)
                out.edge(owner, i, "method" if inside else "contains", n.lineno)
                reason(i, n)
                bodies.append((i, n))
            elif isinstance(n, ast.Import):
                for a in n.names:
                    out.edge(out.file, slug(a.name), "imports", n.lineno)
            elif isinstance(n, ast.ImportFrom):
                folder = path.split("/")[: -n.level] if n.level else []
                module = ".".join(x for x in [*folder, n.module or ""] if x)
                target = slug("/".join(folder + (n.module or "").split(".")) + ".py") if n.level else slug(n.module or "")
                out.edge(out.file, target, "imports_from", n.lineno)
                for a in n.names:
                    out.add(kind="import", source=out.file, module=module.rsplit(".", 1)[-1], name=a.name, start_line=n.lineno)
            elif isinstance(n, (ast.If, ast.Try, ast.With)):
                visit(n.body, owner, inside)

    reason(out.file, tree)
    visit(tree.body, out.file, None)
    seen = set()
    for owner, node in bodies:
        for c in ast.walk(node):
            if isinstance(c, ast.Call) and isinstance(c.func, (ast.Name, ast.Attribute)):
                name = c.func.id if isinstance(c.func, ast.Name) else c.func.attr
                target = named.get(name)
                if target and target != owner:
                    if (owner, target) not in seen:
                        seen.add((owner, target))
                        out.edge(owner, target, "calls", c.lineno)
                elif not target:
                    out.add(kind="call", source=owner, callee=name, start_line=c.lineno)
    for k, line in enumerate(text.split("\n"), 1):
        mark = line.strip().lstrip("#").strip()
        if line.strip().startswith("#") and mark.startswith(REASONS):
            out.edge(out.node(slug(out.stem, "rationale", str(k)), mark[:80], k, None, "rationale"), out.file, "rationale_for", k)
    return out.rows


JS = re.compile(r"""(?P<skip>//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`)|\bclass\s+(?P<cls>\w+)(?:\s+extends\s+(?P<base>[\w.]+))?|\bfunction\s*\*?\s*(?P<fn>\w+)\s*\(|\b(?:const|let|var)\s+(?P<arrow>\w+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=\n]+)?=>|(?P<open>\{)|(?P<close>\})|(?P<call>\b\w+)\s*\(""", re.S)
JS_IMPORT = re.compile(r"""^\s*(?:import|export)\b[^'"\n;]*?from\s*['"]([^'"]+)['"]|^\s*import\s*['"]([^'"]+)['"]|\brequire\(\s*['"]([^'"]+)['"]\s*\)""", re.M)
NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "function", "require", "import", "super", "await", "typeof"}


def script_rows(path: str, text: str) -> list[dict]:
    """JavaScript and TypeScript: imports, classes, methods, functions and arrow functions bound to names, and calls in them."""
    out = Rows(path)
    lines = [m.start() for m in re.finditer("\n", text)]
    at = lambda p: 1 + sum(x < p for x in lines) if len(lines) < 64 else 1 + _before(lines, p)
    for m in JS_IMPORT.finditer(text):
        target = next(g for g in m.groups() if g)
        if target.startswith("."):
            parts = path.split("/")[:-1]
            for x in target.split("/"):
                parts = parts[:-1] if x == ".." else parts if x == "." else [*parts, x]
            name = re.sub(r"\.jsx?$", lambda e: e.group().replace("js", "ts"), "/".join(parts))
        else:
            name = target.rsplit("/", 1)[-1]
        out.edge(out.file, slug(name), "imports_from", at(m.start()))
    depth, stack, named, calls = 0, [], {}, []
    pending: tuple[str, str] | None = None
    for m in JS.finditer(text):
        if m["skip"] is not None:
            continue
        inside = next((s for s in reversed(stack) if s[2] == "class"), None)
        if m["cls"]:
            i = named[m["cls"]] = out.node(slug(out.stem, m["cls"]), m["cls"], at(m.start()), None)
            out.edge(out.file, i, "contains", at(m.start()))
            if m["base"]:
                out.add(kind="inherit", source=i, callee=m["base"].rsplit(".", 1)[-1], start_line=at(m.start()))
            pending = (i, "class")
        elif m["fn"] or m["arrow"]:
            name = m["fn"] or m["arrow"]
            i = named[name] = out.node(slug(out.stem, name), f"{name}()", at(m.start()), None)
            out.edge(out.file, i, "contains", at(m.start()))
            pending = (i, "function")
            if m["arrow"] and not text[m.end() : m.end() + 200].lstrip().startswith("{"):  # an expression, without a block of its own
                pending = None
                stop = re.compile(r";|\n(?!\s*[.?:+)\]}])").search(text, m.end())
                out.ends(i, at(stop.start() if stop else len(text)))
        elif m["open"]:
            depth += 1
            stack.append((pending[0] if pending else None, depth, pending[1] if pending else "block"))
            pending = None
        elif m["close"]:
            if stack:
                out.ends(stack.pop()[0], at(m.start()))
            depth = max(0, depth - 1)
        elif m["call"] and m["call"] not in NOT_CALLS:
            if inside and stack[-1] is inside and re.match(r"[^)]*\)\s*(?::[^{=;]+)?\{", text[m.end() : m.end() + 400]):
                i = out.node(slug(inside[0], m["call"]), f".{m['call']}()", at(m.start()), None)
                named.setdefault(m["call"], i)
                out.edge(inside[0], i, "method", at(m.start()))
                pending = (i, "function")
            else:
                owner = next((s[0] for s in reversed(stack) if s[0] and s[2] == "function"), None)
                if owner:
                    calls.append((owner, m["call"], at(m.start())))
    seen = set()
    for owner, name, line in calls:
        target = named.get(name)
        if not target:
            out.add(kind="call", source=owner, callee=name, start_line=line)
        elif (owner, target) not in seen:
            seen.add((owner, target))
            out.edge(owner, target, "calls", line)
    return out.rows


def _before(places: list[int], p: int) -> int:
    import bisect

    return bisect.bisect_left(places, p)


PARSERS = {".py": python_rows, ".js": script_rows, ".mjs": script_rows, ".ejs": script_rows, ".jsx": script_rows, ".ts": script_rows, ".tsx": script_rows}


def extract(files: DataFrame, parsers: dict | None = None) -> DataFrame:
    """Rows of all files (path, text) whose ending has a parser; more languages come in by `parsers` (ending -> function)."""
    table = {**PARSERS, **(parsers or {})}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ending = re.search(r"[.][^./]+$", path or "")
                parse = table.get(ending[0].lower()) if ending else None
                got = parse(path, text or "") if parse else []
                rows += [{**r, "seq": i} for i, r in enumerate(got)]
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return files.select("path", "text").mapInArrow(run, SCHEMA)


def link_calls(rows: DataFrame) -> DataFrame:
    """Inferred `calls` edges of callees that no entity of their file has: to the last entity of that name anywhere, never
    to oneself nor where an edge is already."""
    nodes = rows.where("kind = 'node'").withColumn("key", F.lower(F.regexp_replace(F.regexp_replace("label", r"[()]+$", ""), r"^\.+", "")))
    named = nodes.groupBy("key").agg(F.max_by("id", F.struct("source_file", "seq")).alias("target"))
    have = rows.where("kind = 'edge'").select("source", "target")
    calls = rows.where("kind = 'call'").withColumn("key", F.lower("callee"))
    found = calls.drop("target").join(named, "key")
    return found.where("source <> target").join(have, ["source", "target"], "left_anti").select("source", "target", F.lit("calls").alias("relation"), F.lit("INFERRED").alias("confidence"), F.lit(0.8).alias("confidence_score"), "source_file").dropDuplicates(["source", "target"])


def link_imports(rows: DataFrame) -> DataFrame:
    """Inferred `uses` edges: every class of a file that imports an entity by name uses that entity."""
    nodes = rows.where("kind = 'node' AND file_type = 'code'")
    entities = nodes.select(F.regexp_extract("source_file", r"([^/]+)\.[^./]+$", 1).alias("module"), F.regexp_replace("label", r"[.()]", "").alias("name"), F.col("id").alias("target"))
    local = nodes.where(~F.col("label").contains("(") & F.col("end_line").isNotNull()).select("source_file", F.col("id").alias("source"))
    wanted = rows.where("kind = 'import'").select("source_file", "module", "name")
    return wanted.join(entities, ["module", "name"]).join(local, "source_file").where("source <> target").select("source", "target", F.lit("uses").alias("relation"), F.lit("INFERRED").alias("confidence"), F.lit(0.8).alias("confidence_score"), "source_file").dropDuplicates(["source", "target"])


def link_bases(rows: DataFrame) -> DataFrame:
    """`inherits` edges: to the class of that name in the same file, else the last anywhere."""
    nodes = rows.where("kind = 'node'").select(F.col("label").alias("callee"), F.col("id").alias("_id"), F.col("source_file").alias("_file"), "seq")
    want = rows.where("kind = 'inherit'").select("source", "callee", "source_file")
    j = want.join(nodes, "callee")
    return j.groupBy("source", "callee", "source_file").agg(F.max_by("_id", F.struct(F.col("_file") == F.col("source_file"), "_file", "seq")).alias("target")).select("source", "target", F.lit("inherits").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("confidence_score"), "source_file")
