"""The node table: one row for every part of a Python file's syntax, and all that follows is joins.

A file is parsed once. Its nodes are numbered in the order in which they begin
(``node``) and end (``post``), and ``last`` is the number of a node's last
descendant, so b lies in a if a.node < b.node <= a.last. Children of one list
have numbers ``nth``, so a run of siblings is a difference of two. Names,
comments and decorated definitions, which a syntax tree of Python leaves out,
are nodes of their own: names are leaves, with what they do in ``use``.

A file that does not parse has no rows; one that parses has at least its module.
"""

from __future__ import annotations

import ast
import hashlib
import io
import keyword
import re
import tokenize
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.scratch import large
from corvane.ship import ship

NODE = (
    "file string, node int, parent int, last int, post int, kind string, field string, nth int, statement boolean, name string, use string,"
    " head string, first_line string, digest string, start bigint, end bigint, start_line bigint, end_line bigint"
)
COLUMNS = [x.split()[0] for x in NODE.split(", ")]
#: clips of a node's text and of what it is about
MOST_HEAD, MOST_NAME = 500, 200
ROWS = 20_000
# Kinds that have a name of their own; the others are called as in ``ast``.
KINDS = {
    "Module": "module", "FunctionDef": "function_definition", "AsyncFunctionDef": "function_definition", "ClassDef": "class_definition",
    "Import": "import_statement", "ImportFrom": "import_from_statement", "Call": "call", "Assign": "assignment", "AnnAssign": "assignment",
    "AugAssign": "assignment", "NamedExpr": "assignment", "Global": "global_statement", "Nonlocal": "nonlocal_statement", "Lambda": "lambda",
    "ListComp": "comprehension_scope", "SetComp": "comprehension_scope", "DictComp": "comprehension_scope", "GeneratorExp": "comprehension_scope",
}


CLASSES = {k: tuple(x for x, kind in KINDS.items() if kind == k) for k in KINDS.values()} | {"string": ("Constant",)}


#: syntax without places and parts
BARE = (ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop)
#: nodes that may say what a name does, see bound()
BINDERS = {
    "Name", "FunctionDef", "AsyncFunctionDef", "ClassDef", "arg", "Attribute", "keyword", "alias", "ImportFrom", "Global", "Nonlocal", "ExceptHandler", "MatchAs", "MatchStar", "MatchMapping",
}
WORDS = set(keyword.kwlist)
LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+\Z")
#: a word right below these is part of their syntax: match, case, type, the r of {x!r}
SOFT = ("Match", "match_case", "TypeAlias", "FormattedValue")
#: a text without these has none of them
SOFT_TEXT = re.compile("match|type|[\"']")
NAMES_ONLY = {"identifier"}
#: fields that never hold syntax with places
PLAIN = {"ctx", "op", "ops", "id", "attr", "arg", "asname", "kind", "type_comment", "type_ignores", "level", "module", "conversion", "is_async", "simple"}
STRINGS = re.compile("[\"'\r]")
COMMENT = re.compile(r"(?P<comment>#[^\n]*)")
WORD = re.compile(rf"{COMMENT.pattern}|{tokenize.Number}|(?P<name>[^\W\d]\w*)", re.ASCII)


@lru_cache(maxsize=1)
def line_starts(source: str) -> list[int]:
    """Bytes before each line."""
    if source.isascii() and "\r" not in source:
        ends = list(accumulate([len(row) + 1 for row in source.split("\n")], initial=0))
        ends[-1] -= 1  # the last line has no end
        return ends[:-1] if source.endswith("\n") or not source else ends
    starts = [0]
    for row in LINE.findall(source):
        starts.append(starts[-1] + len(row.encode()))
    return starts


class Part:
    __slots__ = ("start", "end", "deep", "kind", "field", "nth", "x", "use", "name", "parent", "node", "last", "post", "lines")

    def __init__(self, start, end, deep, kind, field, nth, x, use=None, name=None, lines=(0, 0)):
        self.start, self.end, self.deep, self.kind, self.field, self.nth, self.x = start, end, deep, kind, field, nth, x
        self.use, self.name, self.lines, self.parent, self.last = use, name, lines, None, None


class Wanted:
    """Which parts are wanted, said before they are made: parsing looks no further than where they can lie, and makes no others.

    ``kinds``, all ``statements``, or names by what they ``do``. ``within``: "all" syntax, "statements" (nothing below
    expressions), or "top" (the module and all parts right below it). Numbers then count the parts that are made.
    """

    def __init__(self, *kinds: str, statements: bool = False, do: tuple[str, ...] = (), within: str = "all"):
        self.kinds, self.statements, self.do, self.within = frozenset(kinds), statements, do, within

    def __call__(self, p: Part) -> bool:
        if self.within == "top":
            return not p.parent
        return p.kind in self.kinds or p.use in self.do or (self.statements and statement(p))


class Sort:
    """What the walk has to know of a class of syntax; ``bodies`` are the fields with statements or what holds them."""

    __slots__ = ("name", "kind", "fields", "bodies", "statement", "placed", "decorated", "binds")

    def __init__(self, cls: type):
        self.name = cls.__name__
        self.kind = KINDS.get(self.name, self.name)
        # a name is a word, but for that of a type
        self.fields = () if cls is ast.Constant else tuple(f for f in cls._fields if f not in PLAIN and (f != "name" or cls is ast.TypeAlias))
        self.statement = issubclass(cls, ast.stmt)
        holds = self.statement or issubclass(cls, (ast.mod, ast.ExceptHandler, ast.match_case))
        self.bodies = tuple(f for f in ("body", "handlers", "orelse", "finalbody", "cases") if f in cls._fields) if holds else ()
        self.placed = "end_lineno" in cls._attributes
        self.decorated, self.binds = "decorator_list" in cls._fields, self.name in BINDERS


class Sorts(dict):
    def __missing__(self, cls: type) -> Sort | None:
        self[cls] = out = Sort(cls) if issubclass(cls, ast.AST) and not issubclass(cls, BARE) else None
        return out


SORTS = Sorts()


def leaves(source: str, starts: list[int], names: bool) -> Iterator[tuple[bool, str, int, int, tuple[int, int]]]:
    """Comments and, if asked, names that are no keywords: whether it is a comment, its text, bytes and lines."""
    if source.isascii() and not STRINGS.search(source):
        # without strings, comments, numbers and names are told apart by how they begin
        for m in (WORD if names else COMMENT).finditer(source):
            comment = m.lastgroup == "comment"
            if comment or (m.lastgroup == "name" and m.group() not in WORDS):
                line = bisect_right(starts, m.start())
                yield comment, m.group(), m.start(), m.end(), (line, line)
        return
    rows, plain = LINE.findall(source), source.isascii()
    for type_, word, (line, col), (last, _), _ in tokenize.generate_tokens(io.StringIO(source).readline):
        if type_ == tokenize.COMMENT or (type_ == tokenize.NAME and names and word not in WORDS):
            a = starts[line - 1] + (col if plain else len(rows[line - 1][:col].encode()))
            yield type_ == tokenize.COMMENT, word, a, a + (len(word) if plain else len(word.encode())), (line, last)


def parsed(source: str, names: str = "all", only: Wanted | None = None, uses_wanted: bool = True) -> list[Part]:
    """The numbered parts of a file, in order; none if it does not parse.

    ``names``: leaves of "all" names, of those that are "bound" (not only read), or of "none"; numbers leave no gaps.
    ``only``: parts of other kinds need not be made. ``uses_wanted``: what names do is read.
    """
    within, kinds, statements = ("all", None, True) if only is None else (only.within, only.kinds, only.statements)
    defined = only is not None and only.do == ("definition",) and names != "none" and source.isascii()
    no_names = names == "none" or defined or (only is not None and within != "top" and not only.do and "identifier" not in kinds)
    comments = only is None or within == "top" or "comment" in kinds
    try:
        tree = ast.parse(source)
        starts = line_starts(source)
        words = list(leaves(source, starts, not no_names)) if not no_names or (comments and "#" in source) else []
    except (SyntaxError, ValueError, tokenize.TokenError, RecursionError):
        return []
    if kinds == NAMES_ONLY and not uses_wanted and not no_names and not SOFT_TEXT.search(source):
        return numbered([Part(a, b, 1 << 20, "identifier", None, None, None, None, word, lines) for comment, word, a, b, lines in words if not comment])
    raw = source.encode()
    place = lambda line, col: starts[line - 1] + col
    parts = []
    if kinds is None or within == "top" or "module" in kinds:
        parts.append(Part(0, len(raw), 0, "module", None, None, tree, lines=(1, max(1, len(starts) - 1))))
    uses: dict[tuple[int, int], str] = {}
    if names == "all" and not no_names:
        kinds = None  # a name may be syntax of what is right around it, so all is made
    # without names, what is not of the wanted kinds needs no more than that its parts are looked at
    lean = kinds is not None and no_names and not defined and not statements and within != "top" and {x for k in kinds for x in CLASSES.get(k, (k,))}
    todo = [(tree, 0)]
    while todo:
        parent, deep = todo.pop()
        of = SORTS[parent.__class__]
        deep += 2
        for field in of.fields if within == "all" else of.bodies:
            value = getattr(parent, field, None)
            if value is None:
                continue
            many = value.__class__ is list
            for nth, x in enumerate(value) if many else ((0, value),):
                sort = SORTS[x.__class__]
                if sort is None:
                    continue
                if within == "all":
                    if sort.fields:
                        todo.append((x, deep))
                elif within == "statements" and sort.bodies:
                    todo.append((x, deep))
                if lean and sort.name not in lean and not sort.decorated:
                    continue
                if sort.binds:
                    if not no_names:
                        bound(x, place, raw, uses)
                    elif defined and sort.decorated:
                        at = raw.find(b"class" if sort.name == "ClassDef" else b"def", starts[x.lineno - 1] + x.col_offset)
                        at = raw.find(x.name.encode(), at + (5 if sort.name == "ClassDef" else 3))
                        line = bisect_right(starts, at)
                        parts.append(Part(at, at + len(x.name), 1 << 20, "identifier", "name", None, None, "definition", x.name, (line, line)))
                kind = "string" if sort.name == "Constant" and isinstance(x.value, str) else sort.kind
                decorated = sort.decorated and x.decorator_list
                if kinds is not None and within != "top" and kind not in kinds and not (statements and sort.statement) and not (decorated and "decorated_definition" in kinds):
                    continue
                if sort.placed:
                    a, b, lines = starts[x.lineno - 1] + x.col_offset, starts[x.end_lineno - 1] + x.end_col_offset, (x.lineno, x.end_lineno)
                else:
                    span = ranged(x, place)
                    if span is None:
                        continue
                    a, b, lines = span
                at = nth if many else None
                if decorated:
                    first = x.decorator_list[0]
                    sign = raw.rfind(b"@", 0, place(first.lineno, first.col_offset))
                    parts.append(Part(sign, b, deep - 1, "decorated_definition", field, at, x, name=x.name, lines=(first.lineno, lines[1])))
                    field_, at = "definition", None
                else:
                    field_ = field
                parts.append(Part(a, b, deep, kind, field_, at, x, lines=lines))
    for comment, word, a, b, lines in words:
        if comment:
            if comments:
                parts.append(Part(a, b, 1 << 20, "comment", "comment", None, None, lines=lines))
            continue
        use = uses.get((a, b), "load")
        if use == "load" and names == "bound":
            continue
        parts.append(Part(a, b, 1 << 20, "identifier", "name" if use == "definition" else None, None, None, use, word, lines))
    return numbered(parts)


def ranged(x: ast.AST, place) -> tuple[int, int, tuple[int, int]] | None:
    """Bytes and lines of a node; of one without places of its own, those of its children."""
    last = getattr(x, "end_lineno", None)
    if last is not None:
        return place(x.lineno, x.col_offset), place(last, x.end_col_offset), (x.lineno, last)
    if isinstance(x, BARE):
        return None
    inner = [s for c in ast.iter_child_nodes(x) if (s := ranged(c, place))]
    if not inner:
        return None
    return min(s[0] for s in inner), max(s[1] for s in inner), (min(s[2][0] for s in inner), max(s[2][1] for s in inner))


def bound(x: ast.AST, place, raw: bytes, uses: dict) -> None:
    """What the names of a node do, by their bytes; a name that is only read needs no entry."""

    def put(a: int, name: str, use: str) -> None:
        uses[a, a + len(name.encode())] = use

    def find(name: str, a: int, b: int, use: str, back: bool = False) -> None:
        key = name.encode()
        at = raw.rfind(key, a, b) if back else raw.find(key, a, b)
        if at >= 0:
            put(at, name, use)

    if not hasattr(x, "end_lineno"):
        return
    a, b = place(x.lineno, x.col_offset), place(x.end_lineno, x.end_col_offset)
    if isinstance(x, ast.Name) and not isinstance(x.ctx, ast.Load):
        put(a, x.id, "store" if isinstance(x.ctx, ast.Store) else "delete")
    elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
        word = b"class" if isinstance(x, ast.ClassDef) else b"def"
        find(x.name, raw.find(word, a) + len(word), b, "definition")
    elif isinstance(x, ast.arg):
        put(a, x.arg, "parameter")
    elif isinstance(x, ast.Attribute):
        own = isinstance(x.value, ast.Name) and x.value.id in ("self", "cls")
        find(x.attr, place(x.value.end_lineno, x.value.end_col_offset), b, "own_member" if own else "member", back=True)
    elif isinstance(x, ast.keyword) and x.arg:
        put(a, x.arg, "keyword")
    elif isinstance(x, ast.alias):
        if x.asname:
            find(x.asname, a, b, "import", back=True)
            at = a
            for word in x.name.split("."):
                find(word, at, b, "imported")
                at = raw.find(word.encode(), at, b) + len(word)
        else:
            first, *rest = x.name.split(".")
            put(a, first, "import")
            at = a + len(first.encode())
            for word in rest:
                find(word, at, b, "imported")
                at = raw.find(word.encode(), at, b) + len(word)
    elif isinstance(x, ast.ImportFrom) and x.module:
        at = raw.find(b"from", a) + 4
        for word in x.module.split("."):
            find(word, at, b, "imported")
            at = raw.find(word.encode(), at, b) + len(word)
    elif isinstance(x, (ast.Global, ast.Nonlocal)):
        at = a + (6 if isinstance(x, ast.Global) else 8)
        for word in x.names:
            find(word, at, b, "global" if isinstance(x, ast.Global) else "nonlocal")
            at = raw.find(word.encode(), at, b) + len(word)
    elif isinstance(x, ast.ExceptHandler) and x.name:
        from_ = place(x.type.end_lineno, x.type.end_col_offset) if x.type else a
        find(x.name, raw.find(b"as", from_, b) + 2, b, "store")
    elif isinstance(x, (ast.MatchAs, ast.MatchStar)) and x.name:
        find(x.name, a, b, "store", back=True)
    elif isinstance(x, ast.MatchMapping) and x.rest:
        find(x.rest, a, b, "store", back=True)


def numbered(parts: list[Part]) -> list[Part]:
    """Parts in order with parents and numbers, by one sweep over where they begin."""
    parts.sort(key=lambda p: (p.start, -p.end, p.deep))
    out: list[Part] = []
    path: list[Part] = []
    post = 0

    def closed() -> None:
        nonlocal post
        p = path.pop()
        p.last, p.post = len(out) - 1, post
        post += 1

    for p in parts:
        while path and not (path[-1].start <= p.start and p.end <= path[-1].end):
            closed()
        if p.kind == "identifier" and p.use == "load" and path and path[-1].kind in SOFT:
            continue
        p.node, p.parent = len(out), path[-1].node if path else None
        path.append(p)
        out.append(p)
    while path:
        closed()
    return out


def about(p: Part, raw: bytes, place, plain: bool = False) -> str | None:
    """What a node is about: its name, the called function, the first import or target, the value of a string."""
    x = p.x
    if p.name is not None or x is None or isinstance(x, ast.Module):
        return p.name
    if hasattr(x, "name") and isinstance(x.name, str) and not isinstance(x, ast.alias):
        return x.name
    if p.kind == "string":
        return x.value[:MOST_NAME]
    part = None
    if isinstance(x, ast.Call):
        part = x.func
    elif isinstance(x, (ast.Import, ast.ImportFrom)):
        part = x.names[0]
    elif isinstance(x, ast.Assign):
        part = x.targets[0]
    elif isinstance(x, (ast.AnnAssign, ast.AugAssign, ast.NamedExpr)):
        part = x.target
    elif isinstance(x, ast.Name):
        return x.id
    if part is None:
        return None
    if plain and part.__class__ is ast.Name:
        return part.id[:MOST_NAME]
    a, b = place(part.lineno, part.col_offset), place(part.end_lineno, part.end_col_offset)
    return " ".join(raw[a:b].decode("utf-8", "replace").split())[:MOST_NAME]


def statement(p: Part) -> bool:
    return isinstance(p.x, ast.stmt) and p.kind != "decorated_definition"


def rows_of(file: str, source: str, columns: list[str] = COLUMNS, only: Callable[[Part], bool] | None = None, names: str = "all") -> list[tuple]:
    wanted = set(columns)
    parts = parsed(source, names, only if isinstance(only, Wanted) else None, bool(wanted & {"use", "field"}))
    if not parts:
        return []
    raw, starts, plain = source.encode(), line_starts(source), source.isascii()
    place = lambda line, col: starts[line - 1] + col
    flat = lambda a, b: " ".join((source[a:b] if plain else raw[a:b].decode("utf-8", "replace")).split())[:MOST_HEAD]
    heads, firsts, digests, abouts = "head" in wanted, "first_line" in wanted, "digest" in wanted, "name" in wanted
    out = []
    for p in parts if only is None else filter(only, parts):
        head = first = digest = None
        if digests:
            digest = hashlib.md5(raw[p.start : p.end]).hexdigest()
        if heads or firsts:
            end = p.start + 16 * MOST_HEAD
            if p.kind in ("function_definition", "class_definition"):
                body = p.x.body[0]
                end = place(body.lineno, body.col_offset)
                if firsts:
                    line = raw.find(b"\n", p.start, p.end)
                    first = flat(p.start, line if line >= 0 else p.end)
                head = flat(p.start, end)
            else:
                head = flat(p.start, min(end, p.end))
        out.append((
            file, p.node, p.parent, p.last, p.post, p.kind, p.field, p.nth, statement(p), about(p, raw, place, plain) if abouts else None, p.use, head, first, digest, p.start, p.end, *p.lines,
        ))
    return out


def node_table(files: DataFrame, columns: list[str] = COLUMNS, only: Callable[[Part], bool] | None = None, names: str = "all", among: str | None = None) -> DataFrame:
    """(file, source) -> rows of NODE; of these the ``columns``, and the parts that ``only`` accepts; ``names``: see parsed().

    ``among``: a column with a list of names; of the leaves with a name, those of the list are told.

    Spark can't tell the size of what Python makes and takes it for that of the
    files' table, so the rows are never sent to all tasks in a join.
    """
    at, types = _types(columns)

    def batch(files: list[list[tuple]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(_arrays(files, at, types), names=columns)

    return _made(files, columns, only, names, batch, ", ".join(f"{c} {KIND_OF[c]}" for c in columns), among)


def node_lists(files: DataFrame, columns: list[str], only: Callable[[Part], bool] | None = None, names: str = "all") -> DataFrame:
    """(file, source) -> (file, nodes): the rows of node_table(), those of a file in one list in their order.

    What is asked of one file's nodes needs no shuffle, as they stay together.
    """
    inner = [c for c in columns if c != "file"]
    at, types = _types(inner)

    def batch(files: list[list[tuple]]) -> pa.RecordBatch:
        ends = list(accumulate(map(len, files), initial=0))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(_arrays(files, at, types), names=inner))
        return pa.RecordBatch.from_arrays([pa.array([rows[0][0] for rows in files], pa.string()), lists], names=["file", "nodes"])

    return _made(files, columns, only, names, batch, f"file string, nodes array<struct<{', '.join(f'{c}: {KIND_OF[c]}' for c in inner)}>>")


KIND_OF = dict(x.split() for x in NODE.split(", "))


def _types(columns: list[str]) -> tuple[list[int], list[pa.DataType]]:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
    return [COLUMNS.index(c) for c in columns], [kinds[KIND_OF[c]] for c in columns]


def _arrays(files: list[list[tuple]], at: list[int], types: list[pa.DataType]) -> list[pa.Array]:
    rows = [row for part in files for row in part]
    return [pa.array([row[i] for row in rows], t) for i, t in zip(at, types)]


def _made(files: DataFrame, columns: list[str], only, names: str, batch: Callable[[list[list[tuple]]], pa.RecordBatch], schema: str, among: str | None = None) -> DataFrame:
    """Batches of the rows of files that have some, in the given form."""
    ship(files.sparkSession)

    def run(batches):
        some: list[list[tuple]] = []
        n = 0
        for part in batches:
            for file, source, *told in zip(*(c.to_pylist() for c in part.columns)):
                rows = rows_of(file, source, columns, _among(only, set(told[0] or ())) if told else only, names)
                if rows:
                    some.append(rows)
                    n += len(rows)
                if n >= ROWS:
                    yield batch(some)
                    some, n = [], 0
        if some:
            yield batch(some)

    return large(files.where("source is not null").select("file", "source", *[among] * (among is not None)).mapInArrow(run, schema))


def _among(only: Callable[[Part], bool] | None, told: set[str]) -> Callable[[Part], bool]:
    return lambda p: (p.kind != "identifier" or p.name in told) and (only is None or only(p))
