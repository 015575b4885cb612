"""Scalar text functions: tokens, clips, identifiers, hints. All are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDY = r"\p{IsAlphabetic}\p{N}"

# Words that never name anything worth searching for, mostly keywords.
STOP_WORDS = [
    "and", "as", "async", "await", "break", "case", "catch", "class", "const", "continue",
    "def", "default", "do", "else", "except", "export", "extends", "false", "finally", "for",
    "from", "function", "if", "import", "in", "interface", "let", "new", "none", "null", "of",
    "pass", "return", "static", "super", "switch", "this", "throw", "true", "try", "type", "var",
    "while", "with", "yield",
]


def code_tokens(text: Column) -> Column:
    """Lower-cased identifiers, paths and their parts; repeats stay, for term counts.

    A token is a run of letters, digits and ``_ $ - . / :`` without other
    characters at its ends, of two characters or more. Parts split at the
    separators and where an upper-case letter follows a lower-case one; a token
    with several parts also gives its parts of two characters or more.
    """
    # ends in a letter, digit or $ on both sides, so nothing is left to trim
    token = rf"([{WORDY}$](?:[{WORDY}_$\-./:]*[{WORDY}$])+)"
    raw = F.regexp_extract_all(text, F.lit(token), F.lit(1))

    def with_parts(x: Column) -> Column:
        apart = F.regexp_replace(x, r"(\p{Ll})(?=\p{Lu})", "$1 ")
        parts = F.filter(F.split(F.lower(apart), r"[ _\-./:]+"), lambda p: p != "")
        more = F.filter(parts, lambda p: (F.length(p) >= 2) & (p != F.lower(x)))
        whole = F.array(F.lower(x))
        # most words have one part
        return F.when(x.rlike(r"[_\-./:]|\p{Ll}\p{Lu}"), F.concat(whole, F.when(F.size(parts) > 1, more).otherwise(F.array().cast("array<string>")))).otherwise(whole)

    return F.flatten(F.transform(raw, with_parts))


def query_terms(text: Column) -> Column:
    """Sorted distinct tokens of a query."""
    return F.array_sort(F.array_distinct(code_tokens(text)))


def path_tokens(text: Column, least: int = 3, most: int = 8) -> Column:
    """First-seen distinct lower-cased words and their parts, at most ``most`` of them.

    A word begins with a letter or underscore and goes on with letters, digits,
    ``_`` and ``-``; it comes first, then its parts between these two and at
    upper-case letters, those of at least ``least`` characters.
    """
    words = F.filter(F.regexp_extract_all(text, F.lit("([A-Za-z_][A-Za-z0-9_-]*)"), F.lit(1)), lambda w: F.length(w) >= least)
    parts = lambda w: F.split(F.lower(F.regexp_replace(w, "(?<=[a-z0-9])(?=[A-Z])", "-")), "[_-]+")
    each = F.transform(words, lambda w: F.concat(F.array(F.lower(w)), F.filter(parts(w), lambda p: F.length(p) >= least)))
    return F.slice(F.array_distinct(F.flatten(each)), 1, most)


def anchor(tokens: Column) -> Column:
    """The longest token, then the first in order."""
    rows = F.transform(tokens, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))
    return F.array_min(rows)["t"]


def identifiers(text: Column, most: int = 160, stop_words: list[str] = STOP_WORDS) -> Column:
    """First-seen distinct identifiers without stop words."""
    raw = F.regexp_extract_all(text, F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*)"), F.lit(1))
    stop = F.array(*map(F.lit, stop_words))
    return F.slice(F.array_distinct(F.filter(raw, lambda x: ~F.array_contains(stop, F.lower(x)))), 1, most)


def compact(text: Column, most: int, mark: bool = False) -> Column:
    """White space runs become one space; clipped to ``most`` characters, with an ellipsis if ``mark``."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    if not mark:
        return F.left(flat, F.lit(most))
    return F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most)), F.lit("…"))).otherwise(flat)


def indent_width(line: Column) -> Column:
    """Width of the leading blanks; a tab counts as four."""
    return F.length(F.replace(F.regexp_extract(line, r"^([ \t]*)", 1), F.lit("\t"), F.lit("    ")))


# Words that begin a declaration, those that may stand before them, and names that are no declaration.
DECLARING = ["def", "class", "function", "interface", "type", "enum", "struct", "trait", "fn"]
MODIFIERS = ["public", "private", "protected", "static", "readonly", "async", "abstract", "override", "get", "set"]
NO_SYMBOLS = ["if", "for", "while", "switch", "catch", "function", "constructor"]
#: which words may stand before which declaring words
EXPORTED, CONSTANTS, RUST = (["export", "default", "async"], DECLARING[:6]), (["export"], ["const", "let", "var"]), (["pub", "async"], ["fn", "struct", "enum", "trait", "type", "const", "static"])


def line_tokens(line: Column) -> Column:
    """The names of a line and, one by one, its other characters; ``pub(crate)`` is ``pub``."""
    return F.regexp_extract_all(F.regexp_replace(F.trim(line), r"^pub\s*\([^)]*\)", "pub"), F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*|\S)"), F.lit(1))


def after_leading(tokens: Column, words: list[str]) -> Column:
    """The tokens without those of ``words`` that they begin with."""
    kinds = F.transform(tokens, lambda t: t.isin(*words))
    first = F.array_position(kinds, F.lit(False))
    return F.when(first > 0, F.slice(tokens, first.cast("int"), F.size(tokens))).otherwise(F.slice(tokens, 1, 0))


def _declared(tokens: Column, before: list[str], words: list[str]) -> Column:
    """The name after a declaring word, with nothing but ``before`` in front; null if there is none."""
    rest = after_leading(tokens, before)
    name = F.get(rest, F.lit(1))
    return F.when(F.get(rest, F.lit(0)).isin(*words) & name.rlike("^[A-Za-z_$]"), name)


def declaration_hint(line: Column) -> Column:
    return F.coalesce(F.get(after_leading(line_tokens(line), ["export", "async"]), F.lit(0)).isin(*DECLARING), F.lit(False)).cast("int")


def declares(line: Column, symbol: Column) -> Column:
    """Whether a line of any language defines the name."""
    # the tokens of a line are made once for all forms
    names = lambda tokens: F.array_compact(F.array(*(_declared(tokens, *form) for form in (EXPORTED, CONSTANTS, RUST))))
    return F.coalesce(F.exists(F.array(line_tokens(line)), lambda tokens: F.array_contains(names(tokens), symbol)), F.lit(False))


def python_definition(line: Column) -> Column:
    """The name that a line of Python defines as a function or class; null if none."""
    return _declared(line_tokens(line), ["async"], ["def", "class"])


def declared_symbols(line: Column, language: str) -> Column:
    """Distinct names a line declares, by its form: Python, or a language with braces."""
    tokens = line_tokens(line)
    if language == "python":
        second = F.get(tokens, F.lit(1))
        later = F.array_contains(F.slice(tokens, 4, F.greatest(F.size(tokens), F.lit(1))), "=")
        assigned = F.when(F.get(tokens, F.lit(0)).rlike("^[A-Za-z_$]") & ((second == "=") | ((second == ":") & later)), F.get(tokens, F.lit(0)))
        names = [python_definition(line), assigned]
    else:
        own = after_leading(tokens, MODIFIERS)
        # a modifier right before a bracket is a name itself
        led = F.size(tokens) - F.size(own)
        own = F.when((F.get(own, F.lit(0)) == "(") & (led > 0), F.slice(tokens, led, F.size(tokens))).otherwise(own)
        inside = F.slice(own, 3, F.greatest(F.size(own), F.lit(1)))
        shut, cut = F.array_position(inside, ")"), F.array_position(inside, ";")
        method = F.when(F.get(own, F.lit(0)).rlike("^[A-Za-z_$]") & (F.get(own, F.lit(1)) == "(") & (shut > 0) & ((cut == 0) | (shut < cut)), F.get(own, F.lit(0)))
        names = [_declared(tokens, EXPORTED[0], ["function"]), _declared(tokens, ["export", "default"], ["class", "interface", "type", "enum"]), _declared(tokens, *CONSTANTS), method]
    return F.array_distinct(F.filter(F.array_compact(F.array(*names)), lambda x: ~x.isin(*NO_SYMBOLS)))


def atom_in_line(line: Column, atom: Column) -> Column:
    """A word is looked for anywhere; a number only where no digit touches it."""
    number = F.concat(F.lit(r"(?<![0-9])"), atom, F.lit(r"(?![0-9])"))
    return F.when(atom.rlike("^[0-9]+$"), F.regexp_like(line, number)).otherwise(F.contains(F.lower(line), F.lower(atom)))


def quoted(literal: Column) -> Column:
    r"""A regular expression that matches the literal text."""
    return F.concat(F.lit(r"\Q"), F.replace(literal, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def whole_word(text: Column, symbol: Column) -> Column:
    return F.regexp_like(text, F.concat(F.lit(r"\b"), quoted(symbol), F.lit(r"\b")))


def member_symbols(line: Column, binding: str) -> Column:
    """Names used as ``binding.name`` or ``binding?.name``."""
    return F.array_distinct(F.regexp_extract_all(line, F.lit(rf"\b\Q{binding}\E\s*\??\.\s*([A-Za-z_$][A-Za-z0-9_$]*)"), F.lit(1)))


def search_signature(queries: Column, path: Column, glob: Column) -> Column:
    """The same for the same set of queries in the same place."""
    key = F.to_json(F.struct(F.array_sort(queries).alias("queries"), path.alias("path"), glob.alias("glob")), {"ignoreNullFields": "false"})
    return F.sha2(key, 256)


def eol_kind(text: Column) -> Column:
    """none, lf, crlf, mixed or bare_cr."""
    crlf = F.regexp_count(text, F.lit("\r\n"))
    lf = F.regexp_count(text, F.lit("\n")) - crlf
    cr = F.regexp_count(text, F.lit("\r")) - crlf
    return F.when(cr > 0, "bare_cr").when((crlf > 0) & (lf > 0), "mixed").when(crlf > 0, "crlf").when(lf > 0, "lf").otherwise("none")


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("long")


def byte_offset(source: Column, line: Column, column: Column) -> Column:
    """Line and character column, both from 1 -> byte offset from 0; null outside the line."""
    rows = F.split(source, "\n")
    row = F.get(rows, line - 1)
    before = F.aggregate(F.slice(rows, F.lit(1), F.greatest(line - 1, F.lit(0))), F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x) + 1)
    return F.when((line >= 1) & (column >= 1) & (column <= F.length(row) + 1), before + F.octet_length(F.left(row, column - 1)))
