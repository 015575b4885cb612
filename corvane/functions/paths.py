"""Paths: sanitising, normalising, languages, test files, candidate targets. Native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders that are never part of a source inventory.
SKIPPED = [".git", ".hg", ".svn", ".venv", "__pycache__", "build", "coverage", "dist", "node_modules", "target", "vendor", "venv"]

# File extension to language.
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "html": "html", "htm": "html",
    "css": "css", "xml": "xml", "sql": "sql", "rs": "rust", "c": "c_cpp", "h": "c_cpp", "cc": "c_cpp", "cpp": "c_cpp", "hpp": "c_cpp",
}

# Which source extensions a relative import of a script extension may mean, and those tried without one.
SCRIPT_FORMS = {
    "js": ["ts", "tsx", "d.ts", "js", "jsx"],
    "jsx": ["tsx", "d.ts", "jsx"],
    "mjs": ["mts", "d.mts", "mjs"],
    "cjs": ["cts", "d.cts", "cjs"],
}
BARE_FORMS = ["ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs", "d.ts"]


def safe_relative(path: Column) -> Column:
    """The path without empty and ``.`` segments; null if absolute, climbing or empty."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    bad = F.startswith(path, F.lit("/")) | F.contains(path, F.lit("\\")) | F.array_contains(F.split(path, "/"), "..")
    return F.when(~bad & (F.size(parts) > 0), F.array_join(parts, "/"))


def normalize(path: Column) -> Column:
    """``..`` removes the segment before it; null if there is none."""

    def step(stack: Column, x: Column) -> Column:
        up = F.when(F.size(stack) > 0, F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))))
        return F.when(x.isin("", "."), stack).when(x == "..", up).otherwise(F.concat(stack, F.array(x)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]+$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]+)$", 1))


def language(path: Column) -> Column:
    name = F.lower(base_name(path))
    out = F.when(name.rlike(r"^(?:dockerfile|containerfile)(?:\..*)?$") | name.endswith(".dockerfile"), "docker")
    for lang in dict.fromkeys(LANGUAGES.values()):
        out = out.when(extension(path).isin([e for e, x in LANGUAGES.items() if x == lang]), lang)
    return out.otherwise("other")


def likely_test(path: Column) -> Column:
    p = F.lower(path)
    return p.rlike(r"(?:^|/)(?:test|tests|__tests__|spec|specs)/") | F.regexp_like(p, F.lit(r"(?:^|/)(?:test_[^/]*\.py|[^/]*_test\.py|[^/]*\.test\.[cm]?[jt]sx?)$"))


def in_vendor_folder(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIPPED)))


def reserved(path: Column, top: str = ".corvane") -> Column:
    return (path == top) | F.startswith(path, F.lit(top + "/"))


def scope_of(path: Column, scope: Column) -> Column:
    """Whether a path lies in the directory ``scope``; the empty scope is everything."""
    return (scope == "") | F.startswith(path, F.concat(scope, F.lit("/")))


def _join(a: Column, b: Column) -> Column:
    return F.when(a == "", b).otherwise(F.concat(a, F.lit("/"), b))


def _ends(base: Column, ends: list[str]) -> Column:
    return F.when(base.isNotNull() & (base != ""), F.array(*(F.concat(base, F.lit(e)) for e in ends))).otherwise(F.array().cast("array<string>"))


def python_targets(importer: Column, spec: Column) -> Column:
    """A module is a file or a package; leading dots start at the importer's folder."""
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    module = F.replace(F.regexp_replace(spec, r"^\.+", ""), F.lit("."), F.lit("/"))
    up = F.concat(parent(importer), F.repeat(F.lit("/.."), F.greatest(dots - 1, F.lit(0))))
    base = normalize(F.when(dots == 0, module).otherwise(F.concat(up, F.lit("/"), module)))
    return _ends(base, [".py", "/__init__.py"])


def module_targets(importer: Column, spec: Column) -> Column:
    base = normalize(_join(parent(importer), spec))
    ext = extension(base)
    bare = F.regexp_replace(base, r"\.[^./]+$", "")
    out = F.when(ext == "", _ends(base, [e for x in BARE_FORMS for e in (f".{x}", f"/index.{x}")]))
    for e, forms in SCRIPT_FORMS.items():
        out = out.when(ext == e, F.array_distinct(F.concat(F.array(base), _ends(bare, [f".{x}" for x in forms]))))
    return out.otherwise(_ends(base, [""]))


def rust_mod_targets(importer: Column, spec: Column) -> Column:
    root = base_name(importer).isin("lib.rs", "main.rs", "mod.rs")
    folder = F.when(root, parent(importer)).otherwise(F.regexp_replace(importer, r"\.[^./]+$", ""))
    return _ends(normalize(_join(folder, spec)), [".rs", "/mod.rs"])


def rust_crate_targets(spec: Column) -> Column:
    parts = F.filter(F.split(F.regexp_replace(F.trim(spec), ";+$", ""), "::"), lambda x: x != "")
    whole, module = F.array_join(parts, "/"), F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/")

    def ends(x: Column) -> Column:
        return F.array(F.concat(F.lit("src/"), x, F.lit(".rs")), F.concat(F.lit("src/"), x, F.lit("/mod.rs")))

    none = F.array().cast("array<string>")
    return F.concat(F.when(F.size(parts) > 0, ends(whole)).otherwise(none), F.when(F.size(parts) > 1, ends(module)).otherwise(none))


def local_targets(importer: Column, spec: Column) -> Column:
    bare = F.regexp_replace(spec, "^/+", "")
    both = F.array(normalize(_join(parent(importer), bare)), normalize(bare))
    return F.array_distinct(F.array_compact(both))


def targets(kind: Column, importer: Column, spec: Column) -> Column:
    """Files an import may mean, by its kind."""
    return (
        F.when(kind.isin("python_from", "python_import"), python_targets(importer, spec))
        .when(kind.isin("js_relative_import", "js_require"), module_targets(importer, spec))
        .when(kind == "rust_mod", rust_mod_targets(importer, spec))
        .when(kind == "rust_crate_use", rust_crate_targets(spec))
        .when(kind.isin("c_quote_include", "html_script", "html_link", "css_import", "xml_include", "docker_copy", "sql_include"), local_targets(importer, spec))
        .otherwise(F.array().cast("array<string>"))
    )
