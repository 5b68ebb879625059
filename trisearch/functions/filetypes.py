"""File types by name, and languages by extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The extensions of each file type.
TYPES = {
    "c": ["c", "h"],
    "cpp": ["cpp", "cc", "cxx", "hpp", "hxx", "h"],
    "css": ["css"],
    "dart": ["dart"],
    "elixir": ["ex", "exs"],
    "go": ["go"],
    "gradle": ["gradle"],
    "haskell": ["hs"],
    "html": ["html", "htm"],
    "java": ["java"],
    "javascript": ["js", "mjs", "cjs"],
    "json": ["json"],
    "jsx": ["jsx"],
    "kotlin": ["kt", "kts"],
    "lua": ["lua"],
    "markdown": ["md", "markdown"],
    "php": ["php"],
    "proto": ["proto"],
    "python": ["py", "pyi"],
    "r": ["r", "R"],
    "ruby": ["rb"],
    "rust": ["rs"],
    "scala": ["scala", "sc"],
    "shell": ["sh", "bash", "zsh"],
    "sql": ["sql"],
    "svelte": ["svelte"],
    "swift": ["swift"],
    "terraform": ["tf", "tfvars"],
    "toml": ["toml"],
    "typescript": ["ts", "tsx", "mts"],
    "vue": ["vue"],
    "xml": ["xml"],
    "yaml": ["yaml", "yml"],
    "zig": ["zig"],
}

#: Other names of types.
ALIASES = {
    "rs": "rust",
    "py": "python",
    "js": "javascript",
    "ts": "typescript",
    "rb": "ruby",
    "cc": "cpp",
    "sh": "shell",
    "yml": "yaml",
    "md": "markdown",
    "kt": "kotlin",
    "protobuf": "proto",
    "ex": "elixir",
    "hs": "haskell",
    "tf": "terraform",
}

#: The language that a fenced block of an extension is marked with.
LANGUAGES = {
    "rs": "rust",
    "py": "python",
    "js": "javascript",
    "ts": "typescript",
    "go": "go",
    "rb": "ruby",
    "java": "java",
    "c": "c",
    "h": "c",
    "cpp": "cpp",
    "cc": "cpp",
    "hpp": "cpp",
    "sh": "bash",
    "bash": "bash",
    "json": "json",
    "yaml": "yaml",
    "yml": "yaml",
    "md": "markdown",
    "html": "html",
    "css": "css",
    "sql": "sql",
}


def extensions_for_type(name: str) -> list[str] | None:
    """The extensions of a type, whose name may be in any case; None for an unknown one."""
    name = name.lower()
    return TYPES.get(ALIASES.get(name, name))


def list_all_types() -> list[tuple[str, list[str]]]:
    return sorted(TYPES.items())


def type_catalog(spark: SparkSession) -> DataFrame:
    """(name, extensions, listing); listing is the line that --list-types shows."""
    rows = spark.createDataFrame(list_all_types(), "name string, extensions array<string>")
    globs = F.array_join(F.transform("extensions", lambda e: F.concat(F.lit("*."), e)), ", ")
    return rows.select("name", F.array_join("extensions", ",").alias("extensions"), F.concat(F.rpad("name", 14, " "), globs).alias("listing"))


def extension(path: Column) -> Column:
    """What follows the last dot of the file name, empty without one or if the name only begins with it."""
    return F.regexp_extract(path, r"[^/]\.([^./]*)\z", 1)


def language(path: Column) -> Column:
    """The language of a path's extension, empty if unknown. The extension of a name that ends in a dot is empty."""
    found = F.lit("")
    ext = extension(path)
    by_language: dict[str, list[str]] = {}
    for e, lang in LANGUAGES.items():
        by_language.setdefault(lang, []).append(e)
    for lang, exts in by_language.items():
        found = F.when(ext.isin(exts), F.lit(lang)).otherwise(found)
    return found
