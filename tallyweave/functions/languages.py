"""The language of a file by its path, and by its content where the path isn't enough."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by the extensions of their files, and by whole names of files.
EXTENSIONS = {
    "Rust": "rs", "Python": "py pyi", "Go": "go", "Java": "java", "JavaScript": "js mjs cjs jsx", "TypeScript": "ts mts cts tsx", "C": "c h", "Cpp": "cc cpp cxx hpp hh hxx", "CSharp": "cs", "Ruby": "rb",
    "Php": "php", "Kotlin": "kt kts", "Swift": "swift", "Scala": "scala", "Lua": "lua", "Bash": "sh bash", "Html": "html htm", "Css": "css", "Json": "json", "Yaml": "yaml yml", "Toml": "toml", "Xml": "xml",
    "Markdown": "md markdown", "Sql": "sql", "Haskell": "hs", "Elixir": "ex exs", "Zig": "zig", "Dart": "dart", "R": "r", "Nix": "nix", "Vim": "vim",
}
NAMES = {"Make": "makefile gnumakefile", "Docker": "dockerfile containerfile", "CMake": "cmakelists.txt", "Bazel": "build build.bazel workspace"}


def language_of(path: Column, content: Column | None = None) -> Column:
    """The language of a path, null if none is known. Only `.ts` asks the content: markup in it is a translation table, no TypeScript."""
    base = F.lower(F.regexp_extract(path, r"([^/\\]+)$", 1))
    table = F.create_map(*(F.lit(x) for name, ends in EXTENSIONS.items() for e in ends.split() for x in (e, name)))
    names = F.create_map(*(F.lit(x) for name, files in NAMES.items() for f in files.split() for x in (f, name)))
    found = F.coalesce(F.element_at(names, base), F.element_at(table, F.regexp_extract(base, r"\.([^.]+)$", 1)))
    if content is None:
        return found
    return F.when(base.endswith(".ts") & F.startswith(F.ltrim(F.coalesce(content, F.lit(""))), F.lit("<")), None).otherwise(found)
