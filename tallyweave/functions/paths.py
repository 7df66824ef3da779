"""Paths, names and extensions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the category labels are, and the extensions that a label is known for.
CATEGORIES = {
    "Code": ["rs", "py", "go", "java", "js", "ts", "c", "h", "cpp", "rb", "kt", "swift", "sh", "lua"],
    "Data": ["csv", "tsv", "parquet", "sql", "xml", "json"],
    "Configuration": ["yml", "yaml", "toml", "ini", "cfg", "conf", "lock"],
    "Documentation": ["md", "rst", "txt", "adoc", "tex"],
}
# Fragments of paths that corpus scans skip.
ANOMALOUS = [
    "/.gitignore",
    "/.gitkeep",
    "/.git/",
    "/.github/",
    "third_party",
    "3rdparty",
    "security/nss/gtests/freebl_gtest/kat",
    "blob/4.x/3rdparty/openexr/Half/toFloat.h",
    "libavcodec/metasound_data.h",
    "libavcodec/on2avcdata.c",
    "libavcodec/dcadata.c",
    "libavcodec/hq_hqadata.h",
    "libavcodec/ralfdata.h",
    "libavcodec/twinvq_data.h",
    "swiftlang-swift.git/test",
]


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension_key(path: Column) -> Column:
    """The last extension of the lower-case base name, `min.js` as one, the whole name where there is none."""
    name = F.lower(basename(path))
    bare = F.trim(name, F.lit("."))
    return F.when(name.endswith(".min.js"), F.lit("min.js")).when(F.instr(bare, ".") > 0, F.element_at(F.split(bare, "[.]"), -1)).otherwise(bare)


def last_extension(path: Column) -> Column:
    """What follows the last dot of the path; the whole path if there is none."""
    return F.element_at(F.split(path, "[.]"), -1)


def top_folder(path: Column) -> Column:
    """The first part of a path, after `//` and `/./` are folded."""
    return F.element_at(F.split(F.regexp_replace(F.regexp_replace(path, "/+", "/"), r"/(?:\./)+", "/"), "/"), 1)


def renamed_from(path: Column) -> Column:
    """The old path of `dir/{a => b}/f` or `a => b`; the path itself if it names no rename."""
    return _renamed(path, 1)


def renamed_to(path: Column) -> Column:
    return _renamed(path, 2)


def _renamed(path: Column, side: int) -> Column:
    braced = F.regexp_replace(path, r"\{([^{}]*?) => ([^{}]*?)\}", f"${side}")
    plain = F.regexp_replace(path, r"^(.*) => (.*)$", f"${side}")
    chosen = F.when(path.contains("{"), braced).otherwise(plain)
    return F.array_join(F.filter(F.split(chosen, "/"), lambda x: x != ""), "/")


def category(path: Column) -> Column:
    """Code, Data, Configuration, Documentation or Unknown, by the extension."""
    key = extension_key(path)
    out = F.lit("Unknown")
    for name, extensions in reversed(CATEGORIES.items()):
        out = F.when(key.isin(extensions), name).otherwise(out)
    return F.when(path.isNull(), "Unknown").otherwise(out)


def label_of_tip(tip: Column) -> Column:
    """The label before the bracket of a tip; Unknown for null and empty ones."""
    label = F.trim(F.element_at(F.split(F.coalesce(tip, F.lit("")), "[(]"), 1))
    return F.when(label == "", "Unknown").otherwise(label)


def is_anomalous(path: Column) -> Column:
    """Whether the path holds one of the fragments anywhere."""
    return F.exists(F.array(*map(F.lit, ANOMALOUS)), lambda x: F.contains(path, x))
