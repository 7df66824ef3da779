"""Source files that nobody of the repository wrote by hand: generated, minified, copied, or data.

Character n-gram models of identifiers are trained per language over all files. Mangled names have
a high cross-entropy under them, names filled into a template leave few line shapes, and names that
another project declares in the same order are a foreign style: the file is a copy of that project.
Two passes over the files and one aggregation over short hashes of names; no text is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ..session import BROADCAST_ROWS, cut_lineage, spread
from .syntax import EXTENSIONS, known_language

#: What a language that isn't one of the bundled ones is called.
OTHER = "other"
#: Order of the identifier models, and the number of symbols: letters, digits, `_`, other, end.
ORDER = 3
SYMBOLS = 39
#: A template: so few line shapes (as perplexity), each for so many lines on average, one of them filled in so often.
SHAPES, LINES_PER_SHAPE, REPEATS = 5.2, 2.8, 6
#: Data: so many characters of literals, and their share of the code.
DATA_CHARS, DATA_SHARE = 450, 0.6
#: Mangled: bits per character above those of the language's files, fewer in a file that is packed and of one-letter names, and distinct names that it takes to tell.
MANGLED_BITS, PACKED_BITS, LEAST_NAMES = 2.0, 1.0, 20
#: Packed: so few blanks among the characters, and this share of one-letter names. Models aren't trained on files with so few blanks.
BLANKS, SHORT_SHARE = 0.13, 0.4
#: What a task remembers of names and lines, in entries; beyond that it starts anew.
MOST_KNOWN = 200_000
#: Files that share a triple up to which they meet in one task.
HOT_FILES = 100_000
#: A copy: the share of name triples that another project is the home of, and the least number of triples.
FOREIGN_SHARE, LEAST_TRIPLES = 0.5, 3

_NAME = re.compile(r"[^\W\d]\w*")
_COMMENT = re.compile(r"/\*.*?\*/|\"\"\".*?\"\"\"|'''.*?'''", re.S)
_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|`[^`]*`')
_NUMBER = re.compile(r"(?<![\w.])[-+]?(?:0[xX][0-9a-fA-F]+|[0-9]+(?:\.[0-9]+)?)[uUlL]*(?![\w.])")
_BLOB = re.compile(r"(?:data:[\w/+.-]+;base64,)?[A-Za-z0-9+/=_\\-]{32,}\Z")
_TABLE_ROW = re.compile(r"[\s\d\-+.,xXa-fA-F()\[\]{};uUlL]*\Z")

# What generators write at the head of a file, in several languages, and what takes it back.
_GENERATED = re.compile(
    r"@generated|<auto-generated|auto(?:matically)?[- ]?generated|code generated by|generated (?:file|by|from|code)|machine[- ](?:written|generated)|autogenerated"
    r"|(?:produced|created|written|emitted) by \w[\w.-]*(?: v?[\d.]+)?[ ;,](?:.*\b(?:edit|build|lost|overwritten)\b)|manual (?:edits|changes) (?:are|will be) lost|changes will be (?:lost|overwritten)"
    r"|automatisch (?:erzeugt|generiert)|nicht von hand|(?:produit|généré|créé) (?:automatiquement )?par .*(?:modifier|éditer)|généré automatiquement|generado (?:automáticamente|por)|no (?:editar|modificar)|generato automaticamente|автоматически"
    r"|do not (?:edit|modify)(?: (?:this file|by hand|manually))?[.!]?\s*(?:\*/|-->)?\s*$|\A\W*line \d+ \"[^\"\n]+\.(?:y|l|yy|ll|rl|re)\"",
    re.I | re.M,
)
_TAKEN_BACK = re.compile(r"\bnot generated\b|\bunlike\b|written by hand|hand-?written|in this file instead|\bno longer generated|von hand geschrieben|edit freely", re.I)
# Folders that hold other projects, if a package has its own folder in them.
_VENDOR = re.compile(r"(?:^|/)(?:vendor|vendored|_vendor|third[_-]?party|3rdparty|node_modules|bower_components|Pods|site-packages|external|extern|deps|contrib|subprojects)/(?P<package>[^/]+)/(?:.*/)?(?P<file>[^/]+)$")
_LOCKFILE = re.compile(r"(?:^|/)(?:package-lock|npm-shrinkwrap|composer\.lock|[\w.-]*[.-]lock)(?:\.json)?$", re.I)
_HASHED = re.compile(r"\"(?:integrity|shasum|checksum|sha(?:1|256|512)|resolved|content-hash)\"\s*:", re.I)
_PROJECT = re.compile(
    r"this file is part of (?P<a>[\w.-]+)|(?:copyright|\(c\)|©)\s*(?:\(c\)\s*)?(?:[\d,\s–-]+\s+)?(?:the\s+)?(?P<b>[\w.-]+)\s+(?:authors|contributors|team|project|developers)"
    r"|stay with the (?P<c>[\w.-]+) (?:team|authors|project)|SPDX-FileCopyrightText:\s*(?:[\d,\s–-]+\s+)?(?P<d>[\w.-]+)(?:\s+(?:project|authors|contributors|team))?"
    r"|^\W*(?P<e>[A-Za-z][\w.-]*?)(?:\.\w+)?\s+v?\d+\.\d+(?:\.\d+)*\b|^\W*(?P<f>[A-Za-z][\w.-]*):\s.*\(version \d[\d.]*\)",
    re.I | re.M,
)


#: Symbols of bytes: letters of either case, digits, `_`, and one for all others; 0 is the beginning and end of a name.
_SYMBOL = bytes(0 if o == 0 else o - 96 if 97 <= o <= 122 else o - 64 if 65 <= o <= 90 else 27 + o - 48 if 48 <= o <= 57 else 37 if o == 95 else 38 for o in range(256))


def codes(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all names, one after the other, each as one number, and how many every name has."""
    sizes = np.fromiter(map(len, names), np.int64, len(names)) + 1
    line = np.frombuffer("".join([f"\0\0{x}\0" for x in names]).encode("latin-1", "replace").translate(_SYMBOL), np.uint8).astype(np.int32)
    grams = (line[:-2] * SYMBOLS + line[1:-1]) * SYMBOLS + line[2:]
    ends = np.cumsum(sizes + 2)[:-1]
    inside = np.ones(len(grams), bool)
    inside[ends - 1] = inside[ends - 2] = False  # from one name into the next
    return grams[inside], sizes


def head_of(text: str) -> str:
    """The leading comments of a file, all of them."""
    out = []
    inside = ""
    for line in text.splitlines():
        bare = line.strip()
        if inside:
            out.append(bare)
            if inside in bare:
                inside = ""
        elif bare.startswith("/*"):
            out.append(bare)
            inside = "" if "*/" in bare else "*/"
        elif bare.startswith(('"""', "'''")):
            out.append(bare)
            inside = "" if bare.count(bare[:3]) > 1 else bare[:3]
        elif bare.startswith(("//", "#", "--", "<!--", ";;")) and not bare.startswith(("#include", "#define", "#[", "#!", "#if", "#pragma")):
            out.append(bare)
        elif bare and not bare.startswith(("#!", "<?", "'use strict'", '"use strict"')):
            break
    return "\n".join(out)


def named_projects(head: str) -> list[str]:
    """The projects that the leading comments name, in lower-case letters and digits."""
    found = [g.lower() for m in _PROJECT.finditer(head) for g in m.groups() if g]
    return [re.sub(r"[^a-z0-9]", "", x) for x in found if x.lower() not in ("the", "this", "version", "v", "release", "licence", "license", "python", "apache", "mit", "bsd", "gpl", "mpl", "isc", "zlib", "copyright", "spdx", "todo", "note", "since", "requires", "step", "section", "chapter", "part")]


def names_other_project(head: str, repository: str | None) -> bool:
    """Whether the leading comments say that the file belongs to a project that isn't this repository."""
    own = re.sub(r"[^a-z0-9]", "", (repository or "").lower())
    found = named_projects(head)
    return any(x and x not in own for x in found) and not any(x and x in own for x in found)


def vendored_package(path: str) -> tuple[str, bool] | None:
    """The package whose folder the file is in, and whether that is surely another project's."""
    vendor = _VENDOR.search(path)
    if not vendor:
        return None
    package = re.sub(r"(?:-src|[-@]v?\d[\d.]*)$", "", vendor["package"]).lower()
    stem = vendor["file"].rsplit(".", 1)[0].lower()
    strict = not re.search(r"(?:^|/)(?:external|extern|deps|contrib)/", path) or stem in (package, "index", "main", "lib", "mod", "__init__") or package != vendor["package"].lower()
    return package, strict


def origins(text: str, path: str) -> list[str]:
    """The projects that a copied file comes from, by its head and folder, in lower-case letters and digits."""
    vendor = vendored_package(path)
    package = [re.sub(r"[^a-z0-9]", "", vendor[0])] if vendor and vendor[1] else []
    return sorted({x for x in named_projects(head_of(text)) + package if x})


_DIGITS = re.compile(r"\d+")
_DIGIT = re.compile(r"\d")
_HUMP = re.compile(r"[a-z][A-Z]")
_LETTER = re.compile(r"[^\W_]")


class _Lines(dict):
    """Of a line: its characters without blanks and line comments, those of literals of data, and its shape (none for rows of data)."""

    def __missing__(self, line: str) -> tuple[int, int, str | None]:
        if len(self) > MOST_KNOWN:
            self.clear()
        bare = " ".join(line.split())
        cut = bare.find(" //")
        bare = bare[:cut] if cut > 0 else bare
        self[line] = (0, 0, None) if not bare or bare.startswith(("//", "# ")) else self.measured(bare)
        return self[line]

    @staticmethod
    def measured(bare: str) -> tuple[int, int, str | None]:
        size = len(bare)
        digits = _DIGIT.search(bare) is not None
        quoted = '"' in bare or "'" in bare or "`" in bare
        blobs = sum(len(s) for s in _STRING.findall(bare) if len(s) > 33 and _BLOB.match(s[1:-1])) if quoted and size > 33 else 0
        table = digits and _TABLE_ROW.match(bare) is not None
        data = blobs
        if digits and (table or bare.count(",") > 12):  # numbers and what lies between them
            numbers = sum(map(len, _NUMBER.findall(bare)))
            separators = bare.count(",") + bare.count(" ")
            if numbers > 0.4 * size and separators:
                data = min(size, blobs + numbers + separators)
        row = table or blobs > 0.7 * size
        shape = None
        if not row and _LETTER.search(bare):
            shape = _NAME.sub("w", _STRING.sub("s", bare) if quoted else bare)
            shape = _DIGITS.sub("0", shape) if digits else shape
        return size, min(size, data), shape


_lines = _Lines()


def code_of(text: str) -> str:
    """The text without block comments."""
    return _COMMENT.sub(" ", text)


def layout(text: str, code: str | None = None) -> dict[str, float]:
    """What the file looks like: shapes of lines, literals, blanks; `code` is code_of(text)."""
    code = code_of(text) if code is None else code
    shapes: Counter = Counter()
    data = total = 0
    for line in (code.replace("\r\n", "\n").replace("\r", "\n") if "\r" in code else code).split("\n"):
        size, literal, shape = _lines[line]
        total += size
        data += literal
        if shape is not None:
            shapes[shape] += 1
    n = sum(shapes.values())
    perplexity = math.exp(-sum(v / n * math.log(v / n) for v in shapes.values())) if n else 0.0
    return {
        "lines": n,
        "shapes": len(shapes),
        "repeats": max(shapes.values(), default=0),
        "perplexity": perplexity,
        "data": data,
        "data_share": data / max(1, total),
        "blanks": 1 - sum(map(len, text.split())) / max(1, len(text)),
    }


def names_of(text: str, code: str | None = None) -> list[str]:
    """The names in the code, in order; `code` is code_of(text)."""
    return _NAME.findall(_STRING.sub(" ", code_of(text) if code is None else code))


def triples(names: list[str]) -> list[int]:
    """Three compound names in a row, in the order of their first use: what a copy keeps and chance doesn't repeat."""
    line = [x for x in dict.fromkeys(names) if len(x) > 5 and ("_" in x.strip("_") or _HUMP.search(x))]
    return [xxh3_64_intdigest(" ".join(line[i : i + 3])) - (1 << 63) for i in range(len(line) - 2)]


def train(df: DataFrame, language: str, content: str) -> dict[str, np.ndarray]:
    """Bits of every n-gram per language, from the distinct names of all files that are laid out as text.

    The models have a fixed size: SYMBOLS cubed numbers per known language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text and name is not None and len(text) - sum(map(len, text.split())) > BLANKS * len(text):
                    seen.setdefault(name, Counter()).update(set(names_of(text)))
            for name, names in seen.items():
                if not names:
                    continue
                grams, sizes = codes(list(names))
                tally = np.bincount(grams, np.repeat(np.fromiter(names.values(), np.float64), sizes), SYMBOLS**ORDER)
                k = np.flatnonzero(tally)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k.astype(np.int32)), pa.array(tally[k].astype(np.int64))], names=["l", "k", "n"])

    counts = df.select(language, content).mapInArrow(count, "l string, k int, n bigint").groupBy("l", "k").agg(F.sum("n").alias("n"))
    models: dict[str, np.ndarray] = {}
    for row in counts.toLocalIterator():  # at most SYMBOLS ** 3 rows per language
        models.setdefault(row["l"], np.full(SYMBOLS**ORDER, 0.1))[row["k"]] += row["n"]
    for name, table in models.items():
        cube = table.reshape(-1, SYMBOLS)
        models[name] = (-np.log2(cube / cube.sum(axis=1, keepdims=True))).astype(np.float32).ravel()
    return models


class Bits:
    """Bits of n-grams of names under one model."""

    #: Sums are whole numbers, so that their order doesn't matter: bits in so many parts, and n-grams in the low half.
    PARTS, HALF = 1 << 20, 1 << 40

    def __init__(self, model: np.ndarray):
        self.model = np.rint(model * self.PARTS).astype(np.int64)
        self.known: dict[str, int] = {}

    def per_character(self, names: set[str]) -> float:
        """The cross-entropy of the distinct names."""
        if len(self.known) > MOST_KNOWN:
            self.known.clear()
        new = [x for x in names if x not in self.known]
        if new:
            grams, sizes = codes(new)
            sums = np.add.reduceat(self.model[grams], np.cumsum(sizes) - sizes)
            self.known.update(zip(new, (a * self.HALF + n for a, n in zip(sums.tolist(), sizes.tolist(), strict=True)), strict=True))
        bits, n = divmod(sum(map(self.known.__getitem__, names)), self.HALF)
        return bits / self.PARTS / max(1, n)


def _judge(name: str | None, text: str, path: str, repository: str | None, judge: Bits | None, ids: list[str] | None = None, code: str | None = None) -> tuple[str | None, float]:
    """The reason found in the file itself, if any, and the bits per character of its names; `mangled?` is a packed file, whose bits decide."""
    ids = names_of(text) if ids is None else ids
    return _reason(name, text, path, repository, ids, code), judge.per_character(set(ids)) if ids and judge else 0.0


def _reason(name: str | None, text: str, path: str, repository: str | None, ids: list[str], code: str | None) -> str | None:
    look = layout(text, code)
    head = head_of(text)
    if look["data"] >= DATA_CHARS and look["data_share"] >= DATA_SHARE:
        return "data"
    repeated = look["repeats"] >= REPEATS and look["perplexity"] <= SHAPES and look["lines"] >= LINES_PER_SHAPE * look["shapes"]
    marked = bool(_GENERATED.search(head)) and not _TAKEN_BACK.search(head)
    if marked or repeated and name != "Json":
        return "generated"
    if _LOCKFILE.search(path) and len(_HASHED.findall(text)) >= 2:
        return "generated"
    vendor = vendored_package(path)
    if vendor and vendor[1] and vendor[0] not in re.split(r"[^a-z0-9]+", (repository or "").lower()):
        return "copied"
    if names_other_project(head, repository):
        return "copied"
    if look["blanks"] >= BLANKS:
        return None
    short = sum(len(x.rstrip("0123456789")) <= 1 for x in ids) / max(1, len(ids))
    return "mangled?" if short >= SHORT_SHARE else None


def judged_files(
    df: DataFrame, file_id: str = "file_id", repository: str = "repository", path: str = "path", language: str = "language", content: str = "content"
) -> DataFrame:
    """`file_id`, reason, bits: reason is generated, mangled, copied, data, or null for a hand-written file.

    Null and empty contents are hand-written as far as anyone can tell. Files of no known
    language have no model, so their names can't be mangled. A file in its project's home repository is no
    copy: where any holder's head or package folder names the project, its home is the repository of
    that name, present or not; else the repository that is called like the file, else the one with
    most files of it. Repeated rows are judged each for itself; other columns aren't read.
    """
    spark = df.sparkSession
    named = known_language(F.col(language), F.col(path))
    # Languages without a grammar share one model, so that the number of models is fixed.
    named = F.when(named.isin(*set(EXTENSIONS.values())), named).when(named.isNotNull(), OTHER)
    source = df.select(
        F.col(file_id).alias("_id"), F.col(repository).alias("_repository"), F.coalesce(F.col(path), F.lit("")).alias("_path"), named.alias("_language"), F.col(content).alias("_content")
    )
    source = spread(source)
    models = spark.sparkContext.broadcast(train(source, "_language", "_content"))
    id_type = dict(source.dtypes)["_id"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judges = {name: Bits(model) for name, model in models.value.items()}
        part, at = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            rows = batch.to_pydict()
            reasons, bits, counts, lists, named, sources = [], [], [], [], [], []
            for repo, where, name, text in zip(rows["_repository"], rows["_path"], rows["_language"], rows["_content"], strict=True):
                where = where.replace("\\", "/")
                stem = where.rsplit("/", 1)[-1].rsplit(".", 1)[0].lower()
                parts = [x for x in re.split(r"[^a-z0-9]+", (repo or "").lower()) if x]
                named.append(sum(x == stem for x in parts) / max(1, len(parts)))
                code = code_of(text) if text else ""
                names = names_of(text, code) if text else []
                reason, b = _judge(name, text, where, repo, judges.get(name), names, code) if text else (None, 0.0)
                reasons.append(reason)
                bits.append(b)
                counts.append(len(set(names)))
                lists.append([] if reason == "data" else sorted(set(triples(names))))
                sources.append(origins(text, where) if reason == "copied" else [])
            own = pa.array(range(part + at, part + at + batch.num_rows), pa.int64())
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [own, batch.column(0), batch.column(1), batch.column(3), pa.array(reasons, pa.string()), pa.array(bits, pa.float64()), pa.array(counts, pa.int32()), pa.array(named, pa.float64()), pa.array(lists, pa.list_(pa.int64())), pa.array(sources, pa.list_(pa.string()))],
                names=["_key", "_id", "_repository", "_language", "reason", "bits", "_names", "_named", "_triples", "_origins"],
            )

    # Read by three branches below, judged once.
    seen = cut_lineage(source.mapInArrow(judge, f"_key bigint, _id {id_type}, _repository string, _language string, reason string, bits double, _names int, _named double, _triples array<bigint>, _origins array<string>"))
    # The usual bits of a language, from all its files; JSON has no names but those of its literals.
    usual = seen.filter("reason is null and bits > 0").groupBy("_language").agg(F.avg("bits").alias("_usual"))
    strange = (F.col("_language") != "Json") & (F.col("_names") >= LEAST_NAMES) & (F.col("bits") > F.col("_usual") + F.when(F.col("reason") == "mangled?", PACKED_BITS).otherwise(MANGLED_BITS))
    keyed = seen.join(F.broadcast(usual), "_language", "left").withColumn("_mangled", F.coalesce(strange, F.lit(False)))  # one row a language
    names = keyed.filter("not _mangled").select("_key", "_repository", "_named", F.explode("_triples").alias("_t")).withColumn("_repository", F.coalesce("_repository", F.lit("")))
    # Per triple and repository first, so that a triple of a third of all files is few rows.
    held = names.groupBy("_t", "_repository").agg(F.max("_named").alias("_named"), F.count(F.lit(1)).alias("_n"))
    home = held.groupBy("_t").agg(F.max(F.struct("_named", "_n", "_repository"))["_repository"].alias("_home"), F.count(F.lit(1)).alias("_repos"), F.sum("_n").alias("_files")).filter("_repos > 1")
    # Who says where a triple comes from says it for all its holders.
    told = keyed.filter("size(_origins) > 0").select(F.explode("_triples").alias("_t"), "_origins").select("_t", F.explode("_origins").alias("_o")).groupBy("_t").agg(F.collect_set("_o").alias("_told"))
    own = F.regexp_replace(F.lower("_repository"), "[^a-z0-9]", "")
    elsewhere = F.when(F.col("_told").isNotNull(), ~F.exists("_told", lambda x: F.contains(own, x))).otherwise(F.col("_home") != F.col("_repository"))
    facts, on = cut_lineage(home.join(told, "_t", "full")), ["_t"]
    # A triple of very many files is in several parts, to each of which what is known of it goes.
    hot = facts.filter(F.col("_files") > HOT_FILES).select("_t", F.ceil(F.col("_files") / HOT_FILES).cast("int").alias("_parts"))
    n_hot = hot.count()
    if n_hot:
        hot, on = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot, ["_t", "_part"]
        parts = F.coalesce("_parts", F.lit(1))
        names = names.join(hot, "_t", "left").withColumn("_part", F.pmod(F.xxhash64("_key"), parts).cast("int")).drop("_parts")
        facts = facts.join(hot, "_t", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    foreign = (
        names.join(facts, on)
        .groupBy("_key")
        .agg(F.count_if(elsewhere).alias("_foreign"), F.count(F.lit(1)).alias("_shared"))
        .filter(F.col("_foreign") >= LEAST_TRIPLES)
    )
    out = keyed.join(foreign, "_key", "left")
    copied = F.col("_foreign") >= FOREIGN_SHARE * F.size("_triples")
    own = F.when(F.col("reason") != "mangled?", F.col("reason"))
    reason = F.when(own == "data", own).when(F.col("_mangled"), "mangled").when(own.isNotNull(), own).when(copied, "copied")
    return out.select(F.col("_id").alias(file_id), reason.alias("reason"), "bits")
