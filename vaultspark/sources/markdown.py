"""Collections of Markdown files with frontmatter as DataFrames, and rendering them back.

Two dialects: canonical (one `key: JSON` a line) and a tolerant block subset of YAML (nested maps and lists,
block and quoted scalars, comments). Anchors, aliases, tags and merge keys are refused. A file that cannot be
read keeps its row with `parse_error`; no row is dropped.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Limits of a frontmatter region.
MOST_LINES, MOST_CHARS, MOST_DEPTH = 4096, 262_144, 16
_KEY = re.compile(r"""^("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s#'"\[\]{},&*!|>%@`-][^:#]*?|-[^\s:][^:#]*?)\s*:(?:\s+(.*)|\s*)$""", re.S)


class FrontmatterError(ValueError):
    pass


def split_document(text: str) -> tuple[list[str], str]:
    """(lines of the frontmatter, body). One blank line after the closing fence belongs to neither."""
    text = text.removeprefix("﻿").replace("\r\n", "\n")
    lines = text.split("\n")
    if lines[0].rstrip() != "---":
        raise FrontmatterError("no opening fence")
    for k in range(1, min(len(lines), MOST_LINES + 2)):
        if lines[k].rstrip() == "---":
            region = lines[1:k]
            if sum(map(len, region)) > MOST_CHARS:
                raise FrontmatterError("frontmatter too long")
            body = lines[k + 1 :]
            return region, "\n".join(body[1:] if body and body[0] == "" else body)
    raise FrontmatterError("no closing fence")


def _depth(value, level: int = 0) -> int:
    if level > MOST_DEPTH:
        raise FrontmatterError("nested too deeply")
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return max([level, *(_depth(v, level + 1) for v in inner)])


def _unique(pairs: list[tuple[str, object]]) -> dict:
    out: dict = {}
    for key, value in pairs:
        if key in out:
            raise FrontmatterError(f"repeated key {key}")
        out[key] = value
    return out


def canonical(lines: list[str]) -> dict:
    """One `key: JSON` a line; ValueError where a line is anything else."""
    pairs = []
    for line in lines:
        if not line.strip():
            continue
        key, sep, value = line.partition(": ")
        if not sep or not re.fullmatch(r"[A-Za-z_][\w-]*", key):
            raise ValueError("not canonical")
        pairs.append((key, json.loads(value, object_pairs_hook=_unique, parse_constant=lambda x: 1 / 0)))
    return _unique(pairs)


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "&*!" and text[:1]:
        raise FrontmatterError("anchors, aliases and tags are refused")
    if text[:1] == '"':
        try:
            return json.loads(text)
        except ValueError as e:
            raise FrontmatterError("bad quoted text") from e
    if text[:1] == "'":
        if not re.fullmatch(r"'(?:[^']|'')*'", text):
            raise FrontmatterError("bad quoted text")
        return text[1:-1].replace("''", "'")
    if text[:1] in "[{" and text[:1]:
        return _flow(text)
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text in ("true", "True", "TRUE", "false", "False", "FALSE"):
        return text.lower() == "true"
    if re.fullmatch(r"[-+]?(0|[1-9]\d*)", text):
        return int(text)
    if re.fullmatch(r"[-+]?(\d+\.\d*|\.\d+|\d+)([eE][-+]?\d+)?", text):
        return float(text)
    return text


def _flow(text: str):
    """Inline lists and maps of scalars, nested ones included."""
    items, depth, quote, start, close = [], 0, "", 1, {"[": "]", "{": "}"}[text[0]]
    if text[-1] != close:
        raise FrontmatterError("inline value is not closed")
    for k, c in enumerate(text[1:-1], 1):
        if quote:
            quote = "" if c == quote and text[k - 1] != "\\" else quote
        elif c in "\"'" and not text[start:k].strip():
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == "," and not depth:
            items.append(text[start:k])
            start = k + 1
    if text[start:-1].strip():
        items.append(text[start:-1])
    if close == "]":
        return [_scalar(i) for i in items]
    pairs = []
    for i in items:
        key, sep, value = i.partition(":")
        if not sep:
            raise FrontmatterError("inline map without a colon")
        pairs.append((str(_scalar(key)), _scalar(value)))
    return _unique(pairs)


def _without_comment(line: str) -> str:
    quote = ""
    for k, c in enumerate(line):
        if quote:
            quote = "" if c == quote and line[k - 1] != "\\" else quote
        elif c in "\"'" and (k == 0 or line[k - 1] in " [{,:"):
            quote = c
        elif c == "#" and (k == 0 or line[k - 1] in " \t"):
            return line[:k].rstrip()
    return line.rstrip()


def _is_key(text: str) -> bool:
    return text[0] not in "\"'[{" and _KEY.match(text) is not None


class _Cells:
    """The tolerant dialect as cells (column, text): every dash is one, and so is what stands behind the dashes of a line.

    A list or a map is what its cells' common column says, so a map that begins behind a dash needs no care of its own.
    """

    def __init__(self, lines: list[str]):
        self.lines, self.row = lines, 0
        self.held: list[tuple[int, str]] = []  # cells of the line before `row` that are not taken yet

    def ahead(self) -> tuple[int, str] | None:
        while not self.held and self.row < len(self.lines):
            plain = _without_comment(self.lines[self.row])
            self.row += 1
            text = plain.lstrip()
            column = len(plain) - len(text)
            if text and "\t" in plain[:column]:
                raise FrontmatterError("tabs do not indent")
            while text == "-" or text.startswith("- "):
                self.held.append((column, "-"))
                behind = text[1:].lstrip()
                column, text = column + len(text) - len(behind), behind
            if text:
                self.held.append((column, text))
        return self.held[0] if self.held else None

    def take(self) -> str:
        return self.held.pop(0)[1]

    def tree(self, column: int, depth: int = 0):
        """The list or map whose cells stand in a column."""
        if depth > MOST_DEPTH:
            raise FrontmatterError("nested too deeply")
        cell = self.ahead()
        found = self.items(column, depth) if cell and cell[1] == "-" else _unique(self.pairs(column, depth))
        cell = self.ahead()
        if cell and cell[0] > column:
            raise FrontmatterError("indent does not fit")
        return found

    def items(self, column: int, depth: int) -> list:
        out = []
        while self.ahead() == (column, "-"):
            self.take()
            if self.held and self.held[0][1] != "-" and not _is_key(self.held[0][1]):
                out.append(self.single(self.take(), column))
            else:
                out.append(self.below(column + 1, depth))
        return out

    def pairs(self, column: int, depth: int) -> list:
        out = []
        while (cell := self.ahead()) and cell[0] == column and cell[1] != "-":
            met = _KEY.match(self.take())
            if not met:
                raise FrontmatterError("a line is no key and value")
            key = str(_scalar(met[1])) if met[1][0] in "\"'" else met[1]
            if key == "<<":
                raise FrontmatterError("merge keys are refused")
            value = (met[2] or "").strip()
            if value:
                out.append((key, self.single(value, column)))
            else:  # a list may stand in its key's own column
                listed = self.ahead() == (column, "-")
                out.append((key, self.below(column if listed else column + 1, depth)))
        return out

    def below(self, least: int, depth: int):
        """What the next cell begins, if it stands in column `least` or further in; else null."""
        cell = self.ahead()
        return self.tree(cell[0], depth + 1) if cell and cell[0] >= least else None

    def single(self, text: str, column: int):
        return self.text(text, column) if re.fullmatch(r"[|>][-+]?\d?", text) else _scalar(text)

    def text(self, mark: str, column: int) -> str:
        """Lines kept or folded as they are, up to the next one that stands no further in than `column`."""
        taken: list[str] = []
        while self.row < len(self.lines) and (not self.lines[self.row].strip() or len(self.lines[self.row]) - len(self.lines[self.row].lstrip()) > column):
            taken.append(self.lines[self.row])
            self.row += 1
        inner = min((len(x) - len(x.lstrip()) for x in taken if x.strip()), default=0)
        taken = [x[inner:] for x in taken]
        if mark[0] == "|":
            out = "\n".join(taken)
        else:
            out = re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(taken))
            out = re.sub(r"\n\n", "\n", out)
        out = out.rstrip("\n")
        return out if "-" in mark or not out else out + "\n"


def tolerant(lines: list[str]) -> dict:
    """The map that lines of the tolerant dialect hold."""
    cells = _Cells(lines)
    first = cells.ahead()
    found = cells.tree(first[0]) if first else {}
    if cells.ahead() is not None or not isinstance(found, dict):
        raise FrontmatterError("frontmatter is no map")
    return found


def parse(text: str) -> tuple[dict, str]:
    """(metadata, body) of a document in either dialect."""
    lines, body = split_document(text)
    try:
        found = canonical(lines)
    except FrontmatterError:
        raise
    except (ValueError, ZeroDivisionError):
        found = tolerant(lines)
    _depth(found)
    return found, body


def render(metadata: dict, body: str) -> str:
    """The canonical document: one compact JSON value a line."""
    head = "".join(f"{k}: {json.dumps(v, ensure_ascii=False, separators=(',', ':'))}\n" for k, v in metadata.items())
    return f"---\n{head}---\n\n{body}"


@F.pandas_udf(StructType([StructField(n, StringType()) for n in ("metadata", "body", "parse_error")]))
def parsed(texts: pd.Series) -> pd.DataFrame:
    """Metadata as JSON, body, and why it cannot be read."""
    rows = []
    for t in texts:
        try:
            metadata, body = parse(t if t is not None else "")
            rows.append((json.dumps(metadata, ensure_ascii=False), body, None))
        except FrontmatterError as e:
            rows.append((None, None, str(e)))
    return pd.DataFrame(rows, columns=["metadata", "body", "parse_error"])


def files(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """(path, mtime, size, content) of every file below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return rows.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")


def entries(spark: SparkSession, folder: str, in_trash: bool = False) -> DataFrame:
    """(path, mtime, size, revision, metadata variant, body, parse_error, in_trash) of a collection."""
    read = files(spark, folder).withColumn("p", F.when(F.is_valid_utf8(F.col("content").cast("string")), parsed(F.col("content").cast("string"))))
    error = F.coalesce("p.parse_error", F.when(F.col("p").isNull(), F.lit("not UTF-8")))
    return read.select("path", "mtime", "size", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("revision"), F.try_parse_json("p.metadata").alias("metadata"), "p.body", error.alias("parse_error"), F.lit(in_trash).alias("in_trash"))


def both(spark: SparkSession, active: str, trash: str) -> DataFrame:
    return entries(spark, active).unionByName(entries(spark, trash, True))


def field(name: str, kind: str = "string"):
    """A metadata value by name, null where it is absent or of another kind; built-in types keep some under attributes."""
    own, packed = (F.try_variant_get("metadata", f"$.{p}{name}", kind) for p in ("", "attributes."))
    return F.coalesce(own, F.when(~F.coalesce(F.try_variant_get("metadata", "$.type", "string"), F.lit("")).contains("/"), packed))


def signatures(spark: SparkSession, folder: str) -> DataFrame:
    """(path, mtime, size) without reading any content."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    return rows.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def importable(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """(path, text, refusal) of foreign Markdown: at most 2 MiB, UTF-8, not empty, no NUL, in path order."""
    rows = files(spark, folder)
    text = F.col("content").cast("string")
    refusal = F.when(F.col("size") > 2 << 20, F.lit("too large")).when(~F.is_valid_utf8(text), F.lit("not UTF-8")).when(F.trim(text) == "", F.lit("empty")).when(text.contains("\0"), F.lit("holds NUL"))
    out = rows.select("path", F.when(refusal.isNull(), text).alias("text"), refusal.alias("refusal"))
    return out.orderBy("path").limit(limit) if limit else out
