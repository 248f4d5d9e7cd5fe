"""Help archives as a Spark data source.

An archive is a container of named entities. The bytes of the entity FileStorage are a zip file of pages, those of PackBlock
one of a table of contents. Little-endian; a block's header has its sizes in hexadecimal text.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.text import EXCLUDED_CONTENT, EXCLUDED_NAMES, PAGE_CONTENT, PAGE_PATHS

LAST = 0x7FFFFFFF
NAME_GAP, BODY_GAP = 40, 20
PAGES = "archive string, path string, html string, size long"
TOC = "archive string, id long, parent_id long, child_count long, child_ids array<long>"


def _hex(data: bytes, at: int) -> int:
    try:
        return int(data[at : at + 8].decode("ascii"), 16)
    except ValueError:
        return 0


def places(read, size: int) -> dict[str, tuple[int, int]]:
    """(first byte, length) of the entities of a container of `size` bytes, of which read(at, n) gives some; entries that aren't in use and
    those whose bytes are cut off are left out."""
    listed = read(16 + 2 + 9 + 9 + 11, _hex(read(16, 31), 2))
    out = {}
    for header, body, reserved in struct.iter_unpack("<III", listed[: len(listed) // 12 * 12]):
        if reserved != LAST:
            continue
        length = _hex(read(header, 2 + 9), 2) - 24
        name = read(header + 2 + 9 + NAME_GAP, length) if length > 0 else b""
        at, size_of_body = body + 2 + 9 + BODY_GAP, _hex(read(body, 2 + 9), 2)
        if len(name) == length and at + size_of_body <= size and (text := name.decode("utf-16-le", "replace").rstrip("\0").strip('"')):
            out[text] = at, size_of_body
    return out


def entities(data: bytes) -> dict[str, bytes]:
    """The entities of a container by their names."""
    return {name: data[at : at + n] for name, (at, n) in places(lambda at, n: data[at : at + n], len(data)).items()}


def container(parts: dict[str, bytes]) -> bytes:
    """A container of the given entities, as `entities` reads it."""
    listed, blocks, at = b"", b"", 16 + 31 + 12 * len(parts)
    for name, body in parts.items():
        encoded = name.encode("utf-16-le")
        header = b"\0\0" + f"{len(encoded) + 24:08x} ".encode() + b"\0" * NAME_GAP + encoded
        block = b"\0\0" + f"{len(body):08x} ".encode() + b"\0" * BODY_GAP + body
        listed += struct.pack("<III", at, at + len(header), LAST)
        blocks += header + block
        at += len(header) + len(block)
    return b"\0" * 16 + b"\0\0" + f"{len(listed):08x} ".encode() + f"{len(listed):08x} ".encode() + b"\0" * 11 + listed + blocks


def decoded(data: bytes, order: tuple[str, ...] = ("utf-8", "cp1251")) -> str:
    """Text in the first encoding that fits; in the last resort UTF-8 without what doesn't. Old archives are cp1251 first."""
    for encoding in order:
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "ignore")


def _is_page(name: str, text: str) -> bool:
    low, body = name.lower(), text.lower()
    named = name.endswith(".html") and any(p in low for p in PAGE_PATHS) and not any(p in low for p in EXCLUDED_NAMES)
    return named and any(p in body for p in PAGE_CONTENT) and not any(p in body for p in EXCLUDED_CONTENT)


def pages(data: bytes, order: tuple[str, ...] = ("utf-8", "cp1251"), only_help: bool = True) -> Iterator[tuple[str, str]]:
    """(path, html) of an archive; none of a broken one."""
    try:
        with zipfile.ZipFile(io.BytesIO(entities(data).get("FileStorage", b""))) as z:
            for name in z.namelist():
                html = decoded(z.read(name), order)
                if not only_help or _is_page(name, html):
                    yield name, html
    except (zipfile.BadZipFile, struct.error, ValueError):
        return


def toc_tokens(text: str) -> list[str]:
    """Brackets, commas and what stands between them; quoted stretches, with \\ before a character, in one piece."""
    out, word, quoted, taken = [], [], False, False
    for c in text:
        if taken or c == "\\":
            taken = not taken
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{}[](),":
            out += [w] if (w := "".join(word).strip()) else []
            out.append(c)
            word = []
            continue
        word.append(c)
    return out + ([w] if (w := "".join(word).strip()) else [])


def toc_rows(text: str, commas: bool = True) -> Iterator[tuple[int, int, int, list[int]]]:
    """(id, parent_id, child_count, child_ids) of the outer {...} groups that start with three numbers.

    Groups with commas between the numbers count, too, unless `commas` is False (then they are left out, as old readers do).
    """
    depth, group = 0, []
    for t in toc_tokens(text):
        if t == "{":
            depth += 1
            if depth == 1:
                group = []
                continue
        elif t == "}":
            depth -= 1
            if depth == 0:
                own = [x for x in group if x != ","] if commas else group
                head = next((i for i, x in enumerate(own) if not x.isdigit()), len(own))
                if head >= 3:
                    numbers = [int(x) for x in own[:head]]
                    yield numbers[0], numbers[1], numbers[2], numbers[3 : 3 + numbers[2]]
        if depth:
            group.append(t)


def toc(data: bytes, order: tuple[str, ...] = ("utf-8", "cp1251")) -> Iterator[tuple[int, int, int, list[int]]]:
    block = entities(data).get("PackBlock", b"")
    try:
        with zipfile.ZipFile(io.BytesIO(block)) as z:
            block = z.read(z.namelist()[0]) if z.namelist() else block
    except zipfile.BadZipFile:
        pass
    yield from toc_rows(decoded(block, order))


def _files(spark: SparkSession, path: str, glob: str, least: int) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.filter(F.col("length") >= least).select("path", "content")


def read_pages(spark: SparkSession, path: str, glob: str = "*_ru.{hbk,res}", order: tuple[str, ...] = ("utf-8", "cp1251"), only_help: bool = True) -> DataFrame:
    """The pages of all archives below a folder, which only Spark needs to reach: archive, path, html, size (of the archive's entry)."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(name, p, h, len(h)) for p, h in pages(content, order, only_help)]
                yield pd.DataFrame(rows, columns=["archive", "path", "html", "size"])

    return _files(spark, path, glob, 16).mapInPandas(run, PAGES)


def read_toc(spark: SparkSession, path: str, glob: str = "*_ru.{hbk,res}", order: tuple[str, ...] = ("utf-8", "cp1251")) -> DataFrame:
    """The tables of contents of all archives below a folder."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(name, *r) for r in toc(content, order)], columns=["archive", "id", "parent_id", "child_count", "child_ids"])

    return _files(spark, path, glob, 16).mapInPandas(run, TOC)


def toc_paths(rows: DataFrame, root: int = 0) -> DataFrame:
    """(id, parent_id, level, path): the tree of contents from its roots down, however deep; rows that no root leads to are left out.

    An id that is its own ancestor (where ids repeat) is an error. Rounds grow with the logarithm of the depth.
    """
    from fathomline.operators import tree

    return tree.paths(rows, root)
