"""Ignore files of a folder as a predicate over relative paths."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

#: Names of ignore files, of falling weight within one folder.
NAMES = (".rgignore", ".ignore", ".gitignore")


@dataclass(frozen=True)
class Rule:
    """A pattern for paths below ``folder``; ``negated`` ones take paths back in, ``folders`` ones mean only folders."""

    folder: str
    pattern: str
    negated: bool = False
    folders: bool = False


def _glob(pattern: str) -> str:
    """A glob as a regular expression: ``*`` and ``?`` stay within a name, ``**`` spans folders, ``[...]`` is a class."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("/**", i) and i + 3 == len(pattern):
            out, i = out + "/.+", i + 3
        elif c == "*":
            while pattern.startswith("*", i):
                i += 1
            out += "[^/]*"
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end]
            inner = ("^/" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\").replace("[", "\\[")
            out, i = out + f"[{inner}]", end + 1
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


def rules_of(text: str, folder: str = "") -> list[Rule]:
    """The rules of one ignore file, in their order; blank lines and comments have none."""
    out = []
    for raw in text.splitlines():
        line = raw if raw.endswith("\\ ") else raw.rstrip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line
        only = line.endswith("/")
        line = line.rstrip("/")
        if not line:
            continue
        anchored = "/" in line
        body = _glob(line.lstrip("/"))
        lead = re.escape(folder) + "/" if folder else ""
        out.append(Rule(folder, f"^{lead}{'' if anchored else '(?:[^/]+/)*'}{body}$", negated, only))
    return out


def ordered(found: list[tuple[str, str]]) -> list[Rule]:
    """Rules of ``(path of an ignore file, its text)``, the weightier later: deeper folders, then as in ``NAMES``."""
    def weight(path: str) -> tuple[int, int, str]:
        folder, _, name = path.rpartition("/")
        return folder.count("/") + bool(folder), -NAMES.index(name), path

    return [r for path, text in sorted(found, key=lambda x: weight(x[0])) for r in rules_of(text, path.rpartition("/")[0])]


def ignored(path: Column, rules: list[Rule]) -> Column:
    """Whether a file is left out: the last rule that matches it, or one of the folders above it, counts.

    A file below a folder that is left out can't be taken back in.
    """
    if not rules:
        return F.lit(False)

    def decided(where: Column, folder: bool) -> Column:
        own = [r for r in rules if folder or not r.folders]
        out = F.lit(False)
        for r in own:  # a later rule overrules an earlier one
            out = F.when(where.rlike(r.pattern), F.lit(not r.negated)).otherwise(out)
        return out

    parts = F.split(path, "/")
    above = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.coalesce(F.exists(above, lambda p: decided(p, True)), F.lit(False)) | decided(path, False)


def read(spark: SparkSession, root: str, names: tuple[str, ...] = NAMES[:2]) -> list[Rule]:
    """The rules of a folder's ignore files, nested ones too; of a ``.gitignore`` only where named.

    The files are few and small beside the notes: their texts reach the driver, which builds the predicate.
    """
    spark.dataSource.register(files.FileListing)
    listed = spark.read.format("notelake_files").option("named", ",".join(names)).load(root)
    return ordered([(r["path"], r["content"]) for r in files.contents(listed.select("path"), root).where("problem is null").select("path", "content").collect()])


def visible(notes: DataFrame, rules: list[Rule]) -> DataFrame:
    return notes.where(~ignored(F.col("path"), rules))
