"""Parsing free-text model responses into verdicts per file, as a table function.

A response is read by stages, each of which proposes (file, verdict) pairs in
the order of the text. One rule set per mode:

- "compat" keeps the behaviour users know, quirks included. Each stage is a row
  of a table: a pattern that cuts a line into a text that should name a file and
  one that should hold the verdict, and how the name is looked up. Its rules:
  a verdict text reads O if it has an o in either case, else X if it has an x;
  the first stage takes any name and its last word counts; later stages run
  while files are missing and never overwrite; names are matched by substring,
  the first of the batch that fits; only lower-case labels separate, with or
  without a space before the colon. A line whose file label stands in another case cannot be read at all: the error is
  reported and no verdict of the response is given.
- "strict" takes only files of the batch, whole names, and a lone O or X.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import SparkSession

Proposal = tuple[str, str]

# The labels and file endings that the instruction asks responses for.
VERDICT_LABEL, FILE_LABEL = r"judgment ?:", r"filename ?:"
ENDINGS = r"\.(?:png|jpg|jpeg)"


def _loose(text: str | None) -> str:
    found = re.search("o", text or "", re.I) or re.search("x", text or "", re.I)
    return found[0].upper() if found else ""


def _held(text: str, names: list[str]) -> str:
    """The first name that the text holds."""
    return next(filter(text.__contains__, names), "")


def _either(text: str, names: list[str]) -> str:
    """The first name that the text holds, or that holds the text."""
    return next((n for n in names if n in text or text in n), "")


def _same(text: str, names: list[str]) -> str:
    return text if text in names else ""


_NAMED = re.compile(rf"(?:.*?{FILE_LABEL})(.*?)(?:{FILE_LABEL}.*)?$")


def _after_label(text: str, names: list[str]) -> str:
    """What follows the file label, whatever it is; without a label, a name that the text holds."""
    named = _NAMED.match(text)
    if not named and re.search(FILE_LABEL, text, re.I):
        raise IndexError("a file label in another case")
    return (named[1] if named else _held(text, names)).strip("[]'\"\t ")


class Stage(NamedTuple):
    """Groups "name" and "verdict" of every match in a line, or in a line and the next one (joined by a line break)."""

    cut: re.Pattern
    lookup: Callable[[str, list[str]], str]
    lines: int = 1
    #: Whether each name asks for its first line, instead of each line for its name.
    by_name: bool = False


COMPAT = [
    # a line with both labels; a verdict label in another case separates nothing, so there is no verdict
    Stage(re.compile(rf"^(?=.*(?i:{VERDICT_LABEL}))(?P<name>.*?)(?:{VERDICT_LABEL}(?P<verdict>.*?)(?:{VERDICT_LABEL}.*)?)?$"), _after_label),
    # the two parts around a line's first colon; a second colon ends the verdict
    Stage(re.compile(r"^\s*(?P<name>[^:]*?)\s*:(?P<verdict>[^:]*)"), _either),
    # the cells of a table row, the name and the verdict in one cell
    Stage(re.compile(r"(?:^(?=.*\|)|(?<=\|))(?=(?P<name>[^|]+))(?P<verdict>[^|]+)"), _held),
    # a line with a name, the verdict there or else in the next line
    Stage(re.compile(r"^(?P<name>.*)\n(?P<next>.*)$"), _held, 2),
    # the first line that holds a name: later ones do not count
    Stage(re.compile(r"^(?P<name>(?P<verdict>.*))$"), _held, by_name=True),
    # nothing but a name and a letter
    Stage(re.compile(rf"^\s*(?P<name>[^:]*{ENDINGS})\s*:\s*(?P<verdict>[oOxX])\s*$"), _same),
]


def _proposals(stage: Stage, lines: list[str], names: list[str]) -> Iterator[Proposal]:
    if stage.by_name:
        for name in names:
            yield name, _loose(next((line for line in lines if name in line), ""))
        return
    for at, line in enumerate(lines):
        text = "\n".join([line, *lines[at + 1 : at + 2]] + [""] * (at + 1 == len(lines))) if stage.lines == 2 else line
        for found in stage.cut.finditer(text):
            parts = found.groupdict()
            verdict = _loose(parts["verdict"]) if "verdict" in parts else _loose(parts["name"]) or _loose(parts["next"])
            yield stage.lookup(parts["name"], names), verdict


_STRICT_LABELLED = re.compile(r"^\W*filename\s*:\s*(?P<name>.+?)\s*judgment\s*:\s*(?P<verdict>.+?)\s*$", re.I)
_BARE = "[]'\"`*\t ."


def _strict(lines: list[str], names: list[str]) -> Iterator[Proposal]:
    waiting = ""
    for line in lines:
        labelled = _STRICT_LABELLED.match(line)
        if labelled:
            found = [labelled["name"], labelled["verdict"]]
        elif "|" in line:
            found = [c for c in line.split("|") if c.strip()]
        else:
            found = line.rsplit(":", 1)
        parts = [p.strip().strip(_BARE if p.strip() not in names else "") for p in found]
        if len(parts) >= 2 and parts[0] in names and parts[1].upper() in ("O", "X"):
            yield parts[0], parts[1].upper()
        elif len(parts) == 1 and waiting and parts[0].upper() in ("O", "X"):
            yield waiting, parts[0].upper()
        waiting = parts[0] if len(parts) == 1 and parts[0] in names else ""


def parse_response(text: str | None, files: list[str], mode: str = "compat") -> dict[str, tuple[str, int]]:
    """name -> (verdict, stage from 1) of a response about files (paths or names)."""
    names = [f.rsplit("/", 1)[-1] for f in files]
    if not text or not text.strip():
        return {}
    lines = text.strip().split("\n")
    found: dict[str, tuple[str, int]] = {}
    if mode == "strict":
        for name, verdict in _strict(lines, names):
            found[name] = (verdict, 1)
        return found
    for number, stage in enumerate(COMPAT, 1):
        if number > 1 and len(found) >= len(names):
            break
        for name, verdict in _proposals(stage, lines, names):
            if name and verdict and (number == 1 or name not in found):
                found[name] = (verdict, number)
    return found


class ParseVerdicts:
    """Rows of one response; an error gives one row without a file."""

    def eval(self, text: str, files: list[str], mode: str):
        try:
            for name, (verdict, stage) in parse_response(text, [] if files is None else list(files), mode or "compat").items():
                yield name, verdict, stage, None
        except IndexError as e:
            yield None, None, None, f"IndexError: {e}"


RETURNS = "filename string, judgment string, stage int, error string"


def register(spark: SparkSession, name: str = "parse_verdicts") -> None:
    """Make the table function callable as name(text, files, mode) in SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register(name, udtf(ParseVerdicts, returnType=RETURNS, useArrow=True))
