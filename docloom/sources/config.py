"""A project's configuration: a file of settings over defaults, and the jobs that it steers."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import candidates, drafts, parsers
from .files import source_files

#: Where a project's settings are looked for, in this order.
NAMES = ("docloom.json", ".docloom/config.json")
BACKENDS = ("anthropic", "azure-openai", "deepseek", "auto")


class BadConfig(ValueError):
    """A file of settings that can't be used; the message names it."""


@dataclass
class Config:
    """Settings; what a file does not name has its default."""

    output: str = "./docs/use-cases"
    mock: bool = False
    backend: str = "auto"
    max_candidates: int = 50
    constant_returns: bool = False
    surface: str = "annotated"
    benchmarks: bool = False
    max_steps: int = drafts.MAX_STEPS
    jargon: list[str] = field(default_factory=lambda: list(drafts.JARGON))

    def __post_init__(self):
        kinds = {"output": str, "backend": str, "surface": str, "mock": bool, "constant_returns": bool, "benchmarks": bool, "max_candidates": int, "max_steps": int, "jargon": list}
        for f in fields(self):
            value = getattr(self, f.name)
            if not isinstance(value, kinds[f.name]) or kinds[f.name] is int and (isinstance(value, bool) or value < 1):
                raise ValueError(f"{f.name}: a {'positive ' if kinds[f.name] is int else ''}{kinds[f.name].__name__} is asked for, not {value!r}")
        if not all(isinstance(x, str) for x in self.jargon):
            raise ValueError("jargon: texts are asked for")
        for name, allowed in (("backend", BACKENDS), ("surface", parsers.SURFACES)):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name}: one of {', '.join(allowed)}, not {getattr(self, name)!r}")


def load(root: str) -> Config:
    """The settings of a project: those of the first file that is there, else the defaults. Names that are no settings are left out."""
    for name in NAMES:
        at = Path(root, name)
        if not at.is_file():
            continue
        try:
            found = json.loads(at.read_text(encoding="utf-8"))
            if not isinstance(found, dict):
                raise ValueError("an object is asked for")
            return Config(**{f.name: found[f.name] for f in fields(Config) if f.name in found})
        except (ValueError, OSError) as e:
            raise BadConfig(f"{name} can't be used: {e}") from e
    return Config()


def init(root: str) -> str:
    """Write the defaults as a project's settings; one that has the file keeps it, and that is an error."""
    at = Path(root, NAMES[0])
    with at.open("x", encoding="utf-8") as f:
        f.write(json.dumps(asdict(Config()), indent=2) + "\n")
    return str(at)


def completion_tokens(text: str | None, default: int) -> int:
    """The bound on an answer's tokens that a setting names: a positive whole number; the default if it is blank."""
    text = (text or "").strip()
    if not text:
        return default
    if not text.isascii() or not text.isdigit() or int(text) < 1:
        raise ValueError(f"a positive whole number of tokens is asked for, not {text!r}")
    return int(text)


def found(spark: SparkSession, root: str, config: Config | None = None, everything: bool = False) -> DataFrame:
    """The candidates of a project as its settings ask: parsed, in order, and evenly sampled down to the most that a run takes (all with ``everything``)."""
    config = config or load(root)
    own = parsers.parse(source_files(spark, root), config.surface, config.benchmarks, config.constant_returns)
    if everything:
        return own
    # numbered by path and line: a row for each candidate of one project
    numbered = own.withColumn("n", F.row_number().over(Window.orderBy("relative_path", "line_start")).cast("long"))
    return candidates.sample_even(numbered, "n", config.max_candidates).drop("n")


def issues(rows: DataFrame, config: Config) -> DataFrame:
    """The rules that drafts break, with the settings' bounds."""
    return drafts.issues(rows, config.max_steps, tuple(config.jargon))
