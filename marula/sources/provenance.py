"""What surrounds a run: configuration, logs, archives, versions, and the report of its stages. Small files, on the driver."""

from __future__ import annotations

import logging
import platform
import re
import shutil
import subprocess
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, fields
from importlib import metadata
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from marula.sources.files import markdown_table


@dataclass(frozen=True)
class Config:
    """Thresholds and period of a run. Ratios are of 100."""

    title_threshold: float = 95.0
    year_window: int = 1
    affiliation_threshold: float = 92.0
    affiliation_gap: float = 5.0
    year_min: int = 2015
    year_max: int = 2025
    doc_types: tuple[str, ...] = ("ar", "re")


#: Keys of a configuration file, by section, and what they set; shares of 1 are given as ratios of 100. Fixed values.
KEYS = {
    ("cleaning", "dedup_title_threshold"): ("title_threshold", 100),
    ("cleaning", "dedup_year_window"): ("year_window", 1),
    ("cleaning", "affiliation_fuzzy_threshold"): ("affiliation_threshold", 100),
    ("corpus", "year_min"): ("year_min", 1),
    ("corpus", "year_max"): ("year_max", 1),
    ("corpus", "doc_types"): ("doc_types", None),
}


def read_config(path: str | Path) -> Config:
    """The configuration of a YAML file; keys that it lacks keep their defaults, keys that aren't known are ignored."""
    try:
        import yaml
    except ImportError as e:
        raise ImportError("configuration files need PyYAML") from e
    given = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    found = {}
    for (section, key), (name, scale) in KEYS.items():
        value = (given.get(section) or {}).get(key)
        if value is not None:
            found[name] = tuple(value) if scale is None else value * scale
    kinds = {f.name: type(f.default) for f in fields(Config)}
    return Config(**{k: kinds[k](round(v, 9)) if kinds[k] is not tuple else v for k, v in found.items()})


def read_requirements(text: str) -> list[tuple[str, str, str]]:
    """(name, relation, version) of each line of a requirements file; comments, options and blank lines are none."""
    out = []
    for line in text.splitlines():
        line = line.split("#", 1)[0].split(";", 1)[0].strip()
        if not line or line.startswith("-"):
            continue
        name, relation, version = re.match(r"([\w.-]+(?:\[[^\]]*\])?)\s*([<>=!~]*)\s*(.*)$", line).groups()
        out.append((name, relation, version.strip()))
    return out


def command_output(command: Sequence[str], seconds: float = 15) -> str:
    """The first line that a program prints, or "not available"."""
    try:
        done = subprocess.run(list(command), capture_output=True, text=True, timeout=seconds, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return "not available"
    said = (done.stdout or done.stderr).strip().splitlines()
    return said[0] if said else "not available"


def session_manifest(spark: SparkSession, packages: Iterable[str] = ("pyspark", "pyarrow", "pandas", "numpy")) -> DataFrame:
    """Rows (name, version): Python, Spark, Java and installed packages."""
    rows = [("python", platform.python_version()), ("spark", spark.version), ("java", spark.sparkContext._jvm.System.getProperty("java.version"))]
    for p in packages:
        try:
            rows.append((p, metadata.version(p)))
        except metadata.PackageNotFoundError:
            rows.append((p, "not installed"))
    return spark.createDataFrame(rows, "name string, version string")


def stage_logger(name: str, file: str | Path) -> logging.Logger:
    """A logger to the screen and to a file; asked for again it's the same, with one handler of each."""
    log = logging.getLogger(f"marula.{name}")
    if not log.handlers:
        log.setLevel(logging.INFO)
        Path(file).parent.mkdir(parents=True, exist_ok=True)
        for h in (logging.StreamHandler(), logging.FileHandler(file, encoding="utf-8")):
            h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
            log.addHandler(h)
    return log


def archive_or_restore(file: str | Path, archive: str | Path) -> str:
    """The original of a file that is to be rewritten: archived at the first run, restored from there at later ones."""
    file, archive = Path(file), Path(archive)
    if archive.exists():
        shutil.copyfile(archive, file)
    else:
        archive.parent.mkdir(parents=True, exist_ok=True)
        shutil.copyfile(file, archive)
    return file.read_text(encoding="utf-8")


def expected_files(names: Iterable[str], folder: str | Path) -> list[tuple[str, bool]]:
    """Each name with whether the folder has such a file."""
    return [(n, (Path(folder) / n).is_file()) for n in names]


def query_file(goal: int, first: int | None = None, last: int | None = None) -> str:
    """The name of the file with a goal's query, whole or of a range of years."""
    return f"SDG{goal:02d}_full.txt" if first is None or last is None else f"SDG{goal:02d}_full_{first}-{last}.txt"


def report(title: str, sections: Sequence[tuple[str, DataFrame | str]]) -> str:
    """A text of titled sections, each a paragraph or a small table."""
    parts = [f"# {title}"]
    for name, body in sections:
        parts += [f"## {name}", body if isinstance(body, str) else markdown_table(body)]
    return "\n\n".join(parts) + "\n"
