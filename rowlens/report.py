"""The result of a comparison as Python values, JSON or text."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import asdict, dataclass, field

import numpy as np

from .plans.schema import SchemaDiff

# The wording of text reports, which scripts and readers rely on.
IDENTICAL = "identical"
RENAMED = "renamed, {:.0f}% content match"
KEYLESS = "none — keyless mode{} (rows matched by content; edits appear as - old / + new)"
AUTO = " [auto: no unique key column found]"
INFERRED = " (inferred)"
NO_ROWS = "no row differences"
MORE = "… {} more row difference(s) not shown (use --samples N)"
STOPPED = "(scan stopped early by --fail-fast; counts are lower bounds)"
NOTHING = "No differences found."


@dataclass
class Sample:
    row: list[tuple[str, str]]  # column and value
    count: int = 1


@dataclass
class ModifiedSample:
    key: list[tuple[str, str]]
    changes: list[tuple[str, str, str]]  # column, left, right


@dataclass
class Report:
    schema: SchemaDiff
    key: list[str]
    inferred: bool
    keyless: bool
    rows: tuple[int, int]
    added: int
    removed: int
    modified: int
    columns_changed: dict[str, int]
    added_samples: list[Sample] = field(default_factory=list)
    removed_samples: list[Sample] = field(default_factory=list)
    modified_samples: list[ModifiedSample] = field(default_factory=list)
    truncated: bool = False

    @property
    def has_differences(self) -> bool:
        return not self.schema.empty or self.added + self.removed + self.modified > 0

    def to_dict(self) -> dict:
        pairs = lambda row: [{"column": c, "value": v} for c, v in row]
        samples = lambda some: [{"row": pairs(s.row), "count": s.count} for s in some]
        schema = {k: v for k, v in asdict(self.schema).items() if k != "mutual"}
        return {
            "schema": schema,
            "key": {"columns": self.key, "inferred": self.inferred},
            "keyless": self.keyless,
            "rows": {"left": self.rows[0], "right": self.rows[1]},
            "diff": {"added": self.added, "removed": self.removed, "modified": self.modified},
            "columns_changed": dict(sorted(self.columns_changed.items())),
            "samples": {
                "added": samples(self.added_samples),
                "removed": samples(self.removed_samples),
                "modified": [{"key": pairs(m.key), "changes": [{"column": c, "left": a, "right": b} for c, a, b in m.changes]} for m in self.modified_samples],
            },
            "truncated": self.truncated,
        }

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2, ensure_ascii=False)

    def to_text(self, color: bool = False) -> str:
        paint = (lambda code, s: f"\x1b[{code}m{s}\x1b[0m") if color else (lambda code, s: s)
        green, red, yellow, bold = "32", "31", "33", "1"
        lines = [paint(bold, "Schema")]
        lines += ["  " + IDENTICAL] if self.schema.empty else []
        lines += ["  " + paint(green, f"+ {c.name} ({c.data_type})") for c in self.schema.added]
        lines += ["  " + paint(red, f"- {c.name} ({c.data_type})") for c in self.schema.removed]
        lines += ["  " + paint(yellow, f"~ {c.name}: {c.left} → {c.right}") for c in self.schema.type_changed]
        lines += ["  " + paint(yellow, f"~ {r.left} → {r.right} ({RENAMED.format(100 * r.similarity)})") for r in self.schema.renamed]
        if self.keyless:
            lines.append(f"{paint(bold, 'Key')}: " + KEYLESS.format(AUTO if self.inferred else ""))
        else:
            lines.append(f"{paint(bold, 'Key')}: {', '.join(self.key)}" + (INFERRED if self.inferred else ""))
        lines.append(f"{paint(bold, 'Rows')}: {self.rows[0]} → {self.rows[1]}")
        total = self.added + self.removed + self.modified
        if not total:
            lines.append("  " + NO_ROWS)
        else:
            changed = ", ".join(f"{k}: {v}" for k, v in sorted(self.columns_changed.items()))
            lines += ["  " + paint(green, f"+ {self.added} added"), "  " + paint(red, f"- {self.removed} removed"), "  " + paint(yellow, f"~ {self.modified} modified") + (f"  ({changed})" if changed else ""), ""]
            row = lambda r: ", ".join(f"{c}={v}" for c, v in r)
            lines += [f"{paint(yellow, '~ ' + row(m.key))}  " + ", ".join(f"{c}: {a} → {b}" for c, a, b in m.changes) for m in self.modified_samples]
            for code, mark, some in ((green, "+", self.added_samples), (red, "-", self.removed_samples)):
                lines += [paint(code, f"{mark} {row(s.row)}" + (f" ×{s.count}" if s.count > 1 else "")) for s in some]
            shown = len(self.modified_samples) + sum(s.count for s in self.added_samples + self.removed_samples)
            if total > shown:
                lines.append(MORE.format(total - shown))
        if self.truncated:
            lines.append(STOPPED)
        if not self.has_differences:
            lines += ["", NOTHING]
        return "\n".join(lines) + "\n"


def plain(value) -> str:
    """A cell as shown in a sample: the shortest digits that give a float back, never an exponent."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        if value != value:
            return "NaN"
        if value in (float("inf"), float("-inf")):
            return "inf" if value > 0 else "-inf"
        return np.format_float_positional(value, unique=True, trim="-")
    if isinstance(value, dt.datetime):
        text = value.strftime("%Y-%m-%dT%H:%M:%S")
        us = value.microsecond
        text += "" if not us else f".{us // 1000:03d}" if us % 1000 == 0 else f".{us:06d}"
        return text
    if isinstance(value, bytes | bytearray):
        return bytes(value).hex()
    if isinstance(value, list | tuple | dict):
        return json.dumps(value, default=plain, ensure_ascii=False)
    return str(value)


def quoted(value) -> str:
    """A cell as shown in a change: texts in quotes with escapes, other cells plain."""
    if value is None or isinstance(value, bool | int | float):
        return plain(value)
    escapes = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0"}
    return '"' + "".join(escapes.get(c, c if c.isprintable() else f"\\u{{{ord(c):x}}}") for c in plain(value)) + '"'
