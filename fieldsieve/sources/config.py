"""Settings of a run: criteria, prompt template, limits from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from ..operators.analysis import NEED_CATEGORIES

LISTS = ("direct_fit", "partner_fit", "strategic_interest", "out_of_scope")
PLACEHOLDER = "{{CATEGORY_OPTIONS}}"


def criteria(text: str) -> dict[str, list[str]]:
    """The four lists of a criteria document; unknown keys, empty lists and blank entries are errors."""
    import yaml

    doc = yaml.safe_load(text)
    if not isinstance(doc, dict) or doc.get("version") != 1 or set(doc) - {"version", "name", "notes", *LISTS}:
        raise ValueError("criteria have version 1, a name, four lists and notes")
    for name in LISTS:
        if not isinstance(doc.get(name), list) or not doc[name] or any(not isinstance(x, str) or not x.strip() for x in doc[name]):
            raise ValueError(f"{name}: a list of texts that aren't blank")
    return {name: [x.strip() for x in doc[name]] for name in LISTS}


def prompt(template: str) -> str:
    """The template with the category options put in."""
    if PLACEHOLDER not in template:
        raise ValueError(f"the template needs {PLACEHOLDER}")
    return template.replace(PLACEHOLDER, "\n".join(f"- {c}" for c in NEED_CATEGORIES))


def bounded_int(value: str | None, default: int, least: int, most: int) -> int:
    if value is None or not value.strip():
        return default
    if not value.strip().isascii() or not value.strip().isdigit() or not least <= int(value) <= most:
        raise ValueError(f"{value!r} is no whole number from {least} to {most}")
    return int(value)


@dataclass(frozen=True)
class Limits:
    """Characters that are sent to an analyzer."""

    html: int = 30_000
    pdf_total: int = 50_000
    per_pdf: int = 20_000
    max_pdfs: int = 3

    @classmethod
    def of(cls, env: Mapping[str, str] = os.environ, prefix: str = "AI_INPUT_") -> "Limits":
        return cls(**{f.name: bounded_int(env.get(prefix + f.name.upper()), f.default, 1, 10_000_000) for f in fields(cls)})
