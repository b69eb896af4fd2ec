"""Settings: defaults, a file's sections over them, and arguments over both."""

from __future__ import annotations

import json
from pathlib import Path

# The defaults of the parameters.
DEFAULTS = {
    "processing": {"segment_size": 10_000, "k": 31, "min_hits": 5, "min_score": 0.8, "max_gap": 1000},
    "curve": {"order": 20},
    "quality": {"min_length": 0, "max_unread_share": 1.0},
}


def load(path: str | None = None, **sections: dict) -> dict:
    """Each section is merged on its own, one level deep. JSON always works; YAML where a reader is installed."""
    given: dict = {}
    if path:
        text = Path(path).read_text()
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:
                raise RuntimeError("reading YAML needs the yaml module; JSON works without") from e
            given = yaml.safe_load(text) or {}
        else:
            given = json.loads(text)
    names = {*DEFAULTS, *given, *sections}
    return {n: {**DEFAULTS.get(n, {}), **given.get(n, {}), **sections.get(n, {})} for n in names}
