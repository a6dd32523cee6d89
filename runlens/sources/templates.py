"""Prompt templates: small driver-side strings."""

from __future__ import annotations

from pathlib import Path

DEFAULT_TEMPLATE = """Repository: {repo_name}
Issue: {issue_title}

{issue_description}

Fix the issue above with a minimal change. The repository is at {base_path}.
"""


def load_template(path: str | None = None, default: str = DEFAULT_TEMPLATE) -> str:
    """The template file's text, or the default if no path is given or it does not exist."""
    if path:
        file = Path(path)
        if file.is_file():
            return file.read_text()
    return default
