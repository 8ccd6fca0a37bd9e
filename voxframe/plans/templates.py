"""Files of configurations: the built-in standard set, and YAML or JSON files of a folder."""

from __future__ import annotations

from pathlib import Path

from voxframe.plans.config import Config, Configs, standard


def list_files(folder: str) -> list[str]:
    """Names of the template files of a folder, sorted."""
    return sorted(p.name for p in Path(folder).iterdir() if p.suffix in (".yaml", ".yml", ".json"))


def load_file(path: str) -> dict[str, Config]:
    return Configs.load(path).by_name


def standard_templates() -> dict[str, Config]:
    return standard()


def all_templates(folder: str | None = None) -> dict[str, Config]:
    """The standard set and, over it, those of a folder's files in the order of their names."""
    out = standard()
    for name in list_files(folder) if folder else []:
        out |= load_file(str(Path(folder) / name))
    return out


def metadata_of(path: str) -> dict:
    """What a template file says besides its configurations, and their names."""
    import json

    import yaml

    text = Path(path).read_text()
    data = json.loads(text) if path.endswith(".json") else yaml.safe_load(text)
    return {k: v for k, v in data.items() if k != "configs"} | {"config_names": list(data.get("configs", {}))}
