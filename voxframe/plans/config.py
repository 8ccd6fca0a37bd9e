"""Configurations: ordered steps with parameters, their files, checks, and the plan of what they share."""

from __future__ import annotations

import hashlib
import json
import warnings
from dataclasses import dataclass, field
from pathlib import Path

from voxframe.plans import catalogue

# Steps and their parameters.
STEPS = {
    "resample": {"new_spacing", "interpolation", "mask_interpolation", "mask_threshold", "round_intensities"},
    "resegment": {"range_min", "range_max"},
    "filter_outliers": {"sigma"},
    "round_intensities": set(),
    "keep_largest_component": {"apply_to"},
    "binarize_mask": {"threshold", "mask_values", "apply_to"},
    "discretise": {"method", "n_bins", "bin_width", "min_val", "max_val", "cutoffs"},
    "filter": {"type", "boundary", "support", "sigma_mm", "truncate", "kernel", "kernels", "rotation_invariant", "pooling", "compute_energy", "energy_distance", "lambda_mm", "gamma", "theta", "delta_theta", "average_over_planes", "wavelet", "level", "decomposition", "variant", "order"},
    "extract_features": {"families", "include_spatial_intensity", "include_local_intensity", "ngldm_alpha", "ivh_use_continuous", "ivh_discretisation", "ivh_params"},
}
SOURCE_MODES = ("full_image", "roi_only", "auto")


@dataclass
class Config:
    """steps: list of {"step", "params"}; source_mode and sentinel_value say which voxels were measured."""

    steps: list[dict]
    source_mode: str = "full_image"
    sentinel_value: float | None = None
    warnings: list[str] = field(default_factory=list)
    signatures: dict[str, str] = field(default_factory=dict, repr=False, compare=False)  # of families, once computed

    def __post_init__(self) -> None:
        if self.source_mode not in SOURCE_MODES:
            raise ValueError(f"source_mode must be one of {SOURCE_MODES}")
        for s in self.steps:
            if s.get("step") not in STEPS:
                raise ValueError(f"no step {s.get('step')}")
            for p in s.get("params", {}):
                if p not in STEPS[s["step"]]:
                    self.warnings.append(f"{s['step']} has no parameter {p}")
            if s["step"] == "discretise" and s.get("params", {}).get("method", "FBN") not in ("FBN", "FBS", "FIXED_CUTOFFS"):
                raise ValueError(f"no discretisation {s['params']['method']}")

    @property
    def families(self) -> list[str]:
        out: list[str] = []
        for s in self.steps:
            if s["step"] == "extract_features":
                p = s.get("params", {})
                out += catalogue.expand(p.get("families", []), bool(p.get("include_spatial_intensity")), bool(p.get("include_local_intensity")))
        return list(dict.fromkeys(out))

    def to_dict(self) -> dict:
        steps = []
        for s in self.steps:
            p = {k: {"from": v[0], "to": v[1]} if k == "mask_values" and isinstance(v, tuple) and len(v) == 2 else v for k, v in s.get("params", {}).items()}
            steps.append({**s, "params": p} if "params" in s else s)
        return {"steps": json.loads(json.dumps(steps)), "source_mode": self.source_mode, "sentinel_value": self.sentinel_value}


def standard() -> dict[str, Config]:
    """The six standard configurations: 0.5 mm linear, fixed numbers or widths of bins of 8, 16 and 32."""
    out = {}
    for method, key in (("FBN", "n_bins"), ("FBS", "bin_width")):
        for n in (8, 16, 32):
            out[f"standard_{method.lower()}_{n}"] = Config([
                {"step": "resample", "params": {"new_spacing": [0.5, 0.5, 0.5], "interpolation": "linear"}},
                {"step": "discretise", "params": {"method": method, key: n}},
                {"step": "extract_features", "params": {"families": ["intensity", "morphology", "texture", "histogram", "ivh"]}},
            ])
    return out


class Configs:
    """Named configurations."""

    def __init__(self, load_standard: bool = True) -> None:
        self.by_name: dict[str, Config] = standard() if load_standard else {}

    def add(self, name: str, steps: list[dict], source_mode: str = "full_image", sentinel_value: float | None = None) -> Configs:
        self.by_name[name] = Config(steps, source_mode, sentinel_value)
        return self

    def get(self, name: str) -> Config:
        return self.by_name[name]

    def list(self) -> list[str]:
        return list(self.by_name)

    def remove(self, name: str) -> None:
        del self.by_name[name]

    def merge(self, other: Configs, overwrite: bool = False) -> Configs:
        """Takes over the other's configurations, with their source modes."""
        for k, c in other.by_name.items():
            if overwrite or k not in self.by_name:
                self.by_name[k] = c
        return self

    def resolve(self, names: list[str] | None = None) -> dict[str, Config]:
        """Names to configurations in order; all_standard stands for the sorted standard ones."""
        out: dict[str, Config] = {}
        for n in names or list(self.by_name):
            for k in sorted(x for x in self.by_name if x.startswith("standard_")) if n == "all_standard" else [n]:
                if k not in self.by_name:
                    raise ValueError(f"no configuration {k}")
                out[k] = self.by_name[k]
        return out

    def to_dict(self) -> dict:
        return {"version": VERSION, "configs": {k: c.to_dict() for k, c in self.by_name.items()}}

    @classmethod
    def from_dict(cls, data: dict) -> Configs:
        out = cls(load_standard=False)
        for k, c in migrated(data)["configs"].items():
            out.by_name[k] = Config(c["steps"], c.get("source_mode", "full_image"), c.get("sentinel_value"))
        return out

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2)

    @classmethod
    def from_json(cls, text: str) -> Configs:
        return cls.from_dict(json.loads(text))

    def to_yaml(self) -> str:
        import yaml

        return yaml.safe_dump(self.to_dict(), sort_keys=False)

    @classmethod
    def from_yaml(cls, text: str) -> Configs:
        import yaml

        return cls.from_dict(yaml.safe_load(text))

    def save(self, path: str) -> None:
        Path(path).write_text(self.to_json() if path.endswith(".json") else self.to_yaml())

    @classmethod
    def load(cls, path: str) -> Configs:
        text = Path(path).read_text()
        return cls.from_json(text) if path.endswith(".json") else cls.from_yaml(text)


@dataclass(frozen=True)
class Rules:
    """Which steps the values of each family depend on; a family that isn't named is never reused.

    `exact` steps are compared in their order with all parameters. With ivh_use_continuous, ivh doesn't read bins.
    """

    version: str
    reads: dict[str, frozenset[str]]

    def to_dict(self) -> dict:
        return {"version": self.version, "reads": {k: sorted(v) for k, v in self.reads.items()}}

    @classmethod
    def from_dict(cls, data: dict) -> Rules:
        return cls(data["version"], {k: frozenset(v) for k, v in data["reads"].items()})

    @classmethod
    def of(cls, version: str) -> Rules:
        if version not in RULES:
            raise ValueError(f"no rules of version {version}; there are {', '.join(RULES)}")
        return RULES[version]


_ALL = frozenset(STEPS) - {"extract_features"}
_RAW = _ALL - {"discretise"}
#: By version. All steps but bins count for families that read raw values: shape too reads intensities and so their mask.
RULES = {"1.0.0": Rules("1.0.0", {f: _RAW if f in ("intensity", "morphology", "spatial_intensity", "local_intensity") else _ALL for f in catalogue.FAMILIES})}
LATEST = "1.0.0"


def signature(config: Config, family: str, rules: Rules | None = None) -> str:
    """A digest of all that a family's values depend on: family, source mode, ordered steps before it, its parameters."""
    rules = rules or RULES[LATEST]
    key = f"{rules.version}:{family}"
    if key in config.signatures:
        return config.signatures[key]
    reads = rules.reads.get(family)
    steps, params = [], {}
    for s in config.steps:
        if s["step"] == "extract_features":
            params |= {k: v for k, v in s.get("params", {}).items() if k not in ("families", "include_spatial_intensity", "include_local_intensity")}
        elif reads is None or s["step"] in reads:
            steps.append(s)
    keep = {"ngldm": ("ngldm_alpha",), "ivh": ("ivh_use_continuous", "ivh_discretisation", "ivh_params")}.get(family, ())
    if family == "ivh" and params.get("ivh_use_continuous"):
        steps = [s for s in steps if s["step"] != "discretise"]
    own = "" if reads is not None else str(id(config))
    said = [family, config.source_mode, config.sentinel_value, steps, {k: params[k] for k in keep if k in params}, own]
    out = config.signatures[key] = hashlib.sha256(json.dumps(said, sort_keys=True, default=list).encode()).hexdigest()
    return out


@dataclass
class Plan:
    """What configurations share: (config, family, signature, the configuration it is reused from or None)."""

    rules: Rules
    entries: list[tuple[str, str, str, str | None]]

    @property
    def stats(self) -> dict[str, float]:
        """Reused and computed families, and the share reused; none where nothing is extracted."""
        reused = sum(e[3] is not None for e in self.entries)
        if not self.entries:
            return {}
        return {"reused_families": reused, "computed_families": len(self.entries) - reused, "cache_hit_rate": reused / len(self.entries)}

    def to_dict(self) -> dict:
        return {"rules": self.rules.to_dict(), "entries": [list(e) for e in self.entries]}


def deduplication(configs: dict[str, Config], rules: Rules | str | None = None) -> Plan:
    """The plan by which run() computes equal (family, signature) results of a volume once."""
    rules = Rules.of(rules) if isinstance(rules, str) else rules or RULES[LATEST]
    first: dict[tuple[str, str], str] = {}
    out: list[tuple[str, str, str, str | None]] = []
    for name, c in configs.items():
        for f in c.families:
            s = signature(c, f, rules)
            out.append((name, f, s, first.get((f, s))))
            first.setdefault((f, s), name)
    return Plan(rules, out)


def plan(configs: dict[str, Config]) -> list[tuple[str, str, str, bool]]:
    """(config, family, signature, reused): reused where an earlier configuration has the same family and signature."""
    return [(name, f, s, source is not None) for name, f, s, source in deduplication(configs).entries]


# Groups of families, and those that read bins.
GROUPS = {"intensity": "Intensity", "histogram": "Intensity", "ivh": "Intensity", "morphology": "Morphology", "local_intensity": "Morphology", "spatial_intensity": "Morphology", **dict.fromkeys(catalogue.TEXTURE, "Texture")}
NEED_BINS = {"histogram", "ivh", *catalogue.TEXTURE}


def described(configs: dict[str, Config]) -> list[tuple]:
    """One row for each configuration and feature: its names, its family, and the preprocessing of the configuration (DESCRIBED)."""
    out = []
    for name, c in configs.items():
        at = {s["step"]: s.get("params", {}) for s in c.steps}
        size, bins, kernel = at.get("resample"), at.get("discretise"), at.get("filter")
        spacing = size.get("new_spacing") if size is not None else None
        method = (bins or {}).get("method")
        number = (bins or {}).get({"FBN": "n_bins", "FBS": "bin_width"}.get(method, ""))
        rest = {k: v for k, v in (kernel or {}).items() if k not in ("type", "boundary")}
        meta = (
            bins is not None, method, float(number) if number is not None else None, size is not None, str(tuple(spacing)) if spacing is not None else None,
            size.get("interpolation", "linear") if size is not None else None, kernel is not None, (kernel or {}).get("type"), str(rest) if rest else None,
        )
        for f in c.families:
            for k in catalogue.FAMILIES[f]:
                plain, code = catalogue.parts(k)
                out.append((name, k, plain, code, f, GROUPS[f], f in NEED_BINS, *meta))
    return out


DESCRIBED = (
    "config string, feature_key string, feature_name string, ibsi_code string, family string, family_group string, requires_discretisation boolean, is_discretised boolean, discretisation_method string, "
    "discretisation_param double, is_resampled boolean, resampling_spacing string, interpolation string, is_filtered boolean, filter_type string, filter_params string"
)


def migrated(data: dict) -> dict:
    """A file's configurations in today's form. Versions before had plain lists of steps, and ranges as two-item lists."""
    version = data.get("version", data.get("schema_version", VERSION))
    if version not in (VERSION, str(VERSION), "1.0"):
        warnings.warn(f"schema version {version} is unknown; its configurations are read as they are", stacklevel=2)
    configs = {}
    for k, c in data.get("configs", {}).items():
        c = {"steps": c} if isinstance(c, list) else dict(c)
        steps = []
        for s in c["steps"]:
            p = dict(s.get("params", {}))
            if isinstance(p.get("mask_values"), dict):
                p["mask_values"] = (p["mask_values"]["from"], p["mask_values"]["to"])
            steps.append({**s, "params": p} if "params" in s else dict(s))
        configs[k] = {**c, "steps": steps}
    return {**data, "version": VERSION, "configs": configs}


VERSION = 1
