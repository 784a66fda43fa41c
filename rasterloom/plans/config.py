"""Settings of a registration run, checked when they are made; JSON and YAML files are read by section."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

# The choices that each setting has.
METHODS = {
    "illumination": ("phase_congruency", "clahe", "gradient", "lnms"),
    "detection": ("sift", "superpoint"),
    "matching": ("bf", "lightglue", "loftr"),
    "outlier": ("ransac", "magsac++", "lmeds"),
    "transform": ("affine", "projective"),
    "interpolation": ("nearest", "bilinear", "bicubic", "lanczos"),
    "device": ("auto", "cuda", "cpu"),
}


@dataclass(frozen=True)
class RegistrationConfig:
    illumination_method: str = "phase_congruency"
    pyramid_levels: int | None = None
    pyramid_scale_factor: float = 0.5
    detection_method: str = "sift"
    max_keypoints: int = 8192
    matching_method: str = "bf"
    match_threshold: float = 0.2
    lowe_ratio: float = 0.75
    outlier_method: str = "magsac++"
    ransac_confidence: float = 0.999
    ransac_max_iters: int = 10_000
    transform_type: str | None = None
    refine_subpixel: bool = True
    refinement_patch_size: int = 21
    full_res_refine: bool = True
    interpolation: str = "bicubic"
    device: str = "auto"

    def __post_init__(self):
        chosen = {"illumination": self.illumination_method, "detection": self.detection_method, "matching": self.matching_method, "outlier": self.outlier_method, "interpolation": self.interpolation, "device": self.device}
        if self.transform_type is not None:
            chosen["transform"] = self.transform_type
        for kind, value in chosen.items():
            if value not in METHODS[kind]:
                raise ValueError(f"{kind}: {value!r} is none of {', '.join(METHODS[kind])}")
        rules = {
            "pyramid_levels": self.pyramid_levels is None or self.pyramid_levels >= 1,
            "pyramid_scale_factor": 0 < self.pyramid_scale_factor < 1,
            "max_keypoints": self.max_keypoints > 0,
            "match_threshold": 0 <= self.match_threshold <= 1,
            "lowe_ratio": 0 < self.lowe_ratio <= 1,
            "ransac_confidence": 0 < self.ransac_confidence < 1,
            "ransac_max_iters": self.ransac_max_iters > 0,
            "refinement_patch_size": self.refinement_patch_size > 0 and self.refinement_patch_size % 2 == 1,
            "full_res_refine": isinstance(self.full_res_refine, bool),
        }
        for name, ok in rules.items():
            if not ok:
                raise ValueError(f"{name}: {getattr(self, name)!r} is out of range")


@dataclass(frozen=True)
class WebConfig:
    """Read and kept for whoever serves results; nothing here listens."""

    host: str = "0.0.0.0"
    port: int = 8000
    upload_max_size_mb: int = 500
    results_dir: str = "./results"
    cors_origins: list[str] = field(default_factory=lambda: ["*"])


@dataclass(frozen=True)
class StorageConfig:
    upload_dir: str = "./uploads"
    results_dir: str = "./results"
    export_dir: str = "./exports"


@dataclass(frozen=True)
class AppConfig:
    pipeline: RegistrationConfig = field(default_factory=RegistrationConfig)
    web: WebConfig = field(default_factory=WebConfig)
    storage: StorageConfig = field(default_factory=StorageConfig)

    @classmethod
    def load(cls, path: str) -> AppConfig:
        """From a JSON file, or a YAML file where PyYAML is installed, with the sections pipeline, web and storage; missing or empty sections and settings have their defaults, unknown ones are an error."""
        with open(path, encoding="utf-8") as f:
            if path.lower().endswith((".yaml", ".yml")):
                try:
                    import yaml
                except ImportError as e:
                    raise ValueError("YAML settings need PyYAML; JSON ones don't") from e
                given = yaml.safe_load(f) or {}
            else:
                given = json.load(f)
        kinds = {"pipeline": RegistrationConfig, "web": WebConfig, "storage": StorageConfig}
        for section in given:
            if section not in kinds:
                raise ValueError(f"unknown section {section!r}")
            known = {x.name for x in fields(kinds[section])}
            if unknown := set(given[section] or {}) - known:
                raise ValueError(f"{section}: unknown settings {', '.join(sorted(unknown))}")
        return cls(**{k: kinds[k](**(v or {})) for k, v in given.items()})


def preset(text: str) -> tuple[str, str]:
    """``detector:matcher`` as two settings."""
    detector, _, matcher = text.partition(":")
    if detector not in METHODS["detection"] or matcher not in METHODS["matching"]:
        raise ValueError(f"unknown preset {text!r}")
    return detector, matcher
