"""Settings with checked values, from a YAML file with environment variables."""

from __future__ import annotations

import math
import os
import re
import warnings
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

from shutterloom.functions.paths import template_errors


def _unit(v: Any) -> bool:
    return isinstance(v, float) and 0 < v < 1


def _positive(v: Any) -> bool:
    return isinstance(v, float) and math.isfinite(v) and v > 0


def _weight(v: Any) -> bool:
    return isinstance(v, float) and math.isfinite(v) and v >= 0


def _from(low: int, high: float = math.inf):
    return lambda v: isinstance(v, int) and low <= v <= high


class Checked:
    """Values that don't fit fall back to the default with a warning."""

    CHECKS: dict = {}

    def __post_init__(self) -> None:
        for f in fields(self):
            value, check = getattr(self, f.name), self.CHECKS.get(f.name)
            if isinstance(f.default, float) and isinstance(value, int) and not isinstance(value, bool):
                value = float(value)
                setattr(self, f.name, value)
            if check and not check(value):
                warnings.warn(f"{f.name} = {value!r} is out of range; {f.default!r} is used", stacklevel=3)
                setattr(self, f.name, f.default)


@dataclass
class Copy(Checked):
    timezone_offset_hours: int = 8
    unique_name_max_attempts: int = 10
    archive_template: str = "{year}/{month}/{valuable_name}"
    CHECKS = {"timezone_offset_hours": _from(-23, 23), "unique_name_max_attempts": _from(1), "archive_template": lambda v: isinstance(v, str) and template_errors(v) is None}


@dataclass
class Exif(Checked):
    valid_date_time_secs: int = 946_684_800
    CHECKS = {"valid_date_time_secs": _from(0)}


@dataclass
class Ocr(Checked):
    det_model_path: str = ""
    binarize_threshold: float = 0.3
    min_text_pixel_ratio: float = 0.005
    resize_max_side: int = 736
    CHECKS = {"binarize_threshold": _unit, "min_text_pixel_ratio": _unit, "resize_max_side": _from(64)}


@dataclass
class Face(Checked):
    scrfd_score_threshold: float = 0.5
    scrfd_nms_iou: float = 0.4
    phash_hamming_max: int = 10
    sharpness_min: float = 100.0
    face_cosine_min: float = 0.5
    ear_blink_max: float = 0.21
    eye_blink_score_max: float = 0.5
    eye_crop_radius_ratio: float = 0.10
    w_sharpness: float = 1.0
    w_blink: float = 2.0
    w_smile: float = 0.5
    max_image_bytes: int = 52_428_800
    scrfd_model_path: str = ""
    embed_model_path: str = ""
    mesh_model_path: str = ""
    eye_model_path: str = ""
    CHECKS = {
        **dict.fromkeys(("scrfd_score_threshold", "scrfd_nms_iou", "face_cosine_min", "ear_blink_max", "eye_blink_score_max", "eye_crop_radius_ratio"), _unit),
        **dict.fromkeys(("w_sharpness", "w_blink", "w_smile"), _weight),
        "phash_hamming_max": _from(1, 64),
        "sharpness_min": _positive,
        "max_image_bytes": _from(1 << 20),
    }


@dataclass
class Config:
    copy: Copy = field(default_factory=Copy)
    exif: Exif = field(default_factory=Exif)
    ocr: Ocr = field(default_factory=Ocr)
    face: Face = field(default_factory=Face)


def expanded(text: str, env: dict[str, str] | None = None, depth: int = 32) -> str:
    """``${NAME}`` and ``${NAME:-default}`` replaced, defaults included; control characters of values are
    left out, and what is nested deeper than ``depth`` stays."""
    env = dict(os.environ) if env is None else env
    out, at = [], 0
    while (start := text.find("${", at)) >= 0:
        level, end = 0, start
        while end < len(text):
            if text.startswith("${", end):
                level += 1
                end += 2
                continue
            if text[end] == "}":
                level -= 1
                if not level:
                    break
            end += 1
        if level or depth <= 0:
            break
        name, has_default, default = text[start + 2 : end].partition(":-")
        value = env.get(name, "")
        if not value and has_default:
            value = expanded(default, env, depth - 1)
        out += [text[at:start], re.sub(r"[\x00-\x1f\x7f]", "", value)]
        at = end + 1
    return "".join(out) + text[at:]


def loaded(text: str, env: dict[str, str] | None = None) -> Config:
    """Settings from YAML; unknown keys are ignored, and a text that can't be read gives the defaults."""
    import yaml

    try:
        values = yaml.safe_load(expanded(text, env)) or {}
        out = Config()
        for f in fields(out):
            part, own = values.get(f.name) or {}, getattr(out, f.name)
            if is_dataclass(own):
                known = {x.name for x in fields(own)}
                setattr(out, f.name, type(own)(**{k: v for k, v in part.items() if k in known}))
        return out
    except (yaml.YAMLError, AttributeError, TypeError):
        warnings.warn("the settings can't be read; defaults are used", stacklevel=2)
        return Config()
