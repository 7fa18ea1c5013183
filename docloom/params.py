"""All parameters, with the values that a running service uses."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Params:
    """Frozen settings; ``with_`` gives a changed copy, ``from_mapping`` coerces text values as environment settings are."""

    page_chars: int = 1800
    line_page_chars: int = 2000
    refs_min_lines: int = 5
    refs_ratio: float = 0.55
    refs_run: int = 2
    refs_tail: float = 0.6
    refs_early_pages: int = 3
    refs_min_chars: int = 5000
    child_words: int = 180
    child_overlap: int = 30
    parent_words: int = 500
    noise_min_chars: int = 110
    noise_digits: float = 0.30
    noise_marks: float = 0.28
    noise_short_line: int = 35
    noise_short_share: float = 0.7
    k1: float = 0.9
    b: float = 0.4
    k: int = 8
    per_doc: int = 1
    depth: int = 80
    rrf_depth: int = 60
    rrf_constant: int = 60
    snippet_chars: int = 4000
    context_chars: int = 4000
    context_text_chars: int = 800
    citations: int = 5
    rerank: bool = True
    rerank_top: int = 50
    homoglyphs: bool = True
    lossy_parents: bool = True

    def __post_init__(self):
        if not 0 <= self.child_overlap < self.child_words:
            raise ValueError("the overlap must be at least 0 and less than the window")

    def with_(self, **changes) -> Params:
        return replace(self, **changes)

    @classmethod
    def from_mapping(cls, values: dict[str, object]) -> Params:
        """Values by field name; what cannot be read as the field's type leaves the default."""
        out = {}
        for f in fields(cls):
            raw = values.get(f.name)
            if raw is None or raw == "":
                continue
            try:
                out[f.name] = truthy(raw) if isinstance(f.default, bool) else type(f.default)(str(raw))
            except ValueError:
                pass
        return cls(**out)


def truthy(value: object) -> bool:
    return str(value).strip().lower() in ("1", "true", "yes", "on", "y")


def merged(*layers: dict) -> dict:
    """Nested settings, the later layer winning at each leaf."""
    out: dict = {}
    for layer in layers:
        for key, value in (layer or {}).items():
            out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def lookup(settings: dict, *path: str, default=None):
    for key in path:
        if not isinstance(settings, dict) or key not in settings:
            return default
        settings = settings[key]
    return settings


def service_url(url: str | None, default: str) -> str:
    """A URL with one scheme and no trailing slash."""
    text = (url or "").strip().rstrip("/")
    if not text:
        return default
    while text.startswith(("http://http://", "https://https://", "http://https://", "https://http://")):
        text = text.partition("://")[2]
    return text if "://" in text else f"http://{text.lstrip('/')}"


# fixed values: settings of a running service by model
PRESETS = {
    "llama3.1:8b": {"num_ctx": 4096, "max_tokens": 600, "timeout_s": 150, "temperature": 0.2, "top_p": 0.95, "repeat_penalty": 1.05, "gpu_layers": -1, "keep_alive": "30m"},
    "llama3.1:70b": {"num_ctx": 8192, "max_tokens": 600, "timeout_s": 180, "temperature": 0.2, "top_p": 0.95, "repeat_penalty": 1.05, "gpu_layers": -1, "keep_alive": "30m"},
    "deepseek-r1:32b": {"num_ctx": 12288, "max_tokens": 1800, "timeout_s": 180, "temperature": 0.3, "top_p": 0.90, "repeat_penalty": 1.05, "gpu_layers": -1, "keep_alive": "60m"},
}


def preset(model: str, presets: dict | None = None) -> dict:
    """A copy of a model's settings, empty for a model that has none; ``presets`` replaces the fixed ones as a whole."""
    return dict((PRESETS if presets is None else presets).get(model, {}))
