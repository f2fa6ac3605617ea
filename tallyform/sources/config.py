"""Settings of a run, from defaults and an environment mapping."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from tallyform.plans import catalog


@dataclass(frozen=True)
class Endpoint:
    base_url: str = ""
    model: str = ""
    api_key: str = ""


@dataclass(frozen=True)
class Settings:
    """Nested values use a double underscore: PREFIX_ENDPOINTS__NAME__BASE_URL."""

    allowed_providers: tuple[str, ...] = catalog.DEFAULT_PROVIDERS
    request_timeout_seconds: float = 60.0
    gpu_query_enabled: bool = True
    endpoints: Mapping[str, Endpoint] = field(default_factory=dict)

    def endpoint_for(self, provider: str) -> Endpoint:
        return self.endpoints.get(provider.strip().lower().replace("-", "_"), Endpoint())

    @classmethod
    def load(cls, environ: Mapping[str, str], prefix: str = "OCR_") -> Settings:
        """Known names under the prefix, in any case; lists are comma-separated; others are ignored."""
        given = {k[len(prefix) :].lower(): v for k, v in environ.items() if k.upper().startswith(prefix)}
        kinds = {f.name: type(f.default) for f in fields(cls) if f.name != "endpoints"}
        read = {tuple: lambda v: tuple(x.strip() for x in v.split(",") if x.strip()), float: float, bool: lambda v: v.strip().lower() in ("1", "true", "yes", "on")}
        out = {k: read[t](given[k]) for k, t in kinds.items() if k in given}
        nested: dict[str, dict[str, str]] = {}
        for k, v in given.items():
            if len(p := k.split("__")) == 3 and p[0] == "endpoints" and p[2] in {f.name for f in fields(Endpoint)}:
                nested.setdefault(p[1], {})[p[2]] = v
        return cls(**out, endpoints={k: Endpoint(**v) for k, v in nested.items()})
