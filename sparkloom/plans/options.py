"""Options of a run: command line, configuration file, and the defaults that depend on the input."""

from __future__ import annotations

import argparse
import json
import os
import re
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path
from urllib.parse import urlsplit

# Defaults and the sizes from which retrieval is offered and chosen.
MAX_PAGES, MAX_ARTIFACTS, MAX_DEPTH, CONTEXT = 20, 400, 3, 128_000
VERSION = "0.2.0"
RAG_OFFER, RAG_CHOOSE = 1_000_000, 2_000_000
LEAST_FOR_RETRIEVAL = max(RAG_OFFER, RAG_CHOOSE)
SUGGEST_BROWSER = re.compile("(login|auth|signin|signup|verify|captcha|challenge|mfa|2fa)", re.I)


class ConfigError(ValueError):
    """The configuration file is no JSON, or holds what it may not."""


@dataclass(frozen=True)
class Options:
    url: str | None = None
    output: str | None = None
    headless: bool = False
    local_rag: bool | None = None
    browser_assisted: bool | None = None
    model: str | None = None
    context_size: int = CONTEXT
    analysis_concurrency: int | None = None
    max_pages: int = MAX_PAGES
    max_artifacts: int = MAX_ARTIFACTS
    max_depth: int = MAX_DEPTH

    def __post_init__(self):
        if self.url is not None and urlsplit(self.url).scheme not in ("http", "https"):
            raise ConfigError("the URL must be http or https")
        if self.headless and self.url is None:
            raise ConfigError("a headless run needs a URL")
        for name, least in (("context_size", 1), ("max_pages", 1), ("max_artifacts", 1), ("max_depth", 0)):
            if getattr(self, name) < least:
                raise ConfigError(f"{name} must be at least {least}")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkloom", description="Analyse recorded front-end artifacts of a site.", allow_abbrev=False)
    p.add_argument("--version", "-v", action="version", version=VERSION)
    p.add_argument("--url", "-u", help="the entry page")
    p.add_argument("--output", help="folder of the run's files, or its report if it ends in .md")
    p.add_argument("--headless", action=argparse.BooleanOptionalAction)
    p.add_argument("--local-rag", action=argparse.BooleanOptionalAction)
    p.add_argument("--browser-assisted", action=argparse.BooleanOptionalAction)
    p.add_argument("--model")
    for name in ("--context-size", "--analysis-concurrency", "--max-pages", "--max-artifacts", "--max-depth"):
        p.add_argument(name, type=int)
    return p


def parse(argv: list[str], saved: dict | None = None) -> Options:
    """Flags over saved values over defaults; flags that are not given stay out of it."""
    given = {k: v for k, v in vars(parser().parse_args(argv)).items() if v is not None}
    return replace(Options(), **merge(saved or {}, given))


def resolved(given: dict, saved: dict | None = None) -> Options:
    """Given values over saved ones over defaults; what is None is not given."""
    return replace(Options(), **merge(saved or {}, given))


def merge(*layers: dict) -> dict:
    """Key by key, the last layer that has a value wins."""
    return {k: v for layer in layers for k, v in layer.items() if v is not None}


def read_config(path: str | Path) -> dict | None:
    """The saved options; none if there is no file."""
    try:
        found = json.loads(Path(path).read_text())
    except FileNotFoundError:
        return None
    except ValueError as why:
        raise ConfigError(f"{path} holds no JSON") from why
    if not isinstance(found, dict) or (unknown := set(found) - {f.name for f in fields(Options)}):
        raise ConfigError(f"{path} holds unknown keys: {sorted(unknown) if isinstance(found, dict) else found}")
    return found


def save_config(path: str | Path, options: Options) -> None:
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    with open(os.open(at, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w") as out:
        json.dump({k: v for k, v in asdict(options).items() if v is not None}, out, indent=2)


def retrieval_default(options: Options, total_bytes: int) -> bool:
    """Whether retrieval is on without asking; a question would be offered from RAG_OFFER on."""
    if options.local_rag is not None:
        return options.local_rag
    return not options.headless and total_bytes >= LEAST_FOR_RETRIEVAL


def browser_default(options: Options) -> bool:
    if options.browser_assisted is not None:
        return options.browser_assisted
    return not options.headless and bool(SUGGEST_BROWSER.search(options.url or ""))


def concurrency_default(options: Options, chunks: int) -> int:
    return options.analysis_concurrency or (1 if options.headless or chunks <= 1 else 2)


# Providers that are known by their address, and models whose sizes are known.
PRESETS = (
    {"id": "blackbox", "label": "BlackBox AI", "base_url": "https://api.blackbox.ai"},
    {"id": "nvidia-nim", "label": "Nvidia NIM", "base_url": "https://integrate.api.nvidia.com/v1"},
    {"id": "onlysq", "label": "OnlySQ", "base_url": "https://api.onlysq.ru/ai/openai", "models_url": "https://api.onlysq.ru/ai/models"},
)
CURATED = (
    {"id": "gpt-5.1-codex-max", "label": "ChatGPT Codex Max", "context": 400_000},
    {"id": "gpt-5.1-codex-mini", "label": "ChatGPT Codex Mini", "context": 200_000},
    {"id": "gpt-5.1-codex", "label": "GPT-5.1 Codex", "context": 400_000},
    {"id": "gpt-5-codex", "label": "GPT-5 Codex", "context": 400_000},
    {"id": "codex-mini-latest", "label": "codex-mini-latest", "context": 200_000},
)


def preset_for(base_url: str | None) -> dict | None:
    """The known provider of an address, whatever its case and slashes at the end."""
    return next((p for p in PRESETS if same_base_url(p["base_url"], base_url)), None)


def models_url(base_url: str) -> str:
    """Where a provider lists its models."""
    known = preset_for(base_url) or {}
    return known.get("models_url") or base_url.rstrip("/") + "/models"


# Names that a model's mode is told by.
def codex_mode(model: str) -> str | None:
    low = model.lower()
    return None if "codex" not in low else "fast" if "mini" in low else "reasoning"


def supports_mode(model: str) -> bool:
    return "codex" in model.lower() or bool(re.fullmatch(r"gpt-5(\.\d+)?", model.lower()))


def model_for_mode(model: str, mode: str) -> str:
    low = model.lower()
    if "gpt-5.1-codex" in low:
        return {"fast": "gpt-5.1-codex-mini"}.get(mode, "gpt-5.1-codex-max")
    return {"fast": "codex-mini-latest"}.get(mode, "gpt-5-codex") if "codex" in low else model


def reasoning_effort(mode: str | None) -> str | None:
    return {"fast": "low", "reasoning": "high"}.get(mode or "")


def same_base_url(a: str | None, b: str | None) -> bool:
    """Equal but for case of scheme and host and slashes at the end."""
    norm = lambda u: (p := urlsplit((u or "").strip().rstrip("/")))._replace(scheme=p.scheme.lower(), netloc=p.netloc.lower()).geturl()
    return bool(a) and norm(a) == norm(b)
