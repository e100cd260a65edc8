"""Pluggable models: embedders, judges and summarisers by name, and offline stand-ins for tests."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from dataclasses import dataclass

Embedder = Callable[[list[str]], list[list[float]]]
KINDS = ("embedder", "judge", "summariser")


@dataclass(frozen=True)
class Provider:
    """What makes the models of one provider from options; one that has no model of a kind leaves it out."""

    name: str
    embedder: Callable[..., Embedder] | None = None
    judge: Callable[..., Callable[[str], dict]] | None = None
    summariser: Callable[..., Callable[[str], dict]] | None = None
    needs: tuple[str, ...] = ()


_providers: dict[str, Provider] = {}


def register(provider: Provider) -> None:
    """Known by its name from now on; a later one of the same name replaces it."""
    _providers[provider.name] = provider


def providers(kind: str | None = None) -> list[str]:
    """Names of all providers, or of those that have a kind of model."""
    return sorted(n for n, p in _providers.items() if kind is None or getattr(p, kind) is not None)


def model(kind: str, name: str, **options):
    """A provider's embedder, judge or summariser. Fails for an unknown provider, a kind it lacks, or options it needs."""
    if kind not in KINDS:
        raise ValueError(f"not a kind of model: {kind!r}")
    if name not in _providers:
        raise LookupError(f"no provider {name!r}; known: {providers()}")
    provider = _providers[name]
    make = getattr(provider, kind)
    if make is None:
        raise LookupError(f"{name} has no {kind}; these have: {providers(kind)}")
    if lacking := [n for n in provider.needs if not options.get(n)]:
        raise ValueError(f"{name} needs {lacking}")
    return make(**options)


def embedder(name: str, **options) -> Embedder:
    return model("embedder", name, **options)


def hashing_embedder(size: int = 64) -> Embedder:
    """Deterministic vectors of word hashes: equal words point the same way. No network."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            vector = [0.0] * size
            for word in text.lower().split():
                h = hashlib.blake2b(word.encode(), digest_size=8).digest()
                vector[int.from_bytes(h[:4], "big") % size] += 1.0 if h[4] & 1 else -1.0
            out.append(vector)
        return out

    return embed


register(Provider("hashing", embedder=hashing_embedder))


def with_retries(call: Callable, retries: int = 3, first_delay: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call`` again after 1, 2 and 4 seconds while it fails for too many requests (429); other errors come at once."""

    def run(*args, **kwargs):
        for attempt in range(retries + 1):
            try:
                return call(*args, **kwargs)
            except Exception as error:
                if "429" not in str(error) or attempt == retries:
                    raise
                sleep(first_delay * 2**attempt)

    return run
