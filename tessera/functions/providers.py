"""Named providers of things that live outside (models, stores, readers of scores), chosen by name, alias, a model's name, or a dotted path."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module
from typing import Any


class Providers:
    """Factories of one kind. A factory takes options and returns what it provides."""

    def __init__(self, kind: str, infer: Callable[[str], str | None] = lambda name: None):
        self.kind, self.infer = kind, infer
        self.factories: dict[str, Callable[..., Any]] = {}

    def register(self, *names: str) -> Callable:
        def put(factory: Callable[..., Any]) -> Callable[..., Any]:
            for n in names:
                self.factories[n.lower()] = factory
            return factory

        return put

    def known(self) -> list[str]:
        return sorted(self.factories)

    def factory(self, name: str) -> Callable[..., Any]:
        found = self.factories.get(name.lower()) or self.factories.get((self.infer(name) or "").lower())
        if found is None and "." in name and "/" not in name:
            module, _, attribute = name.rpartition(".")
            try:
                found = getattr(import_module(module), attribute)
            except (ImportError, AttributeError) as e:
                raise ValueError(f"no {self.kind} {name!r}: {e}") from e
        if found is None:
            raise ValueError(f"unknown {self.kind} {name!r}; known: {', '.join(self.known())}, or a dotted path")
        return found

    def make(self, name: str, **options: Any) -> Any:
        return self.factory(name)(**options)

    def of(self, settings: dict[str, Any], name: str | None = None, **options: Any) -> Any:
        """By a table of named settings: {"default": name, "models": {name: {"provider": ..., options}}}; options given here win."""
        name = name or settings.get("default")
        if name is None:
            raise ValueError(f"no {self.kind} named and no default")
        chosen = dict(settings.get("models", {}).get(name, {}))
        return self.make(chosen.pop("provider", name), **{**chosen, **options})


def _client(kind: str, name: str) -> Callable[..., Any]:
    """A provider that needs a client of the user's own: a function in the form that the operators call."""

    def make(client: Callable[..., Any] | None = None, **options: Any) -> Callable[..., Any]:
        if client is None:
            raise ValueError(f"{kind} {name!r} needs a client=, a function; none comes with this library")
        return (lambda *a: client(*a, **options)) if options else client

    return make


def _hash_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    from tessera.sources.stores import hash_embedding

    return lambda texts: [hash_embedding(t, dim) for t in texts]


def _embedder_of(model: str) -> str | None:
    low = model.lower()
    if "openai" in low or low.startswith("text-embedding"):
        return "openai"
    return "huggingface" if "huggingface" in low or "/" in low else None


#: Embedders: texts -> vectors.
EMBEDDERS = Providers("embedder", _embedder_of)
EMBEDDERS.register("hash", "fake", "mock")(_hash_embedder)
#: Scorers of (queries, documents) -> raw scores, for reranking.
SCORERS = Providers("scorer")
#: Text generators: prompts -> answers.
GENERATORS = Providers("generator")
for _name in ("openai", "huggingface", "google", "cohere"):
    EMBEDDERS.register(_name)(_client("embedder", _name))
for _name in ("cohere", "cross-encoder"):
    SCORERS.register(_name)(_client("scorer", _name))
for _name in ("openai", "anthropic", "google", "huggingface"):
    GENERATORS.register(_name)(_client("generator", _name))


def backend(store: Any) -> str:
    """Which kind of vector store an object (or what it wraps) is, by the names of its class and module."""
    inner = getattr(store, "_store", store)
    names = f"{type(inner).__module__}.{type(inner).__name__}".lower()
    return next((k for k in ("chroma", "faiss", "pinecone", "weaviate", "tessera") if k in names), "generic")
