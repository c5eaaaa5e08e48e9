"""The extension surface: plug-ins by kind and name.

=====================  =====================================================
kind                   a plug-in is called as
=====================  =====================================================
``preprocessor``       ``(documents) -> documents``, before projection
``postprocessor``      ``(records) -> records``, after it
``query_preprocessor`` ``(query, meta) -> query``
``query_analyzer``     ``(query) -> rules.Analyzed``
``query_factory``      ``(docs, tokens, terms) -> hits`` with ``score``, or none
``facet``              ``(facet values) -> facet``
``rescorer``           ``(query, custom parameters) -> ranking.Rescorer`` or none
``product_set``        ``(set, docs, ids taken) -> doc_id, pos``
``config``             ``(tenant, configuration) -> configuration``
=====================  =====================================================

A plug-in is a function, or a class whose objects can be called.  An object is made for
each configuration, gets its settings by ``initialize(settings)`` if it has that, and
preprocessors and postprocessors hear by ``finish(success)`` how an indexing ended."""

from __future__ import annotations

import logging
from collections.abc import Callable

LOG = logging.getLogger(__name__)

KINDS = ("preprocessor", "postprocessor", "query_preprocessor", "query_analyzer", "query_factory", "facet", "rescorer", "product_set", "config")


class Registry:
    """Functions ``Column -> Column`` or ``DataFrame -> DataFrame`` by kind and name.

    A name may be disabled; of two with one name, the preferred or the last counts."""

    def __init__(self, disabled: tuple[str, ...] = (), preferred: dict[str, str] | None = None):
        self.disabled, self.preferred = set(disabled), preferred or {}
        self._found: dict[tuple[str, str], dict[str, Callable]] = {}

    def add(self, kind: str, name: str, function: Callable, source: str = "") -> None:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind}")
        self._found.setdefault((kind, name), {})[source] = function

    def get(self, kind: str, name: str) -> Callable | None:
        some = {s: f for s, f in self._found.get((kind, name), {}).items() if s not in self.disabled and name not in self.disabled}
        return some.get(self.preferred.get(name, ""), next(reversed(some.values()), None)) if some else None

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self._found if k == kind and self.get(k, n) is not None)

    def configured(self, kind: str, names: list[str], settings: dict[str, dict] | None = None) -> dict[str, Callable]:
        """Plug-ins of these names, ready for use; one that is unknown or fails is left out."""
        ready = {}
        for name in names:
            plugin = self.get(kind, name)
            if plugin is None:
                LOG.error("no %s of the name %s", kind, name)
                continue
            try:
                if isinstance(plugin, type):
                    plugin = plugin()
                    if hasattr(plugin, "initialize"):
                        plugin.initialize((settings or {}).get(name, {}))
            except Exception:
                LOG.exception("%s %s can't be initialized", kind, name)
                continue
            ready[name] = plugin
        return ready
