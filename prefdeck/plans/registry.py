"""Names of scorers and judges. Users add their own; unknown names get the default scorer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.resource import ResourceProfile
from pyspark.sql import Column
from pyspark.sql import functions as F

from prefdeck.functions.text import ChatTemplate
from prefdeck.operators.scoring import Calls

SCORE, JUDGE = "score", "judge"


@dataclass(frozen=True)
class Predictor:
    """``implementation`` is a Column or a factory, ``calls`` and ``profile`` say how and where a factory's
    function is called, see ``operators.scoring``."""

    kind: str
    implementation: Column | Callable
    style: str = "bracket"
    template: str | ChatTemplate = "chatml"
    batch_size: int | None = None
    calls: Calls | None = None
    profile: ResourceProfile | None = None


class Registry:
    def __init__(self, default: Predictor | None = None) -> None:
        self._known: dict[str, Predictor] = {}
        self._default = default

    def register(self, name: str, predictor: Predictor) -> None:
        if predictor.kind not in (SCORE, JUDGE):
            raise ValueError(f"unknown predictor kind {predictor.kind!r}")
        self._known[name] = predictor

    def names(self) -> list[str]:
        return sorted(self._known)

    def get(self, name: str) -> Predictor:
        found = self._known.get(name, self._default)
        if found is None:
            raise KeyError(f"no predictor {name!r} and no default scorer")
        return found


def length_scorer() -> Predictor:
    """The default until a model is registered: longer answers score higher."""
    return Predictor(SCORE, F.length("output").cast("double"))


def default_registry() -> Registry:
    return Registry(default=length_scorer())
