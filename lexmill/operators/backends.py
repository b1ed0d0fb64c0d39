"""Models by name: each is a column function, made when asked for. Stand-ins are deterministic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Factory = Callable[..., Callable[..., Column]]
KINDS = ("transcriber", "verifier", "mos", "denoiser", "vad", "marker", "moderator", "synthesizer")
_made: dict[tuple[str, str], Factory] = {}


def register(kind: str, name: str) -> Callable[[Factory], Factory]:
    """A name is taken once."""
    if kind not in KINDS:
        raise ValueError(f"kinds: {', '.join(KINDS)}")

    def add(f: Factory) -> Factory:
        if (kind, name) in _made:
            raise ValueError(f"there is a {kind} {name} already")
        _made[kind, name] = f
        return f

    return add


def backend(kind: str, name: str, **options) -> Callable[..., Column]:
    if (kind, name) not in _made:
        raise ValueError(f"no {kind} {name}; there are {', '.join(names(kind)) or 'none'}")
    return _made[kind, name](**options)


def names(kind: str) -> list[str]:
    return sorted(n for k, n in _made if k == kind)


@register("denoiser", "noop")
def _unchanged() -> Callable[[Column], Column]:
    return lambda clip: clip


@register("transcriber", "constant")
def _constant(text: str = "") -> Callable[[Column], Column]:
    return lambda clip: F.when(clip.isNotNull(), text)


@register("verifier", "cosine")
def _cosine() -> Callable[[Column, Column], Column]:
    from lexmill.functions.columns import cosine

    return cosine


@register("verifier", "constant")
def _same(similarity: float = 0.9) -> Callable[[Column, Column], Column]:
    return lambda a, b: F.lit(similarity)
