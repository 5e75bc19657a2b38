"""Parameters of the sketches. They travel with a sketch, so that unlike sketches fail to compare."""

from __future__ import annotations

from dataclasses import dataclass


class Params:
    """alike: the fields in which two sketches must agree to be compared."""

    alike: tuple[str, ...] = ()

    def check(self, other: Params) -> None:
        if type(self) is not type(other):
            raise ValueError("sketches are of different kinds")
        unlike = [f for f in self.alike if getattr(self, f) != getattr(other, f)]
        if unlike:
            raise ValueError(f"sketches differ in {', '.join(unlike)}")


@dataclass(frozen=True)
class MinHashParams(Params):
    alike = ("k", "seed", "canonical")

    k: int = 21
    size: int = 1000
    seed: int = 42
    canonical: bool = True
    min_copies: int = 1

    def __post_init__(self):
        if self.k < 1 or self.size < 1 or self.min_copies < 1:
            raise ValueError("k, size and min_copies must be at least 1")


@dataclass(frozen=True)
class HllParams(Params):
    """drop_last leaves out a sequence's last k-mer, as the original estimator does."""

    alike = ("p", "k", "seed", "canonical", "drop_last")

    p: int = 12
    k: int = 32
    seed: int = 42
    canonical: bool = True
    drop_last: bool = True

    def __post_init__(self):
        if not 4 <= self.p <= 24:
            raise ValueError("p must lie in 4..24")


@dataclass(frozen=True)
class WeightedParams(Params):
    """Concept drift is accepted for compatibility; it has no effect on a sketch."""

    alike = ("k", "size", "window", "seed")

    k: int = 21
    size: int = 50
    window: int = 20
    seed: int = 1
    decay: float = 0.0

    def __post_init__(self):
        if not 1 <= self.k <= 31 or not 1 <= self.window <= 256:
            raise ValueError("k must lie in 1..31, window in 1..256")
        if not 0 <= self.decay <= 1:
            raise ValueError("decay must lie in 0..1")

    @property
    def bins(self) -> int:
        return self.k**4


@dataclass(frozen=True)
class OrderParams(Params):
    alike = ("k", "l", "seed")

    k: int = 21
    l: int = 2  # noqa: E741
    m: int = 500
    seed: int = 32
    reverse: bool = False

    def __post_init__(self):
        if not 1 <= self.k <= 31:
            raise ValueError("k must lie in 1..31")
        if self.l < 0 or self.m < 1:
            raise ValueError("l must not be negative, m at least 1")
