"""What to sketch: algorithm, parameters and hash, with their legal ranges."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from tallymark.functions.hashing import HashChoice, resolve_hash
from tallymark.functions.labels import ALGORITHM_NAMES, PUBLIC_ALGORITHMS, algorithm_id

# Parameter domains and defaults.
HLLPP_K = range(4, 19)
HLL_K = range(4, 17)
WORD_L = 32
PC_L = range(1, 32)
DEFAULT_K = 16
DEFAULT_PC_L = 16
DEFAULT_STRATEGY = "direct"


@dataclass(frozen=True)
class SketchSpec:
    """One sketch configuration.

    ``k`` is the precision of the register algorithms, ``l`` the word length of LogLog and
    HyperLogLog (always 32) or the bitmap length of Probabilistic Counting.
    """

    algo: str
    k: int | None = None
    l: int | None = None  # noqa: E741
    hash: HashChoice = field(default_factory=resolve_hash)

    def __post_init__(self) -> None:
        object.__setattr__(self, "algo", algorithm_id(self.algo))
        if self.algo == "pc":
            if self.k is not None:
                raise ValueError("Probabilistic Counting has no k")
            if self.l is None:
                object.__setattr__(self, "l", DEFAULT_PC_L)
            if self.l not in PC_L:
                raise ValueError("Probabilistic Counting needs L in [1, 31]")
        elif self.algo in ("hll", "ll"):
            if self.k is None:
                object.__setattr__(self, "k", DEFAULT_K)
            if self.l is None:
                object.__setattr__(self, "l", WORD_L)
            if self.k not in HLL_K or self.l != WORD_L:
                raise ValueError(f"{ALGORITHM_NAMES[self.algo]} needs k in [4, 16] and L = 32")
        elif self.algo == "hllpp":
            if self.k is None:
                object.__setattr__(self, "k", DEFAULT_K)
            if self.l is not None:
                raise ValueError("HyperLogLog++ has no L")
            if self.k not in HLLPP_K:
                raise ValueError("HyperLogLog++ needs k in [4, 18]")
        elif self.k is not None or self.l is not None:
            raise ValueError("the exact counter has no parameters")

    @property
    def params(self) -> str:
        parts = []
        if self.k is not None:
            parts.append(f"k={self.k}")
        if self.l is not None:
            parts.append(f"L={self.l}")
        return ",".join(parts)

    @property
    def name(self) -> str:
        return ALGORITHM_NAMES[self.algo]


def sketch(
    algo: str,
    k: int | None = None,
    l: int | None = None,  # noqa: E741
    hash: str | None = None,
    seed: int | None = None,
) -> SketchSpec:
    """Shorthand for a :class:`SketchSpec` with the hash looked up by name."""
    return SketchSpec(algo, k, l, resolve_hash(hash, seed))


def requested_algorithms(ids: Iterable[str]) -> list[str]:
    """Algorithm ids to run; ``all`` stands for every public one."""
    wanted = [i.strip().lower() for i in ids]
    if "all" in wanted:
        return list(PUBLIC_ALGORITHMS)
    chosen = {algorithm_id(i) for i in wanted}
    return [a for a in PUBLIC_ALGORITHMS if a in chosen]


def sweep_specs(
    algorithms: Sequence[str] = ("all",),
    hashes: Sequence[HashChoice] | None = None,
    ks: Sequence[int] | None = None,
    ls: Sequence[int] | None = None,
) -> list[SketchSpec]:
    """The full parameter sweep of the chosen algorithms, or of chosen parameter lists."""
    specs = []
    for algo, choice in itertools.product(
        requested_algorithms(algorithms), hashes or [resolve_hash()]
    ):
        if algo == "pc":
            specs += [SketchSpec("pc", None, l, choice) for l in (ls or PC_L)]
            continue
        domain = HLLPP_K if algo == "hllpp" else HLL_K
        specs += [SketchSpec(algo, k, None, choice) for k in (ks or domain) if k in domain]
    return specs
