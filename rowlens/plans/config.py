"""Options of a comparison."""

from __future__ import annotations

from dataclasses import dataclass


class DiffError(RuntimeError):
    """The comparison cannot be done as asked."""


@dataclass(frozen=True)
class Options:
    key: tuple[str, ...] | None = None
    keyless: bool = False
    tol_abs: float | None = None
    tol_rel: float | None = None
    fail_fast: int | None = None
    samples: int = 10
    assume_sorted: bool = False
    where: str | None = None
    # Accepted without effect: memory and spill places are settings of the cluster.
    memory_mb: int = 256
    spill_dir: str | None = None

    @property
    def tolerant(self) -> bool:
        return self.tol_abs is not None or self.tol_rel is not None

    def check(self) -> None:
        """Conflicts that can be told from the options alone."""
        if self.keyless:
            if self.key:
                raise DiffError("--keyless and --key are mutually exclusive")
            if self.tolerant:
                raise DiffError("float tolerances are not supported in keyless mode (rows are matched by exact content)")
            if self.assume_sorted:
                raise DiffError("--assume-sorted requires a key (keyless mode does not follow file order)")
        elif self.assume_sorted and not self.key:
            raise DiffError("--assume-sorted requires an explicit --key")
