"""Settings of a selection run, resolved and checked once."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class SelectionConfig:
    """Sizes of a sharded, paged, two-stage selection."""

    total_samples: int = 100_000
    page_size: int = 2_000
    sample_size: int = 256
    local_size: int = 1_000
    final_size: int = 10_000
    shards: int = 4
    start_id: int | None = None
    id_column: str = "id"
    vector_column: str = "embedding"
    notes: tuple[str, ...] = field(default=(), compare=False)

    @property
    def stride(self) -> int:
        return self.page_size // self.sample_size

    @property
    def page_rows(self) -> int:
        """Rows that one page consumes: whole strides, so it may exceed the page size."""
        return -(-self.page_size // self.stride) * self.stride

    @property
    def kept_per_page(self) -> int:
        return -(-self.page_size // self.stride)

    @property
    def pages_per_shard(self) -> int:
        return self.total_samples // self.shards // self.page_size

    def resolved(self) -> "SelectionConfig":
        """The settings with the total rounded down to whole pages of all shards.

        Raises one ValueError that lists every mistake; warns where the final pass
        would prune nothing or the local passes are too small for a sound bound.
        """
        wrong = [f"{n} must be at least 1" for n in ("total_samples", "page_size", "sample_size", "local_size", "final_size", "shards") if getattr(self, n) < 1]
        if not wrong:
            if self.sample_size > self.page_size:
                wrong.append(f"sample_size ({self.sample_size}) must be at most page_size ({self.page_size})")
            if self.total_samples // self.shards < self.page_size:
                wrong.append(f"rows of a shard ({self.total_samples // self.shards}) must be at least page_size ({self.page_size})")
            if self.final_size > self.total_samples:
                wrong.append(f"final_size ({self.final_size}) must be at most total_samples ({self.total_samples})")
        if wrong:
            raise ValueError("; ".join(wrong))
        unit = self.shards * self.page_size
        notes = []
        if self.total_samples % unit:
            notes.append(f"total_samples rounded down to a multiple of {unit}")
        if self.final_size >= self.shards * self.local_size:
            notes.append("the final pass prunes nothing: final_size is not below shards * local_size")
        if self.local_size < self.final_size:
            notes.append("local_size is below final_size: the two-round bound does not hold")
        for note in notes:
            warnings.warn(note, stacklevel=2)
        return replace(self, total_samples=self.total_samples // unit * unit, notes=tuple(notes))
