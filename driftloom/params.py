"""Parameters of a run, with the defaults that the reference data were made with. Fixed values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    distance_threshold: float = 5.2
    min_pc_size: int = 5
    voxel_size: tuple[float, float, float] = (3.0, 3.0, 3.0)
    voxel_origin: tuple[float, float, float] | None = (-2160.0, -2160.0, -2160.0)
    defragment_sem_types: tuple[int, ...] = (1, 3, 4, 5)
    electron_energy_threshold: float = 0.05
    delta_min_standoff: float = 0.0
    rules: tuple[str, ...] = ("photon_decay", "combine_le", "absorb_le", "touching_em")
    max_passes: int = 10
    include_le: bool = True
    drop_le: bool = False
    traceable: bool = True

    @classmethod
    def pixel(cls) -> Params:
        return cls(distance_threshold=6.2, min_pc_size=63, delta_min_standoff=8.0)

    def extent_voxel(self) -> float | None:
        """The voxel size that measures a cloud's extent, None (count rows) where voxels are not cubes."""
        return self.voxel_size[0] if len(set(self.voxel_size)) == 1 else None
