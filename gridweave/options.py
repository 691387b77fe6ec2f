"""Options of the multilevel setup, with per-level overrides."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Generic, TypeVar

T = TypeVar("T")


@dataclass(frozen=True)
class PerLevel(Generic[T]):
    """A value for all levels, with other ones for some."""

    default: T
    overrides: dict[int, T] = field(default_factory=dict)

    def at(self, level: int) -> T:
        return self.overrides.get(level, self.default)


@dataclass(frozen=True)
class Options:
    """Defaults are those of scalar diffusion problems in 2D.

    crs_alg: "spw" (successive pairwise matching), "mis" or "plate_test"; prol_type: "piecewise", "aux_smoothed" or
    "semi_aux_smoothed"; mg_cycle: "V", "W" or "BS"; clev: "inv", "sm" or "none".
    """

    max_levels: int = 10
    max_coarse_size: int = 50
    min_coarse_size: int = 0
    first_aaf: float = 0.1
    aaf: float = 0.25
    aaf_scale: float = 1.0
    crs_alg: PerLevel[str] = PerLevel("spw")
    spw_rounds: PerLevel[int] = PerLevel(3)
    spw_pick_avg: PerLevel[str] = PerLevel("geom")
    spw_orphan_treatment: bool = True
    edge_thresh: float = 0.025
    vert_thresh: float = 0.0
    check_isolated_vertices: bool = True
    mis_dist2: PerLevel[bool] = PerLevel(False, {0: True})
    prol_type: PerLevel[str] = PerLevel("semi_aux_smoothed")
    sp_min_frac: PerLevel[float] = PerLevel(0.15)
    sp_max_per_row: PerLevel[int] = PerLevel(3)
    sp_max_per_row_classic: PerLevel[int] = PerLevel(5)
    sp_omega: PerLevel[float] = PerLevel(1.0)
    sp_improve_its: PerLevel[int] = PerLevel(0)
    mg_cycle: str = "V"
    clev: str = "inv"
    sm_type: PerLevel[str] = PerLevel("jacobi")
    sm_steps: int = 1
    sm_symm: bool = False
    energy: str = "alg"
    #: Matching rounds inside one pairing; most pairs are found in the first ones and orphans join a cluster after the last.
    handshakes: int = 3
    #: Levels of at most so many edges are clustered in numpy on the driver (a few MB); 0 turns it off.
    local_edges: int = 200_000
    #: Matrices of at most so many vertices are coarsened by blocks of rows (``plans.bulk``), with arrays over vertices in every task (some
    #: 100 bytes a vertex); 0 turns it off.
    held_vertices: int = 2_000_000
    #: Vertices that one task is meant to hold; levels are dealt over as many partitions as that takes.
    vertices_per_task: int = 250_000
    #: Whether coarse levels may be dealt over fewer tasks; then a step must leave less than ``crs_thresh`` of the vertices. Levels of at
    #: most ``seq_vertices`` are one task's, and tasks become fewer by ``task_factor`` at most in one step.
    redistribute: bool = True
    crs_thresh: float = 0.9
    seq_vertices: int = 1000
    task_factor: float = 0.25

    @classmethod
    def of(cls, **flags: object) -> Options:
        """From plain flags; a flag with the suffix ``_spec`` is a list of values for the levels from 0 on."""
        import dataclasses

        base = cls()
        known = {f.name for f in dataclasses.fields(cls)}
        out: dict[str, object] = {}
        for name, value in flags.items():
            key = name.removesuffix("_spec")
            if key not in known:
                raise ValueError(f"unknown option {name!r}")
            now = out.get(key, getattr(base, key))
            if name.endswith("_spec"):
                default = now.default if isinstance(now, PerLevel) else now
                out[key] = PerLevel(default, dict(enumerate(value)))  # type: ignore[arg-type]
            elif isinstance(now, PerLevel):
                out[key] = value if isinstance(value, PerLevel) else PerLevel(value, now.overrides if key not in flags else {})
            else:
                out[key] = value
        return dataclasses.replace(base, **out)
