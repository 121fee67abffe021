"""Scalar derivations as Column expressions: everything stays in generated JVM code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..enums import INTERACTION, OTHER_RANK, PROCESS, SEMANTIC, SEMANTIC_RANK, SUBPROCESS

SPEED_OF_LIGHT = 299.792458  # mm / ns
NEAR_PARENT = 1e-4


def _first(cases: list[tuple[Column, int]], other: Column | int) -> Column:
    chain = F
    for when, value in cases:
        chain = chain.when(when, F.lit(value))
    return chain.otherwise(other if isinstance(other, Column) else F.lit(other))


def interaction_type(primary: Column, pdg: Column, parent_pdg: Column, process: Column, subprocess: Column, parent_distance: Column, ke: Column, threshold: float = 0.05) -> Column:
    """The interaction type code of a track; the first rule that fits. ``parent_distance``: between the starts of track and parent, -1 without a parent. NaN energies are above any threshold; null inputs fit no rule."""
    electron = F.abs(pdg) == 11
    em = electron & (process == PROCESS["electromagnetic"])
    ion = em & (subprocess == SUBPROCESS["ionization"])
    near = electron & (process == PROCESS["hadronic"]) & (subprocess == SUBPROCESS["hadron_151"]) & (parent_distance < NEAR_PARENT)
    soft = ke < threshold
    t = INTERACTION
    return _first(
        [
            (primary, t["primary"]), (pdg == 2112, t["neutron"]), (pdg > 1_000_000_000, t["nucleus"]), (pdg == 22, t["photon"]),
            (em & (subprocess == SUBPROCESS["photoelectric"]), t["photoelectron"]), (em & (subprocess == SUBPROCESS["compton"]), t["compton"]),
            (em & subprocess.isin(SUBPROCESS["conversion"], SUBPROCESS["pair_production"]), t["conversion"]),
            (ion & (F.abs(parent_pdg) == 22), t["ionization"]), (ion & F.abs(parent_pdg).isin(211, 13, 2212, 321), t["delta"]), (ion, t["ionization"]), (em, t["invalid"]),
            (electron & (process == PROCESS["decay"]), t["decay"]), (near & soft, t["ionization"]), (near, t["decay"]), (electron & soft, t["compton"]), (electron, t["other_shower"]), (~electron, t["track"]),
        ],
        t["invalid"],
    )


def semantic_type(kind: Column, pdg: Column, parent_pdg: Column, extent: Column, least: int, strict: bool = True) -> Column:
    """The semantic type code. Tracks and deltas of exactly ``least`` cells are large, showers and nuclei of that extent are small. Photon-like kinds of other than electrons and photons, and unknown or null kinds, are errors; not ``strict``: unknown."""
    t, s = INTERACTION, SEMANTIC
    light = F.abs(pdg).isin(11, 22)
    small = extent < least
    large = extent > least
    le = F.lit(s["le_scatter"])
    wrong = F.lit(s["unknown"]) if not strict else F.raise_error(F.concat(F.lit("no semantic type for interaction type "), kind.cast("string"), F.lit(", pdg "), pdg.cast("string"))).cast("int")
    return (
        F.when(kind == t["invalid"], s["unknown"])
        .when(kind == t["track"], F.when(small, le).otherwise(s["track"]))
        .when(kind == t["primary"], F.when(light, s["shower"]).otherwise(s["track"]))
        .when(kind == t["delta"], F.when(small, le).otherwise(s["delta"]))
        .when(kind == t["decay"], F.when((F.abs(pdg) == 11) & (F.abs(parent_pdg) == 13), s["michel"]).when(light, s["shower"]).otherwise(s["track"]))
        .when(kind.isin(t["neutron"], t["ionization"], t["photoelectron"]), le)
        .when(kind.isin(t["photon"], t["conversion"], t["compton"], t["other_shower"]) & light, F.when(large, s["shower"]).otherwise(le))
        .when(kind == t["nucleus"], F.when(large, s["track"]).otherwise(le))
        .otherwise(wrong)
    )


def semantic_rank(sem_type: Column) -> Column:
    """Rank in a contested voxel; null and unknown codes come last."""
    return _first([(sem_type == code, rank) for code, rank in SEMANTIC_RANK.items()], OTHER_RANK)


def cell(v: Column, size: float, origin: float | Column = 0.0) -> Column:
    """The index of the cell that holds a coordinate; floors, also below 0."""
    return F.floor((v.cast("double") - origin) / size)


def centre(index: Column, size: float, origin: float | Column = 0.0) -> Column:
    return ((index + 0.5) * size + origin).cast("float")


def drift_position(py: Column, pz: Column, tick: Column, geometry: dict[str, Column]) -> tuple[Column, Column, Column]:
    """x, y, z of a readout pixel and tick. geometry: anode_x, drift_dir, velocity, time_step, reference_tick, y_min, z_min, pitch_y, pitch_z."""
    g = geometry
    x = g["anode_x"] - g["drift_dir"] * (tick - g["reference_tick"]) * g["velocity"] * g["time_step"]
    return x, g["y_min"] + (py + 0.5) * g["pitch_y"], g["z_min"] + (pz + 0.5) * g["pitch_z"]


def outside(x: Column, low: Column, high: Column) -> Column:
    """Beyond either end; the ends are inside."""
    return (x < low) | (x > high)


def wanted_tick(x: Column, t0: Column, geometry: dict[str, Column]) -> Column:
    """The tick at which a deposit would be read out."""
    g = geometry
    return g["reference_tick"] + (F.abs(x - g["anode_x"]) / g["velocity"] + t0) / g["time_step"]


def time_shift(t0: Column, geometry: dict[str, Column]) -> Column:
    """How far a deposit's apparent x lies from its own."""
    return geometry["drift_dir"] * t0 * geometry["velocity"]


def step_end(sign: int, x: Column, y: Column, z: Column, t: Column, theta: Column, phi: Column, p: Column, dx: Column, mass: Column) -> Column:
    """Where and with what momentum a step begins (-1) or ends (+1): struct x, y, z, t, px, py, pz, e. A step that has no speed takes no time."""
    x, y, z, t, theta, phi, p, dx, mass = (c.cast("double") for c in (x, y, z, t, theta, phi, p, dx, mass))
    d = (F.sin(theta) * F.cos(phi), F.sin(theta) * F.sin(phi), F.cos(theta))
    e = F.sqrt(p * p + mass * mass)
    beta = F.when(e > 0, p / e).otherwise(0.0)
    dt = F.when(beta > 0, 0.5 * dx / (beta * SPEED_OF_LIGHT)).otherwise(0.0)
    at = [(c + sign * 0.5 * dx * u).alias(n) for n, c, u in zip("xyz", (x, y, z), d)]
    return F.struct(*at, (t + sign * dt).alias("t"), *((p * u).alias(f"p{n}") for n, u in zip("xyz", d)), e.alias("e"))


def pixel_key(py: Column, pz: Column, tick: Column) -> Column:
    """One BIGINT for a pixel and tick: 21 bits each, biased, so that negative ones sort first."""
    biased = [c.cast("bigint") + (1 << 20) for c in (py, pz, tick)]
    return reduce(lambda a, b: F.shiftleft(a, 21).bitwiseOR(b), biased)


def entry_charge(peak: Column, fraction: Column, bits: int, signed: bool, absolute: bool = False) -> Column:
    """A hit's charge from its group's peak and its stored fraction (i16: of 32767, u16: of 65535)."""
    peak = F.abs(peak) if absolute else peak
    return peak.cast("double") * fraction / float((1 << (bits - 1)) - 1 if signed else (1 << bits) - 1)


def rounded_mantissa(v: Column, bits: int) -> Column:
    """A DOUBLE column of float values rounded to the nearest with ``bits`` bits of mantissa; NaN and infinities stay.

    Done as v / ulp * ulp with a power of two, exactly, in the JVM; halves go to even, as a float's own rounding does.
    """
    d = v.cast("double")
    ulp = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(d))) - bits)
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")) | (d == 0), d).otherwise(F.rint(d / ulp) * ulp)
