"""Which files a run reads, and what must agree between them. Driver-side, before any plan is made."""

from __future__ import annotations

from collections.abc import Sequence
from glob import glob

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolved(paths: Sequence[str] | str, others: dict[str, Sequence[str] | str | None]) -> list[dict[str, str | None]]:
    """One dict per input. Every role has as many paths as the first, or one that all share, or none."""
    first = [paths] if isinstance(paths, str) else list(paths)
    if not first:
        raise ValueError("no input files")
    lists = {}
    for role, p in others.items():
        given = [None] if p is None else [p] if isinstance(p, str) else list(p)
        if len(given) not in (1, len(first)):
            raise ValueError(f"{role}: {len(given)} files for {len(first)} inputs")
        lists[role] = given * len(first) if len(given) == 1 else given
    return [{"events": f, **{r: p[i] for r, p in lists.items()}} for i, f in enumerate(first)]


def production(root: str, batch: str = "*") -> dict[str, list[str]]:
    """The step, hits and sensor files of a production directory, each in order."""
    return {kind: sorted(glob(f"{root}/{kind}/*{batch}*")) for kind in ("step", "hits", "sensor")}


def readout_type(config: dict) -> str:
    """``wire`` unless the file says otherwise; unknown types are refused."""
    kind = str(config.get("readout_type", "wire")).strip().lower()
    if kind not in ("wire", "pixel"):
        raise ValueError(f"readout type {kind!r}")
    return kind


def same_batch(a: dict, b: dict, attributes: Sequence[str]) -> None:
    wrong = [k for k in attributes if k in a and k in b and a[k] != b[k]]
    if wrong:
        raise ValueError(f"files of different batches: {', '.join(wrong)}")


#: Names that a step's columns go by.
ALIASES = {"t": ("t", "time"), "de": ("de", "e", "energy"), "dx": ("dx",), "x": ("x",), "y": ("y",), "z": ("z",)}


def step_columns(df: DataFrame) -> tuple[list[Column], list[str]]:
    """x, y, z, t, de, dx as floats by the first alias that is there, and which optional ones are missing (0 then); a missing coordinate is an error."""
    out, missing = [], []
    have = {c.lower(): c for c in df.columns}
    for name, names in ALIASES.items():
        hit = next((have[a] for a in names if a in have), None)
        if hit is None and name in "xyz":
            raise ValueError(f"steps have no {name}")
        if hit is None:
            missing.append(name)
        out.append((F.lit(0.0) if hit is None else F.col(hit)).cast("float").alias(name))
    return out, missing
