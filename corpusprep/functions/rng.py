"""Deterministic randomness.

``uniform(tag, key, pos)`` replaces every ``torch.rand`` / ``random`` draw:
a value in [0, 1) that depends only on (seed, tag, keys), never on
partitioning, task order or retries — so a lost executor recomputes
exactly the same mask.

Two generators share one call site:

* ``portable`` — first 52 bits of ``md5(seed|tag|k1|k2…)``. DuckDB and
  other engines compute the same doubles, so every query built on it has
  an independent SQL oracle.
* ``fast`` — ``xxhash64`` (Spark built-in, codegen'd, ~5x cheaper). Use it
  in production feeds where an external oracle is not needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = float(2 ** 52)
TWO_53 = float(2 ** 53)
DEFAULT_SEED = 0


def _as_col(k) -> Column:
    return k if isinstance(k, Column) else F.col(k)


def uniform(tag: str, *keys, seed: int = DEFAULT_SEED, rng: str = "portable") -> Column:
    """Deterministic U[0,1) from integer or string key columns (integers of
    any width give the same value; never use floating-point keys)."""
    cols = [_as_col(k) for k in keys]
    if rng == "portable":
        text = F.concat_ws("|", F.lit(str(seed)), F.lit(tag), *[c.cast("string") for c in cols])
        bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
        return bits.cast("double") / F.lit(TWO_52)
    if rng == "fast":
        h = F.xxhash64(F.lit(seed), F.lit(tag), *[c.cast("string") for c in cols])
        return F.shiftrightunsigned(h, 11).cast("double") / F.lit(TWO_53)
    raise ValueError(f"unknown rng {rng!r}")


def gumbel(u: Column) -> Column:
    """Gumbel noise ``-ln(max(-ln(max(u,1e-20)),1e-20))``."""
    inner = -F.log(F.greatest(u, F.lit(1e-20)))
    return -F.log(F.greatest(inner, F.lit(1e-20)))


def normal(tag: str, *keys, seed: int = DEFAULT_SEED, rng: str = "portable") -> Column:
    """Standard normal by Box-Muller from two independent uniforms."""
    u1 = uniform(tag + ":bm1", *keys, seed=seed, rng=rng)
    u2 = uniform(tag + ":bm2", *keys, seed=seed, rng=rng)
    return F.sqrt(-2.0 * F.log(F.greatest(u1, F.lit(1e-20)))) * F.cos(2.0 * 3.141592653589793 * u2)
