"""Binning and distributions: supports with atoms, moments, histograms, tails, discrete scores."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.functions.shared import value_counts, written


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins from least to greatest; the last includes its end."""
    ends = df.agg(F.min(column).alias("_a"), F.max(column).alias("_b"))
    place = F.coalesce(F.try_divide(F.col(column) - F.col("_a"), F.col("_b") - F.col("_a")), F.lit(0.0))
    found = df.join(F.broadcast(ends)).withColumn("bin", F.least(F.floor(place * bins), F.lit(bins - 1)).cast("int"))
    return found.groupBy("bin").agg(F.count("*").alias("n"))


def bin_of(x: Column, atoms: tuple[float, ...], edges: tuple[float, ...]) -> Column:
    """Atoms first, by equality; else the number of lower edges at or below, after the atoms."""
    below = sum(((x >= e).cast("int") for e in edges), F.lit(0))
    found = F.lit(len(atoms)) + below
    for k, a in reversed(list(enumerate(atoms))):
        found = F.when(x == a, k).otherwise(found)
    return found.cast("int")


def binned(df: DataFrame, column: str, atoms: tuple[float, ...], edges: tuple[float, ...]) -> DataFrame:
    finite = ~F.isnan(column) & (F.abs(column) < float("inf"))
    return df.where(finite).withColumn("bin", bin_of(F.col(column), atoms, edges))


def moments(binned: DataFrame, column: str) -> DataFrame:
    """Mass, mean and second moment of each bin."""
    mean, second = F.avg(column), F.avg(F.col(column) * F.col(column))
    found = binned.groupBy("bin").agg(F.count("*").alias("n"), mean.alias("mean"), F.greatest(second, mean * mean).alias("second"))
    return found.withColumn("mass", F.col("n") / F.sum("n").over(W.partitionBy()))


def fit_support(df: DataFrame, column: str, mandated: tuple[float, ...], bins: int, least_mass: float = 0.005, most_atoms: int = 8, clip: float = 1e-4) -> DataFrame:
    """Atoms (mandated values, and values with much mass) and equal-mass edges between them: (kind, at, mass).

    Values are counted and sorted by ranges, so no task has all of a continuous column's; the values heavy enough to be
    atoms, at most 1 / ``least_mass`` of them and the mandated ones, meet in one.
    """
    own = df.where(F.col(column).isNotNull() & ~F.isnan(column)).select(F.col(column).alias("x"))
    counts = value_counts(own, "x")
    total = counts.agg(F.sum("n").alias("_total"))  # one row
    shares = counts.join(F.broadcast(total)).withColumn("mass", F.col("n") / F.col("_total"))
    must = F.col("x").isin(*mandated) if mandated else F.lit(False)
    nth = F.row_number().over(W.orderBy((~must).cast("int"), F.desc("mass"), "x"))
    heavy = shares.where(must | (F.col("mass") >= least_mass)).withColumn("_k", nth).where(F.col("_k") <= most_atoms)
    atoms = written(heavy.select("x", "n", "below", "mass"), "atoms")
    # what stands below a value without the atoms' rows
    light = F.aggregate("_atoms", F.lit(0).cast("long"), lambda a, v: a + F.when(v["x"] < F.col("x"), v["n"]).otherwise(0))
    listed = atoms.agg(F.collect_list(F.struct("x", "n")).alias("_atoms"), F.coalesce(F.sum("n"), F.lit(0)).alias("_heavy"))  # one row of bounded size
    rest = shares.join(F.broadcast(atoms.select("x")), "x", "left_anti").join(F.broadcast(listed))
    upto = (F.col("below") - light + F.col("n")) / (F.col("_total") - F.col("_heavy"))
    ranked = rest.withColumn("_share", upto).where((F.col("_share") >= clip) & (F.col("_share") <= 1 - clip))
    free = F.lit(bins) - F.least(F.lit(most_atoms), F.lit(max(len(mandated), 1)))
    edges = ranked.groupBy(F.floor(F.col("_share") * free).alias("_slot")).agg(F.min("x").alias("at"), F.sum("mass").alias("mass"))
    named = atoms.select(F.lit("atom").alias("kind"), F.col("x").alias("at"), "mass")
    return named.unionByName(edges.select(F.lit("edge").alias("kind"), "at", "mass"))


def float_place(x: float) -> int:
    """The float's place among all 32-bit floats in ascending order, from 0 for 0.0 on."""
    bits = int(np.float32(x).view(np.int32))
    return bits if bits >= 0 else -1 - (bits & 0x7FFFFFFF)


def float_at(place: int) -> float:
    bits = place if place >= 0 else (-1 - place) | -0x80000000
    return float(np.array([bits], np.int32).view(np.float32)[0])


def shared_out(counts: list[int], total: int) -> list[int]:
    """``total`` places over segments: one each, the others by their counts with largest remainders, ties to the larger count."""
    if total < len(counts):
        raise ValueError(f"{total} bins are fewer than {len(counts)} segments")
    extra, whole = total - len(counts), sum(counts)
    if not whole:
        return [1 + extra, *[1] * (len(counts) - 1)]
    parts = [c / whole * extra for c in counts]
    out = [1 + int(p) for p in parts]
    order = sorted(range(len(counts)), key=lambda k: (int(parts[k]) - parts[k], -counts[k]))
    for k in order[: total - sum(out)]:
        out[k] += 1
    return out


def widened(edges: list[float], bins: int) -> list[float]:
    """``edges`` with the middle of the widest gap, in 32-bit floats, put in until there are ``bins`` of bins."""
    places = [float_place(e) for e in edges]
    while len(places) < bins + 1:
        gaps = [b - a for a, b in pairwise(places)]
        at = gaps.index(max(gaps))
        if gaps[at] < 2:
            raise ValueError(f"{edges[0]} to {edges[-1]} has no room for {bins} bins")
        places.insert(at + 1, (places[at] + places[at + 1]) // 2)
    return [float_at(k) for k in places]


def support_bins(
    df: DataFrame, column: str, mandated: tuple[float, ...] = (), bins: int = 128, least_mass: float = 0.005, most_atoms: int = 8, clip: float = 1e-4
) -> list[tuple[float, float]]:
    """(low, high) of each bin, ascending: an atom is a bin without width, the others lie between pins and meet.

    Atoms are the mandated values and the heaviest others with at least ``least_mass``.  Pins are the atoms, and the ranks
    ``clip`` and 1 - ``clip`` where these lie outside them.  A stretch between pins gets bins by its rows; their edges are
    values of equal mass, and where it has too few values, its widest gaps are halved.  Everything is in 32-bit floats.

    Values are counted and ranked by ranges; what reaches the driver are atoms, counts of stretches, and edges.  Rows that
    are null or not finite take no part; a column of one value gets its bins just above it; without values there are none.
    """
    x = F.col(column).cast("float").cast("double")
    own = df.select(x.alias("x")).where(~F.isnan("x") & (F.abs("x") < float("inf")))
    counts = value_counts(own, "x").withColumnsRenamed({"n": "rows", "below": "mass"})
    ranks = value_counts(counts.select("x"), "x").select("x", F.col("below").alias("nth"))
    values = written(counts.join(ranks, "x"), "values")
    total = values.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    if not total:
        return []
    low_rank, high_rank = (int(q * (total - 1) + 0.5) for q in (clip, 1 - clip))
    inside = lambda r: (F.col("mass") <= r) & (F.col("mass") + F.col("rows") > r)
    low, high = (values.where(inside(r)).first()["x"] for r in (low_rank, high_rank))
    fixed = [float(np.float32(m)) for m in mandated][:most_atoms]
    heavy = values.where((F.col("rows") >= least_mass * total) & ~F.col("x").isin(*fixed)) if fixed else values.where(F.col("rows") >= least_mass * total)
    atoms = sorted({*fixed, *(r.x for r in heavy.orderBy(F.desc("rows"), "x").limit(most_atoms - len(fixed)).collect())})
    ends = [e for e, out in ((low, not atoms or low < atoms[0]), (high, not atoms or high > atoms[-1])) if out]
    pins = sorted({*atoms, *ends})
    if len(pins) == 1:
        pins.append(float(np.float32(pins[0] + max(abs(pins[0]), 1.0) * 1e-3)))
    stretch = F.lit(None).cast("int")
    for k, (a, b) in enumerate(pairwise(pins)):
        stretch = F.when((F.col("x") > a) & (F.col("x") < b), k).otherwise(stretch)
    within = written(values.withColumn("part", stretch).where("part IS NOT NULL"), "stretches")
    found = within.groupBy("part").agg(F.sum("rows").alias("rows"), F.min("mass").alias("mass"), F.min("nth").alias("first"), F.max("nth").alias("last"))
    parts = {r.part: r for r in found.collect()}
    share = shared_out([parts[k].rows if k in parts else 0 for k in range(len(pins) - 1)], bins - len(atoms))
    # the k-th edge of a stretch is the first value up to which k of its shares lie; a value is met by few k
    sizes = F.create_map(*(F.lit(v) for k, r in parts.items() for v in (k, share[k]))) if parts else None
    wanted: dict[int, list[int]] = {}
    if parts:
        own_rows, own_mass = (F.create_map(*(F.lit(v) for k, r in parts.items() for v in (k, r[c]))) for c in ("rows", "mass"))
        each = within.withColumns({"_m": sizes[F.col("part")], "_all": own_rows[F.col("part")], "_upto": F.col("mass") + F.col("rows") - own_mass[F.col("part")]})
        k_low = F.greatest(F.floor((F.col("_upto") - F.col("rows")) * F.col("_m") / F.col("_all")) - 1, F.lit(1))
        k_high = F.least(F.ceil(F.col("_upto") * F.col("_m") / F.col("_all")) + 1, F.col("_m") - 1)
        aim = lambda k: F.ceil(k / F.col("_m") * F.col("_all"))
        ks = F.when(k_low <= k_high, F.filter(F.sequence(k_low, k_high), lambda k: (aim(k) <= F.col("_upto")) & (aim(k) > F.col("_upto") - F.col("rows"))))
        hits: dict[int, dict[int, int]] = {}
        for r in each.select("part", "nth", F.explode(ks).alias("k")).collect():
            hits.setdefault(r.part, {})[r.k] = r.nth - parts[r.part]["first"]
        for p, of in hits.items():
            first, last = int(pins[p] not in atoms), parts[p]["last"] - parts[p]["first"] - int(pins[p + 1] not in atoms)
            before, taken = first - 1, wanted.setdefault(p, [])
            for k in sorted(of):
                at = max(of[k], before + 1, first)
                if at > last:
                    break
                taken.append(at + parts[p]["first"])
                before = at
    numbers = sorted(k for of in wanted.values() for k in of)
    at = {r.nth: r.x for r in within.where(F.col("nth").isin(numbers)).select("nth", "x").collect()} if numbers else {}
    out = []
    for p, pin in enumerate(pins):
        if pin in atoms:
            out.append((pin, pin))
        if p < len(share):
            out += pairwise(widened([pin, *(at[k] for k in wanted.get(p, [])), pins[p + 1]], share[p]))
    return out


def tail_slopes(df: DataFrame, column: str, ks: tuple[int, ...]) -> DataFrame:
    """Log-log slopes between the upper order statistics of the given ranks."""
    top = df.orderBy(F.desc(column)).limit(max(ks))
    picked = top.withColumn("k", F.row_number().over(W.orderBy(F.desc(column)))).where(F.col("k").isin(*ks))
    a = picked.select(F.col("k").alias("k1"), F.col(column).alias("x1"))
    b = picked.select(F.col("k").alias("k2"), F.col(column).alias("x2"))
    slope = (F.ln("k2") - F.ln("k1")) / (F.ln("x2") - F.ln("x1"))
    return a.join(b, F.col("k1") < F.col("k2")).select("k1", "k2", slope.alias("slope"))


def pit(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Density of each bin of [0, 1] and the total variation from the uniform law."""
    found = df.groupBy(F.least(F.floor(F.col(column) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy())
    found = found.withColumn("density", share * bins).withColumn("_off", F.abs(share - 1 / bins))
    return found.withColumn("variation", F.sum("_off").over(W.partitionBy()) / 2).drop("_off")


def pmf_nll(pmf: Column, bin_: Column, floor: float = 1e-12) -> Column:
    """Negative log mass of the bin that came."""
    return -F.ln(F.greatest(F.get(pmf, bin_), F.lit(floor)))


def pmf_crps(pmf: Column, bin_: Column, widths: Column) -> Column:
    """Integral of (F - step) ** 2 over bins of the given widths."""
    start = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("v"), F.lit(0).alias("k"))
    step = lambda a, x: F.struct(
        (a["c"] + x["p"]).alias("c"),
        (a["v"] + F.pow(a["c"] + x["p"] - (a["k"] >= bin_).cast("double"), 2) * x["w"]).alias("v"),
        (a["k"] + 1).alias("k"),
    )
    return F.aggregate(F.zip_with(pmf, widths, lambda p, w: F.struct(p.alias("p"), w.alias("w"))), start, step, lambda a: a["v"])


def pmf_kl(p: Column, q: Column, floor: float = 1e-12) -> Column:
    parts = F.zip_with(p, q, lambda a, b: F.when(a > 0, a * F.ln(a / F.greatest(b, F.lit(floor)))).otherwise(0.0))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
