"""Palettes by k-means, and restoring a picture on its grid with them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tidemark.staging import written

from .pixels import assign_cells, cell_color, color_bin, edge_gates, label_shares, oklab_bin, oklab_dist2, spatial_grid, to_oklab, tv_cleanup
from .refine import cell_vote, protected_mask, refine_ambiguous, relax_labels, saliency, whole_core, with_confidence
from .tiles import TILE

CHANNELS = ["r", "g", "b"]


def lloyd(points: np.ndarray, weight: np.ndarray, ks: Sequence[int], rounds: int, attempts: int, seed: int) -> list[tuple[np.ndarray, float]]:
    """For each k the centres of weighted points, and the mean squared distance to them: the best of several k-means++ starts.

    A start of fewer centres is the beginning of one of more, so all ks share them."""
    starts = [spread(points, weight, max(ks), seed + attempt) for attempt in range(attempts)]
    moved = [weight * points[:, c] for c in range(3)]
    found = []
    for k in ks:
        best, least = points[:1], np.inf
        for centres in (start[:k] for start in starts):
            for _ in range(rounds):
                near = nearest(points, centres)[0]
                total = np.bincount(near, weight, len(centres))
                sums = np.stack([np.bincount(near, m, len(centres)) for m in moved], 1)
                new = np.where(total[:, None] > 0, sums / np.maximum(total, 1e-12)[:, None], centres)
                step, centres = np.abs(new - centres).max(), new
                if step < 0.5:
                    break
            error = float((nearest(points, centres)[1] * weight).sum() / weight.sum())
            if error < least:
                best, least = centres, error
        found.append((best[np.lexsort(best.T[::-1])], least))
    return found


def spread(points: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The centres of a k-means++ start: fewer than k if all points are centres."""
    draws = np.random.default_rng(seed).random(k)
    chosen, far = [], np.ones(len(points))
    for draw in draws:
        mass = far * weight
        total = mass.sum()
        if chosen and not total > 0:
            break
        shares = (mass / total).cumsum()
        at = (shares / shares[-1]).searchsorted(draw, side="right")
        d = ((points - points[at]) ** 2).sum(1)
        far = np.minimum(far, d) if chosen else d
        chosen.append(at)
    return points[chosen]


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the nearest centre, the first of equals, and its squared distance."""
    d = sum(np.subtract.outer(points[:, c], centres[:, c]) ** 2 for c in range(3))
    at = d.argmin(1)
    return at, d[np.arange(len(points)), at]


def kmeans_palette(pixels: DataFrame, ks: Sequence[int] | DataFrame, rounds: int = 15, attempts: int = 3, seed: int = 42, least_alpha: int = 128) -> DataFrame:
    """(image_id, k, palette, rmse) for each image and each k: a list, or a table (image_id, k) such as adaptive_k's.

    All opaque pixels count. They are aggregated to 5-bit colour bins first, with their means and counts, so an image is
    at most 32,768 rows whatever its size; those are one group. Images without opaque pixels give no row. Same input, same palette."""
    bins = pixels.where(F.col("a") >= least_alpha).groupBy("image_id", color_bin(F.col("r"), F.col("g"), F.col("b"), 5).alias("bin"))
    means = bins.agg(F.count("*").cast("double").alias("n"), *[F.avg(c).alias(c) for c in CHANNELS], F.avg(sum((F.col(c) * F.col(c) for c in CHANNELS), F.lit(0.0))).alias("squares"))
    if isinstance(ks, DataFrame):
        asked = means.join(ks.groupBy("image_id").agg(F.sort_array(F.collect_set(F.col("k").cast("int"))).alias("ks_")), "image_id")
    else:
        asked = means.withColumn("ks_", F.array(*map(F.lit, sorted(set(ks)))))

    def fit(table: pa.Table) -> pa.Table:
        rows = {c: table.column(c).to_numpy()[table.column("bin").to_numpy().argsort()] for c in ("n", "squares", *CHANNELS)}
        points, weight, of = np.stack([rows[c] for c in CHANNELS], 1), rows["n"], table.column("ks_")[0].as_py()
        found = lloyd(points, weight, of, rounds, attempts, seed)
        # what lies inside the bins counts too
        inside = float(((rows["squares"] - (points**2).sum(1)) * weight).sum() / weight.sum())
        images = pa.concat_arrays([table.column("image_id")[:1].combine_chunks()] * len(of))
        palettes = pa.array([p.tolist() for p, _ in found], pa.list_(pa.list_(pa.float64())))
        return pa.Table.from_arrays([images, pa.array(of, pa.int32()), palettes, pa.array([max(0.0, e + inside) ** 0.5 for _, e in found])], names=["image_id", "k", "palette", "rmse"])

    kind = pixels.schema["image_id"].dataType.simpleString()
    return asked.groupBy("image_id").applyInArrow(fit, f"image_id {kind}, k int, palette array<array<double>>, rmse double")


def palette_labels(pixels: DataFrame, palettes: DataFrame) -> DataFrame:
    """J9 for palettes of an image's own: pixels with label, the place of the nearest colour (the first of equals). Pixels of images without palette go."""
    d = lambda p: sum(((F.col(c) - p[i]) * (F.col(c) - p[i]) for i, c in enumerate(CHANNELS)), F.lit(0.0))
    best: Column = F.array_min(F.transform("palette", lambda p, i: F.struct(d(p).alias("d"), i.alias("i"))))
    return pixels.join(palettes.select("image_id", "palette"), "image_id").withColumn("label", best["i"]).drop("palette")


def elbow_k(fits: DataFrame, share: float = 0.055) -> DataFrame:
    """Of fits (image_id, k, rmse) the k after which the error first falls by less than share of the first error; else the largest."""
    fit = F.array_sort(F.collect_list(F.struct("k", "rmse")))
    stop = lambda f, i: (i < F.size("fits") - 1) & (f["rmse"] - F.get("fits", i + 1)["rmse"] < share * F.greatest(F.get("fits", F.lit(0))["rmse"], F.lit(1e-9)))
    first = F.get(F.filter("fits", stop), F.lit(0))["k"]
    return fits.groupBy("image_id").agg(fit.alias("fits")).select("image_id", F.coalesce(first, F.element_at("fits", -1)["k"]).alias("k"))


def restore(pixels: DataFrame, palettes: DataFrame, step: float, offset: float = 0.0) -> DataFrame:
    """One pixel a cell (image_id, cx, cy, r, g, b, a), on a grid of `step` pixels; palettes as kmeans_palette gives them."""
    return restore_cells(assign_cells(palette_labels(pixels, palettes), step, offset))


def restore_grid(pixels: DataFrame, k: int, cols: int, rows: int, offset: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """I10 on a grid of cols x rows cells, of pixels with label (0 to k - 1)."""
    return restore_cells(spatial_grid(pixels, cols, rows, offset), k)


def restore_cells(pixels: DataFrame, k: int = 1) -> DataFrame:
    """I10 of pixels with label, cell and w: shares by place in the cell, gated relaxation, the best label, clean-up, and the mean
    colour of the winner's own pixels.

    Every stage is a join or an aggregation keyed by image and cell. What several stages read is a written table, so a
    plan is as long as one stage."""
    key = ["image_id", "cx", "cy"]
    own = written(pixels, "restore-pixels")
    shares, means = (written(x, "restore-cells") for x in label_shares(own, k))
    soft = relax_labels(shares, edge_gates(means))
    won = written(with_confidence(soft, key).join(means, key), "restore-labels")
    clean = written(tv_cleanup(won, soft), "restore-clean")
    return cell_color(own.withColumn("w", F.col("w") + 1e-4), clean)


def lab_palette(pixels: DataFrame, k: int = 32, rounds: int = 15, attempts: int = 3, seed: int = 42) -> DataFrame:
    """A24 in OKLab: (image_id, palette) of pixels (image_id, lab, weight), by k-means over the 32 x 32 x 32 bins' weighted means."""
    bins = pixels.groupBy("image_id", oklab_bin(F.col("lab")).alias("bin")).agg(F.sum("weight").alias("n"), *[(F.sum(F.col("weight") * F.col(f"lab.{c}")) / F.sum("weight")).alias(c) for c in "LAB"])

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin")
        # chroma weighs as in oklab_dist2, and the scale is that of bytes, on which lloyd's end is set
        scale = 255 * np.array([1.0, 1.8**0.5, 1.8**0.5])
        palette, _ = lloyd(rows[list("LAB")].to_numpy() * scale, rows["n"].to_numpy(), [k], rounds, attempts, seed)[0]
        return pd.DataFrame({"image_id": [rows["image_id"].iloc[0]], "palette": [[dict(zip("LAB", p)) for p in (palette / scale).tolist()]]})

    kind = pixels.schema["image_id"].dataType.simpleString()
    return bins.groupBy("image_id").applyInPandas(fit, f"image_id {kind}, palette array<struct<L:double,A:double,B:double>>")


def lab_labels(pixels: DataFrame, palettes: DataFrame, tile: int = TILE) -> DataFrame:
    """Pixels (with lab) and the place of the nearest palette colour as label, and confidence, 1 - sqrt(d1 / d2) of the two least distances.
    Pixels meet their palette in tiles. Those of images without palette go."""
    key = ["image_id", "tx_", "ty_"]
    placed = pixels.withColumns({"tx_": F.floor(F.col("x") / tile), "ty_": F.floor(F.col("y") / tile)})
    listed = placed.select(*key).distinct().join(palettes.select("image_id", "palette"), "image_id").toDF("of_", "of_tx_", "of_ty_", "palette")
    kept = [f for f in pixels.schema if f.name not in ("label", "confidence")]
    names = [f.name for f in kept]

    def run(rows: pa.Table, palette: pa.Table) -> pa.Table:
        colours = palette.column("palette")[0].as_py() if palette.num_rows else []
        rows = rows.select(names) if colours else rows.select(names).slice(0, 0)
        lab = rows.column("lab").combine_chunks()
        parts = [np.subtract.outer(lab.field(c).to_numpy(), np.array([p[c] for p in colours])) for c in "LAB"]
        d = parts[0] * parts[0] + 1.8 * (parts[1] * parts[1]) + 1.8 * (parts[2] * parts[2])
        label, sure = np.zeros(rows.num_rows, np.int32), np.ones(rows.num_rows)
        if len(colours) and rows.num_rows:
            label = d.argmin(1).astype(np.int32)
        if len(colours) > 1 and rows.num_rows:
            least = np.partition(d, 1, axis=1)
            sure = np.where(least[:, 1] <= 1e-9, 1.0, np.clip(1 - np.sqrt(least[:, 0] / np.maximum(least[:, 1], 1e-300)), 0.0, 1.0))
        return rows.append_column("label", pa.array(label)).append_column("confidence", pa.array(sure))

    schema = StructType([*kept, StructField("label", IntegerType()), StructField("confidence", DoubleType())])
    return placed.groupBy(*key).cogroup(listed.groupBy("of_", "of_tx_", "of_ty_")).applyInArrow(run, schema)


def advanced(pixels: DataFrame, cols: int, rows: int, offset: tuple[float, float] = (0.0, 0.0)) -> tuple[DataFrame, DataFrame]:
    """I11 after its palette: of pixels (image_id, x, y, r, g, b, a, rareness, label, confidence) the cells' colours as restore gives them, and
    (image_id, confident_ratio, protected_pixels). Small details are protected, pixels vote with their confidence, ambiguous
    cells are refined by their neighbours, and the winner's own pixels give the colour."""
    key = ["image_id", "cx", "cy"]
    grid = spatial_grid(pixels, cols, rows, offset)
    own = written(grid.join(protected_mask(pixels), ["image_id", "x", "y"]), "advanced-pixels")
    votes = written(cell_vote(own), "advanced-votes")
    refined = written(refine_ambiguous(votes, whole_core(own, cols, rows)).select(*key, "label"), "advanced-labels")
    sure = votes.groupBy("image_id").agg(F.avg(F.col("confident").cast("int")).alias("confident_ratio"))
    details = own.groupBy("image_id").agg(F.count_if("protected").alias("protected_pixels"))
    return cell_color(own.withColumn("w", F.col("w") + 1e-4), refined), sure.join(details, "image_id")


def restore_advanced(pixels: DataFrame, cols: int, rows: int, k: int = 32, offset: tuple[float, float] = (0.0, 0.0)) -> tuple[DataFrame, DataFrame]:
    """Saliency, a palette in OKLab weighted by it (k-means in place of box splitting), labels with confidence, then `advanced`."""
    seen = written(saliency(pixels).join(pixels, ["image_id", "x", "y"]).withColumn("lab", to_oklab(F.col("r"), F.col("g"), F.col("b"))), "advanced-saliency")
    labelled = written(lab_labels(seen, lab_palette(seen, k)), "advanced-labelled")
    return advanced(labelled, cols, rows, offset)
