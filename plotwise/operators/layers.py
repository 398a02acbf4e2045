"""Map layers as tables: one styled row for each shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import MILE_METRES
from ..functions.ids import exclusion_flag
from .features import LAND_LIMIT, OPEN_SPACE_LIMIT

# Fixed values.
RANK_COLORS = ("#b3de69", "#80b1d3", "#bebada", "#fb8072", "#fdb462", "#8dd3c7", "#ccebc5", "#fccde5")
GREY, WHITE = "#bdbdbd", "#ffffff"
STRICT_COLORS = ("#0b3d91", "#2c7fb8", "#41b6c4", "#a1dab4", "#ffffbf", "#fdae61", "#d7191c")
STRICT_STEPS, RING_MAX_SCALE, DOT_MIN, DOT_MAX = 11, 2.0, 4.0, 12.0


def rank_color(rank: Column) -> Column:
    colors = F.array(*[F.lit(c) for c in RANK_COLORS])
    return F.when(rank > 0, F.element_at(colors, F.pmod(rank - 1, F.lit(len(RANK_COLORS))).cast("int") + 1)).otherwise(F.lit(GREY))


def inferred_land(unknown: Column) -> Column:
    """Land share, else from land and water area, else 0 where water dominates, else ``unknown``."""
    whole = F.col("aland") + F.col("awater")
    return F.coalesce("land_share", F.when(whole > 0, F.col("aland") / whole), F.when(F.col("water_share") > 1.0 - LAND_LIMIT, F.lit(0.0)), unknown)


def ranked_layer(df: DataFrame) -> DataFrame:
    """``area_id layer fill weight opacity`` from ``exclusion cluster cluster_rank`` and the share columns.

    Excluded areas are grey where there is land (or known open space), otherwise transparent; ranked areas have their
    rank's colour, anchors (cluster 0) a thicker line; areas with neither are left out.
    """
    out = exclusion_flag(F.col("exclusion")) != "no"
    land = inferred_land(F.when(out, F.lit(None).cast("double")).otherwise(F.lit(1.0)))
    clear = F.when(out & land.isNull(), F.coalesce("open_space_share", F.lit(0.0)) < OPEN_SPACE_LIMIT).otherwise(land < LAND_LIMIT)
    pick = lambda seen_out, seen, none: F.when(clear, F.lit(none)).when(out, F.lit(seen_out)).otherwise(seen)
    return df.where(out | F.col("cluster_rank").isNotNull()).select(
        "area_id", F.when(out, F.lit("excluded")).otherwise(F.lit("ranked")).alias("layer"), pick(GREY, rank_color(F.col("cluster_rank")), WHITE).alias("fill"),
        pick(0.4, F.when(F.col("cluster") == 0, F.lit(1.2)).otherwise(F.lit(0.25)), 0.0).alias("weight"), pick(0.6, F.lit(0.7), 0.0).alias("opacity"),
    )


def step_color(t: Column, colors: tuple[str, ...] = STRICT_COLORS, steps: int = STRICT_STEPS) -> Column:
    """Colour of t in [0, 1] on a scale of ``steps`` equal steps through ``colors``, as #rrggbb."""
    rgb = [[int(c[i : i + 2], 16) for i in (1, 3, 5)] for c in colors]
    table = []
    for k in range(steps):
        at = k / (steps - 1) * (len(colors) - 1)
        i = min(int(at), len(colors) - 2)
        table.append("#" + "".join(f"{round(a + (b - a) * (at - i)):02x}" for a, b in zip(rgb[i], rgb[i + 1], strict=True)))
    place = F.least(F.floor(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * steps), F.lit(steps - 1)).cast("int")
    return F.element_at(F.array(*[F.lit(c) for c in table]), place + 1)


def ladder_layer(areas: DataFrame, steps: int = 100) -> DataFrame:
    """``area_id ring_metres dot_radius color tooltip`` of the areas that the ladder kept."""
    frac = F.least(F.greatest(F.coalesce("ladder_freq", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    parts = [
        F.format_string("Earliest-T: %.2f", "t_first"), F.format_string("Last-T: %.2f", "t_last"), F.format_string(f"Ladder selections: %d / {steps} (%.0f%%)", "ladder_count", frac * 100),
        F.format_string("ring (mi): %.2f", "ring_med"), F.concat(F.lit("Businesses over regimes: "), F.format_number("pbus_sum", 0)),
    ]
    return areas.select(
        "area_id", F.when(F.col("ring_med") > 0, F.col("ring_med") * MILE_METRES * (1.0 + (RING_MAX_SCALE - 1.0) * frac)).alias("ring_metres"), (F.lit(DOT_MIN) + (DOT_MAX - DOT_MIN) * frac).alias("dot_radius"),
        step_color(F.col("t_first")).alias("color"), F.concat_ws("; ", F.concat(F.lit("Area: "), F.col("area_id")), *parts).alias("tooltip"),
    )


def html_map(layer: DataFrame, title: str, most_rows: int = 20_000) -> str:
    """A plain page that lists the layer's rows as JSON for a map script; layers are for people, so their size is checked."""
    import html
    import json

    rows = layer.limit(most_rows + 1).toPandas()
    if len(rows) > most_rows:
        raise ValueError(f"a page holds {most_rows} shapes")
    data = json.dumps(json.loads(rows.to_json(orient="records"))).replace("</", "<\\/")
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><script type='application/json' id='layer'>{data}</script>"
