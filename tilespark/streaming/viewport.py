"""The viewer: which tiles at which level, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import Grid
from ..functions.lod import lod_for_radius
from ..functions.project import to_world
from ..schema import BUILDING_COLOR, FIT_PADDING, MOVE_SPEED, POI_COLOR, POI_RADIUS, PRELOAD_TILES, ROAD_CLASS, ROAD_COLOR, TERRAIN, TERRAIN_COLOR, VIEW_WIDTH_M, ZOOM_LERP, ZOOM_WHEEL


def scale_for_width(window: Column, view_m: Column) -> Column:
    return F.greatest(view_m / F.greatest(window, F.lit(1.0)), F.lit(0.0001))


def scale_for_radius(span: Column, radius_m: Column) -> Column:
    return F.greatest(radius_m * 2.0 / F.greatest(span, F.lit(1.0)), F.lit(0.0001))


def fit_scale(width: Column, height: Column, map_width: Column, map_height: Column, padding: float = FIT_PADDING) -> Column:
    one = F.lit(1.0)
    fit = F.greatest(F.greatest(map_width, one) / F.greatest(width, one), F.greatest(map_height, one) / F.greatest(height, one))
    return F.greatest(fit * max(padding, 1.0), F.lit(0.0001))


def viewer_start(index: DataFrame, windows: DataFrame) -> DataFrame:
    """Start position, scales and level for each window (width, height) over a one-row index with min_x, min_y, max_x,
    max_y and the array ``distances``."""
    rows = windows.crossJoin(F.broadcast(index))  # the index is one row
    span = F.greatest("width", "height")
    playable = scale_for_width(F.col("width"), F.lit(VIEW_WIDTH_M))
    full = fit_scale(F.col("width"), F.col("height"), F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    rows = rows.withColumn("min_scale", F.least(scale_for_radius(span, F.get("distances", F.lit(0)) * 0.5), playable))
    rows = rows.withColumn("max_scale", F.greatest(scale_for_radius(span, F.element_at("distances", -1)), full, F.col("min_scale")))
    rows = rows.withColumn("scale", F.least(F.greatest(playable, F.col("min_scale")), F.col("max_scale")))
    return rows.withColumns({"start_x": (F.col("min_x") + F.col("max_x")) * 0.5, "start_y": (F.col("min_y") + F.col("max_y")) * 0.5})


def with_view(cameras: DataFrame, grid: Grid, distances: list[float], width: float = 1280.0, height: float = 720.0, preload: int = PRELOAD_TILES) -> DataFrame:
    """Adds lod and visible (sorted tile ids) to rows with x, y and scale."""
    return cameras.withColumn("lod", lod_for_radius(F.col("scale") * max(width, height) * 0.5, distances)).withColumn(
        "visible", F.array_sort(grid.visible_ids(F.col("x"), F.col("y"), F.col("scale"), width, height, preload)))


def move_path(inputs: DataFrame, viewer: str, order: list[str]) -> DataFrame:
    """Positions after each input (dir_x, dir_y, dt): the direction at unit length times speed and time, summed up."""
    norm = F.sqrt(F.col("dir_x") * F.col("dir_x") + F.col("dir_y") * F.col("dir_y"))
    step = lambda c: F.when(norm > 0, F.col(c) / norm * MOVE_SPEED * F.col("dt")).otherwise(0.0)
    so_far = Window.partitionBy(viewer).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return inputs.withColumns({"x": F.sum(step("dir_x")).over(so_far), "y": F.sum(step("dir_y")).over(so_far)})


def zoom_fold(inputs: DataFrame, viewer: str, order: list[str], start: float, low: float, high: float) -> DataFrame:
    """(viewer, target_scale, scale, frames) after all inputs (scroll, dt) of a viewer, in order. The clamp at every frame
    makes this a fold, not a sum."""
    frames = F.sort_array(F.collect_list(F.struct(*order, "scroll", "dt")))
    begin = F.struct(F.lit(start).alias("target"), F.lit(start).alias("scale"))

    def step(state: Column, frame: Column) -> Column:
        zoomed = F.least(F.greatest(state["target"] * F.pow(F.lit(2.0), -frame["scroll"] * ZOOM_WHEEL), F.lit(low)), F.lit(high))
        target = F.when(F.abs(frame["scroll"]) <= 1.1920929e-07, state["target"]).otherwise(zoomed)
        ease = 1.0 - F.exp(-ZOOM_LERP * frame["dt"])
        return F.struct(target.alias("target"), (state["scale"] + (target - state["scale"]) * ease).alias("scale"))

    return inputs.groupBy(viewer).agg(frames.alias("f")).select(viewer, F.aggregate("f", begin, step).alias("s"), F.size("f").cast("bigint").alias("frames")).select(viewer, F.col("s.target").alias("target_scale"), F.col("s.scale").alias("scale"), "frames")


def desired(views: DataFrame, available: DataFrame | None = None, opens: Column | None = None) -> DataFrame:
    """Rows of ``views`` once for each visible tile, as tile_id, and whether it can be opened in this frame; tile_id is null
    for tiles that are not baked, and in the one row of a frame that sees none. ``available`` (tile_id): the tiles there are, all if not given.
    ``opens``: over a row with tile_id, whether opening succeeds; always if not given."""
    rows = views.withColumn("tile_id", F.explode_outer("visible")).drop("visible")
    if available is not None:
        there = available.select(F.col("tile_id").alias("there_")).distinct()
        rows = rows.join(there, F.col("tile_id") == F.col("there_"), "left").withColumn("tile_id", F.col("there_")).drop("there_")
    return rows.withColumn("opens", F.lit(True) if opens is None else F.coalesce(opens, F.lit(False)))


def load_evict(views: DataFrame, viewer: str, order: list[str], frame: str, available: DataFrame | None = None, opens: Column | None = None) -> DataFrame:
    """(viewer, frame, action, tile_id): what each frame loads, and what it evicts.

    A tile is wanted as long as it is visible and available. Of every run of frames that want it, the first one that can
    open it loads it, so a failed open is tried again in the next frame; the frame after the run evicts it if it was loaded.
    """
    by_frame = Window.partitionBy(viewer).orderBy(*order)
    frames = views.select(viewer, frame, F.row_number().over(by_frame).alias("i"))
    wanted = desired(views, available, opens).filter("tile_id is not null").select(viewer, frame, "tile_id", "opens").join(frames, [viewer, frame])
    run = F.col("i") - F.row_number().over(Window.partitionBy(viewer, "tile_id").orderBy("i"))
    runs = wanted.withColumn("run", run).groupBy(viewer, "tile_id", "run").agg(F.min(F.when(F.col("opens"), F.col("i"))).alias("first"), F.max("i").alias("last")).filter("first is not null")
    event = lambda action, i: F.struct(F.lit(action).alias("action"), i.alias("i"))
    events = runs.select(viewer, "tile_id", F.explode(F.array(event("load", F.col("first")), event("evict", F.col("last") + 1))).alias("e")).select(viewer, "tile_id", "e.*")
    return events.join(frames, [viewer, "i"]).select(viewer, frame, "action", "tile_id")  # no frame after the last one


FRAME = "user_id bigint, event_id bigint, lod int, load array<bigint>, evict array<bigint>"


def load_evict_stream(wanted: DataFrame, forget_after_ms: int | None = None) -> DataFrame:
    """The same as a stream of ``desired`` rows (user_id, ts, event_id, lod, tile_id, opens): state is the set of tiles that
    a viewer holds. Frames of a micro-batch are put in order first; all rows of a frame have to be in one micro-batch, as
    ``desired`` leaves them. A viewer without a frame for ``forget_after_ms`` is forgotten; by default none is."""

    def frames(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        loaded = set(state.get[0]) if state.exists else set()
        out = []
        for (_, event, lod), rows in pd.concat(list(batches)).groupby(["ts", "event_id", "lod"], sort=True):
            there = rows[rows["tile_id"].notna()]
            visible = {int(v) for v in there["tile_id"]}
            new = {int(v) for v in there.loc[there["opens"], "tile_id"]} - loaded
            out.append((key[0], event, lod, sorted(new), sorted(loaded - visible)))
            loaded = (loaded & visible) | new
        state.update((sorted(loaded),))
        if forget_after_ms is not None:
            state.setTimeoutDuration(forget_after_ms)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "lod", "load", "evict"])

    timeout = "NoTimeout" if forget_after_ms is None else "ProcessingTimeTimeout"
    return wanted.groupBy("user_id").applyInPandasWithState(frames, FRAME, "tiles array<bigint>", "append", timeout)


def follow(cameras: DataFrame, players: DataFrame, key: list[str]) -> DataFrame:
    """``cameras`` (key, x, y ...) with the position of the player of the same key; one without a player stays where it is."""
    where = players.select(*key, F.col("x").alias("player_x"), F.col("y").alias("player_y"))
    rows = cameras.join(where, key, "left").withColumns({"x": F.coalesce("player_x", "x"), "y": F.coalesce("player_y", "y")})
    return rows.drop("player_x", "player_y")


def segments(points: DataFrame, key: list[str], order: str = "pos") -> DataFrame:
    """Pairs of consecutive vertices (x0, y0, x1, y1) of rows (key, pos, x, y)."""
    after = Window.partitionBy(*key).orderBy(order)
    rows = points.select(*key, F.col(order), F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(after).alias("x1"), F.lead("y").over(after).alias("y1"))
    return rows.filter(F.col("x1").isNotNull())


def color_code(rgb: tuple[int, int, int]) -> int:
    """Hundredths of red, green and blue in one number."""
    return rgb[0] * 10_000 + rgb[1] * 100 + rgb[2]


def _by_code(code: Column, codes: dict[str, int], colors: dict[str, tuple]) -> Column:
    return F.coalesce(*(F.when(code == codes[n], color_code(c)) for n, c in colors.items()))


def terrain_color(code: Column) -> Column:
    return _by_code(code, TERRAIN, TERRAIN_COLOR)


def road_color(code: Column) -> Column:
    return _by_code(code, ROAD_CLASS, ROAD_COLOR)


def drawn(layers: dict[str, DataFrame], grid: Grid, lod: int) -> DataFrame:
    """(tile_id, layer, x0, y0, x1, y1, radius, color): a line for each pair of consecutive vertices and a circle for each
    point of interest of baked layers at a level."""
    left, bottom = grid.origin_of(F.col("tile_id"))
    colors = {"areas": terrain_color(F.col("kind")), "buildings": F.lit(color_code(BUILDING_COLOR)), "roads": road_color(F.col("class")), "pois": F.lit(color_code(POI_COLOR))}
    lines = {"areas": F.flatten(F.transform("rings", _pairs)), "buildings": _pairs(F.col("footprint")), "roads": _pairs(F.col("points")), "pois": F.array(F.struct(F.col("point").alias("a"), F.col("point").alias("b")))}
    out = None
    for name, pairs in lines.items():
        rows = layers[name].filter(F.col("lod") == lod).select("tile_id", F.lit(name).alias("layer"), colors[name].alias("color"), F.explode(pairs).alias("p"))
        ends = {f"{c}{i}": to_world(F.col(f"p.{e}.{c}"), origin) for i, e in enumerate("ab") for c, origin in (("x", left), ("y", bottom))}
        rows = rows.withColumns(ends).select("tile_id", "layer", "x0", "y0", "x1", "y1", F.lit(POI_RADIUS if name == "pois" else None).cast("double").alias("radius"), "color")
        out = rows if out is None else out.unionByName(rows)
    return out


def _pairs(points: Column) -> Column:
    """Array of consecutive vertices (a, b); empty below two."""
    steps = F.when(F.size(points) >= 2, F.sequence(F.lit(0), F.size(points) - 2)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.struct(F.get(points, i).alias("a"), F.get(points, i + 1).alias("b")))


def lod_or_last(lods: Column, lod: Column) -> Column:
    """The level of a nested tile, or its last one; null for a tile without levels."""
    return F.coalesce(F.get(lods, lod), F.try_element_at(lods, F.lit(-1)))


def status_text(region: Column, x: Column, y: Column, scale: Column, lod: Column, loaded: Column) -> Column:
    return F.format_string("Region: %s\nPlayer: %.0f, %.0f\nScale: %.4f\nLOD: %d\nLoaded tiles: %d", region, x, y, scale, lod, loaded)
