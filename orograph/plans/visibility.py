"""Queries on masks, lines of sight, coverage, fusion and volumes, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.functions import scalars as S
from orograph.operators import masks, sight
from orograph.operators.registry import Registry
from orograph.sources import fixtures
from orograph.sources.fixtures import with_

REGISTRY = Registry()
query = REGISTRY.query

NEAR = """near AS (SELECT s.station_id, s.r AS site_r, s.c AS site_c, s.height_m, s.range_cells, s.azimuth_deg, s.width_deg, t.r, t.c, t.z, t.valid,
    t.c - s.c AS dx, s.r - t.r AS dy, (t.c - s.c) * (t.c - s.c) + (s.r - t.r) * (s.r - t.r) AS d2
    FROM terrain t JOIN stations s ON (t.c - s.c) * (t.c - s.c) + (s.r - t.r) * (s.r - t.r) <= s.range_cells * s.range_cells)"""
SECTOR = "(dx = 0 AND dy = 0) OR width_deg >= 360 OR abs((degrees(atan2(dx::DOUBLE, dy::DOUBLE)) + 360 - azimuth_deg + 180 + 360) % 360 - 180) <= width_deg / 2.0"


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.around(fixtures.terrain(spark, sf_dir), fixtures.stations(spark, sf_dir))


def in_sector() -> F.Column:
    return masks.sector(F.col("dx"), F.col("dy"), F.col("azimuth_deg"), F.col("width_deg"))


@query(f"{with_('terrain', 'stations')}, {NEAR} SELECT station_id, r, c, d2 FROM near")
def range_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(spark, sf_dir).select("station_id", "r", "c", "d2")


@query(f"{with_('terrain', 'stations')}, {NEAR} SELECT station_id, count(*) FILTER ({SECTOR}) AS inside, count(*) AS in_range FROM near GROUP BY station_id")
def sector_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(spark, sf_dir).groupBy("station_id").agg(F.count_if(in_sector()).alias("inside"), F.count("*").alias("in_range"))


@query(f"{with_('terrain', 'stations')}, {NEAR} SELECT station_id, count(*) AS cells FROM near WHERE 4 * d2 >= range_cells * range_cells AND ({SECTOR}) GROUP BY station_id")
def annular_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    outer = near(spark, sf_dir).where(4 * F.col("d2") >= F.col("range_cells") * F.col("range_cells"))
    return outer.where(in_sector()).groupBy("station_id").agg(F.count("*").alias("cells"))


# Rays from each station to the cells in its range.
RAYS = """rays AS (SELECT n.*, g.z + n.height_m AS h0, n.z + 2 AS h1, greatest(abs(n.r - n.site_r), abs(n.c - n.site_c)) AS n
    FROM near n JOIN terrain g ON g.r = n.site_r AND g.c = n.site_c WHERE n.valid),
hits AS (SELECT station_id, x.r, x.c, i, n, h0, h1, h0 + (h1 - h0) * i / n AS line, t.z AS ground
    FROM (SELECT *, unnest(range(1, n)) AS i FROM rays) x JOIN terrain t
    ON t.r = x.site_r + floor((2 * (x.r - x.site_r) * i + n) / (2 * n)) AND t.c = x.site_c + floor((2 * (x.c - x.site_c) * i + n) / (2 * n)) AND t.valid)"""
SEEN = RAYS + """, seen AS (SELECT r.*, h.station_id IS NULL AS visible FROM rays r LEFT JOIN (SELECT DISTINCT station_id, r, c FROM hits WHERE ground > line) h USING (station_id, r, c))"""


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid cells in the range of each station, with the verdict on a point 2 above them."""
    return sight.views(fixtures.stations(spark, sf_dir), fixtures.terrain(spark, sf_dir), "station_id", 2.0).where("visible is not null")


@query(f"{with_('terrain', 'stations')}, {NEAR}, {SEEN} SELECT station_id, r, c, visible FROM seen")
def los_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen(spark, sf_dir).select("station_id", "r", "c", "visible")


WATCH = "count(*) FILTER ({0}) AS theoretical, count(*) FILTER (({0}) AND visible) AS visible_cells, count(*) FILTER (({0}) AND NOT visible) AS blocked_cells"


@query(f"{with_('terrain', 'stations')}, {NEAR}, {SEEN}, w AS (SELECT station_id, {WATCH.format(SECTOR)} FROM seen GROUP BY station_id) SELECT *, round(CASE WHEN theoretical > 0 THEN visible_cells / theoretical ELSE 0 END, 6) AS visible_ratio FROM w")
def watchpost_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = in_sector()
    out = seen(spark, sf_dir).groupBy("station_id").agg(
        F.count_if(inside).alias("theoretical"), F.count_if(inside & F.col("visible")).alias("visible_cells"), F.count_if(inside & ~F.col("visible")).alias("blocked_cells")
    )
    return out.withColumn("visible_ratio", F.round(F.when(F.col("theoretical") > 0, F.col("visible_cells") / F.col("theoretical")).otherwise(F.lit(0.0)), 6))


LEAST = RAYS + """, least AS (SELECT r.*, greatest(0.0, coalesce(m.needed - r.h1, 0.0)) AS least_height
    FROM (SELECT * REPLACE (z AS h1) FROM rays) r LEFT JOIN (SELECT station_id, r, c, max(h0 + (ground - h0) * n / i) AS needed FROM hits GROUP BY ALL) m USING (station_id, r, c))"""


def least(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid cells in the range of each station, with their least visible height above ground."""
    return heights(spark, sf_dir).where("least_height is not null")


def heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells in the range of each station; the least visible height of invalid ones is null."""
    return sight.views(fixtures.stations(spark, sf_dir), fixtures.terrain(spark, sf_dir), "station_id")


@query(f"{with_('terrain', 'stations')}, {NEAR}, {LEAST} SELECT station_id, r, c, round(least_height, 6) AS least_height FROM least")
def min_visible_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return least(spark, sf_dir).select("station_id", "r", "c", F.round("least_height", 6).alias("least_height"))


# Masks of a coverage for a target 40 above ground, elevation band 0.5 to 20 degrees, cells of 10 metres.
BAND = "40.0 >= sqrt(d2) * 10 * tan(radians(0.5)) AND 40.0 <= sqrt(d2) * 10 * tan(radians(20.0))"


def coverage(spark: SparkSession, sf_dir: str, height: float = 40.0) -> DataFrame:
    """The masks of every station's coverage; invalid cells are outside the domain."""
    cells = heights(spark, sf_dir)
    away = F.sqrt(F.col("d2").cast("double")) * 10
    band = F.lit(height).between(away * F.tan(F.radians(F.lit(0.5))), away * F.tan(F.radians(F.lit(20.0))))
    domain = F.col("valid") & F.col("least_height").isNotNull()
    return masks.assemble(cells, in_sector(), band, F.coalesce(F.col("least_height") <= height, F.lit(False)), domain)


MASKS = LEAST + f""", masks AS (SELECT n.station_id, n.r, n.c, n.z, n.d2, l.least_height, raw, raw AND n.valid AND l.least_height IS NOT NULL AS theoretical, raw AND NOT (n.valid AND l.least_height IS NOT NULL) AS unknown,
    raw AND n.valid AND coalesce(l.least_height <= 40, FALSE) AS visible, raw AND n.valid AND l.least_height > 40 AS blocked
    FROM (SELECT *, ({SECTOR}) AND {BAND} AS raw FROM near) n LEFT JOIN least l USING (station_id, r, c))"""


@query(f"{with_('terrain', 'stations')}, {NEAR}, {MASKS} SELECT station_id, r, c, raw AS raw_theoretical, theoretical, unknown, coalesce(visible, FALSE) AS visible, coalesce(blocked, FALSE) AS blocked FROM masks")
def coverage_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(spark, sf_dir).select("station_id", "r", "c", "raw_theoretical", "theoretical", "unknown", "visible", "blocked")


AREAS = """count(*) FILTER (raw) * 100.0::DOUBLE AS raw_theoretical_area, count(*) FILTER (theoretical) * 100.0::DOUBLE AS theoretical_area, count(*) FILTER (unknown) * 100.0::DOUBLE AS unknown_area,
    count(*) FILTER (visible) * 100.0::DOUBLE AS visible_area, count(*) FILTER (blocked) * 100.0::DOUBLE AS blocked_area"""


@query(f"{with_('terrain', 'stations')}, {NEAR}, {MASKS}, a AS (SELECT station_id, {AREAS} FROM masks GROUP BY station_id) SELECT *, round(CASE WHEN theoretical_area > 0 THEN blocked_area / theoretical_area ELSE 0 END, 6) AS blocked_ratio, round(CASE WHEN raw_theoretical_area > 0 THEN theoretical_area / raw_theoretical_area ELSE 1 END, 6) AS coverage_ratio FROM a")
def radar_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.areas(coverage(spark, sf_dir), ["station_id"], 100.0)


@query(f"{with_('terrain', 'stations')}, {NEAR}, {LEAST} SELECT station_id, h::DOUBLE AS height_m, count(*) FILTER (least_height <= h) AS visible_cells, count(*) FILTER (least_height > h) AS blocked_cells FROM least, (VALUES (10), (40), (80), (160)) v(h) GROUP BY ALL")
def height_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = least(spark, sf_dir).withColumn("height_m", F.explode(F.array(*map(F.lit, (10.0, 40.0, 80.0, 160.0)))))
    return layers.groupBy("station_id", "height_m").agg(F.count_if(F.col("least_height") <= F.col("height_m")).alias("visible_cells"), F.count_if(F.col("least_height") > F.col("height_m")).alias("blocked_cells"))


FLOOR, TOP = "greatest(0.0, sqrt(d2) * 10 * tan(radians(0.5)))", "least(120.0, sqrt(d2) * 10 * tan(radians(20.0)))"
BEAM = f"beam AS (SELECT *, {FLOOR} AS bottom, CASE WHEN d2 > 0 THEN {TOP} ELSE 120.0 END AS top FROM least)"


def beam(cells: DataFrame) -> DataFrame:
    """Cells with the bottom and top of the beam over them, where it is open."""
    away = F.sqrt(F.col("d2").cast("double")) * 10
    cells = cells.withColumn("bottom", F.greatest(F.lit(0.0), away * F.tan(F.radians(F.lit(0.5)))))
    top = F.when(F.col("d2") > 0, F.least(F.lit(120.0), away * F.tan(F.radians(F.lit(20.0))))).otherwise(F.lit(120.0))
    return cells.withColumn("top", top).where(F.col("top") > F.col("bottom"))


@query(f"{with_('terrain', 'stations')}, {NEAR}, {LEAST}, {BEAM}, v AS (SELECT *, bottom + (k + 0.5::DOUBLE) * ((top - bottom) / 6) AS z_agl FROM beam, (SELECT unnest(range(0, 6)) AS k) WHERE top > bottom) SELECT station_id, r, c, k::INT AS k, round(z_agl, 6) AS z_agl, round(z_agl - least_height, 6) AS clearance FROM v WHERE z_agl >= least_height")
def voxel_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = beam(least(spark, sf_dir)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5))))
    points = points.withColumn("z_agl", F.col("bottom") + (F.col("k") + 0.5) * ((F.col("top") - F.col("bottom")) / 6)).where(F.col("z_agl") >= F.col("least_height"))
    return points.select("station_id", "r", "c", "k", F.round("z_agl", 6).alias("z_agl"), F.round(F.col("z_agl") - F.col("least_height"), 6).alias("clearance"))


@query(f"{with_('terrain', 'stations')}, {NEAR}, {LEAST}, {BEAM} SELECT station_id, r, c, round(bottom, 6) AS beam_bottom, round(least(greatest(least_height, bottom), top), 6) AS blocked_top, round(CASE WHEN least_height < top THEN top ELSE bottom END, 6) AS visible_top FROM beam WHERE top > bottom AND d2 > 0")
def clipped_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = beam(least(spark, sf_dir)).where("d2 > 0")
    low = F.least(F.greatest("least_height", "bottom"), F.col("top"))
    high = F.when(F.col("least_height") < F.col("top"), F.col("top")).otherwise(F.col("bottom"))
    return cells.select("station_id", "r", "c", F.round("bottom", 6).alias("beam_bottom"), F.round(low, 6).alias("blocked_top"), F.round(high, 6).alias("visible_top"))


COUNTS = "counts AS (SELECT r, c, count(*) FILTER (visible) AS n, count(*) AS in_range FROM seen GROUP BY r, c)"


@query(f"{with_('terrain', 'stations')}, {NEAR}, {SEEN}, {COUNTS} SELECT r, c, n, in_range FROM counts")
def multi_station_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seen(spark, sf_dir).groupBy("r", "c").agg(F.count_if("visible").alias("n"), F.count("*").alias("in_range"))


@query(f"{with_('terrain', 'stations')}, {NEAR}, {SEEN}, {COUNTS} SELECT count(*) AS theoretical, count(*) FILTER (n >= 1) AS union_cells, count(*) FILTER (n >= 2) AS overlap_cells, count(*) FILTER (n = 0) AS blind_cells FROM counts")
def multi_station_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_station_count(spark, sf_dir).agg(
        F.count("*").alias("theoretical"), F.count_if(F.col("n") >= 1).alias("union_cells"), F.count_if(F.col("n") >= 2).alias("overlap_cells"), F.count_if(F.col("n") == 0).alias("blind_cells")
    )


@query(f"{with_('terrain', 'stations')}, {NEAR}, {SEEN}, {COUNTS} SELECT station_id, count(*) AS visible_cells, count(*) FILTER (counts.n >= 2) AS shared_cells FROM seen JOIN counts USING (r, c) WHERE visible GROUP BY station_id")
def fusion_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = seen(spark, sf_dir).where("visible").select("station_id", "r", "c")
    counts = mine.groupBy("r", "c").agg(F.count("*").alias("n"))
    return mine.join(counts, ["r", "c"]).groupBy("station_id").agg(F.count("*").alias("visible_cells"), F.count_if(F.col("n") >= 2).alias("shared_cells"))


ENVELOPE = """env AS (SELECT station_id, r, c, greatest(z + least_height, h0 + sqrt(d2) * 10 * tan(radians(0.5))) AS lower, h0 + sqrt(greatest(0, (range_cells * 10) * (range_cells * 10) - d2 * 100)) AS upper FROM least)"""


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vertical interval each station covers above each cell, where there is one."""
    away, reach = F.sqrt(F.col("d2").cast("double")) * 10, F.col("range_cells") * 10
    lower = F.greatest(F.col("z") + F.col("least_height"), F.col("h0") + away * F.tan(F.radians(F.lit(0.5))))
    upper = F.col("h0") + F.sqrt(F.greatest(F.lit(0), reach * reach - F.col("d2") * 100).cast("double"))
    return least(spark, sf_dir).select("station_id", "r", "c", lower.alias("lower"), upper.alias("upper")).where("lower <= upper")


@query(f"{with_('terrain', 'stations')}, {NEAR}, {LEAST}, {ENVELOPE} SELECT r, c, round(max(lower), 6) AS lower, round(min(upper), 6) AS upper, count(*) AS stations FROM env WHERE lower <= upper GROUP BY r, c HAVING count(*) >= 2 AND max(lower) <= min(upper)")
def envelope_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = envelopes(spark, sf_dir).groupBy("r", "c").agg(F.max("lower").alias("lower"), F.min("upper").alias("upper"), F.count("*").alias("stations"))
    return out.where("stations >= 2 and lower <= upper").select("r", "c", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "stations")


@query(f"{with_('terrain', 'stations')}, {NEAR}, {LEAST}, {ENVELOPE} SELECT h::DOUBLE AS height_m, r, c, count(*) AS n FROM env, (VALUES (150), (250), (350)) v(h) WHERE h BETWEEN lower AND upper GROUP BY ALL")
def height_band_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = envelopes(spark, sf_dir).withColumn("height_m", F.explode(F.array(*map(F.lit, (150.0, 250.0, 350.0)))))
    return bands.where("height_m between lower and upper").groupBy("height_m", "r", "c").agg(F.count("*").alias("n"))


# A ray to every target from the station whose turn it is.
PROFILE = """pr AS (SELECT t.target_id, s.r AS r0, s.c AS c0, g.z + s.height_m AS h0, t.r AS r1, t.c AS c1, t.z_abs AS h1, greatest(abs(t.r - s.r), abs(t.c - s.c)) AS n, s.range_cells
    FROM targets t JOIN stations s ON s.station_id = t.target_id % (SELECT count(*) FROM stations) JOIN terrain g ON g.r = s.r AND g.c = s.c),
ps AS (SELECT p.*, i, h0 + (h1 - h0) * i / n AS line, t.z AS ground FROM (SELECT *, unnest(range(1, n)) AS i FROM pr) p JOIN terrain t
    ON t.r = r0 + floor((2 * (r1 - r0) * i + n) / (2 * n)) AND t.c = c0 + floor((2 * (c1 - c0) * i + n) / (2 * n)) AND t.valid),
pa AS (SELECT target_id, min(line - ground) AS worst_clearance, min(i) FILTER (line - ground < 0) AS first_hit, max(h0 + (ground - h0) * n / i) AS needed, arg_min(i, (line - ground, i)) AS worst_at FROM ps GROUP BY target_id)"""


def target_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ray to every target, from the station whose turn it is."""
    cells = fixtures.terrain(spark, sf_dir)
    sites = fixtures.stations(spark, sf_dir)
    many = F.broadcast(sites.agg(F.count("*").alias("many")))  # one row
    sites = sites.join(cells, ["r", "c"]).select("station_id", F.col("r").alias("r0"), F.col("c").alias("c0"), (F.col("z") + F.col("height_m")).alias("h0"), "range_cells")
    ends = fixtures.targets(spark, sf_dir).join(many).select((F.col("target_id") % F.col("many")).alias("station_id"), "target_id", F.col("r").alias("r1"), F.col("c").alias("c1"), F.col("z_abs").alias("h1"))
    return ends.join(sites, "station_id")


def target_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile to every target, from the station whose turn it is."""
    return sight.profiles(target_rays(spark, sf_dir), fixtures.terrain(spark, sf_dir), ["target_id"])


@query(f"{with_('terrain', 'stations', 'targets')}, {PROFILE} SELECT target_id, round(worst_clearance, 6) AS worst_clearance, worst_at, first_hit, round(greatest(h1, coalesce(needed, h1)), 6) AS required FROM pr LEFT JOIN pa USING (target_id)")
def profile_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_profiles(spark, sf_dir).select("target_id", F.round("worst_clearance", 6).alias("worst_clearance"), "worst_at", "first_hit", F.round("required", 6).alias("required"))


@query(f"""{with_('terrain', 'stations', 'targets')}, {PROFILE}, v AS (SELECT p.*, first_hit, g.z AS ground1, g.valid AS valid1, (r1 - r0) * (r1 - r0) + (c1 - c0) * (c1 - c0) AS d2 FROM pr p LEFT JOIN pa USING (target_id) LEFT JOIN terrain g ON g.r = r1 AND g.c = c1)
    SELECT target_id, CASE WHEN d2 * 100 + (h1 - h0) * (h1 - h0) > 400 * 400 THEN 'outside_range' WHEN h1 - h0 > sqrt(d2) * 10 * tan(radians(20.0)) THEN 'above_max_elevation' WHEN ground1 IS NULL THEN 'outside_dem' WHEN NOT valid1 THEN 'dem_nodata' WHEN h1 < ground1 THEN 'below_terrain' WHEN first_hit IS NOT NULL THEN 'terrain_blocked' ELSE 'detectable' END AS verdict FROM v""")
def target_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ground = fixtures.terrain(spark, sf_dir).select(F.col("r").alias("r1"), F.col("c").alias("c1"), F.col("z").alias("ground1"), F.col("valid").alias("valid1"))
    dr, dc, dh = (F.col("r1") - F.col("r0")).cast("long"), (F.col("c1") - F.col("c0")).cast("long"), F.col("h1") - F.col("h0")
    d2 = dr * dr + dc * dc
    # The verdicts and their order.
    verdict = (
        F.when(d2 * 100 + dh * dh > 400 * 400, "outside_range")
        .when(dh > F.sqrt(d2.cast("double")) * 10 * F.tan(F.radians(F.lit(20.0))), "above_max_elevation")
        .when(F.col("ground1").isNull(), "outside_dem")
        .when(~F.col("valid1"), "dem_nodata")
        .when(F.col("h1") < F.col("ground1"), "below_terrain")
        .when(F.col("first_hit").isNotNull(), "terrain_blocked")
        .otherwise("detectable")
    )
    return target_profiles(spark, sf_dir).join(ground, ["r1", "c1"], "left").select("target_id", verdict.alias("verdict"))


@query(f"{with_('terrain', 'stations', 'targets')}, {NEAR}, {SEEN} SELECT target_id, coalesce(bool_or(visible), FALSE) AS seen_by_any, count(s.station_id) AS in_range_of FROM targets t LEFT JOIN seen s ON s.r = t.r AND s.c = t.c GROUP BY target_id")
def multi_target_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    from_all = seen(spark, sf_dir).select("r", "c", "station_id", "visible")
    return fixtures.targets(spark, sf_dir).join(from_all, ["r", "c"], "left").groupBy("target_id").agg(F.coalesce(F.bool_or("visible"), F.lit(False)).alias("seen_by_any"), F.count("station_id").alias("in_range_of"))


POLAR = """inv AS (SELECT station_id, range_cells, sqrt(d2) - 1 AS cut, floor((degrees(atan2(dx::DOUBLE, dy::DOUBLE)) + 360) % 360 / 10)::INT AS low FROM near WHERE NOT valid),
cuts AS (SELECT station_id, b, min(greatest(0.0, cut)) AS cut FROM (SELECT station_id, cut, unnest([low % 36, (low + 1) % 36]) AS b FROM inv) GROUP BY ALL)"""


def polar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per station and bin of 10 degrees, the range up to the nearest invalid cell."""
    low = F.floor(S.azimuth(F.col("dx").cast("double"), F.col("dy").cast("double")) / 10).cast("int")
    gaps = near(spark, sf_dir).where("not valid").select("station_id", (F.sqrt(F.col("d2").cast("double")) - 1).alias("cut"), F.explode(F.array(low % 36, (low + 1) % 36)).alias("b"))
    cuts = gaps.groupBy("station_id", "b").agg(F.min(F.greatest(F.lit(0.0), F.col("cut"))).alias("cut"))
    bins = fixtures.stations(spark, sf_dir).select("station_id", "range_cells", F.explode(F.sequence(F.lit(0), F.lit(35))).alias("b"))
    return bins.join(cuts, ["station_id", "b"], "left").select("station_id", "b", F.coalesce("cut", F.col("range_cells").cast("double")).alias("radius"))


@query(f"{with_('terrain', 'stations')}, {NEAR}, {POLAR} SELECT station_id, b::INT AS b, round(coalesce(cut, range_cells::DOUBLE), 6) AS radius FROM stations CROSS JOIN (SELECT unnest(range(0, 36)) AS b) LEFT JOIN cuts USING (station_id, b)")
def polar_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polar(spark, sf_dir).select("station_id", "b", F.round("radius", 6).alias("radius"))


@query(f"""{with_('terrain', 'stations')}, {NEAR}, {POLAR}, full_ AS (SELECT station_id, b, coalesce(cut, range_cells::DOUBLE) AS radius FROM stations CROSS JOIN (SELECT unnest(range(0, 36)) AS b) LEFT JOIN cuts USING (station_id, b)),
    az AS (SELECT *, (degrees(atan2(dx::DOUBLE, dy::DOUBLE)) + 360) % 360 / 10 AS f FROM near WHERE valid)
    SELECT az.station_id, count(*) FILTER (sqrt(d2) <= l.radius + (u.radius - l.radius) * (f - floor(f)) + 0.5) AS domain_cells, count(*) AS valid_cells FROM az JOIN full_ l ON l.station_id = az.station_id AND l.b = floor(f) % 36 JOIN full_ u ON u.station_id = az.station_id AND u.b = (floor(f) + 1) % 36 GROUP BY ALL""")
def analysis_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = polar(spark, sf_dir)
    low = bins.select("station_id", F.col("b").alias("low"), F.col("radius").alias("low_radius"))
    high = bins.select("station_id", F.col("b").alias("high"), F.col("radius").alias("high_radius"))
    place = S.azimuth(F.col("dx").cast("double"), F.col("dy").cast("double")) / 10
    cells = near(spark, sf_dir).where("valid").withColumn("f", place).withColumns({"low": (F.floor("f") % 36).cast("int"), "high": ((F.floor("f") + 1) % 36).cast("int")})
    limit = F.col("low_radius") + (F.col("high_radius") - F.col("low_radius")) * (F.col("f") - F.floor("f")) + 0.5
    joined = cells.join(low, ["station_id", "low"]).join(high, ["station_id", "high"])
    return joined.groupBy("station_id").agg(F.count_if(F.sqrt(F.col("d2").cast("double")) <= limit).alias("domain_cells"), F.count("*").alias("valid_cells"))


@query(f"""{with_('terrain', 'stations')}, m AS (SELECT station_id, g.z + height_m AS h0, s.r AS r0, s.c AS c0, range_cells, a, k, d FROM stations s JOIN terrain g ON g.r = s.r AND g.c = s.c, (SELECT unnest(range(0, 36)) AS a), (SELECT unnest([-2.0::DOUBLE, 0.0, 2.0]) AS k), (SELECT unnest(range(1, 25)) AS d) WHERE d <= range_cells),
    w AS (SELECT m.*, t.z, t.valid, CASE WHEN t.r IS NULL THEN 'boundary' WHEN NOT t.valid THEN 'nodata' WHEN t.z > h0 + d * 10 * tan(radians(k)) THEN 'terrain' END AS stop FROM m LEFT JOIN terrain t ON t.r = r0 - round(d * cos(radians(a * 10.0)), 0) AND t.c = c0 + round(d * sin(radians(a * 10.0)), 0)),
    f AS (SELECT station_id, a, k, min(d) FILTER (stop IS NOT NULL) AS hit, arg_min(stop, d) FILTER (stop IS NOT NULL) AS stop, any_value(range_cells) AS reach FROM w GROUP BY station_id, a, k)
    SELECT station_id, (a * 10)::INT AS azimuth, k AS elevation, coalesce(hit, reach)::INT AS distance, coalesce(stop, 'nominal') AS termination FROM f""")
def ray_fan(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fixtures.terrain(spark, sf_dir)
    fan = fixtures.stations(spark, sf_dir).join(cells, ["r", "c"]).withColumn("h0", F.col("z") + F.col("height_m"))
    fan = fan.withColumn("azimuth", F.explode(F.sequence(F.lit(0), F.lit(350), F.lit(10)))).withColumn("elevation", F.explode(F.array(*map(F.lit, (-2.0, 0.0, 2.0)))))
    fan = fan.withColumn("d", F.explode(F.sequence(F.lit(1), "range_cells"))).withColumn("angle", F.radians(F.col("azimuth").cast("double")))
    fan = fan.select(
        "station_id", "azimuth", "elevation", "d", "h0", "range_cells",
        (F.col("r") - F.round(F.col("d") * F.cos("angle"), 0)).cast("int").alias("r"), (F.col("c") + F.round(F.col("d") * F.sin("angle"), 0)).cast("int").alias("c"),
    )
    over = F.col("z") > F.col("h0") + F.col("d") * 10 * F.tan(F.radians("elevation"))
    stop = F.when(F.col("z").isNull(), "boundary").when(~F.col("valid"), "nodata").when(over, "terrain")
    steps = fan.join(cells, ["r", "c"], "left").withColumn("stop", stop)
    out = steps.groupBy("station_id", "azimuth", "elevation").agg(F.min(F.when(F.col("stop").isNotNull(), F.col("d"))).alias("hit"), F.min_by("stop", F.when(F.col("stop").isNotNull(), F.col("d"))).alias("stop"), F.max("range_cells").alias("reach"))
    return out.select("station_id", "azimuth", "elevation", F.coalesce("hit", "reach").alias("distance"), F.coalesce("stop", F.lit("nominal")).alias("termination"))
