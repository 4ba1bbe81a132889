"""Geocode attempts, cached and ranked hits, logical places, hexagon bins and overlap groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.keys import geo_query_key
from tidewell.functions.text import fold
from tidewell.operators.classify import small_table
from tidewell.operators.components import connected_components
from tidewell.operators.filters import in_bbox

EARTH = 6_371_008.8


def district_centroid(df: DataFrame, centroids: DataFrame, district: str = "district") -> DataFrame:
    """df with lat and lng of its district; unknown districts stay null."""
    c = centroids.select(F.col("district").alias(district), F.col("lat").alias("lat"), F.col("lng").alias("lng"))
    return df.join(c, district, "left")


def geocode_inputs(cands: DataFrame, id_col: str, most: int = 8) -> DataFrame:
    """(id, attempt, address, hint, key): addresses to try, best candidate first, one per query key.

    cands(id, pos, text, neighborhood, district): text with district, then the neighborhood, for the first `most`.
    """
    tries = F.array(F.struct(F.col("text").alias("address"), F.lit(0).alias("o")), F.struct(F.col("neighborhood").alias("address"), F.lit(1).alias("o")))
    rows = cands.filter(F.col("pos") <= most).select(id_col, "pos", F.col("district").alias("hint"), F.inline(tries)).filter("address IS NOT NULL AND trim(address) <> ''")
    rows = rows.withColumn("key", geo_query_key("address", "hint"))
    first = rows.groupBy(id_col, "key").agg(F.min(F.struct("pos", "o", "address", "hint")).alias("f"))
    ordered = first.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("f", "key"))).alias("a"))
    return ordered.select(id_col, F.posexplode("a").alias("attempt", "x")).select(id_col, "attempt", "x.f.address", "x.f.hint", "x.key")


def cached_geocodes(inputs: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """inputs with the live cache entry of their key; provider becomes cache where one is found."""
    live = cache.filter(F.col("expires_at") > now).select(F.col("normalized_query").alias("key"), F.struct("status", "lat", "lng", "confidence", "district").alias("hit"))
    best = live.groupBy("key").agg(F.max_by("hit", F.col("hit.confidence")).alias("hit"))
    return inputs.join(best, "key", "left").withColumn("provider", F.when(F.col("hit").isNotNull(), "cache"))


def invalidate_cache(cache: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Entries that stay, and the number of those dropped (provider version with the prefix)."""
    gone = F.coalesce(F.startswith("provider_version", F.lit(prefix)), F.lit(False))
    return cache.filter(~gone), cache.agg(F.count_if(gone).alias("dropped"))


def rank_hits(inputs: DataFrame, places: DataFrame, key: str, confidence: Column, most: int = 5) -> DataFrame:
    """The best of up to `most` places per query, by confidence, then importance. places has key and pos."""
    rows = inputs.join(places.filter(F.col("pos") <= most), key).withColumn("confidence", confidence)
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("confidence", F.coalesce("importance", F.lit(0.0)), -F.col("pos"))).alias("b")).select(key, "b.*")


def geocode_status(df: DataFrame, box: tuple[float, float, float, float], sure: float = 0.75, least: float = 0.3) -> DataFrame:
    """status and failure_type of hits(lat, lng, confidence, is_district); rows without a hit have null lat."""
    inside = in_bbox("lat", "lng", box)
    failure = F.when(F.col("lat").isNull(), "no_result").when(~inside, "out_of_bounds").when(F.col("confidence") < least, "low_confidence")
    status = F.when(failure.isNotNull(), "failed").when(F.col("is_district") | (F.col("confidence") < sure), "approximate").otherwise("resolved")
    return df.withColumns({"failure_type": failure, "status": status})


def logical_places(docs: DataFrame, id_col: str, text: str, rules: DataFrame) -> DataFrame:
    """(id, strategy, place): the first rule whose pattern the folded text matches.

    rules(priority, strategy, pattern, place) is a small table; its rows become one chain of conditions.
    """
    t = fold(text)
    found = F.coalesce(*[F.when(t.rlike(r.pattern), F.struct(F.lit(r.strategy).alias("strategy"), F.lit(r.place).alias("place"))) for r in small_table(rules.orderBy("priority"))])
    return docs.select(id_col, found.alias("f")).filter("f IS NOT NULL").select(id_col, "f.*")


def metres(lat: Column, lng: Column, lat0: float = 0.0) -> tuple[Column, Column]:
    """Equirectangular metres around a reference latitude."""
    return F.radians(lng) * math.cos(math.radians(lat0)) * EARTH, F.radians(lat) * EARTH


def hexbin(df: DataFrame, lat: str, lng: str, radius: float = 500.0, lat0: float = 0.0) -> DataFrame:
    """(q, r, n): points per pointy-topped hexagon, by rounding cube coordinates; integers as longs."""
    x, y = metres(F.col(lat), F.col(lng), lat0)
    q, r = (math.sqrt(3) / 3 * x - y / 3) / radius, (2 / 3 * y) / radius
    cube = df.filter(F.col(lat).isNotNull() & F.col(lng).isNotNull()).select(q.alias("q"), r.alias("r"))
    cube = cube.withColumn("s", -F.col("q") - F.col("r"))
    for c in "qrs":
        cube = cube.withColumns({f"{c}0": F.floor(F.col(c) + 0.5), f"{c}d": F.abs(F.floor(F.col(c) + 0.5) - F.col(c))})
    fix_q = (F.col("qd") > F.col("rd")) & (F.col("qd") > F.col("sd"))
    fix_r = ~fix_q & (F.col("rd") > F.col("sd"))
    cells = cube.select(F.when(fix_q, -F.col("r0") - F.col("s0")).otherwise(F.col("q0")).cast("long").alias("q"), F.when(fix_r, -F.col("q0") - F.col("s0")).otherwise(F.col("r0")).cast("long").alias("r"))
    return cells.groupBy("q", "r").agg(F.count("*").alias("n"))


def overlap_groups(df: DataFrame, id_col: str, lat: str, lng: str, eps: float, lat0: float = 0.0) -> DataFrame:
    """(id, group): points closer than eps metres are one group, transitively; the least id names it.

    Points fall into cells whose diagonal is eps, so all points of a cell are linked at once; cells are then linked
    where two of their points are near, and the components of the cells are the groups.
    """
    side = eps / math.sqrt(2) * 0.999999
    x, y = metres(F.col(lat), F.col(lng), lat0)
    pts = df.select(F.col(id_col).alias("id"), x.alias("x"), y.alias("y")).withColumn("cell", F.struct(F.floor(F.col("x") / side).alias("x"), F.floor(F.col("y") / side).alias("y")))
    near = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if (i, j) > (0, 0)]
    places = pts.select("x", "y", "cell").distinct()
    around = places.select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("cell").alias("a"), F.explode(F.array(*[F.struct((F.col("cell.x") + i).alias("x"), (F.col("cell.y") + j).alias("y")) for i, j in near])).alias("cell"))
    hit = around.join(places, "cell").filter((F.col("ax") - F.col("x")) ** 2 + (F.col("ay") - F.col("y")) ** 2 < eps * eps)
    parts = connected_components(hit.select("a", F.col("cell").alias("b")).distinct().checkpoint())
    cells = pts.groupBy("cell").agg(F.min("id").alias("least")).join(parts.withColumnRenamed("node", "cell"), "cell", "left").withColumn("component", F.coalesce("component", "cell"))
    names = cells.groupBy("component").agg(F.min("least").alias("group_id"))
    return pts.join(cells.join(names, "component").select("cell", "group_id"), "cell").select(F.col("id").alias(id_col), "group_id")
