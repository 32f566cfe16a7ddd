"""Addresses, zones, place hierarchies and shapefiles."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from larkspur.functions import text as X, vectors as V
from larkspur.plans.session import broadcast_if_small, written

# --- addresses


def address_indexes(addresses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Localities, streets and the rarest word of each locality, from normal addresses (number, street, postcode, inseeCode, locality_name, lon, lat).

    Localities: locality (postcode and name), postcode, inseeCode, locality_name, lon, lat (means over addresses), count.
    Streets: street, locality, postcode, numbers (an array of number, lon, lat), lon, lat, count. Words: word, locality_name,
    postcode, inseeCode: of a locality's words the one that the fewest have, of equals the first.
    """
    base = addresses.where("postcode is not null and postcode <> ''").withColumn("locality", F.concat("postcode", F.lit(" "), "locality_name")).withColumn("postcode", F.col("postcode").cast("int"))
    means = (F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.count("*").alias("count"))
    localities = base.where("locality_name <> ''").groupBy("locality").agg(F.min("postcode").alias("postcode"), F.min("inseeCode").alias("inseeCode"), F.min("locality_name").alias("locality_name"), *means)
    streets = base.where("street is not null and locality is not null").groupBy("street", "locality").agg(F.min("postcode").alias("postcode"), F.sort_array(F.collect_list(F.struct("number", "lon", "lat"))).alias("numbers"), *means)
    words = localities.select("locality", "locality_name", "postcode", "inseeCode", F.explode(F.array_distinct(F.transform(X.address_words("locality_name"), X.simplify_phonetic))).alias("word"))
    counted = words.withColumn("n", F.count("*").over(Window.partitionBy("word")))
    rarest = counted.groupBy("locality").agg(F.min_by(F.struct("word", "locality_name", "postcode", "inseeCode"), F.struct("n", "word")).alias("r")).select("r.*")
    return localities, streets, rarest


def with_postcode(search: DataFrame, localities: DataFrame, words: DataFrame) -> DataFrame:
    """search (id, address) with postcode, inseeCode, locality, localitySimilarity and localityMatchedBy.

    A postcode in the address that a locality has is taken. Else each word of the address that is the rarest of a
    locality is a candidate: its likeness is that of the texts, and with a number that looks like a postcode the mean of that and
    of how near both codes are; the best counts, of equals the least postcode.
    """
    asked = search.select("id", "address").withColumn("_simple", X.simplify_phonetic("address")).withColumn("_code", X.postcode("_simple").cast("int"))
    known = localities.groupBy("postcode").agg(F.min(F.struct("locality", "inseeCode")).alias("l"))
    known = broadcast_if_small(written(known.withColumnRenamed("postcode", "_known")))  # few codes have most addresses: a shuffle would deal by them
    asked = written(asked.join(known, F.col("_code") == F.col("_known"), "left"))
    rest = asked.where("_known is null").withColumn("_rest", X.without_house_number("_simple")).withColumn("_code", X.postcode("_rest").cast("int"))
    name = F.coalesce(F.call_function("replace", F.col("_rest"), F.col("_code").cast("string"), F.lit("")), F.col("_rest"))
    tried = rest.select("id", "_code", name.alias("_name"), F.explode(F.array_distinct(X.address_words("_rest"))).alias("word")).join(broadcast_if_small(written(words)), "word")
    # words are few that many localities share, as each has its rarest
    alike = X.text_similarity(F.col("_name"), F.col("locality_name"), 0.7, 0.7)
    code = 1 - F.abs(F.col("_code") - F.col("postcode")) / F.greatest("_code", "postcode")
    scored = tried.withColumn("localitySimilarity", F.when(F.col("_code").isNotNull(), (code + alike) / 2).otherwise(alike))
    best = scored.groupBy("id").agg(F.min_by(F.struct("postcode", "inseeCode", "locality_name", "localitySimilarity"), F.struct(-F.round("localitySimilarity", 12), "postcode", "locality_name")).alias("b"))
    out = asked.join(best, "id", "left")
    by_list = F.col("_known").isNotNull()
    return out.select(
        "id", "address", F.when(by_list, F.col("_code")).otherwise(F.col("b.postcode")).alias("postcode"), F.when(by_list, F.col("l.inseeCode")).otherwise(F.col("b.inseeCode")).alias("inseeCode"),
        F.when(by_list, F.col("l.locality")).otherwise(F.col("b.locality_name")).alias("locality"), F.col("b.localitySimilarity").alias("localitySimilarity"),
        F.when(by_list, "postcodeList").when(F.col("b").isNotNull(), "Locality").alias("localityMatchedBy"),
    )


def street_name(address: Column, locality: Column, postcode: Column) -> Column:
    """The words of an address without its house number, without its postcode and without what is like the locality; of equal words that go only the last does."""
    words = X.address_words(X.without_house_number(address))
    # read from the end, the first time that such a word comes it goes
    turned = F.reverse(words)
    goes = lambda w: (w.rlike("^[0-9]{1,9}$") & F.coalesce(w.try_cast("int") == postcode, F.lit(False))) | F.coalesce(X.text_similarity(w, locality) >= 0.8, F.lit(False))
    kept = F.filter(turned, lambda w, i: ~(goes(w) & (F.array_position(turned, w) == i + 1)))
    return F.array_join(F.reverse(kept), " ")


def in_street(located: DataFrame, streets: DataFrame, need_number: bool = True) -> DataFrame:
    """The best street for each row of located (as with_postcode() gives it), of those with its postcode.

    A street's strict likeness has to be above 0; best is the most alike, then the softly most alike, then one whose house number is
    found. number, longitude and latitude are those of the equal house number, else of that with the same digits and the most
    similar letters, else the street's mean. Addresses without a house number are left out, or with need_number off get the mean.
    """
    asked = located.withColumn("_simple", X.simplify_phonetic("address")).withColumn("_number", X.house_number("_simple"))
    asked = asked.where("_number is not null") if need_number else asked
    asked = written(asked.withColumn("_street", street_name(F.col("_simple"), F.col("locality"), F.col("postcode"))).drop("_simple"))
    # what several addresses ask for is looked up once; of streets of a postcode only the most alike meet house numbers, and these by equal keys
    wanted = ["postcode", "_street", "_number"]
    streets = written(streets.withColumn("_s", F.monotonically_increasing_id()))
    places = broadcast_if_small(written(streets.select("_s", "postcode", "street", F.col("locality").alias("_locality"), "lon", "lat")))
    pairs = asked.select(*wanted).distinct().join(places, "postcode")
    pairs = pairs.withColumn("streetSimilarity", X.text_similarity(F.col("_street"), F.col("street"), 1, 0.7)).where("streetSimilarity > 0").withColumn("streetSoftSimilarity", X.text_similarity(F.col("_street"), F.col("street"), 1, 0.0))
    likeness = (-F.round("streetSimilarity", 12)).alias("a"), (-F.round("streetSoftSimilarity", 12)).alias("b")
    pairs = pairs.withColumn("_r", F.rank().over(Window.partitionBy(*wanted).orderBy(*likeness))).where("_r = 1")
    digits = lambda c: F.nullif(F.regexp_replace(c, "[^0-9]", ""), F.lit("")).try_cast("long")
    letters = lambda c, none: F.coalesce(F.nullif(F.regexp_replace(c, "[0-9]", ""), F.lit("")), F.lit(none))
    houses = streets.select("_s", F.posexplode("numbers").alias("i", "n")).withColumns({"_same": X.simplify_phonetic("n.number"), "_digits": digits(F.col("n.number")), "_letters": letters(F.col("n.number"), "1")})
    first = F.min(F.struct("i", "n"))
    same = houses.where("_same is not null").groupBy("_s", "_same").agg(first.alias("_equal"))
    near = houses.where("_digits is not null").groupBy("_s", "_digits", "_letters").agg(first.alias("f")).groupBy("_s", "_digits").agg(F.collect_list(F.struct("_letters", "f")).alias("_near"))
    pairs = pairs.withColumns({"_same": X.simplify_phonetic("_number"), "_digits": digits(F.col("_number"))})
    pairs = pairs.join(broadcast_if_small(written(same)), ["_s", "_same"], "left").join(broadcast_if_small(written(near)), ["_s", "_digits"], "left")
    ranked = F.array_min(F.transform("_near", lambda x: F.struct((-X.text_similarity(x["_letters"], letters(F.col("_number"), "0"))).alias("s"), x["f"]["i"].alias("i"), x["f"]["n"].alias("n"))))
    pairs = pairs.withColumn("_n", F.coalesce("_equal.n", ranked["n"]))
    order = F.struct(*likeness, F.col("_n").isNull().alias("c"), "street", "_locality")
    fields = F.struct(F.col("_n.number").alias("number"), "street", "_locality", "streetSimilarity", "streetSoftSimilarity", F.coalesce("_n.lon", "lon").alias("longitude"), F.coalesce("_n.lat", "lat").alias("latitude"))
    best = pairs.groupBy(*wanted).agg(F.min(F.struct(order.alias("o"), fields.alias("f"))).alias("b"))
    best = broadcast_if_small(written(best.select(*(F.col(c).alias(f"_b{c}") for c in wanted), "b")))
    found = asked.join(best, (F.col("postcode") == F.col("_bpostcode")) & (F.col("_street") == F.col("_b_street")) & F.col("_number").eqNullSafe(F.col("_b_number")))
    row = F.struct("address", "b.f.number", "postcode", "inseeCode", "b.f.street", F.col("b.f._locality").alias("locality"), "localitySimilarity", "localityMatchedBy", "b.f.streetSimilarity", "b.f.streetSoftSimilarity", "b.f.longitude", "b.f.latitude")
    return found.groupBy("id").agg(F.min_by(row, "b.o").alias("b")).select("id", "b.*")


def in_zone(points: DataFrame, zones: DataFrame, block: str, key: str = "id", x: str = "longitude", y: str = "latitude", code: str = "zone") -> DataFrame:
    """points with the code of a zone of the same block that holds them, null if none does, of several the least.

    zones: block, code, ring (an array of structs x, y). A zone's box is looked at before its edges; points on an edge are inside.
    """
    box = V.bounding_box("ring")
    points = written(points)  # they are read twice
    shapes = broadcast_if_small(written(zones.select(F.col(block).alias("_block"), F.col(code).alias("_code"), "ring", box.alias("_box"))))
    # the block is the key of the join, so a row meets only its own block's zones
    met = points.select(F.col(key).alias("_id"), F.col(block).alias("_block"), F.col(x).alias("_x"), F.col(y).alias("_y")).join(shapes, "_block")
    met = met.where(F.col("_x").between(F.col("_box.min_x"), F.col("_box.max_x")) & F.col("_y").between(F.col("_box.min_y"), F.col("_box.max_y")))
    inside = met.where(V.in_polygon("_x", "_y", "ring")).groupBy("_id").agg(F.min("_code").alias(code))
    return points.join(inside, F.col(key).eqNullSafe(F.col("_id")), "left").drop("_id")


def locate_addresses(search: DataFrame, indexes: tuple[DataFrame, DataFrame, DataFrame], zones: DataFrame | None = None, need_number: bool = True) -> DataFrame:
    """search (id, address) located in streets, and in zones (inseeCode, irisCode, ring) if given: the whole cascade."""
    localities, streets, words = indexes
    found = in_street(with_postcode(search, localities, words), streets, need_number)
    return found if zones is None else in_zone(found, zones, "inseeCode", code="irisCode")


# --- place hierarchy

#: Kinds of countries and of cities among places, as feature codes begin. Fixed values.
COUNTRY_CODES, CITY_CODES = ("PCL", "PCLD", "PCLF", "PCLI"), "PPL"


def place_hierarchy(places: DataFrame, attach_to_country: bool = True) -> DataFrame:
    """A row for each country, administrative unit of level 1 to 4 and city whose parent is known, with the names of all above it.

    places: id, name, alternatenames, feature_code, country_code, admin1_code to admin4_code, population, timezone. Returns id,
    name, alias, code, parent_code, geo_type, level (0 country to 5 city), city, adm4 to adm1, country, country_code,
    population, time_zone. Codes are those of the levels from below, joined by `;`. A city belongs to the lowest
    level that it has a code of; with attach_to_country off it is left out if that is the country.
    """
    alias = F.concat_ws(",", F.regexp_replace("name", ",", " "), F.coalesce("alternatenames", F.lit("")))
    base = places.select("id", "name", alias.alias("alias"), "feature_code", "country_code", *(F.nullif(F.col(f"admin{i}_code"), F.lit("")).alias(f"a{i}") for i in range(1, 5)), "population", F.col("timezone").alias("time_zone"))
    path = lambda n: F.concat_ws(";", *(F.col(f"a{i}") for i in range(n, 0, -1)), "country_code")
    names = ["country", "adm1", "adm2", "adm3", "adm4"]
    none = F.lit(None).cast("string")
    top = base.where(F.col("feature_code").isin(*COUNTRY_CODES)).withColumns({"code": F.col("country_code"), "parent_code": none, "level": F.lit(0), "country": F.col("alias"), **{n: none for n in names[1:]}, "city": none})
    levels = [top]
    columns = top.columns
    for n in range(1, 5):
        own = base.where(F.col("feature_code") == f"ADM{n}").where(F.col(f"a{n}").isNotNull()).withColumns({"code": path(n), "parent_code": path(n - 1), "level": F.lit(n)})
        above = levels[-1].select(F.col("code").alias("_code"), *(F.col(x).alias(f"_{x}") for x in names[:n]))
        filled = own.join(above, F.col("parent_code") == F.col("_code"))
        levels.append(filled.withColumns({**{x: F.col(f"_{x}") for x in names[:n]}, names[n]: F.col("alias"), **{x: none for x in names[n + 1 :]}, "city": none}).select(*columns))
    lowest = F.coalesce(*(F.when(F.col(f"a{n}").isNotNull(), F.lit(n)) for n in range(4, 0, -1)), F.lit(0))
    parent = F.coalesce(*(F.when(F.col(f"a{n}").isNotNull(), path(n)) for n in range(4, 0, -1)), F.col("country_code"))
    cities = base.where(F.col("feature_code").startswith(CITY_CODES)).withColumns({"code": F.col("id").cast("string"), "parent_code": parent, "_low": lowest, "level": F.lit(5)})
    above = levels[0].where(F.lit(attach_to_country))
    for level in levels[1:]:
        above = above.unionByName(level)
    above = above.select(F.col("code").alias("_code"), F.col("level").alias("_level"), *(F.col(x).alias(f"_{x}") for x in names))
    located = cities.join(above, (F.col("parent_code") == F.col("_code")) & (F.col("_low") == F.col("_level")))
    levels.append(located.withColumns({**{x: F.col(f"_{x}") for x in names}, "city": F.col("alias")}).select(*columns))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select("id", "name", "alias", "code", "parent_code", F.col("feature_code").alias("geo_type"), "level", "city", "adm4", "adm3", "adm2", "adm1", "country", "country_code", "population", "time_zone")


# --- shapefiles

#: Shape types of polygons and points, and the size of a file's header in bytes. Fixed values of the format.
POLYGONS, POINTS, HEADER = {5, 15, 25}, {1, 11, 21}, 100
SHAPES = "ID long, attributes map<string,string>, rings array<array<struct<x:double,y:double>>>, MinLong double, MinLat double, MaxLong double, MaxLat double"


def shapes_of(shp: bytes, dbf: bytes | None) -> Iterator[tuple]:
    """(number, attributes, rings, min x, min y, max x, max y) of each record of a shapefile; a null shape has no rings, a point is a ring of one."""
    rows, at = list(table_of(dbf)) if dbf else [], HEADER
    number = 0
    while at + 8 <= len(shp):
        size = struct.unpack(">i", shp[at + 4 : at + 8])[0] * 2
        body, at = shp[at + 8 : at + 8 + size], at + 8 + size
        kind, rings = struct.unpack("<i", body[:4])[0], []
        if kind in POINTS:
            rings = [[struct.unpack("<2d", body[4:20])]]
        elif kind in POLYGONS:
            parts, points = struct.unpack("<2i", body[36:44])
            begins = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            flat = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
            every = list(zip(flat[::2], flat[1::2], strict=True))
            rings = [every[b:e] for b, e in zip(begins, begins[1:], strict=False)]
        xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
        box = (min(xs), min(ys), max(xs), max(ys)) if xs else (None,) * 4
        yield (number, rows[number] if number < len(rows) else {}, [[{"x": x, "y": y} for x, y in r] for r in rings], *box)
        number += 1


def table_of(dbf: bytes) -> Iterator[dict[str, str]]:
    """The records of a dBase table as text."""
    count, header, size = struct.unpack("<IHH", dbf[4:12])
    fields, at = [], 32
    while at + 32 <= header and dbf[at] != 0x0D:
        fields.append((dbf[at : at + 11].split(b"\0")[0].decode("latin-1"), dbf[at + 16]))
        at += 32
    for i in range(count):
        row, place = dbf[header + i * size : header + (i + 1) * size], 1
        out = {}
        for name, width in fields:
            out[name] = row[place : place + width].decode("utf-8", "replace").strip()
            place += width
        yield out


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """Shapes of all .shp files of a folder, with the attributes of the .dbf files beside them and the file they are of; coordinates as they are, which is to be longitude and latitude."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"^(.*)\.[^.]*$", 1).alias("file"), F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1)).alias("kind"), "content")
    both = files.where("kind in ('shp', 'dbf')").groupBy("file").agg(F.max(F.when(F.col("kind") == "shp", F.col("content"))).alias("shp"), F.max(F.when(F.col("kind") == "dbf", F.col("content"))).alias("dbf")).where("shp is not null")

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                found = list(shapes_of(bytes(row.shp), bytes(row.dbf) if row.dbf is not None else None))
                for b in range(0, len(found), 5_000):
                    out = pd.DataFrame(found[b : b + 5_000], columns=["ID", "attributes", "rings", "MinLong", "MinLat", "MaxLong", "MaxLat"])
                    out.insert(0, "file", row.file)
                    yield out

    return both.mapInPandas(parsed, f"file string, {SHAPES}")


def shapes_to_parquet(spark: SparkSession, source: str, target: str, append: bool = False) -> None:
    read_shapes(spark, source).write.mode("append" if append else "overwrite").parquet(target)
