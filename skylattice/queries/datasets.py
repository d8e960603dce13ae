"""Jobs on data sets."""

from pyspark.sql import functions as F

from ..functions import regions, sphere, times
from ..plans import catalogue, filejobs, images as im, pixels as px, products as pr, spectra as sp
from ..session import scratch_path
from ..sources import files, upload
from .registry import mjd_sql, query


@query("x1_spectrum_cutout", "SELECT spectrum_id, min(spectral) AS a, max(spectral) AS b, max(spectral) - min(spectral) AS ext, (min(spectral) + max(spectral)) / 2 "
                             "AS mid FROM {spectra} s WHERE spectral BETWEEN 1.5 AND 5.5 GROUP BY spectrum_id")
def x1_spectrum_cutout(t):
    # the axis is taken to be in nanometres
    cut = sp.cutout(t.spectra, 1.5e-9, 5.5e-9, "nm")
    limits = sp.spectral_limits(cut, unit="nm")
    names = {"a": "ssa_specstart", "b": "ssa_specend", "ext": "ssa_specext", "mid": "ssa_specmid"}
    return limits.select("spectrum_id", *(F.round(F.col(c) * 1e9, 6).alias(n) for n, c in names.items()))


@query("x1_cutout_points", "SELECT spectrum_id, spectral, flux FROM {spectra} s WHERE spectral BETWEEN 3 AND 6")
def x1_cutout_points(t):
    return sp.cutout(t.spectra, 2.9999e-9, 6.0001e-9, "nm").select("spectrum_id", "spectral", "flux")


@query("x2_spectrum_metadata", f"SELECT o_orderkey, {mjd_sql('o_orderdate')} AS date_obs, o_custkey * 7919 % 36000 / 1e2 AS ra FROM orders")
def x2_spectrum_metadata(t):
    rows = t.orders.select("o_orderkey", "o_orderdate", (F.col("o_custkey") * 7919 % 36000 / 100.0).alias("alpha"), F.lit(0.0).alias("delta"))
    made = sp.spectrum_metadata(rows, "o_orderdate", "alpha", "delta")
    return made.select("o_orderkey", F.col("ssa_dateObs").alias("date_obs"), F.col("ssa_location.ra").alias("ra"))


def _wcs_images(t):
    """TAN images: 100 by 80 pixels, scale by the part's size."""
    scale = F.col("p_size") / 1000.0
    return t.images.select(
        "p_partkey", F.lit("2").alias("NAXIS"), F.lit("100").alias("NAXIS1"), F.lit("80").alias("NAXIS2"), F.lit("50.5").alias("CRPIX1"),
        F.lit("40.5").alias("CRPIX2"), F.col("ra").cast("string").alias("CRVAL1"), F.col("dec").cast("string").alias("CRVAL2"),
        (-scale).cast("string").alias("CDELT1"), scale.cast("string").alias("CDELT2"),
        F.when(F.col("p_type") == "PROMO", "RA---SIN").otherwise("RA---TAN").alias("CTYPE1"))


def _tan_sql(ra: str, dec: str) -> tuple[str, str, str]:
    """Pixel x, y and depth of a position on the TAN images, from columns ra, dec (centre) and s (scale)."""
    depth = (f"(sin(radians({dec})) * sin(radians(dec)) + cos(radians({dec})) * cos(radians(dec)) * cos(radians({ra} - ra)))")
    xi = f"degrees(cos(radians({dec})) * sin(radians({ra} - ra)) / {depth})"
    eta = (f"degrees((sin(radians({dec})) * cos(radians(dec)) - cos(radians({dec})) * sin(radians(dec)) * cos(radians({ra} - ra))) / {depth})")
    return f"(50.5 - {xi} / s)", f"(40.5 + {eta} / s)", depth


_TAN_TABLE = "(SELECT p_partkey, ra, dec, p_size / 1e3 AS s FROM {sky_part} s0 WHERE p_type != 'PROMO')"


@query("x3_image_metadata", "SELECT p_partkey, round(p_size / 1e3, 9) AS scale, CASE WHEN p_type = 'PROMO' THEN NULL ELSE round(dec, 6) END AS center_dec, "
                            "p_type != 'PROMO' AS has_footprint FROM {sky_part} s")
def x3_image_metadata(t):
    made = im.with_image_metadata(_wcs_images(t))
    return made.select("p_partkey", F.round(F.col("pixelScale")[1], 9).alias("scale"), F.round("centerDelta", 6).alias("center_dec"),
                       F.col("coverage").isNotNull().alias("has_footprint"))


@query("x3_pixel_round_trip", "SELECT p_partkey, 17.0 AS x, 66.0 AS y FROM {sky_part} s")
def x3_pixel_round_trip(t):
    made = im.with_image_metadata(_wcs_images(t))
    made = made.withColumn("sky", im.pixel_to_sky(17.0, 66.0))
    return made.select("p_partkey", im.sky_to_pixel(F.col("sky.ra"), F.col("sky.dec")).alias("p")).select(
        "p_partkey", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


def _slice_sql() -> str:
    corners = [_tan_sql(f"(ra + {a})", f"(dec + {d})") for a, d in ((-0.1, -0.1), (0.1, -0.1), (0.1, 0.2))]
    low = lambda i, most: f"greatest(1, CAST(floor(least({', '.join(c[i] for c in corners)})) AS BIGINT))"
    high = lambda i, most: f"least({most}, CAST(ceil(greatest({', '.join(c[i] for c in corners)})) AS BIGINT))"
    return (f"SELECT * FROM (SELECT p_partkey, {low(0, 100)} AS x0, {high(0, 100)} AS x1, {low(1, 80)} AS y0, {high(1, 80)} AS y1 FROM {_TAN_TABLE} q) q "
            f"WHERE x0 <= x1 AND y0 <= y1")


@query("x4_pixel_slices", _slice_sql())
def x4_pixel_slices(t):
    made = im.with_image_metadata(_wcs_images(t)).filter("wcs_projection = 'TAN'")
    area = F.array(*(regions.point(F.col("centerAlpha") + a, F.col("centerDelta") + d) for a, d in ((-0.1, -0.1), (0.1, -0.1), (0.1, 0.2))))
    return made.select("p_partkey", im.pixel_slice(area).alias("s")).filter("s IS NOT NULL").select("p_partkey", "s.*")


@query("x5_pixel_cutout", "SELECT y, x - 4 AS x, value, 10 - 4 AS ref FROM (SELECT y, x + 1 AS x, value FROM {pixels} p) q WHERE x BETWEEN 5 AND 20")
def x5_pixel_cutout(t):
    rows = t.pixels.select("y", (F.col("x") + 1).cast("bigint").alias("x"), "value", F.lit(10).alias("ref"))
    cut = px.cut_pixels(rows, {"x": (5, 20)}, {"x": 64}, {"x": "ref"})
    return cut.select("y", "x", "value", F.col("ref").cast("int").alias("ref"))


@query("x5_border_crop", "SELECT y, x, value FROM (SELECT y, x + 1 AS x, value FROM {pixels} p) q WHERE x <= 3")
def x5_border_crop(t):
    rows = t.pixels.select("y", (F.col("x") + 1).cast("bigint").alias("x"), "value")
    return px.cut_pixels(rows, {"x": (-5, 3)}, {"x": 64})


@query("x6_downscale", "SELECT label, bx AS x, bly AS y, round(avg(value), 6) AS value FROM (SELECT label, x // 5 + 1 AS bx, vec_id // 5 + 1 AS bly, value FROM "
                       "(SELECT label, vec_id, unnest(embedding) AS value, generate_subscripts(embedding, 1) - 1 AS x FROM embeddings) p WHERE x < 60 AND "
                       "vec_id < (SELECT (max(vec_id) + 1) // 5 * 5 FROM embeddings)) q GROUP BY label, bx, bly")
def x6_downscale(t):
    rows = t.embeddings.select("label", (F.col("vec_id") + 1).alias("y"), F.posexplode("embedding").alias("p", "value"))
    rows = rows.withColumn("x", (F.col("p") + 1).cast("bigint")).crossJoin(t.embeddings.agg((F.max("vec_id") + 1).alias("h")))
    small = px.downscale(rows, 5, F.lit(64), F.col("h"), key=("label",))
    return small.withColumn("value", F.round("value", 6))


@query("x7_axis_values", "SELECT p_partkey, p_retailprice + (p_size - 3) * 0.25 AS v, CAST(p_size AS DOUBLE) AS back, p_retailprice - 0.5 AS low, "
                         "p_retailprice + (p_size - 3) * 0.25 AS high FROM part WHERE p_size > 3")
def x7_axis_values(t):
    axis = (F.col("p_retailprice"), 3.0, 0.25)
    value = px.pixel_to_value("p_size", *axis)
    limits = px.axis_limits("p_size", *axis)
    return t.part.filter("p_size > 3").select("p_partkey", value.alias("v"), F.round(px.value_to_pixel(value, *axis), 9).alias("back"),
                                              limits["low"].alias("low"), limits["high"].alias("high"))


_LOW, _HIGH = _tan_sql("(ra - 0.25)", "(dec - 0.25)"), _tan_sql("(ra + 0.25)", "(dec + 0.25)")


@query("x8_cutout_estimate", f"SELECT p_partkey, least(16000, CAST(floor(2 * abs({_LOW[0]} - {_HIGH[0]}) * abs({_LOW[1]} - {_HIGH[1]})) AS BIGINT)) AS accsize, "
                             f"round(dec, 6) AS center_dec FROM {_TAN_TABLE} q")
def x8_cutout_estimate(t):
    made = im.with_image_metadata(_wcs_images(t)).filter("wcs_projection = 'TAN'")
    made = made.withColumn("accsize", F.lit(16000).cast("bigint"))
    out = im.cutout_estimate(made, None, None, 0.5, 0.5)
    return out.select("p_partkey", "accsize", F.round("centerDelta", 6).alias("center_dec"))


def _products(t):
    return pr.product_rows(
        t.part, "concat('parts/', p_partkey)", "concat('/data/', p_partkey, '.fits')", F.lit("application/fits"), "p_size * 2048", "part",
        owner="p_brand", embargo=F.when(F.col("p_size") > 40, F.lit("2030-01-01")).cast("date"),
        preview=F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("prev/"), "p_partkey")), preview_mime=F.lit("image/png"))


@query("x9_links", "SELECT 'parts/' || p_partkey AS ID, '#this' AS semantics, CAST(p_size * 2048 AS BIGINT) AS content_length, NULL AS error_message FROM part UNION ALL "
                   "SELECT 'parts/' || p_partkey, '#preview', NULL, NULL FROM part WHERE p_size % 2 = 0 UNION ALL "
                   "SELECT 'parts/' || p_partkey, '#proc', NULL, NULL FROM part UNION ALL "
                   "SELECT DISTINCT 'lost/' || s_suppkey, '#this', CAST(NULL AS BIGINT), 'NotFoundFault: no dataset lost/' || s_suppkey FROM supplier")
def x9_links(t):
    ids = t.part.select(F.concat(F.lit("parts/"), "p_partkey").alias("ID")).unionByName(
        t.supplier.select(F.concat(F.lit("lost/"), "s_suppkey").alias("ID")))
    made = pr.links(ids, _products(t), services={"cut": "soda/cut"})
    return made.select("ID", "semantics", "content_length", "error_message")


def _image_table(t):
    made = im.with_image_metadata(_wcs_images(t))
    return made.join(t.part.select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"), "p_partkey").select(
        F.concat(F.lit("parts/"), "p_partkey").alias("accref"), F.lit("application/fits").alias("mime"), (F.col("p_size") * 2048).alias("accsize"),
        F.col("p_name").alias("imageTitle"), F.col("p_brand").alias("instId"), (F.col("p_retailprice") * 50).alias("dateObs"), "pixelSize", "pixelScale",
        "coverage", "centerAlpha", "centerDelta", (F.col("p_size") * 1e-8).alias("bandpassLo"), (F.col("p_size") * 1.5e-8).alias("bandpassHi"))


def _spectrum_table(t):
    return t.orders.select(
        F.concat(F.lit("spec/"), "o_orderkey").alias("accref"), F.lit("application/x-votable+xml").alias("mime"), F.lit(5000).alias("accsize"),
        F.concat(F.lit("Spectrum of "), "o_orderpriority").alias("ssa_dstitle"), F.concat(F.lit("ivo://x/"), "o_orderkey").alias("ssa_creatorDID"),
        F.concat(F.lit("ivo://p/"), "o_orderkey").alias("ssa_pubDID"), times.mjd("o_orderdate").alias("ssa_dateObs"), F.lit(0.5).alias("ssa_timeExt"),
        F.concat(F.lit("Star "), F.col("o_custkey")).alias("ssa_targname"), F.col("o_orderpriority").alias("ssa_targclass"),
        (F.col("o_totalprice") / 1000).alias("ssa_snr"), F.lit(0.1).alias("ssa_aperture"), F.lit("V").alias("ssa_bandpass"),
        (F.col("o_custkey") * 1e-9).alias("ssa_specstart"), (F.col("o_custkey") * 1e-9 + 1e-8).alias("ssa_specend"),
        F.col("o_orderdate").alias("ssa_pdate"), (F.col("o_custkey") % 7 / 10.0).alias("ssa_redshift"),
        sphere.point(F.col("o_custkey") * 7919 % 36000 / 100.0, F.col("o_custkey") * 104729 % 18001 / 100.0 - 90).alias("ssa_location"),
        (F.col("o_custkey") * 7919 % 36000 / 100.0).alias("ra"), (F.col("o_custkey") * 104729 % 18001 / 100.0 - 90).alias("dec"))


@query("x10_dataset_catalogue", f"SELECT 'image' AS dataproduct_type, p_name AS obs_title, p_size * 1e-8 AS em_min, p_retailprice * 50 AS t_min, "
                                f"CAST(p_size * 2 AS BIGINT) AS access_estsize FROM part UNION ALL SELECT 'spectrum', 'Spectrum of ' || o_orderpriority, "
                                f"o_custkey * 1e-9, {mjd_sql('o_orderdate')} - 0.25, 4 FROM orders")
def x10_dataset_catalogue(t):
    whole = catalogue.dataset_catalogue(catalogue.publish_images(_image_table(t)),
                                        catalogue.publish_spectra(_spectrum_table(t), params={"ssa_collection": "orders"}))
    return whole.select("dataproduct_type", "obs_title", "em_min", "t_min", "access_estsize")


@query("x11_dataset_search", f"SELECT 'spec/' || o_orderkey AS obs_id FROM orders WHERE {mjd_sql('o_orderdate')} - 0.25 < 50400 AND {mjd_sql('o_orderdate')} + 0.25 "
                             f"> 50390 AND o_custkey * 1e-9 < 1.2e-6 AND o_custkey * 1e-9 + 1e-8 > 1.0e-6")
def x11_dataset_search(t):
    whole = catalogue.dataset_catalogue(catalogue.publish_images(_image_table(t)), catalogue.publish_spectra(_spectrum_table(t)))
    found = catalogue.search_datasets(whole, {"TIME": "50390 50400", "BAND": [(1.0e-6, 1.2e-6)], "DPTYPE": "spectrum",
                                              "FORMAT": ["application/x-votable+xml", "image/png"]})
    return found.select("obs_id")


@query("x11_shape_search")
def x11_shape_search(t):
    whole = catalogue.dataset_catalogue(catalogue.publish_images(_image_table(t)))
    found = catalogue.search_datasets(whole, {"POS": ["CIRCLE 264 0 15"], "EXPTIME": None, "FOV": (0.0, 10.0)})
    return found.select("obs_id", F.round("s_ra", 6).alias("s_ra"))


@query("x12_spectrum_search", f"SELECT 'spec/' || o_orderkey AS accref FROM orders WHERE {mjd_sql('o_orderdate')} BETWEEN 50000 AND 50500 AND o_custkey * 1e-9 + 1e-8 "
                              f"> 5e-7 AND o_custkey * 1e-9 < 6e-7 AND o_totalprice / 1000 >= 100 AND lower(o_orderpriority) IN ('1-urgent', '2-high')")
def x12_spectrum_search(t):
    found = sp.search_spectra(_spectrum_table(t), {
        "TIME": "1995-10-10/1997-02-21", "BAND": "5e-7/6e-7", "SNR": "100/", "TARGETCLASS": "1-urgent,2-High", "FORMAT": "compliant",
        "WILDTARGET": "Star *"})
    return found.select("accref")


@query("x12_constant_param", "SELECT 'spec/' || o_orderkey AS accref FROM orders WHERE FALSE")
def x12_constant_param(t):
    return sp.search_spectra(_spectrum_table(t), {"TARGETCLASS": "galaxy"}, constants={"ssa_targclass": "Star"}).select("accref")


@query("x13_line_search", "SELECT p_partkey FROM part WHERE (p_retailprice BETWEEN 905 AND 910 OR p_retailprice >= 980) AND p_brand IN ('Brand#3', 'Brand#4') AND "
                          "p_size <= 30")
def x13_line_search(t):
    lines = t.part.select("p_partkey", F.col("p_retailprice").alias("wavelength"), F.col("p_name").alias("linename"),
                          F.col("p_brand").alias("chemical_element"), F.col("p_size").alias("initial_level_energy"),
                          F.lit(0.0).alias("final_level_energy"))
    return catalogue.search_lines(lines, {"WAVELENGTH": "905/910,980/", "CHEMICAL_ELEMENT": "Brand#3,Brand#4",
                                          "INITIAL_LEVEL_ENERGY": "/30"}).select("p_partkey")


@query("x14_planetary", "SELECT CAST(p_partkey AS BIGINT) AS index_, p_name AS target_name, p_retailprice AS time_min, p_retailprice + 2 AS time_max, "
                        "CAST(p_size * 2 AS BIGINT) AS access_estsize, 'UNKNOWN' AS target_class FROM part")
def x14_planetary(t):
    rows = t.part.withColumns({"accref": F.concat(F.lit("p/"), "p_partkey"), "accsize": F.col("p_size") * 2048})
    made = catalogue.planetary_rows(rows, {"index_": "p_partkey", "target_name": "p_name", "time_": ("p_retailprice", "p_retailprice + 2"),
                                           "c1": "p_size", "spatial_frame_type": F.lit("body")})
    return made.select("index_", "target_name", "time_min", "time_max", "access_estsize", "target_class")


@query("x15_products", "SELECT 'parts/' || p_partkey AS accref, CAST(CASE WHEN p_size > 30 THEN 1 ELSE p_size * 2048 END AS BIGINT) AS accsize FROM part")
def x15_products(t):
    stored = _products(t).withColumn("loaded", F.lit(0))
    fresh = stored.filter(F.col("accsize") > 30 * 2048)
    fresh = fresh.withColumns({"accsize": F.lit(1).cast("bigint"), "loaded": F.lit(1)})
    return pr.merge_products(stored, fresh, "loaded").select("accref", "accsize")


@query("x16_retrieval_plan", "SELECT 'parts/' || o_custkey AS accref, CASE WHEN p_partkey IS NULL THEN 'missing' WHEN p_size > 40 AND p_brand != 'Brand#7' THEN "
                             "'forbidden' ELSE 'ok' END AS status FROM (SELECT DISTINCT o_custkey FROM orders) o LEFT JOIN (SELECT * FROM part WHERE p_size > 5) p "
                             "ON o_custkey = p_partkey")
def x16_retrieval_plan(t):
    import datetime

    wanted = t.orders.select(F.concat(F.lit("parts/"), "o_custkey").alias("accref"))
    known = _products(t).filter(F.col("accsize") > 5 * 2048)
    return pr.retrieval_plan(wanted, known, ["Brand#7"], datetime.date(2025, 1, 1)).select("accref", "status")


@query("x17_changed_records", "SELECT event_id FROM events e WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-06' AND EXISTS (SELECT 1 FROM customer c "
                              "WHERE c.c_custkey = e.user_id AND c_mktsegment = 'BUILDING')")
def x17_changed_records(t):
    sets = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("set_name"))
    found = pr.changed_records(t.events, "ts", "2024-01-03", "2024-01-05", sets, "BUILDING", key=("user_id",))
    return found.select("event_id")


@query("x17_listing_page", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-03T12:00:00' AND event_id > 900 ORDER BY event_id LIMIT 50")
def x17_listing_page(t):
    found = pr.changed_records(t.events, "ts", "2024-01-03T12:00:00")
    return pr.listing_page(found.select("event_id"), "event_id", 50, after=900)


@query("x18_file_jobs", "SELECT CASE WHEN event_type = 'view' THEN 'failed' ELSE 'ok' END AS status, count(DISTINCT event_type) AS kinds, "
                        "CAST(sum(CASE WHEN event_type = 'view' THEN 0 ELSE 1 END) AS BIGINT) AS lines FROM events GROUP BY 1")
def x18_file_jobs(t):
    path = scratch_path(t.spark, "jobs")
    t.events.select(F.col("event_id").cast("string"), "event_type").write.partitionBy("event_type").text(path)

    def job(source):
        from skylattice.sources.ranges import open_input

        if "event_type=view" in source:
            raise ValueError("not this one")
        with open_input(source) as stream:
            return sum(chunk.count(b"\n") for chunk in iter(lambda: stream.read(1 << 20), b""))

    results = filejobs.process_files(files.list_sources(t.spark, path, "part-*"), job)
    kind = F.regexp_extract("path", "event_type=([a-z]+)", 1)
    return results.groupBy("status").agg(F.count_distinct(kind).alias("kinds"), F.coalesce(
        F.sum(F.when(F.col("status") == "ok", F.col("result").cast("bigint"))), F.lit(0)).alias("lines"))


@query("x19_schema_draft", "SELECT count(*) AS n, '  c_custkey bigint' AS second_line FROM customer")
def x19_schema_draft(t):
    path = scratch_path(t.spark, "draft")
    t.customer.select("c_custkey", "c_name").write.option("header", "true").csv(path)
    seen = t.spark.read.option("header", "true").option("inferSchema", "true").csv(path)
    seen = seen.withColumn("c_custkey", F.col("c_custkey").cast("bigint"))
    draft = upload.draft_text(upload.draft_spec(seen, "customers")).split("\n")
    return seen.agg(F.count("*").alias("n")).withColumn("second_line", F.lit(draft[1]))


@query("x20_spectral_slice", "SELECT y, x - 9 AS x, value FROM (SELECT y, x + 1 AS x, value FROM {pixels} p) q WHERE x BETWEEN 10 AND 15")
def x20_spectral_slice(t):
    rows = t.pixels.select("y", (F.col("x") + 1).cast("bigint").alias("x"), "value")
    # plane x is at 400 + (x - 1) * 10 nm
    return px.spectral_cut(rows, "x", 490e-9, 540e-9, "nm", 400.0, 1.0, 10.0, 64)


@query("x21_pixel_ranges", "SELECT y - 99 AS y, x - 2 AS x, value FROM (SELECT y, x + 1 AS x, value FROM {pixels} p) q WHERE x BETWEEN 3 AND 8 AND y BETWEEN 100 AND 120")
def x21_pixel_ranges(t):
    rows = t.pixels.select("y", (F.col("x") + 1).cast("bigint").alias("x"), "value")
    return px.cut_pixels(rows, {"x": (3, 8), "y": (100, 120)}, {"x": 64, "y": 499})


@query("x22_region_cutout")
def x22_region_cutout(t):
    images = im.with_image_metadata(_wcs_images(t)).filter("wcs_projection = 'TAN'")
    pixels = t.embeddings.select(F.col("vec_id").alias("p_partkey"), F.posexplode("embedding").alias("p", "value")).select(
        "p_partkey", (F.col("p") + 1).cast("bigint").alias("x"), (F.col("p") % 80 + 1).cast("bigint").alias("y"), "value")
    cut = px.region_cut(pixels, images.select("p_partkey", "pixelSize", "wcs_refPixel", "wcs_refValues", "wcs_cdmatrix"), "p_partkey",
                        "CIRCLE 264.23 -0.69 8")
    return cut.groupBy("p_partkey").agg(F.count("*").alias("n"))
