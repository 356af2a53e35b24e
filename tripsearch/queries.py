"""The registered queries: each takes a session and a data folder and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripsearch.operators import bounds as B
from tripsearch.operators import curve, enclosed, features, nearest, ordered, outline, pages, similarity, tripcells
from tripsearch.operators import trips as trip_ops
from tripsearch.oracle import DAY_GAP, DELAYED, MONTH_SHIFT, THREE_POINTS, TWO_DAY_GAP
from tripsearch.plans import answers, ingest, search, similar, workload
from tripsearch.sources import positions, requests, tables
from tripsearch.storage import durable, new_folder
from tripsearch.streaming import live

# Query batch over the area of the derived log: (qid, points, day, k). The third query begins inside it and leads out of it.
BATCH = [
    (1, [(121.25, 31.1), (121.4, 31.25), (121.6, 31.35)], None, 2),
    (2, [(121.3, 31.0), (121.32, 31.05)], "2024-01-10", 3),
    (3, [(121.7, 30.95), (121.1, 30.9), (120.5, 30.6)], "2024-01-02", 4),
    (4, [(121.3, 31.0), (121.32, 31.05)], None, 5),
]
SPLIT_BATCH = [
    (5, [(121.05, 30.85), (121.15, 30.95), (121.25, 31.0), (121.35, 31.1), (121.45, 31.2), (121.55, 31.25), (121.65, 31.35), (121.75, 31.45)],
     None, 3),
    (6, [(121.3, 31.2), (121.4, 31.3), (121.35, 31.25), (121.5, 31.1)], None, 5),
]
NEIGHBOURS = 20

_TABLES: dict[tuple, DataFrame] = {}


def _once(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from the data folder, written to the shared folder once per application."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _TABLES:
        _TABLES[key] = build()
    return _TABLES[key]


def kept_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean positions, written once: cutting trips reads them twice with different columns."""
    return _once(spark, ("kept", sf_dir), lambda: durable(clean_points(spark, sf_dir), "kept"))


def clean_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trip_ops.clean_positions(positions.read_events_log(spark, sf_dir))


def trip_points(spark: SparkSession, sf_dir: str, gap: int = DAY_GAP) -> DataFrame:
    """Trip points clustered by day and trip, so a search reads few files and merges early."""
    return _once(spark, ("trips", sf_dir, gap), lambda: durable(
        trip_ops.cut_trips(kept_points(spark, sf_dir), gap)
        .repartitionByRange("day", "trip_id", "seq").sortWithinPartitions("day", "trip_id", "seq"),
        "trips",
    ))


def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, ("density", sf_dir), lambda: durable(
        nearest.cell_counts(trip_points(spark, sf_dir)), "density"))


def query_batch(spark: SparkSession, batch) -> DataFrame:
    rows = [
        f"({qid}, {i}, {x!r}D, {y!r}D, {'null' if day is None else repr(day)}, {k})"
        for qid, points, day, k in batch for i, (x, y) in enumerate(points)
    ]
    return spark.sql(
        "select qid, qseq, qlng, qlat, cast(day as date) as day, k from values "
        + ", ".join(rows) + " as t(qid, qseq, qlng, qlat, day, k)"
    )


def _top_trip(points: DataFrame) -> str:
    """Id of the trip with the most points."""
    catalog = points.groupBy("trip_id").agg(F.count("*").alias("n"))
    return catalog.orderBy(F.desc("n"), "trip_id").first()["trip_id"]


def _scratch(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """Folder of files that a query first writes and then reads back."""
    key = (spark.sparkContext.applicationId, "files", name, sf_dir)
    if key not in _TABLES:
        path = new_folder(spark, name)
        write(path)
        _TABLES[key] = path
    return _TABLES[key]


# --- ingestion -------------------------------------------------------------------------


def gcj_clean(spark, sf_dir):
    return clean_points(spark, sf_dir)


def country_filter(spark, sf_dir):
    raw = positions.read_events_log(spark, sf_dir)
    inside = trip_ops.geo.in_country(F.col("lng"), F.col("lat"))
    return raw.where(inside).select("obd_id", "event_id", "lng", "lat")


def trips(spark, sf_dir):
    cut = trip_ops.cut_trips(kept_points(spark, sf_dir), DAY_GAP)
    return cut.select("trip_id", "r", "seq", "event_id", "lng", "lat")


def trips_short_gap(spark, sf_dir):
    cut = trip_ops.cut_trips(kept_points(spark, sf_dir))
    return cut.select("trip_id", "r", "seq", "event_id", "day")


def trip_catalog(spark, sf_dir):
    return trip_ops.trip_catalog(trip_points(spark, sf_dir))


def trip_day(spark, sf_dir):
    catalog = trip_ops.trip_catalog(trip_points(spark, sf_dir))
    return catalog.groupBy("day").agg(F.count("*").alias("trips"), F.sum("n").alias("points"))


def known_users(spark, sf_dir):
    users = positions.read_events_log(spark, sf_dir).select("obd_id").distinct()
    return trip_ops.known_users(users, trip_points(spark, sf_dir))


def user_trips(spark, sf_dir):
    points = trip_points(spark, sf_dir)
    first_user = points.agg(F.min("obd_id")).first()[0]
    return tables.user_trips(trip_ops.trip_catalog(points), first_user)


def trip_fetch(spark, sf_dir):
    points = trip_points(spark, sf_dir)
    return tables.fetch_trip(points, _top_trip(points))


def trip_polylines(spark, sf_dir):
    lines = trip_ops.trip_polyline(trip_points(spark, sf_dir))
    first = F.when(F.col("block") == 0, F.get("path", F.lit(0))["lng"])
    return lines.groupBy("trip_id").agg(
        F.sum(F.size("path")).alias("n"), F.round(F.max(first), 6).alias("first_lng")
    )


def _ingested(spark, sf_dir, gap) -> ingest.TripTables:
    raw = positions.read_events_log(spark, sf_dir)
    return ingest.TripTables(
        _scratch(spark, sf_dir, f"ingest-{gap}", lambda path: ingest.ingest(raw, path, gap))
    )


def kept_by_month(spark, sf_dir):
    kept = _ingested(spark, sf_dir, TWO_DAY_GAP).read_kept(spark)
    return kept.groupBy(F.col("month").cast("string").alias("month")).agg(
        F.count("*").alias("points"), F.count_distinct("obd_id").alias("users")
    )


def simplified_by_day(spark, sf_dir):
    points = _ingested(spark, sf_dir, TWO_DAY_GAP).read_simplified(spark, "shanghai")
    return points.groupBy(F.col("city").cast("string").alias("city"), "day").agg(
        F.count("*").alias("points"), F.count_distinct("trip_id").alias("trips")
    )


def ingest_two_cities(spark, sf_dir):
    """The log ingested for one city, then for a second one into the same folder."""
    raw = positions.read_events_log(spark, sf_dir)

    def write(path):
        for city in ("shanghai", "pudong"):
            ingest.ingest(raw, path, TWO_DAY_GAP, city_name=city)

    folder = _scratch(spark, sf_dir, "ingest-cities", write)
    points = ingest.TripTables(folder).read_simplified(spark)
    return points.groupBy(F.col("city").cast("string").alias("city"), "day").agg(
        F.count("*").alias("points"), F.count_distinct("trip_id").alias("trips")
    )


def _two_months(spark, sf_dir) -> ingest.TripTables:
    """The log moved to lie over the end of a month, ingested month by month into one folder."""
    raw = positions.read_events_log(spark, sf_dir).withColumn("ts", F.col("ts") + F.expr(f"interval {MONTH_SHIFT} days"))

    def write(path):
        for month in raw.select(F.date_format("ts", "yyyy-MM").alias("month")).distinct().orderBy("month").collect():
            ingest.ingest(raw.where(F.date_format("ts", "yyyy-MM") == month["month"]), path, TWO_DAY_GAP)

    return ingest.TripTables(_scratch(spark, sf_dir, "ingest-months", write))


def ingest_two_months(spark, sf_dir):
    """Every trip of the two months: its day, its points, and how many of them simplification keeps."""
    out = _two_months(spark, sf_dir)
    whole = out.read_by_user(spark).groupBy("trip_id", "obd_id", "r", "day").agg(F.count("*").alias("points"), F.max("seq").alias("last_seq"))
    kept = out.read_simplified(spark).groupBy("trip_id").agg(F.count("*").alias("kept"))
    return whole.join(kept, "trip_id", "left")


def kbct_ingested(spark, sf_dir):
    """The best connected trips among the simplified trips of both months, read as searches read them."""
    return similarity.best_connected(_two_months(spark, sf_dir).read_simplified(spark, "shanghai"), THREE_POINTS, 5)


def point_index(spark, sf_dir):
    points = trip_points(spark, sf_dir).drop("event_id")
    path = _scratch(spark, sf_dir, "point-index", lambda p: tables.write_point_index(points, p))
    return tables.read_day(spark, path).groupBy("day", "cx", "cy").agg(F.count("*").alias("n"))


def _write_raw_log(spark, sf_dir, path, spoil: bool = False) -> None:
    """The derived log as headerless CSV; spoilt, every fifth event lacks a field or has an unreadable one."""
    field = {"user": F.col("obd_id"), "lng": F.col("lng").cast("string"), "time": F.date_format("ts", "yyyy-MM-dd HH:mm:ss")}
    if spoil:
        turn = F.col("event_id") % 25
        field["user"] = F.when(turn != 0, field["user"])
        field["lng"] = F.when(turn == 5, "12l.4").when(turn != 10, field["lng"])
        field["time"] = F.when(turn == 15, F.concat(F.lit("at "), field["time"])).when(turn != 20, field["time"])
    filler = F.lit("0")
    positions.read_events_log(spark, sf_dir).select(
        F.col("event_id"), filler, field["user"], field["lng"], F.col("lat"), filler, filler, filler, field["time"],
    ).toDF(*[f"c{i}" for i in range(9)]).write.csv(path)


def raw_csv_scan(spark, sf_dir):
    path = _scratch(spark, sf_dir, "raw-log", lambda p: _write_raw_log(spark, sf_dir, p))
    return positions.read_raw_log(spark, path).select("obd_id", F.unix_timestamp("ts").alias("epoch"), "lng", "lat")


def raw_log_rejects(spark, sf_dir):
    """Lines of a spoilt log by what is wrong with them (null: nothing), with the first and the last event."""
    path = _scratch(spark, sf_dir, "spoilt-log", lambda p: _write_raw_log(spark, sf_dir, p, spoil=True))
    event = F.get("fields", F.lit(0)).cast("bigint")
    return positions.read_raw_lines(spark, path).groupBy("reason").agg(
        F.count("*").alias("lines"), F.min(event).alias("first_event"), F.max(event).alias("last_event")
    )


def request_decode(spark, sf_dir):
    chunk = F.floor(F.col("seq") / 75).cast("bigint")
    paths = trip_points(spark, sf_dir).groupBy("trip_id", "r", chunk.alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("seq", "lng", "lat"))).alias("path")
    )
    as_object = F.col("r") % 2 == 0
    sent = paths.select(
        F.concat("trip_id", F.lit("#"), F.col("chunk").cast("string")).alias("req_id"),
        F.when(as_object, "p").otherwise("t").alias("kind"),
        F.when(as_object, requests.object_body(F.col("path"))).otherwise(requests.array_body(F.col("path"))).alias("body"),
    )
    return requests.decode_requests(sent).withColumn("qseq", F.col("qseq").cast("bigint"))


# --- features and simplification ---------------------------------------------------------


def path_length(spark, sf_dir):
    return features.path_lengths(trip_points(spark, sf_dir)).withColumn("length_m", F.round("length_m", 4))


def headings(spark, sf_dir):
    found = features.chunk_features(trip_points(spark, sf_dir, TWO_DAY_GAP))
    return found.select(
        "trip_id", "seq", "chunk",
        *[F.round(name, 6).alias(name) for name in ("heading", "nhc", "ahc", "hc")],
        F.round("nd", 4).alias("nd"),
    )


def segment_weights(spark, sf_dir):
    weighed = features.segment_weights(features.chunk_features(trip_points(spark, sf_dir, TWO_DAY_GAP)))
    return weighed.where(F.col("pos_in_seg") == 1).select(
        "trip_id", "chunk", "segment", F.round("seg_w", 9).alias("seg_w"), "headcount"
    )


def ts_simplify(spark, sf_dir):
    kept = features.simplify_trips(trip_points(spark, sf_dir, TWO_DAY_GAP))
    return kept.select("trip_id", "day", "seq", "lng", "lat")


def ts_simplify_intended(spark, sf_dir):
    """The rates as published, heading changes within half a turn."""
    kept = features.simplify_trips(trip_points(spark, sf_dir, TWO_DAY_GAP), rate="intended", wrap=True)
    return kept.select("trip_id", "day", "seq", "lng", "lat")


def dp_simplify(spark, sf_dir):
    points = trip_points(spark, sf_dir, TWO_DAY_GAP)
    kept = outline.outline_trips(points)
    return kept.select("trip_id", "seq", "lng", "lat")


def trip_length_hist(spark, sf_dir):
    return workload.trips_by_length(trip_ops.trip_catalog(trip_points(spark, sf_dir)))


# --- searches ------------------------------------------------------------------------------


def trip_similarity(spark, sf_dir):
    scores = similarity.trip_similarity(trip_points(spark, sf_dir), THREE_POINTS)
    return scores.withColumn("sim", F.round("sim", 9))


def kbct(spark, sf_dir):
    return similarity.best_connected(trip_points(spark, sf_dir), THREE_POINTS, 5)


def kbct_batch(spark, sf_dir):
    return search.best_connected_batch(trip_points(spark, sf_dir), query_batch(spark, BATCH))


def kbct_pruned(spark, sf_dir):
    return search.best_connected_pruned(
        trip_points(spark, sf_dir), query_batch(spark, BATCH), density(spark, sf_dir)
    )


def kbct_lambda(spark, sf_dir):
    return search.best_connected_lambda(
        trip_points(spark, sf_dir), query_batch(spark, BATCH), density(spark, sf_dir)
    )


def kbct_raw_points(spark, sf_dir):
    points = trip_points(spark, sf_dir)
    simplified = _once(spark, ("simplified", sf_dir), lambda: durable(features.simplify_trips(points), "simplified"))
    best = similarity.best_connected(simplified, THREE_POINTS, 3)
    return search.attach_points(best, points)


def kbct_split(spark, sf_dir):
    return search.best_connected_split(trip_points(spark, sf_dir), query_batch(spark, SPLIT_BATCH), 2)


def kbct_by_trip(spark, sf_dir):
    points = trip_points(spark, sf_dir)
    return similar.best_connected_to_trip(
        points, _top_trip(points), counts=density(spark, sf_dir)
    )


def _asked(spark, lam=None) -> DataFrame:
    """The literal batch with the number of neighbours to fetch, written as a small table."""
    lam = F.col("k") if lam is None else F.lit(lam)
    return _once(spark, ("asked", str(lam)), lambda: durable(
        query_batch(spark, BATCH).withColumn("lam", lam).withColumn("prev", F.lit(0)), "asked"))


def _near(spark, sf_dir, lam=NEIGHBOURS) -> DataFrame:
    return nearest.nearest_points(trip_points(spark, sf_dir), _asked(spark, lam), density(spark, sf_dir))


def knn_points(spark, sf_dir):
    return _near(spark, sf_dir).select("qid", "qseq", "nn", "trip_id", "seq", F.round("d", 9).alias("d"))


def range_join(spark, sf_dir):
    asked = _asked(spark, NEIGHBOURS).withColumn("radius", F.lit(5e-2))
    pairs = nearest.within_radius(trip_points(spark, sf_dir), asked)
    return pairs.select("qid", "qseq", "trip_id", "seq", F.round("d", 9).alias("d"))


def range_indexed(spark, sf_dir):
    """As ``range_join``, read from the table in Z-order."""
    points = trip_points(spark, sf_dir).drop("event_id")
    path = _scratch(spark, sf_dir, "curve-index", lambda p: tables.write_curve_index(points, p))
    asked = query_batch(spark, BATCH).withColumn("radius", F.lit(5e-2))
    pairs = curve.within_radius(tables.read_day(spark, path), asked)
    return pairs.select("qid", "qseq", "trip_id", "seq", F.round("d", 9).alias("d"))


def knn_indexed(spark, sf_dir):
    """As ``knn_points``, read from packed pages through their directory."""
    points = trip_points(spark, sf_dir).drop("event_id")
    path = _scratch(spark, sf_dir, "page-index", lambda p: tables.write_page_index(points, p))
    found = pages.nearest_points(*tables.read_page_index(spark, path), _asked(spark, NEIGHBOURS))
    return found.select("qid", "qseq", "nn", "trip_id", "seq", F.round("d", 9).alias("d"))


def candidates(spark, sf_dir):
    return B.candidates(B.scanned_trips(_near(spark, sf_dir)))


def _bounds(spark, sf_dir):
    found = _near(spark, sf_dir)
    return B.similarity_bounds(B.scanned_trips(found), B.look_radii(found))


def lower_bound(spark, sf_dir):
    return _bounds(spark, sf_dir).select("qid", "trip_id", "seen", F.round("lb", 9).alias("lb"))


def upper_bound(spark, sf_dir):
    return _bounds(spark, sf_dir).select("qid", "trip_id", F.round("ub", 9).alias("ub"))


def kth_lower_bound(spark, sf_dir):
    batch = _asked(spark, NEIGHBOURS).select("qid", "k").distinct()
    kth = B.kth_lower_bound(_bounds(spark, sf_dir), batch, max(k for *_, k in BATCH))
    return kth.withColumn("kth_lb", F.round("kth_lb", 9))


def ub_unscanned(spark, sf_dir):
    return B.unseen_bound(B.look_radii(_near(spark, sf_dir))).withColumn("ub_ns", F.round("ub_ns", 9))


def lambda_budget(spark, sf_dir):
    state = _asked(spark)
    found = nearest.nearest_points(trip_points(spark, sf_dir), state, density(spark, sf_dir))
    grown = B.next_budgets(state.select("qid", "qseq", "k", "lam", "prev"), B.look_radii(found), 1)
    return grown.withColumn("lam", F.col("lam").cast("int"))


# --- order-aware measures and distances -------------------------------------------------------


def _measure(measure: str):
    def query(spark, sf_dir):
        found = similar.scores(
            trip_points(spark, sf_dir), THREE_POINTS, measure
        )
        return found.select("trip_id", F.round("value", 9).alias("value"))

    return query


def trip_cells(spark, sf_dir) -> DataFrame:
    """Cells of every trip, kept beside the points."""
    return _once(spark, ("trip-cells", sf_dir), lambda: durable(tripcells.trip_cells(trip_points(spark, sf_dir)), "trip-cells"))


def _top(measure: str):
    def query(spark, sf_dir):
        cells = None if measure == "edwp" else trip_cells(spark, sf_dir)
        return similar.top_by_measure(trip_points(spark, sf_dir), THREE_POINTS, 20, measure, cells)

    return query


def _by_trip(measure: str):
    """The trip with the most points as the query, whole."""

    def query(spark, sf_dir):
        points = trip_points(spark, sf_dir)
        return similar.top_by_trip(points, _top_trip(points), 20, measure)

    return query


def ordered_bounds(spark, sf_dir):
    found = _near(spark, sf_dir)
    low_high = ordered.ordered_bounds(found, _asked(spark, NEIGHBOURS))
    return low_high.select("qid", "trip_id", F.round("lb", 9).alias("lb"), F.round("ub", 9).alias("ub"))


def ordered_enclosed(spark, sf_dir):
    """Bounds that always enclose the ordered measure of the trips reached."""
    limits = enclosed.enclosing_bounds(_near(spark, sf_dir), _asked(spark, NEIGHBOURS))
    return limits.select("qid", "trip_id", F.round("lb", 9).alias("lb"), F.round("ub", 9).alias("ub"))


def ordered_batch(spark, sf_dir):
    """The k best trips by the ordered measure of every query of the batch, found from the trips near its points."""
    queries = _asked(spark).drop("lam", "prev")
    return similar.best_ordered_batch(trip_points(spark, sf_dir), queries, density(spark, sf_dir))


# --- workloads and streams ----------------------------------------------------------------------


def query_sample(spark, sf_dir):
    catalog = trip_ops.trip_catalog(trip_points(spark, sf_dir))
    return workload.sample_queries(catalog, list(range(2, 11)), 10)


def answer_requests(spark, sf_dir):
    """Sampled trips sent as JSON requests of both kinds; the answers read back from their bodies."""
    points = trip_points(spark, sf_dir)
    sample = durable(workload.sample_queries(trip_ops.trip_catalog(points), [3, 4, 5], 2), "requests-sample")
    paths = points.join(sample.select("trip_id", "n", "pick"), "trip_id").groupBy("trip_id", "n", "pick", "day").agg(
        F.array_sort(F.collect_list(F.struct("seq", "lng", "lat"))).alias("path"))
    as_object, odd = F.col("pick") == 1, F.col("n") % 2 == 1
    sent = durable(paths.select(
        F.col("trip_id").alias("req_id"), F.when(as_object, "p").otherwise("t").alias("kind"),
        F.when(as_object, requests.object_body(F.col("path"))).otherwise(requests.array_body(F.col("path"))).alias("body"),
        F.when(odd, F.col("day")).alias("day"), F.lit(3).alias("k"),
    ), "requests")
    answers_found = answers.answer_requests(points, sent, density(spark, sf_dir))
    read = F.from_json("body", "trip_id string, points array<array<double>>")
    return answers_found.withColumn("read", read).select(
        "req_id", "rank", F.col("read.trip_id").alias("trip_id"), F.round("sim", 9).alias("sim"), F.size("read.points").cast("bigint").alias("n"),
        F.round(F.col("read.points")[0][0], 6).alias("first_lng"),
    )


def kbct_accuracy(spark, sf_dir):
    points = trip_points(spark, sf_dir)
    queries = durable(workload.queries_from_sample(points, query_sample(spark, sf_dir), 10, 8), "workload")
    found = workload.accuracy(points, queries, [3, 4, 5, 6, 7, 8], density(spark, sf_dir))
    return found.withColumn("accuracy", F.round("accuracy", 6)).withColumn("mean_sim", F.round("mean_sim", 6))


def stream_trip_summary(spark, sf_dir):
    """All trips of the feed: those that are closed and, from the stream's state, those still open."""
    trips_now = live.summarize_trips(live.position_stream(spark, sf_dir))
    found = trips_now.closed(spark).unionByName(trips_now.open(spark))
    naive = [F.col(name).cast("timestamp_ntz").alias(name) for name in ("first_ts", "last_ts")]
    return found.select("obd_id", *naive, "n")


def _feed(spark, sf_dir) -> str:
    """The events as a feed of four files, eight days each; some points are sent with the last one only."""

    def write(path):
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        part = F.when(F.col("event_id") % DELAYED == 0, 3).otherwise(F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3)))
        for i in range(4):
            events.where(part == i).coalesce(1).write.mode("append").parquet(path)

    return _scratch(spark, sf_dir, "feed", write)


def stream_numbering(spark, sf_dir):
    """Points of four micro-batches, numbered; points older than their user's last one come out as late."""
    path = live.number_points(live.folder_stream(spark, _feed(spark, sf_dir)), DAY_GAP)
    numbered = spark.read.parquet(f"{path}/points").select("obd_id", "event_id", "r", "seq", F.lit(False).alias("late"))
    late = spark.read.parquet(f"{path}/late")
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("r", "int"), ("seq", "bigint"))]
    return numbered.unionByName(late.select("obd_id", "event_id", *nothing, F.lit(True).alias("late")))


def stream_index(spark, sf_dir):
    path = live.append_index(live.table_stream(trip_points(spark, sf_dir)).drop("event_id"))
    return tables.read_day(spark, path).groupBy("day", "cx", "cy").agg(F.count("*").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        gcj_clean, country_filter, trips, trips_short_gap, trip_catalog, trip_day, known_users, user_trips,
        trip_fetch, trip_polylines, kept_by_month, simplified_by_day, ingest_two_cities, ingest_two_months, kbct_ingested, point_index, raw_csv_scan, raw_log_rejects,
        request_decode, path_length, headings, segment_weights, ts_simplify, ts_simplify_intended, dp_simplify, trip_length_hist,
        trip_similarity, kbct, kbct_batch, kbct_pruned, kbct_lambda, kbct_raw_points, kbct_split, kbct_by_trip, knn_points,
        range_join, range_indexed, knn_indexed, candidates, lower_bound, upper_bound, kth_lower_bound, ub_unscanned, lambda_budget,
        ordered_bounds, ordered_enclosed, ordered_batch, query_sample, kbct_accuracy, answer_requests, stream_trip_summary, stream_numbering, stream_index,
    )
} | {
    "sim_ordered": _measure("ordered"),
    "sim_ordered_rec": _measure("ordered_reuse"),
    "sim_ordered_dp": _measure("ordered_dp"),
    "sim_ordered_par": _measure("ordered_all"),
    "lcss": _measure("lcss"),
    "ordered_topk": _top("ordered"),
    "lcss_topk": _top("lcss"),
    "edwp": _measure("edwp"),
    "edwp_topk": _top("edwp"),
    "ordered_by_trip": _by_trip("ordered"),
    "lcss_by_trip": _by_trip("lcss"),
    "edwp_by_trip": _by_trip("edwp"),
}
