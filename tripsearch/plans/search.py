"""k best-connected trips for batches of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripsearch.functions import geo
from tripsearch.operators import bounds as B
from tripsearch.operators import nearest as N
from tripsearch.operators import similarity as S
from tripsearch.storage import bounded_rows, durable

WIDE_POINTS = 96  # one min() column each, within what whole-stage code generation takes
QUERY_SCHEMA = "qid int, qseq int, qlng double, qlat double, day string, k int"
SEED_FACTOR = 4
WAVE = 4096  # survivors of a query that are scored first; fewer cost no less
SLACK = 1e-8  # sums differ in the last digits with the order of addition


def on_asked_days(points: DataFrame, queries: DataFrame) -> DataFrame:
    """The points of the days that the queries ask for; all if one asks for any day. The days are a small table, so partitions are pruned at run time."""
    if not queries.where(F.col("day").isNull()).isEmpty():
        return points
    return points.join(durable(queries.select("day").distinct(), "days"), "day", "left_semi")


def exact_scores(points: DataFrame, pairs: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, trip_id, sim) of the listed (qid, trip_id) pairs only."""
    away = geo.squared_degrees(F.col("lng"), F.col("lat"), F.col("qlng"), F.col("qlat"))
    return (
        points.select("trip_id", "lng", "lat")
        .join(pairs, "trip_id")
        .join(queries.select("qid", "qseq", "qlng", "qlat"), "qid")
        .groupBy("qid", "trip_id", "qseq").agg(F.min(away).alias("d2"))
        .groupBy("qid", "trip_id").agg(F.sum(geo.closeness(F.sqrt("d2"))).alias("sim"))
    )


def _looks(found: DataFrame, state: DataFrame) -> DataFrame:
    """How far each query point has looked: (qid, qseq, r, returned, all_seen)."""
    return (
        B.look_radii(found).join(state.select("qid", "qseq", "lam"), ["qid", "qseq"])
        .withColumn("all_seen", F.col("returned") < F.col("lam")).drop("lam")
    )


def _floors(points: DataFrame, queries: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(qid, qseq, qlng, qlat, day, k, tau, radius) of the query points, and the (qid, trip_id) pairs of queries that have seen all there is.

    tau is the k-th best similarity among trips passing close to the query points: any k trips give a floor for the k-th best answer, and
    near trips give a high one. Query point i has a trip at distance d_i at the nearest, worth e_i = exp(-d_i). A trip
    with similarity tau must earn the share tau / sum(e) of its best worth at some query point, so it comes within
    d_i + ln(sum(e) / tau) of that one: the radius of each query point.

    Few nearest points may all lie on one trip, so queries short of k trips ask for more points until they have k
    trips or have seen all points there are; then those trips are the answer, and radius is NULL.
    """
    asked = queries.withColumn("lam", (F.col("k") * SEED_FACTOR).cast("bigint"))
    ready, complete = [], []
    while True:
        found = durable(N.nearest_points(points, asked, counts), "seeds")
        nearest = found.groupBy("qid", "qseq").agg(F.min("d").alias("nearest"), F.count("*").alias("returned"))
        batch = queries.select("qid", "k").distinct()
        sims = S.rank_within(exact_scores(points, found.select("qid", "trip_id").distinct(), queries).join(batch, "qid"), ["qid"])
        tau = sims.groupBy("qid").agg(F.max(F.when(F.col("rank") == F.col("k"), F.col("sim"))).alias("tau"))
        of_query = Window.partitionBy("qid")
        near = F.sum(geo.closeness(F.col("nearest"))).over(of_query)
        state = durable(
            asked.join(nearest, ["qid", "qseq"], "left").join(tau, "qid", "left")
            .withColumn("all_seen", F.min(F.coalesce(F.col("returned"), F.lit(0)) < F.col("lam")).over(of_query))
            .withColumn("radius", F.col("nearest") + F.greatest(F.log(near / (F.col("tau") - SLACK)), F.lit(0.0)) + SLACK), "floors",
        )
        ready.append(state.where(F.col("tau").isNotNull()).drop("lam", "nearest", "returned", "all_seen"))
        whole = state.where(F.col("tau").isNull() & F.col("all_seen")).select("qid").distinct()
        complete.append(found.select("qid", "trip_id").distinct().join(whole, "qid", "left_semi"))
        short = state.where(F.col("tau").isNull() & ~F.col("all_seen"))
        if short.isEmpty():
            floors = ready[0] if len(ready) == 1 else durable(reduce(DataFrame.unionByName, ready), "asked")
            return floors, reduce(DataFrame.unionByName, complete)
        asked = durable(short.select(*queries.columns, (F.col("lam") * SEED_FACTOR).alias("lam")), "seeds-more")


def _refined(points: DataFrame, survivors: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, trip_id, sim) of the survivors (qid, trip_id, k, ub) that may be among the k best.

    They are scored in waves of falling upper bound, each twice as long as the one before. A query is through when its k-th
    score is no less than the next bound, so the points of the rest are never read.
    """
    by_bound = Window.partitionBy("qid").orderBy(F.desc("ub"), "trip_id")
    pending = durable(survivors.withColumn("turn", F.row_number().over(by_bound)), "survivors")
    longest, width = pending.agg(F.max("turn"), F.max("k")).first()
    low, high = 0, max(WAVE, width or 0)
    scored = []
    while True:
        wave = pending.where((F.col("turn") > low) & (F.col("turn") <= high)).select("qid", "trip_id")
        scores = exact_scores(points, wave, queries)
        if high >= (longest or 0):
            scored.append(scores)
            return reduce(DataFrame.unionByName, scored)
        scored.append(durable(scores, "wave"))
        so_far = reduce(DataFrame.unionByName, scored).join(pending.select("qid", "k").distinct(), "qid")
        kth = S.rank_within(so_far, ["qid"], limit=width).where(F.col("rank") == F.col("k")).select("qid", F.col("sim").alias("kth"))
        rest = pending.where(F.col("turn") > high).join(kth, "qid", "left")
        pending = durable(rest.where(F.col("kth").isNull() | (F.col("ub") >= F.col("kth") - SLACK)).drop("kth"), "survivors")
        longest = pending.agg(F.max("turn")).first()[0]
        if longest is None:
            return reduce(DataFrame.unionByName, scored)
        low, high = high, 2 * high


def pruned_survivors(points: DataFrame, queries: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(qid, trip_id, k, ub) of every trip that may be among the k best, and (qid, trip_id) of queries whose answer is all they have seen."""
    floors, complete = _floors(points, queries, counts)
    scanned = B.scanned_trips(N.within_radius(points, floors.drop("k", "tau")))
    limits = B.similarity_bounds(scanned, floors.select("qid", "qseq", F.col("radius").alias("r")))
    taus = floors.select("qid", "k", "tau").distinct()
    return limits.join(taus, "qid").where(F.col("ub") >= F.col("tau") - SLACK).select("qid", "trip_id", "k", "ub"), complete


def best_connected_pruned(points: DataFrame, queries: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Exact k best-connected trips of every query, looking only near the query points.

    A floor of the k-th best similarity gives every query point a radius that finds every candidate in one equi-join on
    cells. Candidates whose upper bound stays under the floor are dropped, the rest are scored exactly in waves.
    """
    queries = durable(queries, "queries")
    if counts is None:
        counts = durable(N.cell_counts(points), "cell-counts")
    points = on_asked_days(points, queries)
    survivors, complete = pruned_survivors(points, queries, counts)
    scores = _refined(points, survivors, queries).unionByName(exact_scores(points, complete, queries))
    return _best(scores, queries)


def best_connected_lambda(points: DataFrame, queries: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """The same answer, growing the number of nearest points per query point round by round.

    Every round fetches ``lam`` nearest points per query point and bounds the trips seen. A
    query is settled when its k-th lower bound reaches what any unseen trip could have; the
    others grow each point's share by how its tail decays and how much it brought.
    """
    queries = durable(queries, "queries")
    if counts is None:
        counts = durable(N.cell_counts(points), "cell-counts")
    points = on_asked_days(points, queries)
    batch = queries.select("qid", "k").distinct()
    state = queries.withColumn("lam", F.col("k").cast("bigint")).withColumn("prev", F.lit(0).cast("bigint"))
    kept, round_no = [], 0
    while True:
        state = durable(state, "budgets")
        largest_k = state.agg(F.max("k")).first()[0]
        if largest_k is None:
            break
        found = durable(N.nearest_points(points, state, counts), "nearest")
        looks = _looks(found, state)
        limits = B.similarity_bounds(B.scanned_trips(found), looks)
        kth = B.kth_lower_bound(limits, batch, largest_k)
        settled = durable(B.settled_queries(looks, kth), "settled")
        kept.append(B.refine_survivors(limits.join(settled.select("qid"), "qid", "left_semi"), settled))
        round_no += 1
        open_state = state.join(settled, "qid", "left_anti")
        grown = B.next_budgets(open_state, looks, round_no).select("qid", "qseq", "prev", "lam")
        state = open_state.drop("prev", "lam").join(grown, ["qid", "qseq"])
    pairs = queries.select("qid", F.lit("").alias("trip_id")).where(F.lit(False))
    for more in kept:
        pairs = pairs.unionByName(more)
    return _ranked(points, durable(pairs, "survivors"), queries)


def _ranked(points: DataFrame, pairs: DataFrame, queries: DataFrame) -> DataFrame:
    return _best(exact_scores(points, pairs, queries), queries)


def _best(scores: DataFrame, queries: DataFrame) -> DataFrame:
    scores = scores.join(queries.select("qid", "k").distinct(), "qid")
    largest = queries.agg(F.max("k")).first()[0] or 0  # a constant limit: each task ranks no more than that
    return S.rank_within(scores, ["qid"], limit=largest).where(F.col("rank") <= F.col("k")).select("qid", "rank", "trip_id", "sim")


def best_connected_points(
    points: DataFrame, query: list[tuple[float, float]], k: int, day=None, counts: DataFrame | None = None
) -> DataFrame:
    """(trip_id, sim) of the k best trips for one list of points of any length."""
    if len(query) <= WIDE_POINTS:
        return S.best_connected(points, query, k, day)
    rows = [(0, i, float(x), float(y), day, k) for i, (x, y) in enumerate(query)]
    table = points.sparkSession.createDataFrame(rows, QUERY_SCHEMA).withColumn("day", F.col("day").cast("date"))
    return best_connected_pruned(points, table, counts).orderBy("rank").select("trip_id", "sim")


def best_connected_batch(
    points: DataFrame, queries: DataFrame, wide_points: int = WIDE_POINTS, counts: DataFrame | None = None
) -> DataFrame:
    """(qid, rank, trip_id, sim) for a table of queries, each with its own day and k.

    Up to ``wide_points`` query points ride along one scan as columns; a larger batch goes
    through the ring search, which pairs points and queries only where they are near.
    """
    rows = bounded_rows(queries.orderBy("qid", "qseq"), wide_points)
    if not rows:  # too many, or none at all
        return best_connected_pruned(points, queries, counts)
    scores = S.batch_similarity_wide(points, rows, ["qid"])
    largest_k = max(row["k"] for row in rows)
    return (
        S.rank_within(scores, ["qid"], limit=largest_k)
        .where(F.col("rank") <= F.col("k"))
        .select("qid", "rank", "trip_id", "sim")
    )


def best_connected_split(points: DataFrame, queries: DataFrame, parts: int, limit: int | None = None) -> DataFrame:
    """Deal each query's points to ``parts`` sub-queries, take k trips of each, add up by trip.

    Approximate by design: a trip outside the top k of a part adds nothing for that part.
    """
    part = F.pmod(F.col("qseq"), F.lit(parts)).cast("int")
    dealt = queries.withColumn("whole", F.col("qid")).withColumn("qid", F.col("qid") * parts + part)
    answers = best_connected_batch(points, dealt)
    merged = S.merge_parts(answers.withColumn("qid", F.floor(F.col("qid") / parts).cast("int")))
    return S.rank_within(merged, ["qid"], limit=limit).select("qid", "rank", "trip_id", "sim")


def attach_points(results: DataFrame, points: DataFrame) -> DataFrame:
    """The unsimplified points of the result trips, in rows (results.., seq, lng, lat)."""
    return results.join(points.select("trip_id", "seq", "lng", "lat"), "trip_id")
