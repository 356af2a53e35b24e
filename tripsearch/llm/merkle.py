"""A Merkle manifest of a table of documents, and the proof of every row by a recursive query.

Every row is a leaf. Per source, and then over the sources, runs of three nodes become one until one is left. Node rows
are stored with a link to the node ``STEP`` levels above them (their parent in a tree of runs of 81), what that node's hash
is, and the siblings met on the way. A Spark recursive query climbs from every leaf: each turn joins the nodes reached with their
rows, appends the siblings as a row of the climb and folds the leaf's hash. A leaf is verified if the fold ends in the root.

A source may hold any share of the rows: leaves are numbered by range partitions, groups are runs of at most 81 nodes, and
the few nodes that very many leaves pass are stored in ``COPIES`` copies, of which each leaf follows one.

Defined results: a null of any column is ``-``, so rows that differ in null and ``-`` or an empty text have other
leaves. Rows of one source and id are ordered by leaf. A null id comes first and is never tampered with. Extra columns play no part.
An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripsearch.llm.ranks import numbered
from tripsearch.storage import durable, new_folder

#: Nodes that become one.
RUN = 3
#: Levels between a node row and its parent's, and the nodes below one of them.
STEP = 4
FAN = RUN**STEP
#: Copies of a node that more than FAN * FAN leaves may pass.
COPIES = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = -1


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def _field(value: Column) -> Column:
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf_hash(columns: dict[str, Column]) -> Column:
    """The hash (lowercase hex) of a row's fields in their order."""
    return digest(F.concat(*[_field(c) for c in columns.values()]))


def _applies(level: int) -> Column:
    """Whether nodes of that level below ``n`` nodes are still to be joined."""
    return F.ceil(F.col("n") / RUN**level) > 1


def _joined(hashes: Column) -> Column:
    last = (F.size(hashes) - 1 - F.pmod(F.size(hashes) - 1, F.lit(RUN))) / RUN
    return F.transform(
        F.sequence(F.lit(0), last.cast("int")), lambda i: digest(F.array_join(F.slice(hashes, i * RUN + 1, RUN), ""))
    )


def _siblings(level: int, place: Column) -> Column:
    hashes, own = F.col(f"level{level}"), F.floor(place / RUN**level).cast("int")
    first = own - F.pmod(own, F.lit(RUN))
    beside = lambda start, count: F.unhex(F.array_join(F.slice(hashes, start + 1, count), ""))
    return F.when(_applies(level), F.struct(
        beside(first, own - first).alias("before"), beside(own + 1, F.lit(RUN - 1) - (own - first)).alias("after")
    ))


def _hop(nodes: DataFrame, leg: int, carried: list[str]) -> DataFrame:
    """Node rows (tree, pos, hash, n, carried..) with ``steps``, the siblings up to the parent, and the parent's ``up_pos``, ``up_n``, ``arrives``."""
    runs = nodes.groupBy("tree", "n", F.floor(F.col("pos") / FAN).cast("long").alias("up_pos")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "hash", *carried))).alias("members")
    )
    runs = runs.withColumn("level0", F.transform("members", lambda m: F.lower(F.hex(m["hash"]))))
    for level in range(STEP):
        below = F.col(f"level{level}")
        runs = runs.withColumn(f"level{level + 1}", F.when(_applies(level), _joined(below)).otherwise(below))
    steps = F.transform("members", lambda m, i: F.struct(
        m.alias("m"), F.filter(F.array(*[_siblings(level, i) for level in range(STEP)]), lambda s: s.isNotNull()).alias("steps")
    ))
    rows = runs.select(
        "tree", F.ceil(F.col("n") / FAN).cast("long").alias("up_n"), "up_pos", F.unhex(F.get(f"level{STEP}", F.lit(0))).alias("arrives"),
        F.explode(steps).alias("c"),
    )
    return rows.select("tree", F.lit(leg).alias("leg"), "c.m.*", "c.steps", "up_pos", "up_n", "arrives")


def _climbs(nodes: DataFrame, carried: list[str], top: bool) -> tuple[list[DataFrame], DataFrame]:
    """The node rows of all legs, written, and the roots (tree, hash). The last leg of a source leads to its place in the top tree."""
    legs: list[DataFrame] = []
    roots: list[DataFrame] = []
    while True:
        leg = len(legs)
        rows = _hop(nodes, leg, carried if not leg else [])
        over = F.col("up_n") == 1
        up_tree = F.when(over, F.lit(None) if top else F.lit(TOP)).otherwise(F.col("tree")).cast("long")
        rows = rows.withColumns({
            "up_tree": up_tree, "up_leg": F.when(over, 0).otherwise(leg + 1), "up_pos": F.when(over, F.col("tree")).otherwise(F.col("up_pos")),
        })
        rows = durable(rows, "nodes")
        legs.append(rows)
        above = rows.groupBy("tree", "up_pos", "up_n").agg(F.first("arrives").alias("hash"))
        roots.append(above.filter("up_n = 1").select("tree", "hash"))
        nodes = durable(above.filter("up_n > 1").select("tree", F.col("up_pos").alias("pos"), "hash", F.col("up_n").alias("n")), "level")
        if nodes.isEmpty():
            return legs, reduce(DataFrame.unionByName, roots)


def _ways(tree: Column, leg: Column) -> Column:
    return F.when((tree == TOP) | (leg >= 2), COPIES).otherwise(1)


_CLIMB = """
with recursive climb as (
  select home, place, 0 as turn, doc_id, hash as leaf, subroot, root, up_tree, up_leg, up_pos, up_ways,
    siblings, fold as folded
  from {leaves}
  union all
  select c.home, c.place, c.turn + 1, cast(null as bigint), cast(null as binary), n.subroot, n.root, n.up_tree, n.up_leg, n.up_pos, n.up_ways,
    n.siblings,
    aggregate(n.steps, c.folded, (h, s) -> unhex(sha2(concat(lower(hex(s.before)), lower(hex(h)), lower(hex(s.after))), 256)))
  from climb c join {nodes} n
    on c.up_tree = n.tree and c.up_leg = n.leg and c.up_pos = n.pos and pmod(c.place, c.up_ways) = n.copy
)
select home, place, max(doc_id) as doc_id, max(leaf) as leaf, max(subroot) as subroot, max(root) as root,
  max_by(folded, turn) as folded, array_join(transform(array_sort(collect_list(struct(turn, siblings))), x -> lower(hex(x.siblings))), '') as proof
from climb group by home, place
"""


def _fold(start: Column) -> Column:
    return F.aggregate("steps", start, lambda h, s: F.unhex(digest(F.concat(F.lower(F.hex(s["before"])), F.lower(F.hex(h)), F.lower(F.hex(s["after"]))))))


def _siblings_of(rows: DataFrame) -> DataFrame:
    joined = F.aggregate("steps", F.lit("").cast("binary"), lambda b, s: F.concat(b, s["before"], s["after"]))
    return rows.withColumn("siblings", joined).withColumn("up_ways", _ways(F.col("up_tree"), F.col("up_leg")))


def _own_session(spark: SparkSession) -> SparkSession:
    """A session with the caller's settings in which a recursive query may return any number of rows."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return own


def manifest(docs: DataFrame, tampered: Column, tampered_text: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``docs``.

    ``tampered`` rows are folded from the hash with ``tampered_text`` in the place of their text; all other hashes are of
    the table as it is.
    """
    spark = docs.sparkSession
    fields = {c: F.col(c) for c in COLUMNS}
    hurt = F.coalesce(tampered, F.lit(False))
    leaves = durable(docs.select(
        "doc_id", "source", F.unhex(leaf_hash(fields)).alias("hash"),
        F.when(hurt, F.unhex(leaf_hash(fields | {"text": tampered_text}))).alias("start"),
    ), "leaves")
    placed, sizes = numbered(leaves, ["source"], ["doc_id", "hash"])
    sources, _ = numbered(durable(sizes, "sources"), [], ["source"])
    trees = durable(sources.select(F.col("source").alias("_source"), F.col("pos").alias("tree"), F.col("size").alias("n")), "trees")
    nodes = placed.join(trees, F.col("source").eqNullSafe(F.col("_source"))).select("tree", "pos", "hash", "n", "doc_id", "start")

    legs, roots = _climbs(nodes, ["doc_id", "start"], False)
    roots = durable(roots, "subroots")
    count = roots.count()
    top = roots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), "hash", F.lit(count).cast("long").alias("n"))
    top_legs, _ = _climbs(top, [], True)

    own = _own_session(spark)
    none = F.lit(None).cast("binary")
    subroot = F.when(F.col("up_n") == 1, F.col("arrives"))
    first = _siblings_of(legs[0]).withColumns({"subroot": subroot, "root": none, "home": F.col("tree"), "place": F.col("pos")})
    first = first.withColumn("fold", _fold(F.coalesce("start", "hash"))).drop("steps")
    above = [_siblings_of(rows).withColumns({"subroot": subroot, "root": none}) for rows in legs[1:]]
    above += [_siblings_of(rows).withColumns({"subroot": none, "root": subroot}) for rows in top_legs]
    links = reduce(DataFrame.unionByName, above).withColumn(
        "copy", F.explode(F.sequence(F.lit(0), _ways(F.col("tree"), F.col("leg")) - 1))
    )
    paths = []
    for rows in (first, links):
        paths.append(new_folder(spark, "climb"))
        rows.write.parquet(paths[-1])
    climbed = own.sql(_CLIMB.format(leaves=f"parquet.`{paths[0]}`", nodes=f"parquet.`{paths[1]}`"))
    shown = lambda c: F.lower(F.hex(c))
    result = climbed.select(
        "doc_id", shown("leaf").alias("leaf"), shown("subroot").alias("subroot"), shown("root").alias("root"),
        digest(F.col("proof")).alias("proof_sha256"), shown("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
    paths.append(new_folder(spark, "manifest"))
    result.write.parquet(paths[-1])
    return spark.read.schema(result.schema).parquet(paths[-1])


def without_newlines(docs: DataFrame) -> DataFrame:
    """The manifest in which every second document, by the checksum of its id, has lost its newlines."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return manifest(docs, chosen, F.replace("text", F.lit("\n"), F.lit("")))
