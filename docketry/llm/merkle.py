"""Merkle manifest of a dataset: a content-addressed DAG of digests, and inclusion proofs by descent from its root.

Every row is a leaf; the leaves of a group form a tree of fan-out ``FAN``, and the groups' roots form the tree above. A
node is a record (digest, digests of its children), written to the shared folder height by height. A leaf's place in its
group, written in digits of base ``FAN``, is its way down: the descent starts with the root's digest, looks its record up,
goes on with the child the next digit names and keeps the children it left out. At the end the kept segments are reversed,
so that they lead from the leaf to the root.

Leaves that share leading digits share that part of the way, so a step handles each different prefix once and a descent
for all N leaves moves about N/7 rows over all heights, not N a height. A record is looked up by its digest within a
section of ``SECTION`` places: nodes with equal contents share a record, and however many there are, no key of the join
has more than a section's.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import cut, shared_folder
from docketry.llm.ranks import ranked

FAN = 8
BITS = 3  # of a digit
SECTION = 12  # bits of the places that may share a record
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SEGMENTS = "array<struct<before: string, after: string>>"  # of each height: the children left and right of the chosen one


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(*values: Column) -> Column:
    """Each value as ``-`` if NULL, else its UTF-8 byte count, a colon and the value itself."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def group_key(group: Column) -> Column:
    """A text that is never NULL and sorts as the group does, NULL first."""
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group.cast("string")))


@dataclass
class Tree:
    """One tree per group: ``levels[h - 1]`` has the nodes of height h (grp, place, remaining, digest, children)."""

    levels: list[DataFrame] = field(default_factory=list)
    roots: DataFrame | None = None  # grp, height, digest

    def records(self, height: int) -> DataFrame:
        """The store at a height: different digests of a section and their children."""
        kept = self.levels[height - 1].select("digest", "grp", F.shiftright("place", SECTION).alias("section"), "children")
        return kept.dropDuplicates(["digest", "grp", "section"])


@dataclass
class Manifest:
    leaves: DataFrame  # grp, rank, size (leaves of the group), id, leaf and the columns carried along
    groups: Tree
    top: Tree
    names: DataFrame  # the groups' places in the tree above: grp, name, place, digest
    root: str | None  # None for an empty table

    def records(self) -> DataFrame:
        """All records (digest, children) of the store, each once."""
        parts = [t.records(h).select("digest", "children") for t in (self.groups, self.top) for h in range(1, len(t.levels) + 1)]
        spark = self.leaves.sparkSession
        every = spark.createDataFrame([], "digest string, children array<string>")
        for p in parts:
            every = every.unionByName(p)
        return every.distinct()


def grown(nodes: DataFrame, folder: str) -> Tree:
    """The trees over ``nodes`` (grp, place, remaining: the group's nodes, digest), each height a written table."""
    spark, tree = nodes.sparkSession, Tree()
    most = nodes.agg(F.max("remaining")).first()[0] or 0
    now = nodes
    tree.roots = now.where("remaining = 1").select("grp", F.lit(0).alias("height"), "digest")
    while most > 1:
        runs = now.where("remaining > 1").groupBy("grp", F.shiftright("place", BITS).alias("place")).agg(
            F.first("remaining").alias("below"), F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("run"))
        children = F.transform("run", lambda c: c["digest"])
        made = runs.select("grp", "place", F.shiftright(F.col("below") + (FAN - 1), BITS).alias("remaining"),
                           digest(F.array_join(children, "")).alias("digest"), children.alias("children"))
        path = f"{folder}/height-{len(tree.levels) + 1}"
        made.write.parquet(path)
        now = spark.read.parquet(path)
        tree.levels.append(now)
        tree.roots = tree.roots.unionByName(now.where("remaining = 1").select("grp", F.lit(len(tree.levels)).alias("height"), "digest"))
        most = -(-most // FAN)
    tree.roots = cut(tree.roots)
    return tree


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang",
             carried: dict[str, Column] | None = None) -> Manifest:
    """Manifest of ``docs``: a tree per group over the rows by ascending id, and the tree over the groups, NULL first.

    NULL values, empty and very long texts are hashed like any other (see ``leaf_digest``). Rows with a NULL id come first;
    rows that share an id stand in the order of their digests, so repeated rows are leaves of their own and the root does
    not depend on the order of the input. An empty table has no root. ``carried`` columns of ``docs`` go along with the
    leaves; further columns are not read, whatever their names.
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession, "manifest")
    rows = docs.select(F.col(id_col).alias("id"), group_key(F.col(group_col)).alias("grp"),
                       leaf_digest(*[F.col(f) for f in fields]).alias("leaf"),
                       F.struct(*[c.alias(name) for name, c in (carried or {}).items()], F.lit(0).alias("_")).alias("carried"))
    rows.write.parquet(f"{folder}/leaves")
    leaves = cut(ranked(spark.read.parquet(f"{folder}/leaves"), ["grp"], ["id", "leaf"]))
    groups = grown(leaves.select("grp", F.col("rank").alias("place"), F.col("size").alias("remaining"), F.col("leaf").alias("digest")), f"{folder}/groups")
    named = ranked(groups.roots.select(F.lit("").alias("all"), F.col("grp").alias("name"), "digest"), ["all"], ["name"])
    named = cut(named.select(F.col("all").alias("grp"), "name", F.col("rank").alias("place"), F.col("size").alias("remaining"), "digest"))
    top = grown(named.select("grp", "place", "remaining", "digest"), f"{folder}/top")
    found = top.roots.select("digest").first()
    return Manifest(leaves, groups, top, named, found[0] if found else None)


def _hop(frontier: DataFrame, records: DataFrame) -> DataFrame:
    """The children of every node of the frontier (grp, prefix, digest, further columns), from its record."""
    return frontier.withColumn("section", F.shiftright("prefix", SECTION)).join(records, ["digest", "grp", "section"]).drop("digest", "section")


def _chosen(hop: DataFrame, place: Column) -> list[Column]:
    """The child a digit names, and the way so far with the children it leaves out."""
    digit = place.bitwiseAND(F.lit(FAN - 1)).cast("int")
    before = F.array_join(F.slice("children", F.lit(1), digit), "")
    after = F.array_join(F.slice("children", digit + 2, F.lit(FAN)), "")
    segment = F.struct(before.alias("before"), after.alias("after"))
    return [F.element_at("children", digit + 1).alias("digest"), F.concat("segments", F.array(segment)).alias("segments")]


def descended(tree: Tree, starts: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (grp, rank, further columns) with ``digest`` and ``segments`` of the node at the end of their way and
    ``start``, the digest their way began with. ``starts``: grp, height, digest, segments collected so far.

    Segments come in the order of the descent. Requests for a place that does not exist have no answer.
    """
    starts = starts.withColumn("start", F.col("digest"))
    prefixes = {}
    last = requests
    for height in range(1, len(tree.levels)):
        last = cut(last.select("grp", F.shiftright("rank", BITS).alias("rank")).distinct())
        prefixes[height] = last
    frontier = None
    for height in range(len(tree.levels), 0, -1):
        begun = starts.where(F.col("height") == height).select("grp", F.lit(0).cast("long").alias("prefix"), "digest", "segments", "start")
        frontier = begun if frontier is None else frontier.unionByName(begun)
        hop = _hop(frontier, tree.records(height)).withColumnRenamed("prefix", "parent")
        wanted = (prefixes[height - 1] if height > 1 else requests).withColumn("parent", F.shiftright("rank", BITS))
        met = wanted.join(hop, ["grp", "parent"])
        keep = ["grp", F.col("rank").alias("prefix")] if height > 1 else [F.col(c) for c in requests.columns]
        stepped = met.select(*keep, "start", *_chosen(met, F.col("rank")))
        frontier = cut(stepped) if height > 1 else stepped
    single = requests.where("rank = 0").join(starts.where("height = 0").drop("height"), "grp").select(
        *requests.columns, "start", "digest", "segments")
    return single if frontier is None else frontier.unionByName(single)


def proofs(plan: Manifest, requests: DataFrame) -> DataFrame:
    """``requests`` (grp, rank, further columns) with ``found`` (the digest of the leaf at the place), ``subroot``, and
    ``siblings``: the segments from the leaf up to the root."""
    none = F.array().cast(SEGMENTS)
    above = descended(plan.top, plan.top.roots.withColumn("segments", none),
                      plan.names.select("grp", F.col("place").alias("rank"), "name"))
    above = cut(above.select(F.col("name").alias("grp"), "segments"))
    below = descended(plan.groups, plan.groups.roots.join(above, "grp"), requests)
    return below.select(*requests.columns, F.col("digest").alias("found"), F.col("start").alias("subroot"),
                        F.reverse("segments").alias("siblings"))


def folded(leaf: Column, siblings: Column) -> Column:
    """The root a leaf and its siblings give."""
    return F.aggregate(siblings, leaf, lambda node, s: digest(s["before"], node, s["after"]))


def proof_digest(siblings: Column) -> Column:
    return digest(F.array_join(F.transform(siblings, lambda s: F.concat(s["before"], s["after"])), ""))
