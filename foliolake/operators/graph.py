"""Link graph of entries: edges, orphans, neighbourhoods, suggestions, communities.

Nodes are entries by path; edges(src, dst, kind) is a directed multigraph of kinds related, contradiction
and tag_cooccurrence.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import release, stage

LINK_KINDS = ("related", "contradiction")


def node_path(path: Column, exact: bool = False) -> Column:
    """A path as nodes are keyed: one leading `wiki/` is taken off unless exact."""
    return path if exact else F.regexp_replace(path, "^wiki/", "")


def references(entries: DataFrame, exact: bool = False) -> DataFrame:
    """(src, dst, kind) of every mention in related and contradictions, repeats kept; one scan of the entries."""
    mention = lambda column, kind: F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda x: F.struct(x.alias("dst"), F.lit(kind).alias("kind")))
    both = F.concat(mention(F.col("related"), "related"), mention(F.col("contradictions"), "contradiction"))
    rows = entries.select(node_path(F.col("path"), exact).alias("src"), F.explode(both).alias("m"))
    return rows.select("src", node_path(F.col("m.dst"), exact).alias("dst"), F.col("m.kind").alias("kind"))


def resolve_links(entries: DataFrame, exact: bool = False, nodes: DataFrame | None = None) -> DataFrame:
    """Mentions whose target exists (among nodes, by default the entries); the others are dropped, repeats stay parallel edges."""
    nodes = (entries if nodes is None else nodes).select(node_path(F.col("path"), exact).alias("dst"))
    return references(entries, exact).join(nodes, "dst", "left_semi").select("src", "dst", "kind")


def broken_links(entries: DataFrame, exact: bool = False) -> DataFrame:
    """Distinct mentioned paths that no entry has."""
    nodes = entries.select(node_path(F.col("path"), exact).alias("path"))
    return references(entries, exact).select(F.col("dst").alias("path")).distinct().join(nodes, "path", "left_anti")


def shared_tags(a: Column, b: Column) -> Column:
    """How many different tags two sets share; null counts as empty."""
    none = F.array().cast("array<string>")
    return F.size(F.array_intersect(F.coalesce(a, none), F.coalesce(b, none)))


def all_tags(a: Column, b: Column) -> Column:
    """How many different tags two sets have together; null counts as empty."""
    none = F.array().cast("array<string>")
    return F.size(F.array_union(F.coalesce(a, none), F.coalesce(b, none)))


#: Entries of one tag set that lie in one tile on average; what is sent for a pair of entries falls as this grows.
TILE = 4096


def _tag_sets(entries: DataFrame) -> DataFrame:
    """(path, id, tags, n): each entry's tags as a set; equal sets have one id; entries without tags are left out."""
    sets = entries.select("path", F.array_sort(F.array_distinct("tags")).alias("tags")).withColumn("n", F.size("tags")).where("n > 0")
    return sets.select("path", F.to_json("tags").alias("id"), "tags", "n")


def _near_sets(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of tag sets(id, tags, n), one of each side, at least `threshold` alike; a set is like itself.

    One shared tag is enough only if the sets hold at most 1 + 1 / threshold tags together; such small sets
    meet on single tags.  All others share two tags or more and meet on pairs of tags, so a very common tag
    alone brings nothing together.  Each pair is made once: at its least shared key.
    """
    most = math.floor(1 / threshold + 1 + 1e-9)
    one = lambda df: df.where(F.col("n") < most).select("id", "tags", "n", F.explode("tags").alias("key"))
    twos = F.flatten(F.transform("tags", lambda x, k: F.transform(F.slice("tags", k + 2, F.col("n")), lambda y: F.concat_ws("\x01", x, y))))
    two = lambda df: df.where("n > 1").select("id", "tags", "n", F.explode(twos).alias("key"))
    small = _meet(one(left), one(right), F.col("a.n") + F.col("b.n") <= most, 1)
    return small.unionByName(_meet(two(left), two(right), F.lit(True), 2)).where(F.col("jaccard") >= threshold)


def tag_pairs(entries: DataFrame, threshold: float = 0.3, of: DataFrame | None = None) -> DataFrame:
    """(a, b, jaccard), a < b, of entries whose tag sets are at least `threshold` alike.

    With `of`, some of the entries, a is one of them and b any other one, in either order: only their pairs
    are made.
    Sets meet once however many entries have them, and hand on their entries in tiles of some TILE.
    """
    sets = _tag_sets(entries)
    some = sets if of is None else sets.join(of.select("path").distinct(), "path", "left_semi")
    kinds = lambda df: df.select("id", "tags", "n").distinct()
    near = _near_sets(kinds(some), kinds(sets), threshold)
    a, b = _tiles(some), _tiles(sets)
    if of is None:
        near = near.where("a <= b")
    met = near.join(a.select(F.col("id").alias("a"), F.col("tile").alias("tile_a"), F.col("paths").alias("paths_a")), "a")
    tiles = b.groupBy(F.col("id").alias("b")).agg(F.collect_list("tile").alias("at"))  # the numbers of a set's tiles
    met = met.join(tiles, "b").select("a", "b", "jaccard", "tile_a", "paths_a", F.explode("at").alias("tile_b"))
    if of is None:
        met = met.where("a < b or tile_a <= tile_b")
    # Tiles are few and their pairs many: one side is spread out before it meets the other, which is sent once for all its pairs.
    met = met.repartition(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "b", "tile_b")
    met = met.join(b.select(F.col("id").alias("b"), F.col("tile").alias("tile_b"), F.col("paths").alias("paths_b")), ["b", "tile_b"])
    same = (F.col("a") == F.col("b")) & (F.col("tile_a") == F.col("tile_b"))
    rows = met.select("jaccard", same.alias("same"), "paths_b", F.explode("paths_a").alias("x")).select("jaccard", "same", "x", F.explode("paths_b").alias("y"))
    if of is not None:
        return rows.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"), "jaccard")
    return rows.where("x < y or (x > y and not same)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")


def _tiles(sets: DataFrame) -> DataFrame:
    """(id, tile, paths): the entries of each tag set in tiles."""
    tiles = sets.groupBy("id").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    dealt = sets.select("path", "id").join(tiles, "id").withColumn("tile", F.pmod(F.xxhash64("path"), F.col("tiles")).cast("int"))
    return dealt.groupBy("id", "tile").agg(F.collect_list("path").alias("paths"))


def _meet(left: DataFrame, right: DataFrame, fits: Column, size: int) -> DataFrame:
    pairs = left.alias("a").join(right.alias("b"), (F.col("a.key") == F.col("b.key")) & fits)
    shared = F.array_sort(F.array_intersect("a.tags", "b.tags"))
    pairs = pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.key").alias("key"), shared.alias("shared"), (F.col("a.n") + F.col("b.n")).alias("n"))
    first = F.array_join(F.slice("shared", 1, size), "\x01")
    # Pairs that share one tag only belong to the single keys, the others to the pairs of tags.
    own = (F.size("shared") == 1) if size == 1 else (F.col("key") == first)
    return pairs.where(own).select("a", "b", (F.size("shared") / (F.col("n") - F.size("shared"))).alias("jaccard"))


def tag_groups(entries: DataFrame, threshold: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(members(path, grp), near(a, b, w)), staged: the tag edges of all entries, told by groups of paths.

    The paths of a group have the same tag sets; its name is its least path.  Each path of group a has w tag edges to each
    *other* path of group b, in both directions; near has a group with itself too.  A path that repeats has all its sets.
    """
    sets = stage(_tag_sets(entries), "sets")
    own = sets.groupBy("path", "id").agg(F.count("*").alias("m")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("id", "m"))).alias("held"))
    own = stage(own, "held")
    named = own.groupBy("held").agg(F.min("path").alias("grp"))
    members = stage(own.join(named, "held").select("path", "grp"), "members")
    kinds = sets.select("id", "tags", "n").distinct()
    near = _near_sets(kinds, kinds, threshold).select("a", "b")
    part = named.select("grp", F.inline("held"))
    left, right = part.select(F.col("grp").alias("ga"), F.col("id").alias("a"), F.col("m").alias("ma")), part.select(F.col("grp").alias("gb"), F.col("id").alias("b"), F.col("m").alias("mb"))
    met = left.join(near, "a").join(right, "b").groupBy(F.col("ga").alias("a"), F.col("gb").alias("b")).agg(F.sum(F.col("ma") * F.col("mb")).alias("w"))
    near = stage(met, "near")
    release(sets, own)
    return members, near


@dataclass(frozen=True)
class TagGraph:
    """build_graph's edges with those between tags told by groups, as tag_groups has them."""

    links: DataFrame
    members: DataFrame
    near: DataFrame


def tag_graph(entries: DataFrame, threshold: float = 0.3, exact: bool = False) -> TagGraph:
    """The graph of all entries without making its tag edges, for detect_communities."""
    return TagGraph(resolve_links(entries, exact), *tag_groups(entries.withColumn("path", node_path(F.col("path"), exact)), threshold))


def _tag_degrees(members: DataFrame, near: DataFrame) -> DataFrame:
    """(grp, size, degree): how many tag edges leave each path of a group; groups without any are left out."""
    sizes = members.groupBy("grp").agg(F.count("*").alias("size"))
    # A path is no partner of its own.
    reach = near.join(sizes.withColumnRenamed("grp", "b"), "b").groupBy(F.col("a").alias("grp")).agg(F.sum(F.col("w") * (F.col("size") - F.when(F.col("a") == F.col("b"), 1).otherwise(0))).alias("degree"))
    return sizes.join(reach.where("degree > 0"), "grp")


def graph_totals(entries: DataFrame, threshold: float = 0.3, exact: bool = False) -> DataFrame:
    """(kind, n, sources): build_graph's edges and the paths they leave, by kind; tag edges are counted, not made."""
    members, near = tag_groups(entries.withColumn("path", node_path(F.col("path"), exact)), threshold)
    links = resolve_links(entries, exact).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("src").alias("sources"))
    tags = _tag_degrees(members, near).agg(F.sum(F.col("size") * F.col("degree")).alias("n"), F.sum("size").alias("sources")).where("n > 0")
    return links.unionByName(tags.select(F.lit("tag_cooccurrence").alias("kind"), "n", "sources"))


def tag_cooccurrence(entries: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Both directed edges of each alike pair."""
    pairs = tag_pairs(entries, threshold)
    ends = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return pairs.select(ends.alias("e")).select("e.src", "e.dst", F.lit("tag_cooccurrence").alias("kind"))


def build_graph(entries: DataFrame, threshold: float = 0.3, exact: bool = False) -> DataFrame:
    """All edges: resolved mentions, then tag edges."""
    keyed = entries.withColumn("path", node_path(F.col("path"), exact))
    return resolve_links(entries, exact).unionByName(tag_cooccurrence(keyed, threshold))


def find_orphans(entries: DataFrame, exact: bool = False) -> DataFrame:
    """Nodes without any resolved mention in or out; shared tags do not count."""
    links = resolve_links(entries, exact)
    linked = links.select(F.explode(F.array("src", "dst")).alias("path"))
    return entries.select(node_path(F.col("path"), exact).alias("path"), "title", "domain").join(linked, "path", "left_anti")


def suggest_links(entries: DataFrame, path: str, k: int = 5, threshold: float = 0.1, edges: DataFrame | None = None) -> DataFrame:
    """(path, title, jaccard): the k entries most alike in tags that `path` does not link to yet.

    k below 1 gives none; ties go by path.
    """
    me = entries.where(F.col("path") == path).select(F.array_distinct("tags").alias("mine")).limit(1)
    if edges is None:  # only this entry's own edges are needed: its mentions, and what is alike enough for a tag edge
        known = resolve_links(entries.where(F.col("path") == path), nodes=entries)
        most = 0.3
    else:
        known, most = edges.where(F.col("src") == path), 2.0
    known = known.select(F.col("dst").alias("path")).distinct()
    others = entries.where(F.col("path") != path).select("path", "title", F.array_distinct("tags").alias("theirs"))
    # `me` is one row: the entry asked about.
    alike = others.join(F.broadcast(me), F.arrays_overlap("mine", "theirs")).select("path", "title", (F.size(F.array_intersect("mine", "theirs")) / F.size(F.array_union("mine", "theirs"))).alias("jaccard"))
    return alike.where((F.col("jaccard") >= threshold) & (F.col("jaccard") < most)).join(known, "path", "left_anti").orderBy(F.desc("jaccard"), "path").limit(max(k, 0))


def neighbours(edges: DataFrame, start: str, hops: int = 2, both: bool = False) -> DataFrame:
    """(path, hop, edge_kind) of what `start` reaches in at most `hops` steps, itself at hop 0.

    A node comes once, at its least hop; edge_kind is the least kind among the edges that first reach it.
    """
    spark = edges.sparkSession
    steps = edges.select("src", "dst", "kind")
    if both:
        steps = steps.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind"))
    seen = spark.createDataFrame([(start, 0, None)], "path string, hop int, edge_kind string")
    frontier = seen
    for hop in range(1, hops + 1):
        reached = steps.join(frontier.select(F.col("path").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("path")).agg(F.min("kind").alias("edge_kind"))
        frontier = stage(reached.join(seen.select("path"), "path", "left_anti").select("path", F.lit(hop).alias("hop"), "edge_kind"), "frontier")
        seen = seen.unionByName(frontier)
        if not frontier.take(1):
            break
    return seen


def edges_from(entries: DataFrame, some: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The edges of the graph that leave the entries named in some(path): the graph itself is not built."""
    keyed = entries.withColumn("path", node_path(F.col("path")))
    here = keyed.join(some.select("path").distinct(), "path", "left_semi")
    tags = tag_pairs(keyed, threshold, here).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("tag_cooccurrence").alias("kind"))
    return resolve_links(here, nodes=keyed).unionByName(tags)


def neighbours_of(entries: DataFrame, start: str, hops: int = 2) -> DataFrame:
    """neighbours over the entries' own graph: links of what has been reached, and tag edges between groups of paths."""
    keyed = entries.withColumn("path", node_path(F.col("path")))
    members, near = tag_groups(keyed)
    seen = frontier = entries.sparkSession.createDataFrame([(start, 0, None)], "path string, hop int, edge_kind string")
    for hop in range(1, hops + 1):
        here = frontier.select("path").distinct()
        links = resolve_links(keyed.join(here, "path", "left_semi"), nodes=keyed).select(F.col("dst").alias("path"), "kind")
        # What a path reaches of its own group includes itself, which has been seen.
        groups = members.join(here, "path").select(F.col("grp").alias("a")).distinct().join(near, "a").select(F.col("b").alias("grp")).distinct()
        tags = members.join(groups, "grp", "left_semi").select("path", F.lit("tag_cooccurrence").alias("kind"))
        reached = links.unionByName(tags).groupBy("path").agg(F.min("kind").alias("edge_kind"))
        frontier = stage(reached.join(seen.select("path"), "path", "left_anti").select("path", F.lit(hop).alias("hop"), "edge_kind"), "frontier")
        seen = seen.unionByName(frontier)
        if hop < hops and frontier.isEmpty():
            break
    release(members, near)
    return seen


def get_entry_context(entries: DataFrame, path: str, hops: int = 2, edges: DataFrame | None = None) -> DataFrame:
    """(path, title, domain, hop, edge_kind) of the entries around `path`, itself left out.

    Without edges only those of the entries that are reached are made.  An unknown path has nothing around it.
    """
    found = (neighbours_of(entries, path, hops) if edges is None else neighbours(edges, path, hops)).where("hop > 0")
    return found.join(entries.select("path", "title", "domain"), "path").select("path", "title", "domain", "hop", "edge_kind")


def concept_edges(edges: DataFrame, path: str, depth: int = 2) -> DataFrame:
    """Distinct edges among what lies within `depth` steps of `path` in either direction."""
    near = neighbours(edges, path, depth, both=True).select("path")
    inside = edges.join(near.withColumnRenamed("path", "src"), "src", "left_semi").join(near.withColumnRenamed("path", "dst"), "dst", "left_semi")
    return inside.select("src", "dst", "kind").distinct()


def export_concept_map(entries: DataFrame, edges: DataFrame, path: str, depth: int = 2) -> DataFrame:
    """(line_no, line): a Mermaid drawing; nodes are numbered in the order of their paths.

    Numbering sorts the neighbourhood, which `depth` bounds, not the graph.
    """
    near = neighbours(edges, path, depth, both=True).select("path")
    order = Window.orderBy("path")
    nodes = stage(near.join(entries.select("path", "title"), "path", "left").withColumn("id", F.row_number().over(order) - 1), "nodes")
    label = F.regexp_replace(F.coalesce("title", "path"), '"', "'")
    node_lines = nodes.select(F.lit(1).alias("part"), F.col("path").alias("k"), F.format_string('    N%d["%s"]', "id", label).alias("line"))
    arrow = F.when(F.col("kind") == "contradiction", "--x").when(F.col("kind") == "tag_cooccurrence", "-.->").otherwise("-->")
    drawn = concept_edges(edges, path, depth).join(nodes.select(F.col("path").alias("src"), F.col("id").alias("i")), "src").join(nodes.select(F.col("path").alias("dst"), F.col("id").alias("j")), "dst")
    edge_lines = drawn.select(F.lit(2).alias("part"), F.format_string("%08d %08d %s", "i", "j", "kind").alias("k"), F.format_string("    N%d %s N%d", "i", arrow, "j").alias("line"))
    head = edges.sparkSession.createDataFrame([(0, "", "graph TD")], "part int, k string, line string")
    lines = head.unionByName(node_lines).unionByName(edge_lines)
    return lines.select((F.row_number().over(Window.orderBy("part", "k")) - 1).alias("line_no"), "line")


def _half(path: Column, number: int) -> Column:
    """Which nodes move in the first half of a round: another half of them in each."""
    return F.substring(F.md5(F.concat(path, F.lit(f":{number}"))), 1, 1) < "8"


def detect_communities(edges: DataFrame | TagGraph, iterations: int = 50, compat: str = "most_frequent") -> DataFrame:
    """(path, label): label propagation over edges in both directions, parallel edges counted.

    A node takes the label most frequent among its neighbours, ties to the least label.  In each round one half
    of the nodes moves, then the other, as a hash of path and round deals them, so that two linked nodes do not
    exchange labels for ever.  It stops when no label changes in a round, or after `iterations` rounds.
    compat="least_frequent" takes the rarest label instead (a TagGraph has the most frequent only).  Labels are paths; loops
    and null ends are no edges.
    """
    if isinstance(edges, TagGraph):
        if compat != "most_frequent":
            raise ValueError("a TagGraph's labels are the most frequent ones")
        return _communities_by_groups(edges, iterations)
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst")
    weighed = stage(both.groupBy("src", "dst").agg(F.count("*").alias("w")), "weighed")
    labels = stage(weighed.select(F.col("src").alias("path")).distinct().select("path", F.col("path").alias("label"), F.lit(False).alias("moved")), "labels")
    rank = -F.col("votes") if compat == "most_frequent" else F.col("votes")
    # Joins are merged: labels come in small files, and one round after another would be sent to the driver to be broadcast.
    for k in range(iterations):
        moved = 0
        for turn in (True, False):
            now = _half(F.col("src"), k)
            votes = weighed.where(now if turn else ~now).join(labels.select(F.col("path").alias("dst"), "label").hint("merge"), "dst")
            counted = votes.groupBy(F.col("src").alias("path"), "label").agg(F.sum("w").alias("votes"))
            best = counted.groupBy("path").agg(F.min_by("label", F.struct(rank, "label")).alias("new"))
            new = labels.join(best.hint("merge"), "path", "left").select("path", F.coalesce("new", "label").alias("label"), (F.col("new").isNotNull() & (F.col("new") != F.col("label"))).alias("moved"))
            new = stage(new, "labels")
            moved += new.where("moved").count()
            release(labels)
            labels = new
        if not moved:
            break
    release(weighed)
    return labels.select("path", "label")


def _communities_by_groups(graph: TagGraph, iterations: int) -> DataFrame:
    """detect_communities without making tag edges.

    All paths of a group hear the same votes over tag edges, but for their own: a label's votes are summed once a group.
    A path then chooses among its group's two best labels and those of its links.  No other label can win: links
    only add votes, and a path's own vote, which does not count, only lowers the label that it has.
    """
    members, near, links = graph.members, graph.near, _weighed(graph.links)
    tagged = members.join(_tag_degrees(members, near).select("grp"), "grp", "left_semi")
    # Tag edges have two directions, and each is heard both ways.
    own = near.where("a = b").select(F.col("a").alias("grp"), (2 * F.col("w")).alias("own"))
    nodes = links.select(F.col("src").alias("path")).distinct().join(tagged, "path", "full").join(own, "grp", "left")
    labels = stage(nodes.select("path", "grp", F.coalesce("own", F.lit(0)).alias("own"), F.col("path").alias("label"), F.lit(False).alias("moved")), "labels")
    best_two = Window.partitionBy("grp").orderBy(F.desc("votes"), "label")
    for k in range(iterations):
        moved = 0
        for turn in (True, False):
            held = labels.where("grp is not null").groupBy(F.col("grp").alias("b"), "label").agg(F.count("*").alias("c"))
            heard = stage(near.join(held, "b").groupBy(F.col("a").alias("grp"), "label").agg((2 * F.sum(F.col("w") * F.col("c"))).alias("votes")), "heard")
            now = _half(F.col("path"), k)
            movers = labels.where(now if turn else ~now).select("path", "grp", "own", F.col("label").alias("old"))
            top = heard.withColumn("r", F.row_number().over(best_two)).where("r <= 2").drop("r")
            linked = links.join(labels.select(F.col("path").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("path"), "label").agg(F.sum("w").alias("linked"))
            by_link = movers.join(linked, "path").join(heard, ["grp", "label"], "left")
            less = F.when(F.col("label") == F.col("old"), F.col("own")).otherwise(0)
            chosen = lambda df, votes: df.select("path", "label", (votes - less).alias("votes"))
            both = chosen(movers.join(top, "grp"), F.col("votes")).unionByName(chosen(by_link, F.coalesce("votes", less) + F.col("linked")))
            best = both.where("votes > 0").groupBy("path").agg(F.min_by("label", F.struct(-F.col("votes"), "label")).alias("new"))
            new = stage(labels.join(best, "path", "left").select("path", "grp", "own", F.coalesce("new", "label").alias("label"), (F.col("new").isNotNull() & (F.col("new") != F.col("label"))).alias("moved")), "labels")
            moved += new.where("moved").count()
            release(labels, heard)
            labels = new
        if not moved:
            break
    release(links)
    return labels.select("path", "label")


def _weighed(edges: DataFrame) -> DataFrame:
    """Staged (src, dst, w) in both directions, parallel edges counted, without loops and null ends."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst")
    return stage(both.groupBy("src", "dst").agg(F.count("*").alias("w")), "weighed")


def colours(edges: DataFrame) -> DataFrame:
    """Staged (path, colour): no two linked nodes have one colour, and there are not many.

    In each round the nodes whose hash is the largest among their neighbours without a colour take the least one that no
    neighbour has (Jones and Plassmann); the rounds grow with the logarithm of the nodes, not with a hub's links.
    """
    linked = _weighed(edges).select("src", "dst")
    key = lambda c: F.struct(F.xxhash64(c), F.col(c))
    now = stage(linked.select(F.col("src").alias("path")).distinct().withColumn("colour", F.lit(None).cast("int")), "colours")
    while not now.where("colour is null").isEmpty():
        around = linked.join(now.select(F.col("path").alias("dst"), F.col("colour").alias("other")), "dst")
        # Colours that neighbours have are few; of those without one the largest key is enough.
        seen = around.groupBy(F.col("src").alias("path")).agg(F.collect_set("other").alias("used"), F.max(F.when(F.col("other").isNull(), key("dst"))).alias("rival"))
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), "used"))
        turn = F.col("colour").isNull() & (F.col("rival").isNull() | (key("path") > F.struct(F.col("rival.col1"), F.col("rival.dst"))))
        new = stage(now.join(seen, "path").select("path", F.when(turn, free).otherwise(F.col("colour")).alias("colour")), "colours")
        release(now)
        now = new
    return now


def detect_communities_in_turn(edges: DataFrame, iterations: int = 50, compat: str = "most_frequent") -> DataFrame:
    """(path, label): the in-place sweep without a driver, in order of colour and then path.

    Nodes of one colour have no links among themselves, so moving them together is moving them one after another: the
    result is detect_communities_exact's with order=colours(edges), for graphs of any size.
    """
    weighed, deal = _weighed(edges), colours(edges)
    turns = sorted(r["colour"] for r in deal.select("colour").distinct().collect())  # few, whatever the graph's size
    labels = stage(deal.select("path", "colour", F.col("path").alias("label"), F.lit(False).alias("moved")), "labels")
    rank = -F.col("votes") if compat == "most_frequent" else F.col("votes")
    for _ in range(iterations):
        moved = 0
        for turn in turns:
            mine = weighed.join(labels.where(F.col("colour") == turn).select(F.col("path").alias("src")), "src", "left_semi")
            votes = mine.join(labels.select(F.col("path").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("path"), "label").agg(F.sum("w").alias("votes"))
            best = votes.groupBy("path").agg(F.min_by("label", F.struct(rank, "label")).alias("new"))
            new = stage(labels.join(best, "path", "left").select("path", "colour", F.coalesce("new", "label").alias("label"), (F.col("new").isNotNull() & (F.col("new") != F.col("label"))).alias("moved")), "labels")
            moved += new.where("moved").count()
            release(labels)
            labels = new
        if not moved:
            break
    release(weighed, deal)
    return labels.select("path", "label")


def communities(labels: DataFrame) -> DataFrame:
    """(label, size) of labels that two nodes or more share, largest first."""
    return labels.groupBy("label").agg(F.count("*").alias("size")).where("size >= 2").orderBy(F.desc("size"), "label")


def detect_communities_exact(edges: DataFrame, iterations: int = 50, compat: str = "most_frequent", most_edges: int = 200_000, order: DataFrame | None = None) -> DataFrame:
    """The in-place sweep in path order, which is sequential: on the driver, for graphs of at most most_edges.

    With order(path, colour) the sweep goes by colour first; detect_communities_in_turn does that without the driver.
    """
    rows = edges.select("src", "dst").limit(most_edges + 1).collect()
    if len(rows) > most_edges:
        raise ValueError(f"more than {most_edges} edges: use detect_communities")
    around: dict[str, list[str]] = {}
    for r in rows:
        if r["src"] != r["dst"]:
            around.setdefault(r["src"], []).append(r["dst"])
            around.setdefault(r["dst"], []).append(r["src"])
    label = {n: n for n in around}
    first = {r["path"]: r["colour"] for r in order.limit(2 * most_edges).collect()} if order is not None else {}
    sweep = sorted(around, key=lambda n: (first.get(n, 0), n))
    sign = -1 if compat == "most_frequent" else 1
    for _ in range(iterations):
        changed = False
        for n in sweep:
            votes: dict[str, int] = {}
            for m in around[n]:
                votes[label[m]] = votes.get(label[m], 0) + 1
            new = min(votes, key=lambda x: (sign * votes[x], x))
            changed, label[n] = changed or new != label[n], new
        if not changed:
            break
    return edges.sparkSession.createDataFrame(sorted(label.items()) or [], "path string, label string")


def level_members(entries: DataFrame, paths: DataFrame, level: str = "l1") -> DataFrame:
    """The entries of a level, in any case, that are named in paths(path); repeats and unknown paths do not matter."""
    return entries.where(F.lower("level") == level.lower()).join(paths.select("path"), "path", "left_semi")


def majority_domain(members: DataFrame) -> DataFrame:
    """(label, domain, n): the domain most of a label's members have; ties go by name."""
    counts = members.groupBy("label", "domain").agg(F.count("*").alias("n"))
    return counts.groupBy("label").agg(F.min_by(F.struct("domain", "n"), F.struct(-F.col("n"), F.col("domain"))).alias("m")).select("label", "m.domain", "m.n")


def aggregate_entries(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, title, domain, size): communities with two level-1 members or more, named after their main domain."""
    shared = labels.join(labels.groupBy("label").agg(F.count("*").alias("size")).where("size >= 2").select("label"), "label", "left_semi")
    level1 = shared.join(level_members(entries, shared).select("path", "domain"), "path")
    sizes = level1.groupBy("label").agg(F.count("*").alias("size")).where("size >= 2")
    return sizes.join(majority_domain(level1).drop("n"), "label").select("label", F.concat("domain", F.lit(" 领域综合")).alias("title"), "domain", "size")


def graph_counts(entries: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """One row: node_count, edge_count; without edges those of build_graph are counted and not made."""
    counted = graph_totals(entries).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edge_count")) if edges is None else edges.agg(F.count("*").alias("edge_count"))
    return entries.agg(F.count("*").alias("node_count")).crossJoin(counted)
