"""Parent-child links of unknown depth to full hierarchies: path, depth, root, all descendants, loops.

Method: heavy-path decomposition after cycle separation.

1. `_separate`: one pointer doubling over the inner nodes (those with children; leaves never take part, so a parent with a
   third of all children costs no more than any other) sums the subtree sizes and leaves over the nodes on and below
   loops. Loops are then cut: each of their nodes becomes the head of its own tree, whose sizes are summed again.
2. `_chains`: each inner node continues its chain to its largest inner child; chain heads and positions by doubling.
   Chains hang on nodes of other chains; on any way down the subtree size at least halves from chain to chain, so the tree
   of chains has at most log2(n) levels. Depth, root and order number of a chain follow level by level.
3. Every node reads its depth and root off its chain; its descendants are the numbers after its own, one interval.
4. `_several`: where nodes have several parents, subtree sizes miss what hangs on the further links. The nodes above such
   nodes are found along the chains (log2(n) rounds for each nesting of further links); among them and the nodes with
   several parents alone, pairs of ancestor and descendant are closed by doubling and weighted with the plain trees that
   hang on each node once. Exact; the pairs exist for those nodes only.

Rounds are logarithmic in depth or size; each round is written to the shared folder, so no lineage grows and lost
executors cost one round. Row counts are taken while writing; nothing else comes to the driver.

Defined cases
* a null or blank end, and a null type, is no link; repeated links count once;
* a node that is its own parent is a loop of one;
* nodes on or below a loop (by any of their links) have root '' and depth -1; n_below of a node on a loop counts the other
  nodes of the loop and everything below them;
* a node with several parents has its path, depth, root and interval in the tree of the smallest parent id (as text);
  n_below, in_cycle and the nodes below loops count all of its links;
* no links give an empty result; further columns are not read.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.runtime import blank_to_null, drop_table, heavy_bound, lookup_join, materialize, noted

#: Relation types that run from parent to child, and from child to parent.
DOWN = ("CONTAINS", "DECLARES")
UP = ("MEMBER_OF",)
#: Siblings are numbered in groups of about this many.
GROUP = 100_000


def containment(edges: DataFrame) -> DataFrame:
    """Links child, parent of active containment edges, repeats included."""
    up = F.col("type").isin(*UP)
    s, t = blank_to_null("source_id"), blank_to_null("target_id")
    rows = edges.where((F.col("status") == "active") & F.col("type").isin(*DOWN, *UP)).select(F.when(up, s).otherwise(t).alias("child"), F.when(up, t).otherwise(s).alias("parent"))
    return rows.where("child is not null and parent is not null")


def _hop(state: DataFrame) -> DataFrame:
    """One doubling: `to` moves on to the `to` of where it points."""
    b = state.select(F.col("v").alias("to"), F.col("to").alias("to2"))
    return state.join(b, "to").select("v", F.col("to2").alias("to"))


class Hierarchy:
    """The written stages of one decomposition of links (child, parent).

    `links` has one row per child with its smallest parent, `further` the links to other parents."""

    def __init__(self, links: DataFrame):
        one = links.groupBy("child").agg(F.min("parent").alias("parent"), (F.min("parent") != F.max("parent")).alias("more"))
        one = materialize(one, more=F.count_if("more"))
        self.links, self.n = one.select("child", "parent"), noted(one)
        self.further = None
        if noted(one, "more"):
            many = links.join(one.where("more").select("child"), "child", "left_semi").distinct()
            self.further = materialize(many.join(self.links, ["child", "parent"], "left_anti"))
        self._inner()
        self._separate()
        with ThreadPoolExecutor(1) as pool:  # neither waits for the other's rounds
            loops = pool.submit(self._name_loops, noted(self.on_loop)) if self.on_loop is not None else None
            self._chains()
            self.loops = loops.result() if loops else self.inner.where("false").select("v", F.lit(0).cast("bigint").alias("n_loop"))
        self.shared = self._several() if self.further is not None else None

    def _inner(self) -> None:
        """Inner nodes with a number each: id, v, up (number of the parent, null for roots), w (1 + leaf children)."""
        kids = self.links.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"))
        if self.further is not None:
            also = self.further.select(F.col("parent").alias("id"), F.lit(0).cast("bigint").alias("kids"))
            kids = kids.unionByName(also).groupBy("id").agg(F.sum("kids").alias("kids"))
        big = F.col("kids") >= heavy_bound(self.n)
        ids = materialize(kids.withColumn("v", F.monotonically_increasing_id()), most=F.max("kids"), big=F.count_if(big))
        self.salts = max(16, noted(ids, "most") // GROUP)
        self.hubs = ids.where(big).select(F.col("id").alias("parent")) if noted(ids, "big") else None
        number = ids.select("id", "v")
        own = self.links.join(number.select(F.col("id").alias("child"), "v"), "child")
        own = self._to_parent(own, number.select(F.col("id").alias("parent"), F.col("v").alias("up")))
        own = materialize(own.select("v", "up"))
        inner_kids = own.groupBy(F.col("up").alias("v")).agg(F.count("*").alias("inner_kids"))
        self.inner = materialize(ids.join(own, "v", "left").join(inner_kids, "v", "left").select("id", "v", "up", (1 + F.col("kids") - F.coalesce("inner_kids", F.lit(0))).alias("w")))

    def _to_parent(self, rows: DataFrame, parents: DataFrame) -> DataFrame:
        """Rows joined to the one row of their parent; parents with a large share of all children are split off."""
        return rows.join(parents, "parent") if self.hubs is None else lookup_join(rows, parents, "parent", self.n, "inner", heavy=self.hubs)

    def _separate(self) -> None:
        """Loops, cut parents and subtree sizes: self.tree has v, up (null at heads), w, size; self.below has
        the v on and below loops, self.on_loop those on loops (None without any)."""
        state, open_ = self._sizes(self.inner)
        self.below, self.on_loop = self.inner.where("false").select("v"), None
        self.tree = self.inner.join(state.where("to is null").select("v", F.col("s").alias("size")), "v").select("v", "up", "w", "size")
        if open_:
            self._loops(state.where("to is not null").select("v", "to"))
            cut = self.inner.join(self.below, "v", "left_semi").join(self.on_loop.withColumn("cut", F.lit(True)), "v", "left")
            cut = materialize(cut.select("v", F.when(F.col("cut"), None).otherwise(F.col("up")).alias("up"), "w"))
            hung, _ = self._sizes(cut)
            self.tree = self.tree.unionByName(cut.join(hung.select("v", F.col("s").alias("size")), "v").select("v", "up", "w", "size"))
        self.tree = materialize(self.tree)

    def _sizes(self, nodes: DataFrame) -> tuple[DataFrame, int]:
        """Doubling: s counts the nodes less than 2^k below, `to` is the ancestor 2^k above. Ends when no further node runs
        out of ancestors; those that still have one (their number is the second result) are on or below loops."""
        state = nodes.select("v", F.col("up").alias("to"), F.col("w").alias("s"))
        before = -1
        while True:
            going = state.where("to is not null")
            gain = going.groupBy(F.col("to").alias("v")).agg(F.sum("s").alias("gain"))
            above = going.select(F.col("v").alias("to"), F.col("to").alias("to2"))
            nxt = materialize(state.join(gain, "v", "left").join(above, "to", "left").select("v", F.col("to2").alias("to"), (F.col("s") + F.coalesce("gain", F.lit(0))).alias("s")), open=F.count("to"))
            drop_table(state)
            state = nxt
            if noted(state, "open") in (0, before):
                return state, noted(state, "open")
            before = noted(state, "open")

    def _loops(self, jump: DataFrame) -> None:
        """The images of ever longer jumps of the nodes on and below loops shrink to the loops themselves."""
        jump = materialize(jump)
        self.below = jump.select("v")
        image = materialize(jump.select(F.col("to").alias("v")).distinct())
        while True:
            jump = materialize(_hop(jump))
            nxt = materialize(jump.select(F.col("to").alias("v")).distinct())
            same = noted(nxt) == noted(image)
            image = nxt
            if same:
                break
        self.on_loop = image

    def _name_loops(self, n: int) -> DataFrame:
        """Each loop is named by its smallest node: v, n_loop (the number of nodes on and below the loop)."""
        state = self.inner.join(self.on_loop, "v", "left_semi").select("v", F.col("up").alias("to"), F.least("v", "up").alias("name"))
        state = materialize(state)
        reach = 1
        while reach < n:
            b = state.select(F.col("v").alias("to"), F.col("to").alias("to2"), F.col("name").alias("name2"))
            state = materialize(state.join(b, "to").select("v", F.col("to2").alias("to"), F.least("name", "name2").alias("name"), (F.col("name2") < F.col("name")).alias("moved")), moved=F.count_if("moved"))
            reach *= 2
            if not noted(state, "moved"):
                break
        sized = state.join(self.tree.select("v", "size"), "v")
        total = sized.groupBy("name").agg(F.sum("size").alias("n_loop"))
        return materialize(sized.join(total, "name").select("v", "n_loop"))

    def _chains(self) -> None:
        """self.nodes: v, up, w, size, head, pos, depth, root (number); depth and root count from the head of the cut tree."""
        kids = self.tree.where("up is not null")
        heavy = kids.groupBy("up").agg(F.max_by("v", F.struct("size", "v")).alias("v")).select("v", F.lit(True).alias("heavy"))
        state = self.tree.join(heavy, "v", "left").select("v", F.when(F.col("heavy"), F.col("up")).otherwise(F.col("v")).alias("head"), F.when(F.col("heavy"), 1).otherwise(0).cast("bigint").alias("pos"))
        reach = 1
        state = materialize(state, going=F.count_if(F.col("pos") == reach))
        while noted(state, "going"):  # only rows that moved by the full reach can have further to go
            reach *= 2
            b = state.select(F.col("v").alias("head"), F.col("head").alias("head2"), F.col("pos").alias("pos2"))
            nxt = materialize(state.join(b, "head").select("v", F.col("head2").alias("head"), (F.col("pos") + F.col("pos2")).alias("pos")), going=F.count_if(F.col("pos") == reach))
            drop_table(state)
            state = nxt
        self.chained = materialize(self.tree.join(state, "v"), chains=F.count_if(F.col("pos") == 0))
        # The tree of chains, one level a round.
        heads = self.chained.where("pos = 0").select(F.col("v").alias("head"), "up")
        at = self.chained.select(F.col("v").alias("up"), F.col("head").alias("over"), F.col("pos").alias("over_pos"))
        self.hung = materialize(heads.join(at, "up", "left").select("head", "over", "over_pos"))
        top = self.hung.where("over is null").select("head", F.lit(0).cast("bigint").alias("base"), F.col("head").alias("root"))
        step = lambda level: self.hung.join(level.select(F.col("head").alias("over"), "base", "root"), "over").select("head", (F.col("base") + F.col("over_pos") + 1).alias("base"), "root")
        self.nodes = self.chained.join(self._levels(top, step), "head").select("v", "up", "w", "size", "head", "pos", (F.col("base") + F.col("pos")).alias("depth"), "root")

    def _levels(self, top: DataFrame, step) -> DataFrame:
        """All levels of the tree of chains, one row per chain: `top` for the first, step(level) for the next one."""
        level = done = materialize(top)
        n = noted(level)
        while n < noted(self.chained, "chains"):
            level = materialize(step(level))
            done = done.unionByName(level)
            n += noted(level)
        return done

    def _several(self) -> DataFrame:
        """What further parents change: id, v (null for leaves), n_below, in_cycle (null where nothing changes), lost.

        Rows are the nodes above a node with several parents, these nodes, and nodes that come to lie below a loop."""
        name = self.inner.select("id", "v")
        where = self.chained.select("v", "head", "pos")
        several = self.further.select("child").distinct()
        # Nodes above: the part of each chain down to a position. Starts are all parents of nodes with several parents.
        numbered = name.join(where, "v")
        parents = self.links.join(several, "child", "left_semi").unionByName(self.further).select(F.col("parent").alias("id")).distinct()
        marks = numbered.join(parents, "id", "left_semi").groupBy("head").agg(F.max("pos").alias("pos"))
        marks = materialize(marks, sum=F.sum(F.col("pos") + 1))
        # Links that the cut trees do not hold: further parents of inner nodes, and the cut links of loops.
        cut = self.inner.where("false").select("v", "up") if self.on_loop is None else self.inner.join(self.on_loop, "v", "left_semi").select("v", "up")
        more = self.further.join(name.select(F.col("id").alias("child"), "v"), "child").join(name.select(F.col("id").alias("parent"), F.col("v").alias("up")), "parent").select("v", "up")
        jumps = more.unionByName(cut).join(where, "v").select("up", F.col("head").alias("low"), F.col("pos").alias("low_pos"))
        jumps = materialize(jumps.join(where.withColumnRenamed("v", "up"), "up").select("low", "low_pos", "head", "pos"))
        while True:
            over = marks.select("head").join(self.hung.where("over is not null"), "head").select(F.col("over").alias("head"), F.col("over_pos").alias("pos"))
            side = jumps.join(marks.select(F.col("head").alias("low"), F.col("pos").alias("to")), "low").where("low_pos <= to").select("head", "pos")
            nxt = marks.select("head", "pos").unionByName(over).unionByName(side).groupBy("head").agg(F.max("pos").alias("pos"))
            nxt = materialize(nxt, sum=F.sum(F.col("pos") + 1))
            same = noted(nxt, "sum") == noted(marks, "sum")
            marks = nxt
            if same:
                break
        above = numbered.join(marks.select("head", F.col("pos").alias("to")), "head").where("pos <= to").select("id", "v", F.lit(True).alias("above"))
        leaf = several.select(F.col("child").alias("id")).join(name, "id", "left").join(above, "id", "left_anti").select("id", "v", F.lit(False).alias("above"))
        held = materialize(above.unionByName(leaf))
        # Weight: the node and the plain trees on it, without the trees of children that are held themselves.
        size = self.tree.select("v", "up", "size")
        inside = held.where("v is not null").join(size, "v").where("up is not null").groupBy(F.col("up").alias("v")).agg(F.sum("size").alias("taken"))
        loose = held.where("v is null").join(self.links.withColumnRenamed("child", "id"), "id").join(name.withColumnRenamed("id", "parent").withColumnRenamed("v", "up"), "parent")
        loose = loose.groupBy(F.col("up").alias("v")).agg(F.count("*").alias("taken"))
        taken = inside.unionByName(loose).groupBy("v").agg(F.sum("taken").alias("taken"))
        weight = held.join(size.select("v", "size"), "v", "left").join(taken, "v", "left").select("id", "v", "above", F.coalesce(F.col("size") - F.coalesce("taken", F.lit(0)), F.lit(1)).alias("weight"))
        weight = materialize(weight)
        steps = self.links.unionByName(self.further).join(held.select(F.col("id").alias("child")), "child", "left_semi")
        pairs = materialize(steps.select(F.col("parent").alias("a"), F.col("child").alias("b")).distinct())
        while True:
            on = pairs.select(F.col("a").alias("b"), F.col("b").alias("c"))
            nxt = materialize(pairs.unionByName(pairs.join(on, "b").select("a", F.col("c").alias("b"))).distinct())
            same = noted(nxt) == noted(pairs)
            drop_table(pairs)
            pairs = nxt
            if same:
                break
        looped = pairs.where("a = b").select(F.col("a").alias("id"))
        reach = pairs.where("a <> b").join(weight.select(F.col("id").alias("b"), "weight"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("reached"))
        lost = pairs.join(looped.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).unionByName(looped).distinct()
        out = weight.join(reach, "id", "left").join(looped.withColumn("on", F.lit(True)), "id", "left").join(lost.withColumn("lost", F.lit(True)), "id", "left")
        out = materialize(out.select("id", "v", F.when(F.col("above"), F.col("weight") - 1 + F.coalesce("reached", F.lit(0))).alias("n_below"), F.when(F.col("above"), F.coalesce("on", F.lit(False)).cast("bigint")).alias("in_cycle"), F.coalesce("lost", F.lit(False)).alias("lost")), lost=F.count_if("lost"))
        if noted(out, "lost"):
            self._sink(out.where("lost and v is not null").select("v"), where)
        return out

    def _sink(self, lost: DataFrame, where: DataFrame) -> None:
        """self.below with everything below the nodes `lost` in the cut trees: chains from a position on."""
        marks = where.join(lost, "v", "left_semi").groupBy("head").agg(F.min("pos").alias("pos"))
        marks = materialize(marks, sum=F.sum("pos"))
        while True:
            low = self.hung.join(marks.select(F.col("head").alias("over"), F.col("pos").alias("from")), "over").where("over_pos >= from").select("head", F.lit(0).cast("bigint").alias("pos"))
            nxt = materialize(marks.unionByName(low).groupBy("head").agg(F.min("pos").alias("pos")), sum=F.sum("pos"))
            same = (noted(nxt), noted(nxt, "sum")) == (noted(marks), noted(marks, "sum"))
            marks = nxt
            if same:
                break
        sunk = where.join(marks.select("head", F.col("pos").alias("from")), "head").where("pos >= from").select("v")
        self.below = materialize(self.below.unionByName(sunk).distinct())

    def inner_rows(self) -> DataFrame:
        """Result rows of inner nodes, with their number v."""
        names = self.inner.select("id", "v")
        roots = names.select(F.col("v").alias("root"), F.col("id").alias("root_id"))
        rows = self.nodes.select("v", "size", "depth", "root").join(names, "v").join(roots, "root")
        rows = rows.join(self.below.withColumn("lost", F.lit(True)), "v", "left").join(self.loops, "v", "left")
        below = F.coalesce("n_loop", "size") - 1
        on = F.col("n_loop").isNotNull().cast("bigint")
        if self.shared is not None:
            rows = rows.join(self.shared.where("v is not null").select("v", F.col("n_below").alias("all_below"), F.col("in_cycle").alias("on_any")), "v", "left")
            below, on = F.coalesce("all_below", below), F.coalesce("on_any", on)
        root = F.when(F.col("lost"), "").otherwise(F.col("root_id")).alias("root_id")
        return rows.select("v", F.col("id").alias("node_id"), root, F.when(F.col("lost"), -1).otherwise(F.col("depth")).cast("bigint").alias("depth"), below.alias("n_below"), on.alias("in_cycle"))

    def leaves(self) -> DataFrame:
        """Links of the nodes without children: child, parent, lost (by a further parent)."""
        leaf = self.links.join(self.inner.select(F.col("id").alias("child")), "child", "left_anti")
        if self.shared is None:
            return leaf.withColumn("lost", F.lit(False))
        lost = self.shared.where("v is null and lost").select(F.col("id").alias("child"), F.lit(True).alias("lost"))
        return leaf.join(lost, "child", "left").withColumn("lost", F.coalesce("lost", F.lit(False)))

    def rows(self) -> DataFrame:
        """One row per node: node_id, root_id, depth, n_below, in_cycle."""
        inner = materialize(self.inner_rows().drop("v"))
        above = inner.select(F.col("node_id").alias("parent"), "root_id", "depth")
        leaf = self._to_parent(self.leaves(), above)
        gone = F.col("lost") | (F.col("depth") < 0)
        zero = F.lit(0).cast("bigint")
        leaf = leaf.select(F.col("child").alias("node_id"), F.when(gone, "").otherwise(F.col("root_id")).alias("root_id"), F.when(gone, -1).otherwise(F.col("depth") + 1).cast("bigint").alias("depth"), zero.alias("n_below"), zero.alias("in_cycle"))
        return inner.unionByName(leaf)

    def _offsets(self) -> DataFrame:
        """head, offset: how far the number of a light child lies behind that of its parent. The heavy child comes first, then
        the light ones in groups of a hash, so the children of one parent never meet in one window."""
        light = self.chained.where("pos = 0 and up is not null").select("v", "up", "size", F.pmod(F.xxhash64("v"), F.lit(self.salts)).alias("salt"))
        heavy = self.chained.where("pos > 0").select("up", F.col("size").alias("heavy"))
        groups = light.groupBy("up", "salt").agg(F.sum("size").alias("s"))
        groups = groups.select("up", "salt", (F.sum("s").over(Window.partitionBy("up").orderBy("salt")) - F.col("s")).alias("before"))
        own = F.sum("size").over(Window.partitionBy("up", "salt").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
        placed = light.withColumn("within", own).join(groups, ["up", "salt"]).join(heavy, "up", "left")
        return placed.select(F.col("v").alias("head"), (1 + F.coalesce("heavy", F.lit(0)) + F.col("before") + F.col("within")).alias("offset"))

    def intervals(self) -> DataFrame:
        """One row per node: node_id, tree_id, first, last. In a tree (named by its head; the trees below a loop hang on the
        nodes of the loop) the nodes below a node are those numbered first + 1 to last."""
        names = self.inner.select("v", "id")
        rest = materialize(self.hung.where("over is not null").join(self._offsets(), "head").select("head", "over", (F.col("over_pos") + F.col("offset")).alias("step")))
        top = self.hung.where("over is null").select("head", F.col("head").alias("tree"), F.lit(0).cast("bigint").alias("start"))
        step = lambda level: rest.join(level.withColumnRenamed("head", "over"), "over").select("head", "tree", (F.col("start") + F.col("step")).alias("start"))
        rows = self.chained.join(self._levels(top, step), "head").join(names, "v").join(names.select(F.col("v").alias("tree"), F.col("id").alias("tree_id")), "tree")
        first = F.col("start") + F.col("pos")
        inner = materialize(rows.select(F.col("id").alias("node_id"), "tree_id", first.alias("first"), (first + F.col("size") - 1).alias("last"), "w"))
        leaf = self.leaves().withColumn("salt", F.pmod(F.xxhash64("child"), F.lit(self.salts)))
        groups = leaf.groupBy("parent", "salt").agg(F.count("*").alias("n"))
        groups = groups.select("parent", "salt", (F.sum("n").over(Window.partitionBy("parent").orderBy("salt")) - F.col("n")).alias("before"))
        rank = F.row_number().over(Window.partitionBy("parent", "salt").orderBy("child"))
        leaf = leaf.withColumn("rank", rank).join(groups, ["parent", "salt"]).select("child", "parent", (F.col("before") + F.col("rank")).alias("nth"))
        # The leaves of a node are the last numbers of its interval.
        at = F.col("last") - (F.col("w") - 1) + F.col("nth")
        joined = self._to_parent(leaf, inner.select(F.col("node_id").alias("parent"), "tree_id", "last", "w"))
        return inner.drop("w").unionByName(joined.select(F.col("child").alias("node_id"), "tree_id", at.alias("first"), at.alias("last")))

    def paths(self) -> DataFrame:
        """One row per node: node_id, path (ids from the root joined by ` > `, '' on and below loops).

        A node's path is the prefix of its chain and the chain's segment up to it. A segment is no longer than the path of
        the chain's last node, which is a row of the result."""
        names = self.inner.select("v", "id")
        segments = self.chained.join(names, "v").join(self.below, "v", "left_anti").groupBy("head").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("s"))
        segments = materialize(segments.select("head", F.transform("s", lambda x: x["id"]).alias("segment")))
        empty = F.array().cast("array<string>")
        top = self.hung.where("over is null").select("head", empty.alias("prefix"))

        def step(level: DataFrame) -> DataFrame:
            above = level.join(segments, "head", "left").select(F.col("head").alias("over"), "prefix", F.coalesce("segment", empty).alias("segment"))
            return self.hung.join(above, "over").select("head", F.concat("prefix", F.slice("segment", 1, F.col("over_pos").cast("int") + 1)).alias("prefix"))

        rows = self.chained.join(self._levels(top, step), "head").join(segments, "head", "left").join(names, "v").join(self.below.withColumn("lost", F.lit(True)), "v", "left")
        path = F.concat("prefix", F.slice("segment", 1, F.col("pos").cast("int") + 1))
        inner = materialize(rows.select(F.col("id").alias("node_id"), F.when(F.col("lost"), empty).otherwise(path).alias("path"), F.coalesce("lost", F.lit(False)).alias("lost")))
        joined = self._to_parent(self.leaves().withColumnRenamed("lost", "own"), inner.select(F.col("node_id").alias("parent"), "path", "lost"))
        leaf = joined.select(F.col("child").alias("node_id"), F.when(F.col("lost") | F.col("own"), empty).otherwise(F.array_append("path", F.col("child"))).alias("path"))
        return inner.drop("lost").unionByName(leaf).withColumn("path", F.array_join("path", " > "))
