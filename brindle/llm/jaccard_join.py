"""N-gram Jaccard join by a prefix tree.

The links are the pairs of documents whose sets of word n-grams have a Jaccard similarity of at least num / den; the
result is each document's component under these links. No pair of equal sets is ever formed: equal sets are one class.

1. A scan turns each text into its set of n-gram hashes. A document whose set has n members keeps an extended prefix:
   the n - need(n) + extra(n) smallest hashes, need(n) = ceil(n num / den). Two linked sets share at least extra members of
   their extended prefixes.
2. Over one document of each class, the prefix members' exact document counts are taken. Within its extended prefix each
   document orders members from rare to common and keeps the first so many that a linked pair must share one of them;
   members that no other document has are spent first. Passages that many documents share are common, so they rarely
   remain. Documents that share a kept member are joined to groups, by connected components.
3. Each group's whole sets go into radix tries under one global order, common members first, so that near copies share
   their path; sets that such a rarest
   member joins are one trie. Every set is looked up while the tree grows: the walk carries the overlap so far, a subtree is left when the
   overlap that the remaining lengths allow falls short, and also when all its sets are already in the set's own component.
4. From a group above the bound of one task go the sets with more n-grams of their own than a link can spare. The others are
dealt to cells by size class and hash. Each cell is searched together with the heads of the size classes next to it, which
all cells share: sets with the fewest n-grams of their own, such as a text that others are copies of. So near copies become
one part without ever meeting in a task.
What lies outside a group's largest part is then put to every cell whose sizes can link; sets of one part are not compared.
5. Each task returns a spanning forest of its links, and the forests are joined by connected components.

Null, empty and word-less texts have an empty set and link with nothing. Texts shorter than n words are one n-gram of
their own. Rows are told apart by id and text, so different texts of one id, or without one, are different rows; a
component's id is its smallest id that is not null. Repeated rows, and rows that tie in everything else, are one class. A
hot class is joined back by broadcast of its one row. An empty table gives an empty result. Other columns are not looked
at, whatever their names; `one_of_each` carries them through.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import BROADCAST_ROWS, components, discard, join_by_class, keep_rows, small_batches, stage, text_of

#: Share of a set by which its extended prefix goes beyond the plain one.
EXTRA = 0.1
#: A group is dealt to cells beyond this share of all n-grams of groups; a cell is at least and at most so many n-grams.
TASK_SHARE, LEAST_GRAMS, MOST_GRAMS = 1 / 128, 16_000, 1_000_000
#: Heads of a size class of a group: of each part of its classes, the one with the fewest n-grams of its own.
HEADS = 3
WORD_TABLE = 300_000


class Shingler(dict):
    """Sets of hashed n-grams of whole texts; remembers word hashes."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def grams(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the n-grams of the ASCII-lower-cased text's words."""
        ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not ws:
            return np.zeros(0, np.uint64)
        if len(self) > WORD_TABLE:
            self.clear()
        code = np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))
        size = min(self.size, len(ws))
        out = np.full(len(ws) - size + 1, size, np.uint64)
        for i in range(size):
            out = (out ^ code[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        return np.unique(out)


def need(n: int, num: int, den: int) -> int:
    """Overlap that a link of a set of n members needs at least."""
    return -(-n * num // den)


def extra(n: int) -> int:
    return max(1, int(EXTRA * n))


def prefix_lengths(n: int, num: int, den: int) -> tuple[int, int]:
    """Of a set of n members: length of the extended prefix, and how many of its rarest members a link must meet."""
    reach = min(n, n - need(n, num, den) + extra(n))
    return reach, reach - min(extra(n), extra(need(n, num, den))) + 1


def prefix_task(size: int, num: int, den: int):
    """Texts (id, h, text) to set size, set digest and extended prefix."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            n, digest, prefix, quota = [], [], [], []
            for text in batch.column(2).to_pylist():
                found = shingler.grams(text)
                reach, first = prefix_lengths(len(found), num, den) if len(found) else (0, 0)
                n.append(len(found))
                digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                prefix.append(found[:reach].view(np.int64))
                quota.append(first)
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in prefix]))).astype(np.int32)
            members = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(quota, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(members))], ["id", "h", "n", "digest", "quota", "prefix"])

    return task


class Node:
    """A radix trie node: the members on its edge, the lengths and components below, and the sets that end here."""

    __slots__ = ("edge", "children", "ends", "least", "most", "owner")

    def __init__(self, edge: np.ndarray, least: int, most: int, owner: int):
        self.edge, self.children, self.ends = edge, {}, []
        self.least, self.most, self.owner = least, most, owner


class Trie:
    """Finds the links of each added set to the sets before it, up to what connects components.

    parent is the union-find of all sets of the task; has is scratch space, one place per rank.
    """

    def __init__(self, num: int, den: int, parent: list[int], has: np.ndarray):
        self.num, self.den, self.parent, self.has = num, den, parent, has
        self.root = Node(np.zeros(0, np.int64), 1 << 60, 0, -1)

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def links(self, a: int, b: int, overlap: int) -> bool:
        return overlap * (self.num + self.den) >= self.num * (a + b)

    def add(self, me: int, ranks: np.ndarray, keep: bool = True) -> list[int]:
        """Looks up a set of sorted ranks and adds it (unless keep is false); returns earlier sets whose links joined components."""
        self.has[ranks] = True
        met = self.probe(me, ranks)
        self.has[ranks] = False
        if keep:
            self.insert(me, ranks)
        return met

    def uniform(self, node: Node) -> int:
        """The component that all sets below belong to, or -1."""
        if node.owner >= 0:
            return self.find(node.owner)
        owners = {self.find(e) for e in node.ends[:1]}
        for e in node.ends[1:]:
            owners.add(self.find(e))
            if len(owners) > 1:
                return -1
        for child in node.children.values():
            own = child.owner if child.owner < 0 else self.find(child.owner)
            if own < 0:
                return -1
            owners.add(own)
            if len(owners) > 1:
                return -1
        if owners:
            node.owner = owners.pop()
            return node.owner
        return -1

    def probe(self, me: int, ranks: np.ndarray) -> list[int]:
        n, met = len(ranks), []
        num, both = self.num, self.num + self.den
        # (node, overlap before its edge, members before its edge); visited again after its children to settle its owner
        stack = [(self.root, 0, 0, False)]
        while stack:
            node, overlap, depth, done = stack.pop()
            if done:
                self.uniform(node)
                continue
            if node.owner >= 0 and self.find(node.owner) == self.find(me):
                continue
            edge = node.edge
            if len(edge):
                overlap += int(np.count_nonzero(self.has[edge]))
                depth += len(edge)
                left = n - int(ranks.searchsorted(edge[-1], "right"))
            else:
                left = n
            size = min(max(depth + left, node.least), node.most)
            if (overlap + min(left, size - depth)) * both < num * (n + size):
                continue
            for other in node.ends:
                if self.links(n, depth, overlap) and self.find(other) != self.find(me):
                    self.parent[self.find(other)] = self.find(me)
                    met.append(other)
            if node.children:
                stack.append((node, 0, 0, True))
                stack.extend((c, overlap, depth, False) for c in node.children.values())
        return met

    def insert(self, me: int, ranks: np.ndarray) -> None:
        node, at, n = self.root, 0, len(ranks)
        while True:
            node.least, node.most = min(node.least, n), max(node.most, n)
            if node.owner >= 0 and self.find(node.owner) != self.find(me):
                node.owner = -1
            if at == n:
                node.ends.append(me)
                return
            child = node.children.get(int(ranks[at]))
            if child is None:
                leaf = Node(ranks[at:], n, n, me)
                leaf.ends.append(me)
                node.children[int(ranks[at])] = leaf
                return
            edge, rest = child.edge, ranks[at : at + len(child.edge)]
            differ = np.flatnonzero(edge[: len(rest)] != rest)
            same = int(differ[0]) if len(differ) else len(rest)
            if same < len(edge):
                middle = Node(edge[:same], child.least, child.most, child.owner)
                child.edge = edge[same:]
                middle.children[int(edge[same])] = child
                node.children[int(ranks[at])] = middle
                child = middle
            node, at = child, at + same


def forest(ids: list[int], sets: list[np.ndarray], num: int, den: int, parts: list | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among the sets; sets of equal parts (None: no part) count as joined already.

    Linked sets share one of the n - need(n) + 1 members that are rarest here, so a tree holds the sets that such members join.
    """
    if len(ids) < 2:
        return []
    members, counts = np.unique(np.concatenate(sets), return_counts=True)
    rank = np.empty(len(members), np.int64)
    rank[np.lexsort((members, -counts))] = np.arange(len(members))
    ranked = [np.sort(rank[np.searchsorted(members, s)]) for s in sets]
    # ranks rise from common to rare: the rarest are the last
    rare = [r[need(len(r), num, den) - 1 :] for r in ranked]
    member = np.concatenate(rare)
    order = np.argsort(member, kind="stable")
    holder = np.repeat(np.arange(len(sets)), [len(r) for r in rare])[order]
    heads = np.flatnonzero(np.diff(member[order], prepend=-1))
    parent, has, edges = list(range(len(sets))), np.zeros(len(members), bool), []
    lists = sorted((x for x in np.split(holder, heads[1:]) if len(x) > 1), key=len)
    linker = Trie(num, den, parent, has)
    first_of: dict = {}
    for i, part in enumerate(parts or ()):
        if part is not None:
            parent[i] = first_of.setdefault(part, i)
    # near copies of a list's first set are linked to it at once
    for holders in lists:
        head = int(holders[0])
        has[ranked[head]] = True
        for i in holders[1:].tolist():
            if linker.find(i) != linker.find(head) and linker.links(len(ranked[i]), len(ranked[head]), int(np.count_nonzero(has[ranked[i]]))):
                parent[linker.find(i)] = linker.find(head)
                edges.append((ids[i], ids[head]))
        has[ranked[head]] = False
    # sets meet through the lists they are in; what meets is one tree, whatever the number of lists
    meet = list(range(len(sets)))

    def place(x: int) -> int:
        while meet[x] != x:
            meet[x] = meet[meet[x]]
            x = meet[x]
        return x

    for holders in lists:
        head = place(int(holders[0]))
        for i in holders[1:].tolist():
            meet[place(i)] = head
    for i in range(len(sets)):
        meet[place(i)] = place(linker.find(i))
    groups: dict[int, list[int]] = {}
    for i in range(len(sets)):
        groups.setdefault(place(i), []).append(i)
    for group in groups.values():
        of: dict[int, list[int]] = {}
        for i in group:
            of.setdefault(linker.find(i), []).append(i)
        # what is left to compare lies between components: the largest is looked up in a trie of the others
        *others, largest = sorted(of.values(), key=lambda x: (len(x), ids[x[0]]))
        tree = Trie(num, den, parent, has)
        for i in sorted((i for x in others for i in x), key=lambda i: (len(ranked[i]), ids[i])):
            edges += [(ids[i], ids[j]) for j in tree.add(i, ranked[i])]
        for i in largest if others else ():
            edges += [(ids[i], ids[j]) for j in tree.add(i, ranked[i], keep=False)]
    return edges


def group_task(size: int, num: int, den: int):
    """Links of the documents of one group or cell, as edges of class numbers."""

    def task(table: pa.Table) -> pa.Table:
        shingler = Shingler(size)
        rows = dict(zip(table["cid"].to_pylist(), zip(table["text"].to_pylist(), table["part"].to_pylist())))
        edges = forest(list(rows), [shingler.grams(t) for t, _ in rows.values()], num, den, [part for _, part in rows.values()])
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return task


def size_class(n, num: int, den: int):
    """Sets whose classes differ by more than one cannot link."""
    return F.floor(F.log(n) / math.log(den / num) + 1e-9).cast("long")


def coarse_groups(prefixes: DataFrame) -> DataFrame:
    """Staged (cid, comp, shared) of classes that may link with another; prefixes: one row (cid, n, quota, prefix) per class.

    shared: how many classes hold a member of the class's prefix, on average; what others are copies of has much.
    """
    members = prefixes.select("cid", "quota", F.size("prefix").alias("reach"), F.explode("prefix").alias("m"))
    common = members.groupBy("m").agg(F.count("*").alias("df")).filter("df > 1")
    found = members.join(common, "m")
    each = found.groupBy("cid").agg(F.first("quota").alias("quota"), F.first("reach").alias("reach"), F.array_sort(F.collect_list(F.struct("df", "m"))).alias("ms"))
    # members that one document alone has come first in the order, and meet nobody
    left = F.col("quota") - (F.col("reach") - F.size("ms"))
    shared = F.aggregate("ms", F.lit(0.0), lambda a, x: a + x["df"]) / F.col("reach")
    kept = each.select("cid", shared.alias("shared"), F.explode(F.slice("ms", 1, F.greatest(left, F.lit(0)).cast("int"))["m"]).alias("m"))
    kept = stage(kept, "kept-members")
    hubs = kept.groupBy("m").agg(F.min("cid").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    edges = stage(kept.join(hubs, "m").select(F.col("cid").alias("a"), F.col("hub").alias("b")).distinct(), "coarse")
    joined = components(edges, "coarse")
    out = stage(joined.toDF("cid", "comp").join(kept.groupBy("cid").agg(F.max("shared").alias("shared")), "cid"), "groups")
    discard(kept, edges, joined)
    return out


def class_texts(texts: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """(cid, text): one text of each class of ids (column cid)."""
    keys = classes.join(ids, "cid").select("cid", "rep.id", "rep.h").toDF("cid", "rid", "rh")
    keys = F.broadcast(keys) if ids.count() <= BROADCAST_ROWS else keys.hint("shuffle_hash")
    return texts.join(keys, texts["id"].eqNullSafe(F.col("rid")) & (texts["h"] == F.col("rh"))).select("cid", "text").dropDuplicates(["cid"])


def search(texts: DataFrame, classes: DataFrame, tasks: DataFrame, size: int, num: int, den: int, name: str) -> DataFrame:
    """Staged edges (a, b) of the links that tasks find: rows (cid, task key, part), each class taken once in a task."""
    one = class_texts(texts, classes, tasks.select("cid").distinct())
    tasks = F.broadcast(tasks) if tasks.count() <= BROADCAST_ROWS else tasks
    return stage(one.join(tasks, "cid").groupBy("key").applyInArrow(group_task(size, num, den), "a long, b long"), name)


def gram_task(size: int):
    """Texts to their whole sets."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            sets = [shingler.grams(t).view(np.int64) for t in batch.column(1).to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))], ["cid", "grams"])

    return task


def can_link(texts: DataFrame, classes: DataFrame, members: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """members (cid, comp, n, shared) of large groups that may link, with `own`: how many of their n-grams no other of the group has.

    A link needs an overlap of need(n), so a set with more n-grams of its own than it can spare links with nobody.
    """
    sets = class_texts(texts, classes, members.select("cid")).mapInArrow(gram_task(size), "cid long, grams array<long>")
    grams = sets.join(members.select("cid", "comp"), "cid").select("comp", "cid", F.explode("grams").alias("g"))
    single = grams.groupBy("comp", "g").agg(F.count("*").alias("df"), F.min("cid").alias("cid")).filter("df = 1")
    own = single.groupBy("cid").agg(F.count("*").alias("own"))
    needed = F.ceil(F.col("n") * num / den)
    return members.join(own, "cid", "left").withColumn("own", F.coalesce("own", F.lit(0))).filter(F.col("own") <= F.col("n") - needed)


def cells_of(members: DataFrame, num: int, den: int, most: int) -> DataFrame:
    """members (cid, comp, n) with the cell each is dealt to: by size class c and hash h, of some `most` n-grams."""
    classed = members.withColumn("c", size_class(F.col("n"), num, den))
    blocks = classed.groupBy("comp", "c").agg(F.ceil(F.sum("n") / F.lit(most)).alias("blocks"))
    return classed.join(blocks, ["comp", "c"]).withColumn("h", F.pmod(F.xxhash64("cid"), F.col("blocks")))


def group_links(texts: DataFrame, classes: DataFrame, size: int, num: int, den: int, task_grams: int | None) -> DataFrame:
    """Staged edges (a, b) of class numbers whose components are those of all links."""
    groups = coarse_groups(classes)
    members = stage(classes.select("cid", "n").join(groups, "cid"), "group-members")
    discard(groups)
    total = members.agg(F.sum("n")).first()[0] or 0
    most = task_grams or int(min(max(total * TASK_SHARE, LEAST_GRAMS), MOST_GRAMS))
    sizes = members.groupBy("comp").agg(F.sum("n").alias("grams"), F.count("*").alias("members")).filter("members > 1")
    dealt = members.join(sizes, "comp")
    none = F.lit(None).cast("long").alias("part")
    small = dealt.filter(F.col("grams") <= most).select("cid", F.xxhash64(F.lit(0), "comp").alias("key"), none)
    crowd = stage(dealt.filter(F.col("grams") > most).select("cid", "comp", "n", "shared"), "crowd")
    large = stage(cells_of(can_link(texts, classes, crowd, size, num, den), num, den, most), "cells")
    cell = F.xxhash64(F.lit(1), "comp", "c", "h").alias("key")
    heads = large.groupBy("comp", "c", F.pmod("cid", F.lit(HEADS))).agg(F.max_by("cid", F.struct(-F.col("own"), "shared", "cid")).alias("cid")).select("comp", "cid", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)).alias("c"))
    with_heads = large.select("comp", "c", "h").distinct().join(heads, ["comp", "c"]).select("cid", cell, none)
    first = search(texts, classes, small.unionByName(large.select("cid", cell, none)).unionByName(with_heads), size, num, den, "links")
    if large.isEmpty():
        return first
    inside = components(first.join(large.select(F.col("cid").alias("a")), "a", "left_semi"), "parts").toDF("cid", "part")
    parted = stage(large.join(inside, "cid", "left").withColumn("part", F.coalesce("part", "cid")), "parted")
    weight = parted.groupBy("comp", "part").agg(F.sum("n").alias("w"))
    largest = weight.groupBy("comp").agg(F.max(F.struct("w", "part"))["part"].alias("largest"), F.count("*").alias("parts")).filter("parts > 1")
    torn = parted.join(largest, "comp")
    rest = stage(cells_of(torn.filter("part <> largest").select("cid", "comp", "n", "part"), num, den, most), "rest")
    # each cell of a torn group meets each cell of what is outside the group's largest part, where sizes can link
    ours = torn.select("comp", "c", "h").distinct().toDF("comp", "c1", "h1")
    theirs = rest.select("comp", "c", "h").distinct().toDF("comp", "c2", "h2")
    meets = ours.join(theirs, "comp").filter("abs(c1 - c2) <= 1").withColumn("key", F.xxhash64(F.lit(2), "comp", "c1", "h1", "c2", "h2"))
    sides = torn.join(meets, (torn["comp"] == meets["comp"]) & (torn["c"] == meets["c1"]) & (torn["h"] == meets["h1"])).select("cid", "key", "part")
    others = rest.join(meets, (rest["comp"] == meets["comp"]) & (rest["c"] == meets["c2"]) & (rest["h"] == meets["h2"])).select("cid", "key", "part")
    second = search(texts, classes, stage(sides.unionByName(others).distinct(), "meetings"), size, num, den, "more-links")
    return first.unionByName(second)


def linked(docs: DataFrame, size: int, num: int, den: int, id_col: str, text_col: str, task_grams: int | None) -> DataFrame:
    """One row per document: id, h (hash of the text), n, component_id, first (whether it is its component's first row)."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_of(text_col)).alias("h"), text_of(text_col).alias("text"))
    rows = stage(texts.mapInArrow(prefix_task(size, num, den), "id long, h long, n long, digest binary, quota long, prefix array<long>"), "prefixes")
    # rows without an id come last; what belongs to the set is the same in all rows of a class
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "h")
    found = rows.filter("n > 0").groupBy("digest").agg(F.min(place).alias("rep"), F.count("*").alias("rows"), *(F.first(c).alias(c) for c in ("n", "quota", "prefix")))
    classes = stage(found.withColumn("cid", F.monotonically_increasing_id()), "set-classes")
    flat = stage(rows.select("id", "h", "n", "digest"), "set-sizes")
    discard(rows)
    links = group_links(texts, classes, size, num, den, task_grams)
    joined = components(links, "links").toDF("cid", "component")
    known = stage(classes.select("cid", "digest", "rep", "rows").join(joined, "cid", "left").withColumn("component", F.coalesce("component", "cid")), "known")
    discard(classes)
    best = known.groupBy("component").agg(F.min("rep").alias("best"))
    named = stage(known.join(best, "component").select("digest", "rows", "best"), "named")
    of_class = join_by_class(flat.filter("n > 0"), named, "digest", "rows", flat.count())
    out = of_class.select("id", "h", "n", F.col("best.id").alias("component_id"), (place == F.col("best")).alias("first"))
    return out.unionByName(flat.filter("n = 0").select("id", "h", "n", F.col("id").alias("component_id"), F.lit(True).alias("first")))


def link_components(docs: DataFrame, size: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text", task_grams: int | None = None) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links). task_grams: bound of a task, for tests."""
    return linked(docs, size, num, den, id_col, text_col, task_grams).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, size: int, num: int, den: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id (without an id only if none has one), with all its columns.

    Documents without words all stay.
    """
    found = stage(linked(docs, size, num, den, id_col, text_col, None), "near-duplicates")
    first = found.filter("first").groupBy("id", "h").agg(((F.count("*") > 1) & (F.max("n") > 0)).alias("again"))
    return keep_rows(docs, first, id_col, F.xxhash64(text_of(text_col)))
