"""Exact self-join of documents on shingle overlap, by a token-group matrix.

Texts with equal shingle sets form one node, known by a hash of its set.  Under any one order
of the shingles two sets of similarity t or more share ``m`` of their first
``n - ceil(t n) + m`` shingles, so only these prefixes are indexed, with ``m`` (``needed``) a
share of the set's size: a text that has a passage or some phrases in common with others does
not get that far.  The order takes rare
shingles first, by a sketch of fixed size that counts all shingles of the corpus by hash (ties
by hash): it decides how many candidates there are, never which links are found.  Nodes
that share a prefix shingle with another node are partitioned into groups of similar sets (by
smallest hash, about GROUP nodes each); the matrix has, for every prefix shingle, the groups
whose union holds it.  A group is a candidate for another where their rows of the matrix meet;
when the two are opened in a task, sets whose overlap with the other group's whole union is
below the bound are set aside, and the rest are compared exactly.

Only connectivity is asked for, so candidates come in two rounds.  The first opens each group
and, for every shingle, the first group that has it with the others.  The second opens the pairs that are
still apart: components and groups that meet one first group are packed into a bounded number of units, so
that few pairs of units are listed however many near copies of one text are left apart; which texts are packed
together never decides a link.  Groups are opened in blocks of two buckets, so a
group is sent to a block once and not to each of its partners; a block emits a spanning forest of its links.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from protoflow.llm._tables import ensure_shipped, only, row_key, written
from protoflow.llm._words import column_groups, group_words, mix64, texts_of, windows
from protoflow.llm.components import components

WORDS = 3
PERCENT = 90
GROUP = 32             # nodes of a group, on average
GROUP_SHINGLES = 1 << 18
PACKS = 32             # most units of the nodes that meet one first group
SLOTS = 1 << 22        # counters of the sketch that orders the shingles; its size bounds what is broadcast
PAGE = 1 << 16
BUCKETS = 4            # least number of buckets of groups; tasks open pairs of buckets
BUCKET_BYTES = 32 << 20   # of the sets in a bucket
BROADCAST = 32 << 20   # bytes of keys that may be broadcast to the candidate texts and sets


def shingle_sets(texts: list[bytes], n: int = WORDS):
    """(shingles, text of each) of several texts, distinct and ascending within a text."""
    h, text, first = group_words(texts)
    w, at = windows(h, text, n)
    of = text[at]
    size = np.diff(first)
    for k in range(1, n):                                 # fewer words than a shingle: the sequence itself
        short = np.flatnonzero(size == k)
        if len(short):
            v = h[first[short]]
            for i in range(1, k):
                v = v * np.uint64(0xA0761D6478BD642F) + h[first[short] + i]
            w, of = np.concatenate([w, mix64(v + np.uint64(k))]), np.concatenate([of, short])
    order = np.lexsort((w, of))
    w, of = w[order], of[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (of[1:] != of[:-1])
    return w[new], of[new]


def _sets(column, n: int):
    """Slices of an Arrow text column: (first row, last row, shingles, row of each, row bounds)."""
    for a, b, part in column_groups(column):
        w, of = shingle_sets(texts_of(part, lower=True), n)
        yield a, b, w, of, np.searchsorted(of, np.arange(b - a + 1))


def _signature(w: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set: the wrapped sum of its shingles' second hashes, and its size."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(w + np.uint64(0x51ED270B)), dtype=np.uint64)])
    return mix64(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


def needed(size, percent: int):
    """How many shingles the prefixes of two linked sets share at least, if the smaller has ``size``
    (an array or a Column): half of what a set of that size may lack, plus one."""
    part = size * (100 - percent) / 200
    return 1 + (np.floor(part).astype(np.int64) if isinstance(size, np.ndarray) else F.floor(part + 1e-9))


def least_needed(size, percent: int):
    """``needed`` for the smallest set that a set of ``size`` can be linked with."""
    return needed(F.ceil(size * percent / 100 - 1e-9), percent)


def _nodes(docs: DataFrame, n: int) -> DataFrame:
    """One row per document (key, row, size, node, low), and the pages (page, counts) of every task's
    sketch of shingle counts."""
    schema = only(docs, key="key").schema.add("row", "long").add("size", "long").add("node", "long").add(
        "low", "long").add("page", "long").add("counts", "binary")
    names = [f.name for f in schema]

    def run(batches):
        import pyarrow as pa

        sketch = np.zeros(SLOTS, np.uint32)
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for a, b, w, of, bounds in _sets(batch.column(2), n):
                np.add.at(sketch, (w & np.uint64(SLOTS - 1)).astype(np.int64), np.uint32(1))
                low = np.zeros(b - a, np.uint64)
                some = np.flatnonzero(np.diff(bounds))
                low[some] = w[bounds[:-1][some]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(bounds)),
                     pa.array(_signature(w, bounds).view(np.int64)), pa.array(low.view(np.int64)),
                     pa.nulls(b - a, pa.int64()), pa.nulls(b - a, pa.binary())], names=names)
        pages = [p for p in range(0, SLOTS, PAGE) if sketch[p:p + PAGE].any()]
        if pages:
            none = pa.nulls(len(pages), pa.int64())
            small = np.minimum(sketch, 0xFFFF).astype("<u2")      # of one task: a shingle this common is last anyway
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(pages), kind), none, none, none, none, pa.array(pages, pa.int64()),
                 pa.array([small[p:p + PAGE].tobytes() for p in pages], pa.binary())], names=names)

    return docs.select("key", "row", "text").mapInArrow(run, schema)


def _sketch(pages: DataFrame) -> np.ndarray:
    """The summed sketch: pages are added on the executors, the driver gets SLOTS numbers whatever the corpus."""
    def add_up(group):
        import pyarrow as pa

        total = np.zeros(PAGE, np.uint64)
        for x in group.column("counts"):
            total += np.frombuffer(x.as_buffer(), "<u2")
        # steps of a twentieth keep the order of counts in two bytes
        level = np.minimum(20 * np.log2(1 + total.astype(float)), 0xFFFF).astype("<u2")
        return pa.table({"page": group.column("page").slice(0, 1), "counts": pa.array([level.tobytes()], pa.binary())})

    out = np.zeros(SLOTS, np.uint16)
    for r in pages.groupBy("page").applyInArrow(add_up, "page long, counts binary").collect():
        out[r["page"]:r["page"] + PAGE] = np.frombuffer(r["counts"], "<u2")
    return out


def _prefixes(docs: DataFrame, sketch: np.ndarray, n: int, percent: int) -> DataFrame:
    """(token, node, size): the prefix shingles of every set."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches):
        import pyarrow as pa

        level, seen = shared.value, set()
        for batch in batches:
            for _, _, w, of, bounds in _sets(batch.column(0), n):
                size, node = np.diff(bounds), _signature(w, bounds).view(np.int64)
                keep = np.zeros(len(size), bool)
                for i, x in enumerate(node.tolist()):     # equal sets of a task once
                    if size[i] and x not in seen:
                        keep[i] = True
                        if len(seen) < 1_000_000:
                            seen.add(x)
                order = np.lexsort((w, level[(w & np.uint64(SLOTS - 1)).astype(np.int64)], of))
                rank = np.arange(len(w)) - bounds[of]     # sorted by text, so places match
                length = size - (size * percent + 99) // 100 + needed(size, percent)
                mine = order[(rank < length[of]) & keep[of]]
                if len(mine):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(w[mine].view(np.int64)), pa.array(node[of[mine]]), pa.array(size[of[mine]])],
                        names=["token", "node", "size"])

    return docs.select("text").mapInArrow(run, "token long, node long, size long")


def _node_sets(docs: DataFrame, n: int) -> DataFrame:
    """(node, shingles) as ascending little-endian unsigned longs."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for _, _, w, _, bounds in _sets(batch.column(0), n):
                data = w.astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signature(w, bounds).view(np.int64)),
                     pa.array([data[8 * a:8 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())],
                              pa.binary())], names=["node", "shingles"])

    return docs.select("text").mapInArrow(run, "node long, shingles binary")


class _Forest:
    """Components of numbered places; the root of each is its smallest place."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def link(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def one(self, places: list[int]) -> bool:
        """Whether all places are in one component."""
        first = self.root(places[0])
        return all(self.root(x) == first for x in places[1:])


def open_pair(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs (place in left, place in right) of two groups of sets."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def within(sets: list[np.ndarray], union: np.ndarray) -> list[int]:
        """Sets whose overlap with the other group's union reaches the bound."""
        return [i for i, s in enumerate(sets)
                if np.isin(s, union, assume_unique=True).sum() * 100 >= percent * len(s)]

    a = within(left, np.unique(np.concatenate(right)))
    if not a:
        return none
    b = within(right, np.unique(np.concatenate([left[i] for i in a])))
    if not b:
        return none
    tokens, place = np.unique(np.concatenate([left[i] for i in a] + [right[j] for j in b]), return_inverse=True)
    sizes = np.array([len(left[i]) for i in a] + [len(right[j]) for j in b])
    row = np.repeat(np.arange(len(sizes)), sizes)
    both = np.zeros((len(a), len(b)))
    for c in range(0, len(tokens), 1 << 15):              # a strip of the token-set matrix at a time
        mine = (place >= c) & (place < c + (1 << 15))
        bits = np.zeros((len(sizes), min(1 << 15, len(tokens) - c)), np.float32)
        bits[row[mine], place[mine] - c] = 1
        both += bits[:len(a)] @ bits[len(a):].T
    union = sizes[:len(a), None] + sizes[None, len(a):] - both
    i, j = np.nonzero(100 * both >= percent * union)
    return np.array(a)[i], np.array(b)[j]


def _open(pairs: DataFrame, members: DataFrame, percent: int, buckets: int, own: bool) -> DataFrame:
    """Links (u, v) found by opening pairs (x, y) of units; ``members`` has (unit, group, node, shingles).
    Rows of one node are linked already; a group is opened with itself if ``own``.

    Groups fall into ``buckets`` by a hash, and a task opens a block: the groups of two buckets.  A pair of units
    goes to the blocks of their buckets, and a group to each block that needs it, once: its sets are copied at
    most twice per bucket, however many partners it has.  Inside a block, groups that earlier links have
    joined already are not compared again, and the links leave as one spanning forest.
    """
    members = members.withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets)).cast("int"))
    homes = members.select("unit", "bucket").distinct()
    placed = (pairs.join(homes.select(F.col("unit").alias("x"), F.col("bucket").alias("i")), "x")
              .join(homes.select(F.col("unit").alias("y"), F.col("bucket").alias("j")), "y"))
    block = F.least("i", "j").cast("long") * buckets + F.greatest("i", "j")
    placed = placed.select(block.alias("block"), "x", "i", "y", "j")
    needs = placed.select("block", F.col("x").alias("unit"), F.col("i").alias("bucket")).unionByName(
        placed.select("block", F.col("y").alias("unit"), F.col("j").alias("bucket"))).distinct()
    rows = needs.join(members, ["unit", "bucket"]).select("block", "unit", "bucket", "group", "node", "shingles")

    def run(sides, wanted):
        import pyarrow as pa

        nodes, place = np.unique(sides.column("node").to_numpy(), return_inverse=True)
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in sides.column("shingles")]
        groups: dict = {}                                  # (unit, bucket) -> group -> rows
        for r, (unit, bucket, group) in enumerate(zip(*[sides.column(c).to_pylist() for c in ("unit", "bucket", "group")])):
            groups.setdefault((unit, bucket), {}).setdefault(group, []).append(r)
        forest, place = _Forest(len(nodes)), place.tolist()
        for x, i, y, j in sorted(zip(*[wanted.column(c).to_pylist() for c in ("x", "i", "y", "j")])):
            for a, left in groups.get((x, i), {}).items():
                for b, right in groups.get((y, j), {}).items():
                    if x == y and (b < a or b == a and not own):
                        continue
                    if forest.one([place[r] for r in left + right]):
                        continue
                    for p, q in zip(*[k.tolist() for k in open_pair([sets[r] for r in left], [sets[r] for r in right], percent)]):
                        forest.link(place[left[p]], place[right[q]])
        root = np.array([forest.root(x) for x in range(len(nodes))], np.int64)
        leaf = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.table({"u": pa.array(nodes[leaf], pa.int64()), "v": pa.array(nodes[root[leaf]], pa.int64())})

    wanted = placed.select((F.col("block") + F.lit(0)).alias("at"), "x", "i", "y", "j")     # a column of its own
    return rows.groupBy("block").cogroup(wanted.groupBy("at")).applyInArrow(run, "u long, v long")


def _grouped_by(nodes: DataFrame, by: str) -> DataFrame:
    """``nodes`` with ``group``: nodes that agree in ``by``, cut by a hash into parts of bounded size."""
    parts = nodes.groupBy(by).agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / GROUP), F.ceil(F.sum("size") / GROUP_SHINGLES)).alias("parts"))
    return nodes.join(parts, by).withColumn(
        "group", F.xxhash64(F.col(by), F.pmod(F.xxhash64("node"), F.col("parts")))).drop("parts")


def _units(active: DataFrame, roots: DataFrame, star: DataFrame) -> DataFrame:
    """(node, size, group, owner, part, unit): what is linked so far, in units for the second round.

    ``owner`` is a node's component, or its group if it has no link; ``part`` its component or itself.  Owners
    that meet one first group (by ``star``) share at most PACKS units.
    """
    first = star.groupBy(F.col("b").alias("group")).agg(F.min("a").alias("hub"))
    placed = active.join(roots, "node", "left").join(first, "group", "left").withColumn("hub", F.coalesce("hub", "group"))
    linked = _grouped_by(placed.where("root is not null").drop("group"), "root")
    columns = ["node", "size", "group", "hub", F.coalesce("root", "group").alias("owner"), F.coalesce("root", "node").alias("part")]
    placed = written(linked.select(*columns).unionByName(placed.where("root is null").select(*columns)), "owners")
    owners = placed.groupBy("owner").agg(F.min("hub").alias("hub"), F.count(F.lit(1)).alias("n"))
    packs = owners.groupBy("hub").agg(F.least(F.ceil(F.sum("n") / GROUP), F.lit(PACKS)).alias("packs"))
    owners = owners.join(packs, "hub").select(
        "owner", F.xxhash64("hub", F.pmod(F.xxhash64("owner"), F.col("packs"))).alias("unit"))
    return written(placed.drop("hub").join(owners, "owner").select("node", "size", "group", "owner", "part", "unit"), "units")


def similar_nodes(docs: DataFrame, nodes: DataFrame, sketch: np.ndarray, n: int, percent: int) -> DataFrame:
    """Links (u, v) that connect every two nodes a chain of links connects."""
    post = written(_prefixes(docs, sketch, n, percent), "prefixes")
    for _ in range(2):                                    # those that are left may have lost their partners
        first, last = (f("node").over(Window.partitionBy("token")) for f in (F.min, F.max))     # one shuffle
        shared = post.select("token", "node", "size", first.alias("a"), last.alias("b")).where("a != b")
        shared = written(shared.select("token", "node", "size").distinct(), "shared")
        enough = shared.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.first("size").alias("s")).where(
            F.col("c") >= least_needed(F.col("s"), percent)).select("node")
        post = written(shared.join(enough, "node"), "matrix").select("token", "node", "size")
    active = (nodes.groupBy("node", "size", "low").agg(F.min("row").alias("row"))
              .join(post.select("node").distinct(), "node", "left_semi"))
    active = written(_grouped_by(active, "low"), "groups")
    # Keys of a checked size are sent to the texts and sets; beyond it both sides are shuffled.
    total = active.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("shingles")).first()
    sent = F.broadcast if total["n"] * 24 <= BROADCAST else (lambda keys: keys)
    buckets = max(BUCKETS, -(-8 * total["shingles"] // BUCKET_BYTES))
    picked = docs.join(sent(active.select("row")), "row", "left_semi")
    sets = written(_node_sets(picked, n).join(sent(active.select("node")), "node", "left_semi")
                   .dropDuplicates(["node"]), "sets")
    matrix = post.join(active.select("node", "group"), "node").groupBy("token", "group").agg(F.min("size").alias("low"))
    first = F.min("group").over(Window.partitionBy("token"))
    star = matrix.select(first.alias("a"), F.col("group").alias("b"), "low").where("a != b")
    star = star.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.min("low").alias("low")).where(
        F.col("c") >= needed(F.ceil(F.col("low") * percent / 100 - 1e-9), percent)).select("a", "b")
    star = written(star, "star")
    own = active.groupBy("group").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(
        F.col("group").alias("a"), F.col("group").alias("b"))
    members = sets.join(sent(active.select("node", "group")), "node").withColumn("unit", F.col("group"))
    pairs = own.unionByName(star).toDF("x", "y")
    first = written(_open(pairs, members, percent, buckets, True), "links-1")

    placed = _units(active, components(first), star)
    meets = written(post.select("token", "node").join(placed.select("node", "unit", "size", "owner"), "node").groupBy(
        "token", "unit").agg(F.min("size").alias("low"), F.max("size").alias("high"),
                             (F.min("owner") != F.max("owner")).alias("several")), "meets")
    inside = meets.where("several").groupBy("unit").agg(F.count(F.lit(1)).alias("c"), F.min("low").alias("low")).where(
        F.col("c") >= needed(F.ceil(F.col("low") * percent / 100 - 1e-9), percent)).select(
        F.col("unit").alias("x"), F.col("unit").alias("y"))
    x, y = meets.alias("x"), meets.alias("y")
    apart = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.unit") < F.col("y.unit"))
                   & (F.col("x.high") * 100 >= F.col("y.low") * percent)
                   & (F.col("y.high") * 100 >= F.col("x.low") * percent)).groupBy(
        F.col("x.unit").alias("x"), F.col("y.unit").alias("y")).agg(
        F.count(F.lit(1)).alias("c"), F.min(F.least("x.low", "y.low")).alias("low")).where(
        F.col("c") >= needed(F.col("low"), percent)).select("x", "y")
    members = sets.join(sent(placed.select("node", "group", "part", "unit")), "node").withColumn("node", F.col("part"))
    second = written(_open(written(apart.unionByName(inside), "apart"), members, percent, buckets, False), "links-2")
    return first.unionByName(second)


def _placed(docs: DataFrame, key: str, text: str, n: int, percent: int) -> DataFrame:
    """(key, row, size, root): the component of every row, NULL for rows without a set."""
    ensure_shipped(docs.sparkSession)
    src = only(docs, key=key, text=text)
    src = src.select("key", row_key(F.col("key"), F.col("text")).alias("row"), "text")
    found = written(_nodes(src, n), "shingles")
    nodes = found.where("page is null").select("key", "row", "size", "node", "low")
    sketch = _sketch(found.where("page is not null").select("page", "counts"))
    links = similar_nodes(src, nodes.where("size > 0"), sketch, n, percent)
    return nodes.join(components(links), "node", "left").select(
        "key", "row", "size", F.when(F.col("size") > 0, F.coalesce("root", "node")).alias("root"))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS,
                       percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) for every row of ``docs``.

    Words are lower-cased (A-Z) runs without white space.  Two rows link when 100 times the
    size of their sets' intersection is ``percent`` times that of the union or more;
    ``component_id`` is the smallest key a row reaches.  NULL, empty and blank texts have no set and
    stand alone; rows with equal sets (repeated rows too) are linked; a NULL key is the
    smallest only where no other is there.  Other columns are ignored; an empty table gives no rows.
    """
    placed = _placed(docs, key, text, n, percent)
    least = placed.where("root is not null").groupBy("root").agg(F.min("key").alias("least"))
    return placed.join(least, "root", "left").select(
        F.col("key").alias(key), F.col("size").alias("n_shingles"), F.coalesce("least", "key").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS,
             percent: int = PERCENT) -> DataFrame:
    """The documents with one row of each component kept, columns unchanged.

    The row with the smallest key stays (NULL last; among rows of one key, the smallest content
    hash; of equal rows, any one).  Rows without a set are all kept.
    """
    placed = written(_placed(docs, key, text, n, percent).where("root is not null"), "placed")
    least = placed.groupBy("root").agg(F.min("key").alias("least"))
    first = placed.join(least, "root").where(F.col("key").eqNullSafe(F.col("least")))
    stay = first.groupBy("root").agg(F.min("row").alias("_pf_stay")).select("_pf_stay")
    own = row_key(docs[key], docs[text])
    blank = F.length(F.btrim(F.coalesce(docs[text], F.lit("")), F.lit(" \t\n\r\x0b\x0c"))) == 0
    one = (docs.where(~blank).withColumn("_pf_row", own).join(stay, F.col("_pf_row") == F.col("_pf_stay"), "left_semi")
           .dropDuplicates(["_pf_row"]).drop("_pf_row"))
    return one.unionByName(docs.where(blank))
