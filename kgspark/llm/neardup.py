"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

Texts become sets of five-word shingles. Each tree of the forest orders the
signatures by its own sequence of min-hashes: sorted, they are a prefix trie, and
the texts that share a prefix are one run of the sorted rows. A pair at the
threshold shares the ``least`` first hashes in some tree with the target
probability, so matched prefixes are shortened from ``longest`` down to there.

From candidates to links, without emitting all pairs of a group:

1. Texts with equal shingle sets are one node; copies are counted, not joined.
2. One pass over each sorted tree ties a node to the first node of the longest
   prefix that it shares, and, as that one may not be near, of each shorter
   prefix that begins elsewhere: at most ``longest - least + 1`` edges a tree.
   Edges whose signatures agree join nodes to clusters.
3. Inside a cluster *all* pairs are verified exactly, in blocks: large clusters
   are cut into chunks and each pair of chunks is one task. A task sends out
   counts and one edge a node, not pairs.
4. Runs of the shortest prefix that hold several clusters compare signatures
   across clusters, again in blocks; only pairs whose estimate comes near the
   threshold are sent out, and each is then verified on its texts.

Links of both kinds give components, which are the classes.
"""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from kgspark.operators.components import connected_components
from kgspark.runtime import discard, materialize

from . import common

PRIME = np.uint64(0x9E3779B97F4A7C15)
FINAL = np.uint64(0xC2B2AE3D27D4EB4F)
NO_ID = (1 << 63) - 1
#: Texts without words, in Java's notation: white space as Python's ``split`` knows it (fixed values).
BLANK = r"\A[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*\z"


@dataclass(frozen=True)
class Settings:
    words: int = 5
    threshold: float = 0.8
    trees: int = 20
    #: Hashes of a tree's sequence; a node is matched by as many of them as it shares with another.
    longest: int = 8
    target: float = 0.999
    #: Standard deviations below the threshold at which a signature estimate still counts as a candidate.
    slack: float = 3.75
    #: Nodes of a chunk; a task verifies one pair of chunks.
    chunk: int = 192

    @property
    def least(self) -> int:
        """Shortest prefix: the longest at which a pair at the threshold still meets in some tree with the target probability."""
        d = self.longest
        while d > 1 and 1 - (1 - self.threshold**d) ** self.trees < self.target:
            d -= 1
        return d

    @property
    def least_agree(self) -> int:
        n = self.trees * self.longest
        return int(n * self.threshold - self.slack * (n * self.threshold * (1 - self.threshold)) ** 0.5)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * FINAL
        return x ^ (x >> np.uint64(29))


class Shingler:
    """Sorted arrays of distinct 64-bit shingle hashes, one for each text.

    Words are lower-cased and split at white space. A text of fewer words than a
    shingle has is one shingle; a text without words has none.
    """

    def __init__(self, words: int) -> None:
        self.words = words
        self.hashes = common.TokenHashes()

    def __call__(self, texts: list) -> list[np.ndarray]:
        return [self.one(t or "") for t in texts]

    def one(self, text: str) -> np.ndarray:
        h = self.hashes(text.lower().split())
        if not len(h):
            return h
        k = min(self.words, len(h))
        n = len(h) - k + 1
        with np.errstate(over="ignore"):
            out = np.full(n, np.uint64(k), dtype=np.uint64)
            for i in range(k):
                out = out * PRIME + h[i : i + n]
        return np.unique(_mix(out))


_SHINGLERS: dict[int, Shingler] = {}


def shingler(words: int) -> Shingler:
    return _SHINGLERS.setdefault(words, Shingler(words))


def set_id(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signatures(sets: list[np.ndarray], s: Settings) -> np.ndarray:
    """Min-hashes (32 bits) of each non-empty set, one column for each function; sets are taken in cache-sized runs."""
    n = s.trees * s.longest
    rng = np.random.default_rng(5)
    mul = rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    out = np.empty((len(sets), n), dtype=np.uint32)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(sets):
            j, size = i, 0
            while j < len(sets) and (j == i or size + len(sets[j]) <= 60_000):
                size += len(sets[j])
                j += 1
            flat = np.concatenate(sets[i:j])
            at = np.concatenate([[0], np.cumsum([len(x) for x in sets[i : j - 1]])]).astype(np.int64)
            for k in range(n):
                out[i:j, k] = np.minimum.reduceat(((flat * mul[k] + add[k]) >> np.uint64(32)).astype(np.uint32), at)
            i = j
    return out


def labels(sig: np.ndarray, s: Settings) -> np.ndarray:
    """Each tree's sequence of 16-bit hashes as bytes that sort as a trie does; rows x trees."""
    short = np.ascontiguousarray((sig & np.uint32(0xFFFF)).astype(">u2"))
    return short.view(f"V{2 * s.longest}").reshape(len(sig), s.trees)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Exact intersection sizes of all pairs, by products of 0/1 columns; shingles of a single set do not matter."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    out = np.zeros((m, m), dtype=np.float64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    top = int(column[-1]) + 1 if len(column) else 0
    for low in range(0, top, 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        part = np.zeros((m, min(4096, top - low)), dtype=np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        out += part @ part.T
    return out


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix of pairs with Jaccard at or above the threshold; the diagonal is False."""
    inter = overlaps(sets)
    size = np.array([len(x) for x in sets], dtype=np.float64)
    out = inter >= threshold * (size[:, None] + size[None, :] - inter) - 1e-9
    np.fill_diagonal(out, False)
    return out


def _roots(link: np.ndarray) -> np.ndarray:
    """For each row the least row it is connected to."""
    root = np.arange(len(link))
    a, b = np.nonzero(link)
    while len(a):
        before = root.copy()
        np.minimum.at(root, a, root[b])
        root = root[root]
        if (root == before).all():
            break
    return root


def sketch(docs: DataFrame, s: Settings, id_col: str = "doc_id") -> DataFrame:
    """Every row with ``node`` (null without words), ``th`` (hash of the text), ``sig`` (8 bits of each min-hash) and ``labels``."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        sets = shingler(s.words)(cols["text"])
        full = [i for i, x in enumerate(sets) if len(x)]
        out = {"doc_id": cols["doc_id"], "th": cols["th"], "node": [None] * len(sets), "sig": [None] * len(sets), "labels": [None] * len(sets)}
        if full:
            sig = signatures([sets[i] for i in full], s)
            trees, short = labels(sig, s), (sig & np.uint32(255)).astype(np.uint8).view(np.int8)
            for k, i in enumerate(full):
                out["node"][i], out["sig"][i], out["labels"][i] = set_id(sets[i]), short[k], [bytes(x) for x in trees[k]]
        return out

    return common.map_batches(_rows(docs, id_col), run, "doc_id long, th long, node binary, sig array<tinyint>, labels array<binary>")


def _rows(docs: DataFrame, id_col: str) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def shared(a: bytes, b: bytes) -> int:
    """Hashes in the common prefix of two labels."""
    n = 0
    while a[2 * n : 2 * n + 2] == b[2 * n : 2 * n + 2] and 2 * n < len(a):
        n += 1
    return n


class Climb:
    """Walks sorted labels of one tree; keeps the first node of the current run of each prefix length."""

    def __init__(self, s: Settings) -> None:
        self.s, self.key, self.label, self.heads = s, None, b"", {}

    def step(self, key: int, label: bytes, node: bytes) -> list[tuple[int, bytes, bytes, int, bool]]:
        """(key, node, head, depth, whether the node's first row of the run) of the heads that the node meets, longest prefix first; a run's own head comes with depth 0 before its second node."""
        least, longest = self.s.least, self.s.longest
        if key != self.key:
            self.key, self.label, self.heads = key, label, dict.fromkeys(range(least, longest + 1), (node, True))
            return []
        depth, self.label = shared(self.label, label), label
        out, met = [], set()
        root, alone = self.heads[least]
        if alone:
            out.append((key, root, root, 0, True))
            self.heads = {d: (h, False) for d, (h, _) in self.heads.items()}
        for d in range(depth, least - 1, -1):
            head = self.heads[d][0]
            if head not in met:
                out.append((key, node, head, d, not met))
                met.add(head)
        for d in range(max(depth, least - 1) + 1, longest + 1):
            self.heads[d] = node, False
        return out


def forest(nodes: DataFrame, s: Settings) -> DataFrame:
    """``key, node, hub, depth, first``: members of every run of the shortest prefix with more than one node, and the heads that they meet.

    ``key`` names the run. Rows of one run are sorted and read as a stream, so
    the memory of a task does not depend on the size of a run.
    """
    schema = "key long, node binary, hub binary, depth int, first boolean"
    arrow = common.arrow_schema(schema)

    def run(batches):  # noqa: ANN001, ANN202
        climb = Climb(s)  # the first and last row of a batch always count: runs cross batches
        for b in batches:
            key = b.column(0).to_numpy()
            keep = np.zeros(len(key), dtype=bool)
            keep[1:] = key[1:] == key[:-1]
            keep[:-1] |= keep[1:]
            keep[-1:] = keep[:1] = True
            some = np.flatnonzero(keep)
            label, node = b.column(1).take(pa.array(some)).to_pylist(), b.column(2).take(pa.array(some)).to_pylist()
            out = [x for k, l, n in zip(key[some].tolist(), label, node, strict=True) for x in climb.step(k, l, n)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    rows = nodes.select("node", F.posexplode("labels").alias("tree", "label"))
    keyed = rows.select(F.xxhash64("tree", F.substring("label", 1, 2 * s.least)).alias("key"), "label", "node")
    return keyed.repartition("key").sortWithinPartitions("key", "label", "node").mapInArrow(run, schema)


def _agree(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda n, v: n + v)


def _paired(members: DataFrame, size: Column, chunk: int) -> DataFrame:
    """Each member once for every pair of chunks that its own chunk is in: ``own, lo, hi``."""
    chunks = F.ceil(size / chunk).cast("int")
    own = F.pmod(F.xxhash64("node"), chunks).cast("int")
    other = F.explode(F.sequence(F.lit(0), chunks - 1))
    return members.withColumns({"own": own}).withColumn("other", other).withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other")


def _by_group(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:  # noqa: ANN001
    """Apply ``fn(group as dict of lists) -> dict of lists`` to each group of ``keys``; groups are blocks of bounded size."""
    arrow = common.arrow_schema(schema)

    def run(batches):  # noqa: ANN001, ANN202
        held, size = {f.name: [] for f in arrow}, 0
        for group in common.groups(batches, keys):
            out = fn(group)
            for name, values in out.items():
                held[name].extend(values)
            size += len(out[arrow[0].name])
            if size >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(held[f.name], type=f.type) for f in arrow], schema=arrow)
                held, size = {f.name: [] for f in arrow}, 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(held[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _texts(docs: DataFrame, members: DataFrame, id_col: str) -> DataFrame:
    """``members`` (with ``rid`` and ``th``) joined with the one text of that id and hash, however many rows hold it."""
    texts = _rows(docs, id_col).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("rid"), "th", "text")
    texts = texts.join(members.select("rid", "th"), ["rid", "th"], "left_semi").dropDuplicates(["rid", "th"])
    return members.join(texts, ["rid", "th"]).drop("rid", "th")


def _members(nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Members of the clusters and the sizes of these."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return nodes.select("node", "rid", "th", "copies").join(clusters, "node").join(sizes, "cluster")


def _within(docs: DataFrame, members: DataFrame, s: Settings, id_col: str) -> DataFrame:
    """Links between members of one cluster: (a, b, links), b the least node that a's block ties it to."""
    blocks = _texts(docs, _paired(members, F.col("size"), s.chunk).select("cluster", "lo", "hi", "own", "node", "copies", "rid", "th"), id_col)

    def run(g: dict[str, list]) -> dict[str, list]:
        found = {}
        for node, text, own, copies in zip(g["node"], g["text"], g["own"], g["copies"], strict=True):
            if node not in found:
                x = shingler(s.words).one(text or "")
                if set_id(x) == node:  # an id may name several texts
                    found[node] = x, own, copies
        names = sorted(found)
        if len(names) < 2:
            return {"a": [], "b": [], "links": []}
        own, copies = np.array([found[k][1] for k in names]), np.array([found[k][2] for k in names])
        link = linked([found[k][0] for k in names], s.threshold)
        if g["lo"][0] != g["hi"][0]:
            link &= own[:, None] != own[None, :]
        links, root = link @ copies, _roots(link)
        some = np.flatnonzero(links).tolist()
        return {"a": [names[i] for i in some], "b": [names[root[i]] for i in some], "links": [int(links[i]) for i in some]}

    return _by_group(blocks, ["cluster", "lo", "hi"], run, "a binary, b binary, links long")


def _pairs(nodes: DataFrame, runs: DataFrame, clusters: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b) of nodes of different clusters that share a prefix and whose signatures agree."""
    placed = runs.where("first").select("key", "node").join(clusters, "node", "left").select("key", "node", F.coalesce("cluster", "node").alias("cluster"))
    mixed = placed.groupBy("key").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high").select("key", "size")
    members = placed.join(mixed, "key").join(nodes.select("node", "sig"), "node")
    least = s.least_agree

    def run(g: dict[str, list]) -> dict[str, list]:
        sig = np.array(g["sig"], dtype=np.int8)
        names = {c: i for i, c in enumerate(sorted(set(g["cluster"])))}
        cluster, own = np.array([names[c] for c in g["cluster"]]), np.array(g["own"])
        cross = g["lo"][0] != g["hi"][0]
        a, b = [], []
        for i in range(len(sig)):
            ok = (sig[i + 1 :] == sig[i]).sum(axis=1) >= least
            ok &= cluster[i + 1 :] != cluster[i]
            if cross:
                ok &= own[i + 1 :] != own[i]
            for j in np.flatnonzero(ok).tolist():
                x, y = g["node"][i], g["node"][i + 1 + j]
                a.append(min(x, y))
                b.append(max(x, y))
        return {"a": a, "b": b}

    blocks = _paired(members, F.col("size"), s.chunk * 4).select("key", "lo", "hi", "own", "node", "cluster", "sig")
    return _by_group(blocks, ["key", "lo", "hi"], run, "a binary, b binary").distinct()


def _across(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, s: Settings, id_col: str) -> DataFrame:
    """Links between the nodes of pairs: (a, b, links), both ways."""
    info = nodes.select("node", "rid", "th", "copies")
    side = lambda name: info.select(F.col("node").alias(name), "rid", "th", F.col("copies").alias(f"copies_{name}"))
    first = _texts(docs, pairs.join(side("a"), "a"), id_col).withColumnRenamed("text", "text_a")
    both = _texts(docs, first.join(side("b"), "b"), id_col).withColumnRenamed("text", "text_b")

    def verify(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"a": [], "b": [], "links": []}
        one = shingler(s.words).one
        for a, b, ta, tb, na, nb in zip(cols["a"], cols["b"], cols["text_a"], cols["text_b"], cols["copies_a"], cols["copies_b"], strict=True):
            x, y = one(ta or ""), one(tb or "")
            if set_id(x) == a and set_id(y) == b:
                n = len(np.intersect1d(x, y, assume_unique=True))
                if n >= s.threshold * (len(x) + len(y) - n) - 1e-9:
                    out["a"] += [a, b]
                    out["b"] += [b, a]
                    out["links"] += [nb, na]
        return out

    found = common.map_batches(both.select("a", "b", "text_a", "text_b", "copies_a", "copies_b"), verify, "a binary, b binary, links long", rows=128)
    return found.groupBy("a", "b").agg(F.max("links").alias("links"))  # rows that repeat an id repeat a pair


def near_duplicates(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id") -> DataFrame:
    """Class and link count of every document: ``doc_id, class_id, n_links, node, is_first``.

    ``class_id`` is the least id of the documents connected by links;
    ``n_links`` counts the other documents at or above the threshold, copies
    included; ``node`` names the shingle set; ``is_first`` marks the rows that
    hold the class's least (id, node), which more than one row does only if rows
    repeat. Texts without words (null, empty, blank) link to nothing and are
    their own class. A null id sorts last and gives a null class_id if the whole
    class has none. Very long texts are read whole, an empty table gives no rows.
    Other columns are not carried, so their names cannot clash.
    """
    return _marked(docs, s, id_col)[0]


def _marked(docs: DataFrame, s: Settings, id_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of ``near_duplicates``, and the tables that they are read from."""
    sketched = materialize(sketch(docs, s, id_col), "near-rows")
    rid = F.coalesce("doc_id", F.lit(NO_ID))
    nodes = sketched.where("node is not null").groupBy("node").agg(F.min(F.struct(rid.alias("rid"), "th")).alias("least"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("labels").alias("labels"))
    nodes = materialize(nodes.select("node", "least.*", "copies", "sig", "labels"), "near-nodes")
    rows = materialize(sketched.select("doc_id", "node"), "near-ids")
    discard(sketched)
    runs = materialize(forest(nodes, s), "near-runs")
    star = runs.where("depth > 0").select("node", "hub").distinct()
    star = star.join(nodes.select("node", F.col("sig").alias("sig_a")), "node").join(nodes.select(F.col("node").alias("hub"), F.col("sig").alias("sig_b")), "hub")
    tied = connected_components(star.where(_agree(F.col("sig_a"), F.col("sig_b")) >= s.least_agree), "node", "hub")
    clusters = tied.withColumnRenamed("component", "cluster")
    # queries of their own: adaptive execution plans what is left of a query anew after every stage
    members, pairs = materialize(_members(nodes, clusters), "near-members"), materialize(_pairs(nodes, runs, clusters, s), "near-pairs")
    links = materialize(_within(docs, members, s, id_col).unionByName(_across(docs, nodes, pairs, s, id_col)), "near-links")
    brief = materialize(nodes.select("node", "rid", "copies"), "near-brief")
    discard(runs, tied, members, pairs, nodes)

    classes = connected_components(links)
    counts = links.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    known = brief.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = known.groupBy("component").agg(F.min(F.struct("rid", "node")).alias("first"))
    known = known.join(first, "component").join(counts, "node", "left").select("node", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    marked = rows.join(known, "node", "left").select(
        "doc_id",
        F.when(F.col("first").isNull(), F.col("doc_id")).when(F.col("first.rid") != NO_ID, F.col("first.rid")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "node",
        (F.col("first").isNull() | ((F.col("first.rid") == rid) & (F.col("first.node") == F.col("node")))).alias("is_first"),
    )
    return marked, [rows, links, brief, classes]


def keep_first(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each class: the one of the least (id, shingle set).

    Rows that repeat that id and shingle set are one document, of which one row
    stays. Texts without words all stay. Columns are as they were.
    """
    marked, tables = _marked(docs, s, id_col)
    r, n = (f"{name}_{uuid4().hex}" for name in ("rid", "node"))  # no column of ``docs`` has these names
    rid = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    chosen = marked.where("is_first and node is not null").select(F.coalesce("doc_id", F.lit(NO_ID)).alias(r), F.col("node").alias(n)).distinct()
    chosen = materialize(chosen, "near-chosen")
    discard(*tables)
    blank = F.coalesce(F.col("text"), F.lit("")).rlike(BLANK)
    schema = StructType([*docs.schema.fields, StructField(n, BinaryType())])

    def run(cols: dict[str, list]) -> dict[str, list]:
        return cols | {n: [set_id(x) if len(x) else None for x in shingler(s.words)(cols["text"])]}

    # one shuffle of the texts: the join and the deduplication share its keys
    tagged = common.map_batches(docs.where(~blank), run, schema).withColumn(r, rid)
    one = tagged.join(chosen, [r, n], "left_semi").dropDuplicates([r, n])
    return one.select(*docs.columns).unionByName(docs.where(blank))


#: DuckDB SQL of the same rows by brute force over shared shingles, for tables without null or repeated ids.
ORACLE_SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS t FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')]
    ELSE list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) END) AS g FROM t
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 5 * k >= 4 * (a.n + b.n - k)
), walk(id, lo) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.y, walk.lo FROM walk JOIN e ON e.x = walk.id
)
SELECT c.id AS doc_id, c.class_id, coalesce(l.n, 0) AS n_links
FROM (SELECT id, min(lo) AS class_id FROM walk GROUP BY id) c LEFT JOIN (SELECT x, count(*) AS n FROM e GROUP BY x) l ON l.x = c.id
"""
