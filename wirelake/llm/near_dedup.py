"""Near-duplicate documents by a chosen-path set similarity join on minwise tokens.

A document's set is the distinct shingles of its normalised words. Documents of equal sets of words in order are
one class, kept by its smallest id; only classes are joined. Each of several independent trees branches a class
recursively: a node chooses one position of the minwise sketch, or two, so that a pair near the threshold is expected to
share one child or more, and a class goes to the child named by its token there. Nodes of one class drop
out. In the other nodes every class is first held against the node's smallest and, where they are many, the one that has the
most links so far, as large groups are often copies of one original (stars, linear in the node). Then, of what looks apart after that,
small nodes are compared exhaustively, in blocks, and large ones are branched deeper, until the depth limit; there, what is still
apart in large nodes is compared exhaustively too. What links have joined is contracted: only members of different
components are compared, so that a group costs its members, and pairs of it only where they remain apart.

Two sketches serve this. Tokens at minwise positions choose paths, and a few bits of them screen the stars. The smallest hashes of
a set (the whole set, if it has no more than ``SMALLEST``) screen pairs inside a node: for sets that small the comparison
is exact, for others it lets pairs pass from four standard errors below the threshold. Every link is confirmed on the
full sets; members that only looked alike are compared again. Links make components, and a component keeps its smallest document.

At the first depth of six, a pair whose sketches agree in a share s of their positions still shares a node of one tree with
probability 0.57 (s = 0.86) or 0.51 (s = 0.82), so all 14 trees miss a pair at the threshold (0.85; the branching follows it) with
probability near 1e-5, one whose sketches happen to agree that little near 5e-5. Where nodes are large and their members near the
threshold, a pair must stay together down to a small node; the expected number of children that it shares stays above one a level.
The screens miss pairs besides, the same ones in every tree: a pair at exactly the threshold fails the stars' probe, or the estimate if its
sets are larger than ``SMALLEST``, with probability below 2e-4 each. More trees do not help; pairs further above it fail less.

Edge cases: texts without words, null texts and null ids are linked with nothing (component_id is the doc_id, kept is
true; n_shingles 0 for no words); texts with fewer words than a shingle are one shingle whole; rows with equal doc_id
are one document to links, and each is returned; ties do not arise, as components are named by the smallest id;
very long texts are read whole; empty tables give empty results. Columns other than doc_id and text are ignored;
``keep_one`` returns all columns and keeps one row of each component.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirelake.llm.common import LOWER, UPPER, written

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
SHINGLE = 5
#: Positions of a sketch, smallest hashes kept, independent trees, depths at which nodes are formed, the largest node compared
#: exhaustively above the last depth, about the members of a block of a node, and the members from which on a node gets its second star.
SKETCH, SMALLEST, TREES, DEPTHS, SMALL, BLOCK, CROWD = 128, 256, 14, (6, 10, 14), 2048, 256, 64
#: Below the first depth, branching goes by a similarity so much lower than the threshold, as a pair's sketches can agree less than
#: its sets: then a pair is expected to share more than one child a level.
LOWER_BELOW = 0.1
#: Standard errors below the threshold from which an estimate lets a pair pass.
ERRORS = 4
#: Columns of a probe, sixteen digits each.
PROBES = ("p", "q", "r", "s")
#: Pairs that a text meets in one group of a join with texts.
MEETINGS = 256
MEMO = 50_000
#: Rows that a Python worker gets at a time: with texts, and without.
TEXT_ROWS, PLAIN_ROWS = 500, 2000

_U = np.uint64
TOKEN = np.uint8


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


_POSITIONS = _mixed(np.arange(1, SKETCH + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_SCALE, _SHIFT = (_POSITIONS | _U(1)).astype(np.uint32), (_POSITIONS >> _U(32)).astype(np.uint32)
_DIGITS = np.tile(np.arange(0, 64, 4, dtype=np.uint64), 4)
_memo: dict[bytes, int] = {}


def _word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_memo) > MEMO:
        _memo.clear()
    get, out = _memo.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = xxhash.xxh64_intdigest(w)
            if len(w) <= 64:
                _memo[w] = h
        out.append(h)
    return np.array(out, np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return WORDS.findall(text.encode("utf-8", "surrogatepass").translate(LOWERED)) if text else []


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.empty(0, np.uint64)
    h = _word_hashes(words)
    n = max(1, len(h) - SHINGLE + 1)
    acc = np.full(n, len(words) if len(h) < SHINGLE else SHINGLE, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        acc = _mixed(acc * _U(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(acc)


def sketch_of(values: np.ndarray) -> np.ndarray:
    """For each position, a token of the shingle that comes first in the position's order.

    The orders are linear maps of the shingles' own hashes; in blocks, so that long texts stay small. The token is
    the low bits of the least value: its high bits say how large the set is.
    """
    best = np.full(SKETCH, np.iinfo(np.uint32).max, np.uint32)
    low = values.astype(np.uint32)
    for at in range(0, len(low), 4096):
        x = np.multiply.outer(_SCALE, low[at : at + 4096])
        x += _SHIFT[:, None]
        np.minimum(best, x.min(axis=1), out=best)
    return best.astype(TOKEN)


def smallest_of(values: np.ndarray) -> np.ndarray:
    """The smallest hashes of a sorted set, or all, in 32 bits."""
    return (values[:SMALLEST] >> _U(32)).astype(np.uint32)


def probes_of(sketched: np.ndarray) -> dict[str, np.ndarray]:
    """For each row the words of its probe: a digit for every second position."""
    digits = (sketched[:, :: SKETCH // 64] & 15).astype(np.uint64) << _DIGITS
    words = np.bitwise_or.reduce(digits.reshape(-1, len(PROBES), 16), axis=2).view(np.int64)
    return {c: words[:, k] for k, c in enumerate(PROBES)}


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, two halves of a digest of the words, the sketch (a byte a position) and the smallest hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                words = words_of(text)
                values = shingle_set(words)
                if not len(values):
                    rows.append((doc_id, 0, None, None, None, None))
                    continue
                digest = xxhash.xxh128_digest(b" ".join(words))
                a, b = np.frombuffer(digest, np.int64)
                rows.append((doc_id, len(values), int(a), int(b), sketch_of(values).tobytes(), smallest_of(values).tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "a", "b", "sketch", "least"]).astype({"a": "Int64", "b": "Int64"})

    return docs.where("doc_id is not null").select("doc_id", "text").mapInPandas(run, "doc_id long, n long, a long, b long, sketch binary, least binary")


def descend(nodes: np.ndarray, rows: np.ndarray, sketched: np.ndarray, steps: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, rows) that lie ``steps`` below (nodes, rows), rows being those of ``sketched``.

    A node draws one position or two, so that a pair of that similarity is expected to share one child; all members of a
    node draw alike, and go to the child that their token at the position names.
    """
    spare = _U(int((1 / similarity - 1) * (1 << 24)))  # share of nodes that draw a second position
    for _ in range(steps):
        draw = _mixed(nodes ^ _U(0x5851F42D4C957F2D))
        place = draw % _U(SKETCH)
        second = (draw >> _U(40)) < spare
        other = (place + _U(1) + (draw >> _U(16)) % _U(SKETCH - 1)) % _U(SKETCH)
        nodes = np.concatenate([_child(nodes, rows, sketched, place), _child(nodes[second], rows[second], sketched, other[second])])
        rows = np.concatenate([rows, rows[second]])
    return nodes, rows


def _child(nodes: np.ndarray, rows: np.ndarray, sketched: np.ndarray, place: np.ndarray) -> np.ndarray:
    token = sketched[rows, place.astype(np.int64)].astype(np.uint64)
    return _mixed(nodes * _U(0x9E3779B97F4A7C15) + (place << _U(8) | token) + _U(1))


NODE_ROWS = ", ".join(f"{c} long" for c in ("node", "id", *PROBES))


def _matrix(sketches: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), TOKEN).reshape(-1, SKETCH)


def first_rows(reps: DataFrame, depth: int, trees: int, similarity: float) -> DataFrame:
    """(node, id, probes) for each tree and path of ``reps`` (id, sketch)."""
    roots = _mixed(np.arange(1, trees + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sketched = _matrix(pdf["sketch"])
            start = np.arange(len(pdf))
            nodes, rows = descend(np.repeat(roots, len(pdf)), np.tile(start, trees), sketched, depth, similarity)
            probes = {c: x[rows] for c, x in probes_of(sketched).items()}
            yield pd.DataFrame({"node": nodes.view(np.int64), "id": pdf["id"].to_numpy()[rows], **probes})

    return reps.mapInPandas(run, NODE_ROWS)


def deeper_rows(rows: DataFrame, sketched: DataFrame, steps: int, similarity: float) -> DataFrame:
    """The members (node, id, probes) of nodes, ``steps`` further down."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            nodes, at = descend(pdf["node"].to_numpy().view(np.uint64), np.arange(len(pdf)), _matrix(pdf["sketch"]), steps, similarity)
            yield pd.DataFrame({"node": nodes.view(np.int64), **{c: pdf[c].to_numpy()[at] for c in ("id", *PROBES)}})

    # A document of many large nodes, or a node of many documents, is dealt out evenly.
    full = rows.select("node", "id", *PROBES).join(sketched, "id").select("node", "id", *PROBES, "sketch").repartition("node", "id")
    return full.mapInPandas(run, NODE_ROWS)


def shared_nodes(rows: DataFrame) -> DataFrame:
    """(node, id, probes, first, size) of the nodes with two members or more, first being the smallest."""
    nodes = rows.groupBy("node").agg(F.count("*").alias("size"), F.min(F.struct("id", *PROBES)).alias("first")).where("size > 1")
    return rows.join(nodes, "node")


def _unlike(a: Column, b: Column) -> Column:
    """Digits in which two words differ."""
    x = a.bitwiseXOR(b)
    for n in (1, 2):
        x = x.bitwiseOR(F.shiftrightunsigned(x, n))
    return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))


def probed(a: dict[str, Column], b: dict[str, Column], threshold: float) -> Column:
    """Whether two probes do not rule a link out."""
    n, share = 16 * len(PROBES), threshold + (1 - threshold) / 16
    unlike = F.lit(0)
    for c in PROBES:
        unlike = unlike + _unlike(a[c], b[c])
    return n - unlike >= math.floor(n * share - ERRORS * math.sqrt(n * share * (1 - share)))


def _probe(prefix: str = "", suffix: str = "") -> dict[str, Column]:
    return {c: F.col(f"{prefix}{c}{suffix}") for c in PROBES}


def estimates(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, union) of each two (different ones) of the sorted sets of smallest hashes, as far as both are known: up to the least of the largest
    hashes of those that are cut off."""
    sizes = np.array([len(x) for x in sets])
    ends = np.array([float(x[-1]) if len(x) >= SMALLEST else np.inf for x in sets])
    known = np.minimum(np.stack([np.searchsorted(x, ends, "right") for x in sets]), sizes[:, None])  # [i, j]: of i, up to the end of j
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(often) - 1
    held = np.zeros((len(sets), int(often.sum())), np.float32)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = often[column]
    held[row[shared], place[column[shared]]] = 1
    common = held @ held.T
    union = known + known.T - common
    return common / np.maximum(union, 1), union


def passing(similarity: np.ndarray, union: np.ndarray, cut: np.ndarray, threshold: float) -> np.ndarray:
    """Whether estimates do not rule a link out; of sets that are whole (not cut off) a hash that two shingles share is allowed for."""
    slack = np.where(cut, ERRORS * np.sqrt(threshold * (1 - threshold) / np.maximum(union, 1)), 2 / np.maximum(union, 1))
    return similarity >= threshold - slack


def estimate(threshold: float):
    """The similarity of two sets by their smallest hashes, null if it rules a link out."""

    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            similarity, union = estimates([np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)])
            cut = max(len(x), len(y)) >= 4 * SMALLEST
            out.append(float(similarity[0, 1]) if passing(similarity[0, 1], union[0, 1], cut, threshold) else None)
        return pd.Series(out, dtype="float64")

    return run


def similar(percent: int):
    """Whether two texts' full sets have 100 * intersection >= percent * union."""

    @F.pandas_udf(T.BooleanType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            u, v = shingle_set(words_of(x)), shingle_set(words_of(y))
            common = len(np.intersect1d(u, v, assume_unique=True))
            out.append(100 * common >= percent * (len(u) + len(v) - common))
        return pd.Series(out, dtype=bool)

    return run


def meeting(pairs: DataFrame, side: str, rows: DataFrame) -> DataFrame:
    """``pairs`` with the columns of ``rows`` (id, …) for one side. A document of many pairs is copied for each MEETINGS of them, so
    that no task gets all pairs of one."""
    other = "v" if side == "u" else "u"
    degrees = pairs.groupBy(F.col(side).alias("id")).agg(F.ceil(F.count("*") / MEETINGS).cast("int").alias("_copies"))
    copies = rows.join(degrees, "id").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    dealt = pairs.join(degrees.where("_copies > 1").withColumnRenamed("id", side), side, "left")
    dealt = dealt.withColumn("_copy", F.pmod(F.xxhash64(other), F.coalesce("_copies", F.lit(1))).cast("int")).drop("_copies")
    return dealt.join(copies.drop("_copies").withColumnRenamed("id", side), [side, "_copy"]).drop("_copy")


def screened(pairs: DataFrame, sketched: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) whose smallest hashes do not rule a link out, with the estimate."""
    near = meeting(meeting(pairs, "u", sketched.select("id", F.col("least").alias("_lu"))), "v", sketched.select("id", F.col("least").alias("_lv")))
    near = near.select("u", "v", estimate(threshold)("_lu", "_lv").alias("similarity"))
    return written(near.where(F.col("similarity").isNotNull()), "near-pairs", PLAIN_ROWS)


def confirmed(near: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs that are links on the full sets."""
    full = meeting(meeting(near.select("u", "v"), "u", texts.select("id", F.col("text").alias("_tu"))), "v", texts.select("id", F.col("text").alias("_tv")))
    return written(full.where(similar(percent)("_tu", "_tv")).select("u", "v"), "near-links", TEXT_ROWS)


def components(links: DataFrame) -> DataFrame:
    """(id, component) of each id in ``links``, the component being its smallest id, by alternating stars until nothing changes."""
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    edges, before = written(edges, "edges"), None
    while True:
        # Large star: what is greater than a node goes to the smallest of its neighbours and itself.
        around = edges.union(edges.select("v", "u")).toDF("x", "y")
        least = around.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = around.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # Small star: what is not greater goes there with the node itself.
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        now = written(small, "edges")
        after = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        edges = now
        if before == after:
            break
        before = after
    roots = edges.select(F.col("v").alias("id")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))


def with_component(rows: DataFrame, comps: DataFrame, name: str) -> DataFrame:
    return rows.join(comps.select("id", F.col("component").alias(name)), "id", "left").withColumn(name, F.coalesce(name, "id"))


def apart(rows: DataFrame, group: list[str], by: str) -> DataFrame:
    """The rows (group, id, probes, by) of groups that hold two values of ``by`` or more, with the group's size."""
    open_ = rows.groupBy(*group).agg(F.min(by).alias("_lo"), F.max(by).alias("_hi"), F.count("*").alias("size")).where("_lo < _hi")
    return rows.join(open_.drop("_lo", "_hi"), group)


def cross_pairs(rows: DataFrame, sketched: DataFrame, group: list[str], by: str, most: int | None, threshold: float) -> DataFrame:
    """Pairs (u, v, similarity) of a group's members that differ in ``by``, less those that the smallest hashes rule out, and of those
    that whole sets make links, as many as join the members: of groups of at most ``most``.

    A large group is dealt out in blocks, and each two of its blocks, or one with itself, are compared by themselves, so that no
    task gets a whole one.
    """
    if most is not None:
        rows = rows.where(F.col("size") <= most)
    blocks = F.when(F.col("size") <= 2 * BLOCK, 1).otherwise(F.ceil(F.col("size") / BLOCK)).cast("int")
    full = rows.select(*group, "id", F.col(by).alias("_by"), blocks.alias("_blocks")).join(sketched.select("id", "least"), "id")
    mine = full.withColumn("_mine", F.pmod(F.xxhash64(F.lit(1), "id"), F.col("_blocks")).cast("int"))
    dealt = mine.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    cell = F.xxhash64(*group, F.least("_mine", "_with"), F.greatest("_mine", "_with"))
    cells = dealt.select(cell.alias("_cell"), "_mine", (F.col("_mine") == F.col("_with")).alias("_one"), "id", "_by", "least")
    cells = cells.repartition("_cell").sortWithinPartitions("_cell")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the cell that the batch before ended in
        for pdf in batches:
            if not len(pdf):
                continue
            ends = np.flatnonzero(np.diff(pdf["_cell"].to_numpy())) + 1
            parts = [pdf.iloc[lo:hi] for lo, hi in zip([0, *ends], [*ends, len(pdf)], strict=True)]
            if held and held[-1]["_cell"].iloc[-1] == parts[0]["_cell"].iloc[0]:
                parts[0] = pd.concat([*held, parts[0]])
            elif held:
                parts.insert(0, pd.concat(held))
            held = [parts.pop()]
            if out := [x for part in parts for x in compared(part, threshold)]:
                yield pd.DataFrame(out, columns=["u", "v", "similarity"])
        if held and (out := compared(held[0], threshold)):
            yield pd.DataFrame(out, columns=["u", "v", "similarity"])

    return cells.mapInPandas(run, "u long, v long, similarity double").dropDuplicates(["u", "v"])


def compared(cell: pd.DataFrame, threshold: float) -> list[tuple[int, int, float]]:
    """(u, v, similarity) of a cell's pairs that differ in _by and may be links; a pair that whole sets have joined already is left out."""
    ids, name, mine, one = (cell[c].to_numpy() for c in ("id", "_by", "_mine", "_one"))
    if len(ids) < 2 or (name == name[0]).all():
        return []
    sets = [np.frombuffer(x, np.uint32) for x in cell["least"]]
    similarity, union = estimates(sets)
    cut = np.array([len(x) >= SMALLEST for x in sets])
    cut = cut[:, None] | cut[None]
    fit = passing(similarity, union, cut, threshold) & (name[:, None] != name[None]) & (ids[:, None] < ids[None])
    if not one.all():  # members of one block meet where it is compared with itself
        fit &= mine[:, None] != mine[None]
    u, v = np.nonzero(fit)
    root = {x: x for x in set(name.tolist())}

    def of(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for k in np.argsort(-similarity[u, v], kind="stable"):
        i, j = u[k], v[k]
        x, y = of(int(name[i])), of(int(name[j]))
        if x != y:
            out.append((int(ids[i]), int(ids[j]), float(similarity[i, j])))
            if not cut[i, j] and similarity[i, j] >= threshold:
                root[x] = y
    return out


def hub_pairs(rows: DataFrame, links: DataFrame, by: str, threshold: float) -> DataFrame:
    """Pairs of each member of a node of more than CROWD with the node's member of the most links, if they differ in ``by``, less those
    that the probes rule out."""
    degrees = links.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    large = rows.where(F.col("size") > CROWD)
    hubs = large.join(degrees, "id").groupBy("node").agg(F.max(F.struct("degree", "id", by, *PROBES)).alias("_o"))
    held = large.join(hubs, "node").where((F.col(by) != F.col(f"_o.{by}")) & probed(_probe(), _probe("_o."), threshold))
    return held.select(F.least("_o.id", "id").alias("u"), F.greatest("_o.id", "id").alias("v")).distinct()


def link(docs: DataFrame, reps: DataFrame, percent: int = 85, trees: int = TREES, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """(id, component) of the classes ``reps`` (id, sketch, least) that are linked with another."""
    threshold = percent / 100
    near: DataFrame | None = None
    tried: DataFrame | None = None
    sketched = reps

    def fresh(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that are new."""
        nonlocal tried
        new = written(pairs.join(tried, ["u", "v"], "left_anti") if tried is not None else pairs, "pairs", PLAIN_ROWS)
        tried = new.select("u", "v") if tried is None else tried.union(new.select("u", "v"))
        return new

    # By the sketches alone: stars, and what these leave apart in small nodes.
    nodes = written(shared_nodes(first_rows(reps, depths[0], trees, threshold)), "nodes", PLAIN_ROWS)
    rows = nodes.select("node", "id", *PROBES)
    sketched = written(reps.join(nodes.select("id").distinct(), "id", "left_semi"), "active")
    star = nodes.where((F.col("id") != F.col("first.id")) & probed(_probe(), _probe("first."), threshold))
    near = screened(fresh(star.select(F.col("first.id").alias("u"), F.col("id").alias("v")).distinct()), sketched, threshold)
    alike = written(components(near.where(F.col("similarity") >= threshold)), "alike")
    open_ = written(apart(with_component(rows, alike, "alike"), ["node"], "alike"), "open-nodes", PLAIN_ROWS)
    second = screened(fresh(hub_pairs(open_, near.where(F.col("similarity") >= threshold), "alike", threshold)), sketched, threshold)
    if not second.isEmpty():
        near = near.union(second)
        alike = written(components(near.where(F.col("similarity") >= threshold)), "alike")
        open_ = written(apart(with_component(open_.select("node", "id", *PROBES), alike, "alike"), ["node"], "alike"), "open-nodes", PLAIN_ROWS)
    near = near.union(fresh(cross_pairs(open_, sketched, ["node"], "alike", SMALL, threshold)))

    # The texts of all that can still be linked.
    ids = near.select(F.explode(F.array("u", "v")).alias("id")).union(open_.where(F.col("size") > SMALL).select("id")).distinct()
    own = docs.select(F.col("doc_id").alias("id"), "text").join(ids.hint("shuffle_hash"), "id", "left_semi")
    # Rows with one doc_id are one document: the one with the greatest text.
    texts = written(own.groupBy("id").agg(F.max("text").alias("text")), "near-texts")
    links = confirmed(near, texts, percent)
    comps = written(components(links), "components")

    # By the full sets: members that only looked alike, and those of large nodes, deeper level by level.
    # In small nodes of the first level, what did not look alike was compared above.
    rows = with_component(rows.join(texts.select("id"), "id", "left_semi"), alike, "alike")
    for level in range(len(depths)):
        last, group = level == len(depths) - 1, ["node"] if level else ["node", "alike"]
        rows = rows.select("node", *group[1:], "id", *PROBES)
        comped = written(with_component(rows, comps, "component"), "comped-nodes", PLAIN_ROWS)
        open_ = written(apart(comped, ["node"], "component"), "open-nodes", PLAIN_ROWS)
        large = open_.where(F.col("size") > SMALL)
        if not large.isEmpty():
            more = confirmed(screened(fresh(hub_pairs(large, links, "component", threshold)), sketched, threshold), texts, percent)
            if not more.isEmpty():
                links = links.union(more)
                comps = written(components(links), "components")
                comped = written(with_component(rows, comps, "component"), "comped-nodes", PLAIN_ROWS)
                open_ = written(apart(comped, ["node"], "component"), "open-nodes", PLAIN_ROWS)
                large = open_.where(F.col("size") > SMALL)
        inside = open_ if len(group) == 1 else apart(comped, group, "component")
        more = confirmed(fresh(cross_pairs(inside, sketched, group, "component", None if last else SMALL, threshold)), texts, percent)
        if not more.isEmpty():
            links = links.union(more)
            comps = written(components(links), "components")
        if last or large.isEmpty():
            break
        rows = written(deeper_rows(large, sketched, depths[level + 1] - depths[level], threshold - LOWER_BELOW), "deeper", PLAIN_ROWS)
    return comps


def near_duplicates(docs: DataFrame, percent: int = 85, trees: int = TREES, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``."""
    rows = written(sketches(docs), "sketches", TEXT_ROWS)
    # A repeated doc_id stands once, for its greatest text; see link().
    full = rows.where("n > 0")
    classes = written(full.groupBy("a", "b").agg(F.min("doc_id").alias("id"), F.first("sketch").alias("sketch"), F.first("least").alias("least")), "classes")
    reps = classes.select("id", "sketch", "least")
    comps = link(docs, reps, percent, trees, depths)
    names = classes.join(comps, "id", "left").select("a", "b", F.coalesce("component", "id").alias("component_id"))
    linked = full.select("doc_id", "n", "a", "b").join(names, ["a", "b"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    nulls = docs.where("doc_id is null").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    out = linked.unionByName(alone).unionByName(nulls)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``docs`` with one row of each component, all columns; rows with null ids stay."""
    found = near_duplicates(docs, percent)
    drop = found.where("not kept").select("doc_id").distinct()
    rest = docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
    twice = written(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"), "repeated")
    if twice.isEmpty():
        return rest
    once = rest.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return rest.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(once)
