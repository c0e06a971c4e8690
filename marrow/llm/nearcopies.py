"""Near copies by shingle similarity: candidates complete for Jaccard >= 0.8, each verified on whole texts.

The sixty-four bits of a fingerprint cannot tell a similarity of 0.8, so the work is done in two parts. First
come the links of the SimHash operator (simhash.py: segment popcounts, grid range join) over five-word
shingles, verified on the texts; they gather exact and almost exact copies, whose groups are the large ones.
Prefix lists then find whatever that part missed: all shingles have one order; of a text with n different
shingles the first n - ceil(0.8 n) + 1 are posted. Two texts with similarity 0.8 share at least ceil(0.8 n)
shingles of either, so they meet in a posted one: no pair is missed. Any order is right; commonest shingles
come last, as far as a sample of the rows shows them, so that boilerplate is seldom posted.

Before a pair is verified it must pass a bound of the same kind as the operator's, coarse to fine: shingles are
dealt to segments, and a text's sketch holds one bit for each, whether its count is odd. Two sketches differ in no
more bits than the texts differ in shingles, and similar texts differ in at most a ninth of both counts together;
so pairs whose sketches lie farther apart go, and no similar one is among them. Posts carry 256 segments; pairs
that pass meet sketches of at least twice as many segments as shingles, and only what passes these too is read.

A list's texts are first compared with one of them, chosen anew in each of ``STARS`` rounds, and what is found
alike is one component from then on. Pairs of a list that lie in different components after that are all
held against the bound, so components are exact; a large group of near copies costs no square of its size
unless its members are unlike the ones chosen. Such pairs meet by bands of length, because similar texts are at most
a quarter longer than one another. A list is dealt to parts by its size: the chosen text is sent to every part, and
pairs meet part by part, so no task holds a long list. Joins by fingerprint and by a pair's ends are dealt likewise.

Defined cases: words and lower case are those of simhash.py; texts that are equal in these are one node (so
are all texts without words); a text of fewer than five words is one shingle; of each group the row with
the smallest id stays, null ids last, of equal ids one row; an empty table gives an empty result; other
columns are carried along, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marrow.llm import simhash
from marrow.llm.components import components
from marrow.llm.shared import in_parts, join_hot, numbered, picked, remove, shuffles_removed, unused, work_dir, written
from marrow.llm.simhash import _LOWER, _WORD, SEED

SHINGLE = 5
#: Similar texts share at least ALIKE / WHOLE of their union's shingles.
ALIKE, WHOLE = 4, 5
STARS = 1
#: Longs of a post's sketch, 64 segments each; texts of more shingles than WIDE also have a sketch as wide as they are long.
SKETCH = 4
WIDE = 128
#: About as many posts of one list as meet in a task; longer lists are dealt to parts.
LIST_PART = 1024
#: Ratio of lengths that one band spans; a little over WHOLE / ALIKE, so similar texts are in one band or in neighbouring ones.
BAND = 1.26
#: One row in SAMPLED is asked for common shingles, and so many are known at most.
SAMPLED, MOST_COMMON = 16, 50_000


def _words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().translate(_LOWER))


def _shingles(words: list[bytes], shingle: int) -> set[bytes]:
    return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def _hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """A 64-bit hash of each shingle, repeats included, rolled from the words' XXH64."""
    if not words:
        return np.zeros(0, np.uint64)
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    of_words, out = np.array([digest(w, SEED) for w in words], np.uint64), np.zeros(n, np.uint64)
    for j in range(min(shingle, len(words))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + of_words[j : j + n]
    out = (out ^ (out >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return out ^ (out >> np.uint64(29))


def sketch(distinct: np.ndarray, segments: int = 64 * SKETCH) -> np.ndarray:
    """For each segment of different shingles one bit, whether it holds an odd number of them; as longs. segments: a power of two."""
    odd = np.bincount((distinct.view("<u8") & np.uint64(segments - 1)).astype(np.int64), minlength=segments) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def wide_sketch(distinct: np.ndarray) -> bytes:
    n = len(distinct)
    return sketch(distinct, 2 << (n - 1).bit_length()).tobytes() if n > WIDE else b""


def wide_apart(a: bytes, b: bytes) -> int:
    """In how many bits wide sketches differ, the longer one folded; 0 if either text has none."""
    if not a or not b:
        return 0
    x, y = sorted((np.frombuffer(s, np.uint64) for s in (a, b)), key=len)
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def similar_sets(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return WHOLE * both >= ALIKE * (len(a) + len(b) - both)


def similar(a: str | None, b: str | None, shingle: int = SHINGLE) -> bool:
    return similar_sets(_shingles(_words(a), shingle), _shingles(_words(b), shingle))


def _common(rows: DataFrame, shingle: int) -> np.ndarray:
    """Hashes of shingles that several sampled rows have; at most MOST_COMMON."""

    @F.arrow_udf("array<long>")
    def hashes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([np.unique(_hashes(_words(t.as_py()), shingle)).view("<i8") for t in texts], pa.list_(pa.int64()))

    sample = rows.where(F.pmod(F.xxhash64("_row"), F.lit(SAMPLED)) == 0)
    counts = sample.select(F.explode(hashes("_text")).alias("key")).groupBy("key").count().where("count > 3")
    return np.array(sorted(r["key"] for r in counts.orderBy(F.desc("count"), "key").limit(MOST_COMMON).collect()), dtype="<i8")


def _prints(rows: DataFrame, common: np.ndarray, shingle: int) -> DataFrame:
    """_row, _part, _id, digest of the normal text, fp (SimHash), n (different shingles), prefix (those posted), wide and s0 ... (sketches)."""
    held = rows.sparkSession.sparkContext.broadcast(common)

    kinds = [("digest", pa.binary()), ("fp", pa.int64()), ("n", pa.int32()), ("prefix", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())), ("wide", pa.binary())]

    @F.arrow_udf("digest binary, fp long, n int, prefix array<long>, sketch array<long>, wide binary")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        late = held.value
        for texts in batches:
            out = []
            for t in texts:
                words = _words(t.as_py())
                hashes = _hashes(words, shingle)
                keys = np.unique(hashes).view("<i8")
                n = len(keys)
                at = np.minimum(np.searchsorted(late, keys), max(0, len(late) - 1))
                order = np.argsort(late[at] == keys, kind="stable") if len(late) else np.arange(n)
                prefix = keys[order[: n - (ALIKE * n + WHOLE - 1) // WHOLE + 1 if n else 0]]
                out.append((hashlib.sha256(b" ".join(words)).digest(), simhash.majority(hashes), n, prefix, sketch(keys), wide_sketch(keys)))
            columns = zip(*out) if out else [[] for _ in kinds]
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], names=[name for name, _ in kinds])

    bits = [F.col("p.sketch")[i].alias(f"s{i}") for i in range(SKETCH)]
    return rows.select("_row", "_part", "_id", prints("_text").alias("p")).select("_row", "_part", "_id", "p.digest", "p.fp", "p.n", "p.prefix", "p.wide", *bits)


def _near(a: str, b: str) -> Column:
    """False only for pairs of less similarity: by the counts of shingles, and by the sketches' distance."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = F.lit(0)
    for i in range(SKETCH):
        apart = apart + F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}")))
    return (F.least(n, m) * WHOLE >= F.greatest(n, m) * ALIKE) & (apart * (WHOLE + ALIKE) <= (n + m) * (WHOLE - ALIKE))


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, shingle: int, path: str) -> DataFrame:
    """The pairs (u, v) whose whole texts are similar. Only texts that are in a pair which passes all bounds are shuffled."""

    @F.arrow_udf("int")
    def apart(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([wide_apart(x.as_py(), y.as_py()) for x, y in zip(a, b)], pa.int32())

    # Sketches and texts of the pairs' ends are picked where they lie, however many ends there are.
    ends = lambda: pairs.select(F.explode(F.array("u", "v")))
    met_nodes = written(picked(nodes.select("node", "_part", "n", "wide"), ends(), "node", "_part").drop("_part"), f"{path}/known")
    known = lambda end: met_nodes.select(F.col("node").alias(end), F.col("n").alias(f"_n_{end}"), F.col("wide").alias(f"_w_{end}"))
    near = apart("_w_u", "_w_v") * (WHOLE + ALIKE) <= (F.col("_n_u") + F.col("_n_v")) * (WHOLE - ALIKE)
    met = join_hot(join_hot(pairs.select("u", "v"), known("u"), "u", ["v"]), known("v"), "v", ["u"])
    pairs = written(met.where(near).select("u", "v"), f"{path}/pairs")

    @F.arrow_udf("boolean")
    def alike(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        before, held = None, set()
        for us, vs in batches:
            out = []
            for x, y in zip(us, vs):  # many pairs in a row have the same first text
                x = x.as_py()
                if x != before:
                    before, held = x, _shingles(_words(x), shingle)
                out.append(similar_sets(held, _shingles(_words(y.as_py()), shingle)))
            yield pa.array(out, pa.bool_())

    needed = written(picked(rows.select("_row", "_part", "_text"), ends(), "_row", "_part").drop("_part"), f"{path}/texts")
    texts = lambda end: needed.select(F.col("_row").alias(end), F.col("_text").alias(f"_{end}"))
    # By u last, so that pairs with one first text lie side by side.
    return join_hot(join_hot(pairs, texts("v"), "v", ["u"]), texts("u"), "u", ["v"]).where(alike("_u", "_v")).select("u", "v")


def _fingerprint_pairs(nodes: DataFrame, folder: str) -> DataFrame:
    """u, v: pairs of nodes that the SimHash operator links; equal fingerprints are paired with the smallest node."""
    held = ["n", *[f"s{i}" for i in range(SKETCH)]]
    prints = written(nodes.select("node", "fp", *held), f"{folder}/fingerprints")
    first = written(prints.groupBy("fp").agg(F.min(F.struct("node", *held)).alias("c")).select("fp", "c.*"), f"{folder}/named")
    linked = simhash.links(first.select("fp"), f"{folder}/simhash")
    ours = first.select("fp", *[F.col(c).alias(f"_b_{c}") for c in ["node", *held]])
    same = join_hot(prints, ours, "fp", ["node"]).where(F.col("node") > F.col("_b_node"))
    same = same.select(F.struct("node", *held).alias("a"), F.struct(*[F.col(f"_b_{c}").alias(c) for c in ["node", *held]]).alias("b"))
    apart = linked.join(first.alias("a"), F.col("u") == F.col("a.fp")).join(first.alias("b"), F.col("v") == F.col("b.fp"))
    ends = [F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v")]
    return same.where(_near("a", "b")).select(*ends).unionByName(apart.where(_near("a", "b")).select(*ends)).distinct()


def _parts() -> Column:
    """How many parts a list of _many posts is dealt to."""
    return F.ceil(F.col("_many") / LIST_PART).cast("int")


def _posts(nodes: DataFrame, folder: str) -> DataFrame:
    """key, _many, part, node, n, s0 ...: the posts of all lists of more than one text; what a post carries joins it after the others have gone."""
    lists = nodes.select("node", F.explode("prefix").alias("key"))
    keys = written(lists.groupBy("key").agg(F.count(F.lit(1)).alias("_many")).where("_many > 1"), f"{folder}/keys")
    met = lists.join(keys, "key").join(nodes.select("node", "n", *[f"s{i}" for i in range(SKETCH)]), "node")
    # A list's part is seeded apart from the choice of its star.
    posts = written(met.withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), _parts()).cast("int")), f"{folder}/posts")
    remove(nodes.sparkSession, f"{folder}/keys")
    return posts


def _unsettled(mixed: DataFrame) -> DataFrame:
    """key: the lists that may hold pairs which no star has met; of two texts one was the star."""
    return mixed.where(F.col("_many") > 2).select("key")


def _star_pairs(rooted: DataFrame, mixed: DataFrame) -> DataFrame:
    """a, b: each post of a list in mixed (key, _many, c) beside the list's chosen text c."""
    sent = mixed.select("key", F.explode(F.sequence(F.lit(0), _parts() - 1)).alias("part"), F.col("c").alias("b"))
    return rooted.select("key", "part", F.struct(*[c for c in rooted.columns if c not in ("key", "part")]).alias("a")).join(sent, ["key", "part"])


def _cells(left: DataFrame, first: bool) -> DataFrame:
    """key, cell, and the post as a (first) or b. A cell is two parts of one band, or a part of a band and one of the band above."""
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(BAND))).cast("int")
    part, last = F.col("part"), _parts() - 1
    cell = lambda low, across, i, j: F.struct(low.alias("band"), F.lit(across).alias("across"), i.alias("i"), j.alias("j"))
    if first:
        same = F.transform(F.sequence(part, last), lambda j: cell(F.col("_band"), False, part, j))
        other = F.transform(F.sequence(F.lit(0), last), lambda j: cell(F.col("_band"), True, part, j))
    else:
        same = F.transform(F.sequence(F.lit(0), part), lambda i: cell(F.col("_band"), False, i, part))
        other = F.transform(F.sequence(F.lit(0), last), lambda i: cell(F.col("_band") - 1, True, i, part))
    post = F.struct(*[c for c in left.columns if c not in ("key", "part", "_many")]).alias("a" if first else "b")
    return left.withColumn("_band", band).select("key", F.explode(F.concat(same, other)).alias("cell"), post)


def _list_pairs(left: DataFrame) -> DataFrame:
    """a, b: all pairs of posts of one list whose lengths lie within a quarter, each of a list's pairs once."""
    pairs = _cells(left, True).join(_cells(left, False), ["key", "cell"])
    return pairs.where(F.col("cell.across") | (F.col("cell.i") < F.col("cell.j")) | (F.col("a.node") < F.col("b.node"))).select("a", "b")


def links(nodes: DataFrame, rows: DataFrame, folder: str, shingle: int = SHINGLE) -> DataFrame:
    """node, root: components of similar texts. nodes: node, _part, fp, n, prefix, wide, s0 ...; rows: _row (a node's number), _part, _text; both of in_parts()."""
    tried = written(_fingerprint_pairs(nodes, folder), f"{folder}/pairs-simhash")
    for part in ("simhash", "fingerprints", "named"):
        remove(rows.sparkSession, f"{folder}/{part}")
    found = written(_verified(tried, nodes, rows, shingle, f"{folder}/texts-simhash"), f"{folder}/found-simhash")
    remove(rows.sparkSession, f"{folder}/texts-simhash")
    roots = components(found, f"{folder}/round-simhash")
    bits = [f"s{i}" for i in range(SKETCH)]
    posts = _posts(nodes, folder)
    ends = [F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v")]
    for i in range(STARS + 1):
        rooted = posts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        # Lists whose texts are one component are done.
        center = F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("h"), "node", "n", "root", *bits)).alias("c")
        mixed = rooted.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.max("_many").alias("_many"), center).where("_low < _high")
        if i < STARS:
            pairs = _star_pairs(rooted.drop("_many"), mixed)
        else:
            left = written(rooted.join(_unsettled(mixed), "key"), f"{folder}/left")
            pairs = _list_pairs(left)
        pairs = pairs.where((F.col("a.root") != F.col("b.root")) & _near("a", "b")).select(*ends).distinct()
        pairs = written(pairs.join(tried, ["u", "v"], "left_anti"), f"{folder}/pairs-{i}")
        tried = tried.unionByName(pairs)
        found = written(_verified(pairs, nodes, rows, shingle, f"{folder}/texts-{i}"), f"{folder}/found-{i}")
        remove(rows.sparkSession, f"{folder}/texts-{i}")
        roots = components(found.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))), f"{folder}/round-{i}")
    return roots


def keep_one(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near copies: of each component the row with the smallest id stays."""
    folder = work_dir(docs.sparkSession, "nearcopies")
    row, part = unused(docs, "_row"), unused(docs, "_part")
    with shuffles_removed(docs.sparkSession):
        whole = in_parts(numbered(docs, row, part), f"{folder}/rows", part)
        rows = whole.select(F.col(row).alias("_row"), F.col(part).alias("_part"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
        prints = in_parts(_prints(rows, _common(rows, shingle), shingle), f"{folder}/prints", "_part")
        first = F.min(F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_row")).alias("first")
        nodes = written(prints.groupBy("digest").agg(first).select("first", F.col("first._row").alias("node")), f"{folder}/nodes")
        posted = picked(prints.withColumnRenamed("_row", "node"), nodes.select("node"), "node", "_part")
        roots = links(posted, rows, f"{folder}/links", shingle)
        keepers = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
        kept = written(keepers.select(F.col("first._row").alias(row)), f"{folder}/keepers")
    for name in ("links", "prints", "nodes"):
        remove(docs.sparkSession, f"{folder}/{name}")
    return picked(whole, kept, row, part).drop(row, part)
