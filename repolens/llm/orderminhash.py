"""Near-duplicates by order MinHash.

A text's k-mers are its sequences of ``K`` words, each labelled with how often it has occurred before. A component of the sketch takes the
``PICK`` labelled k-mers that are smallest under its hash and keeps them in text order, so that it agrees for texts whose alignment is good,
not just for equal bags. ``BANDS`` bands of ``ROWS`` components each name a bucket.

Candidates are stars first: each member is compared with two leaders of its bucket, one that all buckets prefer and one at random for each. A
bucket holds texts of like length only (a text is in two classes of ratio ``SIMILARITY``, so that any two that could be similar meet). Nodes in
buckets of more than two also get buckets by pairs of bands, with leaders of their own. What the leaders leave open is settled exactly: where the
members of a bucket, leaders aside, are not of one class by then, all of them go through a prefix filter on their rare k-mers, and every pair
that the filter can't rule out is a candidate. Texts that share a common passage or a template thus don't hide each other's links. A candidate
is verified by banded alignment: the longest chain of common labelled k-mers that keeps order in both texts and stays within the band that the
threshold allows gives the similarity chain / (a + b - chain), which is to be ``SIMILARITY`` or more. Classes are the connected components of
the verified links.

Equal texts are one node from the start, found by their digest with a combining aggregate. Nulls: a null or blank text has no k-mers and is in
a class with its equals only (null is a text of its own). A text of fewer than ``K`` words is one k-mer. A null id is larger than all others when
the class id, the smallest id, is chosen. Repeated rows each get a row. Texts of any length are sketched and aligned whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repolens.llm.common import apart, cut, stash
from repolens.llm.components import components
from repolens.llm.substrings import Vocabulary, _mixed

K, PICK, ROWS, BANDS, SIMILARITY = 5, 2, 2, 20, 0.8
_CHUNK = 8192
_STEP = (1 / SIMILARITY) ** 0.25  #: ratio of the size classes of the prefix filter
_B = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(20)
_XOR = _RNG.integers(0, 2**63, ROWS * BANDS).astype(np.uint64)
_MUL = _RNG.integers(0, 2**63, ROWS * BANDS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """Each text's words as 64-bit hashes."""
    vocabulary = Vocabulary()
    found = []
    for t in texts:
        words = (t or "").encode("utf-8", "surrogatepass").split()
        found.append(np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
    return [hashes[f] for f in found]


def labelled_kmers(w: np.ndarray) -> np.ndarray:
    """Hashes of the k-mers in text order, each with its occurrence number mixed in."""
    if not len(w):
        return w
    n = max(1, len(w) - K + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(K, len(w))):
        h = h * _B + w[k : k + n]
    h = _mixed(h + np.uint64(min(K, len(w))))
    order = np.argsort(h, kind="stable")
    s = h[order]
    head = np.r_[True, s[1:] != s[:-1]]
    if head.all():
        return h
    starts = np.flatnonzero(head)
    label = np.empty(n, np.uint64)
    label[order] = (np.arange(n) - starts[np.cumsum(head) - 1]).astype(np.uint64)
    return _mixed(h + label * np.uint64(0xD6E8FEB86659FD93))


def sketch(h: np.ndarray) -> np.ndarray:
    """The band keys of a text's labelled k-mers."""
    m = len(_MUL)
    top = np.uint64(2**64 - 1)
    best, place = np.full((m, PICK), top), np.full((m, PICK), -1, np.int64)
    rows = np.arange(m)
    for a in range(0, len(h), _CHUNK):
        x = (h[a : a + _CHUNK][None, :] ^ _XOR[:, None]) * _MUL[:, None]
        values, places = [best], [place]
        for _ in range(min(PICK, x.shape[1])):
            at = x.argmin(1)
            values.append(x[rows, at][:, None])
            places.append((at + a)[:, None])
            x[rows, at] = top
        values, places = np.concatenate(values, 1), np.concatenate(places, 1)
        keep = np.argsort(values, 1, kind="stable")[:, :PICK]
        best, place = np.take_along_axis(values, keep, 1), np.take_along_axis(places, keep, 1)
    place = np.sort(place, 1)
    code = np.zeros(m, np.uint64)
    for j in range(PICK):
        code = _mixed(code * _B + np.where(place[:, j] >= 0, h[place[:, j]], np.uint64(7)))
    bands = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        bands = _mixed(bands * _B + code[r::ROWS])
    return bands.astype(np.int64)


def chain(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """The longest increasing chain of common labelled k-mers whose places differ by ``band`` at most."""
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=False, return_indices=True)
    near = np.abs(at_a - at_b) <= band
    at_a, at_b = at_a[near], at_b[near]
    at_b = at_b[np.argsort(at_a)]
    if not len(at_b) or (at_b[1:] > at_b[:-1]).all():
        return len(at_b)
    tails: list[int] = []
    for x in at_b.tolist():
        i = bisect_left(tails, x)
        if i == len(tails):
            tails.append(x)
        else:
            tails[i] = x
    return len(tails)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """chain / (a + b - chain); 0 where the lengths alone rule ``least`` out."""
    if not len(a) or not len(b) or min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    total = len(a) + len(b)
    # chain >= least / (1 + least) * total, so no more than this many k-mers are off it on either side
    c = chain(a, b, int(total * (1 - least) / (1 + least)) + 1)
    return c / (total - c)


def _sketcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a in range(0, whole.num_rows, 512):
            batch = whole.slice(a, 512)
            found = word_hashes(batch.column("text").to_pylist())
            bands = [sketch(labelled_kmers(w)).tolist() if len(w) else [] for w in found]
            sizes = [max(1, len(w) - K + 1) for w in found]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64()))], names=["node", "doc_id", "size", "bands"])


def _verifier(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint64))
        for batch in batches:
            a, b, out_a, out_b = batch.column("a").to_pylist(), batch.column("b").to_pylist(), [], []
            text_a, text_b = batch.column("text_a"), batch.column("text_b")
            for i in range(len(a)):
                if last[0] != b[i]:
                    last = (b[i], labelled_kmers(word_hashes([text_b[i].as_py()])[0]))
                if similarity(labelled_kmers(word_hashes([text_a[i].as_py()])[0]), last[1], least) >= least:
                    out_a.append(a[i]), out_b.append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return run


def _node(text: Column) -> Column:
    """A text's digest; null differs from the empty text."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b"null"))


def _classed(g: Column) -> Column:
    """A bucket key with each of the two length classes of column ``size``."""
    step = F.floor(F.log(F.col("size").cast("double")) / float(np.log(1 / SIMILARITY)) + 1e-9)
    return F.explode(F.array(F.xxhash64(g, step), F.xxhash64(g, step + 1)))


def _shared(members: DataFrame) -> DataFrame:
    """The (g, nid, size) whose bucket has two members or more, with the bucket's count. Keys alone are counted first: most buckets have one."""
    crowds = members.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("g").alias("_g"), "n")
    return cut(members.join(apart(crowds), F.col("g") == F.col("_g")).select("g", "nid", "size", "n"))


def _leaders(shared: DataFrame) -> DataFrame:
    """(_g, leaders): the members of each bucket that its others are compared with."""
    leaders = shared.groupBy("g").agg(F.min(F.struct("nid", "size")).alias("first"), F.min(F.struct(F.xxhash64("g", "nid"), F.col("nid"), F.col("size"))).alias("some"))
    one = lambda c: F.struct(F.col(f"{c}.nid").alias("nid"), F.col(f"{c}.size").alias("size"))
    return leaders.select(F.col("g").alias("_g"), F.array_distinct(F.array(one("first"), one("some"))).alias("leaders"))


def _stars(shared: DataFrame, least: float) -> DataFrame:
    """(a, b): each member of a bucket with its bucket's leaders, if their lengths allow a link."""
    pairs = shared.join(apart(_leaders(shared)), F.col("g") == F.col("_g")).select("nid", "size", F.explode("leaders").alias("l"))
    fits = F.least("size", "l.size") >= F.lit(least) * F.greatest("size", "l.size")
    return pairs.where((F.col("nid") != F.col("l.nid")) & fits).select(F.greatest("nid", "l.nid").alias("a"), F.least("nid", "l.nid").alias("b")).dropDuplicates()


def _open(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(nid, size, label): the members, leaders aside, of buckets whose members aside from the leaders are in several classes so far."""
    crowd = shared.where("n > 2").join(apart(_leaders(shared)), F.col("g") == F.col("_g")).where(~F.array_contains(F.transform("leaders", lambda x: x["nid"]), F.col("nid")))
    crowd = cut(crowd.select("g", "nid", "size").join(apart(labels.select(F.col("node").alias("_n"), "label")), F.col("nid") == F.col("_n"), "left").select("g", "nid", "size", F.coalesce("label", "nid").alias("label")))
    several = crowd.groupBy("g").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select(F.col("g").alias("_g"))
    return cut(crowd.join(apart(several), F.col("g") == F.col("_g")).select("nid", "size", "label").dropDuplicates(["nid"]))


def _kmers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a in range(0, whole.num_rows, 128):
            batch = whole.slice(a, 128)
            found = [labelled_kmers(w).view(np.int64) for w in word_hashes(batch.column("text").to_pylist())]
            nid = np.repeat(batch.column("nid").to_numpy(), [len(h) for h in found])
            yield pa.RecordBatch.from_arrays([pa.array(nid), pa.array(np.concatenate(found))], names=["nid", "h"])


def size_class(size: int) -> int:
    return int(np.floor(np.log(size) / np.log(_STEP) + 1e-9))


def prefixes(size: int, least: float) -> list[tuple[int, int]]:
    """(size class of a partner, length of the prefix): a text of ``size`` k-mers shares one of its ``length`` rarest with any partner of that
    class that is similar to it."""
    out = []
    smallest = max(1, int(np.ceil(least * size - 1e-6)))
    for c in range(size_class(smallest), size_class(int(size / least + 1e-6)) + 1):
        low = max(int(np.ceil(_STEP**c * (1 - 1e-6))), smallest)  # the smallest partner there
        common = int(np.ceil((size + low) * least / (1 + least) - 1e-6))
        out.append((c, size - common + 1))
    return out


def _keyer(least: float):
    schema = pa.schema([("key", pa.int64()), ("twin", pa.int64()), ("nid", pa.int64()), ("size", pa.int32()), ("label", pa.int64()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = batch.column("common")
            ends = shared.offsets.to_numpy()
            h = shared.values.field("h").to_numpy().view(np.uint64)
            key, twin, counts, ats = [], [], [], []
            sizes = batch.column("size").to_pylist()
            for i, size in enumerate(sizes):
                mine, own, n = h[ends[i] : ends[i + 1]], np.uint64(size_class(size)), 0
                single = size - len(mine)  # k-mers of this text alone come first
                for c, length in prefixes(size, least):
                    some = mine[: max(0, length - single)]
                    other = np.uint64(c)
                    key.append(_mixed(_mixed(some + own) * _B + other)), twin.append(_mixed(_mixed(some + other) * _B + own))
                    ats.append(np.arange(single, single + len(some), dtype=np.int32))
                    n += len(some)
                counts.append(n)
            if not sum(counts):
                continue
            columns = [np.repeat(batch.column(name).to_numpy(), counts) for name in ("nid", "size", "label")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(twin).view(np.int64)), pa.array(columns[0]), pa.array(columns[1], pa.int32()), pa.array(columns[2]), pa.array(np.concatenate(ats))],
                schema=schema,
            )

    return run


def _rest(members: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """(a, b): every pair of ``members`` in different classes that could be similar, by a prefix filter.

    K-mers are ordered by the number of members that have them, rare ones first. Two texts with enough k-mers in common share one among the
    first of each; how many, depends on both sizes, so keys are made for each size class of partners. What a family has in common is frequent
    and comes last, so its members meet only where the lengths and their own k-mers leave it open.
    """
    texts = held.join(apart(members.select(F.col("nid").alias("_n"))), F.col("nid") == F.col("_n")).select("nid", "text")
    flat = stash(texts.mapInArrow(_kmers, "nid long, h long"), "kmers")
    counts = flat.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("h").alias("_h"), "n")
    common = flat.join(apart(counts), F.col("h") == F.col("_h")).groupBy("nid").agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("common"))
    keyed = common.join(apart(members.select(F.col("nid").alias("_n"), "size", "label")), F.col("nid") == F.col("_n")).select("nid", "size", "label", "common")
    keys = stash(keyed.mapInArrow(_keyer(least), "key long, twin long, nid long, size int, label long, at int"), "prefixes")
    other = keys.select("twin", *[F.col(c).alias(f"_{c}") for c in ("nid", "size", "label", "at")])
    met = keys.drop("twin").join(apart(other), (F.col("key") == F.col("twin")) & (F.col("nid") > F.col("_nid")) & (F.col("label") != F.col("_label")))
    # no more can be common than what is before both places, this one, and what is after both
    most = F.least("at", "_at") + 1 + F.least(F.col("size") - F.col("at"), F.col("_size") - F.col("_at")) - 1
    open_ = (most >= F.lit(least / (1 + least)) * (F.col("size") + F.col("_size")) - 1e-6) & (F.least("size", "_size") >= F.lit(least) * F.greatest("size", "_size"))
    return cut(met.where(open_).select(F.col("nid").alias("a"), F.col("_nid").alias("b")).dropDuplicates())


def _verified(pairs: DataFrame, held: DataFrame, least: float) -> DataFrame:
    with_a = pairs.join(apart(held.select(F.col("nid").alias("a"), F.col("text").alias("text_a"))), "a")
    with_b = with_a.join(apart(held.select(F.col("nid").alias("b"), F.col("text").alias("text_b"))), "b")
    return cut(with_b.select("a", "b", "text_a", "text_b").mapInArrow(_verifier(least), "a long, b long"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(nid, node, age, copies, label): every distinct text with its class's label. ``age`` is the smallest id that has the text."""
    full = F.col(f"`{text}`")
    rows = docs.select(_node(full).alias("node"), F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(2**63 - 1)).alias("doc_id"), full.alias("text"))
    sketched = rows.mapInArrow(_sketcher, "node binary, doc_id long, size int, bands array<long>")
    grouped = sketched.groupBy("node").agg(F.min("doc_id").alias("age"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = stash(grouped.withColumn("nid", F.monotonically_increasing_id()), "sketches")  # written once, so the numbers are fixed
    shared = _shared(nodes.select("nid", "size", F.explode("bands").alias("g")).select("nid", "size", _classed(F.col("g")).alias("g")))
    # nodes in a crowded bucket also get buckets by two bands
    crowded = shared.where("n > 2").select(F.col("nid").alias("_n")).dropDuplicates()
    again = nodes.join(apart(crowded), F.col("nid") == F.col("_n")).select("nid", "size", "bands", F.posexplode("bands").alias("i", "g"))
    double = again.select("nid", "size", F.explode(F.array(*[F.xxhash64(F.lit(step), F.col("g"), F.get("bands", (F.col("i") + step) % BANDS)) for step in (1, 3, 7)])).alias("g"))
    pairs = cut(_stars(shared, least).unionByName(_stars(_shared(double), least)).dropDuplicates())
    asked = shared.select(F.col("nid").alias("n")).dropDuplicates().join(apart(nodes.select("nid", F.col("node").alias("_node"), F.col("age").alias("_age"))), F.col("n") == F.col("nid")).select("nid", "_node", "_age")
    # one copy's text for each node; copies differ in their ids, so a much copied text is no hot key here
    held = rows.join(apart(asked), (F.col("node") == F.col("_node")) & (F.col("doc_id") == F.col("_age"))).select("nid", "text").dropDuplicates(["nid"])
    held = stash(held, "texts")
    labels = cut(components(_verified(pairs, held, least), "a", "b"))
    nodes = nodes.select("nid", "node", "age", "copies")
    nodes = nodes.join(apart(labels.withColumnRenamed("node", "_nid")), F.col("nid") == F.col("_nid"), "left").drop("_nid").withColumn("label", F.coalesce("label", "nid"))
    members = _open(shared, labels)
    if members.isEmpty():
        return nodes
    more = _verified(_rest(members, held, least), held, least)
    if more.isEmpty():
        return nodes
    # the classes that the further links join
    label_of = members.select(F.col("nid").alias("_n"), "label")
    joined = more.join(apart(label_of.select(F.col("_n").alias("a"), F.col("label").alias("x"))), "a").join(apart(label_of.select(F.col("_n").alias("b"), F.col("label").alias("y"))), "b")
    merged = components(joined.select("x", "y"), "x", "y").select(F.col("node").alias("_l"), F.col("label").alias("_to"))
    return nodes.join(apart(merged), F.col("label") == F.col("_l"), "left").select("nid", "node", "age", "copies", F.coalesce("_to", "label").alias("label"))


def _labelled(docs: DataFrame, doc_id: str, text: str, least: float) -> tuple[DataFrame, DataFrame]:
    """Every distinct text with its class's label, and the classes: label, head (age and node of the oldest text), class_size."""
    labelled = classes(docs, doc_id, text, least)
    sizes = labelled.groupBy("label").agg(F.min(F.struct("age", "node")).alias("head"), F.sum("copies").alias("class_size"))
    return labelled, sizes


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, class_size): one row for each row of ``docs``; the class id is the smallest id in the class."""
    labelled, sizes = _labelled(docs, doc_id, text, least)
    sizes = sizes.select(F.col("label").alias("_l"), F.col("head.age").alias("class_id"), "class_size")
    found = cut(labelled.join(apart(sizes), F.col("label") == F.col("_l")).select(F.col("node").alias("_n"), "class_id", "class_size"))
    mine = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), _node(F.col(f"`{text}`")).alias("node"))
    null = F.lit(2**63 - 1)
    return mine.join(apart(found), F.col("node") == F.col("_n")).select("doc_id", F.when(F.col("class_id") == null, F.lit(None)).otherwise(F.col("class_id")).alias("class_id"), "class_size")


def one_per_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class: the one with the smallest id, of rows that repeat one the least by a hash of all columns, so that a rerun
    keeps the same. Columns stay as they are."""
    _, sizes = _labelled(docs, doc_id, text, least)
    heads = cut(sizes.select(F.col("head.node").alias("_n"), F.col("head.age").alias("_a")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    mark = F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    keyed = docs.select(_node(F.col(f"`{text}`")).alias("_node"), F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(2**63 - 1)).alias("_id"), row.alias("_row"), mark.alias("_mark"))
    kept = keyed.join(apart(heads), (F.col("_node") == F.col("_n")) & (F.col("_id") == F.col("_a")), "left_semi")
    return kept.groupBy("_node", "_id").agg(F.min_by("_row", "_mark").alias("_row")).select("_row.*")
