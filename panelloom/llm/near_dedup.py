"""Near-duplicate documents: one-permutation MinHash with optimal densification.

Each document's set of word shingles is hashed once; the hash range is cut into bins and the least
hash of each bin is kept. An empty bin borrows from a bin drawn by a universal hash of its own number
(optimal densification). Runs of ``rows`` bins form bands; documents that share a band meet in a bucket.

A bucket emits a star, not all pairs: every member is compared with one centre, the member whose bands
are shared most widely (the original of a group of edited copies shares every common band, a copy does
not). Candidates are confirmed on whole shingle sets. Where a star leaves several components in its
bucket, the members that are not in the centre's largest component are compared with all members of that
centre's buckets, block by block, by their differences from the centre's set: exact at every size, and
only links leave a block. No pair is dropped by a count or an estimate.

Equal word sequences are one node, so thousands of exact copies cost one row each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelloom.llm.common import mix64, shingle_hashes, stored, table, text_slices, word_hashes

PROBES = 256
#: Shingles of differences in a block of members, on average.
BLOCK = 1 << 17
#: Parts in which the members of a centre are dealt.
PARTS = 64
#: Shingles that two blocks are compared on at once.
COLUMNS = 1 << 12


def _probe_table(bins: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        at = np.arange(bins * PROBES, dtype=np.uint64).reshape(bins, PROBES)
        return (mix64(at + np.uint64(0x5851F42D4C957F2D)) % np.uint64(bins)).astype(np.int64)


def one_permutation(hashes: np.ndarray, bins: int, probes: np.ndarray) -> np.ndarray:
    """Signature (uint32 for each bin) of a sorted, distinct, non-empty array of 64-bit hashes."""
    place = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.searchsorted(place, np.arange(bins, dtype=np.uint64))
    full = first < len(hashes)
    full[full] = place[first[full]] == np.flatnonzero(full).astype(np.uint64)
    out = np.zeros(bins, np.uint64)
    out[full] = hashes[first[full]]
    if not full.all():
        empty = np.flatnonzero(~full)
        tries = full[probes[empty]]
        hit = tries.argmax(axis=1)
        donor = probes[empty, hit]
        lost = ~tries.any(axis=1)
        if lost.any():
            there = np.flatnonzero(full)
            donor[lost] = there[probes[empty[lost], 0] % len(there)]
        out[empty] = out[donor]
    return out & np.uint64(0xFFFFFFFF)


def text_key(words: np.ndarray) -> bytes:
    """Name of a word sequence."""
    return hashlib.md5(words.tobytes()).digest()


def sketcher(shingle: int, bands: int, rows: int):
    bins = bands * rows
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n_shingles", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = _probe_table(bins)
        salt = mix64(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            ids = batch.column(0)
            for at, data, offsets in text_slices(batch):
                words, firsts = word_hashes(data, offsets)
                keys, sizes, marks = [], [], []
                for i in range(len(offsets) - 1):
                    own = words[firsts[i] : firsts[i + 1]]
                    keys.append(text_key(own))
                    found = shingle_hashes(own, shingle)
                    sizes.append(len(found))
                    if not len(found):
                        marks.append(None)
                        continue
                    sig = one_permutation(found, bins, probes)
                    h = salt
                    for column in sig.reshape(bands, rows).T:
                        h = mix64(h ^ column) * np.uint64(0x9E3779B97F4A7C15)
                    marks.append(h.view(np.int64))
                yield pa.record_batch([ids.slice(at, len(keys)), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(marks, pa.list_(pa.int64()))], schema=schema)

    return run, "doc_id long, key binary, n_shingles long, bands array<long>"


def _set_maker(shingle: int):
    """Shingle sets of rows (doc_id, text, key) whose text is the one that ``key`` names."""
    schema = pa.schema([("id", pa.int64()), ("members", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in text_slices(batch):
                words, firsts = word_hashes(data, offsets)
                own = [words[firsts[i] : firsts[i + 1]] for i in range(len(offsets) - 1)]
                named = [i for i, key in enumerate(batch.column(2).slice(at, len(own)).to_pylist()) if text_key(own[i]) == key]
                sets = [shingle_hashes(own[i], shingle).view(np.int64) for i in named]
                yield pa.record_batch([batch.column(0).take(pa.array([at + i for i in named], pa.int64())), pa.array(sets, pa.list_(pa.int64()))], schema=schema)

    return run


def of_ids(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the given doc_ids: the same shuffled join at every size."""
    return texts.join(ids.hint("shuffle_merge"), "doc_id", "left_semi")


def shingle_sets(texts: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(id, members) of the given doc_ids; texts: (doc_id, text, key), each text of a doc_id once.

    No aggregation stands between this and a join, so that adaptive execution can split a hot key there.
    """
    return of_ids(texts, ids).mapInArrow(_set_maker(shingle), "id long, members array<long>")


def confirmed(texts: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Of the distinct pairs (u, v) those whose whole sets have 100 * intersection >= percent * union.

    What comes out is distinct as it is: nothing after the joins asks for their partitioning, so that
    adaptive execution can split the pairs of a hot document.
    """
    sets = shingle_sets(texts, pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct(), shingle)
    a, b = sets.select(F.col("id").alias("u"), F.col("members").alias("a")), sets.select(F.col("id").alias("v"), F.col("members").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(b, "v").join(a, "u").where(100 * both >= percent * (F.size("a") + F.size("b") - both)).select("u", "v")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(id, component_id) of every id in ``links`` (u, v): the least id that can be reached.

    Every round each node points to the least of its neighbours and itself, edges are renamed by those
    pointers and loops go, until no edge is left: the number of rounds grows with the logarithm of paths.
    """
    edges, pointers = links, []
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        point = stored(spark, both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.col("id")).alias("to")), "pointers")
        pointers.append(point)
        p = point.select(F.col("id").alias("u"), F.col("to").alias("pu"))
        q = point.select(F.col("id").alias("v"), F.col("to").alias("pv"))
        edges = stored(spark, edges.join(p, "u").join(q, "v").where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
        if edges.isEmpty():
            break
    out = pointers[0].select("id", F.col("to").alias("component_id"))
    for point in pointers[1:]:
        step = point.select(F.col("id").alias("component_id"), "to")
        out = out.join(step, "component_id", "left").select("id", F.coalesce("to", "component_id").alias("component_id"))
    return stored(spark, out, "components")


def _with_counts(entries: DataFrame) -> DataFrame:
    """Entries (bucket, ...) of buckets with at least two members, with the count."""
    counts = entries.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    return entries.join(counts, "bucket")


def centres(entries: DataFrame) -> DataFrame:
    """(bucket, centre): the member whose buckets have the most members, the least id of several."""
    weight = entries.groupBy("id").agg(F.sum("members").alias("weight"))
    return entries.join(weight, "id").groupBy("bucket").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("centre"))


def stars(entries: DataFrame, centre: DataFrame) -> DataFrame:
    """Distinct pairs (u < v) of each member of a bucket with its centre; entries: bucket, id, members."""
    return entries.join(centre, "bucket").where("id <> centre").select(F.least("id", "centre").alias("u"), F.greatest("id", "centre").alias("v")).distinct()


def _open(entries: DataFrame) -> DataFrame:
    """Entries of buckets that hold several components after their star, and more than one untested pair."""
    state = entries.groupBy("bucket").agg(F.count("*").alias("members"), F.min("component_id").alias("low"), F.max("component_id").alias("high")).where("members > 2 and low <> high").select("bucket", "members")
    return entries.drop("members").join(state, "bucket")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right sorted set."""
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    vocabulary = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)

    def cells(sets: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(vocabulary, flat), max(0, len(vocabulary) - 1))
        has = vocabulary[at] == flat
        order = np.argsort(at[has], kind="stable")
        return row[has][order], at[has][order]

    if not len(vocabulary):
        return out.astype(np.int64)
    (ra, ca), (rb, cb) = cells(left, a), cells(right, b)
    for first in range(0, len(vocabulary), COLUMNS):
        parts = []
        for n, r, c in ((len(left), ra, ca), (len(right), rb, cb)):
            lo, hi = np.searchsorted(c, (first, first + COLUMNS))
            m = np.zeros((n, min(COLUMNS, len(vocabulary) - first)), np.float32)
            m[r[lo:hi], c[lo:hi] - first] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def _block_linker(percent: int):
    """Links between a block of open members and a block of all members of one centre.

    With D the difference of a member's set from the centre's and r the part of the centre it lacks, two
    members share |centre| - r1 - r2 + |D1 & D2| shingles: exact, from differences alone. One link for each
    open member and component is enough to join them.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def unpack(group):
            ids, parts, lacks, sizes = (np.array([m[k] for m in group], np.int64) for k in ("id", "component_id", "lacks", "size"))
            return ids, parts, lacks, sizes, [np.asarray(m["differs"], np.int64) for m in group]

        for frame in frames:
            us, vs = [], []
            for some, others, of in zip(frame["some"], frame["others"], frame["of"], strict=True):
                ids, parts, lacks, sizes, left = unpack(some)
                there, there_parts, there_lacks, there_sizes, right = unpack(others)
                both = of - lacks[:, None] - there_lacks[None] + shared_counts(left, right)
                linked = (100 * both >= percent * (sizes[:, None] + there_sizes[None] - both)) & (parts[:, None] != there_parts[None])
                for k in np.flatnonzero(linked.any(axis=1)):
                    own = np.flatnonzero(linked[k])
                    own = own[np.unique(there_parts[own], return_index=True)[1]]
                    us.append(np.minimum(there[own], ids[k]))
                    vs.append(np.maximum(there[own], ids[k]))
            if us:
                yield pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)})

    return run


def open_links(spark: SparkSession, texts: DataFrame, open_: DataFrame, centre: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Confirmed links between components of one centre's buckets; open_: (bucket, id, component_id).

    Members are gathered by their bucket's centre, of which a group of edited copies has one or a few.
    Those outside the centre's largest component are compared with all members. Blocks hold about BLOCK
    shingles of differences; each pair of blocks is a row of its own, dealt by centre and block.
    """
    held = stored(spark, open_.join(centre, "bucket").select("centre", "id", "component_id").distinct(), "held")
    sets = shingle_sets(texts, held.select(F.explode(F.array("centre", "id")).alias("doc_id")).distinct(), shingle)
    a, b = sets.select("id", F.col("members").alias("own")), sets.select(F.col("id").alias("centre"), F.col("members").alias("base"))
    lacks = F.array_except("base", "own")
    rows = held.join(a, "id").join(b, "centre").select("centre", "id", "component_id", F.size(lacks).alias("lacks"), F.size("own").alias("size"), F.size("base").alias("of"), F.concat(lacks, F.array_except("own", "base")).alias("differs"))
    rows = stored(spark, rows, "differences")
    parts = rows.groupBy("centre", "component_id").agg(F.count("*").alias("n"), F.sum(F.size("differs") + 8).alias("weight"))
    groups = parts.groupBy("centre").agg(F.ceil(F.sum("weight") / BLOCK).cast("int").alias("blocks"), F.max_by("component_id", F.struct("n", -F.col("component_id"))).alias("most"))
    # facts of a centre meet its members by centre and part, so that a centre of many members is no single task
    spread = groups.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    placed = rows.withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(PARTS)).cast("int")).join(spread.hint("shuffle_merge"), ["centre", "part"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    member = F.struct("id", "component_id", "lacks", "size", "differs")
    some = placed.where("component_id <> most").groupBy("centre", "block").agg(F.collect_list(member).alias("some"), F.first("of").alias("of"), F.first("blocks").alias("blocks"))
    others = placed.groupBy("centre", "block").agg(F.collect_list(member).alias("others"))
    some = some.select("centre", "some", "of", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return some.join(others.hint("shuffle_merge"), ["centre", "block"]).select("some", "others", "of").mapInPandas(_block_linker(percent), "u long, v long").distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 24, rows: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text, ...).

    Words are maximal runs of bytes other than ASCII white space, A-Z lower-cased. Null, empty or
    blank texts have 0 shingles and link with nothing, as do rows without doc_id (their component_id
    is null and they are kept). doc_id names a document: of different texts that share one, that with
    the least MD5 of its words' hashes stands for it, and all its rows share its component. An empty
    table gives no rows; other columns of ``docs`` are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    run, schema = sketcher(shingle, bands, rows)
    sketch = stored(spark, docs.mapInArrow(run, schema), "sketch")
    whole = sketch.where("n_shingles > 0 and doc_id is not null")
    named = whole.groupBy("doc_id").agg(F.min("key").alias("key"))
    node_of = stored(spark, named.groupBy("key").agg(F.min("doc_id").alias("doc_id")), "nodes-of")
    nodes = stored(spark, whole.join(node_of, ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), "key", "bands"), "nodes")
    entries = stored(spark, _with_counts(nodes.select("id", F.explode("bands").alias("bucket"))), "entries")
    centre = stored(spark, centres(entries), "centres")
    first = stored(spark, stars(entries, centre), "stars")
    # texts of documents that share a bucket at all: the only ones any confirmation asks for
    wanted = entries.select("id").distinct().join(nodes.select("id", "key"), "id").withColumnRenamed("id", "doc_id")
    once = docs.join(wanted.hint("shuffle_merge"), "doc_id").withColumn("name", F.xxhash64("text")).dropDuplicates(["doc_id", "name"])
    texts = stored(spark, once.select("doc_id", "text", "key"), "texts")
    links = stored(spark, confirmed(texts, first, shingle, percent), "links")
    parts = components(spark, links)
    labelled = nodes.select("id").join(parts, "id", "left").select("id", F.coalesce("component_id", "id").alias("component_id"))
    now = stored(spark, _open(entries.select("bucket", "id").join(labelled, "id")), "open")
    late = stored(spark, open_links(spark, texts, now, centre, shingle, percent), "late")
    if not late.isEmpty():
        parts = components(spark, links.union(late))
    labels = node_of.withColumnRenamed("doc_id", "id").join(parts, "id", "left").select("key", F.coalesce("component_id", "id").alias("linked"))
    linked = named.join(labels, "key").select("doc_id", "linked")
    out = sketch.join(linked, "doc_id", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("linked", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, 85 of 100, over all documents."""
    return near_duplicates(spark, table(spark, sf_dir, "documents"), shingle=3, percent=85, bands=20, rows=4)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.v FROM r JOIN e ON e.u = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""
