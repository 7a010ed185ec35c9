"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, documents, mix, packed_row, partitions, prepare, sized_broadcast, text_or_empty, trim, unpacked_row, words_of, written
from .graph import components

N_GRAM, SIMILARITY, RECALL, ROWS = 5, 0.8, 0.9999, 7
#: Members of a candidate group that one task compares with as many others.
BLOCK = 256
_P = np.uint64(0x9E3779B97F4A7C15)


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """The least number of bands of ``rows`` rows by which a pair of just this similarity is found with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def n_grams(texts: list[bytes], n: int = N_GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the distinct n-grams of each text's white-space separated words, sorted, one text after another.

    A text of fewer words, but not none, has one n-gram: all its words.
    """
    h, doc, counts = words_of(texts)
    grams = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for i in range(n):
        grams = grams * _P + h[i : i + len(grams)]
    whole = doc[: len(grams)] == doc[n - 1 :] if len(grams) else np.zeros(0, bool)
    grams, owner = mix(grams[whole]), doc[: len(grams)][whole]
    few = np.flatnonzero((counts > 0) & (counts < n))
    if len(few):
        first = np.cumsum(counts) - counts
        short = []
        for d in few.tolist():
            g = 0
            for x in h[first[d] : first[d] + counts[d]].tolist():
                g = (g * int(_P) + x + 1) % 2**64
            short.append(g)
        grams, owner = np.concatenate([grams, mix(np.array(short, np.uint64))]), np.concatenate([owner, few.astype(np.int32)])
    order = np.argsort(grams)
    order = order[np.argsort(owner[order].astype(np.uint16) if len(texts) < 65536 else owner[order], kind="stable")]
    grams, owner = grams[order], owner[order]
    if len(grams):
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        grams, owner = grams[new], owner[new]
    return grams, np.bincount(owner, minlength=len(texts)).astype(np.int64)


def signatures(grams: np.ndarray, sizes: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(digest of each set, its band hashes) for the sets that aren't empty."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros((0, bands), np.int64)
    digest = mix(np.add.reduceat(mix(grams ^ _P), starts) + sizes[sizes > 0].astype(np.uint64))
    low = (grams >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(20240501)
    mult = rng.integers(0, 2**32, bands * rows, np.uint32) | np.uint32(1)
    add = rng.integers(0, 2**32, bands * rows, np.uint32)
    out = np.empty((len(starts), bands), np.uint64)
    turned = np.empty_like(low)
    for b in range(bands):
        h = np.full(len(starts), np.uint64(b + 1))
        for r in range(b * rows, (b + 1) * rows):
            np.multiply(low, mult[r], out=turned)
            np.add(turned, add[r], out=turned)
            turned ^= turned >> np.uint32(15)
            h = mix(h * _P + np.minimum.reduceat(turned, starts).astype(np.uint64))
        out[:, b] = h
    return digest.view(np.int64), out.view(np.int64)


def _signature_batches(batches, n: int, bands: int, rows: int):
    for batch, texts in blocks(batches):
        grams, sizes = n_grams(texts, n)
        digest, band = signatures(grams, sizes, bands, rows)
        some = sizes > 0
        cls = np.zeros(len(texts), np.int64)
        cls[some] = digest
        offsets = np.concatenate(([0], np.cumsum(np.where(some, bands, 0)))).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(band.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(cls, mask=~some), lists], ["doc_id", "text_hash", "cls", "bands"])


def signed(docs: DataFrame, n: int = N_GRAM, bands: int | None = None, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_hash, cls, bands): cls is a digest of the n-gram set, null for a text without words."""
    bands = bands or bands_for(rows=rows)
    kind = dict(docs.dtypes)["doc_id"]
    t = text_or_empty()
    return docs.select("doc_id", F.xxhash64(t).alias("text_hash"), t.alias("text")).mapInArrow(lambda it: _signature_batches(it, n, bands, rows), f"doc_id {kind}, text_hash long, cls long, bands array<long>")


def candidate_groups(classes: DataFrame) -> DataFrame:
    """(node, component): classes that share a band hash with another, and the group they are connected to.

    In each bucket all are linked to the least class: as many links as members, never their pairs.
    """
    flat = classes.select("cls", F.explode("bands").alias("band"))
    hubs = flat.groupBy("band").agg(F.min("cls").alias("hub"), F.max("cls").alias("top")).where("hub <> top").select("band", "hub")
    return components(flat.join(hubs, "band").where("cls <> hub").select(F.col("cls").alias("a"), F.col("hub").alias("b")))


def _compare(rows: list[tuple], split: int, n: int, similarity: float, one: bool) -> Iterator[tuple]:
    """Links among rows[:split] and rows[split:] (or all among rows, if ``one``) as (cls, links, least linked class)."""
    cls = np.array([r[0] for r in rows], np.int64)
    weight = np.array([r[1] for r in rows], np.int64)
    grams, sizes = n_grams([r[2] for r in rows], n)
    _, column = np.unique(grams, return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), sizes)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    often = np.bincount(column)[column] > 1 if len(column) else np.zeros(0, bool)
    _, column = np.unique(column[often], return_inverse=True)
    owner, a, b = owner[often], (0, len(rows)) if one else (0, split), (0, len(rows)) if one else (split, len(rows))
    shared, width = np.zeros((a[1], b[1] - b[0]), np.float32), 8192
    for c in range(0, int(column.max()) + 1 if len(column) else 0, width):
        x, y = np.searchsorted(column, [c, c + width])
        m = np.zeros((len(rows), width), np.float32)
        m[owner[x:y], column[x:y] - c] = 1
        shared += m[: a[1]] @ m[b[0] :].T
    union = sizes[: a[1], None] + sizes[None, b[0] :] - shared
    linked = shared >= similarity * union - 1e-6
    if one:
        np.fill_diagonal(linked, False)
    links, least = np.zeros(len(rows), np.int64), cls.copy()
    links[: a[1]] += linked @ weight[b[0] :]
    if not one:
        links[split:] += linked.T @ weight[:split]
    i, j = np.nonzero(linked)
    j = j + b[0]
    while True:  # the least class of each connected set
        low = np.minimum(least[i], least[j])
        was = least.copy()
        np.minimum.at(least, i, low)
        np.minimum.at(least, j, low)
        if (was == least).all():
            break
    for k in np.flatnonzero(links).tolist():
        yield int(cls[k]), int(links[k]), int(least[k])


def _compare_batches(batches, n: int, similarity: float):
    """Takes rows sorted by (component, low, high, block); compares each such group's blocks."""
    out: list[tuple] = []

    def flush():
        cols = list(zip(*out)) if out else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["cls", "links", "least"])

    def groups():
        key, rows = None, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("component", "low", "high", "block", "cls", "n_texts")]
            for *k, block, cls, n_texts, text in zip(*cols, batch.column("text").cast("binary").to_pylist(), strict=True):
                if k != key:
                    if len(rows) > 1:
                        yield key, rows
                    key, rows = k, []
                rows.append((cls, n_texts, text or b"", block))
        if len(rows) > 1:
            yield key, rows

    for (_, low, high), rows in groups():
        split = sum(r[3] == low for r in rows)
        if low == high or 0 < split < len(rows):
            out.extend(_compare(rows, split, n, similarity, low == high))
        if len(out) > 10000:
            yield flush()
            out.clear()
    yield flush()
    trim()


def near_classes(docs: DataFrame, sig: DataFrame, n: int = N_GRAM, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(cls, n_texts, group, links): each n-gram set, its number of different texts, its group of similar sets, its links.

    A candidate group is cut into blocks, and a task compares two blocks, so a group of any size spreads over tasks; each
    pair of sets meets in one task, which counts its links and never puts pairs out.
    """
    spark = docs.sparkSession
    some = sig.where("cls is not null")
    classes = written(some.groupBy("cls").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.any_value("bands").alias("bands")))
    texts = some.select("cls", "text_hash").distinct().groupBy("cls").agg(F.count("*").alias("n_texts"))
    groups = candidate_groups(classes).checkpoint()
    parts = groups.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    members = groups.join(parts, "component").join(classes.select(F.col("cls").alias("node"), "rep"), "node").join(texts.withColumnRenamed("cls", "node"), "node")
    members = members.select(F.col("node").alias("cls"), "component", "parts", "n_texts", F.expr("cast(pmod(xxhash64(node), parts) as int)").alias("block"), F.col("rep.doc_id").alias("_id"), F.col("rep.text_hash").alias("_hash")).checkpoint()
    keys = sized_broadcast(members, F.lit(120))
    t = text_or_empty()
    own = docs.select("doc_id", t.alias("text"), F.xxhash64(t).alias("text_hash"))
    with_text = own.join(keys, own.doc_id.eqNullSafe(F.col("_id")) & (own.text_hash == F.col("_hash"))).drop("doc_id", "text_hash", "_id", "_hash").dropDuplicates(["cls"])
    with_text = with_text.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    with_text = with_text.select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "cls", "n_texts", "text")
    dealt = with_text.repartition(partitions(spark), "component", "low", "high").sortWithinPartitions("component", "low", "high", "block", "cls")
    found = written(dealt.mapInArrow(lambda it: _compare_batches(it, n, similarity), "cls long, links long, least long"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    group = components(found.select(F.col("cls").alias("a"), F.col("least").alias("b")))
    return texts.join(links, "cls", "left").join(group.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "n_texts", F.coalesce("component", "cls").alias("group"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def near_duplicates(docs: DataFrame, n: int = N_GRAM, similarity: float = SIMILARITY, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """A row for each document: doc_id, text_hash, class_id, class_hash, n_links.

    Two texts are linked if their n-gram sets have a Jaccard similarity of at least ``similarity``; a class is what links
    connect. class_id and class_hash are the least (doc_id, text_hash) of the class; n_links counts the different texts, copies not
    among them, that the document's text is linked to. Texts without words (null, empty, blank) are classes of their own and have no
    links. Repeated rows share a class; null ids come first; other columns are ignored; no rows give no rows.
    """
    prepare(docs.sparkSession)
    sig = written(signed(docs, n, bands_for(similarity, recall, rows), rows))
    near = written(near_classes(docs, sig, n, similarity))
    joined = sig.drop("bands").join(near, "cls", "left")
    first = joined.where("cls is not null").groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    out = joined.join(first, "group", "left")
    alone = F.col("cls").isNull()
    return out.select("doc_id", "text_hash", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"), F.when(alone, F.col("text_hash")).otherwise(F.col("first.text_hash")).alias("class_hash"), F.coalesce(F.col("links") + F.col("n_texts") - 1, F.lit(0).cast("long")).alias("n_links"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class, the one of the least doc_id; columns stay, whatever their names. Texts without words all stay.

    Null ids come first; of repeated rows one stays; no rows give no rows.
    """
    found = near_duplicates(docs, **options)
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("class_hash"))
    firsts = written(found.where(first).groupBy(F.struct("doc_id", "text_hash").alias("first")).agg(F.count("*").alias("rows")))
    t = text_or_empty()
    blank = F.trim(F.translate(t, "\t\n\x0b\f\r", "     ")) == ""
    rows = docs.select(packed_row(docs), F.struct(F.col("doc_id"), F.xxhash64(t).alias("text_hash")).alias("key"), blank.alias("blank"))
    same = F.col("key").eqNullSafe(F.col("first"))
    kept = rows.join(sized_broadcast(firsts.select("first"), F.lit(80)), same, "left_semi")
    again = firsts.where(F.col("rows") > 1).select("first")
    if not again.isEmpty():
        again = sized_broadcast(again, F.lit(80))
        many = kept.join(again, same, "left_semi")
        kept = kept.join(again, same, "left_anti").unionByName(many.where("blank")).unionByName(many.where("not blank").dropDuplicates(["key"]))
    return unpacked_row(kept, docs)


def op9_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """near_duplicates() of the whole table documents."""
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "class_id", "n_links")


#: The same in DuckDB's SQL: all pairs that share an n-gram, their exact similarity, and the classes by recursion.
OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
texts AS (SELECT t, any_value(w) AS w, dense_rank() OVER (ORDER BY t) AS x FROM d GROUP BY t),
g AS (SELECT DISTINCT x, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (SELECT x, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM texts WHERE len(w) > 0)),
n AS (SELECT x, count(*) AS n FROM g GROUP BY x),
p AS (SELECT a.x AS a, b.x AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.x <> b.x GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n na ON na.x = a JOIN n nb ON nb.x = b WHERE c >= 0.8 * (na.n + nb.n - c) - 1e-9),
r AS (SELECT DISTINCT a AS x, a AS m FROM l UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.x),
f AS (SELECT x, min(m) AS m FROM r GROUP BY x),
e AS (SELECT a AS x, count(*) AS n_links FROM l GROUP BY a),
o AS (SELECT d.doc_id, len(d.w) AS nw, coalesce(f.m, texts.x) AS m, coalesce(e.n_links, 0) AS n_links FROM d JOIN texts USING (t) LEFT JOIN f ON f.x = texts.x LEFT JOIN e ON e.x = texts.x)
SELECT doc_id, CASE WHEN nw = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY m) END AS class_id, n_links::BIGINT AS n_links FROM o
"""
