"""Benchmark decontamination by a stored positional inverted index of the training tokens, in DataFrame functions alone.

The index is a written table of postings (document, term, position) of the terms that the benchmark uses; each task
writes a segment of its own in the order of terms, so the list of a rare term is read from few row groups. Everything else
reads lists: how often terms occur, the phrases, the terms that stand close together. Texts are split once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, packed_row, prepare, sized_broadcast, text_or_empty, unpacked_row, written

WINDOW = 13
#: A benchmark item's rarest terms that a document must hold close together, and how close to the rarest, for a proximity match.
NEAR_TERMS, NEAR_WITHIN = 3, 30
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text: A-Z in lower case, digits, a-z and all beyond ASCII are word characters."""
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, _GAP), "")


def item_tokens(bench: DataFrame) -> DataFrame:
    """(item, item_id, n_words, at, term): the words of the distinct (item_id, text); ``item`` numbers these. Written once."""
    rows = bench.select("item_id", "text").distinct().select("item_id", words(text_or_empty()).alias("words"))
    rows = written(rows.select(F.monotonically_increasing_id().alias("item"), "item_id", "words"))
    return written(rows.select("item", "item_id", F.size("words").alias("n_words"), F.posexplode("words").alias("at", "term")))


@dataclass
class PositionalIndex:
    """terms: (term, term_id, n: its postings); postings: (row, term_id, pos); catalog: (row, doc_id, text_hash, text_bytes, n_words).

    ``row`` numbers the rows of the documents, so repeated rows and equal ids stay apart. text_hash and text_bytes are the text's xxhash64 and UTF-8 length.
    """

    terms: DataFrame
    postings: DataFrame
    catalog: DataFrame

    @staticmethod
    def build(docs: DataFrame, terms: DataFrame) -> PositionalIndex:
        """Stores where the terms (column ``term``) occur in docs (doc_id, text).

        Null and empty texts are in the catalog with no words; repeated rows have postings each; other columns
        are ignored; no terms or no rows give an index without postings. Each text leads with an entry of term_id 0, whose pos is
        its number of words: the catalog is the list of that entry. The terms are broadcast if their bytes allow it, else joined by shuffle.
        """
        spark = prepare(docs.sparkSession)
        named = written(terms.where("term <> ''").select("term").distinct().select("term", (F.monotonically_increasing_id() + 1).alias("term_id")))
        lead = spark.range(1).select(F.lit("").alias("term"), F.lit(0).cast("long").alias("term_id"))
        lookup = sized_broadcast(named.unionByName(lead), F.octet_length("term") + 40)
        t = text_or_empty()
        rows = docs.select("doc_id", t.alias("text")).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), F.octet_length("text").alias("text_bytes"), F.concat(F.array(F.lit("")), words(F.col("text"))).alias("words"))
        flat = rows.select("row", "doc_id", "text_hash", "text_bytes", F.size("words").alias("n"), F.posexplode_outer("words").alias("at", "term"))
        first = lambda c: F.when(F.col("at") == 0, F.col(c))  # noqa: E731 - only the leading entry says whose row it is
        stored = flat.join(lookup, "term").select("row", "term_id", (F.when(F.col("at") == 0, F.col("n")).otherwise(F.col("at")) - 1).alias("pos"), *[first(c).alias(c) for c in ("doc_id", "text_hash", "text_bytes")])
        stored = written(stored.sortWithinPartitions("term_id"))
        postings = stored.where("term_id > 0").select("row", "term_id", "pos")
        n = postings.groupBy("term_id").agg(F.count("*").alias("n"))
        counted = written(named.join(n, "term_id", "left").select("term", "term_id", F.coalesce("n", F.lit(0).cast("long")).alias("n")))
        return PositionalIndex(counted, postings, stored.where("term_id = 0").select("row", "doc_id", "text_hash", "text_bytes", F.col("pos").alias("n_words")))

    def lists(self, wanted: DataFrame) -> DataFrame:
        """The postings of the terms of ``wanted`` (term_id, ...), with its other columns."""
        return self.postings.join(sized_broadcast(wanted, F.lit(64)), "term_id")

    def of_rows(self, rows: DataFrame) -> DataFrame:
        """The postings of the rows of ``rows`` (row)."""
        return self.postings.join(sized_broadcast(rows.select("row").distinct(), F.lit(40)), "row", "left_semi")


def phrases(index: PositionalIndex, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(runs, their words): the stretches of items whose windows share their two rarest occurrences.

    runs: (run, item_id, need, roles); need is a window's length, roles the one or two rarest occurrences as (term_id, at). words: (run, at, term_id).
    """
    known = items.join(sized_broadcast(index.terms, F.octet_length("term") + 40), "term")
    last = F.greatest(F.col("n_words") - window, F.lit(0))
    starts = known.select("item", "item_id", "n_words", "at", "term", "term_id", "n", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - window + 1), F.least(last, F.col("at")))).alias("start"))
    order = Window.partitionBy("item", "start").orderBy("n", "term", "at")
    two = starts.withColumn("r", F.row_number().over(order)).where("r <= 2").groupBy("item", "item_id", "n_words", "start").agg(F.array_sort(F.collect_list(F.struct("r", "term_id", "at"))).alias("roles"))
    two = two.withColumn("roles", F.transform("roles", lambda x: F.struct(x["term_id"].alias("term_id"), x["at"].alias("at"))))
    runs = two.groupBy("item", "item_id", "n_words", "roles").agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    need = F.least("n_words", F.lit(window))
    runs = written(runs.select(F.monotonically_increasing_id().alias("run"), "item", "item_id", need.alias("need"), "roles", "lo", (F.col("hi") + need - 1).alias("hi")))
    own = runs.select("run", "item", F.explode(F.sequence("lo", "hi")).alias("at")).join(known.select("item", "at", "term_id"), ["item", "at"])
    return runs.select("run", "item_id", "need", "roles"), written(own.select("run", "at", "term_id"))


def phrase_matches(index: PositionalIndex, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each row with matches: (row, spans, items).

    spans: sorted distinct (start, end) of runs of words in which each word is inside an occurring window; items: the sorted ids,
    as strings, of the items with such windows. The list of each stretch's rarest term is intersected, both shifted by their place in
    the item, with that of the second rarest; what is left, with the lists of all its terms. Whole windows of a stretch hold both
    rarest occurrences, so matched words count where as many as a window has follow each other.
    """
    runs, run_words = phrases(index, items, window)
    roles = runs.select("run", F.size("roles").alias("parts"), F.explode("roles").alias("x")).select("run", "parts", "x.term_id", "x.at")
    met = index.lists(roles).groupBy("row", "run", "parts", (F.col("pos") - F.col("at")).alias("origin")).agg(F.count("*").alias("n"))
    met = written(met.where("n = parts").select("row", "run", "origin"))
    asked = met.join(sized_broadcast(run_words, F.lit(48)), "run").select("row", "run", "origin", "at", "term_id", (F.col("origin") + F.col("at")).alias("pos"))
    seen = asked.join(index.of_rows(met), ["row", "term_id", "pos"]).groupBy("row", "run", "origin").agg(F.sort_array(F.collect_set("at")).alias("ats"))
    seen = seen.join(sized_broadcast(runs.select("run", "item_id", "need"), F.lit(64)), "run")
    edge = lambda step: F.filter("ats", lambda x: ~F.array_contains("ats", x + step))
    spans = F.zip_with(edge(-1), edge(1), lambda a, b: F.struct((F.col("origin") + a).alias("start"), (F.col("origin") + b + 1).alias("end")))
    found = seen.select("row", "item_id", F.explode(F.filter(spans, lambda s: s["end"] - s["start"] >= F.col("need"))).alias("span"))
    return found.groupBy("row").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))


def proximity_matches(index: PositionalIndex, items: DataFrame, terms: int = NEAR_TERMS, within: int = NEAR_WITHIN) -> DataFrame:
    """(row, item_id): rows that hold an item's ``terms`` rarest distinct terms no further than ``within`` words from one place of the rarest.

    Items without words match nothing; of an item with fewer terms all are asked for. Lists meet by row and by cells
    of ``within`` positions, so a term that fills a long text costs no more than its places times those near them.
    """
    known = items.select("item", "item_id", "term").distinct().join(sized_broadcast(index.terms, F.octet_length("term") + 40), "term")
    rank = F.row_number().over(Window.partitionBy("item").orderBy("n", "term"))
    rare = known.withColumn("r", rank).where(F.col("r") <= terms)
    rare = written(rare.join(rare.groupBy("item").agg(F.count("*").alias("parts")), "item").select("item", "item_id", "parts", "r", "term_id"))
    hits = index.lists(rare)
    cell = lambda p: F.floor(p / within).cast("long")
    first = hits.where("r = 1").select("row", "item", "item_id", "parts", "pos", cell(F.col("pos")).alias("cell"))
    rest = hits.where("r > 1").select("row", "item", "r", F.col("pos").alias("other"), F.explode(F.sequence(cell(F.col("pos") - within), cell(F.col("pos") + within))).alias("cell"))
    met = first.join(rest, ["row", "item", "cell"]).where(F.abs(F.col("other") - F.col("pos")) <= within)
    met = met.groupBy("row", "item", "item_id", "parts", "pos").agg(F.count_distinct("r").alias("n")).where("n = parts - 1")
    return met.select("row", "item_id").unionByName(first.where("parts = 1").select("row", "item_id")).distinct()


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items (sorted ids as strings), n_near, contaminated, text_hash, text_bytes.

    n_hit counts words inside any occurrence of a window of ``window`` consecutive item words (a shorter item is one
    window); contaminated: these are at least a twentieth of the words, and not none; n_near counts items by proximity_matches(). Null
    and empty texts have no words; repeated rows give repeated rows; null ids are kept; other columns are ignored; an empty benchmark
    hits nothing; a null item_id is counted under no name. Lists are narrowed by rare terms before they are shuffled, so a frequent word or a hot source moves nothing.
    """
    prepare(docs.sparkSession)
    items = item_tokens(bench)
    index = PositionalIndex.build(docs, items.select("term"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("e")),
        lambda acc, s: F.struct((acc.n + F.greatest(F.lit(0), s.end - F.greatest(s.start, acc.e))).alias("n"), F.greatest(acc.e, s.end).alias("e")),
        lambda acc: acc.n,
    )
    found = phrase_matches(index, items, window).select("row", covered.cast("long").alias("hit"), "items")
    near = proximity_matches(index, items).groupBy("row").agg(F.count("item_id").alias("near"))
    out = index.catalog.join(found, "row", "left").join(near, "row", "left")
    none = F.lit(0).cast("long")
    names = F.coalesce("items", F.array().cast("array<string>"))
    out = out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("hit", none).alias("n_hit"), F.size(names).cast("long").alias("n_items"), names.alias("items"), F.coalesce("near", none).alias("n_near"), "text_hash", "text_bytes")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW, least_share: float = 0.0) -> DataFrame:
    """docs without those in which a window of the benchmark occurs; their columns and all other rows stay as they are.

    least_share: such words must make up this share of a document's words as well. The default drops a document for one window: a passage
    of a benchmark in a long document is as much of a leak as in a short one. Null ids, repeated rows, empty tables and
    columns of any name are taken as they come: rows are told by doc_id, hash and length of the text.
    """
    hit = contamination(docs, bench, window).where((F.col("n_hit") > 0) & (F.col("n_hit") >= least_share * F.col("n_words")))
    bad = written(hit.select("doc_id", "text_hash", "text_bytes").distinct())
    t = text_or_empty()
    rows = docs.select(packed_row(docs), F.struct(F.col("doc_id"), F.xxhash64(t).alias("h"), F.octet_length(t).alias("b")).alias("key"))
    keys = sized_broadcast(bad.select(F.struct(F.col("doc_id"), F.col("text_hash").alias("h"), F.col("text_bytes").alias("b")).alias("bad")), F.lit(96))
    return unpacked_row(rows.join(keys, F.col("key").eqNullSafe(F.col("bad")), "left_anti"), docs)


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """contamination() of the whole table documents by the whole table benchmark; item ids as a digest."""
    out = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated", "n_near")


#: The same in DuckDB's SQL: every window of every document is looked up, and every place of the rarest terms compared.
OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT k, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT k, i, dw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
h AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS p FROM m) GROUP BY k),
it AS (SELECT k, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT k, item_id::VARCHAR AS s FROM m) GROUP BY k),
bt AS (SELECT DISTINCT j, item_id, unnest(w) AS term FROM (SELECT row_number() OVER () AS j, item_id, w FROM (SELECT DISTINCT item_id, w FROM b))),
tok AS (SELECT k, term, p FROM (SELECT k, unnest(w) AS term, generate_subscripts(w, 1) AS p FROM d) WHERE term IN (SELECT term FROM bt)),
rare AS (SELECT * FROM (SELECT j, item_id, term, row_number() OVER (PARTITION BY j ORDER BY coalesce(c, 0), term) AS r FROM bt LEFT JOIN (SELECT term, count(*) AS c FROM tok GROUP BY term) USING (term)) WHERE r <= 3),
want AS (SELECT j, count(*) AS parts FROM rare GROUP BY j),
place AS (SELECT k, j, item_id, r, p FROM tok JOIN rare USING (term)),
met AS (SELECT a.k, a.j, a.item_id, a.p, count(DISTINCT b.r) AS n FROM place a JOIN place b ON a.k = b.k AND a.j = b.j AND abs(a.p - b.p) <= 30 WHERE a.r = 1 GROUP BY ALL),
ne AS (SELECT k, count(DISTINCT item_id) AS n_near FROM met JOIN want USING (j) WHERE n = parts GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN h USING (k) LEFT JOIN it USING (k) LEFT JOIN ne USING (k)
"""
