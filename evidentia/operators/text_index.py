"""An inverted index of words: ranked search that skips blocks, and phrases.

The index is a table of (term, block of documents): the documents as places in
the block, each one's weight of the term, its length and the term's positions,
and the greatest share of a score that any of them can have. It is partitioned
by a hash of the term, so that a search reads only its own terms' files. What a
batch of texts has of a block and a bucket of terms is sent as one row.

Ranked search (BM25) first adds up these greatest shares by block. The most
promising blocks are scored; the k-th score found there is a bound, and only
blocks that can reach it are read any further. Phrases are found by
intersecting positions. Neither reads a text. An index that is ranked only can
be built without positions, which are most of it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.sources.shared import bound_batches, small_batches

#: Ids of a block: documents with the same ``id // BLOCK_IDS``.
BLOCK_IDS = 1_024
BUCKETS = 32
#: Blocks that give the first bound of a ranked search.
FIRST_BLOCKS = 8
K1, B = 1.2, 0.75
#: Files that a bucket's blocks are dealt to.
SLOTS = 8
#: Places between two fields, so that no phrase runs from one into the next.
GAP = 1_000
POSTINGS = (
    "term string, block long, most double, documents int, ids array<int>, weight array<double>, length array<int>, "
    "starts array<int>, places array<int>, bucket int"
)
#: Terms with the number of their documents; these, with the number of their places; these.
CHUNKS = (
    "bucket int, block long, terms array<string>, sizes array<int>, ids array<int>, weight array<double>, length array<int>, "
    "counts array<int>, places array<int>"
)


def stem(word: str) -> str:
    """A word without the ending of its plural (the S-stemmer: Harman, 1991)."""
    if len(word) < 4:
        return word
    if word.endswith("ies") and not word.endswith(("eies", "aies")):
        return word[:-3] + "y"
    if word.endswith("es") and not word.endswith(("aes", "ees", "oes")):
        return word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")):
        return word[:-1]
    return word


def query_terms(text: str) -> list[str]:
    """Stems of a query's words, in order."""
    return [stem(w) for w in re.sub(r"[^a-z0-9]+", " ", text.lower()).split()]


@dataclass(frozen=True)
class TextIndex:
    """Where an index lies, how many documents it has, their mean length, and whether it has positions."""

    path: str
    documents: int
    mean_length: float
    positions: bool = True

    def postings(self, spark: SparkSession, terms: list[str]) -> DataFrame:
        """The rows of some terms; the files of other buckets are not read."""
        wanted = sorted(set(terms))
        rows = spark.createDataFrame([(t,) for t in wanted], "term string").select(bucket_of(F.col("term"))).distinct()
        buckets = [r[0] for r in rows.collect()] if wanted else []
        table = spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")
        return table.where(F.col("bucket").isin(buckets) & F.col("term").isin(wanted))


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def impact(weight: Column, length: Column, mean: float) -> Column:
    """What a term of this weight adds to the score of a document, but for the term's own factor."""
    return weight * (K1 + 1) / (weight + K1 * (1 - B + B * length / F.lit(max(mean, 1e-9))))


def _plain(text: Column) -> Column:
    """The words of a text, with one space between them."""
    return X.normalize_span(F.coalesce(text, F.lit("")))


def _lists(values: np.ndarray | pa.Array, ends: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values, kind))


def _ends(sizes: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(sizes)].astype(np.int64)


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where rows begin whose keys differ from those before."""
    return np.flatnonzero(np.r_[True, np.any([np.diff(k) != 0 for k in keys], axis=0)])


def _chunks(weights: list[float], positions: bool = True):
    """What a batch of texts, words in fields, has of each bucket and block: one row, by term and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.take(pc.array_sort_indices(batch.column("id")))
            ids = np.asarray(batch.column("id"), np.int64)
            doc, place, words, weight = [], [], [], []
            start = np.zeros(batch.num_rows, np.int64)
            length = np.zeros(batch.num_rows, np.int64)
            for k, w in enumerate(weights):
                text = batch.column(f"f{k}")
                field = pc.ascii_split_whitespace(pc.if_else(pc.equal(text, ""), None, text))
                sizes = np.asarray(pc.fill_null(pc.list_value_length(field), 0), np.int64)
                row = np.repeat(np.arange(batch.num_rows), sizes)
                doc.append(row)
                place.append(np.arange(len(row)) - _ends(sizes)[row] + start[row])
                words.append(field.flatten())
                weight.append(np.full(len(row), w))
                start += sizes + GAP
                length += sizes
            coded = pa.concat_arrays(words).dictionary_encode()
            stems = [stem(w) for w in coded.dictionary.to_pylist()]
            if not stems:
                continue
            names = sorted(set(stems))
            number = {n: k for k, n in enumerate(names)}
            of_word = np.array([number[s] for s in stems], np.int64)
            bucket = np.fromiter((xxhash.xxh64_intdigest(n, 42) for n in names), np.uint64, len(names)).view(np.int64) % BUCKETS
            doc, place, weight = map(np.concatenate, (doc, place, weight))
            term = of_word[np.asarray(coded.indices, np.int64)]
            block, inside = np.divmod(ids, BLOCK_IDS)
            nth = _ends(np.diff(block) != 0)  # of its block among the batch's
            key = ((bucket[term] * (nth[-1] + 1) + nth[doc]) * len(names) + term) * batch.num_rows + doc
            order = np.argsort(key, kind="stable")
            term, doc, place, weight = term[order], doc[order], place[order], weight[order]
            first = _changes(key[order])
            counts, weight, term, doc = np.diff(np.r_[first, len(term)]), np.add.reduceat(weight, first), term[first], doc[first]
            if not positions:
                counts, place = np.zeros_like(counts), place[:0]
            own, at = bucket[term], block[doc]
            begin, part = _changes(own, at), _changes(own, at, term)
            cut = np.r_[begin, len(term)]
            of_terms = np.searchsorted(part, cut)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(own[begin], pa.int32()), pa.array(at[begin]),
                    _lists(pa.array(names, pa.string()).take(pa.array(term[part])), of_terms), _lists(np.diff(np.r_[part, len(term)]), of_terms, pa.int32()),
                    _lists(inside[doc], cut, pa.int32()), _lists(weight, cut), _lists(length[doc], cut, pa.int32()), _lists(counts, cut, pa.int32()),
                    _lists(place, _ends(counts)[cut], pa.int32()),
                ],
                ["bucket", "block", "terms", "sizes", "ids", "weight", "length", "counts", "places"],
            )

    return run


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of chunks that come in order of bucket and block: one row for each term and block."""

    def postings(held: list[dict[str, np.ndarray]], bucket: int, block: int) -> pa.RecordBatch:
        values = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        names, term = np.unique(values["terms"], return_inverse=True)
        term = np.repeat(term, values["sizes"])
        order = np.lexsort((values["ids"], term))
        counts, term = values["counts"][order], term[order]
        # Places go where their documents go.
        ends = _ends(counts)
        moved = np.repeat(_ends(values["counts"])[:-1][order] - ends[:-1], counts) + np.arange(ends[-1])
        cut = np.r_[_changes(term), len(term)]
        row = np.repeat(np.arange(len(names)), np.diff(cut))
        # One more start than documents in a row: where the places of its last one end.
        starts = np.insert(ends[:-1] - ends[cut][row], cut[1:], np.diff(ends[cut]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(names), bucket), pa.int32()), pa.array(np.full(len(names), block), pa.int64()), pa.array(names.tolist(), pa.string()),
                _lists(values["ids"][order], cut, pa.int32()), _lists(values["weight"][order], cut), _lists(values["length"][order], cut, pa.int32()),
                _lists(starts, cut + np.arange(len(cut)), pa.int32()), _lists(values["places"][moved], ends[cut], pa.int32()),
            ],
            ["bucket", "block", "term", "ids", "weight", "length", "starts", "places"],
        )

    at, held = None, []
    for batch in batches:
        columns = {c: batch.column(c) for c in ("terms", "sizes", "ids", "weight", "length", "counts", "places")}
        for k, key in enumerate(zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist(), strict=True)):
            if key != at and held:
                yield postings(held, *at)
                held = []
            at = key
            held.append({c: v[k].values.to_numpy(zero_copy_only=False) for c, v in columns.items()})
    if held:
        yield postings(held, *at)


def build_text_index(docs: DataFrame, path: str, fields: Mapping[str, float], id_: str = "doc_id", positions: bool = True) -> TextIndex:
    """Index the ``fields`` (column and weight of a word there) of all documents.

    Phrases need ``positions``; a ranked search does not.

    Ids are distinct whole numbers; rows with a null id are left out. A null
    field has no words; a document without words counts, but is never found.
    """
    spark = docs.sparkSession
    kept = docs.where(F.col(id_).isNotNull()).select(
        F.col(id_).cast("long").alias("id"), *(_plain(F.col(c)).alias(f"f{k}") for k, c in enumerate(fields))
    )
    words = sum((F.when(F.col(f"f{k}") == "", 0).otherwise(F.regexp_count(f"f{k}", F.lit(" ")) + 1) for k in range(len(fields))), F.lit(0))
    count, total = kept.agg(F.count("*"), F.sum(words)).first()
    mean = (total or 0) / max(1, count)
    kind = "bucket int, block long, term string, ids array<int>, weight array<double>, length array<int>, starts array<int>, places array<int>"
    with small_batches(spark):
        chunks = kept.mapInArrow(_chunks(list(fields.values()), *([] if positions else [False])), CHUNKS)
        # A block's documents bound what meets, however frequent a term.
        dealt = chunks.repartition("bucket", F.pmod("block", F.lit(SLOTS))).sortWithinPartitions("bucket", "block")
        most = F.array_max(F.zip_with("weight", "length", lambda w, n: impact(w, n, mean)))
        table = dealt.mapInArrow(_rows_of, kind).withColumns({"most": most, "documents": F.size("ids")})
        table.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/postings")
    spark.createDataFrame([(count, float(mean), positions)], "documents long, mean_length double, positions boolean").coalesce(1).write.parquet(f"{path}/index")
    return TextIndex(path, count, mean, positions)


def open_text_index(spark: SparkSession, path: str) -> TextIndex:
    """An index that was built before, by another session too."""
    held = spark.read.parquet(f"{path}/index").first().asDict()
    return TextIndex(path, held["documents"], held["mean_length"], held.get("positions", True))


def _opened(rows: DataFrame, *columns: str) -> DataFrame:
    """One row for each term and document: ``term, id`` and some of ``weight, length, places``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (term, block) in enumerate(zip(batch.column("term").to_pylist(), batch.column("block").to_pylist(), strict=True)):
                value = {c: batch.column(c)[k].values for c in batch.schema.names[2:]}
                if "places" in value:
                    value["places"] = _lists(value["places"], np.asarray(value["starts"]))
                ids = pa.array(np.asarray(value["ids"], np.int64) + block * BLOCK_IDS)
                yield pa.RecordBatch.from_arrays([pa.array([term] * len(ids), pa.string()), ids, *(value[c] for c in columns)], ["term", "id", *columns])

    bound_batches(rows.sparkSession)
    kinds = {"weight": "double", "length": "int", "places": "array<int>"}
    held = rows.select("term", "block", "ids", *columns, *(["starts"] if "places" in columns else []))
    return held.mapInArrow(run, ", ".join(["term string, id long", *(f"{c} {kinds[c]}" for c in columns)]))


def search(spark: SparkSession, index: TextIndex, query: str, k: int, first_blocks: int = FIRST_BLOCKS) -> DataFrame:
    """``pos, id, score`` (9 digits) of the ``k`` best documents; ties go to the smaller id.

    A word that the query repeats counts once; a query without words, or with
    none that any document has, finds nothing.
    """
    return ranked(spark, index, query, k, first_blocks)[0]


def ranked(spark: SparkSession, index: TextIndex, query: str, k: int, first_blocks: int = FIRST_BLOCKS) -> tuple[DataFrame, dict[str, int]]:
    """As ``search``, and how many blocks there are and how many were scored."""
    terms = sorted(set(query_terms(query)))
    rows = index.postings(spark, terms)
    having = {r["term"]: r["n"] for r in rows.groupBy("term").agg(F.sum("documents").alias("n")).collect()}
    factor = {t: math.log(1 + (index.documents - n + 0.5) / (n + 0.5)) for t, n in having.items()}
    of_term = F.coalesce(*(F.when(F.col("term") == t, F.lit(f)) for t, f in factor.items()), F.lit(0.0))
    bounds = rows.groupBy("block").agg(F.sum(of_term * F.col("most")).alias("bound"))
    ahead = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(first_blocks).collect()]

    def scored(some: DataFrame) -> DataFrame:
        share = of_term * impact(F.col("weight"), F.col("length"), index.mean_length)
        return _opened(some, "weight", "length").groupBy("id").agg(F.round(F.sum(share), 9).alias("score"))

    order = F.desc("score"), F.col("id")
    best = scored(rows.where(F.col("block").isin(ahead))).orderBy(*order).limit(k)
    held = best.collect()
    found = spark.createDataFrame([(r["id"], r["score"]) for r in held], "id long, score double")
    least = held[k - 1]["score"] if len(held) >= k > 0 else 0.0
    # A bound may be off by its last digits, and scores are rounded.
    open_ = bounds.where(~F.col("block").isin(ahead) & (F.col("bound") >= least - 1e-6))
    rest = scored(rows.join(open_.select("block"), "block", "left_semi"))
    numbered = F.row_number().over(Window.orderBy(*order)).alias("pos")
    all_best = found.unionByName(rest).orderBy(*order).limit(max(0, k))
    counts = {"blocks": bounds.count(), "scored": len(ahead) + open_.count()}
    return all_best.select(numbered, "id", "score"), counts


def phrase(spark: SparkSession, index: TextIndex, text: str) -> DataFrame:
    """``id, times`` of all documents that have the words of ``text`` in a row, in any of their forms."""
    if not index.positions:
        raise ValueError("the index was built without positions")
    terms = query_terms(text)
    if not terms:
        return spark.createDataFrame([], "id long, times int")
    rows = index.postings(spark, terms)
    several = len(set(terms))
    shared = rows.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") == several).select("block")
    by_doc = _opened(rows.join(shared, "block", "left_semi"), "places").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("of")).where(F.size("of") == several)
    starts = None
    for k, term in enumerate(terms):
        here = F.transform(F.col("of")[term], lambda p: p - k)
        starts = here if starts is None else F.array_intersect(starts, here)
    return by_doc.select("id", F.size(starts).alias("times")).where("times > 0")
