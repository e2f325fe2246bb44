"""Hard-negative mining with ball trees: branch and bound on inner products.

Rows are dealt to parts: cells around centres that are fitted on at most
``SAMPLE_ROWS`` rows, and a cell of many rows to several parts by a hash of the
row. Every part builds a ball tree over all its rows, in memory that the size
of a part bounds. The inner product of a query q with a row of a ball lies
within |q| r of that with its centre, so a node (and before that a whole cell,
whose parts the query is then not sent to) goes if it lies outside the score
window, strictly beneath the current k-th score, or has no row of the wanted
labels.

An anchor is first searched in its own part. The k-th score found there bounds
what is still needed from others, to which it is sent together with it. Scores
are exact integers; equal scores are ordered by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import partitions, ragged, stored, tidy

#: Rows that the centres are fitted on, and centres at most.
SAMPLE_ROWS, CELLS = 20_000, 1_024
#: Rows of a part grow with the root of all rows, between these: a query is sent
#: to fewer parts of a large table, and a part fits in a task's memory.
LEAST_ROWS, MOST_ROWS = 2_048, 131_072
#: Rows of a leaf, and queries that are searched together.
LEAF, BLOCK = 64, 512
#: Rows of queries that a task holds before it sends them on.
SENT = 4_096
LONGEST = (1 << 63) - 1

ROWS = "vec_id long, row long, label long, anchor boolean, wide boolean, vector binary, cell int, distance double"
SENDING = "part int, kind int, anchor boolean, row long, vec_id long, label long, wide boolean, vector binary, marks array<long>"


def pack(vectors: list[np.ndarray]) -> tuple[list[bytes], list[bool]]:
    """Whole numbers as bytes: two each where they fit, else as doubles."""
    wide = [bool(len(v)) and bool(np.abs(v).max() > 32_767) for v in vectors]
    return [v.astype("<f8" if w else "<i2").tobytes() for v, w in zip(vectors, wide, strict=True)], wide


def unpack(packed: list[bytes], wide: list[bool]) -> np.ndarray:
    """Rows of a matrix of doubles; shorter vectors end in zeros."""
    rows = [np.frombuffer(b, "<f8" if w else "<i2") for b, w in zip(packed, wide, strict=True)]
    size = max((len(r) for r in rows), default=0)
    if all(len(r) == size for r in rows):
        return np.array(rows, np.float64).reshape(len(rows), size)
    out = np.zeros((len(rows), size))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def widened(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two matrices with as many columns, zeros at the end of the narrower."""
    size = max(a.shape[1], b.shape[1])
    return tuple(m if m.shape[1] == size else np.pad(m, ((0, 0), (0, size - m.shape[1]))) for m in (a, b))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers; what is no long becomes the nearest one."""
    most = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(a).dot(whole(b).T), -LONGEST, LONGEST).astype(np.int64)


def bounds(queries: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of every query with a point of every ball, rounded outwards."""
    queries, centres = widened(queries, centres)
    with np.errstate(over="ignore", invalid="ignore"):
        norms = np.sqrt((queries * queries).sum(1))[:, None]
        middle, spread = queries @ centres.T, norms * radius
        spread = spread + 1e-9 * (norms * np.sqrt((centres * centres).sum(1)) + spread) + 1e-6
        low, high = middle - spread, middle + spread
    return np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high)


class BallTree:
    """Nodes in order of levels; a node has the rows from start to stop."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        order = np.lexsort((rows, ids))
        todo, nodes = [(0, len(order), -1)], []
        for at, (a, b, parent) in enumerate(todo):
            here = order[a:b]
            points, kinds = vectors[here], labels[here]
            centre = points.mean(0)
            away = np.sqrt(((points - centre) ** 2).sum(1))
            nodes.append((a, b, parent, centre, away.max(initial=0.0), kinds.min(), kinds.max()))
            if b - a <= LEAF:
                continue
            if kinds.min() != kinds.max():
                # Labels apart first, so that a search for one of them leaves the others out.
                place = np.argsort(kinds, kind="stable")
                cuts = np.flatnonzero(np.diff(kinds[place])) + 1
                cut = int(cuts[np.argmin(np.abs(cuts - (b - a) // 2))])
            else:
                far = points[np.argmax(away)]
                other = points[np.argmax(((points - far) ** 2).sum(1))]
                place, cut = np.argsort(points @ (other - far), kind="stable"), (b - a) // 2
            order[a:b] = here[place]
            todo += [(a, a + cut, at), (a + cut, b, at)]
        self.vectors, self.labels, self.ids, self.rows = vectors[order], labels[order], ids[order], rows[order]
        self.start, self.stop, self.parent, centres, self.radius, self.low, self.high = map(np.array, zip(*nodes, strict=True))
        self.centres = centres.reshape(len(nodes), vectors.shape[1])
        inner_nodes = np.zeros(len(nodes), bool)
        inner_nodes[self.parent[1:]] = True
        self.leaves = np.flatnonzero(~inner_nodes)

    def search(
        self, queries: np.ndarray, who: np.ndarray, label: np.ndarray, row: np.ndarray,
        least: np.ndarray, most: np.ndarray, k: int, same: bool,
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first ``k`` rows of each wish: its number, the row's place in the tree, the score.

        Wish i asks with vector ``who[i]``, for rows of its label (or of any
        other, if not ``same``), but its own row, with scores from ``least`` to
        ``most``.
        """
        low, high = bounds(queries, self.centres, self.radius)
        low, high = low[who], high[who]
        one = (self.low == self.high) & (self.low == label[:, None])
        wanted = (self.low <= label[:, None]) & (label[:, None] <= self.high) if same else ~one
        open_ = (high >= least[:, None]) & (low <= most[:, None]) & wanted
        for node in range(1, len(self.parent)):  # parents come first
            open_[:, node] &= open_[:, self.parent[node]]
        high = np.where(open_[:, self.leaves], high[:, self.leaves], -np.inf)
        best = np.argsort(-high, axis=1, kind="stable")
        left = open_[:, self.leaves].sum(1)
        floor = least.astype(np.float64)
        out = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        step, level = 1, 0
        while level < left.max(initial=0):
            wish, nth = np.nonzero((np.arange(level, min(level + step, best.shape[1])) < left[:, None]))
            leaf = best[wish, nth + level]
            worth = high[wish, leaf] >= floor[wish]
            out = self._merged(out, self._scored(queries, who, label, row, floor, most, same, wish[worth], leaf[worth]), k)
            counts = np.bincount(out[0], minlength=len(who))
            full = np.flatnonzero(counts == k)
            last = np.cumsum(counts) - 1
            floor[full] = np.maximum(floor[full], out[2][last[full]])
            level, step = level + step, step * 2
        return out

    def _scored(self, queries, who, label, row, floor, most, same, wish, leaf):
        order = np.argsort(leaf, kind="stable")
        wish, leaf = wish[order], leaf[order]
        cuts = [0, *(np.flatnonzero(np.diff(leaf)) + 1).tolist(), len(leaf)]
        found = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            node = self.leaves[leaf[a]]
            s, e = self.start[node], self.stop[node]
            asked = wish[a:b]
            vectors, of = np.unique(who[asked], return_inverse=True)
            scores = inner(*widened(queries[vectors], self.vectors[s:e]))[of]
            fits = (scores >= floor[asked][:, None]) & (scores <= most[asked][:, None])
            fits &= (self.labels[s:e] == label[asked][:, None]) == same
            fits &= self.rows[s:e] != row[asked][:, None]
            i, j = np.nonzero(fits)
            found.append((asked[i], j + s, scores[i, j]))
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else None

    def _merged(self, held, more, k: int):
        """Both lists together, the first ``k`` of each wish."""
        if more is None:
            return held
        wish, place, score = (np.concatenate(pair) for pair in zip(held, more, strict=True))
        order = np.lexsort((self.rows[place], self.ids[place], -score, wish))
        wish, place, score = wish[order], place[order], score[order]
        nth = np.arange(len(wish)) - np.searchsorted(wish, wish, "left")
        return wish[nth < k], place[nth < k], score[nth < k]


def fit_centres(sample: np.ndarray, count: int) -> np.ndarray:
    """Centres of a few rounds of k-means."""
    centres = sample[:count].copy()
    for _ in range(5):
        nearest = nearest_centre(sample, centres)[0]
        for k in np.unique(nearest):
            centres[k] = sample[nearest == k].mean(0)
    return centres


def nearest_centre(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centre nearest to each point, and how far it is."""
    points, centres = widened(points, centres)
    near = np.argmin((centres * centres).sum(1) - 2 * points @ centres.T, axis=1)
    return near, np.sqrt(((points - centres[near]) ** 2).sum(1))


def floored(lists: pa.Array, scale: int) -> list[np.ndarray]:
    """The scaled components, rounded down, of every row of a list array."""
    sizes = np.asarray(pc.list_value_length(lists), np.int64)
    flat, ends = np.floor(np.asarray(lists.flatten(), np.float64) * scale), ragged(sizes)
    return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _prepared(rows: DataFrame, vec_id: str, vector: str, label: str, anchors: Column, scale: int) -> DataFrame:
    most = np.finfo(np.float64).max / scale
    whole = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) <= F.lit(float(most)), F.lit(False)) & ~F.isnan(x.cast("double")))
    return (
        rows.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & whole)
        .select(
            F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
            F.coalesce(anchors, F.lit(False)).alias("anchor"), F.col(vector).cast("array<double>").alias("vector"),
        )
        .withColumn("row", F.monotonically_increasing_id())
    )


def _dealt(prepared: DataFrame, scale: int) -> tuple[DataFrame, dict]:
    """All rows, packed, with their cell, as a table; and what is known of the at most ``CELLS`` cells."""
    spark = prepared.sparkSession
    total = prepared.count()
    part_rows = int(min(max(LEAST_ROWS, 16 * total**0.5), MOST_ROWS))
    sample = prepared.orderBy(F.xxhash64("vec_id"), "row").limit(SAMPLE_ROWS).select("vector").toArrow()["vector"]
    points = unpack([v.tobytes() for v in floored(sample.combine_chunks(), scale)], [True] * len(sample))
    centres = fit_centres(points, max(1, min(CELLS, -(-total // part_rows), len(points)))) if len(points) else np.zeros((1, 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = floored(batch.column("vector"), scale)
            packed, wide = pack(vectors)
            cell, distance = nearest_centre(unpack(packed, wide), centres)
            columns = [batch.column(n) for n in ("vec_id", "row", "label", "anchor")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(wide), pa.array(packed, pa.binary()), pa.array(cell.astype(np.int32)), pa.array(distance)],
                ["vec_id", "row", "label", "anchor", "wide", "vector", "cell", "distance"],
            )

    rows = stored(prepared.mapInArrow(tidy(assign), ROWS), "ball-rows")
    found = rows.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("distance").alias("radius"), F.min("label").alias("low"), F.max("label").alias("high")
    ).orderBy("cell").collect()
    cells = [r["cell"] for r in found]
    salts = np.array([-(-r["n"] // part_rows) for r in found], np.int64)
    known = {
        "centres": centres[cells], "radius": np.array([r["radius"] for r in found]),
        "low": np.array([r["low"] for r in found]), "high": np.array([r["high"] for r in found]),
        "first": ragged(salts)[:-1], "salts": salts, "parts": int(salts.sum()),
    }
    table = [(c, int(f), int(s)) for c, f, s in zip(cells, known["first"], salts, strict=True)]
    of_cell = F.broadcast(spark.createDataFrame(table, "cell int, first int, salts int"))  # CELLS rows at most
    part = (F.col("first") + F.pmod(F.xxhash64("row"), F.col("salts"))).cast("int")
    return rows.join(of_cell, "cell").withColumn("part", part), known


def _by_part(sending: DataFrame, parts: int) -> DataFrame:
    tasks = max(parts, partitions(sending.sparkSession))
    return sending.repartition(tasks, "part").sortWithinPartitions("part", "kind", "row")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
    """Stretches of rows of one part and kind, at most a block each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        part, kind = np.asarray(batch.column("part")), np.asarray(batch.column("kind"))
        cuts = np.flatnonzero((np.diff(part) != 0) | (np.diff(kind) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            for c in range(a, b, BLOCK):
                yield int(part[a]), int(kind[a]), pa.Table.from_batches([batch.slice(c, min(BLOCK, b - c))])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[BallTree, pa.Table, bool]]:
    """The tree of every part of a task: first with the part's own rows, then with blocks of queries.

    Only the rows of one part and one block of queries are held at a time.
    """
    runs = _runs(batches)
    held = next(runs, None)
    while held is not None:
        part, rows = held[0], []
        while held is not None and held[:2] == (part, 0):
            rows.append(held[2])
            held = next(runs, None)
        if rows:
            own = pa.concat_tables(rows).combine_chunks()
            rows = []
            vectors = unpack(own["vector"].to_pylist(), own["wide"].to_pylist())
            tree = BallTree(vectors, *(own[n].to_numpy() for n in ("label", "vec_id", "row")))
            yield tree, own, True
        while held is not None and held[:2] == (part, 1):
            yield tree, held[2], False
            held = next(runs, None)


def _marks(found: list[list[int]]) -> pa.Array:
    return pa.array(found, pa.list_(pa.int64()))


def _home(k: int):
    """Every anchor, with the first ``k`` other rows of its label in its own part as marks: row, id, score of each."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, own, _ in _parts(batches):
            asking = own.filter(own["anchor"])
            for a in range(0, asking.num_rows, BLOCK):
                some = asking.slice(a, BLOCK).combine_chunks()
                n = some.num_rows
                vectors = unpack(some["vector"].to_pylist(), some["wide"].to_pylist())
                wish, place, score = tree.search(
                    vectors, np.arange(n), some["label"].to_numpy(), some["row"].to_numpy(),
                    np.full(n, -LONGEST), np.full(n, LONGEST), k, same=True,
                )
                marks: list[list[int]] = [[] for _ in range(n)]
                for w, r, i, x in zip(wish.tolist(), tree.rows[place].tolist(), tree.ids[place].tolist(), score.tolist(), strict=True):
                    marks[w] += [r, i, x]
                yield from some.select(["part", "row", "vec_id", "label", "wide", "vector"]).append_column("marks", _marks(marks)).to_batches()

    return search


def _sent(known: dict, window):
    """Anchors to every part that can hold what they look for, by their cells' balls.

    ``window`` gives least and greatest score of an anchor's marks (None where
    there is nothing to look for) and the marks to send.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                some = batch.slice(a, BLOCK)
                vectors = unpack(some.column("vector").to_pylist(), some.column("wide").to_pylist())
                label = np.asarray(some.column("label"))[:, None]
                asked = [window(marks) for marks in some.column("marks").to_pylist()]
                least = np.array([w[0] if w else np.inf for w in asked], np.float64)[:, None]
                most = np.array([w[1] if w else -np.inf for w in asked], np.float64)[:, None]
                low, high = bounds(vectors, known["centres"], known["radius"])
                wanted = known["wanted"](known["low"], known["high"], label)
                who, cell = np.nonzero((high >= least) & (low <= most) & (least <= most) & wanted)
                salts = known["salts"][cell]
                who = np.repeat(who, salts)
                part = np.repeat(known["first"][cell], salts) + np.arange(len(who)) - np.repeat(ragged(salts)[:-1], salts)
                if known["apart"]:
                    others = part != np.asarray(some.column("part"))[who]
                    who, part = who[others], part[others]
                for b in range(0, len(who), SENT):
                    take = pa.array(who[b : b + SENT])
                    n = len(take)
                    columns = [some.column(c).take(take) for c in ("row", "vec_id", "label", "wide", "vector")]
                    marks = _marks([asked[w][2] for w in take.to_pylist()])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part[b : b + SENT].astype(np.int32)), pa.array(np.ones(n, np.int32)), pa.array(np.zeros(n, bool)), *columns, marks],
                        ["part", "kind", "anchor", "row", "vec_id", "label", "wide", "vector", "marks"],
                    )

    return send


def _same_label(low: np.ndarray, high: np.ndarray, label: np.ndarray) -> np.ndarray:
    return (low <= label) & (label <= high)


def _other_label(low: np.ndarray, high: np.ndarray, label: np.ndarray) -> np.ndarray:
    return (low != high) | (low != label)


def _still_needed(k: int):
    """Positives: scores from the k-th of those found at home."""

    def window(marks: list[int]) -> tuple[int, int, list[int]]:
        least = marks[-1] if len(marks) == 3 * k else -LONGEST
        return least, LONGEST, [least]

    return window


def score_window(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest whole number x with low * score <= 100 * x <= high * score."""
    return max(-LONGEST, -(-low * score // 100)), min(LONGEST, high * score // 100)


def _around(low: int, high: int):
    """Negatives: the windows of all positives that have one."""

    def window(marks: list[int]) -> tuple[int, int, list[int]] | None:
        out, least, most = [], LONGEST, -LONGEST
        for k in range(0, len(marks), 3):
            a, b = score_window(marks[k + 2], low, high)
            if a <= b:
                out += [*marks[k : k + 3], a, b]
                least, most = min(least, a), max(most, b)
        return (least, most, out) if out else None

    return window


FOUND = "anchor_row long, anchor_id long, positive_row long, positive_id long, positive_score long, row long, id long, score long"


def _asked(k: int, same: bool):
    """What a part holds of what is asked there: marks are a least score, or five numbers a window."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, some, own in _parts(batches):
            if own:
                continue
            vectors = unpack(some["vector"].to_pylist(), some["wide"].to_pylist())
            marks = some["marks"].to_pylist()
            wishes = [[0, 0, 0, m[0], LONGEST, w] for w, m in enumerate(marks)] if same else [
                [*m[a : a + 5], w] for w, m in enumerate(marks) for a in range(0, len(m), 5)
            ]
            asked = np.array(wishes, np.int64).reshape(-1, 6)
            who = asked[:, 5]
            row, ids = some["row"].to_numpy(), some["vec_id"].to_numpy()
            wish, place, score = tree.search(
                vectors, who, some["label"].to_numpy()[who], row[who], asked[:, 3], asked[:, 4], k, same
            )
            columns = [row[who[wish]], ids[who[wish]], *asked[wish, :3].T, tree.rows[place], tree.ids[place], score]
            names = [f.split()[0] for f in FOUND.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names)

    return search


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
) -> DataFrame:
    """For every anchor and each of its positives, the hardest rows of other labels.

    Vectors are scaled and rounded down; scores are their inner products. An
    anchor's positives are the first ``positives`` other rows of its label;
    a positive's negatives the first ``negatives`` rows of other labels with
    scores from ``low`` to ``high`` percent of its score. Higher scores come
    first, then smaller ids, then rows as they come. ``anchors`` is a condition
    on the columns of ``rows``.

    A row with a null id, label, vector or component, or a component that is
    not finite (or not when scaled), takes no part. Repeated rows, with equal
    ids too, are rows of their own: one is a positive of the other. Vectors of
    unequal length end in zeros, an empty one has scores of 0. A score beyond a
    long becomes the nearest long. Anchors without a positive, or positives
    without a score window (negative scores) or rows in it, give no row, and
    neither does an empty table. Other columns do not matter.
    """
    prepared = _prepared(rows, vec_id, vector, label, anchors, scale)
    data, known = _dealt(prepared, scale)
    none = F.array().cast("array<long>")
    own = data.select("part", F.lit(0).alias("kind"), "anchor", "row", "vec_id", "label", "wide", "vector", none.alias("marks"))
    home_kind = "part int, row long, vec_id long, label long, wide boolean, vector binary, marks array<long>"
    home = stored(_by_part(own, known["parts"]).mapInArrow(tidy(_home(positives)), home_kind), "ball-home")

    def searched(asking: DataFrame, window, k: int, same: bool) -> DataFrame:
        cells = known | {"wanted": _same_label if same else _other_label, "apart": same}
        sent = asking.mapInArrow(tidy(_sent(cells, window)), SENDING)
        return _by_part(own.unionByName(sent), known["parts"]).mapInArrow(tidy(_asked(k, same)), FOUND)

    def mark(at: Column, field: int, name: str) -> Column:
        return F.col("marks")[at * 3 + field].alias(name)

    nths = F.sequence(F.lit(0), (F.size("marks") / 3).cast("int") - 1)
    triples = F.transform(nths, lambda i: F.struct(mark(i, 0, "row"), mark(i, 1, "id"), mark(i, 2, "score")))
    at_home = home.where(F.size("marks") > 0).select(F.col("row").alias("anchor_row"), F.inline(triples))
    elsewhere = searched(home, _still_needed(positives), positives, True).select("anchor_row", "row", "id", "score")
    order = [F.desc("score"), "id", "row"]
    first = F.row_number().over(Window.partitionBy("anchor_row").orderBy(*order))
    best = at_home.unionByName(elsewhere).withColumn("nth", first).where(F.col("nth") <= positives)
    marks = best.groupBy("anchor_row").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("nth", "row", "id", "score"))), lambda x: F.array(x["row"], x["id"], x["score"]))).alias("marks")
    )
    asking = home.drop("marks").join(marks.withColumnRenamed("anchor_row", "row"), "row")
    asking = asking.select("part", "row", "vec_id", "label", "wide", "vector", "marks")
    found = searched(asking, _around(low, high), negatives, False)
    rank = F.row_number().over(Window.partitionBy("anchor_row", "positive_row").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
