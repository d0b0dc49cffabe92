"""Hard negatives by k-means inverted lists with stored radii.

Rows are dealt to the nearest of the centroids that k-means fits to a bounded
sample; every row is indexed. Rows in the order of centroid, label and distance
are cut into shards of about the same size and, within them, into lists that
carry their centroid and the largest distance of a member, the radius. By
Cauchy-Schwarz an anchor ``a`` scores at most ``a.c + |a| r`` and at least
``a.c - |a| r`` in a list. Each shard visits its lists in falling order of that
upper bound, skips those outside the anchor's window of scores, and stops when
the bound falls strictly below the k-th score found; so results are exact.

Anchors meet the shard of their own list first; only the shards whose bound
reaches the k-th score of that visit are asked for the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiresmith.llm.common import rows_of, streamed
from quiresmith.llm.topk import best_places, products, whole_numbers
from quiresmith.session import discard, materialize

#: Rows that k-means is fitted to, about; centroids at most; rounds of the fit.
SAMPLE_ROWS, CENTROIDS, FIT_ROUNDS = 16_384, 1024, 8
#: Rows of a shard, about, and of a list at most; labels change within a list of fewer rows than the last.
SHARD_ROWS, LIST_ROWS, LABEL_ROWS = 65_536, 2048, 256
#: Anchors that are scored together.
ANCHOR_ROWS = 128
_NONE = np.iinfo(np.int64).min
_MATRIX = "<f8"

_LIST = "dim int, cluster int, first_label long, last_label long, radius double, ids binary, uids binary, labels binary, mat binary"
_ANCHOR = "uid long, vec_id long, label long, dim int, mat binary"


def fit_centroids(points: np.ndarray, k: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """k-means by Lloyd's rounds from every (n/k)-th point; a centroid without points stays."""
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(points, centres)[0]
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, points)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each point's nearest centroid and the distance to it."""
    with np.errstate(all="ignore"):
        place = np.argmin((centres**2).sum(1) / 2 - points @ centres.T, axis=1)
        return place, np.sqrt(((points - centres[place]) ** 2).sum(1))


def bounds(anchors: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most that any member of a list can score with an anchor, with room for rounding."""
    with np.errstate(all="ignore"):
        norm, middle = np.sqrt((anchors**2).sum(1))[:, None], anchors @ centres.T
        far = norm * (radius + 1e-9 * (radius + np.sqrt((centres**2).sum(1)))) + 1e-6
        return np.nan_to_num(middle - far, nan=-np.inf), np.nan_to_num(middle + far, nan=np.inf)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // len(column))


def _centres_of(sample: pa.Table, n: int) -> dict[int, np.ndarray]:
    """Centroids of every dimension that the sample has, by the sample's share of it."""
    found, dims = {}, sample.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        points = np.array(sample.filter(pa.array(dims == dim)).column("v").to_pylist(), float)
        k = max(1, min(CENTROIDS, len(points), round((n * len(points) / len(dims)) ** 0.5)))
        found[dim] = fit_centroids(points, k) if dim else np.zeros((1, 0))
    return found


def _assigned(centres: dict[int, np.ndarray]):
    """Kernel over rows: adds centroid and distance; a dimension that the sample has not has the origin for its centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 1024):
            dims, vectors = batch.column("dim").to_numpy(), batch.column("v")
            cluster, distance = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.nonzero(dims == dim)[0]
                points = _matrix(vectors.take(pa.array(at)))
                cluster[at], distance[at] = nearest(points, centres.get(int(dim), np.zeros((1, dim))))
            yield pa.record_batch([*batch.columns, pa.array(cluster), pa.array(np.nan_to_num(distance, nan=np.inf))], [*batch.schema.names, "cluster", "distance"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel over rows in order of dimension, centroid, label and distance: the partition's lists, as ``_LIST`` with their shard."""
    shard, held = TaskContext.get().partitionId(), []

    def done() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).sort_by([("vec_id", "ascending"), ("uid", "ascending")])  # ties are then by place
        held.clear()
        label, first = rows.column("label").to_numpy(), rows.slice(0, 1).to_pylist()[0]
        flat = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        values = {
            "shard": [shard], "dim": [first["dim"]], "cluster": [first["cluster"]], "first_label": [label.min()], "last_label": [label.max()], "radius": [rows.column("distance").to_numpy().max()],
            "ids": [rows.column("vec_id").to_numpy().astype("<i8").tobytes()], "uids": [rows.column("uid").to_numpy().astype("<i8").tobytes()], "labels": [label.astype("<i8").tobytes()], "mat": [flat.astype(_MATRIX).tobytes()],
        }
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), *[pa.binary()] * 4]
        return pa.record_batch([pa.array(x, t) for x, t in zip(values.values(), kinds)], list(values))

    size, last = 0, None
    for batch in batches:
        dim, cluster, label = (batch.column(c).to_numpy() for c in ("dim", "cluster", "label"))
        at = 0
        while at < batch.num_rows:
            list_of, here = (dim[at], cluster[at]), (dim[at:] == dim[at]) & (cluster[at:] == cluster[at]) & (label[at:] == label[at])
            run = len(here) if here.all() else int(np.argmin(here))  # rows of one centroid and label
            if held and (last[0] != list_of or size >= LIST_ROWS or (last[1] != label[at] and size >= LABEL_ROWS)):
                yield done()
                size = 0
            run = min(run, LIST_ROWS - size)
            held.append(batch.slice(at, run))
            size, last, at = size + run, (list_of, label[at]), at + run
    if held:
        yield done()


def _routed(centres: dict[int, np.ndarray], entries: list, wanted: Callable[[dict, np.ndarray, np.ndarray, dict], np.ndarray]):
    """Kernel over anchors: adds the shards that ``wanted`` takes, given the bounds of each shard's part of each centroid.

    There are no more entries than shards and centroids together.
    """
    by_dim: dict[int, dict[str, np.ndarray]] = {}
    for dim in {e["dim"] for e in entries}:
        mine = [e for e in entries if e["dim"] == dim]
        by_dim[dim] = {c: np.array([e[c] for e in mine]) for c in ("shard", "first_label", "last_label", "radius")}
        by_dim[dim]["centre"] = np.array([centres[dim][e["cluster"]] if dim in centres else np.zeros(dim) for e in mine]).reshape(len(mine), dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 64):
            out = []
            for row in batch.to_pylist():
                e = by_dim[row["dim"]]
                least, most = bounds(np.frombuffer(row["mat"], _MATRIX)[None], e["centre"], e["radius"])
                out.append(np.unique(e["shard"][wanted(row, least[0], most[0], e)]).tolist())
            yield pa.record_batch([*batch.columns, pa.array(out, pa.list_(pa.int32()))], [*batch.schema.names, "shards"])

    return run


class _Lists:
    """The lists of one shard and dimension."""

    def __init__(self, rows: list[dict], dim: int, centres: np.ndarray):
        self.matrix = [np.frombuffer(r["mat"], _MATRIX).reshape(len(r["ids"]) // 8, dim) for r in rows]
        self.ids, self.uids, self.labels = ([np.frombuffer(r[c], "<i8") for r in rows] for c in ("ids", "uids", "labels"))
        self.centre, self.radius = np.array([centres[r["cluster"]] for r in rows]), np.array([r["radius"] for r in rows])
        self.first, self.last = (np.array([r[c] for r in rows]) for c in ("first_label", "last_label"))


def _search(bound: np.ndarray, k: int, score: Callable[[int, np.ndarray], np.ndarray], ids: list[np.ndarray], uids: list[np.ndarray], floor: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each seeker's k best (score, id, uid) over lists, for its bounds by list; -inf is a list to skip.

    Lists are visited in falling order of bound, 1, 2, 4 ... a round, until
    the bound is strictly below the k-th score, or ``floor`` where that is more.
    ``score(l, seekers)`` has a row for each seeker and ``_NONE`` for rows that do not count.
    """
    n = len(bound)
    top = np.full((3, n, k), _NONE, np.int64)
    order = np.argsort(-bound, axis=1, kind="stable")
    at, step = 0, 1
    while at < bound.shape[1]:
        turn = order[:, at : at + step]
        reached = np.take_along_axis(bound, turn, 1)
        bar = np.maximum(top[0].min(1), floor)[:, None]
        seeker, place = np.nonzero((reached > -np.inf) & (reached >= bar))
        if not len(seeker):
            break
        visited = turn[seeker, place]
        for at_list in np.unique(visited):
            rows = seeker[visited == at_list]
            scores = score(at_list, rows)
            i, j = best_places(scores, k)
            found = scores[i, j] > _NONE
            i, j = i[found], j[found]
            new = (rows[i], scores[i, j], ids[at_list][j], uids[at_list][j])
            old_at, old_k = np.nonzero(top[0][rows] > _NONE)
            old = (rows[old_at], *(top[x][rows[old_at], old_k] for x in range(3)))
            who, s, d, u = (np.concatenate(x) for x in zip(new, old))
            rank_by = np.lexsort((u, d, ~s, who))  # ~s falls as s rises, without overflow
            who, s, d, u = who[rank_by], s[rank_by], d[rank_by], u[rank_by]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            keep = rank < k
            top[:, who[keep], rank[keep]] = s[keep], d[keep], u[keep]
        at, step = at + step, step * 2
    i, j = np.nonzero(top[0] > _NONE)
    return i, *(top[x][i, j] for x in range(3))


def _in_shards(centres: dict[int, np.ndarray], answer: Callable[[_Lists, pa.Table], Iterator[dict[str, np.ndarray]]], schema: pa.Schema):
    """Kernel over a shard's lists, which come first, and its anchors, which are answered a few at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows, lists = None, [], {}
        for batch in rows_of(batches, ANCHOR_ROWS):
            of, kind = (batch.column(c).to_numpy() for c in ("shard", "kind"))
            for here in np.unique(of):
                if here != shard:
                    shard, rows, lists = here, [], {}
                rows += batch.filter(pa.array((of == here) & (kind == 0))).select(["dim", "cluster", "first_label", "last_label", "radius", "ids", "uids", "labels", "mat"]).to_pylist()
                asked = batch.filter(pa.array((of == here) & (kind == 1)))
                if not asked.num_rows:
                    continue
                if rows:
                    for dim in {r["dim"] for r in rows}:
                        lists[dim] = _Lists([r for r in rows if r["dim"] == dim], dim, centres.get(dim, np.zeros((1, dim))))
                    rows = []
                dims = asked.column("dim").to_numpy()
                for dim in np.unique(dims).tolist():
                    if dim in lists:
                        found = answer(lists[dim], asked.filter(pa.array(dims == dim)))
                        yield pa.record_batch([pa.array(found[f.name], f.type) for f in schema], schema=schema)

    return run


_FOUND = pa.schema([("uid", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("other", pa.int64()), ("score", pa.int64())])
_FOUND_SQL = "uid long, place int, id long, other long, score long"


def _positives(k: int):
    """The k best rows of an anchor's label in a shard, but itself."""

    def answer(lists: _Lists, asked: pa.RecordBatch) -> dict[str, np.ndarray]:
        uid, label = asked.column("uid").to_numpy(), asked.column("label").to_numpy()
        a = np.array([np.frombuffer(x.as_py(), _MATRIX) for x in asked.column("mat")])
        _, most = bounds(a, lists.centre, lists.radius)
        bound = np.where((lists.first <= label[:, None]) & (label[:, None] <= lists.last), most, -np.inf)

        def score(at: int, rows: np.ndarray) -> np.ndarray:
            mine = (lists.labels[at] == label[rows, None]) & (lists.uids[at] != uid[rows, None])
            return np.where(mine, products(a[rows], lists.matrix[at]), _NONE)

        floor = asked.column("bar").fill_null(_NONE).to_numpy(zero_copy_only=False)
        i, s, d, u = _search(bound, k, score, lists.ids, lists.uids, floor)
        return {"uid": uid[i], "place": np.zeros(len(i), np.int32), "id": d, "other": u, "score": s}

    return answer


def _negatives(k: int):
    """For each of an anchor's windows the k best rows of other labels within it in a shard."""

    def answer(lists: _Lists, asked: pa.RecordBatch) -> dict[str, np.ndarray]:
        uid, label = asked.column("uid").to_numpy(), asked.column("label").to_numpy()
        a = np.array([np.frombuffer(x.as_py(), _MATRIX) for x in asked.column("mat")])
        asks = [(k, x["place"], x["low"], x["high"]) for k, row in enumerate(asked.column("asks").to_pylist()) for x in row]
        of, place, low, high = (np.array(x, np.int64) for x in zip(*asks))
        least, most = bounds(a, lists.centre, lists.radius)
        other = (lists.first != lists.last) | (lists.first != label[:, None])
        bound = np.where(other[of] & (most[of] >= low[:, None]) & (least[of] <= high[:, None]), np.minimum(most[of], high[:, None]), -np.inf)

        def score(at: int, rows: np.ndarray) -> np.ndarray:
            who, back = np.unique(of[rows], return_inverse=True)
            s = np.where(lists.labels[at] != label[who, None], products(a[who], lists.matrix[at]), _NONE)[back]
            return np.where((s >= low[rows, None]) & (s <= high[rows, None]), s, _NONE)

        i, s, d, u = _search(bound, k, score, lists.ids, lists.uids, np.full(len(of), _NONE))
        return {"uid": uid[of[i]], "place": place[i].astype(np.int32), "id": d, "other": u, "score": s}

    return answer


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_of(batches, 1024):
        mat = [np.array(x, _MATRIX).tobytes() for x in batch.column("v").to_pylist()]
        yield pa.record_batch([*(batch.column(c) for c in ("uid", "vec_id", "label", "dim")), pa.array(mat, pa.binary())], ["uid", "vec_id", "label", "dim", "mat"])


def _of_label(row: dict, e: dict) -> np.ndarray:
    return (e["first_label"] <= row["label"]) & (row["label"] <= e["last_label"])


def _home(row: dict, least: np.ndarray, most: np.ndarray, e: dict) -> np.ndarray:
    """The one part with the anchor's label and the highest bound."""
    return np.argmax(np.where(_of_label(row, e), most, -np.inf))[None]


def _reached(row: dict, least: np.ndarray, most: np.ndarray, e: dict) -> np.ndarray:
    """Parts with the anchor's label whose bound reaches its bar, but those of the shard that it has met."""
    return _of_label(row, e) & (most >= (_NONE if row["bar"] is None else row["bar"])) & (e["shard"] != row["shards"][0])


def _overlapping(row: dict, least: np.ndarray, most: np.ndarray, e: dict) -> np.ndarray:
    """Parts with other labels that a window of the anchor overlaps."""
    some = np.zeros(len(least), bool)
    for x in row["asks"]:
        some |= (most >= x["low"]) & (least <= x["high"])
    return some & ((e["first_label"] != e["last_label"]) | (e["first_label"] != row["label"]))


def _first(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id", "other")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for vectors(vec_id, embedding, label).

    Components become floor(scale * x); a score is the inner product of these
    whole numbers. ``is_anchor`` is a condition on vec_id. An anchor's
    positives are its first other rows of the same label; for each, the first
    rows of other labels follow that score from ``low`` to ``high`` percent of
    it. Higher scores come first, then smaller ids; labels are whole numbers.
    Rows with a null id, label or vector, or a null or non-finite component,
    take no part; rows that repeat an id are rows of their own, as anchors and
    as partners, and the one with an equal vector is no anchor's own row.
    Vectors of another dimension do not meet, empty ones score 0. Scores
    beyond the range of a long are held at its ends. A positive without such
    negatives, an anchor without positives and an empty table give no rows.
    Results are exact: whatever the centroids, no list is left out that a
    bound does not rule out.
    """
    sound = whole_numbers(vectors, scale, "label").where(F.col("label").isNotNull())
    whole = sound.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.size("v").alias("dim"), "v")
    rows = materialize(whole, "negatives-rows", F.count(F.lit(1)).alias("n"))
    n = rows.facts["n"]
    # By number of the row, not by its values: every row may be in the sample, and about SAMPLE_ROWS are.
    sample = rows.where(F.pmod(F.xxhash64("uid"), F.lit(max(1, -(-n // SAMPLE_ROWS)))) == 0).select("dim", "v").toArrow()
    centres = _centres_of(sample, n) if sample.num_rows else {}

    shards = max(1, -(-n // SHARD_ROWS), min(32, -(-n // 1024)))
    order = ["dim", "cluster", "label", "distance", "vec_id", "uid"]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", cluster int, distance double"
    near = rows.mapInArrow(_assigned(centres), kind).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    lists = materialize(near.mapInArrow(_packed, "shard int, " + _LIST), "negatives-lists")
    parts = lists.groupBy("shard", "dim", "cluster").agg(F.max("radius").alias("radius"), F.min("first_label").alias("first_label"), F.max("last_label").alias("last_label"))
    entries = [r.asDict() for r in parts.collect()]
    shards = 1 + max([r["shard"] for r in entries], default=0)

    def routed(asked: DataFrame, wanted: Callable) -> DataFrame:
        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema)
        return asked.mapInArrow(_routed(centres, entries, wanted), kind + ", shards array<int>")

    def found(asked: DataFrame, answer: Callable) -> DataFrame:
        sent = asked.withColumn("shard", F.explode("shards")).drop("shards")
        return streamed(lists, sent, shards).mapInArrow(_in_shards(centres, answer, _FOUND), _FOUND_SQL)

    anchors = rows.where(is_anchor).mapInArrow(_as_bytes, _ANCHOR)
    at_home = routed(anchors, _home)
    met = materialize(_first(found(at_home.withColumn("bar", F.lit(None).cast("long")), _positives(positives)), ["uid"], positives).drop("rank"), "negatives-met")
    bars = met.groupBy("uid").agg(F.when(F.count(F.lit(1)) >= positives, F.min("score")).alias("bar"))
    again = routed(at_home.join(bars, "uid", "left").withColumnRenamed("shards", "met"), lambda row, *x: _reached(row | {"shards": row["met"]}, *x))
    all_met = met.unionByName(found(again.drop("met"), _positives(positives)))
    pairs = materialize(_first(all_met, ["uid"], positives).select("uid", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-pairs")

    # low * score <= 100 * other <= high * score, by hundreds and the rest, so that nothing overflows.
    hundreds, rest = F.expr("(positive_score - pmod(positive_score, 100L)) div 100L"), F.pmod("positive_score", F.lit(100))
    least, most = hundreds * low + F.ceil(rest * low / 100).cast("long"), hundreds * high + F.floor(rest * high / 100).cast("long")
    asks = pairs.select("uid", F.struct("place", least.alias("low"), most.alias("high")).alias("ask")).where("ask.low <= ask.high").groupBy("uid").agg(F.collect_list("ask").alias("asks"))
    hits = _first(found(routed(anchors.join(asks, "uid"), _overlapping), _negatives(negatives)), ["uid", "place"], negatives)
    named = hits.join(pairs, ["uid", "place"]).join(anchors.select("uid", F.col("vec_id").alias("anchor_id")), "uid")
    out = materialize(named.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    discard(rows, lists, met, pairs)
    return out
