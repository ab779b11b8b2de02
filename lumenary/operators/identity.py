"""Face clusters and persons: matching, forming, folding, correcting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lumenary.functions import blockmatch as bm
from lumenary.functions.blockmatch import Side
from lumenary.functions.text import distinct_names, empty_strings, normalize_name
from lumenary.functions.vector import dense, l2_normalize, mean_vector
from lumenary.session import cut_lineage, spread_groups

# Default thresholds and the weights of the person score.
FACE_DIM = 512
CLUSTER_THRESHOLD = 0.5
PERSON_THRESHOLD = 0.52
PERSON_MARGIN = 0.04
BEST_WEIGHT, MEAN_WEIGHT, CENTROID_WEIGHT = 0.45, 0.35, 0.2
TOP_SAMPLES = 3
#: Samples a person, from which each person's are searched by themselves.
LONG_SEGMENT = 16
#: Similarity cells held at once while persons are ranked; three of each person's are kept besides.
RANK_CELLS = 1_000_000
#: Rows of a tile: faces that stay while vectors pass by, and vectors that pass one tile of faces in a task.
TILE_ROWS, SLICE_ROWS = 16_384, 65_536
#: Vectors up to this length; tiles of longer ones hold fewer rows.
DIM_OF_TILES = 64
#: Vectors scored at a time, and tasks that tiles are dealt to, at most.
RANK_BLOCK, MOST_TASKS = 1_024, 4_096
#: Hex digits of a new label.
LABEL_DIGITS = 32
#: Faces of a cluster that are folded into its centroid at a time.
FOLD_WINDOW = 128


def has_dim(vector: str, dim: int) -> Column:
    return F.coalesce(F.size(vector) == dim, F.lit(False))


# --- scores ---------------------------------------------------------------------------------------


def assign_clusters(
    faces: DataFrame, clusters: DataFrame, thr: float = CLUSTER_THRESHOLD, dim: int = FACE_DIM, **sizes
) -> DataFrame:
    """Best cluster per face with cosine >= thr: (face_id, label, score)."""
    hits = bm.nearest(
        Side(faces, "face_id", "embedding"),
        Side(clusters, "label", "centroid", "updated_at"),
        dim=dim, k=1, floor=thr, **sizes,
    )
    return hits.select("face_id", F.col("match_label").alias("label"), "score")


def _person_vectors(persons: DataFrame, samples: DataFrame, dim: int) -> DataFrame:
    """One row per usable vector of a person: the centroid and every sample."""
    profile = persons.select(F.col("id").alias("rkey"), F.col("updated_at").cast("double").alias("rtie"))
    centroid = persons.filter(has_dim("centroid", dim)).select(
        F.col("id").alias("rkey"),
        F.col("updated_at").cast("double").alias("rtie"),
        F.lit(True).alias("central"),
        F.col("centroid").cast("array<double>").alias("rvec"),
    )
    sample = (
        samples.filter(has_dim("embedding", dim))
        .select(F.col("person_id").alias("rkey"), F.col("embedding").cast("array<double>").alias("rvec"))
        .join(profile, "rkey")
        .select("rkey", "rtie", F.lit(False).alias("central"), "rvec")
    )
    return centroid.unionByName(sample)


class _Gallery:
    """The vectors of some persons, laid out for segment-wise maxima."""

    def __init__(self, keys, ties, central, vectors, dim: int) -> None:
        keys, ties = bm.keys_of(keys), bm.keys_of(ties)
        central = bm.keys_of(central).astype(bool)
        matrix, _ = bm.matrix_of(vectors, dim)
        unit = bm.unit_rows(matrix)
        self.keys, first = np.unique(keys, return_index=True)
        self.ties = ties[first]
        home = np.searchsorted(self.keys, keys)
        self.centroids = np.zeros((len(self.keys), dim))
        self.centroids[home[central]] = unit[central]
        order = np.argsort(home[~central], kind="stable")
        self.samples = unit[~central][order]
        self.owner = home[~central][order]
        self.with_samples, self.starts, self.sizes = np.unique(
            self.owner, return_index=True, return_counts=True
        )
        self.segment = np.repeat(np.arange(len(self.starts)), self.sizes)

    def __len__(self) -> int:
        return len(self.keys)

    def tops(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid cosines, and the best three sample cosines per person (-inf where missing)."""
        central = unit @ self.centroids.T
        best = np.full((TOP_SAMPLES, len(unit), len(self.keys)), -np.inf)
        if len(self.samples):
            left = unit @ self.samples.T
            if self.sizes.mean() >= LONG_SEGMENT:
                for person, start, size in zip(self.with_samples, self.starts, self.sizes):
                    some = left[:, start : start + size]
                    if size > TOP_SAMPLES:
                        some = np.partition(some, size - TOP_SAMPLES, axis=1)[:, -TOP_SAMPLES:]
                    best[: some.shape[1], :, person] = np.sort(some, axis=1)[:, ::-1].T
                return central, best
            column = np.arange(left.shape[1])
            rows = np.arange(len(unit))[:, None]
            for i in range(TOP_SAMPLES):
                top = np.maximum.reduceat(left, self.starts, axis=1)
                best[i][:, self.with_samples] = top
                at = np.where(left == top[:, self.segment], column, left.shape[1])
                first = np.minimum.reduceat(at, self.starts, axis=1)
                left[rows, np.minimum(first, left.shape[1] - 1)] = -np.inf
        return central, best


def _blend(central: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Person score from a centroid cosine and the top sample cosines (first axis, best first)."""
    found = np.isfinite(best)
    count = found.sum(axis=0)
    mean = np.where(found, best, 0.0).sum(axis=0) / np.maximum(count, 1)
    first = np.where(found[0], best[0], 0.0)
    mixed = BEST_WEIGHT * first + MEAN_WEIGHT * mean + CENTROID_WEIGHT * central
    return np.round(np.where(count > 0, np.maximum(central, mixed), central), 6)


_PERSON_HIT = "rkey {r}, score double, rtie double, watched boolean"


def _ranked(keys, unit: np.ndarray, want: np.ndarray, gallery: _Gallery, k: int) -> Iterator[pd.DataFrame]:
    """Rows of the persons asked for, and of the k best; a part of the faces at a time."""
    step = max(1, RANK_CELLS // max(1, len(gallery.samples) + len(gallery)))
    for start in range(0, len(keys) if len(gallery) else 0, step):
        part = slice(start, start + step)
        yield from _winners(keys[part], _blend(*gallery.tops(unit[part])), want[part], gallery.keys, gallery.ties, k)


def _winners(keys, scores: np.ndarray, want: np.ndarray, persons, ties, k: int) -> Iterator[pd.DataFrame]:
    at = np.minimum(np.searchsorted(persons, want), len(persons) - 1)
    rows = np.nonzero(persons[at] == want)[0]
    yield pd.DataFrame({"lkey": keys[rows], "rkey": persons[at[rows]], "score": scores[rows, at[rows]], "rtie": ties[at[rows]], "watched": True})
    yield bm.winners(keys, np.where(scores > 0, scores, -np.inf), persons, ties, k).assign(watched=False)


def rank_persons(
    faces: Side,
    persons: DataFrame,
    samples: DataFrame,
    k: int = 5,
    dim: int = FACE_DIM,
    watch: str | None = None,
    broadcast_rows: int = bm.BROADCAST_ROWS,
    block_rows: int = bm.BLOCK_ROWS,
    tile_rows: int = TILE_ROWS,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """(key, person_id, score, rank): the k best persons with a positive score per face.

    With `watch` (a column holding a person id) each face also gets that person's score whatever it
    is, in a row with rank null. Few vectors go to every executor. More are scored `block_rows` at a time
    while they pass tiles of faces (`_rank_in_tiles`).
    """
    ltype = dict(faces.df.dtypes)[faces.key]
    rtype = dict(persons.dtypes)["id"]
    watched = F.col(watch).cast("double") if watch else F.lit(None).cast("double")
    left = faces.df.select(
        F.col(faces.key).alias("lkey"), F.col(faces.vector).cast("array<double>").alias("lvec"), watched.alias("want")
    )
    right = _person_vectors(persons, samples, dim)

    small = bm.fetch_if_small(right, broadcast_rows, dim)
    if small is not None:
        shared = left.sparkSession.sparkContext.broadcast(small)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            r = shared.value
            gallery = _Gallery(r["rkey"], r["rtie"], r["central"], r["rvec"], dim)
            for batch in batches:
                matrix, ok = bm.matrix_of(batch["lvec"], dim)
                keys, want = batch["lkey"].to_numpy()[ok], batch["want"].to_numpy(dtype=float)[ok]
                yield from _ranked(keys, bm.unit_rows(matrix[ok]), want, gallery, k)

        hits = left.mapInPandas(scan, f"lkey {ltype}, " + _PERSON_HIT.format(r=rtype))
    else:
        hits = _rank_in_tiles(left, right, k, ltype, rtype, dim, block_rows, tile_rows, slice_rows)

    order = W.partitionBy("lkey").orderBy(F.desc("score"), F.desc("rtie"), F.desc("rkey"))
    out = hits.filter("not watched").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    if watch:
        out = out.unionByName(hits.filter("watched").withColumn("rank", F.lit(None).cast("int")))
    return out.select(F.col("lkey").alias(faces.key), F.col("rkey").alias("person_id"), "score", "rank")


class _Tile:
    """Faces of a tile, and the person whose vectors are passing: its cosines so far."""

    def __init__(self, k: int, dim: int, block: int) -> None:
        self.k, self.dim, self.block = k, dim, block
        self.parts, self.wants, self.units, self.found, self.held = [], [], [], [], 0
        self.keys = self.person = None

    def face(self, rows: pa.RecordBatch) -> None:
        matrix, ok = dense(rows.column("vec"), self.dim)
        self.parts.append(rows.column("lkey").filter(pa.array(ok)))
        self.wants.append(rows.column("want").filter(pa.array(ok)).to_numpy(zero_copy_only=False))
        self.units.append(bm.unit_rows(matrix[ok]))

    def vectors(self, rows: pa.RecordBatch) -> Iterator[dict]:
        """Vectors in the order of their persons; yields the rows of persons that are through."""
        if self.keys is None:
            if not self.parts:
                return
            self.keys, self.want, self.unit = pa.concat_arrays(self.parts), np.concatenate(self.wants).astype(float), np.concatenate(self.units)
            self.places = np.arange(len(self.keys))
        whole = np.asarray(rows.column("whole"))
        for start in range(0, len(whole), self.block):
            part = rows.slice(start, self.block)
            # a person in pieces stands apart from those that are whole here
            cut = np.flatnonzero(np.diff(whole[start : start + self.block])) + 1
            for lo, hi in zip([0, *cut], [*cut, len(part)]):
                yield from self._score(part.slice(lo, hi - lo), bool(whole[start + lo]))

    def _score(self, rows: pa.RecordBatch, whole: bool) -> Iterator[dict]:
        gallery = _Gallery(*[rows.column(c) for c in ("rkey", "rtie", "central", "vec")], self.dim)
        n, last = len(self.keys), len(gallery) - 1
        same = self.person is not None and self.whole == whole and self.person == gallery.keys[0]
        if self.person is not None and not same:
            yield from self.through()
        central, best = (self.central, self.best) if same else (np.zeros(n), np.full((TOP_SAMPLES, n), -np.inf))
        step = max(1, RANK_CELLS // (len(gallery.samples) + len(gallery)))
        for start in range(0, n, step):
            part = slice(start, start + step)
            c, b = gallery.tops(self.unit[part])
            c[:, 0] += central[part]
            b[:, :, 0] = np.sort(np.concatenate([b[:, :, 0], best[:, part]]), axis=0)[::-1][:TOP_SAMPLES]
            yield from self._emit(self.places[part], c[:, :last], b[:, :, :last], gallery.keys[:last], gallery.ties[:last], whole)
            central[part], best[:, part] = c[:, last], b[:, :, last]
        self.person, self.tie, self.whole, self.central, self.best = gallery.keys[last], gallery.ties[last], whole, central, best

    def through(self) -> Iterator[dict]:
        """Rows of the last person."""
        if self.person is not None:
            yield from self._emit(self.places, self.central[:, None], self.best[:, :, None], np.array([self.person]), np.array([self.tie]), self.whole)
            self.person = None

    def finish(self) -> Iterator[dict]:
        yield from self.through()
        if self.held:
            self._cut()
            yield self._rows(self.found[0])

    def _cut(self) -> None:
        """Keep the k best found so far of each face."""
        found = pd.concat([f for f in self.found if len(f)])
        person = np.unique(found["rkey"].to_numpy(), return_inverse=True)[1]
        place = found["lkey"].to_numpy()
        order = np.lexsort((-person, -found["rtie"].to_numpy(), -found["score"].to_numpy(), place))
        place = place[order]
        rank = np.arange(len(place)) - np.searchsorted(place, place, side="left")
        self.found = [found.iloc[order[rank < self.k]]]
        self.held = len(self.found[0])

    def _rows(self, found: pd.DataFrame) -> dict:
        keys = self.keys.take(pa.array(found["lkey"].to_numpy(dtype=np.int64)))
        return {"lkey": keys, **{c: found[c].to_numpy() for c in ("rkey", "rtie", "score", "watched")}}

    def _emit(self, places, central, best, persons, ties, whole: bool) -> Iterator[dict]:
        if not len(persons):
            return
        if whole:
            asked, ranked = _winners(places, _blend(central, best), self.want[places], persons, ties, self.k)
            if len(asked):
                yield self._rows(asked)
            self.found.append(ranked)
            self.held += len(ranked)
            if self.held > 8 * self.k * len(self.keys):
                self._cut()
            return
        for i, person in enumerate(persons):
            tops = {f"top{t}": best[t, :, i] for t in range(TOP_SAMPLES)}
            yield {"lkey": self.keys.take(pa.array(places)), "rkey": np.full(len(places), person), "rtie": np.full(len(places), ties[i]), "central": central[:, i], "want": self.want[places], **tops}


def _rank_in_tiles(
    left: DataFrame, right: DataFrame, k: int, ltype: str, rtype: str, dim: int, block_rows: int, tile_rows: int, slice_rows: int
) -> DataFrame:
    """Both sides too large to ship: a task holds one tile of faces, past which a slice of the vectors streams.

    Vectors come in the order of their persons, so a person's best three cosines are kept while it passes and
    its score is known when it is through. A person with more vectors than a slice is cut in pieces, which may
    lie in several slices; those give partials (three best cosines), one for each face and slice.
    What is sent are the faces once for each slice and the vectors once for each tile, however small the blocks are.
    """
    held = right.groupBy("rkey").agg(F.count(F.lit(1)).alias("held"))
    total, most = held.agg(F.coalesce(F.sum("held"), F.lit(0)), F.coalesce(F.max("held"), F.lit(0))).first()
    if dim > DIM_OF_TILES:
        tile_rows, slice_rows = -(-tile_rows * DIM_OF_TILES // dim), -(-slice_rows * DIM_OF_TILES // dim)
    tiles, slices = max(1, -(-left.count() // tile_rows)), max(1, -(-total // slice_rows))
    split = most > slice_rows
    if split:
        sized = right.join(held, "rkey").withColumn("whole", F.col("held") <= slice_rows)
        pieces = F.ceil(F.col("held") / slice_rows)
        right = sized.withColumn("piece", F.when(F.col("whole"), F.lit(0)).otherwise(F.pmod(F.xxhash64("rvec"), pieces)))
    else:
        right = right.withColumn("whole", F.lit(True)).withColumn("piece", F.lit(0).cast("long"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    no = lambda kind: F.lit(None).cast(kind)
    at = F.col("tile").cast("long") * slices + F.col("slice")
    a = left.withColumn("tile", F.pmod(F.xxhash64("lkey"), F.lit(tiles))).withColumn("slice", every(slices)).select(
        at.alias("cell"), F.lit(0).alias("side"), no("boolean").alias("whole"), "lkey", "want", no(rtype).alias("rkey"),
        no("double").alias("rtie"), no("boolean").alias("central"), F.col("lvec").alias("vec"),
    )
    b = right.withColumn("slice", F.pmod(F.xxhash64("rkey", "piece"), F.lit(slices))).withColumn("tile", every(tiles)).select(
        at.alias("cell"), F.lit(1).alias("side"), "whole", no(ltype).alias("lkey"), no("double").alias("want"), "rkey",
        "rtie", "central", F.col("rvec").alias("vec"),
    )
    tops_of = [f"top{i}" for i in range(TOP_SAMPLES)]
    kinds = f"lkey {ltype}, rkey {rtype}, rtie double, score double, watched boolean, central double, want double, " + ", ".join(f"{c} double" for c in tops_of)
    block = min(block_rows, RANK_BLOCK)
    made = StructType.fromDDL(kinds)
    names, types = made.names, to_arrow_schema(made).types

    def packed(rows: dict) -> pa.RecordBatch:
        n = len(rows["lkey"])
        columns = [pa.array(rows[c], type=t) if c in rows else pa.nulls(n, t) for c, t in zip(names, types)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, current = None, None
        for batch in batches:
            cells, sides = np.asarray(batch.column("cell")), np.asarray(batch.column("side"))
            cut = np.flatnonzero(np.diff(cells) | np.diff(sides)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(cells)]):
                if cells[lo] != current:
                    if tile is not None:
                        yield from map(packed, tile.finish())
                    tile, current = _Tile(k, dim, block), cells[lo]
                if sides[lo] == 0:
                    tile.face(batch.slice(lo, hi - lo))
                else:
                    yield from map(packed, tile.vectors(batch.slice(lo, hi - lo)))
        if tile is not None:
            yield from map(packed, tile.finish())

    parts = min(tiles * slices, MOST_TASKS)
    met = a.unionByName(b).repartitionById(parts, F.pmod("cell", F.lit(parts)).cast("int")).sortWithinPartitions("cell", "side", "whole", "rkey")
    rows = met.mapInArrow(scan, made)
    cols = ["lkey", "rkey", "score", "rtie", "watched"]
    if not split:
        return rows.select(cols)
    rows = cut_lineage(rows)
    partial = rows.filter("score is null").withColumn("tops", F.filter(F.array(*tops_of), lambda x: x > float("-inf")))
    merged = partial.groupBy("lkey", "rkey").agg(
        F.max("rtie").alias("rtie"),
        F.max("want").alias("want"),
        # a piece without the centroid row reports 0, so the sum is the centroid's own cosine
        F.sum("central").alias("central"),
        F.slice(F.sort_array(F.flatten(F.collect_list("tops")), asc=False), 1, TOP_SAMPLES).alias("tops"),
    )
    total = F.aggregate("tops", F.lit(0.0), lambda acc, x: acc + x)
    mixed = (
        BEST_WEIGHT * F.col("tops")[0] + MEAN_WEIGHT * total / F.size("tops") + CENTROID_WEIGHT * F.col("central")
    )
    scored = merged.filter(F.size("tops") > 0).withColumn("score", F.round(F.greatest("central", mixed), 6))
    return (
        rows.filter("score is not null").select(cols)
        .unionByName(scored.filter("score > 0").withColumn("watched", F.lit(False)).select(cols))
        .unionByName(scored.filter(F.col("want") == F.col("rkey")).withColumn("watched", F.lit(True)).select(cols))
    )


def match_persons(
    faces: Side, persons: DataFrame, samples: DataFrame,
    thr: float = PERSON_THRESHOLD, margin: float = PERSON_MARGIN, dim: int = FACE_DIM, top: DataFrame | None = None,
) -> DataFrame:
    """(key, person_id, score): best person when good enough and clear of the runner-up.

    `top`: the faces' `best_two`, where they are ranked already.
    """
    top = best_two(faces, persons, samples, dim) if top is None else top
    clear = (F.col("second") <= 0) | (F.round(F.col("score") - F.col("second"), 6) >= margin)
    return top.filter((F.col("score") >= thr) & clear).select(faces.key, "person_id", "score")


def best_two(faces: Side, persons: DataFrame, samples: DataFrame, dim: int = FACE_DIM) -> DataFrame:
    """`top_two` of all faces, for matching and voting alike."""
    return top_two(rank_persons(faces, persons, samples, 2, dim), faces.key)


def top_two(ranked: DataFrame, key: str) -> DataFrame:
    """One row per key: best person, its score and the runner-up's score (0 when there is none)."""
    return ranked.groupBy(key).agg(
        F.max(F.when(F.col("rank") == 1, F.col("person_id"))).alias("person_id"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("score"),
        F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("second"),
    )


# --- clusters -------------------------------------------------------------------------------------


def form_clusters(unmatched: DataFrame, thr: float = CLUSTER_THRESHOLD, dim: int = FACE_DIM, **sizes) -> DataFrame:
    """(face_id, root, label): faces linked by chains of cosine >= thr share a new cluster.

    The label holds 128 bits of a digest of the root, so two roots don't meet in one label.
    """
    key_type = dict(unmatched.dtypes)["face_id"]
    edges = bm.forest_edges(Side(unmatched, "face_id", "embedding"), dim=dim, floor=thr, **sizes)
    roots = bm.components(edges, key_type, cut_lineage)
    joined = unmatched.filter(has_dim("embedding", dim)).select("face_id").join(
        roots.withColumnRenamed("node", "face_id"), "face_id", "left"
    )
    root = F.coalesce("root", "face_id")
    label = F.concat(F.lit("face-"), F.substring(F.sha1(root.cast("string").cast("binary")), 1, LABEL_DIGITS))
    return joined.select("face_id", root.alias("root"), label.alias("label"))


def update_centroids(clusters: DataFrame, assigned: DataFrame, keep: float = 0.7, window: int = FOLD_WINDOW) -> DataFrame:
    """Fold assigned faces into their centroid in `seq` order: c = unit(keep*c + (1-keep)*e), to six digits.

    A step is rounded and divided by its length, so a digit may depend on any face before it, and no part of a
    history can stand for all of it. A label's faces pass its centroid one after the other, sorted by the shuffle;
    the centroid and `window` faces at a time are all that is held. Faces of another length than the
    centroid's are left out of the fold. `assigned`: label, seq, face_id, media_id, embedding.
    """
    state = clusters.select("label", F.col("centroid").cast("array<double>").alias("start"), F.col("example_photo_id").cast("long").alias("example"))
    faces = assigned.select(
        "label", F.col("seq").cast("long"), F.col("face_id").cast("long"), F.col("media_id").cast("long"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )
    faces = faces.join(state.select("label", F.size("start").alias("dim")), "label")
    fits = F.size("vec") == F.col("dim")
    counts = faces.groupBy("label").agg(
        F.count_if(fits).alias("folded"), F.min_by("media_id", F.when(F.col("media_id").isNotNull(), F.struct("seq", "face_id"))).alias("first_photo")
    )
    order = ["label", "seq", "face_id", "vec"]
    heads = state.select("label", F.lit(0).alias("turn"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("long").alias("face_id"), F.col("start").alias("vec"))
    met = spread_groups(heads.unionByName(faces.filter(fits).select(F.lit(1).alias("turn"), *order)), "label").sortWithinPartitions("label", "turn", *order[1:])
    folded = met.select("label", "turn", "vec").mapInPandas(lambda batches: _fold(batches, keep, window), "label string, centroid array<double>")
    return state.join(counts, "label", "left").join(folded, "label").select(
        "label", "centroid", F.coalesce("example", "first_photo").alias("example_photo_id"), F.coalesce("folded", F.lit(0)).alias("folded")
    )


def _fold(batches: Iterator[pd.DataFrame], keep: float, window: int) -> Iterator[pd.DataFrame]:
    label, c = None, None
    for batch in batches:
        done = []
        for start in range(0, len(batch), window):
            part = batch.iloc[start : start + window]
            for name, turn, vec in zip(part["label"], part["turn"], part["vec"]):
                if turn == 0:
                    if label is not None:
                        done.append((label, c))
                    label, c = name, None if vec is None else np.asarray(vec, dtype=float)
                else:
                    merged = keep * c + (1 - keep) * np.asarray(vec, dtype=float)
                    size = np.linalg.norm(merged)
                    c = np.round(merged / size if size else merged, 6)
        if done:
            yield pd.DataFrame({"label": [x for x, _ in done], "centroid": [v for _, v in done]})
    if label is not None:
        yield pd.DataFrame({"label": [label], "centroid": [c]})


def label_names(clusters: DataFrame, persons: DataFrame) -> DataFrame:
    """label -> display name, owner id and owner name."""
    owner = persons.select(F.col("id").alias("person_profile_id"), F.col("name").alias("person_name"))
    return clusters.select("label", "display_name", "person_profile_id").join(owner, "person_profile_id", "left")


def face_names(media: DataFrame, clusters: DataFrame, persons: DataFrame, key: str = "id") -> DataFrame:
    """(key, face_names): display names in label order, then owner names, first-seen distinct."""
    labels = media.select(key, F.posexplode("face_clusters").alias("pos", "label"))
    named = labels.join(label_names(clusters, persons), "label")
    entries = named.select(
        key,
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("tier"), "pos", F.col("display_name").alias("name")),
                F.struct(F.lit(1).alias("tier"), "pos", F.col("person_name").alias("name")),
            )
        ).alias("e"),
    ).filter(F.coalesce(F.col("e.name") != "", F.lit(False)))
    # first place of each name before collecting: a list never exceeds the names of one medium
    firsts = entries.groupBy(key, F.col("e.name").alias("name")).agg(F.min("e").alias("e"))
    names = F.transform(F.array_sort(F.collect_list("e")), lambda e: e["name"])
    return firsts.groupBy(key).agg(names.alias("face_names"))


def resolve_labels(media: DataFrame, clusters: DataFrame, persons: DataFrame) -> DataFrame:
    """(id, labels, names, face_count) from stored labels alone."""
    names = face_names(media, clusters, persons)
    return media.select("id", F.col("face_clusters").alias("labels")).join(names, "id", "left").select(
        "id", "labels", F.coalesce("face_names", empty_strings()).alias("names"),
        F.size("labels").alias("face_count"),
    )


def _ordered_distinct(df: DataFrame, key: str, value: str, place: str, out: str) -> DataFrame:
    firsts = df.filter(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(key, value).agg(
        F.min(place).alias("first")
    )
    items = F.array_sort(F.collect_list(F.struct("first", value)))
    return firsts.groupBy(key).agg(F.transform(items, lambda e: e[value]).alias(out))


def summarise_faces(
    faces: DataFrame, assigned: DataFrame, matches: DataFrame, clusters: DataFrame, persons: DataFrame,
    voted: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Per media: labels, names and face count; and the owner/name change of each matched cluster.

    faces: face_id, media_id, seq; assigned: face_id, label; matches: face_id, person_id; voted (a
    further name said after the others of a face): media_id, seq, name. All faces see the same
    snapshot of the clusters; the last matched face of a cluster decides its owner.
    """
    found = persons.select(F.col("id").alias("person_id"), F.col("name").alias("match_name"), "normalized_name")
    rows = (
        faces.select("face_id", "media_id", "seq")
        .join(assigned.select("face_id", "label"), "face_id", "left")
        .join(matches.select("face_id", "person_id").join(found, "person_id"), "face_id", "left")
        .join(clusters.select("label", "display_name", "person_profile_id"), "label", "left")
    )
    shown = F.when(
        F.col("match_name").isNotNull()
        & (normalize_name(F.col("display_name")) != F.coalesce("normalized_name", F.lit(""))),
        F.col("match_name"),
    ).otherwise(F.col("display_name"))
    rows = rows.withColumn("shown", shown)
    counts = rows.groupBy("media_id").agg(F.count(F.lit(1)).alias("face_count"))
    labels = _ordered_distinct(rows, "media_id", "label", "seq", "labels")
    spoken = rows.select(
        "media_id",
        F.explode(
            F.array(
                F.struct((F.col("seq") * 3).alias("place"), F.col("shown").alias("name")),
                F.struct((F.col("seq") * 3 + 1).alias("place"), F.col("match_name").alias("name")),
            )
        ).alias("e"),
    ).select("media_id", "e.place", "e.name")
    if voted is not None:
        spoken = spoken.unionByName(voted.select("media_id", (F.col("seq") * 3 + 2).alias("place"), "name"))
    names = _ordered_distinct(spoken, "media_id", "name", "place", "names")
    media = (
        counts.join(labels, "media_id", "left")
        .join(names, "media_id", "left")
        .select(
            "media_id",
            F.coalesce("labels", empty_strings()).alias("labels"),
            F.coalesce("names", empty_strings()).alias("names"),
            "face_count",
        )
    )
    changes = (
        rows.filter("label is not null and person_id is not null")
        .groupBy("label")
        .agg(F.max(F.struct("seq", "face_id", "person_id", F.col("shown").alias("display_name"))).alias("last"))
        .select("label", F.col("last.person_id").alias("person_profile_id"), F.col("last.display_name").alias("display_name"))
    )
    return media, changes


# --- person profiles ------------------------------------------------------------------------------


def centroids(samples: DataFrame, key: str = "person_id", vector: str = "embedding", dim: int = FACE_DIM) -> DataFrame:
    """(key, centroid): unit mean of the vectors with `dim` entries."""
    usable = samples.filter(has_dim(vector, dim))
    return usable.groupBy(key).agg(mean_vector(F.col(vector)).alias("m")).select(
        key, F.transform(l2_normalize(F.col("m")), lambda x: F.round(x, 6)).alias("centroid")
    )


def refresh_profiles(persons: DataFrame, samples: DataFrame, dim: int = FACE_DIM) -> DataFrame:
    """Centroid, sample count and newest sample of every person, from its samples."""
    counted = samples.groupBy("person_id").agg(
        F.count(F.lit(1)).cast("int").alias("sample_count"),
        F.max(F.struct("created_at", "id"))["id"].alias("example_sample_id"),
    )
    return (
        persons.drop("centroid", "sample_count", "example_sample_id")
        .join(counted.withColumnRenamed("person_id", "id"), "id", "left")
        .join(centroids(samples, dim=dim).withColumnRenamed("person_id", "id"), "id", "left")
        .withColumn("sample_count", F.coalesce("sample_count", F.lit(0)))
        .select(*persons.columns)
    )


def legacy_vectors(persons: DataFrame, samples: DataFrame, clusters: DataFrame, dim: int = FACE_DIM) -> DataFrame:
    """(kind, key, length) of every non-empty vector that does not have `dim` entries."""
    parts = [
        persons.select(F.lit("person").alias("kind"), F.col("id").cast("string").alias("key"), F.size("centroid").alias("length")),
        samples.select(F.lit("sample").alias("kind"), F.col("id").cast("string").alias("key"), F.size("embedding").alias("length")),
        clusters.select(F.lit("cluster").alias("kind"), F.col("label").alias("key"), F.size("centroid").alias("length")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.filter((F.col("length") > 0) & (F.col("length") != dim))


def cluster_stats(photos: DataFrame) -> DataFrame:
    """(label, photo_count, latest_photo_at); a label repeated on one photo counts each time."""
    when = F.coalesce("taken_at", "created_at")
    return (
        photos.select(F.explode("face_clusters").alias("label"), when.alias("at"))
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("photo_count"), F.max("at").alias("latest_photo_at"))
    )


def person_stats(photos: DataFrame, clusters: DataFrame) -> DataFrame:
    """(person_id, linked_cluster_count, linked_photo_count); a photo counts once per person."""
    owned = clusters.filter("person_profile_id is not null").select("label", F.col("person_profile_id").alias("person_id"))
    linked = owned.groupBy("person_id").agg(F.count(F.lit(1)).alias("linked_cluster_count"))
    seen = photos.select("id", F.explode(F.array_distinct("face_clusters")).alias("label")).join(owned, "label")
    counted = seen.select("id", "person_id").distinct().groupBy("person_id").agg(
        F.count(F.lit(1)).alias("linked_photo_count")
    )
    return linked.join(counted, "person_id", "left").select(
        "person_id", "linked_cluster_count", F.coalesce("linked_photo_count", F.lit(0)).alias("linked_photo_count")
    )
