"""Nearest neighbours of every row, exactly, over an inverted file of vectors.

The vectors, scaled to length one, are dealt to cells around pivots fitted on a bounded sample. Cells are packed into shelves of
about `SHELF` rows, a large cell being split over several, and a shelf is what one task holds. First every row meets its own
shelf. Its worst neighbour so far then bounds what another cell can offer: by the triangle inequality a cell of radius r around p
has nothing nearer to q than d(q, p) - r, and as its rows are nearer to p than to q's own pivot o, nothing nearer than
(d(q, p)^2 - d(q, o)^2) / 2 d(p, o). Only rows that a shelf may improve are sent there, and there only its cells within
their bound are compared, nearest first, while the bound tightens: queries of neighbouring cells together, as one product in single
precision that says which pairs are worth an exact one. Nothing is left out: the answers are those of all pairs.
Where vectors have no structure the bounds spare little, and the work is that of blocked search, in the same memory.

Equal vectors are one row of the index, with the few ids that can be among anyone's neighbours, so that a vector that a
third of the rows share is compared once. Similarities are rounded to nine digits; ties go by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparklode.operators.vectors import unit
from sparklode.sources.scratch import Scratch

#: Rows whose pivots are fitted on, most pivots, rows of a shelf, and queries that one task compares with a shelf.
SAMPLE, PIVOTS, SHELF, ASKED = 20_000, 1024, 20_000, 20_000
SLACK = 1e-6
#: Queries that go through a shelf together, the fewest and most rows they meet at once, and pairs worked out at once.
TOGETHER, FEWEST, MOST, PAIRS = 256, 128, 4096, 50_000


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def fitted_pivots(sample: np.ndarray, pivots: int, rounds: int = 5) -> np.ndarray:
    """Cell centres by a few rounds of k-means from evenly spread rows of the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, pivots).astype(int)].copy()
    for _ in range(rounds):
        near = distances(sample, centres).argmin(axis=1)
        sums, held = np.zeros_like(centres), np.bincount(near, minlength=pivots)
        np.add.at(sums, near, sample)
        centres[held > 0] = sums[held > 0] / held[held > 0, None]
    return centres


class Cells:
    """What tasks need to know of the index: pivots, the radius of each cell, and the shelves its rows lie on."""

    def __init__(self, pivots: np.ndarray, sizes: dict[int, tuple[int, float]], shelf: int = SHELF) -> None:
        self.pivots = pivots
        self.radius = np.full(len(pivots), -np.inf)
        self.first, self.pieces = np.zeros(len(pivots), int), np.ones(len(pivots), int)
        at, room = 0, shelf
        for cell, (rows, radius) in sorted(sizes.items()):
            self.radius[cell] = radius
            if rows > shelf:
                at += room < shelf
                self.first[cell], self.pieces[cell] = at, -(-rows // shelf)
                at, room = at + int(self.pieces[cell]), shelf
                continue
            if rows > room:
                at, room = at + 1, shelf
            self.first[cell], room = at, room - rows
        self.shelves = at + (room < shelf)

    @cached_property
    def between(self) -> np.ndarray:
        return distances(self.pivots, self.pivots)

    def home(self, cell: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The shelf of rows of these cells; rows of a split cell are spread by their number."""
        return self.first[cell] + number % self.pieces[cell]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and cell a distance that none of the cell's rows is below; infinite for empty cells."""
        far = distances(queries, self.pivots)
        own = far.argmin(axis=1)
        ball = far - self.radius
        apart = np.maximum(self.between[own], 1e-12)
        plane = (far**2 - far[np.arange(len(far)), own][:, None] ** 2) / (2 * apart)
        out = np.maximum(np.maximum(ball, 0), plane)
        out[np.arange(len(far)), own] = np.maximum(ball[np.arange(len(far)), own], 0)
        out[:, np.isneginf(self.radius)] = np.inf
        return out


def reach(queries: np.ndarray, worst: np.ndarray) -> np.ndarray:
    """The distance within which a row must lie to have at least the similarity `worst`; rows have length one or none."""
    return np.sqrt(np.maximum((queries * queries).sum(axis=1) + 1 - 2 * worst, 0)) + SLACK


class Best:
    """The `k` best (similarity, id) of each of some queries, while candidates come in."""

    def __init__(self, queries: int, k: int, worst: np.ndarray) -> None:
        self.k, self.floor = k, worst.copy()
        self.ids, self.sims = np.full((queries, k), np.iinfo(np.int64).max), np.full((queries, k), -np.inf)
        self.compared = 0

    def offer(self, some: slice, queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> None:
        """Rows for the queries `some`. Single precision, with room for its error, tells which pairs may count; those alone are
        worked out."""
        self.compared += len(queries) * len(vectors)
        room = (queries.shape[1] + 4) * 1.2e-7
        rough = queries.astype("float32") @ vectors.astype("float32").T
        query, row = np.nonzero(rough >= (self.floor[some] - room).astype("float32")[:, None] - np.float32(room))
        exact = [np.einsum("ij,ij->i", queries[query[a : a + PAIRS]], vectors[row[a : a + PAIRS]]) for a in range(0, len(query), PAIRS)]
        sims = np.round(np.concatenate([*exact, np.zeros(0)]), 9)
        held, place = np.nonzero(self.sims[some] > -np.inf)
        query, sims = np.concatenate([held, query]), np.concatenate([self.sims[some][held, place], sims])
        names = np.concatenate([self.ids[some][held, place], ids[row]])
        order = np.lexsort((names, -sims, query))
        query, sims, names = query[order], sims[order], names[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        top = place < self.k
        self.sims[some][query[top], place[top]], self.ids[some][query[top], place[top]] = sims[top], names[top]
        self.floor[some] = np.maximum(self.floor[some], self.sims[some][:, -1])

    def rows(self, queries: np.ndarray) -> pd.DataFrame:
        at, place = np.nonzero(self.sims >= np.maximum(self.floor, -2)[:, None])
        return pd.DataFrame({"query_id": queries[at], "id": self.ids[at, place], "similarity": self.sims[at, place]})


def compared(cells: Cells, shelf: pd.DataFrame, queries: pd.DataFrame, k: int) -> tuple[pd.DataFrame, int]:
    """The best rows (id, cell, v) of a shelf for each query (id, v, worst), and how many pairs were compared."""
    if shelf.empty or queries.empty:
        return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")}), 0
    asked = np.stack(queries["v"].to_list())
    # Queries of one cell lie side by side, so that they leave out much the same cells.
    turn = np.argsort(np.concatenate([distances(asked[k : k + 2000], cells.pivots).argmin(axis=1) for k in range(0, len(asked), 2000)]), kind="stable")
    queries, asked = queries.iloc[turn], asked[turn]
    best = Best(len(asked), k, queries["worst"].to_numpy(float))
    shelf = shelf.sort_values("cell", kind="stable")
    vectors, ids = np.stack(shelf["v"].to_list()), shelf["id"].to_numpy()
    present, first, many = np.unique(shelf["cell"].to_numpy(), return_index=True, return_counts=True)
    for at in range(0, len(asked), TOGETHER):
        some = slice(at, at + TOGETHER)
        bounds = cells.bounds(asked[some])[:, present]
        waiting, width = np.argsort(bounds.min(axis=0), kind="stable"), FEWEST
        while len(waiting):
            waiting = waiting[(bounds[:, waiting] <= reach(asked[some], best.floor[some])[:, None]).any(axis=0)]
            now = waiting[: max(1, int(np.searchsorted(np.cumsum(many[waiting]), width)))]
            waiting = waiting[len(now) :]
            rows = np.concatenate([np.arange(first[c], first[c] + many[c]) for c in now] or [np.zeros(0, int)])
            while len(rows):
                best.offer(some, asked[some], vectors[rows[:width]], ids[rows[:width]])
                rows, width = rows[width:], min(2 * width, MOST)
    return best.rows(queries["id"].to_numpy()), best.compared


def _classes(rows: DataFrame, id_col: str, vector: str, offered: Column) -> DataFrame:
    """(id, h1, h2, v, offered): equal vectors have equal digests."""
    v = unit(F.col(vector))
    slim = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), offered.alias("offered"))
    return slim.select("id", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"), "v", "offered")


def nearest_to_all(rows: DataFrame, id_col: str, vector: str, k: int, offered: Column | None = None, shelf: int = SHELF, asked: int = ASKED, sample: int = SAMPLE) -> DataFrame:
    """(query_id, id, similarity, rank): the `k` most similar offered rows of every row, itself left out.

    Rows for which `offered` is false ask, but aren't answers. Ids must be unique; rows without an id or vector are left out."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "neighbours")
    offered = F.lit(True) if offered is None else F.coalesce(offered, F.lit(False))
    members = scratch.keep(_classes(rows.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()), id_col, vector, offered), "members")
    same = ["h1", "h2"]
    reps = members.groupBy(*same).agg(F.min("id").alias("id"), F.first("v").alias("v"), F.max("offered").alias("offered"))
    reps = scratch.keep(reps, "reps")

    n = reps.where("offered").count()
    found = reps.where("offered").orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toPandas()["v"].to_list()
    if not found:
        return spark.createDataFrame([], "query_id long, id long, similarity double, rank int")
    basis = np.stack(found)
    pivots = fitted_pivots(basis, int(min(PIVOTS, len(np.unique(basis, axis=0)), max(1, round(n**0.5)))))
    shared = spark.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                far = distances(np.stack(batch["v"].to_list()), shared.value)
                yield batch.assign(cell=far.argmin(axis=1).astype("int32"), far=far.min(axis=1))

    placed = scratch.keep(reps.select("id", "v", "offered").mapInPandas(place, "id long, v array<double>, offered boolean, cell int, far double"), "placed")
    # One row a cell, and there are at most PIVOTS cells.
    sizes = {r["cell"]: (r["n"], r["far"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    cells = spark.sparkContext.broadcast(Cells(pivots, sizes, shelf))
    spread = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)).cast("int").alias("spread")

    def shelve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.assign(shelf=cells.value.home(batch["cell"].to_numpy(), batch["spread"].to_numpy()))
            yield batch.drop(columns="spread")

    kinds = "id long, v array<double>, offered boolean, cell int, shelf int"
    shelved = scratch.keep(placed.select("id", "v", "offered", "cell", spread).mapInPandas(shelve, kinds), "shelved")
    answer = "query_id long, id long, similarity double"

    def at_home(table: pd.DataFrame) -> pd.DataFrame:
        return compared(cells.value, table[table["offered"]], table.assign(worst=-np.inf), k + 1)[0]

    first = scratch.keep(shelved.groupBy("shelf").applyInPandas(at_home, answer), "home")
    last = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("similarity").alias("least"))
    worst = F.when(F.col("n") > k, F.col("least")).otherwise(F.lit(-2.0))
    waiting = shelved.join(last.withColumnRenamed("query_id", "id"), "id", "left").select("id", "v", F.coalesce(worst, F.lit(-2.0)).alias("worst"), F.col("shelf").alias("seen"))

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here = cells.value
        shelf_of = np.concatenate([np.column_stack([np.full(here.pieces[c], c), here.first[c] + np.arange(here.pieces[c])]) for c in np.flatnonzero(~np.isneginf(here.radius))])
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                asked_ = np.stack(part["v"].to_list())
                open_ = here.bounds(asked_) <= reach(asked_, part["worst"].to_numpy())[:, None]
                query, piece = np.nonzero(open_[:, shelf_of[:, 0]])
                pairs = np.unique(np.column_stack([query, shelf_of[piece, 1]]), axis=0)
                pairs = pairs[pairs[:, 1] != part["seen"].to_numpy()[pairs[:, 0]]]
                out = part.iloc[pairs[:, 0]][["id", "v", "worst"]].copy()
                out["shelf"] = pairs[:, 1].astype("int32")
                yield out

    asking = scratch.keep(waiting.mapInPandas(sent, "id long, v array<double>, worst double, shelf int"), "asking")
    # How many tasks a shelf needs: one row a shelf.
    chunks = asking.groupBy("shelf").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / asked)).cast("int").alias("chunks"))
    part = F.pmod(F.xxhash64("id", F.lit(11)), F.col("chunks")).cast("int").alias("part")
    dealt = asking.join(F.broadcast(chunks), "shelf").select("shelf", part, "id", "v", "worst")
    copies = shelved.where("offered").join(F.broadcast(chunks), "shelf").select("shelf", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("part"), "id", "v", "cell")

    def away(key: tuple, table: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        return compared(cells.value, table, queries, k + 1)[0]

    second = copies.groupBy("shelf", "part").cogroup(dealt.groupBy("shelf", "part")).applyInPandas(away, answer)
    best = scratch.keep(_best(first.unionByName(second), k + 1), "best")

    # From classes to rows: of each class the smallest ids that can count, for each class its list, then each row's own.
    low = F.row_number().over(W.partitionBy(*same).orderBy("id"))
    few = members.where("offered").select("id", *same).withColumn("n", low).where(F.col("n") <= k + 1).drop("n")
    named = few.join(reps.select(F.col("id").alias("rep"), *same), same).select("rep", "id")
    spread_out = _best(best.withColumnRenamed("id", "rep").join(named, "rep").select("query_id", "id", "similarity"), k + 1)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("less"), "id"))).alias("list")
    lists = spread_out.groupBy(F.col("query_id").alias("rep")).agg(ordered)
    asks = members.select(F.col("id").alias("query_id"), *same).join(reps.select(F.col("id").alias("rep"), *same), same)
    mine = asks.join(lists, "rep").select("query_id", F.slice(F.filter("list", lambda x: x["id"] != F.col("query_id")), 1, k).alias("list"))
    flat = mine.select("query_id", F.posexplode("list").alias("rank", "x"))
    return flat.select("query_id", F.col("x.id").alias("id"), (-F.col("x.less")).alias("similarity"), (F.col("rank") + 1).alias("rank"))


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).drop("rank")


def similar_items(neighbours: DataFrame, marks: DataFrame, k: int) -> DataFrame:
    """(query_id, id, rank): the first `k` of each row's pool that are neither its copy or original nor of its very title.

    marks: (id, original, title); original is null for rows that are no copy."""
    mine, theirs = (marks.withColumnsRenamed({"id": name, "original": f"{name}_original", "title": f"{name}_title"}) for name in ("query_id", "id"))
    joined = neighbours.join(mine, "query_id", "left").join(theirs, "id", "left")
    copy = (F.col("query_id_original") == F.col("id")) | (F.col("id_original") == F.col("query_id"))
    titled = (F.col("query_id_title") != "") & (F.col("query_id_title") == F.col("id_title"))
    kept = joined.where(~F.coalesce(copy, F.lit(False)) & ~F.coalesce(titled, F.lit(False))).drop("rank")
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return kept.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "id", "rank")
