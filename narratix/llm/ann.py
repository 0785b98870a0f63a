"""Approximate nearest neighbours by balanced posting lists.

Centroids come from a tree of k-means over ``per_list`` sampled vectors for each of ``most_lists`` lists at most (65,536 vectors, so
sample and broadcast are bounded), in which no cluster keeps over twice the mean share. Every distinct vector is indexed: it goes
to its nearest centroid's list and, near a boundary, to up to ``copies`` lists whose centroids are within ``closure`` of the nearest. Lists that
hold more than ``bound`` are split, each by centroids fitted on its own members, all lists at once in written rounds, until none
does (four rounds at most: 256 parts each), so a list's size does not grow with the table.

Centroids are found by best-first search in a nearest-neighbour graph held in memory. A query reads the lists whose centroid is at most
1 + ``ratio`` times as far as the nearest one, and further ones until they hold ten times k vectors; the search widens until the
ratio ends it. Of a list that was split it reads the parts within the ratio
of the nearest part of all. Long lists are scanned in parts of at most ``part``
members, their queries likewise, so no task grows with a list.

Nearness is the largest inner product: vectors get one more component that makes all norms equal, so distances order alike.
Equal vectors are indexed once with their k + 1 smallest ids, which is all that any top k can hold of them. Rows whose vector
is null, empty or zero, holds null or non-finite components, or has another length than most take no part; nor do null ids.
Repeated rows count once. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import joined_apart, materialize, sample_share


def two_means(x: np.ndarray, rng) -> np.ndarray:
    a, b = x[rng.choice(len(x), 2, replace=False)]
    side = np.zeros(len(x), dtype=bool)
    for _ in range(8):
        new = ((x - b) ** 2).sum(1) < ((x - a) ** 2).sum(1)
        if not new.any() or new.all():
            return np.arange(len(x)) % 2 == 0
        side, a, b = new, x[~new].mean(0), x[new].mean(0)
    return side


def balanced_centroids(x: np.ndarray, lists: int, rng, branch: int = 16, rounds: int = 6) -> np.ndarray:
    """A tree of k-means with `branch` ways, as deep as clusters are large; a cluster never keeps over twice the mean share of points."""
    lists = max(1, min(lists, len(x)))
    most, out, todo = max(2, 2 * len(x) // lists), [], [(np.arange(len(x)), lists)]
    while todo:
        own, want = todo.pop()
        if want <= 1 and len(own) <= most:
            out.append(x[own].mean(0))
            continue
        ways = min(branch, max(2, want), len(own))
        if ways == 2:
            side = two_means(x[own], rng)
            near = side.astype(np.int64)
        else:
            c = x[own[rng.choice(len(own), ways, replace=False)]].copy()
            for _ in range(rounds):
                near = nearest_all(x[own], c)
                total = np.zeros_like(c)
                np.add.at(total, near, x[own])
                n = np.bincount(near, minlength=ways)
                c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
            if np.bincount(near, minlength=ways).max() == len(own):
                near = np.arange(len(own)) % ways  # points that no centroid tells apart are dealt evenly
        for k in range(ways):
            if len(part := own[near == k]):
                todo.append((part, max(1, round(want * len(part) / len(own)))))
    return np.array(out, dtype=np.float32)


def nearest_all(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c**2).sum(1) / 2
    return np.concatenate([(half - x[i : i + 4096] @ c.T).argmin(1) for i in range(0, len(x), 4096)])


class CentroidGraph:
    """Each centroid's nearest centroids both ways; entry points are spread over all of them."""

    def __init__(self, centroids: np.ndarray, degree: int = 16, entries: int = 32):
        self.c, n = centroids, len(centroids)
        degree = min(degree, n - 1)
        half = (centroids**2).sum(1) / 2
        near = []
        for i in range(0, n, 1024):
            d = half - centroids[i : i + 1024] @ centroids.T
            d[np.arange(len(d)), i + np.arange(len(d))] = np.inf
            near.append(np.argsort(d, axis=1)[:, :degree])
        near = np.concatenate(near) if degree else np.zeros((n, 0), np.int64)
        back = [list(r) for r in near]
        for i, r in enumerate(near):
            for j in r:
                if len(back[j]) < 2 * degree and i not in back[j]:
                    back[j].append(i)
        width = max([1, *map(len, back)])
        self.near = np.array([r + [i] * (width - len(r)) for i, r in enumerate(back)], dtype=np.int64)
        far = [0]
        least = ((centroids - centroids[0]) ** 2).sum(1)
        while len(far) < min(entries, n):
            far.append(int(least.argmax()))
            least = np.minimum(least, ((centroids - centroids[far[-1]]) ** 2).sum(1))
        self.entry = np.unique(far)

    def ranked(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All centroids, nearest first, and their squared distances: one product, cheaper than a search that meets most of them."""
        d = (self.c**2).sum(1) / 2 - q @ self.c.T
        ids = np.argsort(d, axis=1, kind="stable")
        return ids, np.maximum(2 * np.take_along_axis(d, ids, 1) + (q**2).sum(1)[:, None], 0)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids found, nearest first, and their squared distances: best-first over the graph for all q at once."""
        n = len(self.c)
        beam = min(beam, n)
        rows = np.arange(len(q))[:, None]
        half, own = (self.c**2).sum(1) / 2, (q**2).sum(1)[:, None]
        seen = np.zeros((len(q), n), dtype=bool)
        ids = np.repeat(self.entry[None], len(q), 0)
        d = half[ids] - q @ self.c[self.entry].T
        seen[:, self.entry] = True
        if ids.shape[1] < beam:
            pad = beam - ids.shape[1]
            ids, d = np.pad(ids, ((0, 0), (0, pad))), np.pad(d, ((0, 0), (0, pad)), constant_values=np.inf)
        done = np.zeros(ids.shape, dtype=bool)
        wide = 4
        while True:
            order = np.argsort(d, axis=1, kind="stable")[:, :beam]
            ids, d, done = (np.take_along_axis(x, order, 1) for x in (ids, d, done))
            open_ = ~done & np.isfinite(d)
            if not open_.any():
                return ids, np.maximum(2 * d + own, 0)
            pick = np.argsort(~open_, axis=1, kind="stable")[:, :wide]
            live = np.take_along_axis(open_, pick, 1)
            node = np.take_along_axis(ids, pick, 1)
            done[rows, pick] = True
            new = self.near[node].reshape(len(q), -1)
            fresh = np.repeat(live, self.near.shape[1], 1) & ~seen[rows, new]
            order = np.argsort(new, axis=1, kind="stable")  # a centroid reached twice counts once
            new, fresh = np.take_along_axis(new, order, 1), np.take_along_axis(fresh, order, 1)
            fresh[:, 1:] &= ~((new[:, 1:] == new[:, :-1]) & fresh[:, :-1])
            r, k = np.nonzero(fresh)
            at = new[r, k]
            seen[r, at] = True
            dist = np.full(new.shape, np.inf)
            dist[r, k] = half[at] - np.einsum("ij,ij->i", q[r], self.c[at])
            ids, d, done = np.concatenate([ids, new], 1), np.concatenate([d, dist], 1), np.concatenate([done, np.zeros(new.shape, bool)], 1)


def lengthened(x: np.ndarray, most: float, query: bool = False) -> np.ndarray:
    extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(most - (x.astype(float) ** 2).sum(1), 0))
    return np.concatenate([x, extra[:, None]], 1).astype(np.float32)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((c**2).sum(1) - 2 * (x @ c.T) + (x**2).sum(1)[:, None], 0))


def replicas(d: np.ndarray, closure: float, copies: int) -> np.ndarray:
    """Which of a vector's nearest centroids (nearest first, d their distances) list it: the nearest, and others nearly as near."""
    return (d <= (1 + closure) * d[:, :1] + 1e-12) & np.isfinite(d) & (np.arange(d.shape[1]) < copies)


def _assign(shared, closure: float, copies: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, most = shared.value
        for f in frames:
            for lo in range(0, len(f), 256):
                g = f.iloc[lo : lo + 256]
                ids, d = graph.search(lengthened(np.stack(g["embedding"].to_numpy()), most), 16)
                r, k = np.nonzero(replicas(np.sqrt(d), closure, copies))
                yield pd.DataFrame({"list": ids[r, k], "rep": g["rep"].to_numpy()[r], "embedding": g["embedding"].to_numpy()[r]})

    return run


def _probe(shared, sizes: np.ndarray, ratio: float, enough: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, most = shared.value
        for f in frames:
            for lo in range(0, len(f), 256):
                g, beam = f.iloc[lo : lo + 256], 64
                while len(g):  # the ratio alone ends a search: where it reaches beyond the beam, the beam is widened
                    q = lengthened(np.stack(g["embedding"].to_numpy()), most, True)
                    ids, d = graph.search(q, beam) if beam == 64 or 8 * beam < len(graph.c) else graph.ranked(q)
                    beam = max(beam, ids.shape[1])
                    d, found = np.sqrt(d), np.isfinite(d)
                    before = np.cumsum(np.where(found, sizes[ids], 0), 1) - sizes[ids]
                    take = found & ((d <= (1 + ratio) * d[:, :1]) | (before < enough))
                    short = take.sum(1) == found.sum(1) if beam < len(graph.c) else np.zeros(len(g), bool)
                    r, k = np.nonzero(take & ~short[:, None])
                    yield pd.DataFrame({"list": ids[r, k], "query": g["rep"].to_numpy()[r], "embedding": g["embedding"].to_numpy()[r], "d": d[r, k].astype(float), "must": before[r, k] < enough})
                    g, beam = g[short], 4 * beam

    return run


def _stacked(f: pd.DataFrame, most: float, query: bool = False) -> np.ndarray:
    return lengthened(np.stack(f["embedding"].to_numpy()), most, query)


def _fit(most: float, seed: int):
    """Centroids of the parts of a long list, from its drawn members."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("rep", kind="stable")
        c = balanced_centroids(_stacked(f, most), int(f["subs"].iat[0]), np.random.Generator(np.random.PCG64(seed + key[0] % (1 << 30))))
        return pd.DataFrame({"list": [key[0]], "width": [c.shape[1]], "centroids": [c.tobytes()]})

    return run


def _centroids(t: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(t["centroids"].iat[0], np.float32).reshape(-1, int(t["width"].iat[0]))


#: A part of list x has the number (x + 1) * 2**PARTS + k, so numbers tell levels apart.
PARTS = 13
#: The fewest bins of a scan, and about the most rows (of members, of queries) that one holds, each with its vector.
BINS, BIN = 16, 131_072


def _parted(most: float, closure: float, copies: int):
    def run(key: tuple, f: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(f):
            return f[["list", "rep", "embedding"]]
        c, out = _centroids(t), []
        for lo in range(0, len(f), 1024):
            g = f.iloc[lo : lo + 1024]
            d = distances(_stacked(g, most), c)
            ids = np.argsort(d, axis=1, kind="stable")[:, :copies]
            r, k = np.nonzero(replicas(np.take_along_axis(d, ids, 1), closure, copies))
            out.append(pd.DataFrame({"list": (key[0] + 1 << PARTS) + ids[r, k], "rep": g["rep"].to_numpy()[r], "embedding": g["embedding"].to_numpy()[r]}))
        return pd.concat(out)

    return run


def _routed(most: float, ratio: float):
    def run(key: tuple, f: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(f):
            return f[["list", "query", "embedding", "d", "must"]]
        c, out = _centroids(t), []
        for lo in range(0, len(f), 1024):
            g = f.iloc[lo : lo + 1024]
            d = distances(_stacked(g, most, True), c)
            r, k = np.nonzero(d <= (1 + ratio) * d.min(1, keepdims=True))
            must = g["must"].to_numpy()[r] & (k == d.argmin(1)[r])
            out.append(pd.DataFrame({"list": (key[0] + 1 << PARTS) + k, "query": g["query"].to_numpy()[r], "embedding": g["embedding"].to_numpy()[r], "d": d[r, k].astype(float), "must": must}))
        return pd.concat(out)

    return run


def _scan(k: int):
    """The k best of each query over all the lists of a bin, each list's members against the queries that read it."""
    unit = ["list", "m", "q"]

    def run(key: tuple, members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        at = members.groupby(unit).indices if len(members) else {}
        rep, name = members["rep"].to_numpy(), queries["query"].to_numpy()
        for which, rows in queries.groupby(unit).indices.items() if at else ():
            own = at.get(which)
            if own is None:
                continue
            v, n = np.stack(members["embedding"].to_numpy()[own]).astype(float), min(k, len(own))
            for lo in range(0, len(rows), 512):
                part = rows[lo : lo + 512]
                q = np.stack(queries["embedding"].to_numpy()[part]).astype(float)
                s = q @ v.T
                least = np.partition(s, len(v) - n, axis=1)[:, len(v) - n]
                r, c = np.nonzero(s >= least[:, None] - 1e-12)
                out.append((name[part[r]], rep[own[c]], np.einsum("ij,ij->i", q[r], v[c])))
        query, rep, score = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((-score, rep, query))  # a vector may stand in several lists
        query, rep, score = query[order], rep[order], score[order]
        new = np.append(True, (query[1:] != query[:-1]) | (rep[1:] != rep[:-1]))[: len(query)]
        query, rep, score = query[new], rep[new], score[new]
        order = np.lexsort((rep, -score, query))
        query, rep, score = query[order], rep[order], score[order]
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1])[: len(query)])
        best = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query)))) < k
        return pd.DataFrame({"query": query[best], "rep": rep[best], "score": score[best]})

    return run


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    x = F.col("embedding")
    fine = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False)) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).where(fine)
    # one row per length of vector comes back
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("embedding") == (sizes[0]["d"] if sizes else 0))


def _counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"))


def _dealt(rows: DataFrame, name: str, counts: DataFrame, part: int) -> DataFrame:
    """Rows with p, their part of a list; parts have about `part` rows."""
    parts = counts.select("list", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    return joined_apart(rows, parts, "list", counts).withColumn("p", F.pmod(F.xxhash64(name), F.col("parts")).cast("int")).drop("parts")


def _spread(tables: DataFrame, counts: DataFrame, part: int) -> DataFrame:
    """The lists' tables, one for each part that _dealt makes."""
    return tables.join(counts, "list").select("list", "width", "centroids", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / part).cast("int") - 1)).alias("p"))


class Index:
    """Posting lists (list, rep, embedding) over distinct vectors `alike` (embedding, rep, ids), and the tables of the lists that were split."""

    def __init__(self, alike: DataFrame, list_size: int, per_list: int, most_lists: int, bound: int, copies: int, closure: float, part: int, seed: int):
        indexed, self.alike, self.part = alike.where(F.size("ids") > 0), alike, part
        spark = alike.sparkSession
        facts = indexed.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))).alias("most")).first()
        self.vectors, self.most, self.levels = facts["n"], facts["most"], []
        if not self.vectors:
            return
        lists = max(1, min(most_lists, self.vectors // list_size))
        share = sample_share(self.vectors, per_list * lists)
        drawn = indexed.where(F.pmod(F.xxhash64("rep"), F.lit(share)) == 0).limit(per_list * lists).select("embedding").toPandas()["embedding"]
        drawn = drawn if len(drawn) else indexed.orderBy("rep").limit(per_list * lists).select("embedding").toPandas()["embedding"]
        points = lengthened(np.stack(drawn.to_numpy()).astype(np.float32), self.most)
        graph = CentroidGraph(balanced_centroids(points[np.lexsort(points.T)], lists, np.random.Generator(np.random.PCG64(seed))))
        self.shared = spark.sparkContext.broadcast((graph, self.most))
        self.kind = alike.schema["embedding"].dataType.simpleString()
        members = materialize(indexed.select("rep", "embedding").mapInPandas(_assign(self.shared, closure, copies), f"list long, rep long, embedding {self.kind}"), "posting-lists")
        counts = materialize(_counts(members), "list-sizes")
        self.sizes = np.zeros(len(graph.c), np.int64)  # at most most_lists rows come back, and those of clusters halved
        for r in counts.collect():
            self.sizes[r["list"]] = r["n"]
        while (long := counts.where(F.col("n") > bound)).limit(1).count() and len(self.levels) < 4:
            subs = F.least(F.ceil(F.col("n") / list_size), F.lit(256)).cast("int")
            every = F.greatest(F.floor(F.col("n") / (per_list * subs)), F.lit(1))
            plan = materialize(long.select("list", subs.alias("subs"), every.alias("every")), "long-lists")
            drawn = joined_apart(members, plan, "list", long).where(F.pmod(F.xxhash64("rep"), F.col("every")) == 0).select("list", "rep", "embedding", "subs")
            tables = materialize(drawn.groupBy("list").applyInPandas(_fit(self.most, seed), "list long, width int, centroids binary"), "list-parts")
            long = counts.join(tables.select("list"), "list", "left_semi")
            left = _dealt(members, "rep", long, part)  # the rows of long lists alone
            split = left.groupBy("list", "p").cogroup(_spread(tables, long, part).groupBy("list", "p")).applyInPandas(_parted(self.most, closure, 2), f"list long, rep long, embedding {self.kind}")
            members = materialize(members.join(long.select("list"), "list", "left_anti").unionByName(split), "posting-lists")
            counts = materialize(_counts(members), "list-sizes")
            self.levels.append(tables)
        self.members, self.counts = members, counts

    def probes(self, asked: DataFrame, ratio: float, enough: int) -> DataFrame:
        """(list, query, embedding): the lists that each distinct query (rep, embedding) reads."""
        schema = f"list long, query long, embedding {self.kind}, d double, must boolean"
        out = asked.mapInPandas(_probe(self.shared, self.sizes, ratio, enough), schema)
        out = materialize(out, "probes")
        for tables in self.levels:
            counts = _counts(out).join(tables.select("list"), "list", "left_semi")
            left = _dealt(out, "query", counts, self.part)
            down = left.groupBy("list", "p").cogroup(_spread(tables, counts, self.part).groupBy("list", "p")).applyInPandas(_routed(self.most, ratio), schema)
            out = materialize(out.join(tables.select("list"), "list", "left_anti").unionByName(down), "probes")
        if self.levels:  # parts are nearer than the lists they came from, so the ratio prunes once more
            near = out.groupBy("query").agg(F.min("d").alias("least"))
            out = materialize(out.join(near, "query").where(F.col("must") | (F.col("d") <= (1 + ratio) * F.col("least"))), "probes")
        return out.select("list", "query", "embedding")


def indexed(vectors: DataFrame, queries: DataFrame, k: int = 20, list_size: int = 64, per_list: int = 16, most_lists: int = 4096, bound: int = 512, copies: int = 4, closure: float = 0.02, part: int = 4096, seed: int = 7) -> Index:
    """The index of all rows that take part; queries that are not rows are known to it, but not listed."""
    rows, asked = valid_vectors(vectors), valid_vectors(queries)
    least = Window.partitionBy("embedding").orderBy("vec_id")
    some = rows.distinct().withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1)
    asks = asked.groupBy("embedding").agg(F.count(F.lit(1)).alias("asked"))
    alike = some.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    alike = materialize(alike.join(asks, "embedding", "left"), "vectors")
    lone = asks.join(alike, "embedding", "left_anti")  # queries that are not rows themselves
    number = (-F.row_number().over(Window.partitionBy(F.xxhash64("embedding")).orderBy("embedding")) - F.pmod(F.xxhash64("embedding"), F.lit(1 << 60))).cast("long")
    alike = alike.unionByName(lone.select("embedding", number.alias("rep"), F.array().cast("array<long>").alias("ids"), "asked"))
    return Index(alike, list_size, per_list, most_lists, bound, copies, closure, part, seed)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, ratio: float = 0.2, **options) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of all other rows found for each query row; queries: (vec_id, embedding). options: those of ``indexed``."""
    spark, index = vectors.sparkSession, indexed(vectors, queries, k, **options)
    if not index.vectors:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    alike, part = index.alike, index.part
    probe = index.probes(alike.where("asked > 0").select("rep", "embedding"), ratio, 10 * k)
    # a list that is read is dealt into parts of members (m) and of queries (q), and each pair of parts is scanned; bins of
    # many pairs hand on the best of each query once, so that few rows are shuffled
    asked_of = materialize(_counts(probe), "asked")
    parts = index.counts.withColumnRenamed("n", "members").join(asked_of, "list").select("list", "members", "n", F.ceil(F.col("members") / part).cast("int").alias("mp"), F.ceil(F.col("n") / part).cast("int").alias("qp"))
    parts = materialize(parts, "parts")
    size = parts.agg(F.sum(F.col("members") * F.col("qp")), F.sum(F.col("n") * F.col("mp"))).first()
    bins = max(BINS, *(-(-(x or 0) // BIN) for x in size))
    bin_ = F.pmod(F.xxhash64("list", "m", "q"), F.lit(bins)).alias("bin")
    parts = parts.select("list", "mp", "qp")
    each = lambda c, n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(c)
    left = joined_apart(index.members, parts, "list", index.counts).select("list", F.pmod(F.xxhash64("rep"), F.col("mp")).cast("int").alias("m"), each("q", "qp"), "rep", "embedding").select("*", bin_)
    right = joined_apart(probe, parts, "list", asked_of).select("list", each("m", "mp"), F.pmod(F.xxhash64("query"), F.col("qp")).cast("int").alias("q"), "query", "embedding").select("*", bin_)
    hits = left.groupBy("bin").cogroup(right.groupBy("bin")).applyInPandas(_scan(k + 1), "query long, rep long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    hits = hits.groupBy("query", "rep").agg(F.max("score").alias("score")).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    found = hits.join(alike.where(F.size("ids") > 0).select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    # a query's list holds k + 1 of them, one of which may be the query itself
    found = found.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))), 1, k + 1).alias("all"))
    names = valid_vectors(queries).distinct()
    # a join on the vector itself: the side with repeated queries is the one that Spark can split
    names = names.join(alike.where("asked > 0").select("embedding", F.col("rep").alias("query")), "embedding").select(F.col("vec_id").alias("query_id"), "query")
    out = joined_apart(names, found, "query", alike.where("asked > 0").select(F.col("rep").alias("query"), F.col("asked").alias("n")))
    mine = F.slice(F.filter("all", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(mine).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), "x.vec_id", (-F.col("x.less")).alias("score"))
