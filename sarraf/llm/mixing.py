"""Mixing sources to target weights by pivotal dependent rounding.

Each document should appear target / source_size times. The whole part is fixed; the fractions of a source's
documents are paired, and words are moved at random between the two of a pair until one fraction is 0 or 1, so
expectations hold and the words taken never drift. In a bucket the larger partner comes first, and the other is
the bundle of all smaller documents, so that what stays open is short. Every bucket leaves one open fraction a source; these meet in
a reduction tree over ever fewer buckets, and the last one of a source is rounded by its own chance.

Defined cases: null source is a source of its own, last in order; null or blank text has size 0 and takes 0;
equal rows are rounded together and each get a row; an empty table gives no rows. Draws follow from hashes of
the rows, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3
#: Rows of a leaf bucket, and buckets that meet in one of the next level.
LEAF_ROWS, FAN_IN = 20_000, 64


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, n_rows, target) from rows (source, size): weights 1, 2, 3 by source order, capped at CAP times the source."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("n_rows"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # one row a source
    sources = common.materialize(sources.withColumn("weight", (rank - 1) % 3 + 1))
    level, capped = None, F.lit(False)
    while True:  # raises the level until no source above its cap shares in it
        total, held, weight = sources.agg(F.sum("source_size"), F.sum(F.when(capped, CAP * F.col("source_size"))), F.sum(F.when(~capped, F.col("weight")))).first()
        now = (total - (held or 0)) / weight if weight and total else 0.0
        if level is not None and now <= level:
            break
        level, capped = now, CAP * F.col("source_size") < F.lit(now) * F.col("weight")
    target = F.least((CAP * F.col("source_size")).cast("double"), F.lit(level) * F.col("weight"))
    return sources.select("source", "source_size", "n_rows", target.alias("target"))


class _Rounding:
    """Closes the fractions p of one source's rows in a bucket; closed: (row, 0 or 1, how many of its equal rows)."""

    def __init__(self, size: list[int], p: list[float], n: list[int], draw):
        self.size, self.p, self.draw, self.closed, self.open = size, p, draw, [], []
        for i, count in enumerate(n):
            if size[i] == 0:
                self.close(i, 0, count)  # no words either way
            elif count > 1:  # equal rows among themselves: whole sums close, one fraction stays
                whole = int(count * p[i] + 1e-9)
                p[i] = max(0.0, count * p[i] - whole)
                self.close(i, 1, whole)
                self.close(i, 0, count - whole - 1)
                if whole < count:
                    self.keep(i)
            else:
                self.keep(i)

    def close(self, i: int, copies: int, count: int = 1) -> None:
        if count:
            self.closed.append((i, copies, count))

    def keep(self, i: int) -> None:
        """Leaves a row open if its fraction is one."""
        if self.p[i] <= 1e-9 or self.p[i] >= 1 - 1e-9:
            self.close(i, int(self.p[i] > 0.5))
        else:
            self.open.append(i)

    def bundle(self) -> None:
        """Largest first, pairs each row with the bundle of all smaller ones, which share one fraction.

        So long texts are settled while the bundle can take their words, and what stays open is short.
        """
        rows, self.open = sorted(self.open, key=lambda i: -self.size[i]), []
        share, rest = self.p[rows[0]] if rows else 0.0, sum(self.size[i] for i in rows)
        for at, i in enumerate(rows):
            z = self.size[i]
            rest -= z
            up, down = min((1 - share) * z, share * rest), min(share * z, (1 - share) * rest)
            move = up if self.draw() * (up + down) < down else -down
            self.p[i] = share + move / z
            share = share - move / rest if rest else 0.0
            self.keep(i)
            if self.open:  # the bundle closed instead
                for j in rows[at + 1 :]:
                    self.close(j, int(share > 0.5))
                return

    def pairs(self) -> None:
        """Pairs open rows until one is left."""
        while len(self.open) > 1:
            a, b = self.open.pop(), self.open.pop()
            up, down = min((1 - self.p[a]) * self.size[a], self.p[b] * self.size[b]), min(self.p[a] * self.size[a], (1 - self.p[b]) * self.size[b])
            move = up if self.draw() * (up + down) < down else -down
            self.p[a] += move / self.size[a]
            self.p[b] -= move / self.size[b]
            self.keep(b)
            self.keep(a)


def _pivot(rows: pd.DataFrame, leaf: bool, last: bool) -> pd.DataFrame:
    """Rounds the open fractions of one bucket; a source keeps one open row unless this is the last level."""
    rows = rows.sort_values(["source_hash", "key", "doc_id", "n"], kind="stable").reset_index(drop=True)
    rng = np.random.Generator(np.random.PCG64([int(rows["key"].iloc[0]) & (2**63 - 1), len(rows)]))
    out, source = [], rows["source_hash"].to_numpy()
    cuts = np.flatnonzero(np.r_[True, source[1:] != source[:-1]])
    for lo, hi in zip(cuts, [*cuts[1:], len(rows)], strict=True):
        part = rows.iloc[lo:hi]
        r = _Rounding(part["size"].tolist(), part["p"].tolist(), part["n"].tolist(), rng.random)
        if leaf and not (part["n"] > 1).any():
            r.bundle()
        r.pairs()
        if last:
            for i in r.open:
                r.close(i, int(rng.random() < r.p[i]))
            r.open = []
        out += [(lo + i, copies, 0.0, n) for i, copies, n in r.closed] + [(lo + i, -1, r.p[i], 1) for i in r.open]
    done = rows.iloc[[x[0] for x in out]][["doc_id", "source_hash", "key", "size", "whole", "bucket"]].reset_index(drop=True)
    done["extra"], done["p"], done["n"] = [x[1] for x in out], [x[2] for x in out], [x[3] for x in out]
    return done


def _level(leaf: bool, last: bool):
    return lambda rows: _pivot(rows, leaf, last)


_STATE = "doc_id long, source_hash long, key long, size long, whole int, bucket long, extra int, p double, n long"


def copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source_hash, key, size, copies, n), n equal rows with so many copies each, and the targets.

    key tells rows with one doc_id apart.
    """
    base = _keyed(docs).groupBy("doc_id", "source", "source_hash", "key", "size").agg(F.count("*").alias("n"))
    base = common.materialize(base)
    aims = common.materialize(targets(base.withColumn("size", F.col("size") * F.col("n"))))
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(CAP)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    buckets = max(1, -(-(base.count()) // LEAF_ROWS))
    now = (
        base.join(aims.select(F.xxhash64("source").alias("source_hash"), ratio.alias("ratio")), "source_hash")
        .select("doc_id", "source_hash", "key", "size", F.floor("ratio").cast("int").alias("whole"), F.pmod("key", F.lit(buckets)).alias("bucket"), F.lit(-1).alias("extra"), (F.col("ratio") - F.floor("ratio")).alias("p"), "n")
    )
    done = None
    while True:
        last = buckets == 1
        level = common.materialize(now.groupBy("bucket").applyInPandas(_level(done is None, last), _STATE))
        closed = level.filter("extra >= 0")
        done = closed if done is None else done.unionByName(closed)
        if last:
            break
        buckets = -(-buckets // FAN_IN)
        now = level.filter("extra < 0").withColumn("bucket", F.pmod("bucket", F.lit(buckets)))
    return done.select("doc_id", "source_hash", "key", "size", (F.col("whole") + F.col("extra")).alias("copies"), "n"), aims


def _keyed(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", F.xxhash64("source").alias("source_hash"), F.xxhash64("doc_id", "text", "source").alias("key"), size.alias("size"))


def plan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, copies."""
    rounded, aims = copies(docs)
    return (
        rounded.withColumn("row", F.explode(F.expr("sequence(1L, n)")))
        .join(aims.withColumn("source_hash", F.xxhash64("source")), "source_hash")
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
    )


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as its copies say, with the columns of the input."""
    rounded, _ = copies(docs)
    often = rounded.groupBy("doc_id", "key").agg(F.sum(F.col("copies") * F.col("n")).alias("_often"), F.sum("n").alias("_rows")).filter("_often > 0")
    whole = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_id"), F.xxhash64("doc_id", "text", "source").alias("_key"))
    joined = whole.join(often, (F.col("_key") == F.col("key")) & F.col("_id").eqNullSafe(F.col("doc_id")))
    one = joined.filter("_rows = 1").unionByName(joined.filter("_rows > 1").dropDuplicates(["_id", "_key"]))
    return one.withColumn("_copy", F.explode(F.expr("sequence(1L, _often)"))).select("_doc.*")
