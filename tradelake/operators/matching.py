"""Greedy one-to-one assignment by score."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..streaming.runs import shared_folder


def greedy(pairs: DataFrame, group: Sequence[str], left: str, right: str, score: str) -> DataFrame:
    """group, left, right, score of the pairs that are claimed in the order of score (highest first), then left, then right.

    A pair is claimed if neither side was claimed before it. In rounds: a pair that comes first for both of
    its sides among those still open is claimed, and what shares a side with it goes. Each round claims at
    least one pair of every group that has any, and all groups advance together, so rounds follow the longest
    chain of displaced pairs, not the number of rows. Rounds are cut by written tables.
    """
    spark = pairs.sparkSession
    folder = shared_folder(spark)

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    ranked = pairs.select(*group, left, right, score).distinct()
    first = F.min(F.struct((-F.col(score)).alias("s"), F.col(left).alias("l"), F.col(right).alias("r")))
    open_, done, k = kept(ranked, "open-0"), None, 0
    while open_.limit(1).count():
        by_left = open_.groupBy(*group, left).agg(first.alias("_l"))
        by_right = open_.groupBy(*group, right).agg(first.alias("_r"))
        both = by_left.withColumn(right, F.col("_l.r")).join(by_right, [*group, right]).where(F.col("_l") == F.col("_r"))
        won = kept(both.select(*group, left, right, (-F.col("_l.s")).alias(score)), f"won-{k}")
        done = won if done is None else done.unionByName(won)
        k += 1
        open_ = kept(open_.join(won.select(*group, left), [*group, left], "left_anti").join(won.select(*group, right), [*group, right], "left_anti"), f"open-{k}")
    return ranked.limit(0) if done is None else done


def with_margin(pairs: DataFrame, group: str, left: str, right: str, score: str, margin: float, most: float) -> DataFrame:
    """group, left, right, score, rival, confidence, verdict: what becomes of each left of a group, whole groups at a time.

    Pairs come in the order of score (highest first), then left, then right. A pair whose sides are both free is MATCHED if its
    score leads the best rival (another right of its left that is still free) by `margin` at least; else its left is AMBIGUOUS and is
    frozen: it gets none of the others either. A left all of whose rights went to others is TAKEN (right null). confidence is the
    score, `most` at most: a likeness is a proposal and ranks under equal names and codes. Pairs without a score have no part.

    The pairs of a group follow each other in one task, dealt and sorted by group; keep a group to one document's candidates.
    """
    schema = {f.name: f.dataType for f in pairs.schema.fields}
    kinds = [*(to_arrow_type(schema[x]) for x in (group, left, right)), pa.float64(), pa.float64(), pa.float64(), pa.string()]
    names = [group, left, right, "score", "rival", "confidence", "verdict"]

    def decided(lefts: list, rights: list, scores: list) -> list[tuple]:
        """The rows of one group; its pairs come in order."""
        of: dict = {}
        for i, a in enumerate(lefts):
            of.setdefault(a, []).append(i)
        taken: set = set()
        done: dict = {}
        for a, b, s in zip(lefts, rights, scores, strict=True):
            if a in done or b in taken:
                continue
            rival = next((scores[j] for j in of[a] if rights[j] != b and rights[j] not in taken), 0.0)  # its pairs are in order of score
            if s - rival < margin:
                done[a] = (b, s, rival, None, "AMBIGUOUS")
            else:
                taken.add(b)
                done[a] = (b, s, rival, min(s, most), "MATCHED")
        return [(a, *done.get(a, (None, None, None, None, "TAKEN"))) for a in of]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put_out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        job, held, rows = None, ([], [], []), []
        for batch in batches:
            jobs, *columns = (batch.column(x).to_pylist() for x in (group, left, right, "_s"))
            heads = [0, *(i for i in range(1, len(jobs)) if jobs[i] != jobs[i - 1]), len(jobs)] if jobs else []
            for i, j in zip(heads, heads[1:], strict=False):
                if held[0] and jobs[i] != job:
                    rows += [(job, *x) for x in decided(*held)]
                    held = ([], [], [])
                job = jobs[i]
                for own, values in zip(held, columns, strict=True):
                    own += values[i:j]
            if rows:
                yield put_out(rows)
                rows = []
        if held[0]:
            yield put_out([(job, *x) for x in decided(*held)])

    given = pairs.where(F.col(score).isNotNull()).groupBy(group, left, right).agg(F.max(F.col(score).cast("double")).alias("_s"))
    dealt = given.repartition(F.col(group)).sortWithinPartitions(group, F.desc("_s"), left, right)
    types = {x: schema[x].simpleString() for x in (group, left, right)}
    return dealt.mapInArrow(work, f"{group} {types[group]}, {left} {types[left]}, {right} {types[right]}, score double, rival double, confidence double, verdict string")
