"""A net that grows with a stream: keyed state by landmark cell.

Each row of the stream goes to the cell of its nearest landmark. The cell's state
holds its representatives; a row within delta of one joins the nearest, another
becomes one itself. A task streams the rows of a cell and holds its representatives
only. Rows farther from all landmarks than the novelty radius (the larger of delta
and the landmarks' median nearest distance) are marked: they ask for new landmarks.

Every micro-batch writes a folder of its own, so a batch that is run again after a
failure overwrites itself; with the same folder a new query goes on where the last
one stopped. Rows that come twice count twice. Landmarks are few and ride with the
tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Landmarks of a stream at most.
MOST_LANDMARKS = 4096
ROWS = "id long, rep long, l long, d double, spawned boolean, novel boolean"


def novelty_radius(x: np.ndarray, delta: float) -> float:
    """The larger of delta and the lower median nearest distance of landmarks."""
    if len(x) < 2:
        return max(delta, 0.0)
    near = [np.delete(((x - v) ** 2).sum(1), k).min() ** 0.5 for k, v in enumerate(x)]
    return max(delta, sorted(near)[(len(near) - 1) // 2])


@dataclass(frozen=True)
class CellNet:
    """A net at ``delta`` over ``landmarks`` (id, v), kept below the folder ``uri``."""

    spark: SparkSession
    uri: str
    landmarks: DataFrame
    delta: float

    def start(self, stream: DataFrame) -> StreamingQuery:
        """Take in all that ``stream`` (id, v) has now, then stop."""
        marks = self.landmarks.select("id", "v").limit(MOST_LANDMARKS + 1).collect()
        if not 0 < len(marks) <= MOST_LANDMARKS:
            raise ValueError(f"between 1 and {MOST_LANDMARKS} landmarks are needed")
        marks.sort(key=lambda r: r.id)
        ids, x, delta = np.array([r.id for r in marks]), np.array([r.v for r in marks], float), self.delta
        novel, uri = novelty_radius(x, delta), self.uri

        def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    v = np.array(f["v"].tolist(), float)
                    d = np.array([((x - row) ** 2).sum(1) for row in v]) ** 0.5
                    yield pd.DataFrame({"id": f["id"], "v": f["v"], "l": ids[d.argmin(1)], "novel": d.min(1) > novel})

        def absorb(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            reps, at = [], []
            if state.exists:
                held_ids, held = state.get
                reps = np.frombuffer(held_ids, "<i8").tolist()
                at = list(np.frombuffer(held, "<f8").reshape(len(reps), -1))
            for f in frames:
                f = f.sort_values("id", kind="stable")
                out = []
                for i, v in zip(f["id"].tolist(), np.array(f["v"].tolist(), float), strict=True):
                    d = ((np.array(at) - v) ** 2).sum(1) ** 0.5 if reps else np.array([np.inf])
                    k = int(d.argmin())
                    if d[k] <= delta:
                        out.append((i, reps[k], float(d[k]), False))
                    else:
                        reps.append(i)
                        at.append(v)
                        out.append((i, i, 0.0, True))
                rows = pd.DataFrame(out, columns=["id", "rep", "d", "spawned"])
                yield rows.assign(l=key[0], novel=f["novel"].to_numpy())[["id", "rep", "l", "d", "spawned", "novel"]]
            state.update((np.array(reps, "<i8").tobytes(), np.array(at, "<f8").tobytes()))

        def write(rows: DataFrame, batch: int) -> None:
            rows.write.mode("overwrite").parquet(f"{uri}/members/batch={batch}")

        placed = stream.select("id", "v").mapInPandas(place, "id long, v array<double>, l long, novel boolean")
        kept = placed.groupBy("l").applyInPandasWithState(absorb, ROWS, "ids binary, at binary", "append", GroupStateTimeout.NoTimeout)
        return kept.writeStream.foreachBatch(write).option("checkpointLocation", f"{uri}/checkpoint").trigger(availableNow=True).start()

    def members(self) -> DataFrame:
        return self.spark.read.schema(f"{ROWS}, batch int").parquet(f"{self.uri}/members")

    def report(self) -> DataFrame:
        """Rows, spawned representatives, absorbed and novel rows of each batch."""
        n = lambda c, name: F.count_if(c).alias(name)
        return self.members().groupBy("batch").agg(F.count("*").alias("n"), n(F.col("spawned"), "spawned"), n(~F.col("spawned"), "absorbed"), n(F.col("novel"), "novel"))
