"""Low-rank adapters derived from document embeddings by hashing, in long form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.hashing import FNV_PRIME, FNV_SEED, MASK
from foliant.functions.vectors import dot
from foliant.operators.embedding import hash_project

# Fixed values.
RANK, ALPHA = 8, 16
SCALE = ALPHA / RANK * 0.04
B_SCALE = 0.1
#: Matrices that a task holds before it hands them on.
FRAMES = 128


def seed_of(name: str, seed: int = FNV_SEED) -> int:
    h = seed
    for c in name:
        h = ((h ^ ord(c)) * FNV_PRIME) & MASK
    return h


def dimensions(hidden: int, heads: int, kv_heads: int, head_dim: int | None = None) -> dict[str, tuple[int, int]]:
    """(inputs, outputs) of each projection; the query's output also holds its gate."""
    head = head_dim or hidden // heads
    return {"q": (hidden, 2 * hidden), "k": (hidden, kv_heads * head), "v": (hidden, kv_heads * head), "o": (heads * head, hidden)}


def derive(metas: DataFrame, *, layers: int, hidden: int, heads: int, kv_heads: int, head_dim: int | None = None, rank: int = RANK) -> DataFrame:
    """(doc_id, layer, proj, mat, i, j, value, weight) from (doc_id, meta, weight): A is rank x inputs, B outputs x rank.

    A task makes one matrix pair of one document, so models of any depth are spread evenly.
    """
    dims = dimensions(hidden, heads, kv_heads, head_dim)
    spark = metas.sparkSession
    places = spark.createDataFrame([(layer, p) for layer in range(layers) for p in dims], "layer int, proj string")
    work = metas.select("doc_id", "meta", "weight").crossJoin(F.broadcast(places))  # layers x 4 rows

    def run(parts):
        for part in parts:
            frames = []
            for d, v, w, layer, p in zip(part["doc_id"], part["meta"], part["weight"], part["layer"], part["proj"], strict=True):
                v, (n_in, n_out), own = np.asarray(v, np.float64), dims[p], seed_of(f"layer_{layer}")
                a = np.stack([hash_project(v, n_in, seed_of(f"A{r}", seed_of(f"{p}_A", own))) for r in range(rank)])
                b = np.stack([hash_project(v, n_out, seed_of(f"B{r}", seed_of(f"{p}_B", own))) for r in range(rank)], axis=1) * B_SCALE
                for name, m in (("A", a), ("B", b)):
                    i, j = np.indices(m.shape)
                    frames.append(pd.DataFrame({"doc_id": d, "layer": layer, "proj": p, "mat": name, "i": i.ravel(), "j": j.ravel(), "value": m.ravel().astype(np.float64), "weight": w}))
                if len(frames) >= FRAMES:
                    yield pd.concat(frames)
                    frames = []
            yield pd.concat(frames) if frames else pd.DataFrame(columns=["doc_id", "layer", "proj", "mat", "i", "j", "value", "weight"])

    return work.mapInPandas(run, "doc_id long, layer int, proj string, mat string, i int, j int, value double, weight double")


def combine(adapters: DataFrame) -> DataFrame:
    """The weighted mean of all documents' matrices, element by element."""
    return adapters.groupBy("layer", "proj", "mat", "i", "j").agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("value"))


def apply_delta(y: Column, x: Column, a_rows: Column, b_rows: Column, scale: float = SCALE) -> Column:
    """y + scale * B (A x); y as it is where the sizes do not fit."""
    fits = (F.size(F.get(a_rows, F.lit(0))) == F.size(x)) & (F.size(b_rows) == F.size(y))
    ax = F.transform(a_rows, lambda r: dot(r, x))
    return F.when(F.coalesce(fits, F.lit(False)), F.zip_with(y, b_rows, lambda v, r: v + F.lit(scale) * dot(r, ax))).otherwise(y)


def memory_bytes(adapters: DataFrame) -> DataFrame:
    return adapters.groupBy("doc_id").agg((F.count(F.lit(1)) * 4).alias("bytes"))


def matrices(adapters: DataFrame, scale: float = SCALE) -> dict[int, dict[str, tuple[float, np.ndarray, np.ndarray]]]:
    """One combined adapter (layer, proj, mat, i, j, value) as ``Decoder.with_adapter`` takes it; a model's worth goes to the driver."""
    out: dict[int, dict[str, tuple[float, np.ndarray, np.ndarray]]] = {}
    rows = adapters.select("layer", "proj", "mat", "i", "j", "value").toPandas()
    for (layer, proj), part in rows.groupby(["layer", "proj"]):
        both = []
        for name in "AB":
            own = part[part["mat"] == name]
            m = np.zeros((own["i"].max() + 1, own["j"].max() + 1))
            m[own["i"], own["j"]] = own["value"]
            both.append(m)
        out.setdefault(int(layer), {})[proj] = (scale, *both)
    return out
