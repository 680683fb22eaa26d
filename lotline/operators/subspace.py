"""Principal components, kernel components and randomized SVD from distributed cross-products."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gram import factor, gram
from .sample import exact_sample


def pca(df: DataFrame, columns: dict[str, Column], k: int = 0, standardize: bool = True) -> dict:
    """Loadings on centred (and scaled) columns; k = 0 keeps singular values over the square root of a third of the mean."""
    names = list(columns)
    g = gram(df, columns)
    s, mean = g.centred(names)
    scale = np.sqrt(np.diag(s) / (g.n - 1)) if standardize else np.ones(len(names))
    scale = np.where(scale > 0, scale, 1.0)
    values, vectors = np.linalg.eigh(s / np.outer(scale, scale) / (g.n - 1))
    order = np.argsort(-values)
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    k = k or max(1, int((np.sqrt(values) > 1 / math.sqrt(3)).sum()))
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(names))])
    return {"names": names, "mean": mean, "scale": scale, "values": values[:k], "loadings": (vectors * signs)[:, :k]}


def projected(df: DataFrame, columns: dict[str, Column], parts: dict, prefix: str = "pc") -> DataFrame:
    """Adds the components as expressions; nothing is shuffled."""
    out = []
    for j in range(parts["loadings"].shape[1]):
        terms = [(columns[n] - float(m)) * float(v / s) for n, m, s, v in zip(parts["names"], parts["mean"], parts["scale"], parts["loadings"][:, j])]
        out.append(sum(terms[1:], terms[0]).alias(f"{prefix}{j}"))
    return df.select("*", *out)


def kernel_components(df: DataFrame, key: str, names: list[str], k: int, kernel: str = "radial", rows: int = 500) -> DataFrame:
    """Components of a kernel matrix against a stated number of sampled rows, for all rows.

    The sample (rows * columns numbers) goes to the tasks; each batch becomes a
    block of the kernel matrix. A radial scale begins at 1 and is doubled, at most
    five times, while the range of the kernel's eigenvalues is under one and a
    half times their middle.
    """
    sample = exact_sample(df.select(key, *names), key, rows).toPandas()[names].to_numpy(float)
    mean, sd = sample.mean(0), np.where(sample.std(0) > 0, sample.std(0), 1.0)
    s = (sample - mean) / sd

    def block(x: np.ndarray, scale: float) -> np.ndarray:
        if kernel == "quadratic":
            return (x @ s.T + 2) ** 2
        d = np.maximum((x * x).sum(1)[:, None] + (s * s).sum(1)[None] - 2 * x @ s.T, 0)
        return np.sqrt(d) if kernel == "l2" else np.exp(-d / scale)

    scale = 1.0
    if kernel == "radial":
        for _ in range(5):
            values = np.linalg.eigvalsh(block(s, scale))
            if values.max() - values.min() >= 1.5 * (values.max() + values.min()) / 2:
                break
            scale *= 2
    m = block(s, scale)
    centre = m.mean(0)
    c = m - centre[None] - (m.mean(1) - m.mean())[:, None]
    values, vectors = np.linalg.eigh((c + c.T) / 2)
    order = np.argsort(-np.abs(values))[:k]
    basis = vectors[:, order] / np.sqrt(np.maximum(np.abs(values[order]), 1e-12))

    def run(batches):
        for pdf in batches:
            x = (pdf[names].to_numpy(float) - mean) / sd
            b = block(x, scale)
            b = b - centre[None] - (b.mean(1) - m.mean())[:, None]
            out = pd.DataFrame(b @ basis, columns=[f"k{i}" for i in range(basis.shape[1])])
            out.insert(0, key, pdf[key].to_numpy())
            yield out

    kind = dict(df.dtypes)[key]
    return df.select(key, *names).mapInPandas(run, f"`{key}` {kind}, " + ", ".join(f"k{i} double" for i in range(basis.shape[1])))


#: Rows that a whole kernel matrix may be sketched over, and rows whose kernel values are held at once.
KERNEL_ROWS, KERNEL_BLOCK = 20_000, 256


def kernel(name: str):
    """Values of a kernel between rows (lines of two arrays): linear, quadratic, l2 or radial; with weights, radial distances are weighted by column."""

    def distance(x, s, w):
        return np.maximum((x * x * w).sum(1)[:, None] + (s * s * w).sum(1)[None] - 2 * (x * w) @ s.T, 0)

    return {
        "linear": lambda x, s, w=1.0: x @ s.T,
        "quadratic": lambda x, s, w=1.0: (x @ s.T + 2) ** 2,
        "l2": lambda x, s, w=1.0: np.sqrt(distance(x, s, w)),
        "radial": lambda x, s, w=1.0: np.exp(-distance(x, s, w)),
    }[name]


def kernel_sketch(df: DataFrame, key: str, names: list[str], k: int, name: str = "radial", weights: np.ndarray | None = None, power: int = 4, seed: int = 0) -> tuple[np.ndarray, np.ndarray, list]:
    """(values, vectors, keys): the k eigenvalues of largest size of the kernel matrix of all rows, without that matrix.

    A block of random vectors is multiplied by the matrix a few times: each task
    makes KERNEL_BLOCK lines of it at a time, multiplies them and drops them. Rows
    (standardized, KERNEL_ROWS at most, else an error) and the block of vectors go
    to the tasks. Rows with nulls are left out; the work is the square of the rows.
    """
    held = df.select(key, *names).dropna().orderBy(key, *names).limit(KERNEL_ROWS + 1).toPandas()
    if len(held) > KERNEL_ROWS:
        raise ValueError(f"a kernel matrix of more than {KERNEL_ROWS} rows isn't sketched")
    x = held[names].to_numpy(float)
    x = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1.0) if len(x) else x
    w, sc = np.ones(len(names)) if weights is None else np.asarray(weights, float), df.sparkSession.sparkContext
    rows, blocks = sc.broadcast(x), -(-len(x) // KERNEL_BLOCK)

    def times(v: np.ndarray) -> np.ndarray:
        shared = sc.broadcast(v)

        def run(batches):
            f = kernel(name)
            for batch in batches:
                for b in batch.column(0).to_pylist():
                    mine = f(rows.value[b * KERNEL_BLOCK : (b + 1) * KERNEL_BLOCK], rows.value, w) @ shared.value
                    yield pa.RecordBatch.from_arrays([pa.array([b]), pa.array([mine.tobytes()], pa.binary())], names=["b", "v"])

        parts = df.sparkSession.range(0, blocks, 1, min(blocks, 4 * sc.defaultParallelism)).mapInArrow(run, "b long, v binary").collect()
        shared.destroy()
        return np.concatenate([np.frombuffer(r["v"]).reshape(-1, v.shape[1]) for r in sorted(parts, key=lambda r: r["b"])])

    if not len(x):
        return np.zeros(0), np.zeros((0, 0)), []
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(x), min(len(x), k + 8))))[0]
    for _ in range(power):
        q = np.linalg.qr(times(q))[0]
    m = q.T @ times(q)
    rows.destroy()
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    order = np.argsort(-np.abs(values))[:k]
    return values[order], q @ vectors[:, order], held[key].tolist()


def kernel_values(df: DataFrame, key: str, names: list[str], k: int, name: str = "quadratic") -> np.ndarray:
    """The k eigenvalues of largest size of the linear or quadratic kernel matrix of all rows, in two passes over them.

    Both kernels are products of features (for d columns d, or all products of
    two and all columns, (d + 1)(d + 2) / 2 with the constant), so the matrix of
    all rows has the squared singular values of the features' triangular factor,
    and zeros. Rows with nulls are left out; nothing grows with the rows.
    """
    if name not in ("linear", "quadratic"):
        raise ValueError(f"the {name} kernel has no finite features")
    rows = df.select(key, *names).dropna()
    g = gram(rows, {n: F.col(f"`{n}`") for n in names})
    if not g.n:
        return np.zeros(0)
    s, mean = g.centred(names)
    sd = np.sqrt(np.maximum(np.diag(s), 0) / g.n)
    sd = np.where(sd > 1e-14 * np.abs(mean), sd, 1.0)
    rows = rows.select(*(((F.col(f"`{n}`") - float(m)) / float(d)).alias(f"z{i}") for i, (n, m, d) in enumerate(zip(names, mean, sd))))
    z = [F.col(f"z{i}") for i in range(len(names))]
    columns = {f"f{i}": c for i, c in enumerate(z)}
    if name == "quadratic":
        pairs = [z[i] * z[j] * (1.0 if i == j else math.sqrt(2)) for i in range(len(z)) for j in range(i, len(z))]
        columns = {f"f{i}": c for i, c in enumerate([c * 2.0 for c in z] + pairs)}
    t = factor(rows, columns)
    r = np.vstack([t.r, math.sqrt(t.n) * t.mean])
    if name == "quadratic":
        r = np.hstack([r, np.append(np.zeros(len(t.r)), 2 * math.sqrt(t.n))[:, None]])
    values = np.linalg.svd(r, compute_uv=False) ** 2
    return np.append(values, np.zeros(k))[: min(k, round(t.n))]


def eigen_gaps(values: np.ndarray, spread: float, smallest: float) -> list[int]:
    """Places of eigenvalues (falling) that stand apart: under a share of the one before, with the next under that share of it, while over a share of the largest."""
    out, last = [], 2 * values[0] if len(values) else 0.0
    for i, now in enumerate(values):
        if now <= smallest * values[0]:
            break
        after = values[i + 1] if i + 1 < len(values) else 0.0
        if now / last < spread and after / now < spread:
            out.append(i)
        last = now
    return out


def random_combinations(columns: dict[str, Column], count: int, share: float = 0.2, pairs: bool = False, power: int = 1, rows: int | None = None, seed: int = 0) -> dict[str, Column]:
    """Sums of a random share of the columns (or of products of pairs of them) with random signs, raised to a power, as expressions.

    With pairs the share is at most 2 rows / columns^2. A draw without any column is left out.
    """
    r, names = np.random.default_rng(seed), list(columns)
    if pairs and rows is not None:
        share = min(share, 2 * rows / len(names) ** 2)
    parts = [columns[a] * columns[b] for i, a in enumerate(names) for b in names[i:]] if pairs else [columns[a] for a in names]
    out = {}
    for k in range(count):
        chosen, sign = r.random(len(parts)) < share, r.random(len(parts)) < 0.5
        terms = [p if s else -p for p, c, s in zip(parts, chosen, sign) if c]
        if terms:
            out[f"random{k}"] = F.pow(sum(terms[1:], terms[0]), F.lit(power)) if power > 1 else sum(terms[1:], terms[0])
    return out


def randomized_svd(df: DataFrame, columns: dict[str, Column], k: int, power: int = 2, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right vectors) by a random projection of the columns' triangular factor and power iterations.

    The factor comes from a tree over the rows and has the table's singular
    values without squaring them, so small ones keep their digits.
    """
    names = list(columns)
    t = factor(df, columns)
    r = np.linalg.qr(np.vstack([t.r, math.sqrt(t.n) * t.mean]), mode="r")
    q = np.linalg.qr(r @ np.random.default_rng(seed).standard_normal((len(names), min(len(names), k + 5))))[0]
    for _ in range(power):
        q = np.linalg.qr(r @ np.linalg.qr(r.T @ q)[0])[0]
    _, values, vectors = np.linalg.svd(q.T @ r, full_matrices=False)
    return values[:k], vectors[:k].T


def varimax(loadings: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Loadings turned so that their squares vary most within factors."""
    p, k = loadings.shape
    turn = np.eye(k)
    last = 0.0
    for _ in range(rounds):
        x = loadings @ turn
        u, d, v = np.linalg.svd(loadings.T @ (x**3 - x * (x**2).mean(0)))
        turn = u @ v
        if d.sum() < last * (1 + 1e-9):
            break
        last = d.sum()
    return loadings @ turn
