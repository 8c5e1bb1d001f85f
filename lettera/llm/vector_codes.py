"""Vectors as short codes: a codebook for each of a few equal parts, fitted by Lloyd's rounds with Elkan's bounds.

All is decided on integers. Of each part of a vector a table in the shared folder keeps, from round to round, its entry, an upper bound
of the distance to it and one lower bound for each entry of the codebook. An entry is passed over only if a bound is strictly
greater than the upper one, so that no tie is lost; what is not passed over is compared by exact squared distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, read_table, removed, shared_path, shuffled, small_batches, small_or_not

#: Rows worked on at once; steps of a lower bound above the upper one, each a sixteenth of that; what makes a rounded bound safe.
ROWS, STEPS, SAFE = 2000, 15, 1e-12
FAR = np.iinfo(np.int64).max


def squared_all(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all of c. Products of floats are exact while they fit their 53 bits."""
    most = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    kind = np.float64 if most * most * x.shape[1] < 1 << 53 else np.int64
    return (x * x).sum(1)[:, None] - 2 * (x.astype(kind) @ c.T.astype(kind)).astype(np.int64) + (c * c).sum(1)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def over(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 + SAFE)


def under(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 - SAFE)


def halves(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half the distance of any two entries, rounded down, an entry to itself as infinite; and the least of each."""
    gaps = under(squared_all(c, c)) / 2
    np.fill_diagonal(gaps, np.inf)
    return gaps, gaps.min(1, initial=np.inf)


def pack(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Lower bounds in four bits each: whole sixteenths of the upper bound above it, rounded down; 0 is no bound."""
    step = np.where(upper > 0, upper, 16.0)[:, None] / 16
    q = np.clip(np.floor((lower - upper[:, None]) / step), 0, STEPS).astype(np.uint8)
    q = np.pad(q, ((0, 0), (0, q.shape[1] % 2)))
    return q[:, ::2] << 4 | q[:, 1::2]


def unpack(packed: np.ndarray, upper: np.ndarray, k: int) -> np.ndarray:
    q = np.stack([packed >> 4, packed & 15], 2).reshape(len(packed), -1)[:, :k]
    step = np.where(upper > 0, upper, 16.0)[:, None] / 16
    return np.where(q > 0, (upper[:, None] + q * step) * (1 - SAFE), 0.0)


def assign(x: np.ndarray, c: np.ndarray, gaps: np.ndarray, least: np.ndarray, codes: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
    """Sets codes, upper and lower (of moved entries, shifted already) to those of the nearest entries, the lower index at a tie. Gives the number of distances to other entries that it worked out."""
    work = np.flatnonzero(upper >= least[codes])
    if not len(work):
        return 0
    xs, own = x[work], codes[work]
    exact = squared(xs, c[own])
    up = over(exact)
    left = (lower[work] <= up[:, None]) & (gaps[own] <= up[:, None])
    left[np.arange(len(work)), own] = False
    found = np.full(left.shape, FAR)
    if (n := int(left.sum())) > left.size // 4:
        found, left[:] = squared_all(xs, c), True
    elif n:
        rows, js = np.nonzero(left)
        found[rows, js] = squared(xs[rows], c[js])
    found[np.arange(len(work)), own] = exact
    left[np.arange(len(work)), own] = True
    codes[work] = found.argmin(1)  # the first of equal ones
    upper[work] = over(found.min(1))
    lower[work] = np.where(left, under(found), lower[work])
    return n


def state_of(batch: pa.RecordBatch, parts: int, k: int) -> tuple[np.ndarray, ...]:
    """(components, codes, upper, lower) of the rows of a table that `passed` has written."""
    n, of = batch.num_rows, lambda c, kind: np.frombuffer(b"".join(batch[c].to_pylist()), kind)
    upper = of("upper", "<f8").reshape(n, parts).copy()
    packed = of("lower", np.uint8).reshape(n, parts, -1)
    lower = np.stack([unpack(packed[:, p], upper[:, p], k) for p in range(parts)], 1)
    return of("x", "<i4").reshape(n, -1).astype(np.int64), of("codes", np.uint8).reshape(n, parts).astype(np.int64), upper, lower


def passed(rows: DataFrame, books: list[np.ndarray], before: list[np.ndarray] | None, last: bool) -> DataFrame:
    """rows with new codes and bounds, or the last time with codes and the sum of squared distances. before: the codebooks that the bounds hold for; without it there are none yet."""
    parts, (k, d) = len(books), books[0].shape
    pairs = [halves(c) for c in books]
    moves = [over(squared(b, c)) for b, c in zip(before, books)] if before else None
    carried = [f for f in rows.schema if f.name not in ("x", "codes", "upper", "lower")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                n = b.num_rows
                if moves:
                    x, codes, upper, lower = state_of(b, parts, k)
                else:
                    x, codes = b["x"].flatten().to_numpy(zero_copy_only=False).reshape(n, parts * d).astype(np.int64), np.zeros((n, parts), np.int64)
                    upper, lower = np.full((n, parts), np.inf), np.zeros((n, parts, k))
                total, packed = np.zeros(n, np.int64), []
                for p, c in enumerate(books):
                    own, code, up, low = x[:, p * d : p * d + d], codes[:, p].copy(), upper[:, p].copy(), lower[:, p]
                    if moves:
                        up += moves[p][code]
                        low = np.maximum(low - moves[p], 0)
                    assign(own, c, *pairs[p], code, up, low)
                    codes[:, p], upper[:, p] = code, up
                    if last:
                        total += squared(own, c[code])
                    else:
                        packed.append(pack(low, up))
                out = [b[f.name] for f in carried] + [pa.array([r.tobytes() for r in codes.astype(np.uint8)], pa.binary())]
                names = [f.name for f in carried] + ["codes"]
                if last:
                    yield pa.RecordBatch.from_arrays([*out, pa.array(total)], [*names, "error"])
                else:
                    more = (x.astype("<i4"), upper.astype("<f8"), np.stack(packed, 1))
                    yield pa.RecordBatch.from_arrays([*out, *(pa.array([r.tobytes() for r in m], pa.binary()) for m in more)], [*names, "x", "upper", "lower"])

    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in carried)
    return rows.mapInArrow(run, kept + ("codes binary, error long" if last else "codes binary, x binary, upper binary, lower binary"))


def moved(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a round: each entry the floor of the mean of its parts, unused ones as they were.

    A task sums its own rows; what is shuffled is a number for each component of each entry and task, and the driver gets as many as the codebooks have.
    """
    parts, (k, d) = len(books), books[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, k, d), np.int64), np.zeros((parts, k), np.int64)
        for b in batches:
            x = np.frombuffer(b"".join(b["x"].to_pylist()), "<i4").reshape(b.num_rows, parts, d)
            codes = np.frombuffer(b"".join(b["codes"].to_pylist()), np.uint8).reshape(b.num_rows, parts)
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                used, starts = np.unique(codes[order, p], return_index=True)
                if len(used):
                    sums[p, used] += np.add.reduceat(x[order, p].astype(np.int64), starts)
                    counts[p] += np.bincount(codes[:, p], minlength=k)
        p, e = np.nonzero(counts)
        for a in range(0, len(p), 256):
            at = (p[a : a + 256], e[a : a + 256])
            entry = np.repeat(at[0] * k + at[1], d)
            yield pa.RecordBatch.from_arrays([pa.array(entry.astype(np.int32)), pa.array(np.tile(np.arange(d, dtype=np.int32), len(at[0]))), pa.array(np.repeat(counts[at], d)), pa.array(sums[at].ravel())], ["entry", "pos", "n", "s"])

    whole = rows.select("x", "codes").mapInArrow(run, "entry int, pos int, n long, s long").groupBy("entry", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = [c.copy() for c in books]
    for r in whole.collect():  # parts x entries x components
        out[r.entry // k][r.entry % k, r.pos] = int(r.s) // r.n
    return out


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: Sequence[str] = (), rounds: int = 4, parts: int = 4, entries: int = 256, scale: int = 1024) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows, codebooks): rows has id, k0, k1, ... (the columns of keep), codes binary (an entry a part) and error, the sum of squared distances.

    Left out are rows whose vector is null or has null or non-finite components, and rows of another length
    than the first (by id) whose length is a positive multiple of parts; if none is left, rows is empty and so are the codebooks. The first `entries` rows
    by id, then components, are the codebooks' first entries (256 at most; fewer rows, fewer entries); null ids come last. Rows that repeat an id are rows of their own.
    Components of so large a size that squares would not fit 63 bits raise an error. Two tables of bounds are on
    disk at most, each of some half a byte a component and entry count; the driver holds codebooks alone.
    """
    spark, v = vectors.sparkSession, F.col("v")
    named = vectors.select(F.col(id_col).alias("id"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(vector_col).cast("array<double>").alias("v"))
    finite = named.where(v.isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    fits = finite.where((F.size("v") > 0) & (F.size("v") % parts == 0))
    first = fits.orderBy(F.asc_nulls_last("id"), "v").select(F.size("v").alias("n")).first()
    if first is None:
        nothing = fits.limit(0).drop("v").withColumns({"codes": F.lit(None).cast("binary"), "error": F.lit(None).cast("long")})
        return nothing, []
    n = first.n
    most = int((2.0**62 / n) ** 0.5) // 2
    whole = F.transform("v", lambda x: F.when(F.abs(x) * scale <= most, F.floor(x * scale)).otherwise(F.raise_error(F.lit(f"a component is over {most} / {scale}"))).cast("int"))
    rows = finite.where(F.size("v") == n).select("id", *(f"k{i}" for i in range(len(keep))), whole.alias("x"))
    seeds = np.array([r.x for r in rows.orderBy(F.asc_nulls_last("id"), "x").select("x").limit(entries).collect()], np.int64)
    books, before, held = list(np.split(seeds, parts, 1)), None, None
    with small_batches(spark):
        for _ in range(rounds):
            at = shared_path(spark, "vector-bounds")
            passed(rows, books, before, last=False).write.option("compression", "zstd").parquet(at)
            rows = spark.read.parquet(at)
            if held:
                removed(spark, held)
            held, before, books = at, books, moved(rows, books)
        at = shared_path(spark, "vector-codes")
        passed(rows, books, before, last=True).write.parquet(at)
    if held:
        removed(spark, held)
    return spark.read.parquet(at), books


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of `embeddings` with their errors, and the errors' sum over rows of the same label. Odd rows: see compress."""
    rows, books = compress(read_table(spark, sf_dir, "embeddings"), keep=("label",))
    text = ",".join(str(x) for c in books for x in c.ravel().tolist())
    sums = checkpointed(rows.groupBy("k0").agg(F.sum("error").alias("label_error")).select(F.col("k0").alias("g"), "label_error"))
    small = small_or_not(sums)
    both = rows.join(small if small is not sums else shuffled(sums), F.col("k0").eqNullSafe(F.col("g")))
    return both.select(F.col("id").alias("vec_id"), F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))


def _sql(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    """The same by comparing each part with each entry."""
    steps = [
        f"""e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 1024) AS BIGINT)) AS x FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"v AS MATERIALIZED (SELECT r, p, x[p * (len(x) // {parts}) + 1 : (p + 1) * (len(x) // {parts})] AS x FROM e, range({parts}) t(p))",
        f"b0 AS MATERIALIZED (SELECT p, r AS i, x AS c FROM v WHERE r < {entries})",
    ]
    for k in range(rounds + 1):
        nearest = "min({'d': CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'i': i})"
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, p, m.i AS i, m.d AS d FROM (SELECT r, p, {nearest} AS m FROM v JOIN b{k} USING (p) GROUP BY r, p))")
        if k < rounds:
            steps.append(f"s{k} AS (SELECT p, i, pos, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT p, i, unnest(x) AS y, generate_subscripts(x, 1) AS pos FROM a{k} JOIN v USING (r, p)) GROUP BY ALL)")
            steps.append(f"n{k} AS (SELECT p, i, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS c FROM s{k} GROUP BY p, i)")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT p, i, coalesce(n{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN n{k} USING (p, i))")
    return f"""WITH {", ".join(steps)},
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, i)) AS h FROM b{rounds}),
f AS (SELECT r, string_agg(lower(printf('%02x', i)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM f JOIN e USING (r), h"""


OP11_SQL = _sql()
