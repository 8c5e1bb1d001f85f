import hashlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from lettera.llm import vector_codes as V

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, id string, k0 int, x int, codes string, error string, v int, g int"


def by_hand(rows, rounds=4, parts=4, entries=256):
    """(vec_id, label, code, error) and the codebooks, in Python's integers and by comparing all with all. rows: (vec_id, vector, label)."""
    kept = [(i, [int(np.floor(float(np.float32(x)) * 1024)) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    fits = [r for r in kept if r[1] and len(r[1]) % parts == 0]
    kept = [r for r in kept if fits and len(r[1]) == len(fits[0][1])]
    if not kept:
        return [], []
    d = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * d : p * d + d]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    for r in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda j: (far(cut(v, p), books[p][j]), j)) for p in range(parts)] for _, v, _ in kept]
        if r == rounds:
            break
        for p in range(parts):
            of = defaultdict(list)
            for (_, v, _), c in zip(kept, codes):
                of[c[p]].append(cut(v, p))
            for j, vs in of.items():
                books[p][j] = [sum(x) // len(vs) for x in zip(*vs)]
    return [(i, g, bytes(c).hex(), sum(far(cut(v, p), books[p][c[p]]) for p in range(parts))) for (i, v, g), c in zip(kept, codes)], books


def rows_of(kind, rng):
    if kind == "odd":
        some = [(i, [float(x) for x in rng.integers(-2, 3, 8) / 4], i % 3 if i % 4 else None) for i in range(60)]
        bad = [(70, None, 1), (71, [1.0, None, 2.0, 3.0, 1.0, 1.0, 1.0, 1.0], 1), (72, [NAN] * 8, 1), (73, [1.0] * 7 + [-INF], 1), (-1, [], 1), (-2, [1.0] * 7, 1), (74, [1.0] * 12, 1)]
        return some + some[:9] + bad + [(None, [0.25] * 8, 2), (None, [0.25] * 8, 2), (5, [-9.0] * 8, 2)]
    if kind == "ties":
        return [(i, [float(x) for x in rng.integers(0, 2, 4) / 1024], i % 2) for i in range(80)]
    if kind == "large":
        return [(i, [float(x) for x in rng.normal(0, 40_000, 16)], 1) for i in range(50)]
    centre = rng.normal(0, 1, (12, 16))
    return [(i, [float(x) for x in centre[i % 12] + rng.normal(0, 0.2, 16)], i % 5) for i in range(500)]


@pytest.mark.parametrize("kind, entries, rounds", [("odd", 256, 4), ("odd", 7, 4), ("ties", 5, 4), ("large", 9, 4), ("groups", 40, 4), ("groups", 3, 0)])
def test_against_all_with_all(spark, kind, entries, rounds):
    rows = rows_of(kind, np.random.default_rng(1))
    df = spark.createDataFrame([(*r, "i", 1, 2, "c", "e", 3, 4) for r in rows], SCHEMA).repartition(3)
    got, books = V.compress(df, keep=("label",), entries=entries, rounds=rounds)
    want, want_books = by_hand(rows, rounds, entries=entries)
    assert [b.tolist() for b in books] == want_books
    assert sorted(str((r.id, r.k0, bytes(r.codes).hex(), r.error)) for r in got.collect()) == sorted(map(str, want))


def test_nothing_is_left(spark):
    for rows in ([], [(1, None, 1), (2, [NAN] * 4, 1), (3, [1.0, 2.0], 1), (4, [], 1)]):
        got, books = V.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), keep=("label",))
        assert got.count() == 0 and books == [] and "error" in got.columns


def test_too_large_is_told(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="a component is over"):
        V.compress(df)


def test_bounds_hold_and_prune():
    """Through rounds of moving entries: bounds stay on their side of the exact distances, also packed, and distances are worked out for few."""
    rng = np.random.default_rng(2)
    centre = rng.normal(0, 300, (64, 16))
    x = (centre[rng.integers(0, 64, 4000)] + rng.normal(0, 40, (4000, 16))).astype(np.int64)
    c = x[:64].copy()
    codes, upper, lower, seen = np.zeros(4000, np.int64), np.full(4000, np.inf), np.zeros((4000, 64)), []
    for _ in range(5):
        seen.append(V.assign(x, c, *V.halves(c), codes, upper, lower) / (4000 * 64))
        exact = V.squared_all(x, c)
        assert (codes == exact.argmin(1)).all()
        own = np.sqrt(exact[np.arange(4000), codes])
        lower = V.unpack(V.pack(lower, upper), upper, 64)
        assert (upper >= own).all() and (lower <= np.sqrt(exact) * (1 + 1e-15)).all()
        new = np.array([x[codes == j].sum(0) // max(1, (codes == j).sum()) if (codes == j).any() else c[j] for j in range(64)])
        step = V.over(V.squared(c, new))
        upper, lower, c = upper + step[codes], np.maximum(lower - step, 0), new
    assert seen[-1] < 0.02 < seen[0]


def test_query_against_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        con = duckdb.connect()
        con.sql(f"create view embeddings as from '{sf}/embeddings.parquet'")
        want, got = con.sql(V.OP11_SQL), V.op11_vector_codes(spark, sf)
        names = sorted(got.columns)
        assert sorted(str(tuple(r)) for r in got.select(names).collect()) == sorted(map(str, want.select(", ".join(names)).fetchall()))


def test_query_by_hand(spark, tmp_path):
    """The query's own columns, with null labels together."""
    rows = rows_of("odd", np.random.default_rng(3))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    want, books = by_hand(rows)
    sums = defaultdict(int)
    for _, g, _, e in want:
        sums[g] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    got = V.op11_vector_codes(spark, str(tmp_path)).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(str((i, c, e, sums[g], sha)) for i, g, c, e in want)
