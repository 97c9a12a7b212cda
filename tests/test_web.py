"""The web of traces against a plain fold over runs in order."""

import math
from collections import defaultdict

from pyspark.sql import functions as F

from trailmill.functions.geo import EARTH_M
from trailmill.operators import web


def folded(runs):
    """runs: [(run_id, [parts])] in order; [(run_id, wear, [(lat, lng)])] by marking ground sample by sample."""
    rad = math.pi / 180
    first = next(line[0] for _, parts in runs for line in parts if len(line) > 1)
    kx, ky = EARTH_M * rad * math.cos(first[0] * rad) / 10, EARTH_M * rad / 10
    cell = lambda p: (math.floor(p[1] * kx), math.floor(p[0] * ky))
    wide = lambda c: {(c[0] + a, c[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)}
    sampled = []
    for run, parts in runs:
        out, at = [], 0.0
        for line in parts:
            if len(line) < 2:
                continue
            out.append((line[0], at, True))
            for a, b in zip(line, line[1:], strict=False):
                d = math.hypot((b[1] - a[1]) * math.cos((a[0] + b[0]) / 2 * rad), b[0] - a[0]) * rad * EARTH_M
                n = max(1, math.ceil(d / 4))
                out += [((a[0] + (b[0] - a[0]) * k / n, a[1] + (b[1] - a[1]) * k / n) if k < n else b, at + d * k / n, False) for k in range(1, n + 1)]
                at += d
        sampled.append((run, out))
    passes = defaultdict(int)
    for _, out in sampled:
        for c in set().union(*(wide(cell(p)) for p, _, _ in out)):
            passes[c] += 1
    drawn, lines = set(), []
    for run, out in sampled:
        steps = [0 if passes[cell(p)] <= 1 else min(4, math.ceil(math.log2(passes[cell(p)]))) for p, _, _ in out]
        i = 0
        while i < len(steps):
            j = i
            while j < len(steps) and steps[j] == steps[i]:
                j += 1
            if j - i < 5:
                steps[i:j] = [steps[i - 1] if i else steps[j] if j < len(steps) else steps[i]] * (j - i)
            i = j
        settled, piece, step = 0, [], None

        def flush(run=run):
            nonlocal piece
            if len(piece) > 1:
                lines.append((run, web.WEAR[step], piece))
            piece = []

        for i, (p, at, head) in enumerate(out):
            while settled < i and out[settled][1] < at - 40:
                drawn |= wide(cell(out[settled][0]))
                settled += 1
            if head:
                flush()
            if cell(p) in drawn:
                if piece:
                    piece.append(p)
                flush()
            elif not piece:
                piece, step = ([out[i - 1][0]] if i and not head else []) + [p], steps[i]
            elif steps[i] != step:
                piece.append(p)
                flush()
                piece, step = [p], steps[i]
            else:
                piece.append(p)
        flush()
        for p, _, _ in out:
            drawn |= wide(cell(p))
    return lines


def line(*spots):
    """Spots in metres around a place, as (lat, lng)."""
    return [(48.0 + y / 111_195, 11.0 + x / (111_195 * math.cos(math.radians(48)))) for x, y in spots]


RUNS = [
    (1, [line((0, 0), (300, 0), (300, 200))]),
    (2, [line((0, 3), (150, 3), (150, 300))]),
    (3, [line((-100, 0), (0, 0), (300, 0)), line((500, 500)), line((600, 600), (700, 600))]),
    (4, [line(*[(100 * math.cos(a / 8), 100 * math.sin(a / 8)) for a in range(110)])]),  # twice around
    (5, [line((0, 100), (200, 100), (200, 106), (0, 106))]),  # there and back beside
    (6, [line((0, 0), (3, 0))]),
    (7, [line((0, 0), (300, 0)), line((305, 0), (340, 0))]),
]


def frame(spark, users):
    rows = [(u, run, f"2024-01-{run:02d}", p, s, float(a), float(b)) for u, runs in users.items() for run, parts in runs for p, part in enumerate(parts) for s, (a, b) in enumerate(part)]
    return spark.createDataFrame(rows, "user_id int, run_id int, started_at string, part int, seq int, lat double, lng double").repartition(3)


def test_pieces_like_a_fold(spark):
    users = {1: RUNS, 2: RUNS[3:4], 3: RUNS[1:5]}
    found = defaultdict(list)
    for r in web.pieces(frame(spark, users)).collect():
        found[r["user_id"]].append((r["run_id"], r["wear"], [(round(p["lat"], 9), round(p["lng"], 9)) for p in r["points"]]))
    for u, runs in users.items():
        want = [(run, wear, [(round(a, 9), round(b, 9)) for a, b in piece]) for run, wear, piece in folded(runs)]
        assert sorted(found[u]) == sorted(want), u
    assert {w for _, w, _ in found[1]} > {web.WEAR[0], web.WEAR[1]}


def test_smoothing(spark):
    cases = {1: [0] * 3 + [1] * 2 + [0] * 6 + [2] * 4 + [1] * 5, 2: [3, 3], 3: [0, 1, 0, 1, 0], 4: [2] * 5 + [0] * 4, 5: [1] * 4 + [0] * 9}
    df = spark.createDataFrame([(1, run, i, s) for run, steps in cases.items() for i, s in enumerate(steps)], "user_id int, run_id int, i int, step int")
    found = defaultdict(list)
    for r in web.smoothed(df).orderBy("i").collect():
        found[r["run_id"]].append(r["step"])
    assert found == {1: [1] * 5 + [0] * 6 + [0] * 4 + [1] * 5, 2: [3, 3], 3: [1] * 5, 4: [2] * 9, 5: [0] * 13}


def test_wear_steps(spark):
    given = {1: 0, 2: 1, 3: 2, 4: 2, 5: 3, 8: 3, 9: 4, 1000: 4}
    rows = spark.createDataFrame([(n,) for n in given], "n int").select("n", web.wear_step(F.col("n")).alias("s")).collect()
    assert {r["n"]: r["s"] for r in rows} == given


def test_an_edited_run_takes_the_place_of_the_stored_one(spark):
    stored, fresh = frame(spark, {1: RUNS[:3], 2: RUNS[:1]}), frame(spark, {1: [(2, RUNS[5][1])]})
    runs = web.with_run(stored, fresh)
    assert {(r["user_id"], r["run_id"], r["n"]) for r in runs.groupBy("user_id", "run_id").agg(F.count("*").alias("n")).collect()} == {(1, 1, 3), (1, 2, 2), (1, 3, 6), (2, 1, 3)}
    assert web.pieces(stored.limit(0)).count() == 0
