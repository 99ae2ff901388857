"""Line dedup, centroid clusters and spelling variants against brute force, edge rows included."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clearprose.llm import ball_tree, line_dedup, spelling

SCHEMA = "doc_id bigint, text string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(FOLD)


def brute_lines(rows, min_docs, min_chars, keep_first):
    holders, first = defaultdict(set), {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0])):
        for i, line in enumerate((t or "").split("\n")):
            k = line_key(line)
            if len(k) >= max(1, min_chars):
                holders[k].add(d)
                first.setdefault(k, (d, i))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        gone = [d is not None and len(holders.get(line_key(x), ())) >= min_docs and not (keep_first and first[line_key(x)] == (d, i)) for i, x in enumerate(lines)]
        out.append((d, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return Counter(out)


@pytest.fixture(scope="module")
def line_rows():
    rng = random.Random(1)
    common = ["All rights reserved.", "  ALL rights reserved.\t", "Menu", "É common Line", "é common line", " padded "]
    rows = []
    for i in range(60):
        lines = [rng.choice(common) if rng.random() < 0.5 else f"own line {rng.randrange(50)} {i}" for _ in range(rng.randint(1, 9))]
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "Menu\n\n\r\nMenu"), (104, "Menu\n" * 2000 + "x" * 300_000), (None, "Menu\nAll rights reserved.")]
    return rows


@pytest.mark.parametrize(("min_docs", "min_chars", "keep_first"), [(10, 1, False), (3, 5, True), (1, 1, False)])
def test_kept_lines(spark, line_rows, min_docs, min_chars, keep_first):
    rows = [*line_rows, line_rows[3], line_rows[3], line_rows[-3]]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("keep", F.lit(1)).withColumn("lines", F.lit("clash")).withColumn("n_gone", F.lit(2))
    told = line_dedup.kept_texts(docs, line_dedup.keep_bitmaps(docs, min_docs=min_docs, min_chars=min_chars, keep_first=keep_first))
    assert told.columns[:5] == docs.columns
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in told.collect()) == brute_lines(rows, min_docs, min_chars, keep_first)


def test_texts_of_one_id_have_bitmaps_of_their_own(spark):
    rows = [(i, "shared\nown") for i in range(5)] + [(5, "first\nshared"), (5, "shared\nsecond")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = line_dedup.kept_texts(docs, line_dedup.keep_bitmaps(docs, min_docs=6)).filter("doc_id = 5").collect()
    assert sorted(r.kept_text for r in got) == ["first", "second"]


def test_bitmaps_are_runs_of_kept_lines(spark):
    docs = spark.createDataFrame([(i, "a\nx\nx\nb\nx") for i in range(3)], SCHEMA)
    some = line_dedup.keep_bitmaps(docs.unionByName(spark.createDataFrame([(9, "x\nx")], SCHEMA)), min_docs=4)
    assert {(r.doc_id, r.n_lines, r.n_dropped, tuple(map(tuple, r.keep))) for r in some.collect()} == {*((i, 5, 3, ((0, 1), (3, 1))) for i in range(3)), (9, 2, 2, ())}


def test_line_dedup_runs_no_python_and_splits_a_shared_line(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("shared\nline "), F.col("id").cast("string")).alias("text"))
    told = line_dedup.kept_texts(docs, line_dedup.keep_bitmaps(docs))
    plan = told._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert told.filter("n_lines = 2 and n_dropped = 1").count() == 4000


def brute_clusters(rows, k, rounds, seed, size=64, scale=1024):
    kept = []
    for d, v in rows:
        if v is not None and len(v) == size and all(x is not None and np.isfinite(x) and abs(x) <= ball_tree.MOST for x in v):
            kept.append((d, [int(np.floor(scale * float(x))) for x in v]))
    if not kept:
        return []
    by_hash = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in by_hash[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    told = [(d, *nearest(v)) for d, v in kept]
    per = Counter()
    for _, dist, c in told:
        per[c] += dist
    digests = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in centroids]
    return [(d, c, dist, per[c], sum(per.values()), digests[c]) for d, dist, c in told]


VECTORS = "vec_id bigint, embedding array<float>, label int"


@pytest.mark.parametrize("tight", [0.02, 0.5])
def test_clusters(spark, monkeypatch, tight):
    monkeypatch.setattr(ball_tree, "TREE", 300)
    monkeypatch.setattr(ball_tree, "SUBTREE", 80)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 64))
    rows = [(i, (centres[i % 6] + tight * rng.standard_normal(64)).astype(np.float32).tolist(), i % 3) for i in range(700)]
    rows += [rows[5], rows[5], (800, None, 1), (801, [1.0] * 63, 1), (802, [float("nan")] * 64, 1), (803, [None] * 64, 1), (804, [1e30] * 64, 1), (805, [0.0] * 64, 2), (None, [0.25] * 64, 1), (806, [60_000.0] * 64, 1), (807, [-60_000.0] * 64, 1)]
    table = spark.createDataFrame(rows, VECTORS).repartition(3).withColumn("id", F.lit("clash")).withColumn("cluster", F.lit(1))
    got = ball_tree.cluster(table, rounds=4).collect()
    assert Counter(map(tuple, got)) == Counter(brute_clusters([r[:2] for r in rows], 8, 4, 3))


def test_few_vectors_and_none(spark):
    rows = [(1, [1.0] * 64, 1), (2, [2.0] * 64, 1)]
    assert Counter(map(tuple, ball_tree.cluster(spark.createDataFrame(rows, VECTORS)).collect())) == Counter(brute_clusters([r[:2] for r in rows], 8, 10, 3))
    assert ball_tree.cluster(spark.createDataFrame([], VECTORS)).collect() == []


def test_whole_balls_are_told_apart_exactly():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(-500, 500, (40, 8)) + 5000 * c for c in range(4)])
    order, balls = ball_tree.grown(x, 0, len(x), ball_tree.LEAF)
    assert sorted(order.tolist()) == list(range(len(x)))
    ends = np.array([(b.start, b.end) for b in balls]).reshape(-1)
    told = np.array([b.radius for b in balls]).tobytes() + np.array([b.sum for b in balls]).tobytes()
    tree = ball_tree.Subtree(None, x[order].astype(np.int32).tobytes(), ends, [s for b in balls for s in (b.left, b.right)], told, 8)
    centroids = np.array([[5000 * c] * 8 for c in range(4)])
    whole, rest, nearest = tree.assigned(centroids)
    want = ball_tree.squared(x[order], centroids).argmin(axis=1)
    assert sum(tree.ends[b, 1] - tree.ends[b, 0] for b, _ in whole) > 100
    assert all((want[tree.ends[b, 0] : tree.ends[b, 1]] == c).all() for b, c in whole) and (want[rest] == nearest).all()
    for b in balls:
        assert (np.sqrt(((x[order][b.start : b.end] - b.centre) ** 2).sum(axis=1)) <= b.radius).all()


def brute_variants(rows, min_chars=7, min_count=2):
    n = Counter()
    for d, t in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_chars:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= min_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found = {}
    for w in n:
        mates = sorted((-n[v], v) for v in n if v != w and near(w, v))
        found[w] = (mates[0][1] if mates and -mates[0][0] >= 10 * n[w] else None, len(mates))
    out = {}
    for w, (form, many) in found.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        out[w] = (form, root, n[w], many, n[form] if form else None)
    return out


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(8)
    letters = "abcdefgh" + "éÉßÿ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 11))) for _ in range(60)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(60):
            w = rng.choice(base[: rng.randint(1, 60)])
            if rng.random() < 0.15:
                at, kind = rng.randrange(len(w)), rng.randrange(3)
                w = w[:at] + ("" if kind == 0 else rng.choice("ab")) + w[at + (kind < 2) :]
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((i, " ".join(words)))
    rows += [(500, None), (501, ""), (502, "short words"), (None, "onlyhere onlyhere onlyherf"), (503, "a" * 100_000 + " " + "a" * 99_999 + "b " + "a" * 100_000 + " " + "a" * 99_999 + "b"), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("block", [4096, 16])
def test_variants(spark, monkeypatch, spelled, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "GROUP", 500)
    docs = spark.createDataFrame(spelled, SCHEMA).repartition(3).withColumn("word", F.lit("clash")).withColumn("h", F.lit(1))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs).collect()}
    want = brute_variants(spelled)
    assert got == want and len(want) > 300
    assert sum(1 for f in want.values() if f[0]) > 20
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0


def test_words_that_differ_in_any_letter_are_near(spark):
    letters = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
    rows = [(i, f"{w} {w}") for i, w in enumerate(["zornigeste", *(f"zornige{c}ste" for c in letters), *(f"zor{c}igeste" for c in letters if c != "n")])]
    got = {r.word: r.n_near for r in spelling.variants(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {w: f[3] for w, f in brute_variants(rows).items()} and len(got) > 170


def test_roots_follow_chains(spark):
    from clearprose.llm.tables import Workspace

    rows = [(f"w{i}", f"w{i + 1}") for i in range(9)] + [("x", "y")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(rows, "word string, form string"), Workspace(spark, "test")).collect()}
    assert got == {**{f"w{i}": "w9" for i in range(9)}, "x": "y"}


def test_masks_of_words_one_edit_apart_share_a_band():
    rng = random.Random(3)
    letters = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
    for _ in range(300):
        w = [rng.choice(letters) for _ in range(rng.randint(1, 12))]
        v, at = list(w), rng.randrange(len(w))
        kind = rng.randrange(3)
        v[at : at + (kind < 2)] = [] if kind == 0 else [rng.choice(letters)]
        m = spelling.masks(*spelling.latin(pa.array(["".join(w), "".join(v)])))
        assert (m[:, 0] == m[:, 1]).any() and np.bitwise_count(m[:, 0] ^ m[:, 1]).sum() <= 2


def test_words_one_edit_apart_share_a_half_and_others_seldom_meet():
    rng = random.Random(4)
    letters = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
    for _ in range(300):
        w = [rng.choice(letters) for _ in range(rng.randint(1, 12))]
        v, at = list(w), rng.randrange(len(w))
        kind = rng.randrange(2)
        v[at : at + kind] = [rng.choice(letters)]
        own, other = zip(*(spelling.bands(*spelling.latin(pa.array(["".join(x)])), longer) for x, longer in ((w, False), (v, not kind))), strict=True)
        equal = (own[0] == own[1]).all(axis=0)[0]
        flips = np.bitwise_count(other[0] ^ other[1]).sum(axis=0)[0]
        assert v == w or (equal & (flips == 1 + kind)).any()
    # words of the same few letters: slices of the alphabet tell few of them apart
    words = sorted({"".join(rng.choice("etaoinsh") for _ in range(10)) for _ in range(2000)})
    own, _ = spelling.bands(*spelling.latin(pa.array(words)), False)
    pairs = sum(int((n * (n - 1) // 2).sum()) for b in (0, 1) for n in [np.unique(own[:, :, b], axis=1, return_counts=True)[1]])
    whole = spelling.masks(*spelling.latin(pa.array(words)))
    assert 4 * pairs < sum(int((n * (n - 1) // 2).sum()) for b in range(3) for n in [np.unique(whole[b], return_counts=True)[1]])
