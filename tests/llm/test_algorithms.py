import random

import pyarrow as pa
import pytest

from millrace.llm import consolidate, format_dups, mixing, near_dups, packing

ROW = "id string, text string, _id int"  # an extra column with an awkward name


def brute_content(text):
    import re

    pieces = [p for p in re.split(r"[\n;|]", text) if any(c.isalnum() for c in p)]
    flat = lambda t: "".join(c for c in t.lower() if c.isalnum())
    label = re.compile(r"^[\W_]*[^\W\d_]+(?:\s+[^\W\d_]+){0,2}\s*[:=]")
    if len(pieces) >= 3 and all(label.match(p) for p in pieces):
        return tuple(sorted(map(flat, pieces)))
    return flat(text)


FIELDS = "Venue: Old Hall\nSeats: 120\nHost name: Ada"
TEXTS = [
    "The river rose by 3 metres overnight.", "the RIVER rose, by 3 metres - overnight", "The river rose by 4 metres overnight.",
    FIELDS, "host name = ADA | venue = old hall | seats=120", "seats: 120; Host  name:Ada; Venue: Old Hall", "Venue: Old Hall Seats: 120 Host name: Ada",
    "short one", "SHORT ONE", "", None, "Ο ΔΡΟΜΟΣ ΕΙΝΑΙ ΜΑΚΡΥΣ ΚΑΙ ΣΤΕΝΟΣ", "ο δρόμος είναι μακρύς", "ο δρομος ειναι μακρυς και στενος", "word " * 60_000, "WORD, " * 60_000,
]


def test_content_duplicates_against_brute_force(spark):
    rows = [(f"{i:02d}", t, i) for i, t in enumerate(TEXTS)] + [("00", TEXTS[0], 99), (None, TEXTS[0], 98)]
    df = spark.createDataFrame(rows, ROW)
    sets = {}
    for i, t, _ in rows[:-1]:
        key = brute_content(t or "")
        if len("".join(key).replace("ς", "σ")) >= 20:
            sets.setdefault(key if isinstance(key, tuple) else key.replace("ς", "σ"), set()).add(i)
    want = {(min(s), m) for s in sets.values() for m in s if m != min(s)}
    assert {(r.keep_id, r.copy_id) for r in format_dups.duplicate_members(df).collect()} == want
    copies = {r.keep_id: r.n_copies for r in format_dups.collapse(df).collect()}
    assert copies["00"] == 2 and copies["03"] == 3 and copies["07"] == 1 and len(copies) == len(TEXTS) - len(want)
    assert format_dups.duplicate_members(df.limit(0)).count() == 0


def test_content_shuffled_classes_give_the_same(spark, monkeypatch):
    rows = [(f"{i:03d}", "a hot group of copies with one text" + "!" * (i % 3) if i % 3 else f"text number {i} of the others", i) for i in range(120)]
    df = spark.createDataFrame(rows, ROW)
    a = {tuple(r) for r in format_dups.duplicate_members(df).collect()}
    monkeypatch.setattr(format_dups, "BROADCAST_CLASSES", 0)
    assert {tuple(r) for r in format_dups.duplicate_members(df).collect()} == a and len(a) == 79


def brute_groups(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {(find(x), x) for x in root if find(x) != x}


@pytest.mark.parametrize("bound", [2_000_000, 40])
def test_components_in_one_task_and_beyond_the_bound(spark, bound):
    rng = random.Random(5)
    links = [(f"r{rng.randrange(300)}", f"r{rng.randrange(300)}") for _ in range(170)] + [(f"c{i}", f"c{i + 1}") for i in range(30)]
    links += [("hub", f"h{i}") for i in range(60)] + [(None, "r1"), ("r2", None), ("r3", "r3")]
    df = spark.createDataFrame(links, "a string, b string").repartition(6)
    assert {(r.group_id, r.id) for r in consolidate.components(df, task_edges=bound).collect()} == brute_groups(links)


def test_no_task_of_consolidation_exceeds_its_bound(spark, tmp_path, monkeypatch):
    """One chain in order, one hub with a third of all rows and many pairs: far more linked ids than one task may hold."""
    bound, folder = 400, str(tmp_path)

    class Counted(consolidate._Trees):
        def __init__(self, ids, roots, level):
            import uuid

            super().__init__(ids, roots, level)
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(f"{len(self.ids)} {len(self.names)}")

    monkeypatch.setattr(consolidate, "_Trees", Counted)
    links = [(f"c{i:05}", f"c{i + 1:05}") for i in range(1200)] + [("hub", f"h{i}") for i in range(1300)] + [(f"p{i}", f"q{i}") for i in range(1000)]
    links += [("c00007", "h3"), ("q5", "q6"), ("hub", "h1")]
    df = spark.createDataFrame(links, "a string, b string").repartition(5)
    found = {(r.group_id, r.id) for r in consolidate.components(df, task_edges=bound).collect()}
    assert found == brute_groups(links) and len(found) > 5 * bound
    sizes = [int((tmp_path / f.name).read_text().split()[0]) for f in tmp_path.iterdir()]
    assert len(sizes) > 20 and max(sizes) <= 1.25 * bound  # hashed partitions are a little uneven


def test_components_of_nothing_and_record_links(spark):
    assert consolidate.components(spark.createDataFrame([], "a string, b string")).count() == 0
    pairs = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.49), ("d", "d", 0.9), (None, "e", 0.9), ("x", "y", None)], "id_a string, id_b string, similarity double")
    runs = spark.createDataFrame([([["m", "n", None, "o"], ["p"], []],), (None,), ([["n", "b"]],)], "clusters array<array<string>>")
    got = {(r.group_id, r.id) for r in consolidate.components(consolidate.record_links(pairs, runs)).collect()}
    assert got == {("a", "b"), ("a", "m"), ("a", "n"), ("a", "o")}


def brute_pairs(rows):
    import re

    grams = {}
    for i, t in rows:
        w = re.findall(r"[a-z0-9]+", (t or "").lower())
        if i is not None and len(w) >= 20:
            grams[i] = ({tuple(w[k : k + 3]) for k in range(len(w) - 2)}, brute_content(t))
    ids = sorted(grams)
    sim = lambda a, b: len(grams[a][0] & grams[b][0]) / len(grams[a][0] | grams[b][0])
    return {(a, b): sim(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if grams[a][1] != grams[b][1] and sim(a, b) >= 0.5}


@pytest.mark.parametrize("hot", [256, 6])
def test_near_duplicates_against_brute_force(spark, hot):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for f in range(12):
        base = [rng.choice(words) for _ in range(rng.randrange(25, 120))]
        for _ in range(rng.choice((1, 2, 9))):
            t = list(base)
            for _ in range(len(t) // 14):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((f"{len(rows):03d}", " ".join(t)))
        rows.append((f"{len(rows):03d}", "  ".join(base).upper()))
    rows += [("900", None), ("901", ""), ("902", "too short"), rows[0], (None, rows[0][1])]
    want = brute_pairs(rows)
    # Many bands, so that even pairs at the threshold are all found.
    run = near_dups.NearDuplicates(spark.createDataFrame(rows, "id string, text string"), bands=80, min_agree=20, hot_tile=hot, block=3)
    assert {(r.id_a, r.id_b) for r in run.record_pairs().collect()} == set(want)
    groups = {r.id: r.group_id for r in run.groups().collect()}
    linked = {x for p in want for x in p}
    assert linked <= set(groups) and all(groups[a] == groups[b] for a, b in want)
    exact = near_dups.NearDuplicates(spark.createDataFrame(rows, "id string, text string"), exact=True, hot_tile=hot, block=3)
    assert {(r.id_a, r.id_b) for r in exact.record_pairs().collect()} == set(want)


def test_near_duplicates_near_the_threshold_as_registered(spark):
    rng = random.Random(5)
    rows, true = [], set()
    for f in range(1500):
        base = [f"x{f}y{i}" for i in range(rng.randrange(60, 140))]
        other = list(base)
        grams = lambda t: {tuple(t[k : k + 3]) for k in range(len(t) - 2)}
        sim = lambda: len(grams(base) & grams(other)) / len(grams(base) | grams(other))
        held = other
        while sim() >= 0.5:
            held = list(other)
            other[rng.randrange(len(other))] = f"z{f}y{rng.randrange(10**9)}"
        true.add((f"{f:04d}a", f"{f:04d}b"))
        rows += [(f"{f:04d}a", " ".join(base)), (f"{f:04d}b", " ".join(held))]
    run = near_dups.NearDuplicates(spark.createDataFrame(rows, "id string, text string"))
    found = {(r.id_a, r.id_b) for r in run.record_pairs().collect()}
    mins = {r.id: bytes(r.mins) for r in run.sketches.select("id", "mins").collect()}
    banded = {(a, b) for a, b in true if any(mins[a][i : i + 6] == mins[b][i : i + 6] for i in range(0, 144, 6))}  # bands of three values of 16 bits
    print(f"recall just above 0.5: {len(found & true)} of {len(true)}")
    # Only the bands may miss a pair; nothing after them does.
    assert found == banded
    assert len(found) >= 0.94 * len(true)
    exact = near_dups.NearDuplicates(spark.createDataFrame(rows, "id string, text string"), exact=True)
    assert {(r.id_a, r.id_b) for r in exact.record_pairs().collect()} == true


def test_bands_keep_their_recall_as_records_grow():
    assert near_dups.banding(0, 0.5) == near_dups.banding(1_000_000, 0.5) == (3, 24)
    for n in (1_000_001, 10**7, 10**9, 10**11):
        rows, bands = near_dups.banding(n, 0.5)
        assert n <= near_dups.PLAIN_RECORDS * 10 ** (rows - 3) and (1 - 0.5**rows) ** bands <= 0.0401


def test_near_duplicates_of_nothing(spark):
    run = near_dups.NearDuplicates(spark.createDataFrame([], "id string, text string"))
    assert run.record_pairs().count() == 0


def test_overlaps_and_bitmap_bound():
    import numpy as np

    rng = np.random.default_rng(0)
    lists = [np.unique(rng.integers(0, 500, rng.integers(5, 300)).astype(np.uint32)) for _ in range(40)]
    data, n = np.concatenate(lists), np.array([len(x) for x in lists])
    at = np.cumsum(n) - n
    x, y = np.triu_indices(40, 1)
    got = near_dups._overlaps(data, at[x], n[x], data, at[y], n[y])
    exact = [len(np.intersect1d(lists[a], lists[b])) for a, b in zip(x, y)]
    assert got.tolist() == exact
    maps = near_dups._bitmaps(data, at, n)
    bound = (n[x] + n[y] - np.bitwise_count(maps[x] ^ maps[y]).sum(1, dtype=np.int64)) // 2
    assert (bound >= exact).all()


def test_words_do_not_run_across_texts():
    shingle = near_dups._Shingler(3, 3)
    picked, _, start, runs = shingle(pa.array(["a b c", "d", "e f g h", "", "A b c"]))
    assert picked.tolist() == [0, 2] and start.tolist() == [0, 1] and len(runs) == 3


def test_nnls_meets_an_exact_histogram():
    import numpy as np

    counts = np.zeros(17, np.int64)
    counts[[10, 6, 4, 2]] = [100, 100, 50, 300]
    plan = packing.plan_bins(counts, depth=3, window=0)
    used = np.zeros(17, np.int64)
    for combo, r in plan:
        assert sum(combo) == 16
        for b in combo:
            used[b] += r
    assert (used <= counts).all() and used[10] >= 99


def test_pricing_equals_brute_force():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    slope = rng.normal(size=13)
    slope[[3, 7]] = -np.inf
    value, combination = packing._Pricing(12, 1, 4)(slope)
    every = [c for k in range(1, 5) for c in itertools.combinations_with_replacement(range(1, 13), k) if sum(c) in (11, 12)]
    best = max(every, key=lambda c: slope[list(c)].sum())
    assert np.isclose(value, slope[list(best)].sum()) and np.isclose(slope[list(combination)].sum(), value) and len(combination) <= 4


@pytest.mark.parametrize(("n", "capacity", "least_fill"), [(1000, 4096, 0.985), (1000, 256, 0.9), (30_000, 1024, 0.99), (3, 4096, 0.0), (0, 100, 0.0)])
def test_most_tokens_are_planned_by_least_squares(n, capacity, least_fill):
    """At every capacity, with many and with few items; every item stands in the plan once."""
    rng = random.Random(7)
    counts = {}
    for _ in range(n):
        size = min(capacity - 1, max(1, int(rng.lognormvariate(5, 0.9))))
        counts[size] = counts.get(size, 0) + 1
    runs = packing.plan(counts, capacity)
    back = {}
    for sizes, k, _ in runs:
        assert sum(sizes) <= capacity and k > 0
        for size in sizes:
            back[size] = back.get(size, 0) + k
    assert back == counts
    tokens = sum(s * k for s, k in counts.items())
    if n >= 1000:
        assert sum(sum(sizes[:planned]) * k for sizes, k, planned in runs) >= 0.75 * tokens
        assert tokens / (capacity * sum(k for _, k, _ in runs)) >= least_fill


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(1)
    sizes = [(i, int(min(900, rng.lognormvariate(4, 0.8)))) for i in range(1500)] + [(9001, 0), (9002, 256), (9003, 600), (None, 5), (0, None)]
    sizes = [s for s in sizes if s != (0, None)] + [sizes[3]]  # a repeated document
    df = spark.createDataFrame(sizes, "doc_id long, tokens long")
    specs = spark.createDataFrame([("short", 256), ("long", 1024), ("bad", None), ("short", 256)], "spec_name string, capacity_tokens long")
    out = packing.pack(df, specs).collect()
    for spec, cap in (("short", 256), ("long", 1024)):
        mine = [r for r in out if r.spec_name == spec]
        room, total = {}, {}
        for r in mine:
            room[r.container_id] = room.get(r.container_id, 0) + r.tokens
            total.setdefault(r.doc_id, []).append(r)
        assert max(room.values()) <= cap
        assert {d: sum(r.tokens for r in rs) for d, rs in total.items()} == {d: n for d, n in sizes if d is not None}
        assert all(len(rs) == 1 for d, rs in total.items() if sum(r.tokens for r in rs) <= cap)
        full = [v for v in room.values() if v]
        assert sum(full) / (len(full) * cap) > 0.97
    assert packing.pack(df.limit(0), specs).count() == 0 and packing.pack(df, specs.limit(0)).count() == 0
    packed = packing.pack(df, specs)
    assert {tuple(r) for r in packing.checked(packed, specs).collect()} == {("short", 1503, 0, 0), ("long", 1503, 0, 0)}
    assert all(r.fill_share > 0.97 and r.planned_share > 0.7 for r in packing.fill(packed, specs.where("capacity_tokens > 0")).collect())


def test_mix_meets_shares_and_caps(spark):
    rng = random.Random(3)
    docs = [(i, ("a", "b", "c")[i % 3] if i % 10 else None, int(rng.lognormvariate(5, 0.7)) + 1) for i in range(3000)] + [(9001, "a", 0), (None, "a", 5)]
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long").repartition(5)
    targets = spark.createDataFrame([("a", 0.6, 2), ("b", 0.3, 3), ("c", 0.05, 1), ("none", 0.05, 4)], "source string, target_share double, max_repeats long")
    used = mixing.mix(df, targets)
    rows = used.collect()
    assert len(rows) == 3001 and all(r.n_uses == 0 for r in rows if r.source is None or r.tokens == 0)
    got = {r.source: r for r in mixing.shares(used, targets).collect()}
    for s, want in (("a", 0.6 / 0.95), ("b", 0.3 / 0.95), ("c", 0.05 / 0.95)):
        assert abs(got[s].actual_share - want) < 0.002
    assert got["none"].actual_share == 0 and got["a"].most_uses <= 2 and got["b"].most_uses <= 3 and got["c"].most_uses <= 1
    short = mixing.shares(mixing.mix(df, targets, total_tokens=10**9), targets).collect()
    assert {r.source: r.most_uses for r in short} == {"a": 2, "b": 3, "c": 1, "none": 0}
    assert mixing.mix(df.limit(0), targets).count() == 0


def test_flight_keeps_both_totals():
    rng = random.Random(0)
    tokens = [rng.randrange(1, 500) for _ in range(400)]
    p = mixing._fly(tokens, [0.37] * 400, rng)
    open_ = [v for v in p if 0 < v < 1]
    assert len(open_) <= 2
    assert abs(sum(p) - 148) < 1e-6 and abs(sum(t * v for t, v in zip(tokens, p)) - 0.37 * sum(tokens)) < 1e-4


def test_registered_near_duplicates_miss_no_pair_at_the_threshold(spark, tmp_path):
    from millrace.llm import queries

    rng = random.Random(11)
    rows, true = [], set()
    for f in range(400):
        base = [f"x{f}y{i}" for i in range(rng.randrange(30, 120))]
        other, held = list(base), base
        grams = lambda t: {tuple(t[k : k + 3]) for k in range(len(t) - 2)}
        while len(grams(base) & grams(other)) >= 0.5 * len(grams(base) | grams(other)):
            held = list(other)
            other[rng.randrange(len(other))] = f"z{f}y{rng.randrange(10**9)}"
        for k in range(1 + f % 3):  # copies of both sides too
            rows += [(f"{f:04d}a{k}", " ".join(base)), (f"{f:04d}b{k}", " ".join(held))]
        true |= {(f"{f:04d}a{k}", f"{f:04d}b{j}") for k in range(1 + f % 3) for j in range(1 + f % 3)}
    spark.createDataFrame(rows, "id string, text string").repartition(3).write.parquet(f"{tmp_path}/synth_records.parquet")
    assert {(r.id_a, r.id_b) for r in queries.p2_found(spark, str(tmp_path)).collect()} == true
    assert {r.id for r in queries.p2_groups(spark, str(tmp_path)).collect()} == {x for p in true for x in p}
